"""A compiler for a small template language of conversations: syntax tree, folded constants, generated Python closures.

The language: text, ``{# remark #}``, ``{{ expression }}``, ``{% if e %}/{% elif e %}/{% else %}/{% endif %}``,
``{% for name in e %}/{% endfor %}``, ``{% set name = e %}`` and ``{% generation %}/{% endgeneration %}``, whose text is marked as the
model's. A ``-`` inside a tag strips white space at that side. Expressions have strings, integers, true, false, none, lists, names, items
(``a.b``, ``a['b']``), ``+ - * % ~``, comparisons, ``in``, ``and or not``, ``a if c else b``, ``is defined``, ``is none`` and filters
(``trim upper lower length string escape default(e)``).

Sandbox: an item is looked up in mappings and sequences alone, never as an attribute of a Python object, there are no calls, imports or
assignments outside the template's own names, integers and repeated strings are bounded, and a name nobody gave is undefined (empty as text).

A template must go over ``messages`` in one outermost loop, and read them nowhere else; so a conversation may be rendered in pieces, each
told where it lies. Parameters (such as control strings) are constants: what depends on them alone is folded when compiling.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    """A template that can't be compiled, or asks for something that the sandbox forbids."""


class Undefined:
    """What a missing name or item gives: false, and empty as text."""

    def __bool__(self) -> bool:
        return False

    def __str__(self) -> str:
        return ""


UNDEFINED = Undefined()
#: Bounds of the sandbox on integers' bits and on the length of text that one expression makes.
MAX_BITS, MAX_TEXT = 64, 1 << 26


@dataclass(frozen=True)
class Node:
    """kind, value, parts: one form for expressions and statements keeps folding short."""

    kind: str
    value: Any = None
    parts: tuple = field(default=())


_TAG = re.compile(r"\{#.*?#\}|\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<mark>==|!=|<=|>=|[-+*%~<>()\[\].,|=:]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_BINARY = ({"or"}, {"and"}, {"==", "!=", "<", "<=", ">", ">=", "in"}, {"+", "-", "~"}, {"*", "%"})
FILTERS = ("trim", "upper", "lower", "length", "string", "escape", "default")


class _Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, text: str):
        self.tokens, at, text = [], 0, text.rstrip()
        while at < len(text):
            if not (m := _TOKEN.match(text, at)):
                raise TemplateError(f"unreadable: {text[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "string" else None

    def take(self, *wanted: str) -> bool:
        if self.peek() in wanted:
            self.at += 1
            return True
        return False

    def need(self, mark: str) -> None:
        if not self.take(mark):
            raise TemplateError(f"{mark!r} expected, {self.peek()!r} found")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name expected")

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"not expected: {self.tokens[self.at][1]!r}")

    def choice(self) -> Node:
        then = self.binary(0)
        if self.take("if"):
            test = self.binary(0)
            other = self.choice() if self.take("else") else Node("constant", UNDEFINED)
            return Node("choose", None, (test, then, other))
        return then

    def binary(self, level: int) -> Node:
        if level == len(_BINARY):
            return self.unary()
        if level == 2 and self.take("not"):
            return Node("not", None, (self.binary(2),))
        left = self.binary(level + 1)
        while (mark := self.peek()) in _BINARY[level] or (level == 2 and mark in ("not", "is")):
            self.at += 1
            if mark == "is":
                negated, test = self.take("not"), self.name()
                if test not in ("defined", "none"):
                    raise TemplateError(f"no such test: {test}")
                left = Node(test, None, (left,))
                left = Node("not", None, (left,)) if negated else left
            elif mark == "not":
                self.need("in")
                left = Node("not", None, (Node("in", None, (left, self.binary(level + 1))),))
            else:
                left = Node(mark, None, (left, self.binary(level + 1)))
        return left

    def unary(self) -> Node:
        if self.take("-"):
            return Node("-", None, (Node("constant", 0), self.unary()))
        made = self.primary()
        while True:
            if self.take("."):
                made = Node("item", None, (made, Node("constant", self.name())))
            elif self.take("["):
                made = Node("item", None, (made, self.choice()))
                self.need("]")
            elif self.take("|"):
                kind, given = self.name(), ()
                if kind not in FILTERS:
                    raise TemplateError(f"no such filter: {kind}")
                if self.take("("):
                    given = (self.choice(),)
                    self.need(")")
                if (kind == "default") != bool(given):
                    raise TemplateError(f"arguments of {kind}")
                made = Node("filter", kind, (made, *given))
            else:
                return made

    def primary(self) -> Node:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            return Node("constant", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "number":
            return Node("constant", int(text))
        if kind == "name":
            known = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
            return Node("constant", known[text]) if text in known else Node("name", text)
        if text == "(":
            made = self.choice()
            self.need(")")
            return made
        if text == "[":
            parts = []
            while not self.take("]"):
                parts.append(self.choice())
                if not self.take(","):
                    self.need("]")
                    break
            return Node("list", None, tuple(parts))
        raise TemplateError(f"not expected: {text!r}")


def _expression(text: str) -> Node:
    made = _Expression(text)
    node = made.choice()
    made.end()
    return node


def parse(template: str) -> Node:
    """The syntax tree of a template."""
    pieces, at, strip = [], 0, False
    for tag in _TAG.finditer(template):
        text = template[at : tag.start()]
        text = text.lstrip() if strip else text
        whole = tag.group()
        pieces.append(("text", text.rstrip() if whole[2] == "-" else text))
        strip, at = whole[-3] == "-", tag.end()
        if not whole.startswith("{#"):
            pieces.append(("show", tag[1]) if tag[1] is not None else ("do", tag[2].strip()))
    pieces.append(("text", template[at:].lstrip() if strip else template[at:]))
    place = 0

    def block(ends: tuple[str, ...]) -> tuple[Node, str]:
        nonlocal place
        made = []
        while place < len(pieces):
            kind, text = pieces[place]
            place += 1
            if kind == "text":
                made.append(Node("text", text))
            elif kind == "show":
                made.append(Node("show", None, (_expression(text),)))
            else:
                word, _, rest = text.partition(" ")
                if word in ends:
                    return Node("block", None, tuple(made)), text
                made.append(statement(word, rest))
        if ends:
            raise TemplateError(f"missing: {' or '.join(ends)}")
        return Node("block", None, tuple(made)), ""

    def statement(word: str, rest: str) -> Node:
        if word == "if":
            then, end = block(("elif", "else", "endif"))
            if end.startswith("elif"):
                other = statement("if", end.partition(" ")[2])
            else:
                other = block(("endif",))[0] if end == "else" else Node("block")
            return Node("if", None, (_expression(rest), then, other))
        if word == "for":
            tokens = _Expression(rest)
            name = tokens.name()
            tokens.need("in")
            over = tokens.choice()
            tokens.end()
            return Node("for", name, (over, block(("endfor",))[0]))
        if word == "set":
            tokens = _Expression(rest)
            name = tokens.name()
            tokens.need("=")
            given = tokens.choice()
            tokens.end()
            return Node("set", name, (given,))
        if word == "generation":
            return Node("generation", None, (block(("endgeneration",))[0],))
        raise TemplateError(f"no such statement: {word!r}")

    return block(())[0]


def _item(of: Any, at: Any) -> Any:
    if isinstance(of, dict):
        return of.get(at, UNDEFINED)
    if isinstance(of, (list, str)) and isinstance(at, int) and -len(of) <= at < len(of):
        return of[at]
    return UNDEFINED


def _bounded(value: Any) -> Any:
    if isinstance(value, int) and value.bit_length() > MAX_BITS or isinstance(value, (str, list)) and len(value) > MAX_TEXT:
        raise TemplateError("an expression gives too much")
    return value


def _times(a: Any, b: Any) -> Any:
    if isinstance(a, int) and isinstance(b, int):
        return a * b
    if isinstance(a, str) and isinstance(b, int) and len(a) * b <= MAX_TEXT:
        return a * b
    raise TemplateError("* takes integers, or a text and an integer")


def _rest(a: Any, b: Any) -> Any:
    if isinstance(a, int) and isinstance(b, int) and b:
        return a % b
    raise TemplateError("% takes integers")


_OPERATIONS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "+": lambda a, b: _bounded(a + b), "-": lambda a, b: _bounded(a - b), "~": lambda a, b: _bounded(_shown(a) + _shown(b)),
    "*": lambda a, b: _bounded(_times(a, b)), "%": _rest,
    "not": lambda a: not a, "defined": lambda a: a is not UNDEFINED, "none": lambda a: a is None, "item": _item,
}


def _shown(value: Any) -> str:
    return value if isinstance(value, str) else "" if value is None else str(value)


class Compiler:
    """Folds a tree under given constants and generates closures (names, out) -> None; ``out`` gets (text, marked) parts."""

    def __init__(self, constants: dict[str, Any], escape: Callable[[str], str]):
        self.constants, self.escape = constants, escape

    def filtered(self, kind: str, value: Any, *given: Any) -> Any:
        if kind == "length":
            return len(value) if isinstance(value, (str, list, dict)) else 0
        if kind == "default":
            return given[0] if value is UNDEFINED else value
        text = _shown(value)
        return {"trim": text.strip, "upper": text.upper, "lower": text.lower, "string": lambda: text, "escape": lambda: self.escape(text)}[kind]()

    def fold(self, node: Node, bound: frozenset = frozenset()) -> Node:
        """The tree with constant parts computed; names in ``bound`` are the template's own, so they aren't the constants of that name."""
        kind, parts = node.kind, node.parts
        if kind == "name":
            return Node("constant", self.constants[node.value]) if node.value in self.constants and node.value not in bound else node
        if kind == "block":
            made, bound = [], frozenset(bound)
            for part in parts:
                if part.kind == "set":
                    part = Node("set", part.value, (self.fold(part.parts[0], bound),))
                    bound |= {part.value}
                    made.append(part)
                    continue
                part = self.fold(part, bound)
                bound |= _assigned(part)
                for one in part.parts if part.kind == "block" else (part,):
                    if one.kind == "text" and made and made[-1].kind == "text":
                        made[-1] = Node("text", made[-1].value + one.value)
                    elif one.kind != "text" or one.value:
                        made.append(one)
            return made[0] if len(made) == 1 and made[0].kind == "text" else Node("block", None, tuple(made))
        if kind == "for":
            inner = bound | {node.value, "loop"} | _assigned(parts[1])
            return Node("for", node.value, (self.fold(parts[0], bound), self.fold(parts[1], inner)))
        parts = tuple(self.fold(p, bound) for p in parts)
        if kind == "show" and parts[0].kind == "constant":
            return Node("text", _shown(parts[0].value))
        if kind in ("if", "choose") and parts[0].kind == "constant":
            return parts[1] if parts[0].value else parts[2]
        if kind in ("and", "or") and parts[0].kind == "constant":
            return parts[1] if bool(parts[0].value) == (kind == "and") else parts[0]
        if kind == "generation" and parts[0].kind == "block" and not parts[0].parts:
            return Node("block")
        node = Node(kind, node.value, parts)
        if parts and all(p.kind == "constant" for p in parts) and (kind in _OPERATIONS or kind in ("filter", "list")):
            return Node("constant", self.value(node)({}))
        return node

    def value(self, node: Node) -> Callable[[dict], Any]:
        """A closure for an expression."""
        kind, known = node.kind, node.value
        if kind == "constant":
            return lambda names: known
        if kind == "name":
            return lambda names: names.get(known, UNDEFINED)
        made = [self.value(p) for p in node.parts]
        if kind == "list":
            return lambda names: [m(names) for m in made]
        if kind == "filter":
            return lambda names: self.filtered(known, *[m(names) for m in made])
        if kind == "choose":
            return lambda names: made[1](names) if made[0](names) else made[2](names)
        if kind == "and":
            return lambda names: made[0](names) and made[1](names)
        if kind == "or":
            return lambda names: made[0](names) or made[1](names)
        run = _OPERATIONS[kind]

        def operation(names: dict) -> Any:
            try:
                return run(*[m(names) for m in made])
            except TypeError as wrong:
                raise TemplateError(f"{kind}: {wrong}") from None

        return operation

    def statement(self, node: Node, marked: bool = False) -> Callable[[dict, list], None]:
        """A closure for a statement; whether its text is marked is settled here, not when it runs."""
        kind = node.kind
        if kind == "text":
            part = (node.value, marked)
            return lambda names, out: out.append(part)
        if kind == "show":
            shown = self.value(node.parts[0])
            return lambda names, out: out.append((_shown(shown(names)), marked))
        if kind == "set":
            name, given = node.value, self.value(node.parts[0])
            return lambda names, out: names.__setitem__(name, given(names))
        if kind == "generation":
            return self.statement(node.parts[0], True)
        if kind == "if":
            test, then, other = self.value(node.parts[0]), self.statement(node.parts[1], marked), self.statement(node.parts[2], marked)
            return lambda names, out: then(names, out) if test(names) else other(names, out)
        if kind == "for":
            name, over, body = node.value, self.value(node.parts[0]), self.statement(node.parts[1], marked)

            def loop(names: dict, out: list) -> None:
                rows = over(names)
                if not isinstance(rows, list):
                    raise TemplateError("for goes over lists")
                for at, row in enumerate(rows):
                    body({**names, name: row, "loop": place(at, len(rows))}, out)

            return loop
        if kind != "block":
            raise TemplateError(f"no statement: {kind}")
        steps = [self.statement(p, marked) for p in node.parts]

        def block(names: dict, out: list) -> None:
            for step in steps:
                step(names, out)

        return block


def place(at: int, size: int) -> dict:
    """What ``loop`` is at one message."""
    return {"index0": at, "index": at + 1, "first": at == 0, "last": at == size - 1, "length": size}


def _assigned(node: Node) -> frozenset:
    """Names that a statement sets around itself."""
    if node.kind == "set":
        return frozenset([node.value])
    inside = node.parts[1:] if node.kind == "if" else node.parts if node.kind in ("block", "generation") else ()
    return frozenset().union(*map(_assigned, inside)) if inside else frozenset()


def _reads(node: Node, name: str) -> bool:
    return node.kind == "name" and node.value == name or any(_reads(p, name) for p in node.parts)


@dataclass(frozen=True)
class Compiled:
    """Closures for what stands before the messages, for one message, and for what stands after them."""

    before: Callable[[dict, list], None]
    message: Callable[[dict, list], None]
    after: Callable[[dict, list], None]
    name: str
    tree: Node

    def parts(self, message: dict, at: int, size: int) -> list[tuple[str, bool]]:
        """The (text, marked) parts of message number ``at`` of ``size``, with what stands before the first and after the last."""
        out: list[tuple[str, bool]] = []
        names: dict = {}
        self.before(names, out)
        if at:
            out.clear()
        self.message({**names, self.name: message, "loop": place(at, size)}, out)
        if at == size - 1:
            self.after(names, out)
        return out


def compile_template(template: str, constants: dict[str, Any] | None = None, escape: Callable[[str], str] = str) -> Compiled:
    """Closures of a template that goes once over ``messages``."""
    compiler = Compiler(constants or {}, escape)
    tree = compiler.fold(parse(template))
    steps = tree.parts if tree.kind == "block" else (tree,)
    loops = [i for i, s in enumerate(steps) if s.kind == "for" and s.parts[0] == Node("name", "messages")]
    if len(loops) != 1 or sum(_reads(s, "messages") for s in steps) != 1 or _reads(steps[loops[0]].parts[1], "messages"):
        raise TemplateError("a template goes over messages in one outermost loop, and reads them nowhere else")
    at = loops[0]
    before, after = (compiler.statement(Node("block", None, tuple(s))) for s in (steps[:at], steps[at + 1 :]))
    return Compiled(before, compiler.statement(steps[at].parts[1]), after, steps[at].value, tree)
