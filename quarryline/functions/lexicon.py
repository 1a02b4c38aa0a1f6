"""Words with one meaning and many spellings: tables that become one pattern, longest spelling first, so the most specific one counts.

A table maps a canonical text to its spellings. In a spelling, a blank stands for white space or a hyphen or nothing between words that are
written together too (``hell grau`` and ``hellgrau``) if it is a ``~``, for white space alone if it is a blank, and ``-`` for either or none.
Spellings match whole words without regard to case.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_LETTER = r"[\p{L}\p{N}]"
_GAPS = {" ": r"\s+", "-": r"[-\s]?", "~": r"\s*"}


def pattern(spelling: str) -> str:
    return "".join(_GAPS.get(c) or (r"\." if c == "." else re.escape(c) if not c.isalnum() else c) for c in spelling)


def any_of(spellings: list[str]) -> str:
    """One alternative of many, longer spellings first, as a whole word."""
    listed = "|".join(pattern(s) for s in sorted(dict.fromkeys(spellings), key=lambda s: (-len(s), s)))
    return rf"(?<!{_LETTER})(?:{listed})(?!{_LETTER})"


def bare(text: Column) -> Column:
    """Lower-case letters and digits, as spellings are compared."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def _key(spelling: str) -> str:
    return "".join(c for c in spelling.lower() if c.isalnum())


def matches(text: Column, table: dict[str, list[str]]) -> Column:
    """An array of structs (name, raw, tier) of a text's words of a table, in order; tier is the place of the name in the table."""
    spellings = [(s, name, tier) for tier, (name, listed) in enumerate(table.items()) for s in listed]
    entries = {}
    for s, name, tier in spellings:
        entries.setdefault(_key(s), (name, tier))
    known = F.create_map(*[c for k, (name, tier) in entries.items() for c in (F.lit(k), F.struct(F.lit(name).alias("name"), F.lit(tier).alias("tier")))])
    found = F.regexp_extract_all(text, F.lit(f"(?iu)({any_of([s for s, _, _ in spellings])})"), F.lit(1))
    return F.transform(found, lambda raw: F.struct(known[bare(raw)]["name"].alias("name"), raw.alias("raw"), known[bare(raw)]["tier"].alias("tier")))


def names(text: Column, table: dict[str, list[str]]) -> Column:
    """The canonical names in a text, each once, in order."""
    return F.array_distinct(F.filter(F.transform(matches(text, table), lambda m: m["name"]), lambda n: n.isNotNull()))
