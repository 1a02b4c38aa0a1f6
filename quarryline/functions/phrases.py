"""Many phrases found in one pass: an automaton over words, and the choice of the longest spans that don't overlap."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import deque

_WORD = re.compile(r"[^\W_]+")
#: What may stand between two words of a phrase.
_GAP = re.compile(r"[ \t\n\r\f\v _./-]{1,3}")


def words_of(text: str) -> list[tuple[str, int, int]]:
    """(word in lower case, begin, end) of a text."""
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


class PhraseAutomaton:
    """Aho and Corasick's automaton over the words of phrases; a text's words are each read once, however many phrases there are.

    Phrases match whole words without regard to case; between their words a text has white space, a hyphen or the like. A phrase without
    words never matches.
    """

    def __init__(self, phrases: list[str]):
        self.steps: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.back = [0]
        self.sizes = [len(words_of(p)) for p in phrases]
        for number, phrase in enumerate(phrases):
            at = 0
            for word, _, _ in words_of(phrase):
                if word not in self.steps[at]:
                    self.steps[at][word] = len(self.steps)
                    self.steps.append({})
                    self.ends.append([])
                    self.back.append(0)
                at = self.steps[at][word]
            if at:
                self.ends[at].append(number)
        queue = deque(self.steps[0].values())
        while queue:
            at = queue.popleft()
            self.ends[at] = self.ends[at] + self.ends[self.back[at]]
            for word, to in self.steps[at].items():
                self.back[to] = self._next(self.back[at], word)
                queue.append(to)

    def _next(self, at: int, word: str) -> int:
        while at and word not in self.steps[at]:
            at = self.back[at]
        return self.steps[at].get(word, 0)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(begin, end, number of the phrase) of all places, overlapping ones too."""
        out, at, read = [], 0, words_of(text)
        for i, (word, begin, end) in enumerate(read):
            if at and not _GAP.fullmatch(text, read[i - 1][2], begin):
                at = 0
            at = self._next(at, word)
            for number in self.ends[at]:
                out.append((read[i - self.sizes[number] + 1][1], end, number))
        return out


def longest_apart(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of spans the longest ones that don't overlap, in order; of equally long ones the earlier, then the phrase that was given first."""
    begins: list[int] = []
    kept: list[tuple[int, int, int]] = []
    for span in sorted(spans, key=lambda s: (s[0] - s[1], s[0], s[2])):
        place = bisect_left(begins, span[0])
        if (place == 0 or kept[place - 1][1] <= span[0]) and (place == len(kept) or kept[place][0] >= span[1]):
            begins.insert(place, span[0])
            kept.insert(place, span)
    return kept
