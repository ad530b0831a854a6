"""Numbers that a text states, in digits or in words.

A text is lexed once. Over its lexemes a small grammar reads citations, figures in digits and spelled
numbers; what stands around a figure (a unit behind it, a label before it) is asked of lexemes, too.

    spelled  = [lead] number-word { gap ["and" gap] number-word }
    lead     = ("half" | "a quarter" | "a" | "an") ["of"] ["a"], right before a scale
    value    = sum over the scales from a thousand up of what stands before each, times the scale,
               and what stands behind the last
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: English number words, fractions before a scale, scales, units of dates and quantities,
#: and labels whose numbers are no figures.
SMALL = {w: n for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
SMALL |= {w: 10 * n for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
SCALES = {"hundred": 100, "thousand": 10**3, "million": 10**6, "billion": 10**9}
FRACTIONS = {"half": 0.5, "quarter": 0.25}
UNITS = frozenset("year years yrs ago bce ad ce % percent generation generations century centuries millennium millennia mile miles feet foot meter meters kilometer kilometers day days month months times".split())
UNIT_PAIRS = frozenset({("per", "cent"), ("b", "c"), ("a", "d")})
LABELS = frozenset("paper papers section sections part figure table note volume vol. p. pp.".split())
#: From here a figure counts by itself; a spelled one with a unit counts above this.
LARGE, SPELLED = 1000, 12

_LEXEME = re.compile(r"[A-Za-z0-9_]+|\S")
_WORDS = SMALL.keys() | SCALES.keys()


@dataclass(frozen=True)
class Lexeme:
    text: str
    start: int
    end: int

    @property
    def digits(self) -> bool:
        return self.text.isascii() and self.text.isdigit()


@dataclass(frozen=True)
class Figure:
    """A stated number: its value, the lexemes first to last that state it, and whether in words."""

    value: float
    first: int
    last: int
    spelled: bool


def lex(text: str) -> list[Lexeme]:
    return [Lexeme(m[0], *m.span()) for m in _LEXEME.finditer(text)]


class Reader:
    """Reads the figures of one text; a citation (1:2.3 or 1:2.3-4) states none."""

    def __init__(self, text: str):
        self.text, self.lexemes = text, lex(text)

    def at(self, i: int) -> str:
        return self.lexemes[i].text.lower() if 0 <= i < len(self.lexemes) else ""

    def glued(self, i: int) -> bool:
        """Whether lexeme i follows the one before it at once."""
        return 0 < i < len(self.lexemes) and self.lexemes[i - 1].end == self.lexemes[i].start

    def sequence(self, i: int, marks: str) -> bool:
        """Whether from lexeme i on there are digits, glued together by these marks."""
        for k, mark in enumerate(marks):
            a, b = i + 2 * k + 1, i + 2 * k + 2
            if not (self.at(a) == mark and self.glued(a) and self.glued(b) and self.at(b).isdigit()):
                return False
        return self.at(i).isdigit()

    def citation(self, i: int) -> int:
        """The lexeme behind the citation that starts at i, or i."""
        if not self.sequence(i, ":."):
            return i
        end = i + 5
        return end + 2 if self.at(end) in ("-", "–") and self.at(end + 1).isdigit() else end

    def figures(self) -> Iterator[Figure]:
        i = 0
        while i < len(self.lexemes):
            if (after := self.citation(i)) > i:
                i = after
            elif found := self.digits(i) or self.spelled(i):
                yield found
                i = found.last + 1
            else:
                i += 1

    def digits(self, i: int) -> Figure | None:
        """Digits, in groups of three by commas, or else with a decimal part."""
        if not (i < len(self.lexemes) and self.lexemes[i].digits):
            return None
        last = i
        if len(self.at(i)) <= 3:
            while self.sequence(last, ",") and len(self.at(last + 2)) == 3:
                last += 2
        if last == i and self.sequence(i, "."):
            last += 2
        return Figure(float("".join(self.at(k) for k in range(i, last + 1) if self.at(k) != ",")), i, last, False)

    def spelled(self, i: int) -> Figure | None:
        first = i
        lead = 1 if self.at(i) in ("half", "a", "an") else 0
        if self.at(i) == "a" and self.at(i + 1) == "quarter":
            lead = 2
        if lead:
            lead += self.at(i + lead) == "of"
            lead += self.at(i + lead) == "a"
            if self.at(i + lead) not in SCALES:
                return None
            i += lead
        if self.at(i) not in _WORDS:
            return None
        last = i
        while (after := self.next_word(last)) > last:
            last = after
        return Figure(value_of_words([self.at(k) for k in range(first, last + 1)]), first, last, True)

    def next_word(self, i: int) -> int:
        """The number word that blanks, hyphens and at most one "and" join to word i, or i."""
        k, joined = i + 1, False
        while self.at(k) == "-" or (self.at(k) == "and" and not joined):
            joined |= self.at(k) == "and"
            k += 1
        return k if self.at(k) in _WORDS else i

    def in_clock(self, f: Figure) -> bool:
        """Part of digits with a colon, as 78:5."""
        return self.sequence(f.last, ":") or (f.first >= 2 and self.sequence(f.first - 2, ":"))

    def labelled(self, f: Figure) -> bool:
        """Behind a label, or behind a labelled number and a comma, "and", "to" or a hyphen."""
        k = f.first - 1
        while self.at(k) in (",", "and", "to", "-") and self.at(k - 1).isdigit():
            k -= 2
        return self.at(k) in LABELS or (self.at(k) == "." and self.at(k - 1) + "." in LABELS)

    def has_unit(self, f: Figure) -> bool:
        k = f.last + 1
        if self.at(k) in ("-", "–") and self.at(k + 1).isdigit():
            k += 2
            while self.sequence(k - 1, ","):
                k += 2
        behind = self.at(k + 2) if self.at(k + 1) == "." else self.at(k + 1)
        return self.at(k) in UNITS or (self.at(k), behind) in UNIT_PAIRS


def value_of_words(words: list[str]) -> float | None:
    """The value of number words; None if there are none among them."""
    if not _WORDS & {*words}:
        return None
    cuts = [-1, *(i for i, w in enumerate(words) if SCALES.get(w, 0) >= 1000)]
    parts = sum((_below_thousand(words[a + 1 : b]) or 1) * SCALES[words[b]] for a, b in pairwise(cuts))
    return float(parts + _below_thousand(words[cuts[-1] + 1 :]))


def _below_thousand(words: list[str]) -> float:
    """Hundreds multiply what stands before them; the rest adds up, a fraction or an article counts alone."""
    if "hundred" in words:
        k = len(words) - 1 - words[::-1].index("hundred")
        return (_below_thousand(words[:k]) or 1) * 100 + _below_thousand(words[k + 1 :])
    plain = sum(SMALL.get(w, 0) for w in words)
    return plain + sum(FRACTIONS.get(w, 0) for w in words)


def value_of(phrase: str) -> float | None:
    """The value of a spelled number, None for other words."""
    return value_of_words([x.text.lower() for x in lex(phrase)])


def numbers_in(text: str) -> set[float]:
    """Every number a text states."""
    return {f.value for f in Reader(text).figures()}


def outside(sentence: str) -> str:
    """A sentence without what stands in straight quotation marks, and without citations in parentheses."""
    parts = sentence.split('"')
    if len(parts) % 2 == 0:  # the last mark has no partner
        parts[-2:] = ['"'.join(parts[-2:])]
    first, *opened = " ".join(parts[::2]).split("(")
    for part in opened:
        body, closed, rest = part.partition(")")
        first += f" {rest}" if closed and cites(body) else f"({part}"
    return first


def cites(body: str) -> bool:
    """Whether it starts with a place in a source, as 78:5 or XY 78:5.7."""
    r = Reader(body)
    i = int(bool(r.lexemes) and r.lexemes[0].text.isalpha() and r.lexemes[0].text.isupper() and 2 <= len(r.lexemes[0].text) <= 5)
    return len(r.at(i)) <= 3 and r.at(i).isdigit() and r.at(i + 1) == ":" and r.glued(i + 1)


def own_numbers(sentence: str) -> set[float]:
    """The figures a sentence states in its own words: LARGE ones, and others (spelled ones above SPELLED) before
    a unit. Labels, places in a source and quotations are none."""
    r = Reader(outside(sentence))
    own = (f for f in r.figures() if not r.in_clock(f) and not r.labelled(f))
    return {f.value for f in own if f.value >= LARGE or (r.has_unit(f) and not (f.spelled and f.value <= SPELLED))}


@F.pandas_udf(ArrayType(DoubleType()))
def numbers_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: sorted(numbers_in(t or "")))


@F.pandas_udf(ArrayType(DoubleType()))
def own_numbers_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: sorted(own_numbers(t or "")))


@F.pandas_udf(ArrayType(DoubleType()))
def digits_udf(text: pd.Series) -> pd.Series:
    """The numbers that a text states in digits."""
    return text.map(lambda t: sorted({f.value for f in Reader(t or "").figures() if not f.spelled}))
