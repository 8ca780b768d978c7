"""Spelling an alias in the way that the name it replaces is spelled: in pandas UDFs, the one part that column expressions can't say well.

A token falls into parts, spans of it. Only what lies between the first and the last part of a match is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F

from veilspark.functions.automaton import Shared
from veilspark.functions.text import PIECES, STOP_WORDS

#: What may join the parts of a token, in order of precedence, and the parts of one that nothing joins.
JOINERS = ("_", "-", ".", " ")
HUMPS = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z0-9]+|[A-Z]+|[0-9]+")

#: Ways to spell the first word of an alias and all further ones.
WAYS: dict[str, tuple[Callable[[str], str], Callable[[str], str]]] = {
    "upper": (str.upper, str.upper), "lower": (str.lower, str.lower), "title": (str.capitalize, str.capitalize), "hump": (str.lower, str.capitalize),
}


class Spelling(NamedTuple):
    spans: list[tuple[int, int]]
    joiner: str
    way: str


def spelling(token: str) -> Spelling:
    """The spans of a token's parts, and how an alias in it is joined and spelled.

    Parts of a joined token are what its first joiner leaves. Else a token of one case is one part, in which an alias of
    several words is joined by dashes, and any other falls into humps, joined by nothing.
    """
    joiner = next((j for j in JOINERS if j in token), None)
    if joiner:
        spans = [m.span() for m in re.finditer(f"[^{re.escape(joiner)}]+", token)]
        words = [w for a, b in spans if any(map(str.isalpha, w := token[a:b]))]
        way = "upper" if words and all(map(str.isupper, words)) else "title" if words and all(w[:1].isupper() for w in words) else "lower"
        return Spelling(spans, joiner, way)
    if token.isupper() or token.islower():
        return Spelling([(0, len(token))], "-", "upper" if token.isupper() else "lower")
    return Spelling([m.span() for m in HUMPS.finditer(token)], "", "hump")


def written_like(words: list[str], like: Spelling, opens_upper: bool) -> str:
    """The words joined and spelled; the first hump begins as what it replaces."""
    first, further = WAYS["title" if like.way == "hump" and opens_upper else like.way]
    return like.joiner.join([first(w) if i == 0 else further(w) for i, w in enumerate(words)])


def in_style_of(sample: str, words: list[str]) -> str:
    """The words in the style of a whole sample."""
    return written_like(words, spelling(sample), sample[:1].isupper())


def parts_of(token: str) -> list[str]:
    return [token[a:b].lower() for a, b in spelling(token).spans]


class Stems:
    """Runs of parts, found in tokens by their first part, so that a token costs the same whatever the number of stems."""

    def __init__(self, stems: list[list[str]], words: list[list[str]]):
        self.words = words
        self.by_first: dict[str, list[tuple[int, tuple[str, ...]]]] = {}
        for number, stem in enumerate(stems):
            if stem:
                self.by_first.setdefault(stem[0], []).append((number, tuple(stem)))

    def hits(self, token: str) -> list[tuple[int, int, str, int]]:
        """begin, end, new text and number of the first run of each stem that the token has."""
        like = spelling(token)
        parts = [token[a:b].lower() for a, b in like.spans]
        found: dict[int, tuple[int, int, str, int]] = {}
        for at, part in enumerate(parts):
            for number, stem in self.by_first.get(part, ()):
                if number not in found and tuple(parts[at : at + len(stem)]) == stem:
                    begin, end = like.spans[at][0], like.spans[at + len(stem) - 1][1]
                    found[number] = begin, end, written_like(self.words[number], like, token[begin].isupper()), number
        return list(found.values())


def replacement(token: str, stem: list[str], words: list[str]) -> tuple[int, int, str] | None:
    """begin, end and new text of the first run of the stem's parts in a token."""
    return next((hit[:3] for hit in Stems([stem], [words]).hits(token)), None)


def splice(token: str, stem: list[str], alias: list[str]) -> str:
    found = replacement(token, [s.lower() for s in stem], alias)
    return token[: found[0]] + found[2] + token[found[1] :] if found else token


def splicer(stem: list[str], alias: list[str]):
    """A pandas UDF that splices whole columns of distinct tokens."""

    @F.pandas_udf("string")
    def run(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: None if t is None else splice(t, stem, alias))

    return run


def common_subsequence(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def indel_ratio(a: str, b: str) -> float:
    return 200.0 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


#: No surface of stop words and numbers alone is compared; fixed value: none shorter than this.
FUZZY_STOP_WORDS = frozenset(STOP_WORDS)
LEAST_FUZZY = 6


def token_set_ratio(a: str, b: str) -> float:
    """The best of the common words, and those with either side's others, among each other; 100 where one side has no others."""
    one, two = set(a.split()), set(b.split())
    if not one or not two:
        return 0.0
    both, left, right = (" ".join(sorted(x)) for x in (one & two, one - two, two - one))
    if both and not (left and right):
        return 100.0
    gap = bool(both)
    rows = [(len(left) + len(right) - 2 * common_subsequence(left, right), 2 * (len(both) + gap) + len(left) + len(right))]
    if both:
        rows += [(gap + len(x), 2 * len(both) + gap + len(x)) for x in (left, right)]
    return max(100.0 * (1 - far / size) for far, size in rows)


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of its length in the longer one, or less at an end."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0 if long else 100.0
    m = len(short)
    best = max(indel_ratio(short, long[max(i, 0) : i + m]) for i in range(1 - m, len(long)))
    return max(best, *(indel_ratio(long, short[max(i, 0) : i + m]) for i in range(1 - m, m))) if m == len(long) else best


def fuzzy_ratio(surface: str, target: str) -> float:
    """The best of the plain, token-set and (for a surface of 0.6 of the target at least) partial ratio; 0 for what is not compared."""
    parts = [p.lower() for p in re.findall(PIECES, surface)]
    if min(len(surface), len(target)) < LEAST_FUZZY or parts and all(p in FUZZY_STOP_WORDS or p.isdigit() for p in parts):
        return 0.0
    a, b = surface.lower(), target.lower()
    best = max(indel_ratio(a, b), token_set_ratio(a, b))
    return max(best, partial_ratio(a, b)) if len(a) >= 0.6 * len(b) else best


def fuzzy_ratios():
    """A pandas UDF of two columns, surface and target: fuzzy_ratio, 0 for nulls."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([0.0 if x is None or y is None else round(fuzzy_ratio(x, y), 4) for x, y in zip(a, b, strict=True)])

    return run


IDENTIFIER = re.compile(r"[A-Za-z0-9]+(?:_[A-Za-z0-9]+)+|[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*")


class Respeller:
    """In each identifier, runs of a pair's first parts become its second, longest runs first; no part of what was put in is taken again."""

    def __init__(self, pairs: list[tuple[list[str], list[str]]]):
        ordered = sorted(([p.lower() for p in stem], words) for stem, words in pairs if stem)
        ordered.sort(key=lambda p: -sum(map(len, p[0])))
        self.stems = Stems([stem for stem, _ in ordered], [words for _, words in ordered])
        self.token = lru_cache(1 << 16)(self.token)

    def token(self, token: str) -> str:
        taken: list[tuple[int, int, str]] = []
        for begin, end, text, _ in sorted(self.stems.hits(token), key=lambda hit: hit[3]):
            if all(end <= a or b <= begin for a, b, _ in taken):
                taken.append((begin, end, text))
        for a, b, text in sorted(taken, reverse=True):
            token = token[:a] + text + token[b:]
        return token

    def line(self, text: str) -> str:
        return IDENTIFIER.sub(lambda found: self.token(found[0]), text)


def respeller(pairs: list[tuple[list[str], list[str]]]):
    """A pandas UDF over lists of text that applies a `Respeller`."""
    shared = Shared(pairs, Respeller)

    @F.pandas_udf("array<string>")
    def run(lines: pd.Series) -> pd.Series:
        line = shared.get().line
        return lines.map(lambda some: None if some is None else [line(t) for t in some])

    return run
