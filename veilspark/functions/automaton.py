"""Many needles in one pass: an Aho-Corasick automaton, and what a Python worker keeps of it between tasks."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from typing import Generic, TypeVar

import ahocorasick
from pyspark import SparkContext
from pyspark.sql import SparkSession

T = TypeVar("T")


class Needles:
    """Distinct needles by number. The work on a text grows with its length and its hits, not with the needles."""

    def __init__(self, needles: list[str]):
        self.lengths = [len(n) for n in needles]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, needle in enumerate(needles):
            if needle:
                self.automaton.add_word(needle, i)
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()

    def hits(self, text: str) -> Iterator[tuple[int, int, int]]:
        """start, end, number, by end; of one needle's hits that overlap each other the first counts."""
        if not self.any:
            return
        free: dict[int, int] = {}
        for last, i in self.automaton.iter(text):
            start = last + 1 - self.lengths[i]
            if start >= free.get(i, 0):
                free[i] = last + 1
                yield start, last + 1, i

    def present(self, text: str) -> set[int]:
        return {i for _, i in self.automaton.iter(text)} if self.any else set()


#: What this worker has built, the latest last.
_built: OrderedDict[str, object] = OrderedDict()
MOST_BUILT = 8


class Shared(Generic[T]):
    """A value for UDFs: its plain parts are broadcast once, and each worker process builds it once of them."""

    def __init__(self, parts: object, build: Callable[[object], T]):
        context: SparkContext = SparkSession.active().sparkContext
        self.key, self.parts, self.build = uuid.uuid4().hex, context.broadcast(parts), build

    def get(self) -> T:
        if self.key not in _built:
            _built[self.key] = self.build(self.parts.value)
            while len(_built) > MOST_BUILT:
                _built.popitem(last=False)
        return _built[self.key]


#: Bytes or letters of texts that a Python worker answers at a time.
PART = 1 << 20


def parts(sizes: Sequence[int], most: int = PART) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of rows of about `most` together (one larger row is a run of its own); of no rows one empty run."""
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > most:
            yield begin, i
            begin, held = i, 0
        held += n
    yield begin, len(sizes)
