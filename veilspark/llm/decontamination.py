"""Benchmark decontamination by one Aho-Corasick automaton over normalised test questions and answers.

Texts are normalised byte by byte (letters A-Z lowered, separators to spaces), so that every place in the normalised
text is the same place in the original; words are then set with single spaces between them. The automaton holds each
different window of the items once and reads a text once, whatever the number of items; the word that an occurrence
ends with gives the words it covers, and their bytes in the original.

Windows are collected in blocks of BLOCK_BYTES, so that the automaton that a worker builds has a bounded size. One
block, the usual case, is one pass without a shuffle. Beyond it each block is a pass of its own over all documents,
and the hits of a document are put together by its key.

Defined results: null text has no words; an item without words has no window; a null item_id counts as an item of
its own with the empty string as its id; items of the same id count once; repeated rows are each judged; an empty
table of documents gives no rows, an empty benchmark no hits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import slices, texts, written

#: Words of a window, and bytes of the windows that one automaton holds.
WINDOW, BLOCK_BYTES = 10, 4 << 20
#: What separates words, and the letters that are lowered.
SEPARATORS, UPPER = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)], range(0x41, 0x5B)
NORMAL = bytes(0x20 if i in SEPARATORS else i + 0x20 if i in UPPER else i for i in range(256))

#: A run of hit words: the first, the one after the last, and its bytes in the original text.
SPANS = "array<struct<first: long, last: long, begin: long, end: long>>"


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """window, items: each different window of the items with the sorted ids of those that have it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, found = [], []
            for item, text in zip(batch.column("item").to_pylist(), texts(batch), strict=True):
                words = text.translate(NORMAL).split()
                for i in range(max(len(words) - size, 0) + 1 if words else 0):
                    ids.append(item)
                    found.append(b" ".join(words[i : i + size]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.binary())], ["item", "window"])

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    each = named.mapInArrow(cut, "item string, window binary").groupBy("window", "item").agg(F.lit(1))
    return each.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def blocks(found: DataFrame, most: int) -> Iterator[list[tuple[bytes, list[str]]]]:
    """The rows of `windows` by blocks of at most about `most` bytes each; the driver holds one block at a time."""
    held: list[tuple[bytes, list[str]]] = []
    size = 0
    for row in found.toLocalIterator():
        weight = len(row["window"]) + sum(map(len, row["items"]))
        if held and size + weight > most:
            yield held
            held, size = [], 0
        held.append((bytes(row["window"]), row["items"]))
        size += weight
    yield held


class Scanner:
    """Finds the windows of one block in texts."""

    def __init__(self, block: list[tuple[bytes, list[str]]]):
        self.items, self.length = [items for _, items in block], np.array([w.count(b" ") + 1 for w, _ in block], dtype=np.int64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, (window, _) in enumerate(block):
            self.automaton.add_word(f" {window.decode('latin-1')} ", i)
        if block:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, np.ndarray, list[str]]:
        """The number of words; a row for each run of hit words, as in SPANS; the items found."""
        normal = text.translate(NORMAL)
        words = normal.split()
        none = np.empty((0, 4), np.int64)
        if not words or not self.items:
            return len(words), none, []
        line = b" %b " % b" ".join(words)
        found = list(self.automaton.iter(line.decode("latin-1")))  # bytes as characters: places stay bytes
        if not found:
            return len(words), none, []
        ends, which = np.array(found, dtype=np.int64).T
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
        after = np.searchsorted(spaces, ends)  # the word after the last of the window
        change = np.bincount(after - self.length[which], minlength=len(words) + 1) - np.bincount(after, minlength=len(words) + 1)
        runs = edges(np.cumsum(change)[:-1] > 0)
        places = edges(np.frombuffer(normal, np.uint8) != 0x20)
        spans = np.column_stack([runs, places[runs[:, 0], 0], places[runs[:, 1] - 1, 1]])
        return len(words), spans, sorted({x for i in np.unique(which).tolist() for x in self.items[i]})


def edges(inside: np.ndarray) -> np.ndarray:
    """The beginning and the end of each run of true values."""
    return np.flatnonzero(np.diff(np.r_[False, inside, False])).reshape(-1, 2)


def scanned(docs: DataFrame, block: list[tuple[bytes, list[str]]]) -> DataFrame:
    """The columns of docs but text, then n_words, spans and items of one block."""
    sent = docs.sparkSession.sparkContext.broadcast(block)  # BLOCK_BYTES, about
    kept = [c for c in docs.columns if c != "text"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sent.value)
        for batch in slices(batches):
            n_words, spans, items = zip(*(scanner.scan(t) for t in texts(batch)), strict=True)
            flat = pa.StructArray.from_arrays([pa.array(c) for c in np.concatenate(spans).T], ["first", "last", "begin", "end"])
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, spans)]).astype(np.int32), flat)
            found = [pa.array(n_words, pa.int64()), lists, pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *found], [*kept, "n_words", "spans", "items"])

    types = dict(docs.dtypes)
    return docs.mapInArrow(scan, ", ".join([*(f"`{c}` {types[c]}" for c in kept), f"n_words long, spans {SPANS}, items array<string>"]))


def merged(spans: Column) -> Column:
    """Runs in any order; those that meet or overlap become one."""
    last = lambda s: F.try_element_at(s, F.lit(-1))

    def add(s: Column, x: Column) -> Column:
        longer = F.struct(last(s)["first"].alias("first"), *(F.greatest(last(s)[c], x[c]).alias(c) if c != "begin" else last(s)[c].alias(c) for c in ("last", "begin", "end")))
        return F.when(x["first"] <= last(s)["last"], F.concat(F.slice(s, 1, F.size(s) - 1), F.array(longer))).otherwise(F.concat(s, F.array(x)))

    return F.aggregate(F.slice(spans, 2, F.greatest(F.size(spans), F.lit(1))), F.slice(spans, 1, 1), add)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (the runs of hit words, as in SPANS), items (the ids found, sorted as strings)."""
    every = blocks(written(windows(items, window), "windows"), block_bytes)
    first, second = next(every), next(every, None)
    if second is None:
        return scanned(docs.select("doc_id", "text"), first)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"), "text")
    passes = [written(scanned(keyed, block), "block-hits") for block in chain((first, second), every)]
    hits = reduce(DataFrame.unionByName, (rows.filter("size(items) > 0") for rows in passes))
    key = F.struct(F.coalesce("doc_id", F.lit(0)).alias("id"), F.isnull("doc_id").alias("none"), "h", "g").alias("key")
    together = hits.groupBy(key).agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in ("spans", "items")))
    met = passes[0].select(key, "doc_id", "n_words").hint("merge").join(together, "key", "left")
    return met.select("doc_id", "n_words", F.coalesce(merged(F.col("spans")), F.array().cast(SPANS.replace("long", "bigint"))).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
