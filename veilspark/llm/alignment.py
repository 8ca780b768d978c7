"""Cross-tokenizer alignment: which ids of two vocabularies cover the same bytes, and how often corpus-wide.

A task tokenises its texts by both vocabularies, cuts both sequences where both have a token's end (a group), and
writes for each document the linked id pairs with their multiplicities. These postings are shuffled by the id of side A,
sorted by (A id, part, B id) in streams that spill; the pairs' document counts and their maximum for the A id, found
from pre-aggregated counts, come as further rows of the same streams, in front of their postings (a cogroup without a
buffer). Each posting so becomes a contribution to its document, and contributions are summed by document. Postings of
an A id with many rows are dealt out over parts by document, and the counts of that id go to each of its parts.

Neither vocabulary has a token across a single space between two other characters, so a text falls apart there: a
worker keeps the result of short parts (KEPT_BYTES at most) and builds documents from them. A text with a part whose
tokens do not spell it has no tokens.

Defined results: a null or empty text, and one whose tokens spell other bytes (as with U+2581, or bytes that are no
UTF-8), has no tokens: zeros and ''. Rows count each as a document, repeated ones too, whatever their id; the pairs of a
group are counted by multiplicity, so that a long group costs its different pairs, not its occurrences; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import slices, written
from veilspark.llm.tokens import byte_bpe, ordinary_ids

#: Bytes that a worker's results of parts may take before it begins anew; text bytes of a step.
KEPT_BYTES, STEP_BYTES = 160 << 20, 2 << 20
#: Occurrence pairs of a group from which its ids are counted before they are paired.
WIDE_GROUP = 256
#: Postings of an A id in one part, about.
ROWS_EACH = 16_384
#: A B id takes the low bits of a pair's code, an A id the next ones.
ID_BITS = 20

SPACE_BETWEEN, UNEVEN = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s\s")


class Vocabularies:
    """Both models, the bytes of each of their tokens, and how many they are."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = byte_bpe(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        n = self.b.get_piece_size()
        if max(self.a.n_vocab, n) >> ID_BITS:
            raise ValueError("vocabularies are too large for a pair's code")
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        none = lambda i: self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i)
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else b"" if none(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_bytes = [self.a.decode_single_token_bytes(i) for i in range(self.a.n_vocab)]
        self.a_size, self.b_size = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.a_bytes, self.b_bytes))
        #: No piece holds a space after another character: only then do texts fall apart at single spaces.
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces)
        #: Each id with what follows it in the text of the groups: another id of its side, or the side's end.
        self.a_more, self.a_last, self.b_more, self.b_last = (np.array([f"{i}{end}" for i in range(size)], dtype=object) for size, end in ((self.a.n_vocab, ","), (self.a.n_vocab, "|"), (n, ","), (n, ";")))

    def parts(self, text: str) -> list[str]:
        """The parts of a text, each without the space before it."""
        if not self.apart:
            return [text]
        return SPACE_BETWEEN.split(text) if text[:1] == " " or text[-1:] == " " or UNEVEN.search(text) else text.split(" ")

    def a_ids(self, parts: list[str]) -> list[int]:
        """The A ids of all parts, each with a space before it. Parts that end or begin with white space stand alone."""
        ids: list[int] = []
        plain: list[str] = []
        for part in parts:
            if self.apart and not part[0].isspace() and not part[-1].isspace():
                plain.append(part)
                continue
            if plain:
                ids += ordinary_ids(self.a, f" {' '.join(plain)}")
                plain = []
            ids += ordinary_ids(self.a, f" {part}")
        return ids + ordinary_ids(self.a, f" {' '.join(plain)}") if plain else ids


@cache
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    return Vocabularies(a_path, b_path)


def wide_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and multiplicities of one group's pairs."""
    (x, n), (y, m) = (np.unique(side, return_counts=True) for side in (a, b))
    return (x[:, None] << ID_BITS | y).ravel(), (n[:, None] * m).ravel()


class Aligned:
    """The alignments of parts: their numbers (n_a, n_b, n_groups, n_links), their groups as text, their pairs as codes and times.

    sizes: how many codes each part has; a code may stand there more than once.
    """

    def __init__(self, both: Vocabularies, parts: list[str]):
        lengths = np.array([1 + len(p.encode()) for p in parts], dtype=np.int64)
        ends = np.cumsum(lengths)
        a_ids, b_lists = both.a_ids(parts), both.b.encode(parts, num_threads=1)
        b_ids = [i for ids in b_lists for i in ids]
        raw = "".join([f" {p}" for p in parts]).encode()
        a_raw, b_raw = b"".join([both.a_bytes[i] for i in a_ids]), b"".join([both.b_bytes[i] for i in b_ids])
        a, b = np.array(a_ids, dtype=np.int64), np.array(b_ids, dtype=np.int64)
        a_ends, b_ends = np.cumsum(both.a_size[a]), np.cumsum(both.b_size[b])
        self.spelt = raw == a_raw == b_raw
        if not self.spelt:  # the caller takes the parts one by one
            return
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        of_a, of_b = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        wide, high = np.bincount(of_a, minlength=len(common)), np.bincount(of_b, minlength=len(common))
        part = np.searchsorted(ends, common)  # of each group; a part's end is an end of both sides
        groups, links = len(parts), wide * high
        self.numbers = np.stack([np.bincount(part, weights=w, minlength=groups).astype(np.int64) for w in (wide, high, np.ones(len(common)), links)])

        last_a, last_b = np.r_[of_a[1:] != of_a[:-1], True], np.r_[of_b[1:] != of_b[:-1], True]
        said = np.r_[np.where(last_a, both.a_last[a], both.a_more[a]), np.where(last_b, both.b_last[b], both.b_more[b])]
        said = said[np.argsort(np.r_[2 * of_a, 2 * of_b + 1], kind="stable")].tolist()
        stops = np.cumsum(self.numbers[0] + self.numbers[1]).tolist()
        self.text = ["".join(said[i:j]) for i, j in zip([0, *stops], stops, strict=False)]  # each group ends with a semicolon

        first_a, first_b = np.cumsum(wide) - wide, np.cumsum(high) - high
        few = np.flatnonzero(links <= WIDE_GROUP)
        group = np.repeat(few, links[few])
        nth = np.arange(len(group)) - np.repeat(np.cumsum(links[few]) - links[few], links[few])
        codes = a[first_a[group] + nth // high[group]] << ID_BITS | b[first_b[group] + nth % high[group]]
        owner, times = part[group], np.ones(len(codes), dtype=np.int64)
        for g in np.flatnonzero(links > WIDE_GROUP).tolist():
            c, t = wide_pairs(a[first_a[g] : first_a[g] + wide[g]], b[first_b[g] : first_b[g] + high[g]])
            codes, times, owner = np.r_[codes, c], np.r_[times, t], np.r_[owner, np.full(len(c), part[g])]
        order = np.argsort(owner, kind="stable")
        self.codes, self.times, self.sizes = codes[order], times[order], np.bincount(owner, minlength=groups)


class Worker:
    """The alignments of the parts it has met, as one table that grows with each step and begins anew when it is full."""

    def __init__(self, both: Vocabularies):
        self.both = both
        self.empty()

    def empty(self) -> None:
        self.place: dict[str, int] = {}
        self.text: list[str] = []
        self.numbers, self.codes, self.times = np.empty((4, 0), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.first, self.sizes, self.held = np.empty(0, np.int64), np.empty(0, np.int64), 0

    def learn(self, parts: list[str]) -> None:
        found = Aligned(self.both, parts)
        if not found.spelt:
            if len(parts) == 1:
                self.place[parts[0]] = -1
            else:  # halves, until what can't be spelt stands alone
                self.learn(parts[: len(parts) // 2])
                self.learn(parts[len(parts) // 2 :])
            return
        self.place.update(zip(parts, range(len(self.text), len(self.text) + len(parts)), strict=True))
        self.text += found.text
        self.first = np.r_[self.first, len(self.codes) + np.cumsum(found.sizes) - found.sizes]
        self.sizes, self.codes, self.times = np.r_[self.sizes, found.sizes], np.r_[self.codes, found.codes], np.r_[self.times, found.times]
        self.numbers = np.concatenate([self.numbers, found.numbers], axis=1)
        self.held += sum(map(len, parts)) + sum(map(len, found.text)) + 300 * len(parts) + 16 * len(found.codes)

    def documents(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """The numbers (four rows) and digests of texts; then how many codes each has, the codes and their times."""
        if self.held > KEPT_BYTES:
            self.empty()
        parts = [self.both.parts(t) if t else [] for t in texts]
        new = [p for p in {p for each in parts for p in each} if p not in self.place]
        if new:
            self.learn(new)
        at = [list(map(self.place.__getitem__, each)) for each in parts]
        at = [x if x and min(x) >= 0 else [] for x in at]
        digests = [hashlib.sha256("".join([self.text[i] for i in x])[:-1].encode()).hexdigest() if x else "" for x in at]
        flat = np.array([i for x in at for i in x], dtype=np.int64)
        owner = np.repeat(np.arange(len(at)), [len(x) for x in at])
        numbers = np.stack([np.bincount(owner, weights=row[flat], minlength=len(at)).astype(np.int64) for row in self.numbers])
        sizes = self.sizes[flat]
        place = np.repeat(self.first[flat] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        codes = np.repeat(owner, sizes) << 2 * ID_BITS | self.codes[place]
        order = np.argsort(codes, kind="stable")
        codes, times = codes[order], self.times[place][order]
        begins = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]][: len(codes)])
        codes, times = codes[begins], np.add.reduceat(times, begins) if len(begins) else times
        return numbers, digests, np.bincount(codes >> 2 * ID_BITS, minlength=len(at)), codes & (1 << 2 * ID_BITS) - 1, times


@cache
def worker(a_path: str, b_path: str) -> Worker:
    return Worker(vocabularies(a_path, b_path))


def decoded(raw: bytes | None) -> str:
    """The text, or an empty one for bytes that are no UTF-8."""
    try:
        return (raw or b"").decode()
    except UnicodeDecodeError:
        return ""


def aligned_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each document: rid (of this table alone), doc_id, the digests, and its pairs as codes and times."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid, mine = TaskContext.get().partitionId() << 40, worker(a_path, b_path)
        for batch in slices(batches, most=STEP_BYTES):
            numbers, digests, sizes, codes, times = mine.documents([decoded(x) for x in batch.column("text").cast(pa.binary()).to_pylist()])
            ends = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            rids = np.arange(rid, rid + len(digests), dtype=np.int64)
            rid += len(digests)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rids), batch.column("doc_id").cast(pa.int64()), *map(pa.array, numbers), pa.array(digests, pa.string()), *(pa.ListArray.from_arrays(ends, x) for x in (codes, times))],
                ["rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times"],
            )

    schema = "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, times array<long>"
    return docs.select("doc_id", "text").mapInArrow(align, schema)


def counted(postings: DataFrame) -> DataFrame:
    """a, b, n (documents with the pair), most (of the A id's pairs), parts (over which the A id's postings are dealt)."""
    pairs = postings.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    of_a = Window.partitionBy("a")
    parts = F.ceil(F.sum("n").over(of_a) / F.greatest(F.lit(ROWS_EACH), 4 * F.count(F.lit(1)).over(of_a)))
    return pairs.select("a", "b", "n", F.max("n").over(of_a).alias("most"), parts.cast("int").alias("parts"))


def alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs."""
    a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    rows = written(aligned_documents(docs, a_path, b_path), "aligned")
    a, b = F.shiftright("pair.codes", ID_BITS), F.col("pair.codes").bitwiseAND((1 << ID_BITS) - 1)
    postings = rows.select("rid", F.explode(F.arrays_zip("codes", "times")).alias("pair")).select("rid", a.cast("int").alias("a"), b.cast("int").alias("b"), F.col("pair.times").alias("times"))
    counts = written(counted(postings), "pair-counts")
    many = counts.filter("parts > 1").select("a", "parts").distinct()  # a row for an A id at most: bounded by the vocabulary
    part = F.pmod(F.xxhash64("rid"), F.coalesce("parts", F.lit(1))).cast("int")
    none = F.lit(None).cast("long")
    left = postings.join(F.broadcast(many), "a", "left").select("a", part.alias("part"), "b", "rid", "times", none.alias("n"), none.alias("most"))
    right = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "b", none.alias("rid"), none.alias("times"), "n", "most")
    streams = left.unionByName(right).repartition("a", "part")
    ahead = Window.partitionBy("a", "part", "b").orderBy(F.asc_nulls_first("rid")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = streams.select("rid", "times", F.max("n").over(ahead).alias("n"), F.max("most").over(ahead).alias("most")).filter("rid IS NOT NULL")
    given = met.groupBy("rid").agg(F.sum(F.when(F.col("n") == F.col("most"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    base = rows.select("rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    out = base.hint("merge").join(given, "rid", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
