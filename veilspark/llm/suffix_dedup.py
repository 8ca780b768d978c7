"""Removal of repeated 200-byte strings by column-wise construction over many documents.

The collection is cut so that each part stays small, and no string that repeats is separated from its copies:

1. Every 200-byte window of a document has one anchor: its GRAM-byte substring with the least hash (leftmost
   of equals). Equal windows have equal anchors at equal places, so windows need comparing only with those of
   the same anchor. A run of windows with one anchor is a segment of at most 336 bytes.
2. Anchors met once are dropped after counting hashes. Equal segments are reduced to one with a count; what is
   in a segment with a count over 1 repeats.
3. Distinct segments of one anchor, aligned at it, form a collection. Its columns are taken from the right,
   one symbol of each segment a round. A round reorders the segments by the symbol put in front (the
   collection's Burrows-Wheeler step: a stable sort of the permuted symbols) and updates the common prefix of
   neighbours: one more than the least over the span between two that now follow each other. A window repeats
   if its suffix shares 200 bytes with a neighbour's when its column is reached.

Between the steps Spark's sorted shuffle files hold the sequences, read in order. A collection of over
HOT_SEGMENTS segments is not put in one task: its segments are compared with one of them, which settles all
windows that one has; the rest is divided by the distance of the anchor and the bytes around it that equal windows
hold alike, into collections of their own (`shared_windows`).

Defined results: null text is empty; matches lie in one document; texts under 200 bytes have no windows;
repeated rows repeat each other's strings; an empty table gives no rows; other columns are ignored by the
digest query, and carried along by `without_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.common import lookup, own_names, slices, texts, written

WINDOW, GRAM = 200, 32
PLACES = WINDOW - GRAM + 1
#: Bytes hashed at once; segments of one collection before it is split; segments a batch.
PART_BYTES, HOT_SEGMENTS, BATCH_SEGMENTS = 1 << 20, 1_000, 20_000
MULTIPLIER, MIX = 0x9E3779B97F4A7C15 | 1, np.uint64(0xBF58476D1CE4E5B9)
BYTE_VALUES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers and inverse powers modulo 2**64."""
    size = max(PART_BYTES + WINDOW, n)
    if size not in _powers:
        forward = np.full(size, np.uint64(MULTIPLIER))
        back = np.full(size, np.uint64(pow(MULTIPLIER, -1, 1 << 64)))
        forward[0] = back[0] = 1
        _powers.clear()
        _powers[size] = np.cumprod(forward), np.cumprod(back)
    forward, back = _powers[size]
    return forward[:n], back[:n]


def sliding_least(values: np.ndarray, span: int) -> np.ndarray:
    reach = 1
    while 2 * reach <= span:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[: len(values) - (span - reach)], values[span - reach :]) if reach < span else values


def anchors(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """first window, last window, anchor place and anchor hash of each segment of the texts that end at `ends` in data."""
    byte = np.frombuffer(data, dtype=np.uint8)
    n = len(byte)
    if n < WINDOW:
        return (np.empty(0, dtype=np.int64),) * 4
    forward, back = powers(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[byte] * forward, out=total[1:])
    gram = (total[GRAM:] - total[:-GRAM]) * back[: n - GRAM + 1]
    gram ^= gram >> np.uint64(31)
    gram *= MIX
    gram ^= gram >> np.uint64(29)
    packed = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    place = (sliding_least(packed, PLACES) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    change = np.zeros(n + 1, dtype=np.int32)
    fits = ends - begins >= WINDOW
    np.add.at(change, begins[fits], 1)
    np.add.at(change, ends[fits] - WINDOW + 1, -1)
    at = np.flatnonzero(np.cumsum(change[: len(place)]) > 0)
    if not len(at):
        return (np.empty(0, dtype=np.int64),) * 4
    owner = place[at]
    new = np.flatnonzero((np.diff(owner) != 0) | (np.diff(at) != 1)) + 1
    first = np.concatenate([[0], new])
    last = np.concatenate([new, [len(at)]]) - 1
    return at[first], at[last], owner[first], gram[owner[first]].view(np.int64)


def parts(raw: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of about PART_BYTES, the ends of its pieces, and row and offset of each; a long text's pieces overlap by a window less one byte."""
    pieces, held = [], 0
    step = PART_BYTES - WINDOW + 1
    for row, text in enumerate(raw):
        for offset in range(0, max(1, len(text) - WINDOW + 1), step):
            piece = text[offset : offset + PART_BYTES]
            if held and held + len(piece) > PART_BYTES:
                yield assembled(pieces)
                pieces, held = [], 0
            pieces.append((piece, row, offset))
            held += len(piece)
    if pieces:
        yield assembled(pieces)


def assembled(pieces: list[tuple[bytes, int, int]]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    return b"".join(p[0] for p in pieces), np.cumsum([len(p[0]) for p in pieces]), np.array([p[1] for p in pieces]), np.array([p[2] for p in pieces])


def anchor_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        for data, ends, _, _ in parts(texts(batch)):
            yield pa.RecordBatch.from_arrays([pa.array(anchors(data, ends)[3])], ["anchor"])


#: A segment's place: 40 bits for its first window, 12 each for its windows less one and its anchor's distance.
def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        ids, prints = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "print"))
        for data, ends, rows, offsets in parts(texts(batch)):
            low, high, place, anchor = anchors(data, ends)
            digest = xxhash.xxh3_128_digest
            sums = np.frombuffer(b"".join([digest(data[a : b + WINDOW]) for a, b in zip(low.tolist(), high.tolist(), strict=True)]), dtype=np.int64).reshape(-1, 2)
            piece = np.searchsorted(ends, low, side="right")
            begins = low - (ends[piece] - np.diff(np.concatenate([[0], ends]))[piece]) + offsets[piece]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (ids[rows[piece]], prints[rows[piece]], (begins << 24) | ((high - low) << 12) | (place - low), anchor, sums[:, 0], sums[:, 1])],
                ["id", "print", "place", "anchor", "sum1", "sum2"],
            )


def repeating_windows(bucket: np.ndarray, data: bytes, begins: np.ndarray, sizes: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Collections of aligned segments, one for each value of bucket, taken together: rows (segment, first, last) of repeating windows.

    Segment i is data[begins[i] : begins[i] + sizes[i]], its anchor lies `distance[i]` bytes in.
    """
    byte, many = np.frombuffer(data, dtype=np.uint8), len(bucket)
    group = np.unique(bucket, return_inverse=True)[1].astype(np.int64) << 9
    order = np.argsort(group, kind="stable")
    common = np.zeros(many + 1, dtype=np.int32)
    open_at = np.full(many, -1, dtype=np.int64)
    found = []
    for column in range(WINDOW - 1, -PLACES, -1):  # relative to the anchor
        at = distance[order] + column
        there = (at >= 0) & (at < sizes[order])
        symbol = np.where(there, byte[np.minimum(begins[order] + np.maximum(at, 0), len(byte) - 1)], 256)
        rank = group[order] | symbol
        step = np.argsort(rank, kind="stable")
        follows = np.zeros(many, dtype=bool)
        follows[1:] = (rank[step[1:]] == rank[step[:-1]]) & (symbol[step[1:]] < 256)
        new = np.zeros(many + 1, dtype=np.int32)
        pair = np.flatnonzero(follows)
        if len(pair):
            spans = np.column_stack([step[pair - 1] + 1, step[pair] + 1]).ravel()
            new[pair] = np.minimum.reduceat(common, spans)[::2] + 1
        order, common = order[step], new
        if column <= 0:
            repeats = np.zeros(many, dtype=bool)
            repeats[order] = (common[:-1] >= WINDOW) | (common[1:] >= WINDOW)
            start = distance + column
            repeats &= (start >= 0) & (start + WINDOW <= sizes)
            begun, ended = np.flatnonzero(repeats & (open_at < 0)), np.flatnonzero(~repeats & (open_at >= 0))
            found.append(np.column_stack([ended, start[ended] + 1, open_at[ended]]))
            open_at[ended] = -1
            open_at[begun] = start[begun]
    last = np.flatnonzero(open_at >= 0)
    found.append(np.column_stack([last, (distance - PLACES + 1)[last], open_at[last]]))
    return np.concatenate(found)


def collections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From segments sorted by bucket: the window ranges (first, last, from the segment's start) that repeat."""
    columns = ["bucket", "anchor", "sum1", "sum2", "low", "high", "begin", "segment"]

    def answered(table: pa.Table) -> pa.RecordBatch:
        raw = [x.as_py() for x in table.column("segment")]
        sizes = np.array([len(x) for x in raw], dtype=np.int64)
        bucket, anchor, one, two, low, high, begin = (table.column(c).to_numpy() for c in columns[:7])
        found = repeating_windows(bucket, b"".join(raw), np.cumsum(sizes) - sizes, sizes, begin.astype(np.int64))
        first, last = np.maximum(found[:, 1], (begin - high)[found[:, 0]]), np.minimum(found[:, 2], (begin - low)[found[:, 0]])
        own = first <= last  # windows of other distances are marked with their own half
        i = found[own, 0]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor[i], one[i], two[i], first[own], last[own])], ["anchor", "sum1", "sum2", "first", "last"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch.select(columns))
        if sum(b.num_rows for b in held) >= BATCH_SEGMENTS:
            table = pa.Table.from_batches(held).combine_chunks()
            bucket = table.column("bucket").to_numpy()
            cut = int(np.searchsorted(bucket, bucket[-1]))
            if cut:
                yield answered(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
    if held and sum(b.num_rows for b in held):
        yield answered(pa.Table.from_batches(held))


def shared_bytes(x: bytes, y: bytes) -> int:
    low, high = 0, min(len(x), len(y))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if x[:middle] == y[:middle] else (low, middle - 1)
    return low


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds left and right: the bytes before and behind the anchor that a segment shares with the first of its collection."""
    for batch in batches:
        first = batch.column("first").to_pylist()
        pairs = [(s, b, f["segment"], f["begin"]) for s, b, f in zip(batch.column("segment").to_pylist(), batch.column("begin").to_pylist(), first, strict=True)]
        left = [shared_bytes(s[:b][::-1], t[:c][::-1]) for s, b, t, c in pairs]
        right = [shared_bytes(s[b + GRAM :], t[c + GRAM :]) for s, b, t, c in pairs]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(left, pa.int32()), pa.array(right, pa.int32())], [*batch.schema.names, "left", "right"])


def divided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment once for every part of its anchor distances low..high that has windows not shared with the first.

    All windows of the distances low..high hold the bytes from `low` before the anchor to where the one of `high`
    ends; key is their digest. With low = high that is the one window.
    """
    same = ["anchor", "sum1", "sum2", "begin", "segment"]
    for batch in batches:
        row, keys, lows, highs = [], [], [], []
        lists = [batch.column(c).to_pylist() for c in ("low", "high", "begin", "segment", "left", "right", "cuts")]
        for i, (low, high, begin, segment, left, right, cuts) in enumerate(zip(*lists, strict=True)):
            inner = sorted({c for c in cuts if low < c <= high}) or [(low + high) // 2 + 1]
            for a, b in zip([low, *inner], [*(c - 1 for c in inner), high], strict=True):
                least, most = max(a, begin + WINDOW - len(segment)), min(b, begin)
                if least <= most and (least < PLACES - 1 - right or most > left):
                    row.append(i)
                    keys.append(xxhash.xxh3_128_digest(bytes([a, b]) + segment[begin - a : begin - b + WINDOW]))
                    lows.append(a)
                    highs.append(b)
        taken = batch.select(same).take(pa.array(row, pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(lows, pa.int32()), pa.array(highs, pa.int32()), *taken.columns], ["key", "low", "high", *same])


def cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with text and wanted (structs of a segment): the segments' bytes."""
    kinds = ["anchor", "sum1", "sum2", "n"]
    for batch in slices(batches):
        out: dict[str, list] = {c: [] for c in [*kinds, "begin", "segment"]}
        for text, wanted in zip(texts(batch), batch.column("wanted").to_pylist(), strict=True):
            for w in wanted:
                first, more, begin = w["place"] >> 24, (w["place"] >> 12) & 4095, w["place"] & 4095
                for c in kinds:
                    out[c].append(w[c])
                out["begin"].append(begin)
                out["segment"].append(text[first : first + more + WINDOW])
        yield pa.RecordBatch.from_arrays([*(pa.array(out[c], pa.int64()) for c in kinds), pa.array(out["begin"], pa.int32()), pa.array(out["segment"], pa.binary())], list(out))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with id and print: rows that agree in both have the same doc_id and text."""
    return docs.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("print", F.xxhash64(F.coalesce("text", F.lit(""))))


def shared_windows(cut: DataFrame) -> DataFrame:
    """anchor, sum1, sum2, first, last: the windows that different segments of cut share.

    In a collection that is too large for one task all segments are compared with one of it, the first. That answers
    for the windows shared with the first. The rest is divided by anchor distance, in turn where most segments part
    from the first and in the middle, and in each part by the bytes that all windows of such distances hold.
    Parts that fit are collections, parts of one window are met several times, others are divided again.
    """
    partitions = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = ["anchor", "sum1", "sum2"]
    kind = "key binary, low int, high int, anchor long, sum1 long, sum2 long, begin int, segment binary"
    rows = cut.select(F.unhex(F.lpad(F.hex("anchor"), 16, "0")).alias("key"), F.lit(0).alias("low"), F.lit(PLACES - 1).alias("high"), *name, "begin", "segment")
    fitting, marks = [], []
    for turn in count():
        sizes = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.max(F.col("high") - F.col("low")).alias("spread")).filter("kinds > 1"), "collection-sizes")
        fits, one = F.col("kinds") <= HOT_SEGMENTS, F.col("spread") == 0
        met = lookup(rows, sizes, "key", "kinds")
        fitting.append(met.filter(fits & ~one).withColumn("bucket", F.xxhash64("key")).drop("key", "kinds", "spread"))
        start = (F.col("begin") - F.col("low")).cast("long")
        marks.append(met.filter(one).select(*name, start.alias("first"), start.alias("last")))
        if sizes.filter(~fits & ~one).isEmpty():
            break
        large = written(met.filter(~fits & ~one).select("key", "low", "high", *name, "begin", "segment"), "large-collections")
        firsts = large.groupBy("key").agg(F.min(F.struct(*name, "begin", "segment")).alias("first"), F.count(F.lit(1)).alias("kinds"))
        beside = lookup(large, firsts, "key", "kinds").filter(F.struct(*name) != F.struct(*[f"first.{c}" for c in name])).select(*large.columns, "first")
        beside = written(beside.mapInArrow(compared, f"{kind}, first struct<anchor: long, sum1: long, sum2: long, begin: int, segment: binary>, left int, right int"), "compared")
        least, most = F.greatest("low", PLACES - 1 - F.col("right")), F.least("high", "left")
        ranges = lambda begin: [(begin - most).cast("long").alias("first"), (begin - least).cast("long").alias("last")]
        equal = beside.filter(least <= most)
        marks.append(equal.select(*name, *ranges(F.col("begin"))))
        marks.append(equal.select(*[f"first.{c}" for c in name], *ranges(F.col("first.begin"))).distinct())
        partings = F.array(PLACES - 1 - F.mode("right"), F.mode("left") + 1) if turn % 2 == 0 else F.array().cast("array<int>")
        cuts = beside.groupBy("key").agg(partings.alias("cuts"), F.count(F.lit(1)).alias("kinds"))
        rows = written(lookup(beside.drop("first"), cuts, "key", "kinds").mapInArrow(divided, kind), "divided")
    together = reduce(DataFrame.unionByName, fitting).repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return reduce(DataFrame.unionByName, marks, together.mapInArrow(collections, "anchor long, sum1 long, sum2 long, first long, last long"))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """id, print, ranges: for documents with repeating strings, the byte ranges (begin, end) that these cover, with overlaps."""
    rows = keyed(docs).select("id", "print", "text")
    twice = rows.select("text").mapInArrow(anchor_hashes, "anchor long").groupBy("anchor").count().filter("count > 1").select("anchor")
    twice = written(twice, "anchors-met-twice")
    found = rows.mapInArrow(segments, "id long, print long, place long, anchor long, sum1 long, sum2 long").hint("merge").join(twice, "anchor")
    found = written(found, "segments")
    name = ["anchor", "sum1", "sum2"]
    distinct = written(found.groupBy(*name).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "print", "place")).alias("one")), "distinct-segments")
    mixed = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    mixed = written(mixed, "mixed-anchors")
    wanted = distinct.hint("merge").join(mixed, "anchor").select(F.col("one.id").alias("id"), F.col("one.print").alias("print"), F.struct(*name, "n", "one.place").alias("w"))
    wanted = wanted.groupBy("id", "print").agg(F.collect_list("w").alias("wanted"))  # as many as a document has segments
    kind = "anchor long, sum1 long, sum2 long, n long, begin int, segment binary"
    cut = written(rows.hint("merge").join(wanted, ["id", "print"]).select("text", "wanted").mapInArrow(cut_segments, kind).dropDuplicates(name), "segment-bytes")
    whole = distinct.filter("n > 1").select(*name, F.lit(0).cast("long").alias("first"), F.shiftright(F.col("one.place"), 12).bitwiseAND(4095).alias("last"))
    marks = written(whole.unionByName(shared_windows(cut)), "marks")
    low = F.shiftright("place", 24)
    return (
        found.hint("merge").join(marks, name)
        .select("id", "print", F.struct((low + F.col("first")).alias("begin"), (low + F.col("last") + WINDOW).alias("end")).alias("r"))
        .groupBy("id", "print").agg(F.collect_list("r").alias("ranges"))  # as many as a document has segments, or windows in hot ones
    )


def runs(ranges: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs; ranges that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["begin"], r["end"]) for r in ranges or []):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def kept_bytes(text: bytes, removed: list[tuple[int, int]]) -> bytes:
    begins, ends = [0, *(b for _, b in removed)], [*(a for a, _ in removed), len(text)]
    return b"".join(text[a:b] for a, b in zip(begins, ends, strict=True))


def whole_characters(text: bytes, removed: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without bytes of characters that they only touch, so that what is left is UTF-8."""
    inside = lambda i: i < len(text) and 0x80 <= text[i] < 0xC0
    out = []
    for a, b in removed:
        while inside(a):
            a += 1
        while inside(b):
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def with_ranges(docs: DataFrame) -> DataFrame:
    ranges = written(repeated_ranges(docs), "ranges")
    return keyed(docs).hint("merge").join(ranges, ["id", "print"], "left")


def removal_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text, ranges in zip(texts(batch), batch.column("ranges").to_pylist(), strict=True):
                removed = runs(ranges)
                out.append((len(text), sum(b - a for a, b in removed), len(removed), hashlib.sha256(kept_bytes(text, removed)).hexdigest()))
            sizes, gone, spans, sums = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, gone, spans)), pa.array(sums, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_ranges(docs.select("doc_id", "text")).select("doc_id", "text", "ranges").mapInArrow(digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs, all columns, with repeated strings taken out of text (characters only partly in one stay), n_chars counted anew."""
    names = docs.columns
    their_id, their_print, found, mine, my_print = own_names(names, "their_id", "their_print", "ranges", "id", "print")
    ranges = written(repeated_ranges(docs.select("doc_id", "text")), "ranges").select(F.col("id").alias(their_id), F.col("print").alias(their_print), F.col("ranges").alias(found))
    rows = docs.withColumn(mine, F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn(my_print, F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = rows.hint("merge").join(ranges, (F.col(mine) == F.col(their_id)) & (F.col(my_print) == F.col(their_print)), "left").select(*[F.col(f"`{c}`") for c in names], found)

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, ranges = texts(batch), batch.column(found).to_pylist()
            left = [kept_bytes(t, whole_characters(t, runs(r))) if r else t for t, r in zip(raw, ranges, strict=True)]
            none = [x is None for x in batch.column("text").to_pylist()]
            columns = {c: batch.column(c) for c in names}
            columns["text"] = pa.array([None if n else t for t, n in zip(left, none, strict=True)], pa.binary()).cast(pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t.decode()) for t in left], columns["n_chars"].type) if columns["n_chars"].type in (pa.int64(), pa.int32()) else columns["n_chars"]
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return joined.mapInArrow(cleaned, T.StructType(docs.schema.fields))
