"""SimHash near-duplicates, found through Golay-code keys.

A fingerprint of 64 bits is cut into three segments, each a word of the binary [23, 12, 7] Golay code space.
That code is perfect: every word has one nearest codeword, at most 3 bits away, and one or six codewords at
most 4 bits away. Of two words that differ in at most one bit, either one's nearest codeword is therefore
among those at most 4 bits from the other. Three differing bits fall on three segments so that either all
segments differ in at most one bit, or, if one segment takes two or three, of the others one is equal and one
differs in at most one bit. Seven kinds of key cover these cases:

* near or nearby codewords of all three segments (36 bits);
* for each ordered pair of segments, the first as it is and a codeword index of the second (33 or 34 bits).

Each distinct fingerprint offers its keys in two roles, `probe` and `offer`; a probe and an offer with equal
keys are verified bit by bit. Fingerprints are distinct before that, so copies cost nothing. Links that
survive are contracted to components by rounds of star operations; a bucket never expands into all pairs
(see `bucket_links`).

Defined results: null text is the empty text, its fingerprint is zero and links like any other; repeated rows
share a fingerprint; an empty table gives no rows; component_id is the smallest reachable doc_id, null ids
are passed over (null only if all are); other columns are carried by `one_of_each` and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import lookup, own_names, slices, texts, written

SHINGLE, DISTANCE, SEED = 3, 3, 42
LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
#: The Golay code's generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1, and the cut of 64 bits.
GENERATOR, SEGMENTS = 0b110001110101, ((0, 22), (22, 21), (43, 21))


def shingle_hashes(text: bytes) -> list[int]:
    words = text.translate(LOWER).split()
    if not words:
        return []
    if len(words) < SHINGLE:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    line = b" ".join(words)
    begins = [0]
    at = 0
    for w in words:
        at += len(w) + 1
        begins.append(at)
    digest = xxhash.xxh64_intdigest
    return [digest(line[a : b - 1], SEED) for a, b in zip(begins, begins[SHINGLE:], strict=False)]


def fingerprints(raw: list[bytes]) -> np.ndarray:
    """One uint64 for each text. Bit counts of up to 255 hashes are summed at once in the byte lanes of a word."""
    out = np.zeros(len(raw), dtype=np.uint64)
    each = [shingle_hashes(t) for t in raw]
    sizes = np.array([len(h) for h in each], dtype=np.int64)
    filled = np.flatnonzero(sizes)
    if not len(filled):
        return out
    h = np.array([x for one in each for x in one], dtype=np.uint64)
    ends = np.cumsum(sizes[filled])
    begins = ends - sizes[filled]
    runs = -(-sizes[filled] // 255)
    first_run = np.cumsum(runs) - runs
    starts = np.repeat(begins, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first_run, runs))
    lanes = np.empty((len(starts), 8, 8), dtype=np.uint8)  # run, bit within byte, byte
    for k in range(8):
        lanes[:, k, :] = np.add.reduceat((h >> np.uint64(k)) & np.uint64(0x0101010101010101), starts).astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.add.reduceat(lanes.astype(np.int64), first_run, axis=0)
    bits = 2 * counts > sizes[filled][:, None, None]
    weights = np.uint64(1) << (np.arange(8, dtype=np.uint64)[:, None] + np.uint64(8) * np.arange(8, dtype=np.uint64)[None, :])
    out[filled] = (bits * weights).sum(axis=(1, 2), dtype=np.uint64)
    return out


def fingerprint_table(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the columns in more (strings) and fp (the fingerprint as a signed long)."""
    names = ["doc_id", *more]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=2 << 20):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(fingerprints(texts(batch)).view(np.int64))], [*names, "fp"])

    return docs.select(*names, "text").mapInArrow(hashed, f"doc_id long, {''.join(f'{c} string, ' for c in more)}fp long")


def syndrome(word: np.ndarray) -> np.ndarray:
    word = word.astype(np.int64)
    for bit in range(22, 10, -1):
        word = np.where((word >> bit) & 1, word ^ (GENERATOR << (bit - 11)), word)
    return word


@cache
def cosets() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error pattern of the nearest codeword; those of all codewords at most 4 bits away (-1: none)."""
    leader, nearby, filled = np.zeros(2048, dtype=np.int64), np.full((2048, 6), -1, dtype=np.int64), np.zeros(2048, dtype=np.int64)
    for weight in range(5):
        patterns = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)], dtype=np.int64)
        for s, pattern in zip(syndrome(patterns), patterns, strict=True):
            if weight < 4:
                leader[s] = pattern
            nearby[s, filled[s]] = pattern
            filled[s] += 1
    return leader, nearby


def code_indices(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest codeword's 12-bit index, and those of all codewords at most 4 bits away (-1: none)."""
    leader, nearby = cosets()
    s = syndrome(word)
    patterns = nearby[s]
    return (word ^ leader[s]) >> 11, np.where(patterns < 0, -1, (word[:, None] ^ patterns) >> 11)


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row in fp, role (0 probe, 1 offer), key: of all keys of distinct fingerprints."""
    word = [((fp >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    near, ball = zip(*[code_indices(w) for w in word], strict=True)
    at = np.arange(len(fp))
    rows, roles, found = [], [], []

    def put(role: int, key: np.ndarray, valid: np.ndarray) -> None:
        rows.append(np.broadcast_to(at.reshape(-1, *[1] * (key.ndim - 1)), key.shape)[valid])
        found.append(key[valid])
        roles.append(np.full(len(found[-1]), role, dtype=np.int8))

    put(0, (ball[0] << 24) | (near[1] << 12)[:, None] | near[2][:, None], ball[0] >= 0)
    both = (ball[1] >= 0)[:, :, None] & (ball[2] >= 0)[:, None, :]
    put(1, (near[0] << 24)[:, None, None] | (ball[1] << 12)[:, :, None] | ball[2][:, None, :], both)
    for kind, (x, y) in enumerate(((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)), 1):
        put(0, (np.int64(kind) << 40) | (word[x] << 12) | near[y], np.ones(len(fp), dtype=bool))
        put(1, (np.int64(kind) << 40) | (word[x] << 12)[:, None] | ball[y], ball[y] >= 0)
    return np.concatenate(rows), np.concatenate(roles), np.concatenate(found)


#: A bucket up to SMALL rows is compared lag by lag, vectorised over a whole batch; a larger one is cut further
#: by 16-bit blocks, of which fingerprints at most 3 bits apart share one, down to LARGE rows, then compared in blocks.
SMALL, LARGE = 48, 2048


def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= DISTANCE


def spanning_links(fp: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the distinct fingerprints of a bucket as all its links would: fewer than its rows."""
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []

    def join(group: np.ndarray) -> None:
        for i in range(0, len(group), 256):
            block = group[i : i + 256]
            for a, b in zip(*np.nonzero(close(block[:, None], group[None, i:])), strict=True):
                x, y = root(int(block[a])), root(int(group[i + b]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((int(block[a]), int(group[i + b])))

    if len(fp) <= LARGE:
        join(fp)
    else:
        for shift in range(0, 64, 16):
            block = (fp >> np.uint64(shift)) & np.uint64(0xFFFF)
            order = np.argsort(block, kind="stable")
            for group in np.split(fp[order], np.flatnonzero(np.diff(block[order])) + 1):
                if len(group) > 1:
                    join(group)
    return out


def bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (key, role, fp) sorted by key: verified links (a < b), as many as a bucket's rows times SMALL at most."""
    held = [np.empty(0, dtype=np.int64)] * 3

    def linked(key: np.ndarray, role: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        fp = fp.view(np.uint64)
        begins = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        sizes = np.diff(begins)
        size = np.repeat(sizes, sizes)
        left, right = [], []
        for lag in range(1, min(SMALL, int(sizes.max(initial=1)))):
            at = np.flatnonzero((size[:-lag] <= SMALL) & (key[:-lag] == key[lag:]) & (role[:-lag] != role[lag:]))
            at = at[(fp[at] != fp[at + lag]) & close(fp[at], fp[at + lag])]
            left.append(fp[at])
            right.append(fp[at + lag])
        for i in np.flatnonzero(sizes > SMALL):
            pairs = np.array(spanning_links(np.unique(fp[begins[i] : begins[i + 1]])), dtype=np.uint64).reshape(-1, 2)
            left.append(pairs[:, 0])
            right.append(pairs[:, 1])
        a, b = (np.concatenate([np.empty(0, dtype=np.uint64), *x]).view(np.int64) for x in (left, right))
        pairs = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "role", "fp")]
        key, role, fp = (np.concatenate([x, y]) for x, y in zip(held, new, strict=True))
        if len(key):
            cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
            if cut:
                yield linked(key[:cut], role[:cut], fp[:cut])
            held = [key[cut:], role[cut:], fp[cut:]]
    if len(held[0]):
        yield linked(*held)


def links(prints: DataFrame) -> DataFrame:
    """Links (a < b) that connect the distinct fingerprints of prints (fp) as all pairs at most DISTANCE bits apart do."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().astype(np.int64).view(np.uint64)
            for i in range(0, len(fp), 4096):
                row, role, key = keys(fp[i : i + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(role.astype(np.int8)), pa.array(fp[i : i + 4096][row].view(np.int64))], ["key", "role", "fp"])

    rows = prints.select("fp").mapInArrow(keyed, "key long, role byte, fp long")
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(bucket_links, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for all nodes of edges (a, b), by alternating star operations."""
    pairs = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "links")
    mark = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")), "least")  # large star: larger neighbours to the smallest
        pairs = lookup(both.filter("v > u"), least, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        pairs = written(pairs, "stars")
        least = written(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")  # small star: smaller neighbours and itself to the smallest
        moved = lookup(pairs, least, "u", "n")
        pairs = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(moved.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        pairs = written(pairs, "stars")
        now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


def grouped(rows: DataFrame) -> DataFrame:
    """fp, n, component_id for each fingerprint of rows (doc_id, fp), one row a document."""
    each = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    roots = components(links(each))
    rooted = written(each.join(roots, each["fp"] == roots["node"], "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    least = written(rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("kinds")), "least-ids")
    return written(lookup(rooted, least, "root", "kinds").select("fp", "n", "root", "component_id"), "groups")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs."""
    rows = written(fingerprint_table(docs), "fingerprints")
    return lookup(rows, grouped(rows), "fp", "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs, all columns, for each group of near copies: the one with the smallest doc_id, of several of that
    id the one whose text has the least digest (a null id only if there is no other); of repeated rows one."""
    columns = docs.columns
    mine, theirs, wanted = own_names(columns, "print", "kept_print", "kept_id")
    marked = docs.withColumn(mine, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    rows = written(fingerprint_table(marked.select("doc_id", "text", F.col(mine).alias("print")), "print"), "fingerprints")
    group = lookup(rows, grouped(rows), "fp", "n")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")).alias("first")
    kept = written(group.groupBy("root").agg(first).select(F.col("first.doc_id").alias(wanted), F.col("first.print").alias(theirs)), "one-of-each")
    same = (F.col(mine) == F.col(theirs)) & F.col("doc_id").eqNullSafe(F.col(wanted))
    left = marked.hint("merge").join(kept, same, "left_semi").dropDuplicates(["doc_id", mine])
    return left.select(*[F.col(f"`{c}`") for c in columns])
