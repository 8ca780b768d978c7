"""Uniform sharding with exact shard sizes through a hypergeometric communication matrix.

Rows lie in source partitions (by a hash of doc_id); shards are cut into equal cells. How many rows go
from each partition to each cell is drawn at once from the multivariate hypergeometric law of a uniform
permutation. Rows are then permuted in their partition, sent to the cells by those counts, and permuted
again there. Only ids, sizes and checksums are shuffled, never texts.

Defined results: null text has size 1 and checksum 0, like the empty text; equal rows change places
freely; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a source partition and of a cell, about; and the most partitions and cells (the matrix stays under 2**20 counts).
ROWS_EACH, MOST_PARTITIONS = 500_000, 1024


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One exact draw, by inversion around the mode: for any size, unlike numpy's, which ends at 10**9."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    spread = int(14 * math.sqrt(draws * (good / total) * (bad / total)) + 60)
    first, last = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(first, last, dtype=np.float64)
    step = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    weight = np.concatenate([[0.0], np.cumsum(step)])
    cumulative = np.cumsum(np.exp(weight - weight.max()))
    return first + int(min(np.searchsorted(cumulative, rng.random() * cumulative[-1], side="right"), last - first))


def communication_matrix(sources: list[int], targets: list[int], seed: int) -> np.ndarray:
    """Counts from each source to each target with these row and column sums."""
    rng, left = np.random.default_rng(seed), list(targets)
    matrix = np.zeros((len(sources), len(targets)), dtype=np.int64)
    for p, rows in enumerate(sources):
        rest = sum(left)
        for t, room in enumerate(left):
            if not rows:
                break
            matrix[p, t] = n = hypergeometric(rng, room, rest - room, rows)
            rest, rows = rest - room, rows - n
            left[t] -= n
    return matrix


def even(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def literal_array(values: list, kind: str) -> Column:
    """A constant array, folded once by the optimizer."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def last_at_most(sorted_array: Column, length: int, value: Column) -> Column:
    """By bisection: how many entries of the ascending array are <= value."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, length.bit_length())))])
    inside = lambda at: (at <= length) & (F.get(sorted_array, at - 1) <= value)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(inside(at + step), at + step).otherwise(at))


def shuffled_shards(docs: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard (null for this law)."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    total = docs.count()
    parts = min(MOST_PARTITIONS, max(16, -(-total // ROWS_EACH)))
    blocks = max(2, -(-parts // shards))
    partition = lambda: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(parts)).cast("int")
    counted = docs.groupBy(partition().alias("p")).count().collect()  # at most MOST_PARTITIONS rows
    sources = [0] * parts
    for row in counted:
        sources[row["p"]] = row["count"]
    cells = [n for size in even(total, shards) for n in even(size, blocks)]
    matrix = communication_matrix(sources, cells, seed)
    begins = np.cumsum(matrix, axis=1)[:, :-1].tolist()
    offsets = [int(x) for s in range(shards) for x in np.cumsum([0, *cells[s * blocks : (s + 1) * blocks - 1]])]

    base = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), partition().alias("p"))
    order = lambda n: (F.xxhash64("doc_id", "text_crc32", F.lit(seed + n)), "doc_id", "text_crc32", "size")
    ranked = base.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy(*order(1))) - 1)
    limits = F.get(literal_array(begins, "array<array<bigint>>"), F.col("p"))
    placed = ranked.withColumn("cell", last_at_most(limits, len(cells) - 1, F.col("r")))
    place = F.row_number().over(Window.partitionBy("cell").orderBy(*order(2))) - 1
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.floor(F.col("cell") / blocks).cast("int").alias("shard"),
        (F.get(literal_array(offsets, "array<bigint>"), F.col("cell")) + place).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
