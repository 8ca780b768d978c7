"""Packing by cutting-stock patterns from column generation.

A document's ids are cut at multiples of the sequence length; what is left is one piece. Lengths are counted in
classes of UNIT tokens. A linear program over patterns (how many pieces of each class fill one sequence) covers
the histogram with as few sequences as it can: its patterns are generated by a knapsack dynamic program at the
program's prices, until none is worth more than its sequence. Patterns are rounded down; the few pieces left
over are patterned greedily. Pieces, ranked in their class, then take the places of the patterns.

The driver holds counts for each length class (and salt), never pieces. A class of any size is ranked in salted
parts. Ids are those that tokenizers gives with add_special_tokens=False, so that the closing token's own string in a
text is its one id (`tokens`, for white space of any length).

Defined results: null text is the empty text, one piece of the closing id; bytes that are no UTF-8 count as U+FFFD;
repeated rows are packed each; ties of length go by doc_id; an empty table gives no rows; other columns are ignored.
Column generation ends at the optimum, or with a warning after IDLE_ROUNDS rounds without a better cover.
"""

from __future__ import annotations

import warnings
import zlib
from array import array
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import slices, texts, written
from veilspark.llm.tokens import byte_bpe, ids_with_special

LENGTH, UNIT, CLOSING = 1024, 8, 0
ROWS_EACH, SALTS = 5_000_000, (16, 4096)
#: Rounds without a better cover after which the linear program is taken to turn in a circle.
IDLE_ROUNDS = 2000


def pieces_of(docs: DataFrame, path: str) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_bpe(path)
        for batch in slices(batches, most=1 << 20):
            rows, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(texts(batch)):
                ids = array("I", ids_with_special(model, text.decode(errors="replace")))
                ids.append(CLOSING)
                raw = memoryview(np.frombuffer(ids, dtype=np.uint32).astype("<u4").tobytes())
                for a in range(0, len(ids), LENGTH):
                    b = min(a + LENGTH, len(ids))
                    rows.append(i)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                    total.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def best_pattern(prices: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The dearest filling of one sequence, by dynamic programming over its room."""
    value, choice = np.zeros(room + 1), np.full(room + 1, -1)
    for r in range(1, room + 1):
        fits = sizes <= r
        worth = np.where(fits, value[np.where(fits, r - sizes, 0)] + prices, 0.0)
        best = int(np.argmax(worth))
        value[r], choice[r] = (worth[best], best) if worth[best] > value[r - 1] else (value[r - 1], -1)
    pattern, r = np.zeros(len(sizes), dtype=np.int64), room
    while r > 0:
        if choice[r] < 0:
            r -= 1
        else:
            pattern[choice[r]] += 1
            r -= sizes[choice[r]]
    return value[room], pattern


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination, without a threaded linear algebra library (one stalled in a driver beside a JVM)."""
    n = len(matrix)
    both = np.concatenate([matrix, np.eye(n)], axis=1)
    for i in range(n):
        pivot = i + int(np.argmax(np.abs(both[i:, i])))
        both[[i, pivot]] = both[[pivot, i]]
        both[i] /= both[i, i]
        factor = both[:, i].copy()
        factor[i] = 0.0
        both -= factor[:, None] * both[i]
    return both[:, n:]


def patterns(demand: dict[int, int], room: int = LENGTH // UNIT) -> list[tuple[dict[int, int], int]]:
    """Patterns (pieces of each size class) and how often each is used; together they hold exactly the demand."""
    sizes = np.array(sorted(k for k, n in demand.items() if n), dtype=np.int64)
    if not len(sizes):
        return []
    wanted = np.array([demand[k] for k in sizes.tolist()], dtype=np.float64)
    basis = np.diag(room // sizes).astype(np.float64)
    inverse = inverted(basis)
    best, idle = np.inf, 0
    for turn in count():
        value, pattern = best_pattern(inverse.sum(axis=0), sizes, room)
        if value <= 1 + 1e-7:
            break
        used, step = (inverse * wanted).sum(axis=1), (inverse * pattern).sum(axis=1)
        best, idle = (used.sum(), 0) if used.sum() < best - 1e-9 * abs(used.sum()) else (best, idle + 1)
        if idle > IDLE_ROUNDS:
            warnings.warn(f"column generation stopped at {best:.1f} sequences; patterns still pay {value - 1:.2g} more than their sequence", stacklevel=2)
            break
        ratio = np.where(step > 1e-9, np.maximum(used, 0) / np.where(step > 1e-9, step, 1), np.inf)
        leaving = int(np.argmin(ratio))
        basis[:, leaving] = pattern
        row = inverse[leaving] / step[leaving]
        inverse -= np.outer(step, row)
        inverse[leaving] = row
        if turn % 256 == 255:
            inverse = inverted(basis)
    times = np.floor(np.maximum((inverted(basis) * wanted).sum(axis=1), 0) + 1e-9).astype(np.int64)
    left, out = wanted.astype(np.int64), []
    for column, n in zip(basis.T.astype(np.int64), times.tolist(), strict=True):
        if (n := min([n, *(left[column > 0] // column[column > 0]).tolist()])) > 0:
            left -= n * column
            out.append((column, n))
    while left.any():  # what rounding left: largest first
        column, r = np.zeros_like(left), room
        for i in range(len(sizes) - 1, -1, -1):
            column[i] = min(left[i], r // sizes[i])
            r -= column[i] * sizes[i]
        n = int((left[column > 0] // column[column > 0]).min())
        left -= n * column
        out.append((column, n))
    return [({int(s): int(c) for s, c in zip(sizes, column, strict=True) if c}, n) for column, n in out]


def last_not_over(sorted_values: Column, x: Column) -> Column:
    """The place of the last value that is not over x, found by halving (the first one is not)."""
    none = F.struct(F.lit(0).alias("low"), F.size(sorted_values).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        over = F.get(sorted_values, middle) > x
        return F.when(s["high"] - s["low"] <= 1, s).otherwise(F.struct(F.when(over, s["low"]).otherwise(middle).alias("low"), F.when(over, middle).otherwise(s["high"]).alias("high")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(16)), none, halve, lambda s: s["low"])


def packed(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece."""
    spark = docs.sparkSession
    pieces = pieces_of(docs, path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    pieces = written(pieces.withColumn("size", F.ceil(F.col("length") / UNIT).cast("int")), "pieces")
    total = pieces.count()
    salts = min(SALTS[1], max(SALTS[0], total // ROWS_EACH))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = pieces.groupBy("size", "salt").count().toPandas().sort_values(["size", "salt"], ignore_index=True)  # 128 * SALTS[1] rows at most
    counts["before"] = counts.groupby("size")["count"].cumsum() - counts["count"]
    demand = {int(k): int(n) for k, n in counts.groupby("size")["count"].sum().items()}
    places: dict[int, list[tuple[int, int, int]]] = {}
    used, first = dict.fromkeys(demand, 0), 0
    for pattern, times in patterns(demand):
        for size, each in pattern.items():
            places.setdefault(size, []).append((used[size], each, first))
            used[size] += each * times
        first += times
    ranks = spark.createDataFrame(counts[["size", "salt", "before"]].astype({"size": "int32", "salt": "int32", "before": "int64"}), "size int, salt int, before long")
    lists = [(size, *map(list, zip(*rows, strict=True))) for size, rows in places.items()]  # one row for each of LENGTH // UNIT sizes
    places_of = spark.createDataFrame(lists, "size int, lows array<long>, eaches array<long>, firsts array<long>")
    order = Window.partitionBy("size", "salt").orderBy("length", "doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("n", F.row_number().over(order) - 1).join(F.broadcast(ranks), ["size", "salt"]).withColumn("rank", F.col("before") + F.col("n"))
    placed = ranked.join(F.broadcast(places_of), "size").withColumn("i", last_not_over(F.col("lows"), F.col("rank")))
    placed = placed.select("*", F.get("lows", "i").alias("low"), F.get("eaches", "i").alias("each"), F.get("firsts", "i").alias("first"))
    at = F.col("rank") - F.col("low")
    placed = placed.withColumn("sequence_id", (F.col("first") + F.floor(at / F.col("each"))).cast("long")).withColumn("turn", at % F.col("each"))
    within = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "turn").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(within), F.lit(0)).cast("long").alias("offset"))
