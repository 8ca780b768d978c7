"""Quality by compression: zstandard dictionaries of good texts against those of bad texts.

A text is compressed whole with the dictionaries of both classes, in a few sizes. The normalised differences
(bad - good) / (bad + good) of the compressed sizes, one for each size of dictionary, and nothing else, go through a
logistic curve (with their squares and products) fitted on labelled rows that built no dictionary.

Defined results: null text scores as the empty text; with under four labelled texts of one class every score is the
share of good labels (0.5 without labels); conflicting or null labels of a document are each used, null ones
dropped; repeated rows score alike; very long texts are scored whole, but those over SAMPLE_BYTES teach nothing; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import slices, texts

#: The bounded sample of labelled rows: texts and bytes a class. The dictionaries' sizes, chosen by four folds of rows that teach.
SAMPLE_TEXTS, SAMPLE_BYTES, LEVEL = 3000, 8 << 20, 3
DICTIONARIES = (16_000, 32_000, 64_000)


def held_out(modulus: int, remainder: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str) -> dict[int, list[bytes]]:
    """Whole texts for each class, spread by a hash of doc_id: SAMPLE_TEXTS and about SAMPLE_BYTES at most. One pass over docs."""
    marks = labels.filter(~F.coalesce(held_out(5, 0), F.lit(True))).select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("y"))
    order = (F.xxhash64("__id"), "__id")
    chosen = [marks.filter(F.col("y") == y).distinct().orderBy(*order).limit(SAMPLE_TEXTS) for y in (0, 1)]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen[0].unionByName(chosen[1])), F.col("doc_id") == F.col("__id"))
    size = F.octet_length("text")
    before = F.sum(size).over(Window.partitionBy("y").orderBy(*order, F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.filter(size <= SAMPLE_BYTES).withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < SAMPLE_BYTES)
    out: dict[int, list] = {0: [], 1: []}
    for row in rows.select("y", "before", "text").collect():  # under 2 * 2 * SAMPLE_BYTES
        out[row["y"]].append((row["before"], row["text"].encode()))
    return {y: [t for _, t in sorted(found)] for y, found in out.items()}


class Compressors:
    def __init__(self, pairs: list[tuple[bytes, bytes]]):
        self.pairs = [[self.with_dictionary(raw) for raw in pair] for pair in pairs]

    @staticmethod
    def with_dictionary(raw: bytes) -> zstandard.ZstdCompressor:
        data = zstandard.ZstdCompressionDict(raw)
        data.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False)

    def differences(self, text: bytes) -> list[float]:
        sizes = [[len(c.compress(text)) for c in pair] for pair in self.pairs]
        return [(bad - good) / (bad + good) for bad, good in sizes]


def first_bytes(samples: list[bytes], most: int) -> list[bytes]:
    """Whole samples of about `most` bytes together."""
    out, held = [], 0
    for x in samples:
        if x and held < most:
            out.append(x)
            held += len(x)
    return out


def build_dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the texts themselves where there are too few to train one."""
    try:
        return zstandard.train_dictionary(size, samples, threads=1).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-size:] or b"\n"


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method; both classes weigh as they occur."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip((x * w).sum(axis=1), -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        hessian = np.einsum("ni,nj->ij", x * s[:, None], x) + ridge * np.eye(len(w)) * len(x) / 100
        w = w + np.linalg.solve(hessian, (x * (y - p)[:, None]).sum(axis=0) - ridge * len(x) / 100 * w)
    return w


def expanded(f: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """One, the scaled differences, and their products with each other and themselves."""
    z = np.clip((f - mean) / scale, -6, 6)
    some = range(z.shape[1])
    return np.column_stack([np.ones(len(z)), z, *(z[:, i] * z[:, j] for i in some for j in some if i <= j)])


def fit(samples: dict[int, list[bytes]]) -> dict:
    """Every other text builds dictionaries, of as many bytes for either class; the rest fits the curve."""
    good, bad = samples[1], samples[0]
    if len(good) < 4 or len(bad) < 4:
        return {"constant": len(good) / (len(good) + len(bad)) if good or bad else 0.5}
    least = max(1, min(sum(map(len, x[::2])) for x in (bad, good)))
    taught = [first_bytes(x[::2], least) for x in (bad, good)]
    pairs = [tuple(build_dictionary(x, size) for x in taught) for size in DICTIONARIES]
    tool = Compressors(pairs)
    f = np.array([tool.differences(t) for x in (bad, good) for t in x[1::2]])
    y = np.array([0.0] * len(bad[1::2]) + [1.0] * len(good[1::2]))
    mean, scale = f.mean(axis=0), f.std(axis=0) + 1e-9
    return {"pairs": pairs, "mean": mean, "scale": scale, "weights": logistic(expanded(f, mean, scale), y)}


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted: 1 if score >= threshold."""
    model = fit(labelled_sample(docs, labels, label))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        tool = Compressors(m["pairs"]) if "weights" in m else None
        for batch in slices(batches):
            if tool:
                f = np.array([tool.differences(t) for t in texts(batch)])
                out = 1 / (1 + np.exp(-np.clip((expanded(f, m["mean"], m["scale"]) * m["weights"]).sum(axis=1), -30, 30)))
            else:
                out = np.full(batch.num_rows, m["constant"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(out)], ["doc_id", "held_out", "score"])

    scored = docs.select("doc_id", "text", held_out(5, 0).alias("held_out")).mapInArrow(score, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
