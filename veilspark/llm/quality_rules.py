"""Quality rules: counted properties and a hashed n-gram likelihood ratio, in DataFrame functions only.

Words and neighbouring pairs of words are hashed into BUCKETS. One multinomial is counted over all documents
(raw), one over trusted documents (target). A document's verdict is the mean over its n-grams of
log(target / raw), compared with a fixed threshold: no draw is involved.

Defined results: null text is the empty text; a document under 50 words fails the base rules, and so never
depends on the ratio; ties with the threshold are kept; repeated rows count each; without trusted documents
every ratio is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 10_000
THRESHOLD = -0.15
SYMBOLS, SPACES = "#*$%&|<>", "\t\n\x0b\f\r "


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def occurrences(text: Column, characters: str) -> Column:
    """How often any of these one-byte characters occurs."""
    return sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c))) for c in characters), F.lit(0))


def ngrams(w: Column) -> Column:
    """The buckets of all words and of all pairs of neighbours."""
    one = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int"))
    two = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.pmod(F.xxhash64(F.get(w, i - 1), F.get(w, i)), F.lit(BUCKETS)).cast("int"))
    return F.when(F.size(w) > 1, F.concat(one, two)).otherwise(one)


def repeated_words(w: Column) -> Column:
    """Words in windows of three that occur twice or more. Windows are sorted by hash, so equal ones are neighbours."""
    n = F.size(w)
    window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    hashes = F.transform(F.sequence(F.lit(0), n - 3), window)
    placed = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(window(i).alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        same = lambda j, k: F.get(s, j)["h"].eqNullSafe(F.get(s, k)["h"])
        found = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: ((j > 0) & same(j, j - 1)) | same(j, j + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(found, lambda j: F.array(F.get(s, j)["i"], F.get(s, j)["i"] + 1, F.get(s, j)["i"] + 2)))))

    once = F.size(F.array_distinct(hashes)) == n - 2
    return F.when((n < 4) | once, F.lit(0)).otherwise(F.element_at(F.transform(F.array(placed), covered), 1)).cast("long")


def log_ratios(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """log(target / raw) of each bucket, each with one added to its count."""
    ids = trusted.select(F.col("doc_id").alias("__id")).distinct().withColumn("target", F.lit(1)).hint("shuffle_hash")  # all: they grow with the input, so never broadcast; texts are not sorted
    marked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids, F.col("doc_id") == F.col("__id"), "left")
    grams = marked.select("target", words(F.col("text")).alias("w")).select("target", F.explode(ngrams(F.col("w"))).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("target").alias("target"))
    counts = counts.collect()  # BUCKETS rows at most
    raw, target = sum(r["raw"] for r in counts) + BUCKETS, sum(r["target"] for r in counts) + BUCKETS
    out = [0.0] * BUCKETS
    if target > BUCKETS:
        from math import log

        for i in range(BUCKETS):
            out[i] = log(raw / target)
        for r in counts:
            out[r["bucket"]] = log((r["target"] + 1) / target) - log((r["raw"] + 1) / raw)
    return out


def judged(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the mean log ratio (mean_ratio)."""
    ratios = F.from_json(F.lit(json.dumps(log_ratios(docs, trusted))), "array<double>")
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("w", words(text))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w = F.col("w")
    rows = rows.withColumn("g", ngrams(w))
    mean = F.aggregate(F.col("g"), F.lit(0.0), lambda s, b: s + F.get(ratios, b)) / F.greatest(F.size("g"), F.lit(1))
    rows = rows.select(
        "doc_id", F.size(w).cast("long").alias("n_words"),
        (F.char_length(text) - occurrences(text, SPACES)).cast("long").alias("word_chars"),
        occurrences(text, SYMBOLS).cast("long").alias("n_symbols"),
        F.when(F.contains(text, F.lit("\n")), F.element_at(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), 1)).otherwise(0).cast("long").alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"), mean.alias("mean_ratio"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("mean_ratio") >= threshold)).alias("kept"), "mean_ratio")
