"""Importance resampling towards a target distribution, on hashed word n-grams through an integer word dictionary.

Distinct words of documents and target get integer ids; runs of one to N words are tuples of ids. Each distinct tuple is
counted on both sides and written out in bytes once, to be hashed into its bucket; bucket counts give each bucket's gain
(log ratio of target and raw), and a tuple's gain is joined back to its occurrences. A document's weight is the sum of
its features' gains; weight plus a Gumbel draw from its id is its score, and the highest scores are the sample: a draw
without replacement in proportion to exp(weight / 1000).

For runs of one word, a word's id is its tuple and its gain stands beside it in the dictionary, so that one join serves
both. Words or tuples with over 1 / HEAD_SHARE of all occurrences are broadcast, HEAD_SHARE at most by that bound and
short ones only; the others meet their row in a merge join, where no key is hot. Scores are ranked by range partitions:
no task holds them all.

Defined results: null text has no words, its weight is 0; a null doc_id is drawn as the empty string; repeated rows are
drawn alike, each is ranked; documents under 20 words are scored but never drawn; other columns are ignored; an empty
table gives no rows, an empty target gives gains by the documents alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import written

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 2024, 20, 10
#: What separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: At most so many keys are broadcast, each of at most so many bytes.
HEAD_SHARE, HEAD_BYTES = 100_000, 64


def words(text: Column) -> Column:
    """Words of the text with A-Z lowered; letters of other scripts stay as they are."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def met(rows: DataFrame, table: DataFrame, key: str, count: str, size: Column) -> DataFrame:
    """rows with the columns of table (one row a key; count: occurrences, size: bytes of the key), inner."""
    total = table.agg(F.sum(count)).first()[0] or 0
    often = (F.col(count) * HEAD_SHARE > total) & (size <= HEAD_BYTES)
    head = rows.join(F.broadcast(table.filter(often).withColumn("often", F.lit(True))), key, "left")
    tail = head.filter("often IS NULL").select(*rows.columns).hint("merge").join(table.filter(~often), key)
    columns = [*rows.columns, *(c for c in table.columns if c != key)]
    return head.filter("often").select(*columns).unionByName(tail.select(*columns))


def dictionary(rows: DataFrame) -> DataFrame:
    """word, id, raw, target (occurrences on both sides) of the distinct words of rows (w, of_target)."""
    each = rows.select(F.explode("w").alias("word"), "of_target").groupBy("word")
    counts = each.agg(F.count_if(~F.col("of_target")).alias("raw"), F.count_if("of_target").alias("target"))
    return written(counts.withColumn("id", F.monotonically_increasing_id()), "words")


def tuples(rows: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """rid, of_target, ids: every run of one to `most` words as the ids of its words."""
    placed = rows.select("rid", "of_target", F.posexplode("w").alias("at", "word"))
    numbered = met(placed, ids.select("word", "id", (F.col("raw") + F.col("target")).alias("n")), "word", "n", F.octet_length("word"))
    ahead = Window.partitionBy("rid").orderBy("at")
    following = numbered.select("rid", "of_target", *(F.lead("id", i).over(ahead).alias(f"i{i}") for i in range(most)))
    runs = F.array(*(F.array(*(f"i{i}" for i in range(n + 1))) for n in range(most)))
    return following.select("rid", "of_target", F.explode(F.filter(runs, lambda r: F.element_at(r, -1).isNotNull())).alias("ids"))


def spelt(distinct: DataFrame, ids: DataFrame) -> DataFrame:
    """distinct (ids, raw, target) with `text`, the words of the tuple joined by a space."""
    each = distinct.select("ids", F.posexplode("ids").alias("at", "id"))
    named = met(each, ids.select("id", "word", F.lit(1).alias("n")), "id", "n", F.lit(8))  # each id is one row: no head
    texts = named.groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("text"))
    return distinct.hint("merge").join(texts, "ids")


def gains(features: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain for the buckets that features (bucket, raw, target) fall into."""
    total = features.agg(F.sum("raw"), F.sum("target")).first()
    ss, tt = (F.lit(float(x or 0)) for x in total)
    counts = features.groupBy("bucket").agg(F.sum("raw").cast("double").alias("s"), F.sum("target").cast("double").alias("t"))
    ratio = (F.col("t") + 1) * (ss + buckets) / ((F.col("s") + 1) * (tt + buckets))
    return counts.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weights(docs: DataFrame, target: DataFrame, most: int, buckets: int) -> DataFrame:
    """rid, doc_id, n_words, n_features, weight of each row of docs."""
    texts = docs.select("doc_id", "text", F.lit(False).alias("of_target")).unionByName(target.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("of_target")))
    rows = texts.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "of_target", F.coalesce(words(F.col("text")), F.array().cast("array<string>")).alias("w"))
    rows = written(rows, "word-lists")
    ids = dictionary(rows)
    if most == 1:
        features = ids.withColumn("bucket", F.pmod(F.crc32("word"), F.lit(buckets)))
        worth = features.join(F.broadcast(gains(features, buckets)), "bucket").select("word", (F.col("raw") + F.col("target")).alias("n"), "gain")
        found = met(rows.filter("NOT of_target").select("rid", F.explode("w").alias("word")), written(worth, "word-gains"), "word", "n", F.octet_length("word"))
    else:
        runs = written(tuples(rows, ids, most), "tuples")
        distinct = written(runs.groupBy("ids").agg(F.count_if(~F.col("of_target")).alias("raw"), F.count_if("of_target").alias("target")), "distinct-tuples")
        features = written(spelt(distinct, ids).select("ids", "raw", "target", F.pmod(F.crc32("text"), F.lit(buckets)).alias("bucket")), "features")
        worth = features.join(F.broadcast(gains(features, buckets)), "bucket").select("ids", (F.col("raw") + F.col("target")).alias("n"), "gain")
        found = met(runs.filter("NOT of_target").select("rid", "ids"), written(worth, "tuple-gains"), "ids", "n", 8 * F.size("ids"))
    n = F.size("w").cast("long")
    n_features = reduce(Column.__add__, (F.greatest(n - i, F.lit(0)) for i in range(most)))
    base = rows.filter("NOT of_target").select("rid", "doc_id", n.alias("n_words"), n_features.alias("n_features"), F.lit(0).cast("long").alias("gain"))
    none = F.lit(None).cast("long")
    parts = base.unionByName(found.select("rid", none.alias("doc_id"), none.alias("n_words"), none.alias("n_features"), F.col("gain").cast("long").alias("gain")))
    return parts.groupBy("rid").agg(*(F.max(c).alias(c) for c in ("doc_id", "n_words", "n_features")), F.sum("gain").alias("weight"))


def scores(weighed: DataFrame, seed: int) -> DataFrame:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    draw = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weighed.withColumn("score", F.col("weight") + draw)


def resampled(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score, rank (1, 2, ... by falling score, ties by doc_id; null for those not drawn) of each row of docs."""
    spark = docs.sparkSession
    order = (F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("rid"))
    scored = written(scores(weights(docs, target, most, buckets), seed), "scores")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = scored.filter(F.col("n_words") >= least_words).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumn("place", F.monotonically_increasing_id()), "ranged")  # partition in the high bits, place in it in the low ones
    partition, place = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    counts = sorted((r["p"], r["count"]) for r in ranged.groupBy(partition.alias("p")).count().collect())  # a row for each partition
    before = [(p, sum(n for _, n in counts[:i])) for i, (p, _) in enumerate(counts)]
    drawn = sum(n for _, n in counts) * percent // 100
    offsets = spark.createDataFrame(before, "p long, before long")
    rank = F.col("before") + place + 1
    placed = ranged.withColumn("p", partition).join(F.broadcast(offsets), "p").withColumn("rank", F.when(rank <= drawn, rank))
    columns = ("doc_id", "n_features", "weight", "score", "rank")
    return placed.select(*columns).unionByName(scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")).select(*columns))
