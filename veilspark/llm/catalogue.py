"""The queries of this subpackage: each applies one operator to the whole of its table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import alignment, class_lm, decontamination, exact_dedup, importance, language_id, packing, quality_classifier, quality_rules, sharding, simhash, sp_sampling, suffix_dedup
from veilspark.llm.common import documents


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffled_shards(documents(spark, sf_dir), shards=8)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_sampling.sampled_segmentations(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    return quality_rules.judged(documents(spark, sf_dir), trusted)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = quality_classifier.held_out(3, 1)
    model = language_id.train(docs.filter(~held_out))
    return language_id.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score")
    )


def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = quality_classifier.held_out(7, 2)
    docs = documents(spark, sf_dir).select("doc_id", "text", held_out.alias("held_out"))
    return class_lm.fitted_scores(docs)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    rows = exact_dedup.decided_in_batches(documents(spark, sf_dir), index)
    index.drop()  # the rows stand on tables of their own
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(documents(spark, sf_dir))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontamination.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"])
    ids = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sharding, op2_quality_classifier, op3_sentencepiece_sampling, op4_packing, op5_quality_rules,
        op6_simhash, op7_suffix_dedup, op8_language_id, op9_class_lm, op10_exact_dedup,
        op11_alignment, op12_decontamination, op13_importance,
    )
}

#: Words of op12 and op13: letters A-Z are lowered, words are what is left between ASCII characters that are neither letters nor digits.
_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL = {
    "op10_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op12_decontamination": rf"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_WORDS} AS w FROM documents),
        b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_SQL_WORDS} AS w FROM benchmark),
        cut AS (SELECT item, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
        asked AS (SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM cut),
        sizes AS (SELECT DISTINCT k FROM asked),
        placed AS (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d JOIN sizes ON len(w) >= k),
        hits AS (SELECT rid, i, p.k, item FROM (SELECT rid, i, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM placed) p JOIN asked USING (k, s)),
        words AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS j FROM hits) GROUP BY rid),
        items AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
    """,
    "op13_importance": rf"""
        WITH RECURSIVE steps(i, k, c) AS (
            SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
            UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END FROM steps WHERE k < 8
        ),
        tab AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
        d AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_WORDS} AS w FROM documents),
        raw AS (SELECT word, rid, count(*) AS n FROM (SELECT rid, unnest(w) AS word FROM d) GROUP BY ALL),
        target AS (SELECT word, count(*) AS n FROM (SELECT unnest({_SQL_WORDS}) AS word FROM benchmark) GROUP BY word),
        known AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM raw UNION SELECT word FROM target)),
        hashed AS (
            SELECT word, xor(CAST(4294967295 AS BIGINT), list_reduce(
                list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, len(h), 2), lambda j: CAST('0x' || substr(h, CAST(j AS BIGINT) + 1, 2) AS BIGINT))),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
            FROM known, tab
        ),
        s AS (SELECT bucket, sum(n) AS s FROM raw JOIN hashed USING (word) GROUP BY bucket),
        t AS (SELECT bucket, sum(n) AS t FROM target JOIN hashed USING (word) GROUP BY bucket),
        sums AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS ss, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS tt),
        gains AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (ss + 10000) / ((s::DOUBLE + 1) * (tt + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), sums),
        weights AS (SELECT rid, CAST(sum(n * gain) AS BIGINT) AS weight FROM raw JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY rid),
        scored AS (
            SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
                coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)::DOUBLE + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
            FROM d LEFT JOIN weights USING (rid)
        ),
        ranked AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (rid)
    """,
}
