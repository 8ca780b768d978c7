"""Exact deduplication against a persistent digest index, bucketed and sorted by digest.

The index is a table (digest, first_id, batch). A batch is reduced to one row for each digest before it meets the
index; digests that a sort-merge anti-join does not find are appended under the batch's name. What a batch itself
brought counts as new to it, so that a job which failed after the append can be run again under the same name
and gives the same rows.

Defined results: null text equals the empty text; texts are equal when identical after every run of
`[\\x20\\x09-\\x0D]` is one space; among equal texts the smallest doc_id stays (a null id only if there
is no other), of repeated rows with that id one row; an empty batch appends nothing. Columns besides
doc_id and text, whatever their names, are carried by `distinct_documents` and ignored elsewhere. Ids may be any of
their type. An index keeps the number of buckets it was made with, under any session's settings, until `compact` changes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import lookup, own_names, written


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


class DigestIndex:
    """A bucketed table of the digests seen so far. Later batches never replace an earlier first_id."""

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None):
        self.spark, self.table, self.next = spark, table, f"{table}_compacted"
        if not spark.catalog.tableExists(table) and spark.catalog.tableExists(self.next):  # a compaction ended between its last two steps
            spark.sql(f"ALTER TABLE {self.next} RENAME TO {table}")
        if not spark.catalog.tableExists(table):
            buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            self._create(table, buckets)
        told = spark.sql(f"DESCRIBE EXTENDED {table}").filter("col_name = 'Num Buckets'").first()
        self.buckets = int(told["data_type"])  # as it was made, whatever this session's settings

    def _create(self, table: str, buckets: int) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} (digest BINARY, first_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS"
        )

    def compact(self, buckets: int | None = None) -> None:
        """One sorted file a bucket again, as each append adds one; with a number given, so many buckets.

        The new table is whole before the old one goes, and takes its name last; opening the index ends what was cut off.
        """
        buckets = buckets or self.buckets
        self.spark.sql(f"DROP TABLE IF EXISTS {self.next}")
        self._create(self.next, buckets)
        self._append(self.read(), self.next, buckets)
        self.drop()
        self.spark.sql(f"ALTER TABLE {self.next} RENAME TO {self.table}")
        self.buckets = buckets

    @staticmethod
    def _append(rows: DataFrame, table: str, buckets: int) -> None:
        (
            rows.repartition(buckets, "digest").sortWithinPartitions("digest")
            .write.bucketBy(buckets, "digest").sortBy("digest").mode("append").format("parquet").saveAsTable(table)
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def add(self, firsts: DataFrame, batch: str) -> None:
        """Append those of firsts (digest, first_id) that the index does not hold."""
        fresh = firsts.select("digest", "first_id", F.lit(batch).alias("batch")).hint("merge").join(self.read(), "digest", "left_anti")
        fresh = written(fresh, "fresh-digests")  # a table can't be read and appended to in one job
        self._append(fresh, self.table, self.buckets)

    def merged(self, firsts: DataFrame, batch: str) -> DataFrame:
        """Adds firsts (digest, first_id, first_count), one row a digest; returns digest, group_size, keep_id, new_here.

        keep_id is the id which the index holds, new_here whether this batch brought it.
        """
        self.add(firsts, batch)
        held = self.read().select("digest", F.col("first_id").alias("keep_id"), (F.col("batch") == batch).alias("new_here"))
        return written(firsts.select("digest", F.col("first_count").alias("group_size")).hint("merge").join(held, "digest"), "digest-groups")

    def decide(self, docs: DataFrame, batch: str) -> DataFrame:
        """Adds a batch; returns a row for each of its rows: doc_id, digest, keep_id, group_size, kept.

        group_size counts the equal rows of this batch.
        """
        rows, firsts = digested(docs)
        return decided(rows, self.merged(firsts, batch))


def digested(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of docs as (digest, doc_id, times), and digest, first_id, first_count of each digest."""
    rows = docs.select("doc_id", digest(F.col("text")).alias("digest")).groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("times"))
    rows = written(rows, "digests")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.sum("times").alias("first_count"))
    return rows, written(firsts, "first-digests")  # else the optimizer moves joins below the aggregate, where copies meet in one task


def decided(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept for each row of rows (digest, doc_id, times), groups as from `merged`."""
    each = lookup(rows, groups, "digest", "group_size").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return each.select(
        "doc_id", "digest", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1) & F.col("new_here")).alias("kept")
    )


def decided_in_batches(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """As decide, for a table that comes in two batches, smaller ids first; group_size counts the equal rows of both."""
    middle = docs.agg(F.expr("min(doc_id) div 2 + max(doc_id) div 2")).first()[0]  # halves first: ids may lie at either end of their type
    early = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False))
    rows, groups = [], []
    for name, some in (("early", docs.filter(early)), ("late", docs.filter(~early))):
        part, firsts = digested(some)
        rows.append(part)
        groups.append(index.merged(firsts, name))
    together = groups[0].unionByName(groups[1]).groupBy("digest").agg(F.sum("group_size").alias("group_size"), F.min("keep_id").alias("keep_id"))
    together = written(together.withColumn("new_here", F.lit(True)), "groups-of-both")
    return decided(rows[0].unionByName(rows[1]), together)


def distinct_documents(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """The rows of docs, all columns, that are the first of their text in the batch and new to the index."""
    columns = docs.columns
    mine, theirs, first = own_names(columns, "digest", "kept_digest", "first_id")
    rows = docs.withColumn(mine, digest(F.col("text")))
    firsts = rows.groupBy(F.col(mine).alias("digest")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("first_count"))
    groups = index.merged(written(firsts, "first-rows"), batch)
    fresh = written(groups.filter("new_here").select(F.col("digest").alias(theirs), F.col("keep_id").alias(first)), "fresh-rows")
    same = (F.col(mine) == F.col(theirs)) & F.col("doc_id").eqNullSafe(F.col(first))
    kept = rows.hint("merge").join(fresh, same, "left_semi").dropDuplicates(["doc_id", mine])  # a repeated row stays once
    return kept.select(*[F.col(f"`{c}`") for c in columns])
