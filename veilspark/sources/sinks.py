"""Append-only logs and small reports, and the guard that keeps private files out of a public tree."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a new one, in local mode only."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not folder:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="veilspark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, read again."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """One JSON object a row, keys in order, nulls left out."""
    rows.select(*sorted(rows.columns)).write.mode("append").json(path)


def audit_events(rows: DataFrame, real: str, event: str, operation_id: str = "op_000000000000", component: str = "veilspark", actor: str = "spark") -> DataFrame:
    """Rows as audit events of one operation: the real value appears as its SHA-256 only."""
    named = {"operation_id": operation_id, "component": component, "actor": actor, "event": event}
    return rows.withColumns({k: F.lit(v) for k, v in named.items()}).withColumn("real_sha256", F.sha2(F.col(real), 256)).drop(real)


def operation_id() -> str:
    return f"op_{uuid.uuid4().hex[:12]}"


def with_real_values(events: DataFrame, reals: DataFrame) -> DataFrame:
    """The events that hold a value of reals (real) in any string field, as they must not: field and digest of the value."""
    strings = [f.name for f in events.schema.fields if f.dataType.simpleString() == "string"]
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in strings])
    return events.select(F.explode(fields).alias("f")).select("f.*").join(reals.select(F.col("real").alias("value")).distinct(), "value").select("field", F.sha2("value", 256).alias("real_sha256")).distinct()


def rewritten_tree(files: DataFrame, path: str, private: str) -> None:
    """new_file and new_text as a whole new tree; refused, before and after, where the private one lies inside it."""
    outside(private, path)
    files.select("new_file", "new_text").write.mode("overwrite").parquet(path)
    outside(private, path)


def ranked_lines(candidates: DataFrame, path: str) -> None:
    """Candidates, best first, one JSON object a line, in place of what was there."""
    candidates.orderBy(F.desc("score"), F.coalesce("entity_id", F.lit("~")), "representative").write.mode("overwrite").json(path)


def run_metrics(rows: DataFrame) -> DataFrame:
    """Rows with schema and ts; those that the caller gives stay."""
    given = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    return rows.withColumn("schema", F.coalesce(given("schema").cast("int"), F.lit(1))).withColumn("ts", F.coalesce(given("ts").cast("timestamp"), F.current_timestamp()))


def clipped(text: Column, most: int = 600) -> Column:
    """Text of over `most` characters cut there, with how many went."""
    over = F.char_length(text) - most
    return F.when(over > 0, F.concat(F.substring(text, 1, most), F.lit("[+"), over.cast("string"), F.lit(" chars]"))).otherwise(text)


def outside(path: str, tree: str) -> str:
    """path, if it lies outside tree; ValueError if not. Both may be reached over links."""
    if Path(path).resolve().is_relative_to(Path(tree).resolve()):
        raise ValueError(f"{path} lies inside {tree}")
    return path
