"""The mapping store as a log of snapshots: a reader holds one version, a writer names the version its own follows.

Each snapshot is a folder of Parquet files; a version is a small file, named by its number, that says which folder. It comes
into being whole, and only where no version of that number is: so of two writers that saw the same version one fails, and takes
up the other's work before it tries again. That holds on shared POSIX folders and on file systems whose rename is atomic.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators import stores


class Conflict(Exception):
    """Another writer took the next version."""


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration())


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file(version: int) -> str:
    return f"{version:012d}.version"


def current(spark: SparkSession, store: str) -> int:
    """The newest version; 0 where there is none."""
    fs, log = _file_system(spark, store), _path(spark, f"{store}/versions")
    names = [s.getPath().getName() for s in fs.listStatus(log)] if fs.exists(log) else []
    return max([int(n.split(".")[0]) for n in names if n.endswith(".version")], default=0)


def read(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """A version's snapshot (by default the newest). What is written later changes nothing of it."""
    version = current(spark, store) if version is None else version
    name = spark.read.text(f"{store}/versions/{_file(version)}").first()[0]
    return spark.read.parquet(f"{store}/data/{name}")


def commit(snapshot: DataFrame, store: str, after: int) -> int:
    """The snapshot as the version that follows `after`; Conflict, and no trace in the log, where there is one already."""
    spark = snapshot.sparkSession
    if current(spark, store) != after:
        raise Conflict(f"version {after + 1} is there already")
    name = uuid.uuid4().hex
    snapshot.write.parquet(f"{store}/data/{name}")
    fs, log = _file_system(spark, store), f"{store}/versions"
    fs.mkdirs(_path(spark, log))
    part = f"{log}/{name}.part"
    out = fs.create(_path(spark, part), True)
    out.write(bytearray(name, "ascii"))
    out.close()
    try:
        if fs.getScheme() == "file":  # a rename would replace what is there, a link does not
            local = lambda p: fs.makeQualified(_path(spark, p)).toUri().getPath()
            os.link(local(part), local(f"{log}/{_file(after + 1)}"))
        elif fs.exists(_path(spark, f"{log}/{_file(after + 1)}")) or not fs.rename(_path(spark, part), _path(spark, f"{log}/{_file(after + 1)}")):
            raise FileExistsError
    except FileExistsError:
        fs.delete(_path(spark, f"{store}/data/{name}"), True)
        raise Conflict(f"version {after + 1} was taken while this one was written") from None
    finally:
        fs.delete(_path(spark, part), False)
    return after + 1


def changed(spark: SparkSession, store: str, change: Callable[[DataFrame | None], DataFrame], attempts: int = 5) -> int:
    """The version that change makes of the newest snapshot (None at first); made anew of the other writer's where one comes first."""
    for left in range(attempts - 1, -1, -1):
        seen = current(spark, store)
        try:
            return commit(change(read(spark, store, seen) if seen else None), store, seen)
        except Conflict:
            if not left:
                raise
    raise ValueError("at least one attempt is needed")


def allocated(store: str, new: DataFrame, key: str, prefix: str, *order: str) -> int:
    """new (key, prefix) with aliases that no version has, kept with all that is there; keys that have one keep it."""

    def change(held: DataFrame | None) -> DataFrame:
        rows = new.select(key, prefix, *[c for c in order if c not in (key, prefix)])
        if held is None:
            return stores.allocated(rows, prefix, *order).select(key, "alias")
        fresh = rows.join(held.select(key), key, "left_anti")
        return held.select(key, "alias").unionByName(stores.allocated(fresh, prefix, *order, taken=held.select("alias")).select(key, "alias"))

    return changed(new.sparkSession, store, change)


def upserted(store: str, new: DataFrame, key: str, value: str, frozen: str) -> int:
    """new (key, value) over the newest snapshot (key, value, frozen); the job fails, and no version is made, where a frozen value would change."""

    def change(held: DataFrame | None) -> DataFrame:
        if held is None:
            return new.select(key, value, F.lit(False).alias(frozen))
        kept = held.select(key, frozen)
        rows = stores.upsert(held, new, key, value, frozen).drop("outcome")
        return rows.join(kept, key, "left").withColumn(frozen, F.coalesce(frozen, F.lit(False)))

    return changed(new.sparkSession, store, change)
