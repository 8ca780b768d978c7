"""Helpers shared by the operators: reading, shared-folder materialisation, byte-bounded batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one step of a Python worker handles at a time.
CHUNK_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; where it is unset, a new one in local mode only."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="veilspark-"))
    return context.getCheckpointDir()


def own_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names with underscores in front, as many as it takes to differ from all columns in any case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while (name := f"_{name}").lower() in taken:
            pass
        out.append(name)
    return out


#: Folders written inside each open `scratch` block.
_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What `written` makes inside this block goes when it ends, but for tables to be kept."""
    _scopes.append([])
    try:
        yield
    finally:
        for folder in _scopes.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes and not keep:
        _scopes[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Each batch cut by rows so that a slice holds about `most` bytes of `column` (one longer row is a slice of its own)."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        begin, held = 0, 0
        for i, n in enumerate(sizes):
            if i > begin and held + n > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        if begin < len(sizes):
            yield batch.slice(begin)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


#: A group with over this share of the rows (and this many) is hot; there are at most 1 / HOT_SHARE such groups.
HOT_SHARE, HOT_ROWS = 1 / 1000, 1000


def lookup(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """rows with the columns of groups (one row for each key; size: the rows of the key), inner.

    The few hot groups are broadcast, at most 1 / HOT_SHARE by their definition, so that their rows stay where
    they are; all other rows meet their group in a sort-merge join.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.filter(F.col(size) > max(HOT_ROWS, total * HOT_SHARE))
    at_hot = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.hint("merge"), key)
    return at_hot.unionByName(others)
