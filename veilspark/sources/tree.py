"""A data source that writes a tree of real files: staged by tasks, put in place by the job's commit alone.

    spark.dataSource.register(Tree)
    rows.write.format("file_tree").mode("overwrite").option("private", folder).save(path)

Rows are (file, content binary): a relative path and the file's bytes, null for none. The path must be a folder that driver and
executors share. To read a tree use `files.text_files`, whose tasks list it.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from veilspark.sources.sinks import outside


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote. Names stay with the files."""

    files: int
    size: int


def placed(top: Path, name: str | None) -> Path:
    """Where a relative path lies below top; ValueError for one that leaves it or names nothing."""
    parts = PurePosixPath(name or "").parts
    if not parts or parts[0] == "/" or ".." in parts or "\0" in name:
        raise ValueError(f"no path of a file within a tree: {name!r}")
    return top.joinpath(*parts)


def same(path: Path, content: bytes) -> bool:
    return path.is_file() and path.stat().st_size == len(content) and path.read_bytes() == content


class TreeWriter(DataSourceArrowWriter):
    """Files come whole to their staged places, by a link that fails where one stands already: a task that runs again meets its
    own files, and two rows of one path that differ end the job."""

    def __init__(self, path: str, private: str | None, overwrite: bool):
        self.path, self.private = Path(path), private
        self.guard()
        if not overwrite and self.path.exists():
            raise ValueError(f"{path} is there already")
        self.staging = self.path.parent / f".{self.path.name}-{uuid.uuid4().hex}"
        self.parts = self.path.parent / f"{self.staging.name}-parts"

    def guard(self) -> None:
        if self.private:
            outside(self.private, str(self.path))

    def write(self, iterator: Iterator) -> Written:
        self.staging.mkdir(parents=True, exist_ok=True)
        self.parts.mkdir(exist_ok=True)
        files = size = 0
        part = self.parts / uuid.uuid4().hex
        for batch in iterator:
            for name, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                content = content or b""
                place = placed(self.staging, name)
                place.parent.mkdir(parents=True, exist_ok=True)
                part.write_bytes(content)
                try:
                    os.link(part, place)
                except FileExistsError:
                    if not same(place, content):
                        raise ValueError(f"two files of one path: {name!r}") from None
                part.unlink()
                files, size = files + 1, size + len(content)
        return Written(files, size)

    def commit(self, messages: list[Written | None]) -> None:
        """The staged tree takes the place of the one that was there, which goes aside first and is deleted last."""
        self.guard()
        self.staging.mkdir(parents=True, exist_ok=True)  # of no rows
        aside = self.path.parent / f"{self.staging.name}-old"
        had = self.path.exists()
        if had:
            self.path.rename(aside)
        try:
            self.staging.rename(self.path)
        except OSError:
            if had:
                aside.rename(self.path)
            raise
        for left in (self.parts, aside):
            shutil.rmtree(left, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        for left in (self.staging, self.parts):
            shutil.rmtree(left, ignore_errors=True)


class Tree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return "file string, content binary"

    def writer(self, schema, overwrite: bool) -> TreeWriter:  # noqa: ANN001
        if [f.name for f in schema] != ["file", "content"]:
            raise ValueError("a tree is written of the columns file and content")
        return TreeWriter(re.sub("^file:(?://)?(?=/)", "", self.options["path"]), self.options.get("private"), overwrite)


def published(texts: DataFrame, path: str, binaries: DataFrame | None = None, private: str | None = None) -> None:
    """texts (new_file, new_text) and binaries (file, content), as they are, as the tree at path, in place of what was there.

    A failed job leaves the old tree whole. A null text is an empty file.
    """
    spark: SparkSession = texts.sparkSession
    spark.dataSource.register(Tree)
    rows = texts.select(F.col("new_file").alias("file"), F.encode("new_text", "UTF-8").alias("content"))
    rows = rows if binaries is None else rows.unionByName(binaries.select("file", "content"))
    writer = rows.write.format("file_tree").mode("overwrite")
    (writer.option("private", private) if private else writer).save(path)
