"""Readers for corpora, logs and diffs, and the predicates that prune and route files."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.sources.sinks import stored

LANGUAGES = {"js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "tsx", "tf": "hcl", "hcl": "hcl"}
SCOPED = ("json", "md", "yml", "yaml", "env", "txt", "html", "css", "toml")


#: Bytes of files that a Python worker hands on at a time.
READ_AT_ONCE = 4 << 20


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows in four parts a core, by key: for work that outweighs a shuffle and that the size of the rows doesn't show."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def listed(batches: Iterator[pa.RecordBatch], top: str, skipped: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """file, is_folder of what the folders (file, relative to top) hold, but for folders with a skipped name."""
    names, kinds = [], []

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(kinds, pa.bool_())], ["file", "is_folder"])
        names.clear()
        kinds.clear()
        return made

    for batch in batches:
        for folder in batch.column("file").to_pylist():
            with os.scandir(os.path.join(top, folder)) as entries:
                for entry in entries:
                    if entry.name not in skipped:
                        names.append(f"{folder}/{entry.name}" if folder else entry.name)
                        kinds.append(entry.is_dir())
                    if len(names) >= 10_000:
                        yield out()
    yield out()


def read_whole(batches: Iterator[pa.RecordBatch], top: str) -> Iterator[pa.RecordBatch]:
    """file, content of files (file, relative to top)."""
    for batch in batches:
        names, contents, held = [], [], 0
        for name in batch.column("file").to_pylist():
            content = Path(top, name).read_bytes()
            names.append(name)
            contents.append(content)
            held += len(content)
            if held >= READ_AT_ONCE:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["file", "content"])
                names, contents, held = [], [], 0
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["file", "content"])


def shared_files(spark: SparkSession, top: str, skipped: tuple[str, ...]) -> DataFrame:
    """file, content below a folder that driver and executors mount. Tasks list it, a level of folders at a time, and read it; the
    driver learns no name, only whether a level has folders."""
    folders, levels = spark.createDataFrame([("",)], "file string"), []
    while not folders.isEmpty():
        levels.append(stored(folders.mapInArrow(lambda b: listed(b, top, skipped), "file string, is_folder boolean"), "listed"))
        folders = levels[-1].filter("is_folder").select("file").repartition(4 * spark.sparkContext.defaultParallelism)
    found = reduce(DataFrame.unionAll, levels).filter("not is_folder").select("file")
    return found.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(lambda b: read_whole(b, top), "file string, content binary")


def text_files(spark: SparkSession, root: str, skipped: tuple[str, ...] = (".git", "node_modules")) -> DataFrame:
    """file (relative), text, is_binary: all files below root but those with a skipped folder on their way.

    A path of a shared folder is listed by tasks. Any other is left to Spark, whose driver holds the list of files and passes
    over names that begin with a dot or an underscore.
    """
    local = re.sub("^file:(?://)?(?=/)", "", root)
    if local.startswith("/"):
        rows = shared_files(spark, local, skipped)
    else:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        top = root.rstrip("/").split(":", 1)[-1].lstrip("/")
        file = F.regexp_replace(F.col("path"), "^.*?" + top.replace(".", r"\.") + "/", "")
        rows = rows.select(file.alias("file"), F.col("content"))
    rows = rows.filter(~F.arrays_overlap(F.split("file", "/"), F.array(*[F.lit(s) for s in skipped])))
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    return rows.select("file", F.when(valid, text).alias("text"), (~valid).alias("is_binary"))


def json_lines(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def glob_pattern(glob: str) -> str:
    """A shell pattern (*, ?, [seq], [!seq]) as a regular expression; * crosses slashes."""
    out = []
    for piece in re.findall(r"\[!?\]?[^\]]*\]|.", glob, re.DOTALL):
        if len(piece) > 1:
            inner = piece[1:-1].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out.append("[" + ("^" + inner[1:] if inner.startswith("!") else "\\" + inner if inner.startswith("^") else inner) + "]")
        else:
            out.append({"*": "(?s:.*)", "?": "(?s:.)"}.get(piece, re.escape(piece)))
    return "^" + "".join(out) + "$"


def excluded(file: Column, globs: list[str]) -> Column:
    """A glob over the whole path (* crosses /); or, without a slash, over any one part of it."""
    out = F.lit(False)
    for glob in globs:
        out = out | file.rlike(glob_pattern(glob))
        core = glob.strip("*/")
        if core and "/" not in core:
            out = out | F.array_contains(F.split(file, "/"), core) | F.element_at(F.split(file, "/"), -1).rlike(glob_pattern(core))
    return out


def language(file: Column) -> Column:
    extension = F.lower(F.regexp_extract(file, r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.element_at(known, extension), F.when(extension.isin(*SCOPED) | F.element_at(F.split(file, "/"), -1).startswith(".env"), "scoped"), F.lit("opaque"))


def diff_lines(lines: DataFrame, source: str, number: str, line: str) -> DataFrame:
    """Unified diffs, one line a row: file_idx, hunk_idx (of the diff), is_new, is_deleted (of the file), tag, content; headers have no tag."""
    w = Window.partitionBy(source).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    opens, hunk = F.col(line).startswith("diff --git"), F.col(line).startswith("@@")
    rows = lines.withColumn("file_idx", F.sum(F.when(opens, 1).otherwise(0)).over(w)).withColumn("hunk_idx", F.sum(F.when(hunk, 1).otherwise(0)).over(w))
    rows = rows.withColumn("in_hunk", F.last(F.when(opens, False).when(hunk, True), ignorenulls=True).over(w) & ~hunk & ~opens)
    flag = lambda head: F.max(F.col(line).startswith(head) & ~F.coalesce("in_hunk", F.lit(False))).over(Window.partitionBy(source, "file_idx"))
    rows = rows.withColumn("is_new", flag("new file mode")).withColumn("is_deleted", flag("deleted file mode"))
    tag = F.when(~F.col("in_hunk") | F.col(line).startswith("\\"), None).when(F.col(line) == "", " ").otherwise(F.substring(line, 1, 1))
    return rows.select(source, number, "file_idx", "hunk_idx", "is_new", "is_deleted", tag.alias("tag"), F.when(tag.isNotNull(), F.substring(F.col(line), F.lit(2), F.char_length(line))).alias("content"))


def single(spark: SparkSession, text: str, file: str = "(stdin)") -> DataFrame:
    """One text, as it came from a pipe or an argument, as a corpus of one file."""
    return spark.createDataFrame([(file, text)], "file string, text string")
