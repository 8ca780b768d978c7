"""One compile run over a corpus: detect, mint, decide, gate, rewrite, verify, publish.

The rewritten files and their hits are written once, to a staging table beside nothing that is public; counters are observed in
that same pass. The gates then read the staging table, and only a run that passes them all takes the place of the tree that was
published before. A run that is blocked or fails leaves that tree as it was.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.automaton import Needles, Shared
from veilspark.operators import compile as compiling
from veilspark.operators import config, detect, discover, gates, rules, source
from veilspark.sources import files as corpus
from veilspark.sources import sinks, tree


class Blocked(Exception):
    """A gate that stopped a run, and what it found."""

    def __init__(self, gate: str, found: str):
        super().__init__(f"{gate}: {found}")
        self.gate = gate


@dataclass
class Run:
    """files: file, new_file, new_text; hits: entity_id, n; kept: specifier, n; audit: events without a real value; entities: as they were used."""

    operation_id: str
    counters: dict[str, int]
    files: DataFrame
    hits: DataFrame
    kept: DataFrame
    audit: DataFrame
    entities: DataFrame
    discovered: DataFrame | None = field(default=None)


class NamesAtEdges:
    """Needles that stand between word edges."""

    def __init__(self, spellings: list[str]):
        self.spellings, self.needles = spellings, Needles(spellings)

    def found(self, line: str) -> list[str]:
        word = lambda i: 0 <= i < len(line) and (line[i] == "_" or line[i].isascii() and line[i].isalnum())
        hits = self.needles.automaton.iter(line) if self.needles.any else ()
        return sorted({self.spellings[i] for last, i in hits if not word(last + 1) and not word(last - self.needles.lengths[i])})


def names_left(line: Column, spellings: list[str]) -> Column:
    """The spellings that stand in a text between word edges: one pass, however many there are."""
    shared = Shared(spellings, NamesAtEdges)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        found = shared.get().found
        return texts.map(lambda t: [] if t is None else found(t))

    return run(line)


def proposals(found: DataFrame) -> DataFrame:
    """Candidates of occurrences in the columns that minting and decisions ask for: surface, kind, level, action, spellings."""
    best = discover.candidates(found)
    also = discover.aliases(found, best).groupBy("grp").agg(F.sort_array(F.collect_set("surface")).alias("spellings"))
    rows = best.join(also, "grp", "left").withColumn("spellings", F.coalesce(F.slice("spellings", 1, compiling.MOST_MATCHES), F.array().cast("array<string>")))
    return rows.withColumn("surface", F.col("representative")).withColumn("kind", F.lit("vendor")).withColumn("level", F.lit("confidential"))


def leaks(staged: DataFrame, entities: DataFrame) -> DataFrame:
    """V1: new_file and digest of each spelling that a rewritten file still holds between word edges."""
    owner = {r["spelling"]: r["entity_id"] for r in config.spellings(entities).collect()}  # configuration, bounded by rules.taken
    left = staged.select("new_file", F.explode(names_left(F.col("new_text"), sorted(owner))).alias("spelling")).select("new_file", F.sha2("spelling", 256).alias("real_sha256"))
    return left.distinct()


def stores_shown(staged: DataFrame) -> DataFrame:
    """V2: rewritten files that are a mapping store or a part of one."""
    return staged.filter(gates.mapping_shaped(F.col("new_text"))).select("new_file")


def moved(spark: SparkSession, old: str, new: str) -> None:
    """A folder takes another's place: what was there goes aside first and is deleted last."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    there, here = hadoop(new), hadoop(old)
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    aside = hadoop(f"{new.rstrip('/')}-{uuid.uuid4().hex}")
    fs.mkdirs(there.getParent())
    if fs.exists(there) and not fs.rename(there, aside):
        raise OSError(f"{new} could not be put aside")
    if not fs.rename(here, there):
        fs.rename(aside, there)
        raise OSError(f"{new} could not be published")
    fs.delete(aside, True)


def compile_run(
    files: DataFrame, entities: DataFrame, out: str, decisions: DataFrame | None = None, detected: bool = False, exclusions: tuple[str, ...] = (), private: str | None = None,
    as_files: bool = False, binaries: DataFrame | None = None,
) -> Run:
    """files (file, text) rewritten by entities into a tree at `out` (new_file, new_text as Parquet). Raises Blocked, and then publishes nothing.

    detected: proposals that are sure become entities first. decisions: the newest ones, which add and clear entities.
    as_files: the tree is one of real files, in a folder that executors share; binaries (file, content) come in under rewritten paths.
    private: a folder that must not lie in the tree. Files that exclusions (globs) name stay out of the tree and of the counters.
    """
    if binaries is not None and not as_files:
        raise ValueError("binaries are published with as_files only")
    spark = files.sparkSession
    op = sinks.operation_id()
    if private:
        sinks.outside(private, out)
    files = files.filter(~corpus.excluded(F.col("file"), list(exclusions))) if exclusions else files
    language = corpus.language(F.col("file"))
    found = None
    if detected:
        found = sinks.stored(proposals(sinks.stored(detect.occurrences(files, entities, language), "found")), "proposals")
        entities = entities.unionByName(compiling.minted(found, entities), allowMissingColumns=True)
    if decisions is not None:
        entities = compiling.with_decided(entities, decisions)
    entities = sinks.stored(entities.withColumn("ord", F.coalesce("ord", F.lit(1 << 30))), "entities")
    passed, why = compiling.checked(lambda rows: config.pending(rows).select("id"), entities)
    if not passed:
        raise Blocked("V10 restricted", why)

    seen = Observation("compile")
    found_rules = rules.taken(rules.rules(entities))
    done = rules.compiled(files, found_rules, source.file_nodes(F.col("file"), language, F.col("text")))
    rewritten = F.size(F.filter("hits", lambda h: ~h["kept"]))
    done = done.observe(
        seen, F.count(F.lit(1)).alias("n_scanned"), F.count_if(F.col("new_text") != F.col("text")).alias("n_changed"),
        F.count_if(F.col("new_file") != F.col("file")).alias("n_renamed"), F.coalesce(F.sum(rewritten), F.lit(0)).cast("long").alias("n_hits"),
    )
    staged = sinks.stored(done.select("file", "new_file", "new_text", "hits"), "staged")
    counters = {k: int(v) for k, v in seen.get.items()}
    hits, kept = rules.hits_by_entity(staged), rules.kept_by_specifier(staged)
    audit = sinks.audit_events(hits.join(entities.select(F.col("id").alias("entity_id"), "real", "level"), "entity_id"), "real", "compile.rewritten", op)
    for gate, check, *args in (("V1 leak", leaks, staged, entities), ("V2 mapping store", stores_shown, staged), ("V12 audit", sinks.with_real_values, audit, entities.select("real"))):
        passed, why = compiling.checked(check, *args)
        if not passed:
            raise Blocked(gate, why)
    if as_files:
        if binaries is not None:
            binaries = binaries.filter(~corpus.excluded(F.col("file"), list(exclusions))) if exclusions else binaries
            binaries = binaries.select(rules.renamed(F.col("file"), found_rules).alias("file"), "content")
        tree.published(staged, out, binaries, private)
    else:
        folder = f"{sinks.shared_folder(spark)}/tree-{op}"
        staged.select("new_file", "new_text").write.parquet(folder)
        if private:
            sinks.outside(private, out)
        moved(spark, folder, out)
    return Run(op, counters, staged.select("file", "new_file", "new_text"), hits, kept, audit, entities, found)
