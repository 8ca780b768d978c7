"""From occurrences with signals to scored candidates: two grouped aggregates, no group is ever gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import scoring


def candidates(found: DataFrame) -> DataFrame:
    """Candidates of occurrences (grp, entity_id, spelling, level, file, surface, kind, signals), one row an occurrence.

    signals: array of (name, weight, scoped); scoped: a package's own scope. A signal name counts once a group, with its best
    weight; groups without an entity are proposals: they get a weak signal and stay only with support (`supported`). The
    representative is the configured spelling (for a proposal what its anchor shows), the longest name of several words in
    a comment or string, or the longest surface, the least of equals. Columns: grp, entity_id, representative, score,
    action, evidence, n_occurrences, n_files.
    """
    each = found.select("grp", F.explode("signals").alias("s")).select("grp", "s.*")
    by_name = each.groupBy("grp", "name").agg(F.max("weight").alias("weight"), F.bool_or(F.coalesce("scoped", F.lit(False))).alias("scoped"))
    by_name = by_name.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("less"), "name", "weight", "scoped"))).alias("signals"))
    order = F.struct((-F.char_length("surface")).alias("n"), "surface")
    spoken = F.col("kind").isin("comment", "string") & F.contains("surface", F.lit(" ")) & (F.char_length("surface") <= 48)
    open_ = F.col("entity_id").isNull()
    real = F.col("file") != "(graph)"
    groups = found.groupBy("grp").agg(
        F.max("entity_id").alias("entity_id"), F.min(F.when(~open_, F.col("spelling"))).alias("named"), F.min_by(F.when(spoken, F.col("surface")), F.when(spoken, order)).alias("spoken"),
        F.min(F.when(open_, F.col("spelling"))).alias("shown"), F.min_by(F.col("surface"), F.struct((~real).alias("g"), order.alias("o"))).alias("longest"), F.max("level").alias("level"),
        F.count(F.lit(1)).alias("n_occurrences"), F.count_distinct(F.when(real, F.col("file"))).alias("n_files"),
        F.bool_or(F.col("kind").isin("definition", "identifier", "import", "env")).alias("in_code"),
    )
    rows = groups.join(by_name, "grp")
    weak = F.array(F.struct(F.lit(-0.02).alias("less"), F.lit("weak").alias("name"), F.lit(scoring.WEAK).alias("weight"), F.lit(False).alias("scoped")))
    rows = rows.filter(~open_ | supported(F.col("signals"), F.col("n_occurrences"), F.col("n_files"), F.col("in_code")))
    rows = rows.withColumn("signals", F.when(open_, F.concat("signals", weak)).otherwise(F.col("signals")))
    rows = rows.withColumn("score", scoring.noisy_or(F.transform("signals", lambda s: s["weight"])))
    action = scoring.classify(F.col("score"), scoring.has_hard_evidence(F.col("signals")), F.col("level"), ~open_)
    representative = F.coalesce("named", "spoken", "shown", "longest").alias("representative")
    return rows.select("grp", "entity_id", representative, "score", action.alias("action"), scoring.evidence_label(F.col("signals")).alias("evidence"), "n_occurrences", "n_files")


def aliases(found: DataFrame, candidates: DataFrame) -> DataFrame:
    """grp, surface, n: how else the entity or proposal of each candidate is spelled."""
    rows = found.groupBy("grp", "surface").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(candidates.select("grp", "representative"), "grp").filter("surface <> representative").drop("representative")


def supported(signals: Column, members: Column, files: Column, in_code: Column) -> Column:
    """Whether a proposal is kept: an alias list, a scoped package, enough taint, a shape met twice, or a decoded literal in code."""
    has = lambda name, least=0.0: F.exists(signals, lambda s: (s["name"] == name) & (s["weight"] >= least))
    scope = F.exists(signals, lambda s: (s["name"] == "import_ref") & s["scoped"])
    return has("alias_enum") | scope | has("graph", 0.55) | (has("shape") & ((members >= 2) | (files >= 2))) | (has("decoded") & in_code)


def ranked(rows: DataFrame) -> DataFrame:
    """Best score first; proposals after entities of the same score."""
    return rows.orderBy(F.desc("score"), F.coalesce("entity_id", F.lit("~")), "representative")


def corroborated(segments: Column, stems: list[list[str]]) -> Column:
    """Whether a file's segments hold all parts of some stem."""
    parts = F.array(*[F.array(*map(F.lit, s)) for s in stems])
    return F.exists(parts, lambda s: (F.size(s) > 0) & (F.size(F.array_except(s, segments)) == 0))
