"""How much of the real names two ways of rewriting leave: plain replacement, and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions import text
from veilspark.operators import config, rewrite, rules
from veilspark.sources.sinks import stored


def counted(rows: DataFrame, hits: str, name: str) -> DataFrame:
    return rows.select(F.explode(hits).alias("entity_id")).groupBy("entity_id").agg(F.count(F.lit(1)).alias(name))


def cases(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """A row for each seed entity: id, kind, level, real_occurrences (whole spellings in docs), baseline_residual and
    compile_residual (hits that rules still find after plain replacement, and after rules), exercised, passed, hard.

    docs: text. Each count is one pass over the texts; what rules made of them is written and scanned again.
    """
    owner = {r["spelling"]: r["entity_id"] for r in config.spellings(entities).collect()}  # configuration, bounded by rules.taken below
    found = rules.taken(rules.rules(entities))
    of = F.create_map(*[F.lit(x) for pair in owner.items() for x in pair])
    ghosts = {r["id"]: "" if r["strategy"] == "remove" else r["ghost"] or "" for r in entities.select("id", "strategy", "ghost").collect()}
    owners = lambda column: F.transform(F.filter(rules.all_hits(rules.transformed(rules.one_node("comment", column), found)), lambda h: ~h["kept"]), lambda h: h["entity_id"])
    real = docs.select(F.transform(text.anchored_hits(F.col("text"), list(owner)), lambda h: F.element_at(of, h)).alias("hits"))
    baseline = docs.select(rewrite.redact(F.col("text"), [(s, ghosts[i]) for s, i in owner.items()])[0].alias("text")).select(owners(F.col("text")).alias("hits"))
    done = stored(docs.select(rules.joined(rules.transformed(rules.one_node("comment", F.col("text")), found, hits=False)).alias("text")), "compiled").select(owners(F.col("text")).alias("hits"))
    rows = config.seeds(entities).select(F.col("id").alias("entity_id"), "kind", "level")
    for part, name in ((real, "real_occurrences"), (baseline, "baseline_residual"), (done, "compile_residual")):
        rows = rows.join(counted(part, "hits", name), "entity_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    exercised = (F.col("real_occurrences") > 0) | (F.col("baseline_residual") > 0)
    return rows.withColumn("exercised", exercised).withColumn("passed", F.col("compile_residual") == 0).withColumn("hard", exercised & (F.col("baseline_residual") > 0))


def ordered(cases_: DataFrame) -> DataFrame:
    return cases_.orderBy(F.desc("real_occurrences"), "entity_id")
