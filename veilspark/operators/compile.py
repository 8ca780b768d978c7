"""From findings and decisions to entities, and from entities to rewritten tasks; nothing passes whose check fails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions import text
from veilspark.operators import config, stores
from veilspark.operators.rules import ONE_TOKEN, Rule, all_hits, joined, one_node, transformed
from veilspark.operators.screen import literal_map

#: Rules that a found entity brings at most.
MOST_MATCHES = 24


def as_entities(found: DataFrame, entities: DataFrame, source: str) -> DataFrame:
    """New entities of found (surface, kind, level, spellings, approved_by): an alias and an id that none of entities has."""
    kind = F.coalesce("kind", F.lit("vendor"))
    rows = found.select(
        F.col("surface").alias("real"), kind.alias("kind"), F.coalesce("level", F.lit("confidential")).alias("level"), "approved_by",
        F.coalesce(F.element_at(literal_map(config.STRATEGY), kind), F.lit("semantic_alias")).alias("strategy"), F.coalesce(F.element_at(literal_map(config.PREFIX), kind), F.lit("vendor")).alias("prefix"),
        F.filter(F.array_distinct(F.coalesce("spellings", F.array().cast("array<string>"))), lambda s: (s != "") & (s != F.col("surface"))).alias("also"),
        F.concat(F.lit("disc_"), F.substring(F.regexp_replace(F.regexp_replace(F.lower("surface"), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 28)).alias("base"),
    )
    rows = stores.unique_ids(rows, "base", "real", taken=entities.select(F.col("id").alias("unique_id")))
    removed = F.col("strategy") == "remove"
    named = stores.allocated(rows.filter(~removed), "prefix", "real", taken=entities.select(F.col("ghost").alias("alias")))
    rows = named.unionByName(rows.filter(removed).withColumn("alias", F.lit("")))
    match = F.transform(F.slice("also", 1, MOST_MATCHES), lambda s: F.struct(F.when(s.rlike(ONE_TOKEN), "identifier").otherwise("literal").alias("kind"), s.alias("value")))
    return rows.select(
        F.col("unique_id").alias("id"), "real", "kind", "level", "strategy", F.col("alias").alias("ghost"), F.lit(None).cast("string").alias("note"), F.lit(source).alias("source"), "approved_by",
        F.lit(False).alias("rewrite_imports"), match.alias("match"),
    )


def minted(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities of proposals (entity_id null) that are sure: surface, kind, level, action, spellings."""
    sure = candidates.filter("entity_id is null and action = 'auto'").withColumn("approved_by", F.lit(None).cast("string"))
    return as_entities(sure, entities, "discovered")


def with_decided(entities: DataFrame, newest: DataFrame) -> DataFrame:
    """entities after the newest decisions (entity_id, surface, kind, level, reviewer_action, approved_by, spellings): an
    accepted one of a restricted entity nobody approved clears it, one of no entity adds one."""
    agreed = stores.accepted(newest)
    clears = stores.cleared(newest).withColumnRenamed("entity_id", "id").withColumnRenamed("approved_by", "_by").groupBy("id").agg(F.min("_by").alias("_by"))
    old = entities.join(clears, "id", "left")
    waits = (F.col("level") == "restricted") & F.coalesce("source", F.lit("seed")).isin("discovered", "human") & (F.coalesce("approved_by", F.lit("")) == "")
    old = old.withColumn("approved_by", F.when(waits, F.coalesce("_by", "approved_by")).otherwise(F.col("approved_by"))).select(*entities.columns)
    fresh = agreed.filter("entity_id is null").join(entities.select(F.col("real").alias("surface")), "surface", "left_anti")
    return old.unionByName(as_entities(fresh, entities, "human"), allowMissingColumns=True)


def tasks(docs: DataFrame, found: list[Rule], spellings: list[str]) -> DataFrame:
    """docs (with text) with the task as it may go out: out (null if a spelling is left in it), n_rewritten, n_residual, rejected."""
    rows = docs.withColumn("_done", transformed(one_node("comment", F.col("text")), found))
    rows = rows.withColumn("_out", joined(F.col("_done"))).withColumn("n_rewritten", F.size(F.filter(all_hits(F.col("_done")), lambda h: ~h["kept"])))
    rows = rows.withColumn("n_residual", F.size(text.anchored_hits(F.col("_out"), spellings)) if spellings else F.lit(0))
    return rows.withColumn("rejected", F.col("n_residual") > 0).withColumn("out", F.when(~F.col("rejected"), F.col("_out"))).drop("_done", "_out")


def checked(gate, *args) -> tuple[bool, str]:  # noqa: ANN001
    """Whether a gate (a function that returns the rows which must not be) lets a run pass; one that fails does not."""
    try:
        first = gate(*args).limit(1).collect()
    except Exception as failure:  # noqa: BLE001
        return False, f"the check failed: {type(failure).__name__}"
    return not first, str(first[0].asDict()) if first else ""
