"""Screening of outbound text: shapes, proposals and claims merged on their surface, with levels, floors and what reviewers said."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions import scoring, text
from veilspark.operators.config import LEVEL
from veilspark.operators.gates import floored

#: Spellings of proposals are searched for in one pattern; a larger set is refused.
MOST_SPELLINGS = 20_000
#: The kind of entity that each shape stands for.
KIND_OF_SHAPE = {
    "rfc1918_ip": "infra_identifier", "aws_account_id": "infra_identifier", "aws_access_key_id": "secret", "prefixed_secret": "secret", "named_secret": "secret", "jwt": "secret",
    "contract_id": "infra_identifier", "tenant_id": "infra_identifier", "internal_host": "domain", "scoped_npm_package": "vendor", "email": "person",
}


def literal_map(values: dict):  # noqa: ANN201
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def findings(docs: DataFrame, key: str, proposals: DataFrame, claims: DataFrame, ghosts: DataFrame, ignored: DataFrame, at: scoring.Thresholds = scoring.Thresholds()) -> DataFrame:
    """A row for each surface of a document: key, surface, kind, level, score, action, evidence, suppressed.

    docs: key and text. proposals: spelling, kind, level. claims: key, surface, kind, confidence; those that the text does
    not hold are dropped. ghosts: surface, aliases that are known and so no finding. ignored: keys ("sha256:...") that a
    reviewer dismissed; such a finding is suppressed, and its action ignore.

    Signals stand in order of their layer (shape, anchor, claim); the kind is that of the first layer, the level that of the
    proposal or what the kind implies. Restricted findings with a structural signal are reviewed whatever their score.
    """
    none = F.lit(None).cast("string")
    shapes = docs.select(key, F.explode(text.shape_hits(F.col("text"))).alias("h")).select(key, F.col("h.text").alias("surface"), F.lit(0).alias("layer"), F.lit("shape").alias("name"), F.col("h.weight").alias("weight"), F.element_at(literal_map(KIND_OF_SHAPE), F.col("h.kind")).alias("kind"), none.alias("level"))
    spelled = proposals.groupBy("spelling").agg(F.min(F.struct(F.coalesce("kind", F.lit("vendor")).alias("kind"), "level")).alias("p")).limit(MOST_SPELLINGS + 1).collect()
    if len(spelled) > MOST_SPELLINGS:
        raise ValueError(f"over {MOST_SPELLINGS} spellings of proposals")
    rows = shapes
    if spelled:
        table = docs.sparkSession.createDataFrame([(r["spelling"], r["p"]["kind"], r["p"]["level"]) for r in spelled], "surface string, kind string, level string")
        hits = docs.select(key, F.explode(text.anchored_hits(F.col("text"), [r["spelling"] for r in spelled])).alias("surface"))
        rows = rows.unionByName(hits.join(F.broadcast(table), "surface").select(key, "surface", F.lit(1).alias("layer"), F.lit("anchor").alias("name"), F.lit(scoring.ANCHOR).alias("weight"), "kind", "level"))
    said = docs.join(claims, key).filter("surface <> ''")
    quoted = F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), F.replace("surface", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z0-9_])"))
    sure = scoring.rounded(0.6 * F.least(F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), 4)
    rows = rows.unionByName(said.filter(F.regexp(F.col("text"), quoted)).select(key, "surface", F.lit(2).alias("layer"), F.lit("llm").alias("name"), sure.alias("weight"), F.coalesce("kind", F.lit("vendor")).alias("kind"), none.alias("level")))
    rows = rows.join(F.broadcast(ghosts.select("surface").distinct()) if ghosts.count() <= MOST_SPELLINGS else ghosts.select("surface").distinct(), "surface", "left_anti")
    by_layer = rows.groupBy(key, "surface", "layer").agg(F.max("weight").alias("weight"), F.first("name").alias("name"), F.min("kind").alias("kind"), F.max("level").alias("level"))
    merged = by_layer.groupBy(key, "surface").agg(
        F.sort_array(F.collect_list(F.struct("layer", "name", "weight"))).alias("signals"), F.min_by("kind", "layer").alias("kind"), F.max("level").alias("level")
    )
    merged = merged.withColumn("level", F.coalesce("level", F.element_at(literal_map(LEVEL), F.col("kind")))).withColumn("score", scoring.noisy_or(F.transform("signals", lambda s: s["weight"])))
    action = floored(scoring.classify(F.col("score"), scoring.has_hard_evidence(F.col("signals")), F.col("level"), F.lit(False), at), F.col("level"), F.col("signals"))
    merged = merged.withColumn("action", action).withColumn("_key", text.surface_key(F.col("surface")))
    merged = merged.join(ignored.select(F.col("key").alias("_key"), F.lit(True).alias("dismissed")).distinct(), "_key", "left")
    suppressed = F.coalesce("dismissed", F.lit(False))
    return merged.select(
        key, "surface", "kind", "level", "score", F.when(suppressed, "ignore").otherwise(F.col("action")).alias("action"), scoring.evidence_label(F.col("signals")).alias("evidence"), suppressed.alias("suppressed")
    )


def decisions(found: DataFrame, key: str, mode: str = "block") -> DataFrame:
    """A row for each document with findings: n_flagged, blocked, top_score, strongest, suppressed, evidence (distinct, joined)."""
    if mode not in ("block", "warn", "off"):
        raise ValueError(f"no such mode: {mode}")
    flagged = F.col("action") != "ignore"
    return found.groupBy(key).agg(
        F.count_if(flagged).alias("n_flagged"), ((F.count_if(flagged) > 0) & F.lit(mode == "block")).alias("blocked"), scoring.rounded(F.max(F.when(~F.col("suppressed"), F.col("score"))), 4).alias("top_score"),
        F.min_by("surface", F.struct((-F.col("score")).alias("s"), "surface")).alias("strongest"), F.count_if("suppressed").alias("suppressed"),
        F.array_join(F.array_sort(F.collect_set(F.when(flagged, F.col("evidence")))), "; ").alias("evidence"),
    )
