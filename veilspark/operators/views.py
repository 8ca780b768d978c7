"""Small views over candidates, findings, logs and the mapping: each one filter, join or grouped aggregate."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.automaton import Needles, Shared
from veilspark.operators import config


def open_proposals(candidates: DataFrame) -> DataFrame:
    """Candidates of no entity that are not ignored."""
    return candidates.filter("entity_id is null and action <> 'ignore'")


def by_action(candidates: DataFrame) -> DataFrame:
    """One row: candidates, auto, review, ignore, and open ones."""
    each = [F.count_if(F.col("action") == a).alias(a) for a in ("auto", "review", "ignore")]
    return candidates.agg(F.count(F.lit(1)).alias("candidates"), *each, F.count_if(F.col("entity_id").isNull() & (F.col("action") != "ignore")).alias("proposed"))


def candidate_table(candidates: DataFrame, limit: int | None = None, width: int = 38) -> DataFrame:
    """The printed rows of candidates (surface, score, evidence, action, entity_id), best first; with a limit only that many are ever sorted out."""
    order = (F.desc("score"), F.coalesce("entity_id", F.lit("~")), F.col("surface"))
    rows = candidates.orderBy(*order)
    rows = rows.limit(limit) if limit is not None else rows
    return rows.select(F.substring("surface", 1, width).alias("surface"), F.format_string("%.2f", "score").alias("score"), "evidence", F.concat(F.lit("["), "action", F.lit("]")).alias("action"), F.coalesce("entity_id", F.lit("(new)")).alias("tag"))


def ordered_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.desc("score"), "surface")


def covered(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """key, found: the expected keys, once each, and whether they were found (found: key)."""
    met = found.select(key).distinct().withColumn("_met", F.lit(True))
    return expected.select(key).distinct().join(met, key, "left").select(key, F.coalesce("_met", F.lit(False)).alias("found"))


def known_aliases(entities: DataFrame, entries: DataFrame) -> DataFrame:
    """alias: what configuration (ghost) or mapping (ghost) may have put into a text, once each."""
    return entities.select(F.col("ghost").alias("alias")).union(entries.select("ghost")).filter("alias <> ''").distinct()


def configured(rows: DataFrame, surface: str, entities: DataFrame) -> DataFrame:
    """rows with `configured`: whether the surface is a spelling of an entity in any case."""
    known = config.spellings(entities).select(F.lower("spelling").alias("_known")).distinct().withColumn("configured", F.lit(True))
    return rows.join(known, F.lower(surface) == F.col("_known"), "left").drop("_known").withColumn("configured", F.coalesce("configured", F.lit(False)))


def latest_matching(log: DataFrame, keys: list[str], order: list[str], **match: object) -> DataFrame:
    """The newest row of each key, whole, of those where every named field has that value. No group is gathered."""
    some = log
    for name, value in match.items():
        some = some.filter(F.col(name).eqNullSafe(F.lit(value)))
    newest = some.groupBy(*keys).agg(F.max_by(F.struct(*log.columns), F.struct(*order)).alias("_row"))
    return newest.select("_row.*")


def log_subset(log: DataFrame, component: str, event: str, components: list[str], noise: list[str]) -> DataFrame:
    """The events of some components, without the kinds that are noise."""
    return log.filter(F.col(component).isin(*components) & ~F.coalesce(F.col(event).isin(*noise), F.lit(False)))


def totals(log: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """keys and the sum of an amount (such as tokens) through each run; what has none counts as 0."""
    return log.groupBy(*keys).agg(F.sum(F.coalesce(F.col(amount), F.lit(0))).alias(f"total_{amount}"))


def newer_than_marker(log: DataFrame, keys: list[str], order: str, marker: Column) -> DataFrame:
    """The rows of each key that are newer than its newest marker row; all rows of a key without one."""
    marks = log.filter(marker).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(order).alias("_mark"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    rows = log.join(marks, same, "left")
    return rows.filter(F.col("_mark").isNull() | (F.col(order) > F.col("_mark"))).select(*log.columns)


def body_lines(text: Column) -> Column:
    """struct<lines, trailing>: the lines of a text, and the line end it ends with, which is no line of its own."""
    trailing = F.endswith(text, F.lit("\n"))
    lines = F.split(F.when(trailing, F.substring(text, F.lit(1), F.char_length(text) - 1)).otherwise(text), "\n")
    return F.struct(lines.alias("lines"), F.when(trailing, "\n").otherwise("").alias("trailing"))


class SlugDecoder:
    """Aliases in slugs become the dashed real names, longest alias first, where they stand alone."""

    def __init__(self, pairs: list[tuple[str, str]]):
        dashed = lambda real: re.sub("[^a-z0-9]+", "-", real.lower()).strip("-")
        ordered = sorted(((g, dashed(r)) for g, r in pairs if g), key=lambda p: -len(p[0]))
        self.steps = [(re.compile(rf"(?<![a-z0-9]){re.escape(g)}(?![a-z0-9])"), real) for g, real in ordered]
        places: dict[str, list[int]] = {}
        for i, (g, _) in enumerate(ordered):
            places.setdefault(g, []).append(i)
        self.needles, self.places = Needles(list(places)), list(places.values())

    def decode(self, slug: str) -> str:
        done = -1
        while later := [p for i in self.needles.present(slug) for p in self.places[i] if p > done]:
            done = min(later)
            pattern, real = self.steps[done]
            slug = pattern.sub(lambda _: real, slug)  # noqa: B023
        return slug


def decoded_slug(slug: Column, pairs: list[tuple[str, str]]) -> Column:
    """slug with every alias of pairs (alias, real name) decoded; one pass finds the aliases that occur at all."""
    shared = Shared(pairs, SlugDecoder)

    @F.pandas_udf("string")
    def run(slugs: pd.Series) -> pd.Series:
        decode = shared.get().decode
        return slugs.map(lambda s: None if s is None else decode(s))

    return run(slug)
