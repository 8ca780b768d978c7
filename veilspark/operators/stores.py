"""Append-only logs and the mapping store: latest record wins, agreement, upserts, allocation, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.scoring import rounded


def latest(log: DataFrame, key: str, *order: str, count: str | None = None) -> DataFrame:
    """The newest record of each key (and in column `count` how many it has): an aggregate with partial results, so a hot key
    costs no window."""
    rest = [c for c in log.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    counted = [F.count(F.lit(1)).alias(count)] if count else []
    return log.groupBy(key).agg(newest, *counted).select(key, *[F.col(f"r.{c}").alias(c) for c in rest], *([count] if count else []))


def agreement(decisions: DataFrame) -> DataFrame:
    """decisions (proposed, reviewer), one row a key: how often the reviewer kept what the scorer kept, and dropped what it
    dropped. A row for each proposed action ("none" for null), and one for all with proposed null, each with overrides, the rest.
    """
    keeps = F.coalesce(F.col("proposed").isin("auto", "review"), F.lit(False)) == F.coalesce(F.col("reviewer").isin("accept", "escalate"), F.lit(False))
    rows = decisions.select(F.coalesce("proposed", F.lit("none")).alias("proposed"), keeps.alias("agrees"), (F.col("reviewer") == "escalate").alias("escalated"))
    n, n_agree = F.count(F.lit(1)), F.count_if("agrees")
    return rows.rollup("proposed").agg(
        n.alias("n"), n_agree.alias("n_agree"), F.when(n > 0, rounded(n_agree / n, 3)).alias("rate"), F.count_if("escalated").alias("escalations"), (n - n_agree).alias("overrides")
    )


def upsert(old: DataFrame, new: DataFrame, key: str, value: str, frozen: str) -> DataFrame:
    """A new snapshot with what became of each row; the job fails where a frozen value would change (see `conflicts`)."""
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    changes = F.coalesce(F.col(f"o.{frozen}") & (F.col(f"o.{value}") != F.col(f"n.{value}")), F.lit(False))
    refused = F.raise_error(F.concat(F.lit("the frozen alias would change of "), F.col(f"o.{key}").cast("string"))).cast(old.schema[value].dataType)
    return joined.select(
        F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key), F.when(changes, refused).otherwise(F.coalesce(F.col(f"n.{value}"), F.col(f"o.{value}"))).alias(value),
        F.when(F.col(f"o.{key}").isNull(), "insert").when(F.col(f"n.{key}").isNull(), "keep").otherwise("update").alias("outcome"),
    )


def conflicts(old: DataFrame, new: DataFrame, key: str, value: str, frozen: str) -> DataFrame:
    """The keys whose frozen value new would change, with both values."""
    both = old.filter(frozen).select(key, F.col(value).alias("held")).join(new.select(key, F.col(value).alias("wanted")), key)
    return both.filter("held <> wanted")


def letter_suffix(n: Column) -> Column:
    """a to z, then 1, 2, ... for n from 0."""
    return F.when(n < 26, F.chr((n + 97).cast("long"))).otherwise((n - 25).cast("string"))


def shifted(rows: DataFrame, key: str, gaps: DataFrame) -> DataFrame:
    """rows (key, _n, ...) with _shift: how many gaps (_p, _free) of their key lie at _n or before. Both go by one sorted window, so that
    the work is linear in rows and gaps together."""
    whole = rows.select(F.col(key).cast("string").alias("_p"), F.col("_n").alias("_at"), F.struct("*").alias("_row"))
    both = whole.unionByName(gaps.select("_p", F.col("_free").alias("_at"), F.lit(None).cast(whole.schema["_row"].dataType).alias("_row")))
    so_far = Window.partitionBy("_p").orderBy("_at", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_shift", F.count_if(F.col("_row").isNull()).over(so_far)).filter("_row is not null").select("_row.*", "_shift")


def allocated(new: DataFrame, prefix: str, *order: str, taken: DataFrame | None = None) -> DataFrame:
    """An alias for each row, in order: its prefix and the next suffix that no alias in taken (alias) has.

    The free places of a prefix are found from its taken ones alone: row n goes n places further for each taken place up
    to it, which a running count of the gaps gives.
    """
    n = F.row_number().over(Window.partitionBy(prefix).orderBy(*order)) - 1
    rows = new.withColumn("_n", n.cast("long"))
    if taken is None:
        return rows.withColumn("alias", F.concat(F.col(prefix), F.lit("-"), letter_suffix(F.col("_n")))).drop("_n")
    used = taken.select(F.regexp_extract("alias", "^(.*)-([a-z]|[1-9][0-9]*)$", 1).alias("_p"), F.regexp_extract("alias", "^(.*)-([a-z]|[1-9][0-9]*)$", 2).alias("_s")).filter("_s <> ''").distinct()
    place = F.when(F.col("_s").rlike("^[a-z]$"), F.ascii("_s") - 97).otherwise(F.try_to_number("_s", F.lit("999999999999")).cast("long") + 25).cast("long")
    used = used.withColumn("_place", place)
    before = F.row_number().over(Window.partitionBy("_p").orderBy("_place")) - 1
    gaps = used.select("_p", (F.col("_place") - before).alias("_free"))
    # the place of the n-th free one: n and the taken places that lie before it
    return shifted(rows, prefix, gaps).withColumn("alias", F.concat(F.col(prefix), F.lit("-"), letter_suffix(F.col("_n") + F.col("_shift")))).drop("_n", "_shift")


def unique_ids(rows: DataFrame, base: str, *order: str, taken: DataFrame | None = None) -> DataFrame:
    """base, base_2, base_3 ... in order, passing over ids in taken (unique_id) and bases that look like such an id."""
    bases = rows.select(F.col(base).alias("unique_id")).distinct()
    used = bases if taken is None else bases.unionByName(taken.select("unique_id")).distinct()
    split = used.select(F.regexp_extract("unique_id", "^(.*)_([2-9]|[1-9][0-9]+)$", 1).alias("_b"), F.regexp_extract("unique_id", "^(.*)_([2-9]|[1-9][0-9]+)$", 2).alias("_k")).filter("_k <> ''")
    split = split.select("_b", F.try_to_number("_k", F.lit("999999999999")).cast("long").alias("_place"))
    if taken is not None:
        split = split.unionByName(taken.select(F.col("unique_id").alias("_b"), F.lit(1).cast("long").alias("_place")))
    split = split.distinct()
    before = F.row_number().over(Window.partitionBy("_b").orderBy("_place"))
    gaps = split.select(F.col("_b").alias("_p"), (F.col("_place") - before + 1).alias("_free"))
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    joined = shifted(rows.withColumn("_n", n.cast("long")), base, gaps)
    at = F.col("_n") + F.col("_shift")
    return joined.withColumn("unique_id", F.when(at == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("_"), at.cast("string")))).drop("_n", "_shift")


def accepted(newest: DataFrame) -> DataFrame:
    return newest.filter(F.col("reviewer_action").isin("accept", "escalate"))


def ignored_keys(newest: DataFrame) -> DataFrame:
    return newest.filter("reviewer_action = 'ignore'").select("key")


def cleared(newest: DataFrame) -> DataFrame:
    """Entities that were accepted by someone with a name."""
    return newest.filter("reviewer_action = 'accept' and coalesce(approved_by, '') <> '' and entity_id is not null").select("entity_id", "approved_by")


def history(log: DataFrame, key: str, value, *order: str) -> DataFrame:  # noqa: ANN001
    return log.filter(F.col(key) == value).orderBy(*order)


def with_decisions(candidates: DataFrame, newest: DataFrame) -> DataFrame:
    """candidates (entity_id, surface) with the newest decision of their key, or null."""
    key = F.coalesce("entity_id", F.concat(F.lit("sha256:"), F.sha2("surface", 256)))
    return candidates.withColumn("key", key).join(newest.select("key", "reviewer_action", "approved_by"), "key", "left")


def episodes(log: DataFrame, stream: str, order: list[str], opener: Column) -> DataFrame:
    """A new episode at each opener; what comes before the first belongs to it."""
    running = F.sum(F.when(opener, 1).otherwise(0)).over(Window.partitionBy(stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return log.withColumn("episode", F.greatest(running, F.lit(1)))


def episode_clock(log: DataFrame, keys: list[str], order: list[str], ts: str) -> DataFrame:
    first = F.first(ts, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return log.withColumn("elapsed", rounded((F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 1e6, 1))


def decision_records(rows: DataFrame) -> DataFrame:
    """Rows (surface, reviewer_action, key, entity_id, level, proposed_level) as log records: unknown actions fail the job;
    the key is the given one, the entity or the surface's digest; an escalation without a level is restricted."""
    known = F.col("reviewer_action").isin("accept", "ignore", "escalate")
    level = F.coalesce("level", F.when(F.col("reviewer_action") == "escalate", "restricted"), "proposed_level")
    action = F.when(known, F.col("reviewer_action")).otherwise(F.raise_error(F.concat(F.lit("no such action: "), F.coalesce("reviewer_action", F.lit("null")))))
    return rows.withColumn("key", F.coalesce("key", "entity_id", F.concat(F.lit("sha256:"), F.sha2("surface", 256)))).withColumn("level", level).withColumn("reviewer_action", action)
