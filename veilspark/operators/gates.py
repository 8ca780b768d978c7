"""Checks that fail closed: leaked mapping stores, changes that carry real values or unknown aliases, claims, verdicts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import scoring
from veilspark.functions import text as words


def _entry(doc: Column) -> Column:
    has = lambda key: F.try_variant_get(doc, f"$.{key}", "variant").isNotNull()
    return has("real") & (has("real_sha256") | (has("ghost") & has("frozen")))


def mapping_shaped(text: Column) -> Column:
    """Whether a text is a mapping store, an entry of one or a list of entries; one that is no JSON is, if it names the digest field."""
    doc = F.try_parse_json(text)
    some = lambda path: F.coalesce(F.exists(F.try_variant_get(doc, path, "array<variant>"), _entry), F.lit(False))
    inside = F.try_variant_get(doc, "$.mapping_version", "variant").isNotNull() | _entry(doc) | some("$.entries") | some("$")
    named = F.contains(text, F.lit("real_sha256"))
    hinted = named | F.contains(text, F.lit('"frozen"')) | F.contains(text, F.lit("mapping_version"))
    return F.coalesce(F.when(~hinted, False).when(doc.isNull(), named).otherwise(inside), F.lit(False))


def alias_tokens(text: Column, prefixes: list[str]) -> Column:
    """Tokens shaped like an alias: a prefix in any case, a separator and one more character, or a prefix and one upper-case letter or digit."""
    plain = [re.escape(v) for p in prefixes for v in (p, p.capitalize())]
    parted = "|".join(plain + [re.escape(p.upper()) for p in prefixes])
    pattern = rf"(?<![A-Za-z0-9_])(?:(?:{parted})[-_][A-Za-z0-9]|(?:{'|'.join(plain)})[A-Z0-9])(?![A-Za-z0-9])"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def patch_rejections(lines: DataFrame, key: str, line: str, owners: dict[str, str], known: list[str], prefixes: list[str]) -> DataFrame:
    """key, leaked, unmapped of the changes that must be refused.

    leaked: ids of entities whose real spelling stands in an added or context line; unmapped: alias-shaped tokens there
    of which no alias is known. A key's distinct ids and tokens are few; its lines are never gathered.
    """
    shown = lines.filter(F.substring(line, 1, 1).isin("+", " ") & ~F.col(line).startswith("+++"))
    body = F.expr(f"substring(`{line}`, 2)")
    owner = F.create_map(*[F.lit(x) for pair in owners.items() for x in pair])
    leaked = F.transform(words.anchored_hits(body, list(owners)), lambda h: F.element_at(owner, h))
    unknown = F.filter(alias_tokens(body, prefixes), lambda t: ~F.regexp_replace(F.lower(t), "[-_]?(.)$", "-$1").isin(known))
    tagged = lambda kind, items: F.transform(items, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("x")))
    found = shown.select(key, F.explode(F.concat(tagged("leaked", leaked), tagged("unmapped", unknown))).alias("f")).select(key, "f.*").distinct()
    of = lambda kind: F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("x")))), ", ").alias(kind)
    return found.groupBy(key).agg(of("leaked"), of("unmapped"))


def parsed_claims(reply: Column) -> Column:
    """array<struct<surface, confidence>> from the first [ to the last ] of a reply; what cannot be read gives none."""
    items = F.try_variant_get(F.try_parse_json(F.regexp_extract(reply, r"(?s)\[.*\]", 0)), "$", "array<variant>")
    get = lambda c, key, kind: F.try_variant_get(c, f"$.{key}", kind)
    claims = F.transform(items, lambda c: F.struct(get(c, "surface", "string").alias("surface"), F.coalesce(get(c, "confidence", "double"), F.lit(0.0)).alias("confidence")))
    return F.coalesce(F.filter(claims, lambda c: c["surface"].isNotNull() & (c["surface"] != "")), F.filter(F.array(F.struct(F.lit("").alias("surface"), F.lit(0.0).alias("confidence"))), lambda c: F.lit(False)))


def claim_weights(rows: DataFrame, key: str, text: str, reply: str) -> DataFrame:
    """key, surface, weight, present: each claimed surface with 0.6 of its best confidence; one that the text doesn't hold is not present."""
    claims = rows.select(key, text, F.explode(parsed_claims(F.col(reply))).alias("c")).select(key, text, "c.*")
    quoted = F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), F.replace("surface", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z0-9_])"))
    weight = scoring.rounded(0.6 * F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)), 4)
    return claims.select(key, "surface", weight.alias("weight"), F.regexp(F.col(text), quoted).alias("present")).groupBy(key, "surface").agg(F.max("weight").alias("weight"), F.bool_or("present").alias("present"))


def floored(action: Column, level: Column, signals: Column) -> Column:
    """Restricted findings with a structural signal are reviewed, whatever their score."""
    structural = F.exists(signals, lambda s: s["name"].isin("shape", "anchor"))
    return F.when((action == "ignore") & (level == "restricted") & structural, "review").otherwise(action)


def screen_summary(findings: DataFrame) -> DataFrame:
    """One row from findings (score, action, evidence): how many are flagged, whether they block, the top score, the distinct evidence."""
    flagged = F.col("action") != "ignore"
    return findings.agg(
        F.count_if(flagged).alias("n_flagged"), (F.count_if(flagged) > 0).alias("blocked"),
        F.coalesce(scoring.rounded(F.max("score"), 4), F.lit(0.0)).alias("top_score"),
        F.array_join(F.array_sort(F.collect_set(F.when(flagged, F.col("evidence")))), "; ").alias("evidence"),
    )


def improvement(before: Column, after: Column) -> Column:
    percent = F.bround(100 * (before - after) / before).cast("long")
    return F.when(before <= 0, "—").otherwise(F.concat(F.lit("-"), (before - after).cast("string"), F.lit(" ("), percent.cast("string"), F.lit("%)")))


def verdict(cases: DataFrame, before: str, after: str, cap: int = 0) -> DataFrame:
    """One row: both sums, and whether nothing over `cap` is left and the earlier way left more."""
    sums = cases.agg(F.coalesce(F.sum(before), F.lit(0)).alias(before), F.coalesce(F.sum(after), F.lit(0)).alias(after))
    return sums.withColumn("passed", (F.col(after) <= cap) & (F.col(before) > F.col(after)))


def csv_field(value: Column) -> Column:
    """Quoted where it holds a comma, a quote or a line break."""
    return F.when(value.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def markdown_row(*values: Column) -> Column:
    cells = [F.replace(F.coalesce(v.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for v in values]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
