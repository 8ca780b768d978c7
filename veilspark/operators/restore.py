"""The way back from aliases to real names: rules from a mapping, text, unified diffs, and replay against real files."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from veilspark.functions.casing import parts_of, respeller
from veilspark.functions.text import needle_pattern, segments

#: How the lines of a diff that name files begin.
HEADERS = ("--- ", "+++ ", "diff --git ", "rename from ", "rename to ", "copy from ", "copy to ")
#: A mapping is configuration; a larger one is refused.
MOST_RULES = 10_000


def best_identifier(values: Column) -> Column:
    """Of several spellings in code the one of most parts, then the longest; null of none."""
    return F.array_max(F.transform(values, lambda v: F.struct(F.size(segments(v)).alias("n"), F.char_length(v).alias("m"), v.alias("v"))))["v"]


def reverse_rules(mapping: DataFrame) -> DataFrame:
    """ghost, real, code (the name's spelling in code), entity_id, lossy of entity_id, ghost, real and identifier (or null).

    Entries without a ghost are left out. lossy: a name of several words, whose case and number in prose don't come back.
    """
    return mapping.filter("ghost <> ''").select("ghost", "real", F.coalesce("identifier", "real").alias("code"), "entity_id", F.contains("real", F.lit(" ")).alias("lossy"))


def unambiguous(rules: DataFrame) -> list[Row]:
    """The rules, for the plan. Raises ValueError for two of one ghost, and beyond MOST_RULES."""
    twice = rules.groupBy("ghost").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"ambiguous mapping: two entries have the alias {twice[0]['ghost']}")
    rows = rules.orderBy(F.desc(F.char_length("ghost")), "ghost").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} entries in a mapping")
    return rows


def restored(text: Column, rules: list[Row], casings: bool = True) -> Column:
    """Aliases replaced by real names: as written, longest first, with their spaced display forms; and, with casings, in
    the identifiers between them in the identifier's own style. What was put in is not looked at again."""
    names = {}
    for r in rules:
        parts = parts_of(r["ghost"])
        if len(parts) > 1:
            names |= {" ".join(map(form, parts)): r["real"] for form in (str.capitalize, str.upper)}
    names |= {r["ghost"]: r["real"] for r in rules}
    if not names:
        return text
    pattern, real = needle_pattern(list(names)), F.from_json(F.lit(json.dumps(names)), "map<string,string>")
    between = F.split(text, pattern, -1)
    if casings:
        code = lambda r: [p for piece in re.split(r"[^A-Za-z0-9]+", r["code"]) if piece for p in parts_of(piece)]
        between = respeller([(parts_of(r["ghost"].split(".")[0]), code(r)) for r in rules])(between)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda h: F.element_at(real, h))
    return F.array_join(F.zip_with(between, F.concat(found, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def restored_lines(lines: DataFrame, line: str, rules: list[Row]) -> DataFrame:
    """Lines of unified diffs with a column `restored`: headers whole, bodies after their tag, all others as they are."""
    value = F.col(line)
    header = reduce(lambda a, p: a | value.startswith(p), HEADERS, F.lit(False))
    body = ~header & F.substring(line, 1, 1).isin("+", "-", " ") & ~value.startswith("+++") & ~value.startswith("---")
    at = F.when(header, 0).when(body, 1)
    changed = restored(F.when(at.isNotNull(), F.substring(value, at + 1, F.char_length(value))), rules)
    return lines.withColumn("restored", F.when(at.isNull(), value).otherwise(F.concat(F.substring(value, F.lit(1), at), changed)))


def diff_sizes(lines: DataFrame, source: str, line: str) -> DataFrame:
    many = lambda prefix: F.count_if(F.col(line).startswith(prefix))
    return lines.groupBy(source).agg(many("diff --git ").alias("n_files"), many("@@").alias("n_hunks"))


def replayed(changes: DataFrame, public: DataFrame, real: DataFrame, rules: list[Row]) -> DataFrame:
    """Changes of hunks against real files: file, number, hunk, tag, content, with a column `restored`.

    changes: file, number, hunk, old_start (of the hunk), tag, content. public, real: file, n, line (from 1). A line that
    the change keeps or removes is the real file's line at that place; only added lines are translated. Where a file is
    missing on a side, or its sides differ in lines, all its lines are translated.
    """
    within = Window.partitionBy("file", "hunk").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    old = F.col("tag") != "+"
    placed = changes.withColumn("n", F.col("old_start") + F.coalesce(F.count_if(old).over(within), F.lit(0)))
    sizes = lambda side, name: side.groupBy("file").agg(F.count(F.lit(1)).alias(name))
    alike = sizes(public, "a").join(sizes(real, "b"), "file").filter("a = b").select("file", F.lit(True).alias("alike"))
    there = real.select("file", F.col("n").cast("long").alias("n"), F.col("line").alias("real_line")).join(alike, "file")
    joined = placed.withColumn("n", F.col("n").cast("long")).join(there, ["file", "n"], "left")
    kept = old & F.col("alike")
    return joined.withColumn("restored", F.when(kept, F.col("real_line")).otherwise(restored(F.when(kept, None).otherwise(F.col("content")), rules))).select("file", "number", "hunk", "tag", "content", "restored")
