"""The detector: occurrences of configured entities and of what is like them, from the texts of files.

Files are cut into lines, lines into tokens. Distinct surfaces meet profiles by joins on what each kind of evidence rests
on, so that the work grows with the matches and not with the profiles, which are configuration and size-checked. Anchors (declared alias lists, scoped packages, internal hosts) gather what belongs to no
entity; taint over assignments and decoded literals add evidence. The outcome is one row an occurrence, for `discover.candidates`.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import scoring, text
from veilspark.functions.casing import LEAST_FUZZY
from veilspark.operators.graph import taint
from veilspark.operators.similar import fuzzy_pairs
from veilspark.operators.source import edges
from veilspark.sources.files import dealt
from veilspark.sources.sinks import stored

MOST_PROFILES = 5_000
SIGNAL = "array<struct<name:string,weight:double,scoped:boolean>>"
PROFILE = "array<struct<entity_id:string,names:array<string>,stems:array<array<string>>,aliases:array<string>,level:string>>"


def profiles(entities: DataFrame) -> DataFrame:
    """entity_id, ord, names (real and literals), stems (parts of names and identifiers), aliases (names of under six letters), level."""
    given = F.coalesce("match", F.array().cast("array<struct<kind:string,value:string>>"))
    of = lambda *kinds: F.transform(F.filter(given, lambda m: m["kind"].isin(*kinds)), lambda m: m["value"])
    names = F.array_distinct(F.concat(F.array("real"), of("literal")))
    stems = F.array_distinct(F.transform(F.concat(F.array("real"), of("identifier")), text.segments))
    short = F.filter(F.concat(names, of("identifier")), lambda n: F.char_length(n) <= 5)
    return entities.select(F.col("id").alias("entity_id"), "ord", names.alias("names"), F.filter(stems, lambda s: F.size(s) > 0).alias("stems"), short.alias("aliases"), "level")


def taken(rows: DataFrame) -> list[dict]:
    got = [r.asDict() for r in rows.orderBy("ord").limit(MOST_PROFILES + 1).collect()]
    if len(got) > MOST_PROFILES:
        raise ValueError(f"over {MOST_PROFILES} profiles")
    return got


def constant(found: list[dict]) -> Column:
    return F.from_json(F.lit(json.dumps([{k: p[k] for k in ("entity_id", "names", "stems", "aliases", "level")} for p in found])), PROFILE)


def signal(name: str, weight: Column, scoped: Column | bool = False) -> Column:
    return F.struct(F.lit(name).alias("name"), weight.cast("double").alias("weight"), (scoped if isinstance(scoped, Column) else F.lit(scoped)).alias("scoped"))


def tokens_of(files: DataFrame) -> DataFrame:
    """file, line, surface, parts, kind, shape of every token of files (file, text); each has a letter or a digit, and so a part."""
    lines = files.select("file", F.posexplode(F.split("text", "\n")).alias("n", "row"))
    found_at = F.arrays_zip(text.tokens(F.col("row")).alias("surface"), text.hit_starts(F.col("row"), text.TOKEN).alias("start"))
    rows = lines.select("file", (F.col("n") + 1).alias("line"), "row", F.explode(found_at).alias("t")).select("*", "t.*").drop("t")
    before = F.substring("row", F.lit(1), F.col("start"))
    return rows.select(
        "file", "line", "surface", text.segments(F.col("surface")).alias("parts"), text.node_kind(F.col("file"), before).alias("kind"),
        text.shape_of_token(F.col("row"), F.col("start"), F.col("surface")).alias("shape"),
    )


def corroborated(tokens: DataFrame, stems: DataFrame) -> DataFrame:
    """file, ord: the profiles of which a file's tokens (file, parts) hold all parts of some stem (stems: ord, stem).

    A division by counting: parts are looked up in an index of the stems' parts, and a stem counts whose parts were all met.
    """
    parts = stems.select("ord", F.array_distinct("stem").alias("stem")).distinct().select("ord", "stem", F.size("stem").alias("size"), F.explode("stem").alias("part"))
    met = tokens.select("file", F.explode("parts").alias("part")).distinct().join(parts, "part")
    return met.groupBy("file", "ord", "stem", "size").agg(F.count(F.lit(1)).alias("n")).filter("n = size").select("file", "ord").distinct()


def matched(surfaces: DataFrame, known: DataFrame) -> DataFrame:
    """surface, ord, exact, stem, fuzzy, meant: the profiles (known) that distinct surfaces (surface, parts) have to do with.

    Each kind of evidence is a join on what it rests on: the spelling, the first part of a stem's run, the five letters
    that a longer part begins with, keys of similar spellings, the initials. What nothing joins is never compared.
    """
    none = F.lit(0.0)
    row = lambda frame, **has: frame.select("surface", "ord", *(has.get(c, none).cast("double").alias(c) for c in ("exact", "stem", "fuzzy")), has.get("meant", F.lit(False)).alias("meant"))
    spelt = known.select("ord", F.explode(F.array_distinct(F.concat("names", "aliases"))).alias("surface"))
    exact = row(surfaces.join(spelt, "surface"), exact=F.lit(scoring.EXACT))

    stems = known.select("ord", F.explode("stems").alias("run")).withColumn("first", F.get("run", 0))
    parts = surfaces.select("surface", "parts", F.posexplode("parts").alias("at", "part"))
    runs = parts.join(stems, parts["part"] == stems["first"]).filter(F.slice("parts", F.col("at") + 1, F.size("run")) == F.col("run"))
    long = stems.filter((F.size("run") == 1) & (F.char_length("first") >= 5)).withColumn("five", F.substring("first", 1, 5))
    begun = parts.filter(F.char_length("part") > 5).withColumn("five", F.substring("part", 1, 5)).join(long, "five").filter(F.startswith("part", "first") & (F.col("part") != F.col("first")))
    stem = row(runs, stem=F.lit(0.85)).unionByName(row(begun, stem=F.lit(0.60)))

    compared = surfaces.filter((F.char_length("surface") >= LEAST_FUZZY) & ~text.all_stop(F.col("parts")))
    named = known.select("ord", F.explode("names").alias("name"))
    fuzzy = row(fuzzy_pairs(compared, named).join(named, "name"), fuzzy=scoring.fuzzy_weight(F.col("ratio")))

    initials = scoring.initials(F.array_join("names", " "))
    short = F.concat(F.transform("aliases", F.upper), F.when(F.char_length(initials) >= 3, F.array(initials)).otherwise(F.array().cast("array<string>")))
    letters = known.select("ord", F.explode(F.array_distinct(short)).alias("surface"))
    acronym = row(surfaces.filter(F.col("surface").rlike("^[A-Z]{2,5}$")).join(letters, "surface"), meant=F.lit(True))
    every = exact.unionByName(stem).unionByName(fuzzy).unionByName(acronym)
    return every.groupBy("surface", "ord").agg(*(F.max(c).alias(c) for c in ("exact", "stem", "fuzzy")), F.bool_or("meant").alias("meant"))


def scored(tokens: DataFrame, found: list[dict]) -> DataFrame:
    """tokens with entity_id and signals of the profile of the highest score (the first of equals), or neither."""
    rows = [(i, p["entity_id"], p["level"], p["names"], p["stems"], p["aliases"]) for i, p in enumerate(found)]
    known = tokens.sparkSession.createDataFrame(rows, "ord int, entity_id string, level string, names array<string>, stems array<array<string>>, aliases array<string>")
    surfaces = stored(tokens.select("surface", "parts").dropDuplicates(["surface"]), "surfaces")
    pairs = stored(matched(surfaces, known), "matched")
    some = tokens.select("file", "surface", "kind").distinct().join(pairs, "surface")
    asked = tokens.join(some.filter("meant").select("file").distinct(), "file", "left_semi")
    backed = corroborated(asked, known.select("ord", F.explode("stems").alias("stem"))).withColumn("backed", F.lit(True))
    some = some.join(backed, ["file", "ord"], "left").join(known.select("ord", "entity_id", "level", F.get("names", 0).alias("spelling")), "ord")
    acronym = F.when(F.col("meant") & F.col("backed"), 0.70).when(F.col("meant"), 0.22).otherwise(0.0)
    import_ref = scoring.import_weight(F.col("surface"), F.col("kind"))
    own = F.filter(F.array(signal("exact", F.col("exact")), signal("stem", F.col("stem")), signal("fuzzy", F.col("fuzzy")), signal("acronym", acronym)), lambda s: s["weight"] > 0)
    every = F.when((F.size(own) > 0) & (import_ref > 0), F.concat(own, F.array(signal("import_ref", import_ref)))).otherwise(own)
    some = some.withColumn("signals", every).withColumn("score", scoring.noisy_or(F.transform("signals", lambda s: s["weight"]))).filter("score > 0")
    best = some.groupBy("file", "surface", "kind").agg(F.max_by(F.struct("entity_id", "level", "spelling", "signals"), F.struct("score", -F.col("ord"))).alias("best"))
    return tokens.join(best.select("file", "surface", "kind", "best.*"), ["file", "surface", "kind"], "left")


def anchors(files: DataFrame) -> DataFrame:
    """key, stem, prefix, hint, shown, signals: what unknown names are gathered by; one row a stem of an anchor.

    An alias list goes by its shortest telling word and takes all its words, a scoped package by that of its scope, an
    internal host by that of its labels. Of several origins of a key the first (list, package, host) counts.
    """
    none = F.array().cast("array<string>")
    telling = lambda words: F.filter(words, text.distinctive)
    shortest = lambda words: F.array_min(F.transform(telling(words), lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))["w"]
    groups = files.select(F.explode(text.alias_groups(F.col("text"))).alias("items"))
    words = F.flatten(F.transform("items", text.words))
    shown = F.array_max(F.transform("items", lambda x: F.struct(F.char_length(x).alias("n"), x.alias("x"))))["x"]
    lists = groups.select(shortest(words).alias("key"), F.array_distinct(words).alias("stems"), F.lit(True).alias("long"), F.lit("vendor").alias("hint"), shown.alias("shown"), F.array(signal("alias_enum", F.lit(scoring.ALIAS_LIST))).alias("signals"), F.lit(0).alias("origin"))
    hits = files.select(F.explode(text.shape_hits(F.col("text"), ("scoped_npm_package", "internal_host"))).alias("h")).select("h.*")
    scope = text.segments(F.regexp_extract("text", "^@([^/]*)/", 1))
    packages = hits.filter("kind = 'scoped_npm_package'").select(shortest(scope).alias("key"), scope.alias("stems"), F.lit(False).alias("long"), F.lit("vendor").alias("hint"), F.col("text").alias("shown"), F.array(signal("import_ref", F.lit(0.90), True)).alias("signals"), F.lit(1).alias("origin"))
    labels = F.split("text", r"\.")
    hosts = hits.filter("kind = 'internal_host'").select(shortest(labels).alias("key"), none.alias("stems"), F.lit(False).alias("long"), F.lit("infra_identifier").alias("hint"), F.col("text").alias("shown"), F.array(signal("shape", F.col("weight"))).alias("signals"), F.lit(2).alias("origin"))
    every = lists.unionByName(packages).unionByName(hosts).filter("key is not null")
    first = every.groupBy("key").agg(F.min_by(F.struct("hint", "shown", "signals"), F.struct("origin", "shown")).alias("a"))
    stems = every.select("key", "long", F.explode(F.array_distinct(F.concat(F.array("key"), "stems"))).alias("stem"))
    stems = stems.groupBy("key", "stem").agg(F.bool_or(F.col("long") & (F.char_length("stem") >= 5)).alias("prefix"))
    return stems.join(first, "key").select("key", "stem", "prefix", "a.*")


def attached(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (id, parts) that meet an anchor: id, key, hint, shown, signals; the least key of several.

    A part meets a stem that it equals or, where both have five characters and the stem allows it, that begins it or is begun
    by it; five characters are the key of that join.
    """
    parts = rows.select("id", F.explode(F.array_distinct("parts")).alias("part"))
    equal = parts.join(found, parts["part"] == found["stem"]).select("id", "key")
    five = F.substring("part", 1, 5)
    near = parts.filter(F.char_length("part") >= 5).withColumn("five", five).join(found.filter("prefix").withColumn("five", F.substring("stem", 1, 5)), "five")
    near = near.filter(F.startswith("part", "stem") | F.startswith("stem", "part")).select("id", "key")
    met = equal.unionByName(near).groupBy("id").agg(F.min("key").alias("key"))
    return met.join(found.select("key", "hint", "shown", F.col("signals").alias("seed")).distinct(), "key")


def decoded(files: DataFrame, language: Column) -> DataFrame:
    """file, surface: what literals of code files spell when folded or decoded, once a file."""
    every = F.concat(text.folded_concats(F.col("text")), text.folded_joins(F.col("text")), text.decoded_base64(F.col("text")))
    rows = files.filter(language.isin("javascript", "typescript", "tsx")).select("file", F.explode(F.array_distinct(every)).alias("surface"))
    return rows


def occurrences(files: DataFrame, entities: DataFrame, language: Column, decay: float = 0.85, hops: int = 3) -> DataFrame:
    """grp, entity_id, spelling, level, file, line, surface, kind, signals: one row an occurrence that counts.

    Whole names are found beside tokens, so that a name which is also a token counts twice. `language`: of the file column.
    Texts are small beside what is found in them: files are dealt out first, as a table of one row group would be read, and cut
    into tokens and edges, by one task.
    """
    files = stored(dealt(files, "file"), "files")
    found = taken(profiles(entities))
    owner = F.create_map(*[F.lit(x) for p in reversed(found) for n in p["names"] for x in (n, p["entity_id"])]) if found else F.create_map().cast("map<string,string>")
    of = {p["entity_id"]: p for p in found}
    lines = files.select("file", F.posexplode(F.split("text", "\n")).alias("n", "row"))
    names = sorted({n for p in found for n in p["names"]})
    pattern = text.needle_pattern(names)
    at = F.arrays_zip(text.anchored_hits(F.col("row"), names).alias("surface"), text.hit_starts(F.col("row"), pattern).alias("start"))
    phrases = lines.select("file", (F.col("n") + 1).alias("line"), "row", F.explode(at).alias("t")).select("file", "line", "row", "t.*")
    pick = lambda field: F.create_map(*[F.lit(x) for k, p in of.items() for x in (k, p["names"][0] if field == "spelling" else p[field])])
    phrases = phrases.withColumn("entity_id", F.element_at(owner, F.col("surface"))).select(
        "file", "line", "surface", text.segments(F.col("surface")).alias("parts"), text.node_kind(F.col("file"), F.substring("row", F.lit(1), F.col("start"))).alias("kind"), "entity_id",
        F.element_at(pick("level"), F.col("entity_id")).alias("level"), F.element_at(pick("spelling"), F.col("entity_id")).alias("spelling"), F.array(signal("exact", F.lit(1.0))).alias("signals"),
    )
    tokens = scored(stored(tokens_of(files), "tokens"), found)
    shape = F.when(F.col("shape") > 0, F.array(signal("shape", F.col("shape")))).otherwise(F.array().cast(SIGNAL))
    tokens = tokens.withColumn("signals", F.concat(F.coalesce("signals", F.array().cast(SIGNAL)), shape))
    tokens = tokens.filter((F.size("signals") > 0) | F.exists("parts", text.distinctive)).select("file", "line", "surface", "parts", "kind", "entity_id", "level", "spelling", "signals")
    rows = stored(phrases.unionByName(tokens), "occurrences")

    flow = files.filter(language.isin("javascript", "typescript", "tsx")).select(F.explode(edges(F.col("text"))).alias("e")).select("e.src", "e.dst").distinct()
    flow = stored(flow, "edges")
    strong = rows.filter("entity_id is not null").select("surface", scoring.noisy_or(F.transform("signals", lambda s: s["weight"])).alias("score")).filter("score >= 0.5").groupBy("surface").agg(F.max("score").alias("score"))
    nodes = flow.select(F.col("src").alias("node")).unionByName(flow.select(F.col("dst").alias("node"))).distinct()
    seeds = strong.select(F.explode(F.array("surface", F.concat(F.lit("str:"), "surface"))).alias("node"), "score").join(nodes, "node", "left_semi")
    spread = stored(taint(flow, seeds, decay, hops).filter("hops > 0").select(F.col("node").alias("surface"), scoring.graph_weight(F.col("score")).alias("taint")), "taint")
    rows = rows.join(spread, "surface", "left").withColumn("signals", F.when(F.col("entity_id").isNull() & F.col("taint").isNotNull(), F.concat("signals", F.array(signal("graph", F.col("taint"))))).otherwise(F.col("signals"))).drop("taint")
    lone = spread.filter(~F.col("surface").rlike("^(?:str|env|member):")).join(rows.select("surface"), "surface", "left_anti")
    none = F.lit(None).cast("string")
    rows = rows.unionByName(lone.select(F.lit("(graph)").alias("file"), F.lit(0).alias("line"), "surface", text.segments(F.col("surface")).alias("parts"), F.lit("identifier").alias("kind"), none.alias("entity_id"), none.alias("level"), none.alias("spelling"), F.array(signal("graph", F.col("taint"))).alias("signals")))

    plain = decoded(files, language).withColumn("parts", text.segments(F.col("surface")))
    stems = F.transform(constant(found), lambda p: F.struct(F.exists(p["stems"], lambda s: text.contains_run(F.col("parts"), s) >= 0).alias("hit"), p["entity_id"].alias("entity_id"), p["level"].alias("level"), F.get(p["names"], 0).alias("spelling")))
    plain = plain.withColumn("p", F.get(F.filter(stems, lambda x: x["hit"]), 0))
    plain = plain.select("file", F.lit(0).alias("line"), "surface", "parts", F.lit("string").alias("kind"), "p.entity_id", "p.level", "p.spelling", F.array(signal("decoded", F.lit(scoring.DECODED))).alias("signals"))
    rows = stored(rows.unionByName(plain.filter(F.col("entity_id").isNotNull() | F.exists("parts", text.distinctive))), "all-occurrences")

    gathered = stored(anchors(files), "anchors")
    open_ = rows.filter("entity_id is null").withColumn("id", F.xxhash64("surface"))
    key = attached(open_.select("id", "parts").dropDuplicates(["id"]), gathered)
    has = lambda *names: F.exists("signals", lambda s: s["name"].isin(*names))
    more = F.when(has("stem", "alias_enum", "decoded"), F.array().cast(SIGNAL)).otherwise(F.array(signal("stem", F.lit(scoring.ATTACHED_STEM))))
    more = F.concat("signals", more, F.filter("seed", lambda s: ~F.exists("signals", lambda o: o["name"] == s["name"])))
    proposed = open_.join(key, "id").select(F.concat(F.lit("anchor:"), "key").alias("grp"), "entity_id", F.col("shown").alias("spelling"), none.alias("level"), "file", "line", "surface", "kind", more.alias("signals"))
    owned = rows.filter("entity_id is not null").select(F.col("entity_id").alias("grp"), "entity_id", "spelling", "level", "file", "line", "surface", "kind", "signals")
    return owned.unionByName(proposed)
