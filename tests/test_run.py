"""Similarity joins against the direct way, evidence of profiles by joins, and whole compile runs that pass or are stopped."""

import random
import time
from hashlib import sha256
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from test_rules import entities
from veilspark.functions import scoring, text
from veilspark.functions.casing import fuzzy_ratio
from veilspark.operators import detect, run, similar
from veilspark.plans import catalogue


def odd_pairs(n, seed):
    rng = random.Random(seed)

    def changed(s):
        s = list(s)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            i = rng.randrange(len(s) + 1)
            s[i : i + rng.choice([0, 1])] = rng.choice(["", "a", "b", " ", "d"])
        return "".join(s)

    for _ in range(n):
        letters = rng.choice(["ab ", "abc ", "abcdefgh ", "aab  "])
        b = "".join(rng.choice(letters) for _ in range(rng.randint(5, 26)))
        words = b.split()
        yield rng.choice([changed(b), changed(b[rng.randint(0, 4) :]), " ".join(rng.sample(words, len(words))), changed(b + rng.choice(["x", " zz", " a b"])), " ".join(words[:2])]), b


def test_filter_loses_no_pair():
    """Texts that are similar in each of the three ways: every pair from 88 on shares a key and passes the bounds."""
    met = 0
    for a, b in odd_pairs(20_000, 4):
        if min(len(a), len(b)) >= 6 and round(fuzzy_ratio(a, b), 4) >= 88:
            met += 1
            assert {k for k, _ in similar.keys_of(a)} & set(similar.name_keys(b)) and similar.close_enough(a, b), (a, b)
    assert met > 5000


def test_fuzzy_join(spark):
    pairs = list(odd_pairs(150, 8)) + [("meridian aero", "Meridian Aero Systems"), ("data service", "data service"), ("short", "short"), ("RouteSky", "skyroute")]
    left, right = sorted({a for a, _ in pairs}), sorted({b for _, b in pairs})
    surfaces, names = (spark.createDataFrame([(x,) for x in side] + [(None,), (side[0],)], f"{c} string") for side, c in ((left, "surface"), (right, "name")))
    got = {(r["surface"], r["name"]): r["ratio"] for r in similar.fuzzy_pairs(surfaces, names).collect()}
    want = {(a, b): round(fuzzy_ratio(a, b), 4) for a in left for b in right}
    assert got == {k: v for k, v in want.items() if v >= 88}
    tried = similar.fuzzy_candidates(surfaces, names).count()
    assert len(got) <= tried < len(left) * len(right)


def test_fuzzy_join_reads_all_its_tables(spark, tmp_path):
    """Suppliers' and customers' names against parts' as they are and turned round, and all rows counted."""
    tables = {"part": ("p_name", ["sky route", "sky route", "blue gear", None, "rod"]), "customer": ("c_name", ["sky routes", "sky routes", "gear blu", None]), "supplier": ("s_name", ["Skyroute", "large brushed coper", "blue gears", "blue gears", "blue gears"])}
    for name, (column, values) in tables.items():
        spark.createDataFrame([(v,) for v in values], f"{column} string").write.parquet(f"{tmp_path}/{name}.parquet")
    surfaces = [v for _, values in tables.values() for v in values if v]
    parts = [v for v in tables["part"][1] if v]
    names = parts + [" ".join(reversed(v.split(" "))) for v in parts] + [t for _, t in catalogue.FUZZY_NAMES]
    want = {(a, b): (r, surfaces.count(a), names.count(b)) for a in surfaces for b in names if (r := round(fuzzy_ratio(a, b), 4)) >= 88}
    got = catalogue.q_fuzzy_join(spark, str(tmp_path)).collect()
    assert {(r["surface"], r["name"]): (r["ratio"], r["n_surfaces"], r["n_names"]) for r in got} == want and len(got) == len(want)
    assert {("blue gears", "blue gear"), ("large brushed coper", "large brushed copper"), ("sky routes", "sky route")} <= set(want)


def test_evidence_by_joins(spark):
    """As every surface against every profile."""
    rng = random.Random(6)
    word = lambda: rng.choice(["sky", "route", "merid", "meridian", "meridians", "aero", "book", "core", "MAS", "data", "x1"])
    found = [
        {"entity_id": f"e{i}", "level": "internal", "names": [" ".join(word().capitalize() for _ in range(rng.randint(1, 4)))], "stems": [[word().lower() for _ in range(rng.randint(1, 2))] for _ in range(2)], "aliases": ["mas", "SR"][: rng.randint(0, 2)]}
        for i in range(25)
    ]
    surfaces = list({rng.choice(["-", "_", ""]).join(rng.choice([str.lower, str.capitalize, str.upper])(word()) for _ in range(rng.randint(1, 3))) for _ in range(300)}) + ["MAS", "SR", "Sky Route", "meridianss"]
    rows = spark.createDataFrame([(s,) for s in set(surfaces)], "surface string").withColumn("parts", text.segments(F.col("surface"))).filter(F.size("parts") > 0)
    known = spark.createDataFrame([(i, p["entity_id"], p["level"], p["names"], p["stems"], p["aliases"]) for i, p in enumerate(found)], "ord int, entity_id string, level string, names array<string>, stems array<array<string>>, aliases array<string>")
    got = {(r["surface"], r["ord"]): (r["exact"], r["stem"], r["fuzzy"], r["meant"]) for r in detect.matched(rows, known).collect()}
    every = rows.crossJoin(known).select(
        "surface", "ord", F.when(F.array_contains("names", F.col("surface")) | F.array_contains("aliases", F.col("surface")), 1.0).otherwise(0.0).alias("exact"),
        F.array_max(F.transform("stems", lambda s: scoring.stem_weight(F.col("parts"), s))).alias("stem"), "names",
        (F.size("parts") > 0).alias("some"), text.all_stop(F.col("parts")).alias("stop"), (scoring.acronym_weight(F.col("surface"), F.array_join("names", " "), F.lit(True), F.col("aliases")) > 0).alias("meant"),
    ).collect()
    weight = lambda r: round(0.45 + (r - 88) / 12 * 0.25, 4) if r >= 88 else 0.0
    want = {}
    for r in every:
        ratio = 0.0 if r["stop"] or len(r["surface"]) < 6 else max(round(fuzzy_ratio(r["surface"], n), 4) for n in r["names"])
        row = (r["exact"], r["stem"], weight(ratio), r["meant"])
        if row[:3] != (0.0, 0.0, 0.0) or row[3]:
            want[r["surface"], r["ord"]] = row
    assert {k: (v[0], v[1], round(v[2], 4), v[3]) for k, v in got.items()} == want and len(want) > 100


def test_corroboration_is_a_division(spark):
    rows = spark.createDataFrame([("a", ["sky", "x"]), ("a", ["route", None]), ("b", ["sky"]), ("c", None), ("d", ["route", "sky", "sky"])], "file string, parts array<string>")
    stems = spark.createDataFrame([(0, ["sky", "route", "sky"]), (0, ["none"]), (1, ["sky"]), (2, [])], "ord int, stem array<string>")
    assert {(r["file"], r["ord"]) for r in detect.corroborated(rows, stems).collect()} == {("a", 0), ("d", 0), ("a", 1), ("b", 1), ("d", 1)}


def test_semantic_pairs(spark):
    contexts = ["heron station seven", "HERON", "he", "", None, "unlike", "the station"]
    texts = [("e", "Heron Station"), ("e", "heron!"), ("f", "he"), ("g", "")]
    cut = lambda t: (lambda j: {j[i : i + 3] for i in range(len(j) - 2)} if len(j) > 2 else {j} - {""})("".join(c for c in (t or "").lower() if c.isalnum()))
    want = {}
    for i, c in enumerate(contexts):
        for e, t in texts:
            a, b = cut(c), cut(t)
            x = len(a & b) / (len(a) * len(b)) ** 0.5 if a and b else 0
            if x >= 0.3:
                want[i, e] = max(want.get((i, e), 0), x)
    got = similar.semantic_pairs(spark.createDataFrame(list(enumerate(contexts)), "id int, text string"), spark.createDataFrame(texts, "entity_id string, text string"))
    assert {(r["id"], r["entity_id"]): round(r["similarity"], 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}


def test_long_contexts_are_not_carried_with_each_trigram(spark):
    """One piece of 60,000 letters: as text of each of its trigrams it made gigabytes."""
    line = "".join(sha256(str(i).encode()).hexdigest() for i in range(950))
    contexts = spark.createDataFrame([(line, line), ("x", "Heron Station")], "id string, text string")
    began = time.monotonic()
    got = similar.semantic_pairs(contexts, spark.createDataFrame([("e", "heron station")], "entity_id string, text string")).collect()
    assert {(r["id"] == line, r["entity_id"]) for r in got} == {(False, "e")} and time.monotonic() - began < 20


FILES = [("src/skyRoute.js", "const skyRoute = load('Sky Route');\n// SKY_ROUTE_URL"), ("notes.env", "NAME=Sky Route"), ("skip/x.js", "Sky Route"), ("plain.env", "nothing")]


def shop(spark, **more):
    return entities(spark, {"id": "sky", "real": "Sky Route", "ghost": "vendor-a", "match": [("identifier", "skyRoute")]} | more)


def tree(spark, out):
    return {r["new_file"]: r["new_text"] for r in spark.read.parquet(out).collect()}


def test_compile_run(spark, tmp_path):
    out = f"file://{tmp_path}/tree"
    files = spark.createDataFrame(FILES, "file string, text string")
    done = run.compile_run(files, shop(spark), out, exclusions=("skip/*",), private=str(tmp_path / "private"))
    assert done.counters == {"n_scanned": 3, "n_changed": 2, "n_renamed": 1, "n_hits": 4}
    assert tree(spark, out) == {"src/vendorA.js": "const vendorA = load('Vendor A');\n// VENDOR_A_URL", "notes.env": "NAME=Vendor A", "plain.env": "nothing"}
    assert {(r["entity_id"], r["n"]) for r in done.hits.collect()} == {("sky", 4)} and done.kept.count() == 0
    events = done.audit.collect()
    assert len(events) == 1 and "Sky Route" not in str(events) and events[0]["operation_id"] == done.operation_id
    again = run.compile_run(files.limit(0), shop(spark), out)  # an empty corpus is a tree without files
    assert again.counters["n_scanned"] == 0 and tree(spark, out) == {}


def test_blocked_runs_publish_nothing(spark, tmp_path):
    """A pending restricted entity, a name that is left, a mapping store and an unreadable rule: the old tree stays."""
    out, files = f"file://{tmp_path}/tree", spark.createDataFrame([f for f in FILES if not f[0].startswith("skip")], "file string, text string")
    waiting = shop(spark, level="restricted", source="discovered")
    with pytest.raises(run.Blocked) as stopped:
        run.compile_run(files, waiting, out)
    assert stopped.value.gate == "V10 restricted" and not Path(tmp_path / "tree").exists()
    decision = spark.createDataFrame([("sky", "Sky Route", "vendor", "restricted", "accept", "someone", [])], "entity_id string, surface string, kind string, level string, reviewer_action string, approved_by string, spellings array<string>")
    run.compile_run(files, waiting, out, decisions=decision)
    before = tree(spark, out)
    assert len(before) == 3
    leaking = files.unionByName(spark.createDataFrame([("left.bin", "Sky Route")], "file string, text string"))  # a kind of file that is not rewritten
    store = files.unionByName(spark.createDataFrame([("map.bin", '{"mapping_version": 1, "entries": []}')], "file string, text string"))
    for bad, gate in ((leaking, "V1 leak"), (store, "V2 mapping store")):
        with pytest.raises(run.Blocked) as stopped:
            run.compile_run(bad, shop(spark), out)
        assert stopped.value.gate == gate and "Sky Route" not in str(stopped.value) and tree(spark, out) == before
    with pytest.raises(ValueError):
        run.compile_run(files, shop(spark), str(tmp_path / "tree"), private=str(tmp_path / "tree" / "private"))
    assert tree(spark, out) == before


def test_detected_run(spark, tmp_path):
    """Proposals come from the same files; what is not sure is not minted."""
    files = spark.createDataFrame([*FILES[:2], ("a.js", "// also known as: - Halcyon Air\n// - HALX\n\nconst x = '@halcyon/core';")], "file string, text string")
    done = run.compile_run(files, shop(spark), f"file://{tmp_path}/tree", detected=True)
    assert done.counters["n_scanned"] == 3 and done.discovered.filter("entity_id = 'sky'").count() == 1
    assert done.entities.count() >= 1
