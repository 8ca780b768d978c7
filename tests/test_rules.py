"""Rewriting by rules, configuration, stores, screening and the detector, on small fixtures with known results."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspark.functions import casing
from veilspark.operators import compile as compiling
from veilspark.operators import config, detect, discover, evaluate, rules, screen, source, stores
from veilspark.sources import files, sinks
from veilspark.streaming import logs

FIELDS = config.ENTITY + ", ord int"


def entities(spark, *rows):
    base = {"kind": "vendor", "level": "internal", "strategy": "semantic_alias", "match": None}
    names = [f.split(" ")[0] for f in FIELDS.split(", ")]
    return spark.createDataFrame([tuple((base | r | {"ord": i}).get(n) for n in names) for i, r in enumerate(rows)], FIELDS)


def change(spark, found, kind, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", rules.transformed(rules.one_node(kind, F.col("t")), found).alias("d"))
    return [(r["o"], [(h["entity_id"], h["kept"], h["real"]) for h in r["h"]]) for r in rows.select("i", rules.joined(F.col("d")).alias("o"), rules.all_hits(F.col("d")).alias("h")).orderBy("i").collect()]


@pytest.mark.parametrize("token", "booking-core BOOKING_CORE_URL bookingCore BookingCore booking.core bookingcore BOOKINGCORE Northwind SkyRoute region-a host-a.example".split() + ["booking core"])
def test_a_token_is_spelled_like_itself(token):
    assert casing.in_style_of(token, casing.parts_of(token)) == token


def test_replacements_touch_the_match_only():
    at = lambda t, *stem: casing.replacement(t, list(stem), ["vendor", "a"])
    assert at("skyroute", "skyroute") == (0, 8, "vendor-a") and at("SKYROUTE_API_KEY", "skyroute") == (0, 8, "VENDOR_A")
    assert at("northwindSkyrouteConnector", "skyroute") == (9, 17, "VendorA") and at("skyXroute", "skyroute") is None
    like = lambda s: casing.in_style_of(s, ["vendor", "a"])
    assert [like(s) for s in ("SkyRoute", "SKYROUTE", "Sky Route", "Meridian", "MERIDIAN")] == ["VendorA", "VENDOR-A", "Vendor A", "VendorA", "VENDOR-A"]
    put = lambda t: casing.splice(t, ["booking", "core"], ["service", "a"])
    assert [put(t) for t in ("_booking_core", "__booking_core__", "$bookingCore", "x.booking.core")] == ["_service_a", "__service_a__", "$serviceA", "x.service.a"]


@settings(max_examples=300, deadline=None)
@given(st.text("aBbookingCoreKING_-. $1", max_size=30))
def test_nothing_outside_a_match_changes(token):
    found = casing.replacement(token, ["booking", "core"], ["service", "a"])
    if found:
        begin, end, new = found
        assert token[begin:end].lower().replace("_", "").replace("-", "").replace(".", "").replace(" ", "") == "bookingcore"
        assert casing.splice(token, ["booking", "core"], ["service", "a"]) == token[:begin] + new + token[end:]
        assert "".join(c for c in new.lower() if c.isalpha()) == "servicea"
    else:
        assert casing.splice(token, ["booking", "core"], ["service", "a"]) == token


def test_chosen_spans_are_the_picked_ones(spark):
    import random

    from veilspark.operators.rewrite import picked_spans

    rng = random.Random(5)
    rows = []
    for i in range(60):
        spans = [{"start": a, "end": a + rng.randint(1, 9), "rank": rng.randint(0, 3)} for a in (rng.randint(0, 40) for _ in range(rng.randint(0, 14)))]
        rows.append((i, [(s["start"], s["end"], s["rank"]) for s in spans], [(s["start"], s["end"], s["rank"]) for s in rules.chosen(spans)]))
    kind = "array<struct<start:int,end:int,rank:int>>"
    got = spark.createDataFrame(rows, f"i int, s {kind}, want {kind}").select("i", picked_spans(F.col("s")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_rules_by_kind_of_node(spark):
    found = rules.taken(rules.rules(entities(
        spark, {"id": "dd", "real": "Datadog", "ghost": "vendor-c", "match": [("literal", "datadoghq")]}, {"id": "svc", "real": "booking-core", "kind": "internal_service", "ghost": "service-a"},
        {"id": "nw", "real": "Northwind Airlines", "kind": "client", "level": "restricted", "ghost": "client-a", "match": [("identifier", "northwind")]}, {"id": "sky", "real": "skyroute", "ghost": "vendor-a"},
        {"id": "key", "real": "sk_live_northwind_9f3ab7c21e5d4088", "kind": "secret", "level": "restricted", "strategy": "remove", "ghost": ""},
    )))
    assert change(spark, found, "identifier", "datadoghq", "bookingCore", "BOOKING_CORE_URL") == [("datadoghq", []), ("serviceA", [("svc", False, "bookingCore")]), ("SERVICE_A_URL", [("svc", False, "BOOKING_CORE")])]
    got = change(spark, found, "string", "datadoghq", "northwind-skyroute-connector", "Northwind Airlines", "sk_live_northwind_9f3ab7c21e5d4088", "const users", None, "")
    assert [o for o, _ in got] == ["vendor-c", "client-a-vendor-a-connector", "Client A", "", "const users", "", ""]
    assert [h for h, _, _ in got[3][1]] == ["key"] and got[4][1] == []


def test_ties_of_spans(spark):
    found = rules.taken(rules.rules(entities(
        spark, {"id": "dom", "real": "api.example.internal", "kind": "domain", "level": "confidential", "ghost": "host-a.example"}, {"id": "word", "real": "example", "ghost": "vendor-a"},
        {"id": "low", "real": "Acme", "ghost": "vendor-a"}, {"id": "high", "real": "Acme", "level": "restricted", "ghost": "vendor-b"},
        {"id": "z", "real": "Umbra", "level": "restricted", "ghost": "vendor-c"}, {"id": "drop", "real": "Umbra", "kind": "secret", "level": "public", "strategy": "remove", "ghost": ""},
    )))
    got = change(spark, found, "string", "see api.example.internal now", "Acme", "Umbra!")
    assert [(o, [h[0] for h in hs]) for o, hs in got] == [("see host-a.example now", ["dom"]), ("VendorB", ["high"]), ("!", ["drop"])]


def test_specifiers(spark):
    rows = entities(spark, {"id": "v", "real": "AcmeCorp", "ghost": "vendor-a", "match": [("identifier", "acmecorp"), ("identifier", "acme")]})
    found, loud = rules.taken(rules.rules(rows)), rules.taken(rules.rules(rows.withColumn("rewrite_imports", F.lit(True))))
    texts = ['from "@acmecorp/sdk"', "require('acmecorp'", "import './services/acme'", "from 'node:acme'"]
    assert [(o, hs[0][1]) for o, hs in change(spark, found, "specifier", *texts)] == [(texts[0], True), (texts[1], True), ("import './services/vendor-a'", False), (texts[3], True)]
    assert change(spark, loud, "specifier", texts[0])[0][0] == 'from "@vendor-a/sdk"'
    done = spark.createDataFrame([("src/acme.js", "import x from '@acmecorp/sdk'\nconst acmeUrl = 1 // Acme")], "file string, text string")
    done = rules.compiled(done, found, source.file_nodes(F.col("file"), files.language(F.col("file")), F.col("text")))
    row = done.first()
    assert (row["new_file"], row["new_text"]) == ("src/vendor-a.js", "import x from '@acmecorp/sdk'\nconst vendorAUrl = 1 // VendorA")
    assert rules.counters(done).first().asDict() == {"n_scanned": 1, "n_changed": 1, "n_renamed": 1, "n_hits": 2}
    assert [r.asDict() for r in rules.kept_by_specifier(done).collect()] == [{"specifier": "@acmecorp/sdk", "n": 1}]


def test_configuration(spark, tmp_path):
    one = "entities:\n- {id: a, real: Acme, kind: vendor, level: internal, strategy: semantic_alias, ghost: vendor-a, match: [{kind: identifier, value: acme}]}\n"
    (tmp_path / "good.yaml").write_text(one + "- {id: b, real: B, kind: person, level: restricted, strategy: synthetic_id, ghost: person-a, source: human}\n")
    rows = config.entities_of(spark, str(tmp_path / "good.yaml"))
    assert [r["id"] for r in config.pending(rows).collect()] == ["b"] and [r["id"] for r in config.seeds(rows).collect()] == ["a"]
    assert {r["spelling"]: r["entity_id"] for r in config.spellings(rows).collect()} == {"Acme": "a", "acme": "a", "B": "b"}
    (tmp_path / "twice.yaml").write_text(one + one.split("\n")[1] + "\n")
    (tmp_path / "odd.yaml").write_text(one.replace("kind: vendor", "kind: thing").replace("kind: identifier", "kind: stem"))
    for name, fault in (("twice", "met twice"), ("odd", "no such kind: thing")):
        with pytest.raises(ValueError, match=fault):
            config.entities_of(spark, str(tmp_path / f"{name}.yaml"))
    (tmp_path / "m.json").write_text(json.dumps({"mapping_version": 1, "entries": [{"entity_id": "a", "ghost": "vendor-a"}, {"entity_id": "c", "real": "C", "kind": "vendor", "ghost": "vendor-b", "frozen": True}]}))
    assert {r["id"] for r in config.with_mapping_only(rows, config.mapping_entries(spark, str(tmp_path / "m.json"))).collect()} == {"a", "b", "c"}


def test_ids_and_aliases(spark):
    rows = spark.createDataFrame([(1, "disc_a"), (2, "disc_a"), (3, "disc_a_2"), (4, "disc_a"), (5, "x")], "i int, base string")
    ids = {r["i"]: r["unique_id"] for r in stores.unique_ids(rows, "base", "i", taken=spark.createDataFrame([("disc_a_4",), ("x",)], "unique_id string")).collect()}
    assert ids == {1: "disc_a", 2: "disc_a_3", 3: "disc_a_2", 4: "disc_a_5", 5: "x_2"}
    new = spark.createDataFrame([(i, "vendor") for i in range(27)], "i int, p string")
    taken = spark.createDataFrame([("vendor-a",), ("vendor-c",), ("vendor-2",), ("host-b",), ("vendor-",), (None,)], "alias string")
    got = [r["alias"] for r in stores.allocated(new, "p", "i", taken=taken).orderBy("i").collect()]
    assert got[:3] == ["vendor-b", "vendor-d", "vendor-e"] and got[23:] == ["vendor-z", "vendor-1", "vendor-3", "vendor-4"]


def test_frozen_aliases_stop_the_upsert(spark):
    old = spark.createDataFrame([("a", "vendor-a", True), ("b", "vendor-b", False)], "id string, ghost string, frozen boolean")
    new = spark.createDataFrame([("a", "vendor-z"), ("b", "vendor-y"), ("c", "vendor-c")], "id string, ghost string")
    with pytest.raises(Exception, match="frozen alias would change of a"):
        stores.upsert(old, new, "id", "ghost", "frozen").collect()
    assert {(r["id"], r["ghost"]) for r in stores.upsert(old, new.filter("id <> 'a'"), "id", "ghost", "frozen").collect()} == {("a", "vendor-a"), ("b", "vendor-y"), ("c", "vendor-c")}
    assert not compiling.checked(lambda: stores.conflicts(old, new, "id", "ghost", "frozen"))[0]
    assert compiling.checked(lambda: stores.conflicts(old, new.filter("id <> 'a'"), "id", "ghost", "frozen")) == (True, "")
    assert compiling.checked(lambda: old.select("no_such_column")) == (False, "the check failed: AnalysisException")


def test_decisions_become_entities(spark):
    rows = entities(spark, {"id": "a", "real": "Acme", "ghost": "vendor-a"}, {"id": "r", "real": "Rex", "kind": "person", "level": "restricted", "ghost": "person-a", "source": "discovered"})
    kind = "entity_id string, surface string, kind string, level string, reviewer_action string, approved_by string, spellings array<string>"
    newest = spark.createDataFrame([("r", "Rex", "person", "restricted", "accept", "me", None), (None, "Zed Corp", None, "internal", "escalate", None, ["zedCorp", "ZED corp", "Zed Corp"]), (None, "No", None, None, "ignore", None, None), (None, "Acme", None, None, "accept", "me", None)], kind)
    got = {r["id"]: r for r in compiling.with_decided(rows, newest).collect()}
    assert set(got) == {"a", "r", "disc_zed_corp"} and got["r"]["approved_by"] == "me"
    new = got["disc_zed_corp"]
    assert (new["ghost"], new["source"], [tuple(m) for m in new["match"]]) == ("vendor-b", "human", [("identifier", "zedCorp"), ("literal", "ZED corp")])


def test_evaluation_counts_what_is_left(spark):
    docs = spark.createDataFrame([("bookingCore and BOOKING_CORE_URL, booking-core",), ("Sky Route and skyRoute SKY_ROUTE",)], "text string")
    rows = entities(spark, {"id": "svc", "real": "booking-core", "kind": "internal_service", "ghost": "service-a"}, {"id": "sky", "real": "Sky Route", "ghost": "vendor-a", "match": [("identifier", "skyRoute")]}, {"id": "no", "real": "Nothing", "ghost": "vendor-b"})
    got = [(r["entity_id"], r["real_occurrences"], r["baseline_residual"], r["compile_residual"], r["exercised"], r["hard"]) for r in evaluate.ordered(evaluate.cases(docs, rows)).collect()]
    assert got == [("sky", 2, 1, 0, True, True), ("svc", 1, 2, 0, True, True), ("no", 0, 0, 0, False, False)]


def test_screening(spark):
    docs = spark.createDataFrame([(1, "mail bob@x.io and Halcyon at svc.prod.internal, seen by ana@y.io"), (2, "nothing here")], "id int, text string")
    proposals = spark.createDataFrame([("Halcyon", "vendor", None), ("bob@x.io", "person", "restricted")], "spelling string, kind string, level string")
    claims = spark.createDataFrame([(1, "svc.prod.internal", "domain", 0.5), (1, "svc.prod.internal", "domain", 2.0), (1, "svc", "vendor", 0.9), (1, "ana", None, None), (2, "gone", "vendor", 0.9)], "id int, surface string, kind string, confidence double")
    ghosts, ignored = spark.createDataFrame([("ana@y.io",)], "surface string"), spark.createDataFrame([], "key string")
    found = screen.findings(docs, "id", proposals, claims, ghosts, ignored)
    got = {r["surface"]: (r["kind"], r["level"], r["score"], r["action"], r["evidence"]) for r in found.collect()}
    assert got["bob@x.io"] == ("person", "restricted", 0.8375, "review", "anchor + structural shape")
    assert got["svc.prod.internal"] == ("domain", "confidential", 0.78, "review", "llm + structural shape")  # claims are capped at 0.6
    assert got["Halcyon"] == ("vendor", "internal", 0.75, "review", "anchor") and "ana@y.io" not in got and "gone" not in got and got["svc"][2] == 0.54
    row = screen.decisions(found, "id").first()
    assert row["blocked"] and row["strongest"] == "bob@x.io" and not screen.decisions(found, "id", "warn").first()["blocked"]
    dismissed = spark.range(3).select(F.concat(F.lit("sha256:"), F.sha2(F.element_at(F.array(F.lit("Halcyon"), F.lit("bob@x.io"), F.lit("svc.prod.internal")), (F.col("id") + 1).cast("int")), 256)).alias("key"))
    row = screen.decisions(screen.findings(docs, "id", proposals, claims.limit(0), ghosts, dismissed), "id").first()
    assert not row["blocked"] and row["suppressed"] == 3


CODE = """// Halcyon Ltd, also known as:
// - Halcyon
// - HALX

import sdk from "@brandex/core";
const client = bookingCore;
let handle = client;
const key = 'merid' + 'ian_key';
const host = "https://api.halcyon.internal/v1"; // MAS runs it
const meridianBase = load("Sky Rout");
"""


def test_detector(spark):
    shop = entities(
        spark, {"id": "sky", "real": "Sky Route", "ghost": "vendor-a", "match": [("identifier", "skyRoute")]}, {"id": "book", "real": "bookingCore", "kind": "internal_service", "ghost": "service-a"},
        {"id": "mas", "real": "Meridian Aero Systems", "kind": "client", "level": "restricted", "ghost": "client-a", "match": [("identifier", "meridian")]},
    )
    rows = spark.createDataFrame([("src/a.js", CODE), ("src/b.md", "Meridian Aero Systems met the halcyonian team. MAS"), ("src/empty.js", ""), ("src/none.js", None)], "file string, text string")
    found = detect.occurrences(rows, shop, files.language(F.col("file"))).collect()
    best = {}
    for r in found:
        for s in r["signals"]:
            key = (r["grp"], r["surface"], s["name"])
            best[key] = max(best.get(key, 0), s["weight"])
    assert best[("book", "bookingCore", "exact")] == 1.0 and best[("book", "bookingCore", "stem")] == 0.85
    assert best[("mas", "meridianBase", "stem")] == 0.85 and best[("mas", "MAS", "acronym")] == 0.70 and best[("mas", "meridian_key", "decoded")] == 0.5
    assert best[("mas", "Meridian Aero Systems", "exact")] == 1.0
    assert best[("anchor:halcyon", "api.halcyon.internal/v1", "shape")] == 0.45 and best[("anchor:halcyon", "halcyonian", "stem")] == 0.68 and best[("anchor:halcyon", "Halcyon", "alias_enum")] == 0.8
    assert best[("anchor:brandex", "brandex/core", "import_ref")] == 0.9
    assert sum(r["surface"] == "bookingCore" and r["line"] == 6 for r in found) == 2  # a whole name and a token
    got = {r["grp"]: r for r in discover.candidates(spark.createDataFrame(found, detect.occurrences(rows, shop, files.language(F.col("file"))).schema)).collect()}
    assert got["book"]["action"] == "auto" and got["mas"]["action"] == "review" and got["anchor:halcyon"]["entity_id"] is None and got["anchor:halcyon"]["action"] == "review"
    assert got["anchor:halcyon"]["representative"] == "Halcyon" and got["mas"]["representative"] == "Meridian Aero Systems"


def test_detector_deals_out_files_that_one_task_would_read(spark, monkeypatch):
    """A table of one row group is one task; tokens, edges and keys of similar spellings are made by more."""
    from veilspark.operators import similar

    written, dealt = {}, []
    monkeypatch.setattr(detect, "stored", lambda rows, label: written.setdefault(label, sinks.stored(rows, label)))
    monkeypatch.setattr(similar, "dealt", lambda rows, key: dealt.append(key) or files.dealt(rows, key), raising=False)
    rows = spark.createDataFrame([(f"src/{i}.js", CODE) for i in range(40)], "file string, text string").coalesce(1)
    shop = entities(spark, {"id": "book", "real": "bookingCore", "kind": "internal_service", "ghost": "service-a"})
    found = detect.occurrences(rows, shop, files.language(F.col("file")))
    assert found.filter("surface = 'bookingCore' and line = 6").count() == 80  # a name and a token a file
    assert len(written["tokens"].inputFiles()) > 1 and len(written["files"].inputFiles()) > 1 and dealt == ["surface"]


def test_flow_of_names(spark):
    code = "const a = b;\nlet c = f(a, 'x')\nif (a == b) { d => a }\nm = require('@p/q'); n = new K(); a = a;"
    got = {(e["src"], e["dst"]) for e in spark.range(1).select(source.edges(F.lit(code)).alias("e")).first()["e"]}
    assert {("b", "a"), ("f", "c"), ("a", "c"), ("str:x", "c"), ("a", "f"), ("str:x", "f"), ("str:@p/q", "m"), ("K", "n")} <= got and all(a != b for a, b in got)


def test_streamed_episodes_are_those_of_the_batch(spark, tmp_path):
    events = [("k", f"2024-01-01 00:{m:02d}:00", m % 7 == 3) for m in range(30)] + [("m", "2024-01-01 00:01:00", True), ("m", "2024-01-01 00:00:00", False)]
    for i in range(0, len(events), 8):  # events come out of order
        part = sorted(events, key=lambda e: hash((e[1], e[0])) % 1000)[i : i + 8]
        (tmp_path / f"{i}.json").write_text("\n".join(json.dumps({"key": k, "ts": t, "opens": o}) for k, t, o in part) + "\n")
    (tmp_path / "z.json").write_text(json.dumps({"key": "zz", "ts": "2024-01-03 00:00:00", "opens": False}) + "\n")
    schema = "key string, ts timestamp, opens boolean"
    stream = logs.streamed_episodes(logs.json_stream(spark, str(tmp_path), schema), "key", "ts", F.col("opens"), "2 hours")
    got = {(r["key"], str(r["ts"])): r["episode"] for r in logs.drained(spark, stream, "episodes", rocksdb=True).collect()}
    batch = stores.episodes(spark.read.schema(schema).json(str(tmp_path)), "key", ["ts"], F.col("opens"))
    assert got == {(r["key"], str(r["ts"])): r["episode"] for r in batch.filter("key <> 'zz'").collect()}
