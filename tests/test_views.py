"""Small views where a registered query doesn't show the edge cases."""

import random
import re

from pyspark.sql import functions as F

from veilspark.operators import views
from veilspark.sources import files


def test_slugs_as_alias_by_alias(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("ab-") for _ in range(rng.randint(1, 4))).strip("-")
    pairs = [(word(), rng.choice(["Ab B", "a", "b--a", "X_y", ""])) for _ in range(30)] + [("", "Nothing"), ("ab", "first"), ("ab", "second")]
    slugs = ["-".join(word() or "a" for _ in range(rng.randint(1, 6))) for _ in range(300)] + ["", None]

    def decoded(slug):
        for ghost, real in sorted((p for p in pairs if p[0]), key=lambda p: -len(p[0])):
            slug = re.sub(rf"(?<![a-z0-9]){re.escape(ghost)}(?![a-z0-9])", re.sub("[^a-z0-9]+", "-", real.lower()).strip("-"), slug)
        return slug

    rows = spark.createDataFrame(list(enumerate(slugs)), "i int, s string")
    got = {r["i"]: r["o"] for r in rows.select("i", views.decoded_slug(F.col("s"), pairs).alias("o")).collect()}
    assert all(got[i] == (None if s is None else decoded(s)) for i, s in enumerate(slugs))


def test_body_lines(spark):
    texts = ["", "\n", "a", "a\n", "a\n\n", "\na\nb", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", views.body_lines(F.col("t")).alias("b")).collect()
    for r in rows:
        t = texts[r["i"]]
        if t is not None:
            end = "\n" if t.endswith("\n") else ""
            assert r["b"].lines == (t.split("\n")[:-1] if end else t.split("\n")) and r["b"].trailing == end
            assert "\n".join(r["b"].lines) + r["b"].trailing == t


def test_logs_with_nulls_and_no_marker(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "m"), ("a", 3, "x"), ("b", 1, "x"), (None, 1, "m"), (None, 2, None), ("a", 4, "x")], "k string, n int, e string")
    assert {(r.k, r.n) for r in views.newer_than_marker(log, ["k"], "n", F.col("e") == "m").collect()} == {("a", 3), ("a", 4), ("b", 1), (None, 2)}
    assert {(r.k, r.n) for r in views.latest_matching(log, ["k"], ["n"], e="x").collect()} == {("a", 4), ("b", 1)}
    assert [(r.k, r.n) for r in views.latest_matching(log, ["k"], ["n"], e=None).collect()] == [(None, 2)]
    assert views.latest_matching(log, ["k"], ["n"], e="none").count() == 0
    assert {(r.k, r.n) for r in views.log_subset(log, "k", "e", ["a"], ["x"]).collect()} == {("a", 2)}


def test_findings_in_order(spark):
    rows = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.9)], "surface string, score double")
    assert [r.surface for r in views.ordered_findings(rows).collect()] == ["c", "a", "b"]
    assert files.single(spark, "text").collect() == [("(stdin)", "text")]
