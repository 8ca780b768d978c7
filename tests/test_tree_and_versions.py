"""Trees of real files, and the mapping store's versions."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from veilspark.operators import run, versions
from veilspark.sources import files, tree


def texts(spark, rows):
    return spark.createDataFrame(rows, "new_file string, new_text string").repartition(3)


def found(top):
    return {str(p.relative_to(top)): p.read_bytes() for p in top.rglob("*") if p.is_file()}


def test_tree_of_texts_and_binaries(spark, tmp_path):
    out = tmp_path / "out"
    binary = spark.createDataFrame([("img/a.png", bytearray(b"\x89\xff\x00"))], "file string, content binary")
    tree.published(texts(spark, [("a/b.js", "é\n"), ("empty", ""), ("none", None)]), str(out), binary, str(tmp_path / "private"))
    assert found(out) == {"a/b.js": "é\n".encode(), "empty": b"", "none": b"", "img/a.png": b"\x89\xff\x00"}
    tree.published(texts(spark, [("c", "2"), ("c", "2")]), str(out))  # rows alike are one file
    assert found(out) == {"c": b"2"} and [p.name for p in tmp_path.iterdir()] == ["out"]
    back = {r["file"]: (r["text"], r["is_binary"]) for r in files.text_files(spark, str(out)).collect()}
    assert back == {"c": ("2", False)}
    tree.published(texts(spark, []), str(out))
    assert out.is_dir() and found(out) == {}


@pytest.mark.parametrize("bad", ["../x", "/etc/x", "", None, "a/../../x"])
def test_a_failed_job_leaves_the_old_tree(spark, tmp_path, bad):
    out = tmp_path / "out"
    tree.published(texts(spark, [("a", "1")]), str(out))
    with pytest.raises(Exception, match="no path of a file"):
        tree.published(texts(spark, [(f"n{i}", "2") for i in range(20)] + [(bad, "x")]), str(out))
    assert found(tmp_path) == {"out/a": b"1"}


def test_two_files_of_one_path_and_guards(spark, tmp_path):
    out = tmp_path / "out"
    tree.published(texts(spark, [("a", "1")]), str(out))
    with pytest.raises(Exception, match="two files of one path"):
        tree.published(texts(spark, [("x", "1"), ("x", "2")]), str(out))
    with pytest.raises(Exception, match="lies inside"):
        tree.published(texts(spark, [("a", "3")]), str(out), private=str(out / "keys"))
    with pytest.raises(Exception, match="lies inside"):  # by way of a link
        (tmp_path / "link").symlink_to(out)
        tree.published(texts(spark, [("a", "3")]), str(out), private=str(tmp_path / "link" / "keys"))
    assert found(out) == {"a": b"1"}


def test_compile_run_publishes_files(spark, tmp_path):
    entity = [("v", "Acme", "vendor", "internal", "semantic_alias", "vendor-a", "seed", "literal:acme")]
    from veilspark.plans.catalogue import configured

    rows = configured(spark, *[", ".join(f"'{x}'" for x in e) for e in entity])
    corpus = spark.createDataFrame([("src/acme.md", "Acme here"), ("b.md", "none")], "file string, text string")
    binary = spark.createDataFrame([("img/acme.png", bytearray(b"\xff\x00"))], "file string, content binary")
    run.compile_run(corpus, rows, str(tmp_path / "out"), binaries=binary, as_files=True)
    got = found(tmp_path / "out")
    assert set(got) == {"src/vendor-a.md", "b.md", "img/vendor-a.png"} and got["img/vendor-a.png"] == b"\xff\x00" and b"Acme" not in got["src/vendor-a.md"]


def test_of_two_writers_one_fails(spark, tmp_path):
    store = str(tmp_path / "store")
    row = lambda *r: spark.createDataFrame(list(r), "k string, alias string")
    assert versions.current(spark, store) == 0 and versions.commit(row(("a", "x-a")), store, 0) == 1
    pinned = versions.read(spark, store, 1)
    assert versions.commit(row(("a", "x-a"), ("b", "x-b")), store, 1) == 2
    with pytest.raises(versions.Conflict):
        versions.commit(row(("c", "x-b")), store, 1)
    assert pinned.count() == 1 and versions.read(spark, store).count() == 2 and len(list((tmp_path / "store" / "data").iterdir())) == 2
    with ThreadPoolExecutor(4) as pool:  # both saw version 2
        done = list(pool.map(lambda i: _attempt(row((f"t{i}", "x-c")), store), range(4)))
    assert sorted(done) == [False, False, False, True] and versions.current(spark, store) == 3


def _attempt(rows, store):
    try:
        versions.commit(rows, store, 2)
    except versions.Conflict:
        return False
    return True


def test_aliases_of_writers_at_once_differ(spark, tmp_path):
    store = str(tmp_path / "store")
    batches = [spark.createDataFrame([(f"k{i}{j}", "vendor") for j in range(3)] + [("shared", "vendor")], "k string, p string") for i in range(3)]
    with ThreadPoolExecutor(3) as pool:
        assert sorted(pool.map(lambda b: versions.allocated(store, b, "k", "p", "k"), batches)) == [1, 2, 3]
    got = [r["alias"] for r in versions.read(spark, store).collect()]
    assert sorted(got) == [f"vendor-{x}" for x in "abcdefghij"]


def test_frozen_values_make_no_version(spark, tmp_path):
    store = str(tmp_path / "store")
    versions.commit(spark.createDataFrame([("a", "x", True), ("b", "y", False)], "k string, v string, frozen boolean"), store, 0)
    new = lambda *r: spark.createDataFrame(list(r), "k string, v string")
    with pytest.raises(Exception, match="frozen"):
        versions.upserted(store, new(("a", "z")), "k", "v", "frozen")
    assert versions.current(spark, store) == 1
    assert versions.upserted(store, new(("b", "z"), ("c", "w")), "k", "v", "frozen") == 2
    assert {tuple(r) for r in versions.read(spark, store).select("k", "v", "frozen").collect()} == {("a", "x", True), ("b", "z", False), ("c", "w", False)}


def test_tree_is_listed_by_tasks_and_read_whole(spark, tmp_path, monkeypatch):
    """Names with a dot or an underscore count; skipped folders don't, at any depth; a part of some bytes ends within a batch."""
    monkeypatch.setattr(files, "READ_AT_ONCE", 4)
    want = {"a.txt": b"1", ".env": b"k=v", "_x/y.md": b"2", "d/e/f/g.txt": b"", "d/e/.h": b"\xff\x00", "d/lib.txt": b"long enough"}
    for name, content in [*want.items(), ("d/.git/c", b""), ("node_modules/x/y", b"3")]:
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_bytes(content)
    (tmp_path / "t" / "none").mkdir()
    for root in (f"{tmp_path}/t", f"file://{tmp_path}/t"):
        rows = files.text_files(spark, root)
        assert {r["file"]: (r["text"], r["is_binary"]) for r in rows.collect()} == {n: (None, True) if b"\xff" in c else (c.decode(), False) for n, c in want.items()}
        assert not any(n.endswith("a.txt") for n in rows.inputFiles())  # the driver lists names of no file of the tree
