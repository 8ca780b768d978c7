"""The lexer, its nodes as rows, and what flows where."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilspark.functions import lexer
from veilspark.operators import graph, rules, source
from veilspark.sources import files


def kinds(code, hcl=False):
    got = list(lexer.nodes(code, hcl))
    assert "".join(p.text for p in got) == code and all(code[p.start :].startswith(p.text) for p in got)
    return [(p.kind, p.text) for p in got if p.kind != "other"]


def test_code_in_templates_is_code():
    code = "t = `a ${f(`b ${c + `d ${ {e: acme} }`} g`)} h`; q"
    strings = [("string", s) for s in ("a ", "b ", "d ", " g", " h")]
    got = kinds(code)
    assert [n for n in got if n[0] == "string"] == strings
    assert [n[1] for n in got if n[0] == "identifier"] == ["t", "f", "c", "e", "acme", "q"]


def test_patterns_and_divisions():
    assert [n[1] for n in kinds("""a = /['"`]/.test(x) ? 'y' : b / c / d; if (x) /acme'/.exec(z); return /a[/'"]b/g""") if n[0] == "string"] == ["y"]
    assert kinds("x = (a) / b / 'c'")[-1] == ("string", "c") and kinds("x = {} / 2 / 'c'")[-1] == ("string", "c") and kinds("i++ / 2 / 'c'")[-1] == ("string", "c")
    assert kinds("f() { } /it's/.test(y)")[-1] == ("identifier", "y") and kinds("o.return / 2 / 'c'")[-1] == ("string", "c")
    assert [n[1] for n in kinds("<p>{a}</p><i/>b") if n[0] == "identifier"] == ["p", "a", "p", "i", "b"]


def test_specifiers_strings_and_comments():
    code = "import x from '@p/q'; require('r'); jest.mock(\"m\", 'n'); import('./s'); export {a} from \"b\"; o.require('z'); require(`t`)"
    assert [n[1] for n in kinds(code) if n[0] == "specifier"] == ["'@p/q'", "'r'", '"m"', "'./s'", '"b"', "t"]
    assert kinds("'a\\nAcme\\u0041b' // c\n/* open") == [("string", "a"), ("string", "Acme"), ("string", "b"), ("comment", "// c"), ("comment", "/* open")]
    assert kinds("#!/bin/node\nit's") == [("comment", "#!/bin/node"), ("identifier", "it"), ("identifier", "s")]
    assert kinds("") == [] and kinds("`open ${ a") == [("string", "open "), ("identifier", "a")]


def test_hcl():
    code = 'name = "${var.acme_host}-x $${no} ${lookup(m, "k${z}")}" # c\nx = <<-EOT\n  text ${acme-id} more\n  EOT\ny = 1'
    got = kinds(code, hcl=True)
    assert [n[1] for n in got if n[0] == "string"] == ["-x $${no} ", "k", "  text ", " more\n"]
    assert [n[1] for n in got if n[0] == "identifier"] == ["name", "var", "acme_host", "lookup", "m", "z", "x", "acme-id", "y"] and ("comment", "# c") in got


def test_nothing_is_lost_of_any_text():
    draw = random.Random(7)
    bits = ["'", '"', "`", "${", "}", "{", "(", ")", "/", "*/", "/*", "//", "\\", "\n", "a", "return", " ", "é", "𝔘", "1e-5", "<<E\n", "E", "$", "#", "%{", "[", "]"]
    for _ in range(3000):
        text = "".join(draw.choice(bits) for _ in range(draw.randrange(30)))
        for hcl in (False, True):
            assert "".join(p.text for p in lexer.nodes(text, hcl)) == text
        lexer.Flow(text)


@pytest.mark.parametrize("bit", ["'\\'", "/\\/", "`${", "(", "}", "/*", "<<EOT\n", '"${', "x = ", "let a:", "f(", "a=["])
def test_long_texts_in_linear_time(bit):
    begun = time.monotonic()
    text = bit * 40_000
    assert "".join(p.text for p in lexer.nodes(text)) == text and "".join(p.text for p in lexer.nodes(text, True)) == text
    lexer.Flow(text)
    assert time.monotonic() - begun < 20  # quadratic work takes minutes


FLOWS = {
    "cfg.host = process.env.DB_HOST": {("env:DB_HOST", "member:cfg.host", "env"), ("process", "member:cfg.host", "expr"), ("member:cfg.host", "cfg", "member-of")},
    "const { A: b, c = 3, d: { e } } = require('pkg')": {("str:pkg", "b", "require"), ("str:pkg", "c", "require"), ("str:pkg", "e", "require")},
    "x = await f(k.id, {key: val, 'q': g(h)})": {("f", "x", "call-result"), ("k", "x", "call-result"), ("val", "x", "call-result"), ("g", "x", "call-result"), ("h", "x", "call-result"), ("str:q", "x", "literal"),
        ("k", "f", "arg"), ("val", "f", "arg"), ("g", "f", "arg"), ("h", "f", "arg"), ("str:q", "f", "arg"), ("h", "g", "arg")},
    "module.exports = { run, go: stop }": {("run", "member:module.exports", "expr"), ("stop", "member:module.exports", "expr"), ("member:module.exports", "module", "member-of"), ("run", "export:run", "export"), ("stop", "export:stop", "export")},
    "exports.k = z": {("z", "member:exports.k", "alias"), ("member:exports.k", "exports", "member-of"), ("z", "export:z", "export")},
    "const z: Map<X> = y, w = v\nlet q\nr = s": {("y", "z", "alias"), ("v", "w", "alias"), ("s", "r", "alias")},
    "const f = (p) => { a = p }; t = `u ${v} w`": {("p", "a", "alias"), ("str:u ", "t", "literal"), ("v", "t", "expr"), ("str: w", "t", "literal")},
    "a = b = c; ({ d } = e); n = new K(m); o = p ? q : 'r'": {("b", "a", "alias"), ("c", "b", "alias"), ("e", "d", "alias"), ("K", "n", "construct"), ("m", "K", "arg"), ("p", "o", "expr"), ("q", "o", "expr"), ("str:r", "o", "literal")},
}


def test_flow(spark):
    rows = spark.createDataFrame([(k,) for k in FLOWS] + [("",), (None,)], "code string").select("code", source.edges(F.col("code")).alias("e"))
    got = {r["code"]: r["e"] if r["e"] is None else {tuple(e) for e in r["e"]} for r in rows.collect()}
    assert got == FLOWS | {"": set(), None: None}


def test_plain_lines_are_read_by_columns_as_by_the_lexer():
    rng = random.Random(11)
    word = lambda: rng.choice(["a", "b", "m", "$x", "_", "process", "env", "m1", "inn", "process_", "in", "this", "module", "exports", "require"])
    dotted = lambda: ".".join(rng.choice([["a"], ["m"], ["process"], [word()]])[:1] + [word() for _ in range(rng.choice([0, 0, 1, 2, 3]))])
    odd = ["", "(a)", "a == b", "a = b;", "const a: T", "é = a", "a = 1", "a  = b", "a = b = c", "a. = b", ".a = b", "a = b\r", "x.module.exports = a", "a = b.process.env.c"]
    line = lambda: rng.choice(odd) if rng.random() < 0.03 else f"{dotted()} = {rng.choice([dotted(), 'process.env.' + dotted()])}"
    texts = [rng.choice([None, ""]) if rng.random() < 0.02 else "\n".join(line() for _ in range(rng.randint(1, 5))) + rng.choice(["", "", "", "\n"]) for _ in range(6000)]
    want = [None if t is None else [dict(zip(("src", "dst", "kind"), row, strict=True)) for row in lexer.Flow(t).found] for t in texts]
    got = [x for i in range(0, len(texts), 50) for x in source.flows(pa.array(texts[i : i + 50], pa.string())).to_pylist()]
    assert got == want and sum(map(len, filter(None, got))) > 10_000


def test_plain_lines_cost_no_token_each(spark):
    """A megabyte of documents was some seven seconds of the lexer."""
    rows = spark.range(8).select(F.concat_ws("\n", F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda i: F.concat(F.lit("m.w"), i, F.lit(" = process.env.w"), i))).alias("t")).repartition(1).cache()
    code = rows.first()["t"]
    began = time.monotonic()
    lexer.Flow(code)
    once = time.monotonic() - began
    spark.range(1).select(source.edges(F.lit("a = b"))).collect()
    began = time.monotonic()
    assert rows.select(F.size(source.edges(F.col("t"))).alias("n")).agg(F.sum("n")).first()[0] == 8 * 3 * 40_000
    assert time.monotonic() - began < 4 * once


def test_taint_over_members_and_surroundings(spark):
    code = spark.createDataFrame([("cfg.host = process.env.DB_HOST\nconst { host: h } = cfg; url = h",)], "text string")
    flow = code.select(F.explode(source.edges(F.col("text"))).alias("e")).select("e.src", "e.dst")
    got = {r["node"]: r["hops"] for r in graph.taint(flow, spark.createDataFrame([("env:DB_HOST", 0.9)], "node string, score double")).collect()}
    assert got == {"env:DB_HOST": 0, "member:cfg.host": 1, "cfg": 2, "h": 3}


def test_rows_of_nodes_and_files(spark):
    rows = [("a.js", "x = `${acme} 𝔘` // é"), ("b.tf", 'n = "${acme}"'), ("c.md", "acme"), ("d.ts", ""), ("e.js", None)]
    corpus = spark.createDataFrame(rows, "file string, text string")
    got = source.node_rows(corpus, files.language(F.col("file"))).orderBy("file", "node_ord").collect()
    texts = dict(rows)
    assert {r["file"] for r in got} == {"a.js", "b.tf"} and all(texts[r["file"]][r["start"] : r["end"]] == r["text"] for r in got)
    assert ("identifier", "acme") in {(r["kind"], r["text"]) for r in got if r["file"] == "b.tf"}
    whole = corpus.select("file", source.file_nodes(F.col("file"), files.language(F.col("file")), F.col("text")).alias("n"))
    assert {r["file"]: r["t"] for r in whole.select("file", F.array_join(F.transform("n", lambda n: n["text"]), "").alias("t")).collect()} == texts


def test_rows_over_several_blocks(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(source, "ROWS_HELD", 3)
    texts = pa.array(["a b c d e", None, "", "f", "'g' h"])
    got = source.rows_of(texts, lexer.nodes, ["kind", "text", "start"], [pa.string(), pa.string(), pa.int32()]).to_pylist()
    assert [None if x is None else "".join(r["text"] for r in x) for x in got] == texts.to_pylist()


def test_workers_answer_in_parts_of_bounded_size(spark):
    """Batches of 10,000 texts once gave all their rows at a time."""
    texts = pa.array(["a = 'b'; " * 20_000, None, "x"] * 12)
    out = list(source.rows_by_parts(iter([texts, texts[:0]]), lambda t: [(t[:1],)], ["k"], [pa.string()]))
    assert len(out) == 4 and [len(x) for x in out][-1] == 0 and sum(map(len, out)) == 36 and max(len(x) for x in out) < 20
    assert pa.concat_arrays(out).to_pylist()[:3] == [[{"k": "a"}], None, [{"k": "x"}]]
    frame = spark.createDataFrame([(i, None if i % 7 == 0 else "a = 'b'; " * (i % 5) * 9000) for i in range(40)], "i int, t string").repartition(1)
    got = frame.select("i", "t", F.array_join(F.transform(source.nodes(F.col("t")), lambda n: n["text"]), "").alias("again")).collect()
    assert len(got) == 40 and all(r["t"] == r["again"] for r in got)
