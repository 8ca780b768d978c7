"""Every stage and run() as a whole against plain Python models of what they say, with odd rows in every stage."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from veilspark.llm import language_id
from veilspark.llm.common import scratch, written

WORDS = {
    "en": "the of and to in water river stone bridge light over under north garden letter window paper cloud silver".split(),
    "fr": "le la les des une dans pour avec sur maison fleuve pierre jardin lettre papier nuage argent pont monde".split(),
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = np.random.default_rng(11)
    text = lambda lang, n: " ".join(rng.choice(WORDS[lang], n)) + "."
    rows = [(i, text("en" if i % 2 else "fr", int(rng.integers(80, 160))), "en" if i % 2 else "fr") for i in range(40)]
    passage = text("en", 70)
    rows += [(100 + i, f"{text('fr', 30)} {passage} {text('en', 30)}", "en") for i in range(5)]
    rows += [(50, rows[3][1], "en"), (51, rows[3][1].replace(" ", "  "), None), (52, rows[4][1] + " fin", "fr"), (60, None, "en"), (61, "", None), (62, "12 34", "en")]
    return [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in [*rows, rows[5], (None, "a row that has no id at all", "en"), (3, text("fr", 90), "fr")]]


def near(rows):
    """One row of each group of linked fingerprints."""
    def fingerprint(t):
        w = re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t).strip(" \t\n\x0b\f\r"))
        w = [x for x in w if x]
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fingerprint(r[1] or "") for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                if bin(prints[a] ^ prints[b]).count("1") <= 3:
                    group[a] = group[b] = min(group[a], group[b])
    return group


def without_repeats(rows):
    raw = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    out = []
    for r, t in zip(rows, raw):
        flag = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                flag[i : i + 200] = True
        kept = np.frombuffer(t, dtype=np.uint8)[~flag].tobytes().decode()  # no character lies across an edge here
        out.append((r[0], None if r[1] is None else kept, *r[2:4], len(kept)))
    return out


def model(rows):
    """What the first four stages leave; languages are told apart by the operator itself, held to direct escapes elsewhere."""
    stay = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    order = lambda r: (r[0] is None, r[0])
    first = {}
    for r in sorted(stay, key=order):
        first.setdefault(norm(r[1]), r)
    stay = list(first.values())
    best = {}
    for r, g in sorted(zip(stay, near(stay)), key=lambda x: order(x[0])):
        best.setdefault(g, r)
    return without_repeats(list(best.values()))


def packed_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids + [0]


def test_run_against_a_model(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = model(rows)
    assert len(want) < len(rows) - 6 and sum(len(r[1]) for r in want) < sum(len(r[1] or "") for r in rows) - 1000
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    expected = Counter()
    for r in want:
        ids = np.array(packed_ids(r[1]), dtype="<u4")
        for a in range(0, len(ids), 1024):
            part = ids[a : a + 1024]
            expected[(r[0], a, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    assert Counter((p["doc_id"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in pieces) == expected
    for s in {p["sequence_id"] for p in pieces}:
        inside = sorted((p["offset"], p["length"]) for p in pieces if p["sequence_id"] == s)
        assert sum(n for _, n in inside) <= 1024 and [a for a, _ in inside] == [sum(n for _, n in inside[:i]) for i in range(len(inside))]


def test_stages_leave_what_they_say(spark, tmp_path):
    """Columns stay in name, kind and order, whatever they are called; no clean row goes."""
    docs = spark.createDataFrame(corpus(), SCHEMA)
    for name in ("digest", "_digest", "first_id", "__score", "__lang_pred", "_print", "fp", "ranges", "_ranges", "id", "root"):
        docs = docs.withColumn(name, F.lit(7))
    alone = {r[0] for r in corpus()[6:40:2]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = written(stage(spark, docs, str(tmp_path)), "test-stage")
        assert left.schema.simpleString() == docs.schema.simpleString()
        ids = Counter(r["doc_id"] for r in left.select("doc_id").collect())
        assert not ids - Counter(r["doc_id"] for r in docs.select("doc_id").collect()) and alone <= set(ids)
        docs = left
    assert Counter((r["doc_id"], r["text"]) for r in docs.collect()) == Counter(r[:2] for r in model(corpus()))


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(1, "one text", "en", "s", 8)] * 2])
def test_stages_on_few_rows(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == (1 if rows and rows[0][1] else 0)


def test_rejected_language(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    named = language_id.identify(docs, language_id.train(docs), "pred", "sure")
    assert named.filter("pred = 'und'").count() == 3


def test_scratch_removes_what_is_not_kept(spark):
    with scratch(spark):
        gone, kept = written(spark.range(3), "gone"), written(spark.range(4), "kept", keep=True)
        assert gone.count() == 3
    files = [f.inputFiles()[0].rsplit("/", 1)[0] for f in (gone, kept)]
    assert kept.count() == 4 and files[0] != files[1]
    with pytest.raises(Exception):
        spark.read.parquet(files[0]).count()
