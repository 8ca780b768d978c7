"""The operators against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veilspark.llm import class_lm, exact_dedup, language_id, packing, quality_classifier, quality_rules, sharding, simhash, sp_sampling, suffix_dedup, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, word string"
WORDS = "the of and to in water river stone bridge light over under north garden letter window paper cloud silver".split()
MOTS = "le la les des une dans pour avec sur maison fleuve pierre jardin lettre papier nuage argent pont monde".split()


def corpus():
    rng = np.random.default_rng(3)
    text = lambda words, n: " ".join(rng.choice(words, n)) + "."
    rows = [(i, text(WORDS if i % 2 else MOTS, int(rng.integers(60, 160))), "en" if i % 2 else "fr") for i in range(60)]
    passage = text(WORDS, 60)
    rows += [(60 + i, f"{text(MOTS, 20)} {passage} {text(WORDS, 20 + i)}", "fr") for i in range(6)]
    rows += [(70, None, None), (71, "", "en"), (72, "  \n", "en"), (73, "12 34 %%", "en"), (74, rows[3][1], "en"), (75, rows[3][1].replace(" ", "  "), "en")]
    rows += [(76, text(WORDS, 30_000), "en"), (77, "x" * 5000, "en"), (78, "é▁ü  日本 <|endoftext|>", "fr"), (74, rows[3][1], "en")]
    rows += [(80, rows[5][1] + " tail", "en"), (None, "a row without an id", "en")]
    return [(i, t, lang, "s", None, 7, 0.5, "w") for i, t, lang in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return [(r[0], (r[1] or "")) for r in corpus()]


def test_sharding(docs, empty):
    got = sharding.shuffled_shards(docs, 8).toPandas()
    sizes = got.groupby("shard").size()
    assert sizes.sum() == len(corpus()) and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert sorted(zip(got["size"], got.text_crc32)) == sorted((len(t.encode()) + 1, zlib.crc32(t.encode())) for _, t in texts())
    assert sharding.shuffled_shards(empty, 8).count() == 0


def test_hypergeometric_law():
    rng = np.random.default_rng(0)
    draws = np.array([sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)])
    assert abs(draws.mean() - 6) < 0.15 and abs(draws.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.35
    assert abs(sharding.hypergeometric(rng, 10**11, 10**11, 10**10) - 5 * 10**9) < 10**6


def test_exact_dedup(spark, docs, empty):
    index = exact_dedup.DigestIndex(spark, "test_index", 4)
    got = index.decide(docs, "a").toPandas()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    groups = {}
    for i, t in texts():
        groups.setdefault(norm(t), []).append(i)
    want = Counter((i, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g)
    none = lambda v: None if v != v else int(v)
    assert Counter((none(r.doc_id), none(r.keep_id), r.group_size) for r in got.itertuples()) == want
    assert got.kept.sum() == len(groups)
    assert index.decide(docs, "a").toPandas().kept.sum() == len(groups)  # the same batch again, as after a failure
    assert index.decide(docs, "b").toPandas().kept.sum() == 0  # all known by now
    assert index.read().count() == len(groups) and index.decide(empty, "c").count() == 0
    twice = exact_dedup.DigestIndex(spark, "test_index_3", 4)
    both = exact_dedup.decided_in_batches(docs, twice).toPandas()
    twice.drop()
    assert Counter((none(r.doc_id), none(r.keep_id), r.group_size) for r in both.itertuples()) == want and both.kept.sum() == len(groups)
    assert exact_dedup.decided_in_batches(empty, exact_dedup.DigestIndex(spark, "test_index_4", 4)).count() == 0


def test_distinct_documents(spark, docs, empty):
    """Extra columns of any name are carried, and a job that failed after the append keeps its rows when run again."""
    odd = docs.withColumn("digest", F.lit(1)).withColumn("first_id", F.lit("x")).withColumn("_digest", F.lit(2)).withColumn("KEEP_ID", F.lit(3))
    index = exact_dedup.DigestIndex(spark, "test_index_2", 4)
    groups = {re.sub(r"[\x20\x09-\x0D]+", " ", t) for _, t in texts()}
    for _ in range(2):
        kept = exact_dedup.distinct_documents(odd, index, "first")
        assert kept.columns == odd.columns and kept.count() == len(groups)
    assert exact_dedup.distinct_documents(odd, index, "second").count() == 0
    assert exact_dedup.distinct_documents(empty, index, "third").count() == 0


def test_one_of_each(spark, docs, empty):
    """A row that only shares its doc_id with a near copy stays; of repeated rows one stays; extra columns are carried."""
    long = " ".join(WORDS * 4)
    rows = [(1, long), (2, long), (2, "a text of its own that nothing else is like"), (3, "another text"), (3, "another text"), (None, long), (None, "no id and nothing like it here"), (4, None), (5, "")]
    odd = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_print", F.lit(1)).withColumn("fp", F.lit(2)).withColumn("kept_id", F.lit(2))
    got = simhash.one_of_each(odd)
    left = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert got.columns == odd.columns
    assert left == Counter({(1, long): 1, (2, rows[2][1]): 1, (3, "another text"): 1, (None, rows[6][1]): 1, (4, None): 1})
    assert simhash.one_of_each(empty).count() == 0


def test_simhash(docs, empty):
    def fingerprint(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    ids, prints = [i for i, _ in texts()], [fingerprint(t) for _, t in texts()]
    comp = list(range(len(ids)))
    for _ in comp:
        for a in range(len(ids)):
            for b in range(a):
                if bin(prints[a] ^ prints[b]).count("1") <= 3:
                    comp[a] = comp[b] = min(comp[a], comp[b])
    least = {}
    for c, i in zip(comp, ids):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = Counter((i, f"{p:016x}", least.get(c)) for i, p, c in zip(ids, prints, comp))
    none = lambda v: None if v != v else int(v)
    got = simhash.near_groups(docs).toPandas()
    assert Counter((none(r.doc_id), r.fingerprint, none(r.component_id)) for r in got.itertuples()) == want
    assert simhash.near_groups(empty).count() == 0


def test_golay_keys_miss_nothing():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    (r1, o1, k1), (r2, o2, k2) = simhash.keys(x), simhash.keys(y)
    shared = set(zip(r1[o1 == 0], k1[o1 == 0])) & set(zip(r2[o2 == 1], k2[o2 == 1]))
    assert {r for r, _ in shared} == set(range(len(x)))


def removed_flags(raw):
    seen = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    out = []
    for t in raw:
        flag = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                flag[i : i + 200] = True
        out.append(flag)
    return out


@pytest.mark.parametrize("hot", [1000, 2])
def test_suffix_dedup(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", hot)
    raw = [t.encode() for _, t in texts()]
    want = Counter()
    for (i, _), t, f in zip(texts(), raw, removed_flags(raw)):
        kept = np.frombuffer(t, dtype=np.uint8)[~f].tobytes()
        want[(i, len(t), int(f.sum()), int((np.diff(np.concatenate([[0], f.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
    none = lambda v: None if v != v else int(v)
    got = suffix_dedup.removal_digests(docs).toPandas()
    assert Counter((none(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.itertuples()) == want
    assert suffix_dedup.removal_digests(empty).count() == 0
    assert suffix_dedup.without_repeats(docs).columns == docs.columns


@pytest.mark.parametrize("hot", [2, 9])
def test_common_passages_in_many_surroundings(spark, monkeypatch, hot):
    """Large collections are divided, at both ends of passages and at changes within, without losing a window."""
    monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", hot)
    rng = random.Random(3)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    passages = [word(n, "abcdef ") for n in (150, 190, 260, 420)]
    raw = []
    for i in range(60):
        p = passages[i % 4]
        p = p[: 90 + i] + "X" + p[91 + i :] if i % 7 == 0 else p
        raw.append(word(40 + i, "xy") + p + word(170, "uv" if i % 3 else "u") + passages[0])
    want = {i: (int(f.sum()), hashlib.sha256(np.frombuffer(t.encode(), dtype=np.uint8)[~f].tobytes()).hexdigest()) for i, (t, f) in enumerate(zip(raw, removed_flags([t.encode() for t in raw])))}
    got = suffix_dedup.removal_digests(spark.createDataFrame(list(enumerate(raw)), "doc_id long, text string")).toPandas()
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in got.itertuples()} == want
    assert sum(n for n, _ in want.values()) > 5000


def test_long_texts_are_hashed_in_parts(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 700)
    rng = np.random.default_rng(0)
    raw = [rng.integers(97, 123, 3000, dtype=np.uint8).tobytes(), b"short", b"y" * 250]
    met = {}
    for data, ends, rows, offsets in suffix_dedup.parts(raw):
        low, high, _, _ = suffix_dedup.anchors(data, ends)
        piece = np.searchsorted(ends, low, side="right")
        begins = np.concatenate([[0], ends[:-1]])
        for a, b, p in zip(low, high, piece):
            for w in range(a, b + 1):
                key = (int(rows[p]), int(w - begins[p] + offsets[p]))
                assert key not in met
                met[key] = 1
    assert set(met) == {(0, i) for i in range(2801)} | {(2, i) for i in range(51)}


def test_language_id(docs, empty):
    got = language_id.identify(docs.select("doc_id", "text"), language_id.train(docs.filter("doc_id % 3 != 0"))).toPandas().set_index("doc_id")
    assert all(got.loc[i].__getattr__("__lang_pred") == ("en" if i % 2 else "fr") for i in range(0, 60, 3))
    assert [got.loc[i]["__lang_pred"] for i in (70, 71, 72, 73)] == ["und"] * 4
    assert language_id.identify(docs, language_id.train(empty)).filter("__lang_pred = 'und'").count() == len(corpus())
    assert language_id.identify(empty, language_id.train(docs)).count() == 0


def test_language_id_code_lengths_against_direct_escapes(docs, monkeypatch):
    """The frozen costs of method C, followed context by context, with steps that cut texts."""
    monkeypatch.setattr(language_id, "STEP", 97)
    trained = [(t, lang) for _, t, lang, *_ in corpus()[:30]]
    model = language_id.train(docs.filter("doc_id < 30"))
    counts: dict = {}
    for t, lang in trained:
        data = b"\0\0\0" + t.encode()
        for i in range(3, len(data)):
            for order in range(4):
                counts.setdefault((lang, data[i - order : i]), Counter())[data[i]] += 1

    def bits(lang, context, byte):
        c = counts.get((lang, context))
        lower = 8.0 if not context else None
        if not c:
            return bits(lang, context[1:], byte) if context else lower
        total, kinds = sum(c.values()), len(c)
        if c[byte]:
            return -math.log2(c[byte] / (total + kinds))
        return -math.log2(kinds / (total + kinds)) + (bits(lang, context[1:], byte) if context else lower)

    raw = [t.encode() for _, t in texts() if t][:12] + ["é▁ü zürich".encode(), b"x" * 300]
    got = language_id.code_lengths(raw, model)
    for text, row in zip(raw, got):
        data = b"\0\0\0" + text
        for lang, value in zip(model["langs"], row):
            assert abs(sum(bits(lang, data[i - 3 : i], data[i]) for i in range(3, len(data))) - value) < 1e-6 * max(1, value)


def test_language_id_learns_from_a_sample_bounded_in_bytes(spark, monkeypatch):
    rows = [(i, "abcd" * 25, "a") for i in range(400)] + [(1000, "long" * 5000, "a"), (1001, "wxyz" * 5000, "b"), (1002, "efgh", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taught = []
    monkeypatch.setattr(language_id, "context_trees", lambda counted, langs: taught.append((counted.groupby("lang")["n"].sum().to_dict(), langs)))
    monkeypatch.setattr(language_id, "TEXT_BYTES", 10_000)
    language_id.train(docs)
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 4_000)
    language_id.train(docs)
    (by_rows, langs), (by_bytes, _) = taught
    assert langs == ["a", "c"]  # the only text of b is too long
    assert 20_000 < by_rows["a"] < 40_000 and 2_000 < by_bytes["a"] < 7_000 and by_rows["c"] == by_bytes["c"] == 4


def test_language_id_ties_go_to_the_first_language(spark):
    rows = [(1, "abc abc abc", "zz"), (2, "abc abc abc", "aa"), (3, "abc", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["__lang_pred"], r["__score"]) for r in language_id.identify(docs, language_id.train(docs)).collect()}
    assert got[3] == ("aa", 0.5)


def test_quality_classifier(spark, docs, empty):
    rng = np.random.default_rng(9)
    good = [(100 + i, " ".join(rng.choice(WORDS, 80))) for i in range(60)]
    bad = [(200 + i, " ".join(f"{w.upper()}!!" for w in rng.choice(WORDS, 80))) for i in range(60)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad], "doc_id long, quality int")
    got = quality_classifier.quality_scores(rows, labels).toPandas()
    assert (got.predicted == (got.doc_id < 200)).mean() > 0.95 and got.score.between(0, 1).all()
    # the trained path on null, empty and long texts, repeated rows and columns with clashing names
    odd = rows.select("doc_id", "text").unionByName(docs.select("doc_id", "text")).withColumn("y", F.lit(1)).withColumn("before", F.lit(2)).withColumn("score", F.lit(3.0))
    mixed = quality_classifier.quality_scores(odd, labels.unionByName(spark.createDataFrame([(100, 0), (101, None), (None, 1)], "doc_id long, quality int"))).toPandas()
    assert len(mixed) == 120 + len(corpus()) and mixed.score.between(0, 1).all() and mixed[mixed.doc_id == 74].score.nunique() == 1
    assert mixed[mixed.doc_id == 70].score.tolist() == mixed[mixed.doc_id == 71].score.tolist()
    none = quality_classifier.quality_scores(docs, labels.limit(0)).toPandas()
    assert (none.score == 0.5).all() and quality_classifier.quality_scores(empty, labels).count() == 0


def test_quality_scores_are_those_of_the_normalised_differences():
    """Recomputed from compressed sizes, without the operator's classes."""
    import zstandard

    rng = random.Random(2)
    good = [" ".join(rng.choices(WORDS, k=90)).encode() for _ in range(80)]
    bad = [" ".join(w.upper() + "#" for w in rng.choices(WORDS, k=90)).encode() for _ in range(80)]
    model = quality_classifier.fit({0: bad, 1: good})
    text = good[1][:200] + bad[1][:100]
    f = []
    for pair in model["pairs"]:
        sizes = [len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_dict_id=False).compress(text)) for raw in pair]
        f.append((sizes[0] - sizes[1]) / sum(sizes))
    assert np.allclose(quality_classifier.Compressors(model["pairs"]).differences(text), f, atol=2e-2)
    z = quality_classifier.expanded(np.array([quality_classifier.Compressors(model["pairs"]).differences(t) for t in (good[3], bad[3])]), model["mean"], model["scale"])
    assert z.shape[1] == len(model["weights"]) and (z @ model["weights"])[0] > 0 > (z @ model["weights"])[1]


def test_quality_rules(spark, docs, empty):
    trusted = docs.filter("lang = 'en'").select("doc_id")
    got = quality_rules.judged(docs, trusted).toPandas()
    want = Counter()
    for i, t in texts():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        c = Counter(tri)
        cover = {j + k for j, x in enumerate(tri) if c[x] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\f\r")]
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w))] += 1
    none = lambda v: None if v != v else int(v)
    assert Counter((none(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.itertuples()) == want
    assert not got[got.base_failed].kept.any() and quality_rules.judged(empty, trusted).count() == 0


def test_quality_rules_ratio_and_lines(spark, monkeypatch):
    """The verdict recomputed by exact n-grams hashed with Spark's own function; lines met again; a tie with the threshold is kept."""
    rng = random.Random(8)
    line = lambda words: " ".join(rng.choices(words, k=30))
    rows = [(i, "\n".join([line(WORDS if i % 2 else MOTS) for _ in range(3)] + ["", " \t", line(WORDS)] * 2)) for i in range(30)]
    again = line(WORDS)
    rows += [(40, f"{again}\n{again}\n\n{line(MOTS)}\n{again}"), (41, None), (42, again)]
    trusted = {i for i, _ in rows if i % 2} | {99}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("target", F.lit("x")).withColumn("w", F.lit(1))
    got = {r["doc_id"]: r for r in quality_rules.judged(docs, spark.createDataFrame([(i,) for i in trusted] * 2, "doc_id long")).collect()}
    grams = {i: [(x,) for x in (t or "").split()] + list(zip((t or "").split(), (t or "").split()[1:])) for i, t in rows}
    every = sorted({g for gs in grams.values() for g in gs})
    hashed = spark.createDataFrame([(n, g[0], g[-1], len(g)) for n, g in enumerate(every)], "n int, a string, b string, k int")
    hashed = hashed.select("n", F.pmod(F.when(F.col("k") == 1, F.xxhash64("a")).otherwise(F.xxhash64("a", "b")), F.lit(quality_rules.BUCKETS)).alias("h")).toPandas()
    bucket = {every[n]: h for n, h in zip(hashed.n, hashed.h)}
    raw, target = Counter(), Counter()
    for i, gs in grams.items():
        raw.update(bucket[g] for g in gs)
        if i in trusted:
            target.update(bucket[g] for g in gs)
    r, t = sum(raw.values()) + quality_rules.BUCKETS, sum(target.values()) + quality_rules.BUCKETS
    for i, text in rows:
        mean = sum(math.log((target[bucket[g]] + 1) / t) - math.log((raw[bucket[g]] + 1) / r) for g in grams[i]) / max(1, len(grams[i]))
        assert abs(got[i]["mean_ratio"] - mean) < 1e-9 and got[i]["kept"] == (not got[i]["base_failed"] and got[i]["mean_ratio"] >= quality_rules.THRESHOLD)
        full = [x for x in (text or "").split("\n") if x.strip()]
        assert got[i]["n_dup_lines"] == len(full) - len(set(full))
    assert got[40]["n_dup_lines"] == 2 and len({x["kept"] for x in got.values()}) == 2
    tie = quality_rules.judged(docs, spark.createDataFrame([(1,)], "doc_id long"), threshold=got[1]["mean_ratio"])
    assert tie.filter("doc_id = 1").count() == 1


def test_shards_are_placed_evenly():
    """Over many seeds every row meets every shard and slot about as often."""
    met = np.zeros((6, 2, 3), dtype=int)
    rng = np.random.default_rng(0)
    for seed in range(3000):
        matrix = sharding.communication_matrix([2, 3, 1], [3, 3], seed)
        assert matrix.sum(axis=0).tolist() == [3, 3] and matrix.sum(axis=1).tolist() == [2, 3, 1]
        taken: list[list[int]] = [[], []]
        for p, rows in enumerate(([0, 1], [2, 3, 4], [5])):
            rows = rng.permutation(rows)
            for t in (0, 1):
                taken[t] += rows[sum(matrix[p, :t]) : sum(matrix[p, : t + 1])].tolist()
        for t, rows in enumerate(taken):
            for slot, row in enumerate(rng.permutation(rows)):
                met[row, t, slot] += 1
    assert abs(met - 500).max() < 100


def test_class_lm(docs, empty, monkeypatch):
    monkeypatch.setattr(class_lm, "KNOWN", 20)
    marked = docs.withColumn("held_out", F.coalesce(F.col("doc_id") % 7 == 2, F.lit(False)))
    got = class_lm.scores(marked.select("doc_id", "text", "held_out"), *class_lm.fit(marked.filter("not held_out"))).toPandas()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [(i, [w for w in re.split(r"[\x20\x09-\x0D]+", t.translate(low)) if w] + [None]) for i, t in texts()]
    c = Counter(w for i, ws in tokens if i is None or i % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for _, ws in tokens)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got.itertuples()) == want
    assert (got.train_tokens == n).all() and got.score.sum() > got.base_score.sum()
    assert class_lm.scores(empty.withColumn("held_out", F.lit(True)), *class_lm.fit(empty)).count() == 0
    once = class_lm.fitted_scores(marked.select("doc_id", "text", "held_out")).toPandas()
    assert np.allclose(sorted(once.score), sorted(got.score)) and np.allclose(sorted(once.base_score), sorted(got.base_score))


def test_class_lm_classes_cover_all_training_words(docs, monkeypatch):
    monkeypatch.setattr(class_lm, "KNOWN", 20)
    marked = docs.withColumn("held_out", F.coalesce(F.col("doc_id") % 7 == 2, F.lit(False)))
    model, rare = class_lm.fit(marked.filter("not held_out"))
    got = class_lm.scores(marked.select("doc_id", "text", "held_out"), model, rare).toPandas()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    lines = [(i, [w.encode() for w in re.split(r"[\x20\x09-\x0D]+", t.translate(low)) if w] + [None]) for i, t in texts()]
    trained = [ws for i, ws in lines if i is None or i % 7 != 2]
    c = Counter(w for ws in trained for w in ws)
    kind = dict(zip(model["words"], model["classes"].tolist())) | {r["word"]: r["class"] for r in rare.toPandas().to_dict("records")} | {None: class_lm.CLASSES}
    assert set(kind) == set(c) and len(kind) > len(model["words"]) + 1
    of = lambda w: kind[w] if w in kind else model["classes"][len(model["words"]) + 1 + zlib.crc32(w[-2:]) % class_lm.ENDINGS]
    grid, mass, size = np.zeros((class_lm.SIZE, class_lm.SIZE)), (np.arange(class_lm.SIZE) < class_lm.CLASSES).astype(float), class_lm.SIZE
    for ws in trained:
        for a, b in zip([None, *ws], ws):
            grid[of(a), of(b)] += 1
    for w, times in c.items():
        mass[of(w)] += times + 1
    share = (grid.sum(axis=0) + 1) / (grid.sum() + size)
    move = (grid + class_lm.SMOOTHING * share) / (grid.sum(axis=1, keepdims=True) + class_lm.SMOOTHING)
    cost = lambda a, b: math.log10((c[b] + 1) * (class_lm.LAMBDA * move[of(a), of(b)] / mass[of(b)] + (1 - class_lm.LAMBDA) / (sum(c.values()) + len(c) + class_lm.CLASSES)))
    for before in (None, *list(c)[:5]):  # over all words, the end and an unknown for each class P sums to one
        unknown = sum(class_lm.LAMBDA * move[of(before), k] / mass[k] + (1 - class_lm.LAMBDA) / (sum(c.values()) + len(c) + class_lm.CLASSES) for k in range(class_lm.CLASSES))
        assert abs(sum(10 ** cost(before, w) for w in c) + unknown - 1) < 1e-9
    want = sorted(round(sum(cost(a, b) for a, b in zip([None, *ws], ws)), 5) for _, ws in lines)
    assert np.allclose(sorted(got.score), want, atol=1e-4)


@pytest.mark.parametrize("known", [8, 200_000])
def test_class_lm_tells_words_of_one_ending_apart(spark, monkeypatch, known):
    """Rare words that end alike take the class of their neighbours, known or not."""
    monkeypatch.setattr(class_lm, "KNOWN", known)
    rows = [(f"red q{i}ing blue",) for i in range(12)] * 9 + [(f"z{i}ing la",) for i in range(12)] * 9 + [("red sun blue",), ("moon la",)] * 300
    rows += [(f"word{i}x",) for i in range(1200)] * 10  # with these, the words in question are no seeds
    model, rare = class_lm.fit(spark.createDataFrame(rows, "text string"))
    kind = dict(zip(model["words"], model["classes"].tolist())) | {r["word"]: r["class"] for r in rare.toPandas().to_dict("records")}
    q, z = ({k for w, k in kind.items() if w.startswith(x) and w.endswith(b"ing")} for x in (b"q", b"z"))
    assert len([w for w in kind if w.endswith(b"ing")]) == 24 and not q & z


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.packed(docs).toPandas()
    ids = {i: e.ids + [0] for (i, _), e in zip(texts(), reader.encode_batch([t for _, t in texts()], add_special_tokens=False))}
    for r in got[got.doc_id.notna()].itertuples():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, dtype="<u4").tobytes()) == r.ids_crc32 and len(ids[r.doc_id]) == r.doc_tokens
    assert got.length.sum() == sum(len(e) for e in ids.values()) + len(ids[74])  # row 74 comes twice
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist() and s.length.sum() <= 1024
    assert packing.packed(empty).count() == 0
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 1024) + 2  # a class holds up to 7 tokens more than a piece
    assert 50256 in ids[78]  # the special token's string is one id


@pytest.mark.parametrize("text", ["<|endoftext|>", "a <|endoftext|><|endoftext|>b  <|endoftext|> c", "<|endoftext|", "x  <|endoftext|>\n\n y", " <|endoftext|> "])
def test_special_token_strings_are_cut_as_tokenizers_does(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mine = tokens.ids_with_special(tokens.byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), text)
    assert mine == reader.encode(text, add_special_tokens=False).ids


def test_patterns_cover_the_demand():
    demand = {3: 50, 20: 33, 60: 21, 65: 20, 128: 4}
    used = Counter()
    for pattern, times in packing.patterns(demand):
        assert sum(s * n for s, n in pattern.items()) <= 128
        used.update({s: n * times for s, n in pattern.items()})
    assert used == demand


def test_sampled_segmentations(docs, empty):
    a = sp_sampling.sampled_segmentations(docs, with_ids=True).toPandas()
    b = sp_sampling.sampled_segmentations(docs.repartition(2, "text")).toPandas()
    assert a.lossless.all() and sorted(a.ids_crc32) == sorted(b.ids_crc32)
    assert sp_sampling.sampled_segmentations(empty).count() == 0


def test_sampling_follows_the_lattice():
    import public_tokenizers

    v = sp_sampling.vocabulary(public_tokenizers.path("piece_bpe_32k.model"), 1.0)
    ids, sizes = sp_sampling.sample(v, [b"the"] * 20_000, np.arange(20_000), 1)
    found = Counter(tuple(x) for x in np.split(ids, np.cumsum(sizes)[:-1]))
    weights = {p: math.prod(v.weight[i] for i in p) for p in found}
    total = sum(weights.values())
    assert all(abs(n / 20_000 - weights[p] / total) < 0.015 for p, n in found.items())


def test_forward_pass_against_direct_sums():
    import public_tokenizers

    v = sp_sampling.vocabulary(public_tokenizers.path("piece_bpe_32k.model"), 1.0)
    letters = random.Random(4).choices("abcdeinorst", k=2500)
    parts = [" water", "   ", "x", " é日▁", "the" * 30, "日" * 60, " " + "\U0001f600" * 20, "".join(letters), "x" * 1024, "ab" * 128, "日本" * 700]  # long ones advance in blocks
    edges = v.lattices([p.encode() for p in parts])
    group = edge = 0
    for part, chars in zip(parts, edges.chars.tolist(), strict=True):
        assert chars == len(part)
        sums = [math.log(1.0)]
        for end in range(1, len(part) + 1):
            ways = []
            for start in range(max(0, end - v.longest), end):
                if part[start:end] in v.ids:
                    ways.append((start, sums[start] + v.log[v.ids[part[start:end]]]))
                elif start == end - 1:
                    ways.append((start, sums[start] + v.log[-1] * len(part[start].encode())))
            top = max(w for _, w in ways)
            total = sum(math.exp(w - top) for _, w in ways)
            sums.append(top + math.log(total))
            n = edges.count[group]
            assert edges.start[edge : edge + n].tolist() == [s for s, _ in ways]
            np.testing.assert_allclose(edges.share[edge : edge + n], np.cumsum([math.exp(w - top) for _, w in ways]) / total, rtol=1e-9)
            group, edge = group + 1, edge + n
    assert group == len(edges.count) and edge == len(edges.piece)


def test_long_texts_without_spaces_cost_as_others():
    import time

    import public_tokenizers

    v = sp_sampling.vocabulary(public_tokenizers.path("piece_bpe_32k.model"), 1.0)
    rng = random.Random(6)
    for text in ("".join(rng.choices("abcdefgh日本", k=400_000)), "x" * 500_000):
        began = time.process_time()
        ids, sizes = sp_sampling.sample(v, [text.encode(), b"a b"], np.array([1, 2]), 3)
        assert time.process_time() - began < 12 and sp_sampling.decode(v, ids, sizes) == [text.encode(), b"a b"]


def test_draws_do_not_depend_on_batches():
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    raw, keys = [t.encode() for _, t, *_ in corpus() if t is not None][:70] + ["é▁ü  日本 ".encode(), b"", b"  "], np.arange(73)
    v = sp_sampling.Vocabulary(path, 1.0)
    ids, sizes = sp_sampling.sample(v, raw, keys, 5)
    alone = [sp_sampling.sample(sp_sampling.Vocabulary(path, 1.0) if i < 3 else v, [t], keys[i : i + 1], 5)[0] for i, t in enumerate(raw)]
    assert np.array_equal(ids, np.concatenate(alone)) and sp_sampling.decode(v, ids, sizes) == raw


def test_best_class_gains_most_mutual_information():
    rng = np.random.default_rng(5)
    size = class_lm.SIZE
    grid = rng.integers(0, 40, (size, size)).astype(float)
    xlx = lambda x: float(class_lm.x_log_x(x).sum())
    for _ in range(20):
        old, n, sides = int(rng.integers(0, class_lm.CLASSES)), 6, []
        for side in (0, size):
            sides += [side + int(c) for c in rng.choice(rng.choice(size, 3), n)]
        base = grid + 10 * (np.arange(size) == old)[:, None] + 10 * (np.arange(size) == old)[None, :]
        moved = []
        for k in range(class_lm.CLASSES):
            now = base.copy()
            for cell in sides:
                for to, sign in ((old, -1), (k, 1)):
                    now[(cell, to) if cell < size else (to, cell - size)] += sign
            moved.append(xlx(now) - xlx(now.sum(axis=0)) - xlx(now.sum(axis=1)))
        cells, counts = np.unique(sides, return_counts=True)
        assert class_lm.best_classes(np.array([len(cells)]), cells, counts.astype(float), np.array([old]), base)[0] == int(np.argmax(moved))


def test_class_lm_sends_one_row_for_each_word(monkeypatch):
    """What a task counts of a word is one row, not one for each side; batches lose and repeat nothing."""
    monkeypatch.setattr(class_lm, "IDS_IN_A_BATCH", 7)
    rng = np.random.default_rng(3)
    key = np.unique(rng.integers(0, 60 * class_lm.SIDES, 900))
    n = rng.integers(1, 9, len(key))
    rows = [r for b in class_lm.rows_by_id(key, n) for r in b.to_pylist()]
    assert [r["id"] for r in rows] == sorted({k // class_lm.SIDES for k in key.tolist()})
    assert [(r["id"] * class_lm.SIDES + c, x) for r in rows for c, x in zip(r["cells"], r["n"], strict=True)] == list(zip(key.tolist(), n.tolist()))
    grid = [r for b in class_lm.rows_by_id(np.array([-1, -6]), np.array([2, 3])) for r in b.to_pylist()]
    assert grid == [{"id": -1, "cells": [0, 5], "n": [2, 3]}] and not list(class_lm.rows_by_id(key[:0], n[:0]))
