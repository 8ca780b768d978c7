"""Operators 11 to 13 against brute force, and packing and exact dedup on texts and ids that once ended them."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from veilspark.llm import alignment, decontamination, exact_dedup, importance, packing

SCHEMA = "doc_id long, text string, rid string, item_id int, n long, words string, w string, a int, gain double, often int"
ODD = (None, "", " ", "  ", "\n", " lead", "trail ", "a  b", "a \n b\n\nc ", "tab\tx y", "x<|endoftext|>y <s> </s>", "é▁ü", "日本語の文 章です", "é café", "\xa0nbsp \xa0x", "A" * 3000, "ab" * 700 + " z", "0 00 000 0000 00000", "don't we'll I'm", "…—“q” 🙂🙂 x", "\x00 \x1c\x1d \x85 x", "ﬁ ½ Å", "end.\n")
PROSE = "the water under the old stone bridge runs over to the north garden where a letter lay open by the window of the paper mill since spring".split()


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "r", 7, 1, "w", "v", 3, 0.5, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def a_side():
    model = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    return model


def alphabet():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def aligned_by_hand(texts):
    a, b, letters = a_side(), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), alphabet()
    docs = []
    for text in texts:
        if not text:
            docs.append(None)
            continue
        x, y = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
        spelt = [bytes(letters[c] for c in a.id_to_token(i)) for i in x], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if any(b"".join(s) != f" {text}".encode() for s in spelt):
            docs.append(None)
            continue
        ends = [[sum(map(len, s[: i + 1])) for i in range(len(s))] if len(s) < 400 else pd.Series(map(len, s)).cumsum().tolist() for s in spelt]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = {c: ([], []) for c in cuts}
        for side, (ids, e) in enumerate(zip((x, y), ends)):
            at = 0
            for i, end in zip(ids, e):
                while cuts[at] < end:
                    at += 1
                groups[cuts[at]][side].append(i)
        docs.append((x, y, list(groups.values())))
    held = Counter()
    for d in docs:
        held.update({(i, j) for g in (d[2] if d else []) for i in g[0] for j in g[1]})
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = Counter()
        for g in d[2]:
            for i, n in Counter(g[0]).items():
                for j, m in Counter(g[1]).items():
                    links[i, j] += n * m
        said = ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in d[2])
        best = sum(n for p, n in links.items() if held[p] == most[p[0]])
        out.append((len(d[0]), len(d[1]), len(d[2]), sum(links.values()), best, sum(n * held[p] for p, n in links.items()), hashlib.sha256(said.encode()).hexdigest()))
    return out


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize(("rows_each", "kept"), [(16_384, 160 << 20), (5, 1)])
def test_alignment(spark, monkeypatch, rows_each, kept):
    """Also with A ids dealt over many parts."""
    monkeypatch.setattr(alignment, "ROWS_EACH", rows_each)
    texts = [*ODD, *(" ".join(PROSE[i % 7 : 9 + i % 5]) for i in range(40)), *["the same text"] * 12, "the old stone " * 900]
    ids = [*range(len(texts) - 3), None, None, 5]
    got = alignment.alignment(frame(spark, texts, ids)).collect()
    want = [(i, *r) for i, r in zip(ids, aligned_by_hand(texts))]
    assert Counter(tuple(r[c] for c in ("doc_id", *NAMES)) for r in got) == Counter(want)
    assert alignment.alignment(frame(spark, [])).count() == 0


def test_alignment_worker_begins_anew(monkeypatch):
    both = alignment.vocabularies(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"))
    monkeypatch.setattr(alignment, "KEPT_BYTES", 1000)
    small = alignment.Worker(both)
    want = aligned_by_hand(ODD)
    for _ in range(2):
        for text, row in zip(ODD, want):
            numbers, digests, *_ = small.documents([text or ""])
            assert (*numbers[:, 0], digests[0]) == (*row[:4], row[6])


def test_alignment_long_white_space_and_invalid_bytes(spark):
    docs = frame(spark, ["a" + " " * 1_200_000 + "b"]).unionByName(frame(spark, ["x"]).withColumn("text", F.unhex(F.lit("61FF62")).cast("string")))
    got = {r.n_a > 0: r for r in alignment.alignment(docs).collect()}
    assert got[True].n_a == 1_200_001 and got[False].groups_sha256 == ""


def words_of(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def leaks_by_hand(texts, items):
    asked = [(str(i) if i is not None else "", words_of(t)) for i, t in items]
    out = []
    for text in texts:
        w = words_of(text)
        hit, found = set(), set()
        for item, a in asked:
            k = min(len(a), 10)
            pieces = {tuple(a[i : i + k]) for i in range(len(a) - k + 1)} if a else set()
            for i in range(len(w) - k + 1):
                if k and tuple(w[i : i + k]) in pieces:
                    hit.update(range(i, i + k))
                    found.add(item)
        out.append((len(w), frozenset(hit), tuple(sorted(found))))
    return out


@pytest.mark.parametrize("block", [4 << 20, 120])
def test_decontamination(spark, block):
    """In one block and in many; spans are bytes of the original."""
    items = [(0, " ".join(PROSE)), (1, "The NORTH garden!"), (2, None), (3, "?!"), (12, "water-under the Old/stone"), (None, "paper mill"), (0, "window of the"), (5, "é 日本 Übung"), (6, "a a a a a a a a a a a a")]
    texts = [None, "", "--", " ".join(PROSE), "x " + "\n".join(PROSE[3:14]).upper() + ", y", " ".join(PROSE[3:12]), "é  日本; Übung É", "the north-garden where the north garden", "waterunder the old stone", "a " * 40, "paper mill. Paper MILL", *[" ".join(PROSE[:12])] * 3, "word " * 30_000 + "paper, mill"]
    ids = [*range(len(texts) - 2), None, None]
    docs = frame(spark, texts, ids)
    bench = spark.createDataFrame([(*x, 9) for x in items], "item_id long, text string, doc_id long")
    got = decontamination.contamination(docs, bench, block_bytes=block).collect()
    want = leaks_by_hand(texts, items)
    seen = Counter((r.doc_id, r.n_words, frozenset(i for s in r.spans for i in range(s["first"], s["last"])), tuple(r["items"])) for r in got)
    assert seen == Counter((i, *r) for i, r in zip(ids, want))
    by_id = dict(zip(ids, texts))
    for r in got:
        if r.doc_id is not None:
            raw, places = (by_id[r.doc_id] or "").encode(), [m.span() for m in re.finditer(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (by_id[r.doc_id] or "").encode())]
            assert all((s["begin"], s["end"]) == (places[s["first"]][0], places[s["last"] - 1][1]) for s in r.spans)
            assert all(a["last"] < b["first"] for a, b in zip(r.spans, r.spans[1:])) and all(0 <= s["begin"] < s["end"] <= len(raw) for s in r.spans)
    assert decontamination.contamination(frame(spark, []), bench).count() == 0
    none = decontamination.contamination(docs, bench.limit(0)).collect()
    assert len(none) == len(texts) and not any(r["items"] for r in none)


def drawn_by_hand(ids, texts, target, most, buckets=importance.BUCKETS):
    feature = lambda w: [b" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f) % buckets
    docs = [feature(words_of(t)) for t in texts]
    raw, aim = Counter(bucket(f) for d in docs for f in d), Counter(bucket(f) for t in target for f in feature(words_of(t)))
    s, t = raw.total(), aim.total()
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets)))) for b in raw}
    rows = []
    for i, text, d in zip(ids, texts, docs):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in d)
        rows.append([i, len(d), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for n, r in enumerate(able[: 10 * len(able) // 100]):
        r[4] = n + 1
    return Counter(tuple(r[:5]) for r in rows)


@pytest.mark.parametrize(("most", "share"), [(1, 100_000), (1, 20), (3, 100_000), (2, 5)])
def test_importance(spark, monkeypatch, most, share):
    """With most keys broadcast and with most joined."""
    monkeypatch.setattr(importance, "HEAD_SHARE", share)
    texts = [None, "", "É é ÉCOLE Z z", *(" ".join(PROSE[i % 11 :] + PROSE[: i % 13] + [f"w{i % 17}"]) for i in range(90)), "word " * 4000, *["The Same " * 15] * 6]
    ids = [*range(len(texts) - 4), None, None, 3, 3]
    target = ["The north garden, where a LETTER lay", None, "unseen words é", "window window"]
    bench = spark.createDataFrame([(i, t, 2) for i, t in enumerate(target)], "item_id long, text string, doc_id long")
    got = importance.resampled(frame(spark, texts, ids), bench, most).collect()
    assert Counter(tuple(r) for r in got) == drawn_by_hand(ids, texts, target, most)
    assert importance.resampled(frame(spark, []), bench, most).count() == 0
    alone = importance.resampled(frame(spark, texts, ids), bench.limit(0), most).collect()
    assert Counter(tuple(r) for r in alone) == drawn_by_hand(ids, texts, [], most)


def test_packing_of_long_white_space(spark):
    texts = [" " * 3_000_000, "a" + "\n" * 1_100_000 + "b<|endoftext|>c"]
    model = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r.doc_tokens for r in packing.packed(frame(spark, texts)).select("doc_id", "doc_tokens").distinct().collect()}
    assert got == {i: len(model.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    bad = frame(spark, ["x"]).withColumn("text", F.unhex(F.lit("61FF62")).cast("string"))
    assert packing.packed(bad).count() == 1


def test_exact_dedup_ids_at_both_ends(spark):
    for ids in ((2**62 + 10, 2**62 + 11, 2**63 - 1), (-(2**63), -(2**63) + 1, 2**63 - 1)):
        index = exact_dedup.DigestIndex(spark, "ends_index", 2)
        rows = exact_dedup.decided_in_batches(frame(spark, ["a", "a", "b"], ids), index).collect()
        index.drop()
        assert {(r.doc_id, r.keep_id, r.kept) for r in rows} == {(ids[0], ids[0], True), (ids[1], ids[0], False), (ids[2], ids[2], True)}


def test_digest_index_opened_again(spark):
    """Under another number of partitions, after a compaction, and after one that was cut off."""
    index = exact_dedup.DigestIndex(spark, "again_index", 3)
    assert index.decide(frame(spark, ["a", "b"]), "one").filter("kept").count() == 2
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        again = exact_dedup.DigestIndex(spark, "again_index")
        assert again.buckets == 3 and again.decide(frame(spark, ["b", "c"]), "two").filter("kept").count() == 1
        again.compact(5)
        assert exact_dedup.DigestIndex(spark, "again_index").buckets == 5 and again.read().count() == 3
        spark.sql("ALTER TABLE again_index RENAME TO again_index_compacted")
        last = exact_dedup.DigestIndex(spark, "again_index")
        assert last.read().count() == 3 and last.decide(frame(spark, ["a", "d"]), "three").filter("kept").count() == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    last.drop()
