"""Language identification by prediction by partial matching over bytes.

For each language, counts of what byte follows each context of up to ORDER bytes form a context tree. A
byte costs -log2 of its probability in the longest known context, else an escape (method C: the number of
distinct successors against all) and its cost in the next shorter one, down to all bytes alike. The counts
are frozen after training, so costs are looked up: a text costs the sum over all its bytes, and the cheapest
language wins. All contexts of the sample are kept.

Defined results: `und` with score 0 if text is null or holds no letter, or if nothing could be learned; texts over
TEXT_BYTES are identified whole, but teach nothing, so that a language with none else is not learned; ties
go to the language first in order; repeated rows score alike; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import slices, texts

ORDER = 3
#: The bounded sample, spread by a hash of doc_id: about so many training documents and bytes a language, of texts up to TEXT_BYTES.
SAMPLE_DOCUMENTS, SAMPLE_BYTES, TEXT_BYTES = 300, 32 << 20, 4 << 20
#: Bytes whose costs are looked up at a time.
STEP = 1 << 16


def count_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, code, count: code has ORDER bytes of context (zero before the text) and the byte."""
    for batch in slices(batches):
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        raw = texts(batch)
        for lang in sorted(set(langs)):
            joined = (b"\0" * ORDER).join([b"", *(t for t, x in zip(raw, langs, strict=True) if x == lang)])
            data = np.frombuffer(joined, dtype=np.uint8).astype(np.uint32)
            codes = sum(data[i : len(data) - ORDER + i] << np.uint32(8 * (ORDER - i)) for i in range(ORDER + 1))
            codes, counts = np.unique(codes[data[ORDER:] > 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "code", "n"])


def train(docs: DataFrame) -> dict:
    """The frozen costs of every context and byte for every language of docs (text, lang)."""
    size = F.octet_length("text")
    known = docs.filter(F.col("lang").isNotNull() & (size <= TEXT_BYTES))
    totals = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).collect()
    sizes = {r["lang"]: max(r["n"] / SAMPLE_DOCUMENTS, r["bytes"] / SAMPLE_BYTES) for r in totals}
    if not sizes:
        return {"langs": []}
    langs = sorted(sizes)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(1 / max(1.0, sizes[k])))])
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = known.filter(spread < F.element_at(share, F.col("lang")))
    counted = sample.select("text", "lang").mapInArrow(count_windows, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    return context_trees(counted.toPandas(), langs)  # bounded by the sample


def context_trees(counted, langs: list[str]) -> dict:
    """Every context met, of each length, with its parent (one byte shorter), its escape cost, and the costs of the bytes met in it.

    Costs have one column for each language. What bytes a context has met is a mask over the symbols, in words of 64;
    the cost of one stands at its word's first row plus how many lower symbols of the word the context has met.
    """
    seen = np.unique(np.concatenate([[0], (counted["code"].to_numpy() & 255)]))
    symbol = np.full(256, len(seen), dtype=np.int64)  # bytes never met share the last symbol, which no context has met
    symbol[seen] = np.arange(len(seen))
    width, letters = len(seen) + 1, len(langs)
    code, n = counted["code"].to_numpy(), counted["n"].to_numpy()
    lang = counted["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
    parts = [symbol[(code >> (8 * i)) & 255] for i in range(ORDER, -1, -1)]
    byte = parts[-1]

    words = -(-width // 64)
    masks, firsts, escapes, parents, costs = [], [], [], [], []
    tree = lambda: {"words": words} | {k: np.concatenate(v) for k, v in {"mask": masks, "first": firsts, "escape": escapes, "parent": parents, "cost": costs}.items()}
    held, rows = 0, 0  # contexts and costs of shorter lengths
    below = np.zeros(1, dtype=np.int64)  # number of each context of the next shorter length, by its index
    for order in range(ORDER + 1):
        index = np.zeros(len(code), dtype=np.int64)
        for part in parts[ORDER - order : ORDER]:
            index = index * width + part
        met, at = np.unique(index, return_inverse=True)
        cells, place = np.unique(at * width + byte, return_inverse=True)  # (context, byte), in order
        counts = np.bincount(place * letters + lang, weights=n, minlength=len(cells) * letters).reshape(-1, letters)
        owner, met_byte = cells // width, cells % width
        first = np.searchsorted(owner, np.arange(len(met)))
        total, kinds = np.add.reduceat(counts, first), np.add.reduceat((counts > 0).astype(np.int64), first)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            direct = -np.log2(counts / (total + kinds)[owner])
        shorter = below[met % width ** (order - 1)] if order else np.full(len(met), -1)
        mask = np.zeros((len(met), words), dtype=np.uint64)
        np.bitwise_or.at(mask, (owner, met_byte >> 6), np.uint64(1) << (met_byte & 63).astype(np.uint64))
        under = np.bitwise_count(mask).astype(np.int64)
        if order:
            base = lowered(tree(), shorter[owner], met_byte)
        else:
            base = np.full((len(cells), letters), np.log2(256.0))  # no context at all: all bytes alike
        costs.append(np.where(counts > 0, direct, escape[owner] + base))
        masks.append(mask.ravel())
        firsts.append((rows + first[:, None] + np.cumsum(under, axis=1) - under).ravel())
        escapes.append(escape)
        parents.append(shorter)
        number = below[np.arange(width**order) % width ** (order - 1)] if order else np.zeros(1, dtype=np.int64)
        number[met] = held + np.arange(len(met))
        below, held, rows = number, held + len(met), rows + len(cells)
    return {"langs": langs, "symbol": symbol.astype(np.int32), "width": width, "number": below.astype(np.int32), **tree()}


def lowered(tree: dict, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The cost of each symbol in its context, in bits under each language: escapes down to where it has been met."""
    out, words = np.zeros((len(context), tree["cost"].shape[1])), tree["words"]
    left = np.arange(len(context))
    while len(left):
        word, bit = context * words + (symbol >> 6), np.uint64(1) << (symbol & 63).astype(np.uint64)
        own = tree["mask"][word]
        row = tree["first"][word] + np.bitwise_count(own & (bit - np.uint64(1)))
        hit = (own & bit) > 0
        if len(left) == len(out):
            out[hit] = tree["cost"][row[hit]]
        else:
            out[left[hit]] += tree["cost"][row[hit]]
        left, context, symbol = left[~hit], context[~hit], symbol[~hit]
        out[left] += tree["escape"][context]
        context = tree["parent"][context]
        nowhere = context < 0
        out[left[nowhere]] += np.log2(256.0)
        left, context, symbol = left[~nowhere], context[~nowhere], symbol[~nowhere]
    return out


def code_lengths(raw: list[bytes], model: dict) -> np.ndarray:
    """Bits of each text under each language."""
    out = np.zeros((len(raw), len(model["langs"])))
    lead = np.full(ORDER, model["symbol"][0], dtype=np.int32)
    at = 0
    while at < len(raw):  # texts of some STEP bytes at a time, a longer one in pieces
        group, size = at, 0
        while at < len(raw) and (at == group or size + len(raw[at]) <= STEP):
            size += len(raw[at])
            at += 1
        data = np.concatenate([np.concatenate([lead, model["symbol"][np.frombuffer(t, dtype=np.uint8)]]) for t in raw[group:at]])
        owner = np.repeat(np.arange(group, at), [len(t) for t in raw[group:at]])
        place = np.concatenate([np.arange(len(t)) for t in raw[group:at]]) + ORDER * (owner - group + 1) + (np.cumsum([len(t) for t in raw[group:at]]) - [len(t) for t in raw[group:at]])[owner - group]
        for i in range(0, len(place), STEP):
            p, o = place[i : i + STEP], owner[i : i + STEP]
            context = np.zeros(len(p), dtype=np.int64)
            for k in range(ORDER, 0, -1):
                context = context * model["width"] + data[p - k]
            bits = lowered(model, model["number"][context].astype(np.int64), data[p].astype(np.int64))
            first = np.flatnonzero(np.concatenate([[True], np.diff(o) > 0]))
            out[o[first]] += np.add.reduceat(bits, first)
    return out


def identify(docs: DataFrame, model: dict, pred: str = "__lang_pred", posterior: str = "__score") -> DataFrame:
    """docs with their columns and these two: the language, and its posterior under equal priors."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            raw = texts(batch)
            pick = np.array([bool(m["langs"]) and any(map(str.isalpha, t.decode())) for t in raw], dtype=bool)
            lang, score = ["und"] * len(raw), np.zeros(len(raw))
            if pick.any():
                bits = code_lengths([t for t, p in zip(raw, pick, strict=True) if p], m)
                weight = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000))
                best = bits.argmin(axis=1)
                score[pick] = weight[np.arange(len(best)), best] / weight.sum(axis=1)
                for i, b in zip(np.flatnonzero(pick), best, strict=True):
                    lang[i] = m["langs"][b]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], [*names, pred, posterior])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(predict, f"{kinds}, `{pred}` string, `{posterior}` double")
