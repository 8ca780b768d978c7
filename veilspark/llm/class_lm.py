"""Scoring with a class-based bigram language model (Brown) and its unigram base.

Texts are tokenised once into arrays of word ids, from which all further passes count. Exchange clustering works in two
steps. On the driver it moves each of the FREQUENT most frequent words, and each of ENDINGS groups of all others by a
checksum of their last two bytes, to the class that gains most average mutual information of neighbouring classes. Then
ROUNDS rounds of grouped aggregates move each of the at most KNOWN most counted words to the class that gains most from
its own neighbours, and a last round does so for all other training words. The group of its ending gives the class of a
word only where training has no such word. A token costs

    P(w | h) = LAMBDA * P(class | class before) * (c(w) + 1) / (N_class + V_class + 1) + (1 - LAMBDA) * (c(w) + 1) / (N + V + CLASSES)

which sums to one over the words, the end and one unknown for each class of words (the end has a class alone, without
an unknown). Every document ends with an end token, which also stands before its first word.

Word counts and classes cover all training documents. The at most KNOWN most counted words are broadcast; a word beyond
them is looked up by a join, with its count and class.

Defined results: null text is empty, n_tokens 1; without training documents N = V = 0 and every score is 0 for
each token; repeated rows score alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import slices, texts, written

FREQUENT, ENDINGS, CLASSES, SWEEPS, ROUNDS = 1000, 200, 40, 4, 2
KNOWN, LAMBDA, SMOOTHING, MOST_HELD = 200_000, 0.9, 40.0, 100_000
END = FREQUENT + ENDINGS
ITEMS = END + 1
#: Classes with that of the end; what stands before and after a word, by class.
SIZE = CLASSES + 1
SIDES = 2 * SIZE
#: Words whose gains are computed at a time: with SIDES cells each, 5 MB for each of some arrays. Ids of texts, and bytes of them, that a step handles. Words in a batch of counts.
AT_ONCE, IDS_AT_ONCE, BYTES_AT_ONCE, IDS_IN_A_BATCH = 200, 1 << 18, 1 << 20, 1 << 14
LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def tokens(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in slices(batches, most=BYTES_AT_ONCE):
        for text in texts(batch):
            held.update(tokens(text))
        if len(held) > MOST_HELD:
            yield out()
            held.clear()
    if held:
        yield out()


def word_counts(training: DataFrame) -> DataFrame:
    """word (lower-cased bytes) and c over all rows of training (text)."""
    return written(training.select("text").mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")), "word-counts")


def most_counted(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """All words of at least some count, so chosen that there are `most` at most; by count, then bytes."""
    band = F.floor(F.log2("c") * 8).cast("int")
    left, least = most, None
    for row in sorted(counts.groupBy(band.alias("band")).count().collect(), key=lambda r: -r["band"]):
        left -= row["count"]
        if left < 0:
            break
        least = row["band"]
    if least is None:
        return []
    rows = counts.filter(band >= least).toPandas()
    return sorted(zip(map(bytes, rows["word"]), rows["c"].tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def encoded(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """row, doc_id, held_out, ids and cold for every row of docs (doc_id, held_out, text).

    ids: the place of each word among the known words, len(words) for the end, beyond it by ending for all others;
    cold: those others, in order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = len(shared.value)
        index: dict = {w: i for i, w in enumerate(shared.value)} | {None: many}
        for batch in slices(batches, most=BYTES_AT_ONCE):
            flat: list = [None]
            for text in texts(batch):
                flat += tokens(text)
                flat.append(None)
            at = np.array([index.get(w, -1) for w in flat], dtype=np.int32)
            missed = np.flatnonzero(at < 0)
            cold = [flat[j] for j in missed.tolist()]
            at[missed] = [many + 1 + ending(w) for w in cold]
            ends = np.flatnonzero(at == many)
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at[1:]))
            others = pa.ListArray.from_arrays(pa.array(np.searchsorted(missed, ends).astype(np.int32)), pa.array(cold, pa.binary()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "held_out")), ids, others], ["row", "doc_id", "held_out", "ids", "cold"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "text")
    return written(rows.mapInArrow(encode, "row long, doc_id long, held_out boolean, ids array<int>, cold array<binary>"), "encoded")


def lines(batches: Iterator[pa.RecordBatch], many: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of encoded rows, their ids in a line with an end before each text, and where the ends stand."""
    for batch in batches:
        sizes = pa.compute.list_value_length(batch.column("ids")).to_numpy()
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // IDS_AT_ONCE)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True):
            part = batch.slice(a, b - a)
            if part.num_rows:
                yield part, np.concatenate([[many], part.column("ids").flatten().to_numpy().astype(np.int64)]), np.concatenate([[0], np.cumsum(sizes[a:b], dtype=np.int64)])


def key_counts(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(key), 1 << 18):
        yield pa.RecordBatch.from_arrays([pa.array(key[i : i + (1 << 18)].astype(np.int64)), pa.array(n[i : i + (1 << 18)].astype(np.int64))], ["key", "n"])


def rows_by_id(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """id, cells, n: what is counted of each word in one row, of keys (id * SIDES + side) that lie together; those of the class table (-1 - cell) have id -1."""
    ids, cells = np.where(key < 0, -1, key // SIDES), np.where(key < 0, -1 - key, key % SIDES)
    starts = np.concatenate([np.flatnonzero(np.diff(ids, prepend=-2)), [len(ids)]])
    for i in range(0, len(starts) - 1, IDS_IN_A_BATCH):
        ends = starts[i : i + IDS_IN_A_BATCH + 1]
        a, b = ends[0], ends[-1]
        places = pa.array((ends - a).astype(np.int32))
        lists = [pa.ListArray.from_arrays(places, pa.array(x[a:b].astype(t))) for x, t in ((cells, np.int32), (n, np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array(ids[ends[:-1]].astype(np.int32)), *lists], ["id", "cells", "n"])


def pair_counts(coded: DataFrame, group: np.ndarray, many: int, hot_too: bool = False) -> np.ndarray:
    """How often each group follows each, over all rows of coded; group: by id. With hot_too also for known words alone."""
    shared, size = coded.sparkSession.sparkContext.broadcast(group), int(group.max()) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((1 + hot_too) * size * size, dtype=np.int64)
        for _, at, _ in lines(batches, many):
            of = shared.value[at]
            pair = of[:-1] * size + of[1:]
            cells[: size * size] += np.bincount(pair, minlength=size * size)
            if hot_too:
                hot = at <= many
                cells[size * size :] += np.bincount(pair[hot[:-1] & hot[1:]], minlength=size * size)
        met = np.flatnonzero(cells)
        yield from key_counts(met, cells[met])

    rows = coded.select("ids").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()  # cells of the table at most
    out = np.zeros((1 + hot_too) * size * size)
    out[rows["key"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(1 + hot_too, size, size)


def x_log_x(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def class_pairs(pairs: np.ndarray, classes: np.ndarray) -> np.ndarray:
    cells = classes[:, None] * SIZE + classes[None, :]
    return np.bincount(cells.ravel(), weights=pairs.ravel(), minlength=SIZE * SIZE).reshape(SIZE, SIZE)


def exchange_classes(pairs: np.ndarray) -> np.ndarray:
    """A class below CLASSES for each item but the end, which alone is class CLASSES."""
    weight = pairs.sum(axis=0) + pairs.sum(axis=1)
    order = np.argsort(-weight[:END], kind="stable")
    classes = np.full(ITEMS, CLASSES)
    classes[order] = np.arange(END) % CLASSES
    size = CLASSES + 1
    grid = class_pairs(pairs, classes)
    for _ in range(SWEEPS):
        moved = 0
        for w in order:
            if not weight[w]:
                continue
            old, self_pair = classes[w], pairs[w, w]
            after = np.bincount(classes, weights=pairs[w], minlength=size)
            before = np.bincount(classes, weights=pairs[:, w], minlength=size)
            after[old] -= self_pair
            before[old] -= self_pair
            grid[old] -= after
            grid[:, old] -= before
            grid[old, old] -= self_pair
            base = x_log_x(grid)
            rows, columns = x_log_x(grid + after[None, :]) - base, x_log_x(grid + before[:, None]) - base
            corner = np.diagonal(grid)
            gain = rows.sum(axis=1) - np.diagonal(rows) + columns.sum(axis=0) - np.diagonal(columns)
            gain = gain + x_log_x(corner + after + before + self_pair) - x_log_x(corner)
            out, into = grid.sum(axis=1) + before, grid.sum(axis=0) + after  # what w's neighbours gain, whichever class it takes
            gain = gain - (x_log_x(out + after.sum() + self_pair) - x_log_x(out)) - (x_log_x(into + before.sum() + self_pair) - x_log_x(into))
            new = int(np.argmax(gain[:CLASSES] + 1e-9 * (np.arange(CLASSES) == old)))
            classes[w] = new
            moved += new != old
            grid[new] += after
            grid[:, new] += before
            grid[new, new] += self_pair
        if not moved:
            break
    return classes


def best_classes(sizes: np.ndarray, cells: np.ndarray, n: np.ndarray, old: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """For each word the class of greatest gain, all others staying where they are in grid, which counts it under old.

    A word has sizes[i] of the cells (class before, or SIZE + class after; distinct, together n times).
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    every = np.arange(len(sizes))
    others = np.concatenate([grid[:, :CLASSES], grid.T[:, :CLASSES]])[cells]
    others[np.arange(len(cells)), old[owner]] -= n
    gain = np.add.reduceat(x_log_x(others + n[:, None]) - x_log_x(others), np.cumsum(sizes) - sizes, axis=0)
    sides = np.bincount(owner * SIDES + cells, weights=n, minlength=len(sizes) * SIDES).reshape(-1, 2, SIZE)
    before, after = sides[:, 0, :CLASSES], sides[:, 1, :CLASSES]
    w, k = np.nonzero((before > 0) & (after > 0))  # both change one cell of the grid
    a, b, own = before[w, k], after[w, k], old[w] == k
    corner = grid[k, k]
    gain[w, k] -= x_log_x(corner - a * own + a) - x_log_x(corner - a * own) + x_log_x(corner - b * own + b) - x_log_x(corner - b * own)
    corner = np.maximum(corner - (a + b) * own, 0)
    gain[w, k] += x_log_x(corner + a + b) - x_log_x(corner)
    times = sides[:, 0].sum(axis=1)
    for axis in (0, 1):
        total = np.repeat(grid.sum(axis=axis)[None, :CLASSES], len(sizes), axis=0)
        total[every, old] -= times
        gain -= x_log_x(total + times[:, None]) - x_log_x(total)
    gain[every, old] += 1e-6  # a tie moves nothing
    return gain.argmax(axis=1)


def moved_words(coded: DataFrame, own: np.ndarray, many: int) -> np.ndarray:
    """own after one round: each known word that is no seed goes to its best class, all others staying where they are."""
    shared = coded.sparkSession.sparkContext.broadcast(own)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells of the class table as key -1 - cell, sides of words as key id * SIDES + side; a row for each id."""
        own = shared.value
        grid, sides = np.zeros(SIZE * SIZE, dtype=np.int64), np.zeros(many * SIDES, dtype=np.int32)
        for _, at, _ in lines(batches, many):
            kind = own[at]
            grid += np.bincount(kind[:-1] * SIZE + kind[1:], minlength=SIZE * SIZE)
            chosen = np.flatnonzero((at >= FREQUENT) & (at < many))
            np.add.at(sides, at[chosen] * SIDES + kind[chosen - 1], 1)
            np.add.at(sides, at[chosen] * SIDES + SIZE + kind[chosen + 1], 1)
        for base, cells in ((0, sides), (None, grid)):
            met = np.flatnonzero(cells)
            yield from rows_by_id(met if base == 0 else -1 - met, cells[met])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            cells = batch.column("cells")
            ids = np.repeat(batch.column("id").to_numpy().astype(np.int64), pa.compute.list_value_length(cells).to_numpy())
            cell = cells.flatten().to_numpy()
            key, place = np.unique(np.concatenate([key, np.where(ids < 0, -1 - cell, ids * SIDES + cell)]), return_inverse=True)
            n = np.bincount(place, weights=np.concatenate([n, batch.column("n").flatten().to_numpy()])).astype(np.int64)
        yield from rows_by_id(key, n)

    kinds = "id int, cells array<int>, n array<long>"
    parts = max(16, int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = written(coded.select("ids").mapInArrow(count, kinds).repartition(parts, "id").mapInArrow(merge, kinds), "word-sides")
    grid = np.zeros(SIZE * SIZE)
    for row in found.filter("id < 0").collect():  # one row, of SIZE**2 cells at most
        grid[row["cells"]] = row["n"]
    table = coded.sparkSession.sparkContext.broadcast(grid.reshape(SIZE, SIZE))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(i, AT_ONCE)
                sizes = pa.compute.list_value_length(batch.column("cells")).to_numpy()
                old = shared.value[batch.column("id").to_numpy()]
                new = best_classes(sizes, batch.column("cells").flatten().to_numpy(), batch.column("n").flatten().to_numpy().astype(np.float64), old, table.value)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(new.astype(np.int32))], ["id", "class"])

    moved = found.filter("id >= 0").mapInArrow(choose, "id int, class int").toPandas()  # KNOWN rows at most
    out = own.copy()
    out[moved["id"].to_numpy()] = moved["class"].to_numpy()
    return out


def cold_places(coded: DataFrame, own: np.ndarray, many: int) -> DataFrame:
    """A row for each place of a word that is not known: row, held_out, word, code, other.

    code: (guess * 128 + left) * 128 + right, the class by its ending and the classes of its neighbours, SIZE more for
    those that are not known either and so have but a guess; other: the word behind it, if that is one of these.
    """
    shared = coded.sparkSession.sparkContext.broadcast(own)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, at, ends in lines(batches, many):
            missed = np.flatnonzero(at > many)
            kind = shared.value[at]
            side = kind + SIZE * (at > many)
            word, owner = part.column("cold").flatten(), np.searchsorted(ends, missed) - 1
            behind = np.where(at[missed + 1] > many, np.arange(len(missed)) + 1, -1)
            other = word.take(pa.array(behind, mask=behind < 0))
            code = (kind[missed] * 128 + side[missed - 1]) * 128 + side[missed + 1]
            owned = [part.column(c).take(pa.array(owner)) for c in ("row", "held_out")]
            yield pa.RecordBatch.from_arrays([*owned, word, pa.array(code.astype(np.int32)), other], ["row", "held_out", "word", "code", "other"])

    return written(coded.filter(F.size("cold") > 0).mapInArrow(places, "row long, held_out boolean, word binary, code int, other binary"), "cold-places")


def cold_classes(cold: DataFrame, grid: np.ndarray) -> DataFrame:
    """word, class, c of every word of cold places in training; grid: pairs of classes, those of such words by their guesses."""
    shared = cold.sparkSession.sparkContext.broadcast(grid)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(i, AT_ONCE)
                sizes, flat = pa.compute.list_value_length(batch.column("codes")).to_numpy(), batch.column("codes").flatten()
                code, n = flat.field(0).to_numpy(), flat.field(1).to_numpy().astype(np.float64)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                left, right = (code >> 7 & 127) % SIZE, (code & 127) % SIZE
                cells, place = np.unique(np.concatenate([owner * SIDES + left, owner * SIDES + SIZE + right]), return_inverse=True)
                total = np.bincount(place, weights=np.concatenate([n, n]))
                old = (code >> 14)[np.cumsum(sizes) - sizes]
                new = best_classes(np.bincount(cells // SIDES, minlength=len(sizes)), cells % SIDES, total, old, shared.value)
                times = np.bincount(owner, weights=n, minlength=len(sizes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(new.astype(np.int32)), pa.array(times)], ["word", "class", "c"])

    by_code = cold.filter("not held_out").select("word", "code").repartition("word").groupBy("word", "code").agg(F.count(F.lit(1)).alias("n"))
    by_word = by_code.groupBy("word").agg(F.collect_list(F.struct("code", "n")).alias("codes"))  # SIDES**2 codes a word at most
    return written(by_word.mapInArrow(choose, "word binary, class int, c long"), "cold-classes")


def placed(cold: DataFrame, rare: DataFrame) -> DataFrame:
    """row, held_out, c, before, after: the pairs of classes that the words of cold places make with what is around them."""
    guess, left, right = F.shiftright("code", 14), F.shiftright("code", 7).bitwiseAND(127), F.col("code").bitwiseAND(127)
    mine = F.coalesce("class", guess)
    one = cold.drop("other").hint("merge").join(rare, "word", "left").select(
        "row", "held_out", "c", F.when(left < SIZE, left * SIZE + mine).alias("before"), F.when(right < SIZE, mine * SIZE + right).alias("after")
    )
    two = cold.filter("other is not null").hint("merge").join(rare, "word", "left").select("row", "held_out", "other", mine.alias("a"), (right - SIZE).alias("b"))
    two = two.hint("merge").join(rare.select(F.col("word").alias("other"), "class"), "other", "left").select(
        "row", "held_out", F.lit(None).cast("long").alias("c"), F.lit(None).cast("int").alias("before"), (F.col("a") * SIZE + F.coalesce("class", "b")).alias("after")
    )
    return written(one.unionByName(two), "cold-pairs")


def learned(coded: DataFrame, counts: DataFrame, known: list[tuple[bytes, int]]) -> tuple[dict, DataFrame, DataFrame]:
    """The model, the table of all training words that it does not hold (word, class, c), and the cold pairs of all rows of coded."""
    training = coded.filter("not held_out")
    documents = training.count()
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = int(total) + documents, kinds + (documents > 0)
    words, many = [w for w, _ in known], len(known)
    by_ending = np.array([ending(w) for w in words], dtype=np.int64)
    item = np.concatenate([np.where(np.arange(many) < FREQUENT, np.arange(many), FREQUENT + by_ending), [END], FREQUENT + np.arange(ENDINGS)]).astype(np.int64)
    seeds = exchange_classes(pair_counts(training, item, many)[0])
    own = seeds[item]
    for _ in range(ROUNDS if many > FREQUENT else 0):
        own = moved_words(training, own, many)
    cold = cold_places(coded, own, many)
    whole, grid = pair_counts(training, own, many, hot_too=True)
    rare = cold_classes(cold, whole)
    pairs = placed(cold, rare)
    met = pairs.filter("not held_out").select(F.explode(F.array("before", "after")).alias("cell")).filter("cell is not null")
    for row in met.groupBy("cell").count().collect():
        grid[row["cell"] // SIZE, row["cell"] % SIZE] += row["count"]
    mass = np.bincount(own[:many], weights=[c + 1 for _, c in known], minlength=SIZE) + (np.arange(SIZE) < CLASSES)
    for row in rare.groupBy("class").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        mass[row["class"]] += row["n"] + row["v"]
    mass[CLASSES] = documents + 1
    share = (grid.sum(axis=0) + 1) / (grid.sum() + SIZE)
    transition = (grid + SMOOTHING * share) / (grid.sum(axis=1, keepdims=True) + SMOOTHING)
    log_cell = np.log10(LAMBDA * transition / mass + (1 - LAMBDA) / (n + v + CLASSES)) if documents else np.zeros((SIZE, SIZE))
    model = {
        "words": words, "counts": np.array([c for _, c in known], dtype=np.int64), "classes": own,
        "log_cell": log_cell, "n": n, "v": v, "documents": documents,
    }
    return model, rare, pairs


def fit(training: DataFrame) -> tuple[dict, DataFrame]:
    """What scoring needs in every task, and the table of all words that it does not hold: word, class, c."""
    counts = word_counts(training)
    known = most_counted(counts, KNOWN)
    coded = encoded(training.select(F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("held_out"), "text"), [w for w, _ in known])
    return learned(coded, counts, known)[:2]


def scores(docs: DataFrame, model: dict, rare: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text, held_out): n_tokens, n_known, train_tokens, base_score, score."""
    coded = encoded(docs, model["words"])
    return totals(coded, placed(cold_places(coded, model["classes"], len(model["words"])), rare), model)


def fitted_scores(docs: DataFrame) -> DataFrame:
    """As scores(docs, *fit(rows of docs that are not held out)), reading the texts of docs once less."""
    docs = docs.withColumn("held_out", F.coalesce("held_out", F.lit(False)))
    counts = word_counts(docs.filter("not held_out"))
    known = most_counted(counts, KNOWN)
    coded = encoded(docs, [w for w, _ in known])
    model, _, pairs = learned(coded, counts, known)
    return totals(coded, pairs, model)


def totals(coded: DataFrame, pairs: DataFrame, model: dict) -> DataFrame:
    shared = coded.sparkSession.sparkContext.broadcast({k: model[k] for k in ("counts", "classes", "log_cell", "documents")})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        many = len(m["counts"])
        log_count = np.concatenate([np.log10(m["counts"] + 1.0), [np.log10(m["documents"] + 1.0)], np.zeros(ENDINGS)])
        for part, at, ends in lines(batches, many):
            kind, hot, starts = m["classes"][at], at <= many, ends[:-1]
            seen = hot[1:] & ((at[1:] < many) | (m["documents"] > 0))
            add = lambda x: np.add.reduceat(x, starts)  # noqa: E731, B023
            logs = add(log_count[at[1:]])
            cells = add(np.where(hot[:-1] & hot[1:], m["log_cell"][kind[:-1], kind[1:]], 0.0))
            columns = [pa.array(x) for x in (np.diff(ends), add(seen.astype(np.int64)), logs, logs + cells)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "doc_id", "held_out")), *columns], ["row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "score"])

    kinds = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double"
    hot = coded.select("row", "doc_id", "held_out", "ids").mapInArrow(score, kinds)
    log_cell = F.from_json(F.lit(json.dumps(model["log_cell"].ravel().tolist())), "array<double>")
    cost = lambda cell: F.coalesce(F.get(log_cell, cell), F.lit(0.0))
    cold = pairs.groupBy("row").agg(
        F.count("c").alias("more"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0))).alias("cold_logs"), F.sum(cost("before") + cost("after")).alias("cold_cells")
    )
    cold = written(cold, "cold-sums")
    more: Column = F.coalesce("more", F.lit(0))
    logs, cells = F.coalesce("cold_logs", F.lit(0.0)), F.coalesce("cold_cells", F.lit(0.0))
    return hot.hint("merge").join(cold, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + more).alias("n_known"), F.lit(model["n"]).cast("long").alias("train_tokens"),
        (F.col("logs") + logs - F.col("n_tokens") * float(np.log10(model["n"] + model["v"] + 1.0))).alias("base_score"),
        (F.col("score") + logs + cells).alias("score"),
    )
