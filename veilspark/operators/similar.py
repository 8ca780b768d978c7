"""Similarity joins of surfaces with configured names: fuzzy ratios behind a filter that loses no pair, and trigram cosines.

No side meets the other pair by pair. Both sides are reduced to keys (q-grams, words); rows that share a key are candidates, and
only those are compared. Names are configuration, surfaces grow with the data: the cost follows the candidates.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.automaton import parts
from veilspark.functions.casing import LEAST_FUZZY, fuzzy_ratio
from veilspark.operators.source import rows_by_parts
from veilspark.sources.files import dealt

#: The least ratio that counts.
LEAST_RATIO = 88.0
#: Texts of entities that contexts are held against; a larger set is refused.
MOST_TEXTS = 20_000
#: Letters whose keys a Python worker answers at a time.
LETTERS = 1 << 14


def numbered(grams: list[str]) -> list[str]:
    """Grams with their number of times before, so that shared ones can be counted as of multisets."""
    seen: Counter[str] = Counter()
    out = []
    for g in grams:
        out.append(f"{g}{seen[g]}")
        seen[g] += 1
    return out


def least_shared(size: int, least: float = LEAST_RATIO) -> int:
    """How many trigrams a text of this size shares with one that is no shorter, at least, for the ratio.

    Of two texts of together S letters, a ratio r leaves at most (1 - r) S letters that are put in or taken out. Each
    breaks three trigrams at most; and as they part the shared letters into pieces, one piece has three letters.
    """
    return max(1, size - 2 - 3 * math.floor((1 - least / 100) * 2 * size + 1e-9))


def keys_of(text: str, least: float = LEAST_RATIO) -> list[tuple[str, int]]:
    """The keys of a text, each with how many of its kind a partner must share: trigrams of the text (kind 3), those of its words in
    order (kind 1, with pairs of letters if they are few), and its words (kind 2)."""
    low = text.lower()
    words = sorted(set(low.split()))
    line = " ".join(words)
    cut = lambda t, n: [t[i : i + n] for i in range(len(t) - n + 1)]
    plain = [(f"t{g}", 3) for g in numbered(cut(low, 3))]
    ordered = [(f"s{g}", 1) for g in dict.fromkeys(cut(line, 3) + (cut(line, 2) if len(line) < LEAST_FUZZY else []))]
    return plain + ordered + [(f"w{w}", 2) for w in words]


def name_keys(text: str, rank: dict[str, int] | None = None, least: float = LEAST_RATIO) -> list[str]:
    """The keys under which a name is found. Of its trigrams the rarest: a partner that shares as many as it must shares one of these.

    A partner's size decides how many trigrams it shares; partial ratios allow one of 0.6 of the name's size at least, or a longer one.
    """
    n = len(text)
    shared = min((least_shared(m, least) for m in range(max(LEAST_FUZZY, math.ceil(0.6 * n)), n + 1)), default=1)
    keys = keys_of(text, least)
    trigrams = sorted((k for k, kind in keys if kind == 3), key=lambda k: ((rank or {}).get(k, 0), k))
    return trigrams[: max(1, len(trigrams) - shared + 1)] + [k for k, kind in keys if kind != 3]


def close_enough(a: str, b: str, least: float = LEAST_RATIO) -> bool:
    """Whether sizes and letters in common let any of the ratios reach the least one."""
    a, b = a.lower(), b.lower()
    left, right = Counter(a), Counter(b)
    both, short = (left & right).total(), min(len(a), len(b))
    if both * 200 >= least * (short + both) - 1e-6:  # partial ratio, and so the plain one: a window as long as what is shared
        return True
    x, y = set(a.split()), set(b.split())
    if x & y:  # token-set ratio with common words: judged on its own
        return True
    return (Counter(" ".join(x)) & Counter(" ".join(y))).total() * 200 >= least * (len(" ".join(x)) + len(" ".join(y))) - 1e-6


def key_parts(batches: Iterator[pa.Array], keys: Callable[[str], list[str]]) -> Iterator[pa.Array]:
    """The keys of each text, in parts of a few letters: there are some keys a letter, each a string of Python's."""
    for texts in batches:
        sizes = pa.compute.fill_null(pa.compute.utf8_length(texts), 0).to_pylist()
        for begin, end in parts(sizes, LETTERS):
            yield pa.array([[] if t is None or len(t) < LEAST_FUZZY else keys(t) for t in texts.slice(begin, end - begin).to_pylist()], pa.list_(pa.string()))


def keyed(keys: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return key_parts(batches, keys)

    return run


def fuzzy_candidates(surfaces: DataFrame, names: DataFrame, least: float = LEAST_RATIO) -> DataFrame:
    """surface, name: distinct pairs that share a key and whose sizes and letters allow the ratio. No pair at the ratio is missing.

    Surfaces are few bytes beside their keys: they are dealt out, as by their bytes a few tasks would make the keys of all.
    """

    of_surfaces, of_names = keyed(lambda t: [k for k, _ in keys_of(t, least)]), keyed(lambda t: name_keys(t, None, least))

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([close_enough(x, y, least) for x, y in zip(a, b, strict=True)], dtype=bool)

    left = dealt(surfaces.select("surface").distinct(), "surface").select("surface", F.explode(of_surfaces(F.col("surface"))).alias("key"))
    right = names.select("name").distinct().select("name", F.explode(of_names(F.col("name"))).alias("key"))
    return left.join(right, "key").select("surface", "name").distinct().filter(close("surface", "name"))


def fuzzy_pairs(surfaces: DataFrame, names: DataFrame, least: float = LEAST_RATIO) -> DataFrame:
    """surface, name, ratio of every pair of surfaces (surface) and names (name) whose fuzzy ratio is at least that."""

    @F.pandas_udf("double")
    def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([round(fuzzy_ratio(x, y), 4) for x, y in zip(a, b, strict=True)])

    return fuzzy_candidates(surfaces, names, least).withColumn("ratio", ratios("surface", "name")).filter(F.col("ratio") >= least)


def letter_trigrams(text: Column) -> Column:
    """The distinct trigrams of a text's letters and digits, lowered and joined; the whole of it if it has fewer than three."""
    joined = F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", ""))
    many = F.transform(F.sequence(F.lit(1), F.char_length(joined) - 2), lambda i: F.substring(joined, i, F.lit(3)))
    return F.when(F.char_length(joined) >= 3, F.array_distinct(many)).when(joined != "", F.array(joined)).otherwise(F.array().cast("array<string>"))


def semantic_pairs(contexts: DataFrame, texts: DataFrame, least: float = 0.3) -> DataFrame:
    """id, entity_id, similarity: the best cosine of each context (id, text) with a text of each entity (entity_id, text), from `least` on.

    An inverted index of the texts, which are configuration (MOST_TEXTS at most), goes to every task: a context is cut where it is, and
    neither it nor its trigrams are shuffled.
    """
    held = texts.select("entity_id", letter_trigrams(F.col("text")).alias("g")).distinct().limit(MOST_TEXTS + 1).collect()
    if len(held) > MOST_TEXTS:
        raise ValueError(f"over {MOST_TEXTS} texts of entities")
    spark, index = contexts.sparkSession, defaultdict(list)
    for number, row in enumerate(held):
        for gram in row["g"] or ():
            index[gram].append(number)
    shared = spark.sparkContext.broadcast((dict(index), [len(r["g"] or ()) for r in held]))

    def alike(letters: str) -> list[tuple[int, float]]:
        index, sizes = shared.value
        grams = {letters[i : i + 3] for i in range(len(letters) - 2)} if len(letters) > 2 else {letters}
        both = Counter(chain.from_iterable(index[g] for g in index.keys() & grams))
        return [(t, x) for t, n in both.items() if (x := n / math.sqrt(len(grams) * sizes[t])) >= least]

    @F.arrow_udf("array<struct<t:int,similarity:double>>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return rows_by_parts(batches, alike, ["t", "similarity"], [pa.int32(), pa.float64()])

    named = spark.createDataFrame([(i, r["entity_id"]) for i, r in enumerate(held)], texts.select(F.lit(0).alias("t"), "entity_id").schema)
    letters = F.lower(F.regexp_replace("text", "[^A-Za-z0-9]+", ""))
    pairs = contexts.select("id", F.explode(found(letters)).alias("f")).select("id", "f.t", "f.similarity").join(F.broadcast(named), "t")
    return pairs.groupBy("id", "entity_id").agg(F.max("similarity").alias("similarity"))
