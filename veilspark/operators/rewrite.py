"""Baseline redaction, choice of spans and splicing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.automaton import Needles, Shared


#: Rules up to which a text is searched for each of them in the JVM.
FEW_RULES = 32


class Redactor:
    """Rules in turn, as they would be applied one by one; an automaton tells which of them has anything to do.

    What a rule puts in may hold a later rule's spelling, so that a text is read again after each rule that changed it.
    """

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules, self.needles = rules, Needles([real for real, _ in rules])

    def apply(self, text: str) -> tuple[str, int]:
        done, n = -1, 0
        while later := [i for i in self.needles.present(text) if i > done]:
            done = min(later)
            real, ghost = self.rules[done]
            n += text.count(real)
            text = text.replace(real, ghost)
        return text, n


def redact(text: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Every spelling replaced by its alias, longest first and without regard for word edges; and how often, on the text as it changes.

    Spellings of one length go in the order given; of a repeated one the first rule counts. Empty ones are left out.
    """
    unique = list(dict(reversed([r for r in rules if r[0]])).items())[::-1]
    ordered = sorted(unique, key=lambda r: -len(r[0]))
    if len(ordered) > FEW_RULES:
        shared = Shared(ordered, Redactor)

        @F.pandas_udf("out string, n int")
        def run(texts: pd.Series) -> pd.DataFrame:
            apply = shared.get().apply
            return pd.DataFrame([(None, None) if t is None else apply(t) for t in texts], columns=["out", "n"]).astype({"n": "Int32"})

        done = run(text)
    elif ordered:
        array = F.array(*(F.struct(F.lit(a).alias("real"), F.lit(b).alias("ghost")) for a, b in ordered))
        held = lambda s, r: F.floor((F.char_length(s["out"]) - F.char_length(F.replace(s["out"], r["real"]))) / F.char_length(r["real"])).cast("int")
        step = lambda s, r: F.when(F.contains(s["out"], r["real"]), F.struct(F.replace(s["out"], r["real"], r["ghost"]).alias("out"), (s["n"] + held(s, r)).alias("n"))).otherwise(s)
        done = F.aggregate(array, F.struct(text.alias("out"), F.lit(0).alias("n")), step)
    else:
        return text, F.lit(0)
    return done["out"], done["n"]


def picked_spans(spans: Column) -> Column:
    """Greedy choice among array<struct<start, end, rank, ...>>: longest first, then leftmost, then rank; no overlaps. In order of start."""
    ordered = F.array_sort(
        spans,
        lambda a, b: F.when((b["end"] - b["start"]) != (a["end"] - a["start"]), (b["end"] - b["start"]) - (a["end"] - a["start"]))
        .when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"]),
    )
    free = lambda picked, s: ~F.exists(picked, lambda p: (p["start"] < s["end"]) & (s["start"] < p["end"]))
    chosen = F.aggregate(ordered, F.slice(ordered, 1, 0), lambda picked, s: F.when(free(picked, s), F.concat(picked, F.array(s))).otherwise(picked))
    return F.array_sort(chosen, lambda a, b: a["start"] - b["start"])


def spliced(text: Column, spans: Column) -> Column:
    """text with the (disjoint, ordered) spans replaced by their `ghost`."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    state = F.aggregate(
        spans, zero,
        lambda a, s: F.struct(s["end"].cast("int").alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"].cast("int") - a["at"]), s["ghost"]).alias("out")),
    )
    return F.concat(state["out"], F.substring(text, state["at"] + 1, F.char_length(text)))


def residual_by_entity(hits: DataFrame) -> DataFrame:
    return hits.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_hits"), F.count_distinct("file").alias("n_files"))
