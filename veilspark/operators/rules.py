"""Rewriting by the rules of configured entities: literals, patterns and stems, by the kind of each node.

Entities are a table; its rules are a small derived table, which is size-checked when it is taken to the workers. A row of
text is rewritten where it is: nothing is shuffled. A UDF reads a text once, whatever the number of literals and stems, chooses among
the spans it finds, and splices. Patterns are searched one by one.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.automaton import Needles, Shared, parts
from veilspark.functions.casing import Stems, in_style_of, parts_of

#: A configuration is small; a larger one is refused.
MOST_RULES = 20_000
LEVELS = ("public", "internal", "confidential", "restricted")
#: Kinds whose names are rewritten by parts; a token in text; a name that is one token; one that may hold spaces.
NAMED_KINDS = ("vendor", "client", "internal_service", "person")
TEXT_TOKEN = r"[A-Za-z][A-Za-z0-9]*(?:[-_][A-Za-z0-9]+)*"
ONE_TOKEN = r"^[A-Za-z][A-Za-z0-9]*(?:[-_][A-Za-z0-9]+)*$"
NAME_SHAPED = r"^[A-Za-z][A-Za-z0-9]*(?:[ _-][A-Za-z0-9]+)*$"
TOKENS, QUOTED = re.compile(TEXT_TOKEN), re.compile(r"""["']([^"']*)["']\s*$""")
TOKEN_LETTERS, TOKEN_RUN = frozenset(string.ascii_letters + string.digits + "_-"), re.compile(r"[A-Za-z0-9_-]*")
HITS = "array<struct<start:int,end:int,rank:int,ghost:string,entity_id:string,kept:boolean,real:string,specifier:string>>"
DONE, NOTHING = f"array<struct<out:string,hits:{HITS}>>", {"out": None, "hits": []}
#: Rules up to which texts are searched by one pattern before they go to Python; letters of a token whose hits are remembered.
FEW_RULES, LONGEST_KEPT = 8, 64


def rules(entities: DataFrame) -> DataFrame:
    """A row for each rule of entities (id, real, kind, level, strategy, ghost, rewrite_imports, match of (kind, value)):
    form (literal, regex, stem), pattern, and what else its hits need; rank orders rules of equal spans.

    The real name is a literal, and a stem if it is one token of a named kind; stems are for named kinds that are not removed.
    """
    removed, named = F.col("strategy") == "remove", F.col("kind").isin(*NAMED_KINDS)
    given = F.coalesce("match", F.array().cast("array<struct<kind:string,value:string>>"))
    row = lambda form, value: F.struct(F.lit(form).alias("form"), value.alias("pattern"))
    own = F.array(row("literal", F.col("real")), row("stem", F.when(F.col("real").rlike(ONE_TOKEN), F.col("real"))))
    more = F.transform(given, lambda m: F.struct(F.when(m["kind"] == "identifier", "stem").otherwise(m["kind"]).alias("form"), m["value"].alias("pattern")))
    level = F.coalesce(F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level")), F.lit(0)).cast("int")
    rows = entities.select(
        F.col("id").alias("entity_id"), (~removed).cast("int").alias("later"), (-level).alias("less"), F.when(removed, "").otherwise(F.coalesce("ghost", F.lit(""))).alias("ghost"),
        named.alias("named"), F.coalesce("rewrite_imports", F.lit(False)).alias("imports"), F.explode(F.concat(own, more)).alias("r"),
    ).select("*", "r.form", "r.pattern").drop("r")
    rows = rows.filter((F.col("pattern") != "") & ((F.col("form") != "stem") | (F.col("named") & (F.col("later") == 1))))
    return rows.dropDuplicates(["entity_id", "form", "pattern"])


class Rule(NamedTuple):
    entity_id: str
    rank: int
    form: str
    pattern: str
    stem: list[str]
    ghost: str
    words: list[str]
    imports: bool


def taken(rows: DataFrame) -> list[Rule]:
    """The rules in order of rank. Raises ValueError beyond MOST_RULES and for a pattern that is none."""
    got = rows.limit(MOST_RULES + 1).collect()
    if len(got) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} rules")
    ids = {k: i for i, k in enumerate(sorted({(r["later"], r["less"], r["entity_id"]) for r in got}))}
    out = []
    for r in got:
        words = r["ghost"].split("-")
        if r["form"] == "regex":
            re.compile(r["pattern"])
        styled = r["form"] == "literal" and r["named"] and r["later"] and re.match(NAME_SHAPED, r["pattern"])
        out.append(Rule(
            r["entity_id"], ids[(r["later"], r["less"], r["entity_id"])], r["form"], r["pattern"], parts_of(r["pattern"]) if r["form"] == "stem" else [],
            in_style_of(r["pattern"], words) if styled else r["ghost"], words, r["imports"],
        ))
    return sorted(out, key=lambda r: (r.rank, r.form, r.pattern))


def prefilter(found: list[Rule]) -> str | None:
    """A pattern that every text with a hit matches, for a few rules that name what they seek; None for others, which one pass in Python finds faster."""
    if len(found) > FEW_RULES or any(r.form == "regex" for r in found):
        return None
    gap = r"[-_. ]*"
    some = [re.escape(r.pattern) if r.form == "literal" else "(?i:" + gap.join(map(re.escape, r.stem)) + ")" for r in found]
    return "|".join(sorted(set(some))) or r"(?!)"


def chosen(spans: list[dict]) -> list[dict]:
    """Longest first, then leftmost, then by rank; none that overlaps one taken before. In order of start."""
    starts: list[int] = []
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["start"] - s["end"], s["start"], s["rank"])):
        at = bisect_left(starts, s["start"])
        if (at == 0 or out[at - 1]["end"] <= s["start"]) and (at == len(out) or s["end"] <= out[at]["start"]):
            starts.insert(at, s["start"])
            out.insert(at, s)
    return out


class Finder:
    """The spans of rules in texts: one automaton for all literals, one index for all stems, a pattern each for the rest.

    The choice is that of `rewrite.picked_spans`, in time that grows with the spans and not with their pairs. Identifiers are taken by stems alone, all else by patterns, literals and the stems of its tokens. In a specifier only
    what is quoted counts; a hit in a foreign one is kept unless its entity says otherwise.
    """

    def __init__(self, found: list[Rule]):
        by_text: dict[str, list[Rule]] = {}
        for r in found:
            if r.form == "literal":
                by_text.setdefault(r.pattern, []).append(r)
        self.needles, self.owners = Needles(list(by_text)), list(by_text.values())
        self.patterns = [(r, re.compile(r.pattern)) for r in found if r.form == "regex"]
        self.stem_rules = [r for r in found if r.form == "stem"]
        self.stems = Stems([r.stem for r in self.stem_rules], [r.words for r in self.stem_rules])
        self.firsts = Needles(sorted({r.stem[0] for r in self.stem_rules if r.stem}))
        self.in_token = lru_cache(1 << 16)(self._in_token)

    def _in_token(self, name: str) -> list[tuple[int, int, str, Rule]]:
        """What each stem would change in a token, rules in order."""
        hits = sorted(self.stems.hits(name), key=lambda h: h[3])
        return [(a, b, ghost, self.stem_rules[i]) for a, b, ghost, i in hits if ghost != name[a:b]]

    def _tokens(self, text: str) -> Iterator[tuple[int, str]]:
        """start and text of the tokens that hold a stem's first part: where none does, nothing is cut into tokens."""
        low = text.lower()
        if len(low) != len(text):  # a letter that is two in lower case
            low = "".join([x.lower() if x.isascii() else x for x in text])
        done = 0
        for start, end, _ in self.firsts.hits(low):
            if end <= done:
                continue
            begin = max(start, done)
            while begin > done and text[begin - 1] in TOKEN_LETTERS:
                begin -= 1
            done = TOKEN_RUN.match(text, begin).end()
            for m in TOKENS.finditer(text, begin, done):
                yield m.start(), m[0]

    def _candidates(self, kind: str, text: str) -> Iterator[tuple[int, int, str, Rule]]:
        if kind != "identifier":
            for a, b, i in self.needles.hits(text):
                for rule in self.owners[i]:
                    yield a, b, rule.ghost, rule
            for rule, pattern in self.patterns:
                for m in pattern.finditer(text):
                    if m.end() > m.start():
                        yield m.start(), m.end(), rule.ghost, rule
        if self.stem_rules:
            for begin, name in [(0, text)] if kind == "identifier" else self._tokens(text):
                for a, b, ghost, rule in self.in_token(name) if len(name) <= LONGEST_KEPT else self._in_token(name):
                    yield begin + a, begin + b, ghost, rule

    def node(self, kind: str, text: str) -> dict:
        """The new text of a node (null if nothing was found) and the spans chosen in it, in order."""
        inside = QUOTED.search(text) if kind == "specifier" else None
        base, sought = (inside.start(1), inside[1]) if inside else (0, text)
        foreign = kind == "specifier" and not sought.startswith((".", "/", "~"))
        hits = chosen([
            {"start": base + a, "end": base + b, "rank": r.rank, "ghost": ghost, "entity_id": r.entity_id, "kept": foreign and not r.imports}
            for a, b, ghost, r in self._candidates(kind, sought)
        ])
        out, at = [], 0
        for s in hits:
            s["real"] = text[s["start"] : s["end"]]
            s["specifier"] = sought if s["kept"] and inside else "" if s["kept"] else None
            if not s["kept"]:
                out += [text[at : s["start"]], s["ghost"]]
                at = s["end"]
        return {"out": "".join([*out, text[at:]]) if hits else None, "hits": hits}


def span_finder(found: list[Rule], hits: bool = True):
    """A pandas UDF (kinds, texts) -> for each text its new text and (if asked for) hits, null where a null came in."""
    shared = Shared(found, Finder)

    @F.pandas_udf(DONE)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        finder = shared.get()
        node = finder.node if hits else lambda kind, text: {"out": finder.node(kind, text)["out"], "hits": []}
        for kinds, texts in batches:
            for begin, end in parts([0 if t is None else sum(len(x or "") + 1 for x in t) for t in texts]):  # a worker holds the answers of one part
                rows = zip(kinds.iloc[begin:end], texts.iloc[begin:end], strict=True)
                yield pd.Series([None if t is None else [node(k, x) if x else NOTHING for k, x in zip(ks, t, strict=True)] for ks, t in rows], dtype=object)

    return run


def transformed(nodes: Column, found: list[Rule], hits: bool = True) -> Column:
    """array<struct<kind, text, out, hits>> of array<struct<kind, text>>: each node's new text and, if asked for, the spans chosen in it.

    hits: start, end, rank, ghost, entity_id, kept, real, specifier. Nodes of kind "other" stay as they are.
    """
    few = prefilter(found)
    asked = F.transform(nodes, lambda n: F.when(n["kind"] != "other", n["text"]).otherwise(""))
    if few is not None:
        asked = F.when(F.exists(nodes, lambda n: (n["kind"] != "other") & n["text"].rlike(few)), asked)
    answers = span_finder(found, hits)(F.transform(nodes, lambda n: n["kind"]), asked)
    none = F.struct(F.lit(None).cast("string").alias("out"), F.array().cast(HITS).alias("hits"))
    answers = F.coalesce(answers, F.transform(nodes, lambda n: none))
    return F.zip_with(nodes, answers, lambda n, a: F.struct(n["kind"].alias("kind"), n["text"].alias("text"), F.coalesce(a["out"], n["text"]).alias("out"), a["hits"].alias("hits")))


def one_node(kind: str, text: Column) -> Column:
    return F.array(F.struct(F.lit(kind).alias("kind"), text.alias("text")))


def joined(done: Column) -> Column:
    return F.array_join(F.transform(done, lambda n: n["out"]), "")


def all_hits(done: Column) -> Column:
    """The hits of all nodes of `transformed`; real: what stood there; specifier: the whole one, of a kept hit."""
    return F.flatten(F.transform(done, lambda n: n["hits"]))


def renamed(path: Column, found: list[Rule]) -> Column:
    """A path with each of its parts rewritten as text."""
    parts = F.transform(F.split(path, "/"), lambda p: F.struct(F.lit("filename").alias("kind"), p.alias("text")))
    return F.array_join(F.transform(transformed(parts, found, hits=False), lambda n: n["out"]), "/")


def compiled(files: DataFrame, found: list[Rule], nodes: Column) -> DataFrame:
    """files (file, text) with new_file, new_text and hits; nodes: the column of the text's nodes."""
    done = files.withColumn("_done", transformed(nodes, found))
    return done.select(*files.columns, renamed(F.col("file"), found).alias("new_file"), joined(F.col("_done")).alias("new_text"), all_hits(F.col("_done")).alias("hits"))


def counters(compiled_files: DataFrame) -> DataFrame:
    """One row: files scanned, changed and renamed, and hits that were rewritten."""
    return compiled_files.agg(
        F.count(F.lit(1)).alias("n_scanned"), F.count_if(F.col("new_text") != F.col("text")).alias("n_changed"), F.count_if(F.col("new_file") != F.col("file")).alias("n_renamed"),
        F.coalesce(F.sum(F.size(F.filter("hits", lambda h: ~h["kept"]))), F.lit(0)).cast("long").alias("n_hits"),
    )


def hits_by_entity(compiled_files: DataFrame) -> DataFrame:
    """entity_id, n: rewritten hits of each entity."""
    return compiled_files.select(F.explode("hits").alias("h")).filter("not h.kept").groupBy("h.entity_id").agg(F.count(F.lit(1)).alias("n"))


def kept_by_specifier(compiled_files: DataFrame) -> DataFrame:
    return compiled_files.select(F.explode("hits").alias("h")).filter("h.kept").groupBy("h.specifier").agg(F.count(F.lit(1)).alias("n"))
