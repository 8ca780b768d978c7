"""Source files cut into nodes, which rules rewrite by kind, and what flows where in them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import lexer
from veilspark.functions.automaton import parts

SCRIPTS = ("javascript", "typescript", "tsx")
#: The maps of package.json whose keys name packages.
DEPENDENCIES = (
    "dependencies", "devDependencies", "peerDependencies", "optionalDependencies",
    "bundledDependencies", "bundleDependencies", "resolutions", "overrides",
)


#: Rows that are Python objects at a time; those before them are Arrow columns already.
ROWS_HELD = 50_000


def rows_of(texts: pa.Array, found: Callable[[str], Iterable[tuple]], names: list[str], types: list[pa.DataType]) -> pa.Array:
    """For each text the rows found in it, as lists of structs built by column; null where a null came in."""
    columns, ends, n = [[] for _ in names], [0], 0
    done: list[pa.Array] = []

    def flush() -> None:
        done.append(pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names))
        for column in columns:
            column.clear()

    for text in texts:  # one Python string at a time
        for row in found(text.as_py()) if text.is_valid else ():
            for column, value in zip(columns, row, strict=True):
                column.append(value)
            n += 1
            if len(columns[0]) >= ROWS_HELD:
                flush()
        ends.append(n)
    flush()
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(done), mask=texts.is_null())


def rows_by_parts(batches: Iterator[pa.Array], found: Callable[[str], Iterable[tuple]], names: list[str], types: list[pa.DataType]) -> Iterator[pa.Array]:
    """`rows_of` of batches, each in parts of bounded bytes, so that a worker holds the rows of one part."""
    for texts in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0)
        for begin, end in parts(sizes.to_pylist()):
            yield rows_of(texts.slice(begin, end - begin), found, names, types)


def placed_nodes(text: Column, hcl: bool = False) -> Column:
    """array<struct<kind, text, start>> of comment, specifier, string, identifier and other pieces that make up the text, in order.

    start counts code points. Strings are cut at their escapes; their quotes are other pieces, but those of specifiers, which
    are theirs. Code in templates (in hcl: in quoted texts and heredocs) is code. No piece of the empty text; null for null.
    """

    @F.arrow_udf("array<struct<kind:string,text:string,start:int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return rows_by_parts(batches, lambda t: lexer.nodes(t, hcl), ["kind", "text", "start"], [pa.string(), pa.string(), pa.int32()])

    return run(text)


def nodes(text: Column, hash_comments: bool = False) -> Column:
    """array<struct<kind, text>> of `placed_nodes`; hash_comments: of HCL."""
    return F.transform(placed_nodes(text, hash_comments), lambda n: F.struct(n["kind"].alias("kind"), n["text"].alias("text")))


def node_rows(files: DataFrame, language: Column) -> DataFrame:
    """files (file, text) as rows file, node_ord, kind, start, end, text; of code alone."""
    code, hcl = language.isin(*SCRIPTS), language == "hcl"
    both = F.coalesce(placed_nodes(F.when(code, F.col("text"))), placed_nodes(F.when(hcl, F.col("text")), hcl=True))
    rows = files.select("file", F.posexplode(both).alias("node_ord", "n"))
    return rows.select("file", "node_ord", "n.kind", "n.start", (F.col("n.start") + F.char_length("n.text")).alias("end"), "n.text")


def first_party(specifier: Column) -> Column:
    """Whether a specifier, quoted or not, begins with a dot, a slash or a tilde."""
    return F.regexp_replace(specifier, r"""^.*?["']?([^"']*)["']?$""", "$1").rlike("^[./~]")


def package_pieces(text: Column) -> Column:
    """array<struct<key, text>> that make up a package.json: names of dependencies (key true), and what is between them.

    Maps within a map of dependencies may be one deep; their keys are names too.
    """
    name = r'"[^"\n]*"(?=\s*:)'
    piece = lambda key: lambda t: F.struct(F.lit(key).alias("key"), t.alias("text"))

    def woven(between: Column, matches: Column) -> Column:
        return F.flatten(F.zip_with(between, F.concat(matches, F.array(F.array().cast("array<struct<key:boolean,text:string>>"))), lambda b, m: F.concat(F.array(b), m)))

    def pieces_of_map(block: Column) -> Column:
        keys = F.transform(F.regexp_extract_all(block, F.lit(name), F.lit(0)), lambda k: F.array(piece(True)(k)))
        return woven(F.transform(F.split(block, name), piece(False)), keys)

    opening = r'(?<="(?:' + "|".join(DEPENDENCIES) + r')"\s{0,20}:\s{0,20}\{)[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+'
    blocks = F.transform(F.regexp_extract_all(text, F.lit(opening), F.lit(0)), pieces_of_map)
    return woven(F.transform(F.split(text, opening), piece(False)), blocks)


def package_nodes(text: Column) -> Column:
    """array<struct<kind, text>> of a package.json: names of dependencies as specifiers, all else as strings."""
    return F.transform(package_pieces(text), lambda p: F.struct(F.when(p["key"], "specifier").otherwise("string").alias("kind"), p["text"].alias("text")))


def file_nodes(file: Column, language: Column, text: Column) -> Column:
    """The nodes of a file by its name and language: code by its nodes, package files by their keys, all else whole."""
    script, hcl = language.isin(*SCRIPTS), language == "hcl"  # the lexers run over all rows: they are given the texts of theirs alone
    return (
        F.when(script, nodes(F.when(script, text))).when(hcl, nodes(F.when(hcl, text), hash_comments=True))
        .when(F.element_at(F.split(file, "/"), -1) == "package.json", package_nodes(text)).when(language == "scoped", F.array(F.struct(F.lit("string").alias("kind"), text.alias("text"))))
        .otherwise(F.array(F.struct(F.lit("other").alias("kind"), text.alias("text"))))
    )


NAMED = r"[A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*"
#: Texts all whose lines bind one dotted name to another: no line changes what the next one means.
PLAIN = rf"\A(?:{NAMED} = {NAMED}\n)*{NAMED} = {NAMED}\z"
#: Lines of plain texts that mean more: words of the language, what is exported, and surroundings within a longer name.
ODD = rf"(?:\A|\n| = )(?:{'|'.join(sorted(lexer.WORDS))}|module|exports)(?:[. \n]|\z)|\.process\.env\."
PLAIN_KINDS = pa.array(["alias", "expr", "env", "member-of"])


def plain_flows(texts: pa.Array) -> pa.Array:
    """What `lexer.Flow` finds in plain texts, by columns: each line gives what its value names, then its variable of the surroundings, then the member's object."""
    pc = pa.compute
    names = pc.split_pattern(pc.replace_substring(texts, " = ", "\n"), "\n")
    lines = np.diff(names.offsets.to_numpy()) // 2
    flat, of = names.flatten(), np.repeat(np.arange(len(texts)), lines)
    to, value = flat.take(pa.array(np.arange(0, len(flat), 2))), flat.take(pa.array(np.arange(1, len(flat), 2)))
    members, paths = pc.match_substring(to, "."), pc.match_substring(value, ".")
    dst, src = pc.if_else(members, pc.binary_join_element_wise("member:", to, ""), to), pc.list_element(pc.split_pattern(value, ".", max_splits=1), 0)
    which = lambda mask: np.flatnonzero(mask.to_numpy(zero_copy_only=False))
    own, env, owned = which(pc.not_equal(src, dst)), which(pc.starts_with(value, "process.env.")), which(members)
    variable = pc.list_element(pc.split_pattern(value.take(pa.array(env)), ".", max_splits=3), 2)
    owner = pc.list_element(pc.split_pattern(to.take(pa.array(owned)), ".", max_splits=1, reverse=True), 0)
    srcs = pa.concat_arrays([src.take(pa.array(own)), pc.binary_join_element_wise("env:", variable, ""), dst.take(pa.array(owned))])
    dsts = pa.concat_arrays([dst.take(pa.array(own)), dst.take(pa.array(env)), owner])
    kinds = np.concatenate([paths.to_numpy(zero_copy_only=False)[own].astype(np.int64), np.full(len(env), 2), np.full(len(owned), 3)])
    at = np.concatenate([own, env, owned])
    order = np.argsort(np.concatenate([own * 3, env * 3 + 1, owned * 3 + 2]), kind="stable")
    a, b = (x.dictionary_encode() for x in (srcs, dsts))
    key = ((of[at] * len(a.dictionary) + a.indices.to_numpy()) * len(b.dictionary) + b.indices.to_numpy()) * len(PLAIN_KINDS) + kinds
    codes = pa.array(key[order]).dictionary_encode().indices.to_numpy()  # numbered by first sight
    kept = order[np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1))]
    rows = pa.StructArray.from_arrays([srcs.take(pa.array(kept)), dsts.take(pa.array(kept)), PLAIN_KINDS.take(pa.array(kinds[kept]))], names=["src", "dst", "kind"])
    ends = np.concatenate([[0], np.cumsum(np.bincount(of[at[kept]], minlength=len(texts)))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


def flows(texts: pa.Array) -> pa.Array:
    """For each text what flows where in it; null where a null came in. Plain texts are read by columns, only others by the lexer."""
    matches = lambda pattern: pa.compute.fill_null(pa.compute.match_substring_regex(texts, pattern), False).to_numpy(zero_copy_only=False)
    plain = matches(PLAIN)
    plain[plain] &= ~matches(ODD)[plain]
    read = lambda some: rows_of(some, lambda t: lexer.Flow(t).found, ["src", "dst", "kind"], [pa.string()] * 3)
    if plain.all():
        return plain_flows(texts) if len(texts) else read(texts)
    if not plain.any():
        return read(texts)
    place = np.argsort(np.argsort(~plain, kind="stable"), kind="stable")
    return pa.concat_arrays([plain_flows(texts.filter(pa.array(plain))), read(texts.filter(pa.array(~plain)))]).take(pa.array(place))


def edges(text: Column) -> Column:
    """array<struct<src, dst, kind>> of what flows where in code, each once; a node has no edge to itself.

    Names bound by declarations, assignments and destructuring take what their value names (alias, literal, construct, require,
    call-result, expr); plain functions take the names and strings of their calls (arg). Nodes are names, "str:...",
    "member:object.property" (with an edge to its object, member-of) and "env:NAME" for process.env.NAME (env); what a file
    exports leads to "export:name". Values that are functions of their own give nothing; nothing is known of scopes.
    """

    @F.arrow_udf("array<struct<src:string,dst:string,kind:string>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0)
            for begin, end in parts(sizes.to_pylist()):
                yield flows(texts.slice(begin, end - begin))

    return run(text)
