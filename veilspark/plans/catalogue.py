"""The registered queries: each applies operators of this library to whole tables, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import scoring, text
from veilspark.functions.casing import fuzzy_ratios, splicer
from veilspark.operators import compile as compiling
from veilspark.operators import config, detect, discover, evaluate, gates, graph, restore, rewrite, rules, screen, similar, source, stores, versions, views
from veilspark.operators import run as running
from veilspark.sources import files, sinks, tree
from veilspark.streaming import logs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The configured entities of the queries: id, spelling, level, alias. The first declared owner of a spelling counts.
ENTITIES = [
    ("vendor_the", "the", "internal", "vendor-a"), ("vendor_cc", "Licensed under CC BY-NC 4.0", "restricted", "licence-a"), ("vendor_lic", "Licensed under", "confidential", "licence-b"),
    ("client_der", "der", "confidential", "client-a"), ("client_que", "que", "internal", "client-b"), ("person_and", "and", "public", "person-a"),
]
SPELLINGS = [e[1] for e in ENTITIES]
ENTITY_VALUES = ", ".join(f"('{i}', '{s}', '{lv}', '{g}', {n})" for n, (i, s, lv, g) in enumerate(ENTITIES))
NEEDLES_RE2 = r"\b(?:" + "|".join(sorted((s.replace(".", r"\.") for s in SPELLINGS), key=len, reverse=True)) + r")\b"

#: A corpus line for each supplier, the same expression in both engines.
OVERLAY = (
    "concat('host svc-', s_suppkey, '.prod.internal ip 10.', s_nationkey, '.', s_suppkey % 256, '.7 acct ', lpad(CAST(s_suppkey AS STRING), 12, '0'),"
    " ' tenant tenant-eu-', s_suppkey, ' contract ABC-XY-', lpad(CAST(s_suppkey % 10000 AS STRING), 4, '0'), '-', lpad(CAST(s_nationkey AS STRING), 2, '0'),"
    " ' pkg @brand', s_nationkey, '/core mail ops', s_suppkey, '@example.com SUPPLIER_', s_suppkey, '_API_KEY bookingCore', s_suppkey)"
)
#: The shapes for DuckDB, whose patterns know no look-around: written for it, and not taken from the library.
SHAPES_RE2 = {
    "rfc1918_ip": r"\b(?:10\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}|172\.(?:1[6-9]|2[0-9]|3[01])\.[0-9]{1,3}\.[0-9]{1,3}|192\.168\.[0-9]{1,3}\.[0-9]{1,3})\b",
    "aws_account_id": r"\b[0-9]{12}\b", "aws_access_key_id": r"\bAKIA[0-9A-Z]{16}\b", "prefixed_secret": r"\b[a-z][a-z0-9]{1,15}_(?:live|test|prod|sk|pk)_[A-Za-z0-9]{12,}\b",
    "named_secret": r"\b[a-z][a-z0-9-]{2,}-(?:client-secret|api-key|secret)-[A-Za-z0-9]{6,}\b", "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
    "contract_id": r"\b[A-Z]{2,5}-[A-Z]{2,3}-[0-9]{4}-[0-9]{2,4}\b", "tenant_id": r"\btenant-[a-z0-9]+(?:-[a-z0-9]+)+\b",
    "internal_host": r"\b(?:[a-z0-9-]+\.)+(?:internal|intranet|corp|local)(?:\.[a-z]{2,})?\b", "scoped_npm_package": r"@[a-z0-9][a-z0-9-]*/[a-z0-9][a-z0-9._-]*",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
}
#: Weights of the shapes, for the SQL alone.
WEIGHTS_SQL = "CASE kind WHEN 'rfc1918_ip' THEN 0.40 WHEN 'aws_account_id' THEN 0.30 WHEN 'aws_access_key_id' THEN 0.55 WHEN 'prefixed_secret' THEN 0.55 WHEN 'named_secret' THEN 0.50 WHEN 'jwt' THEN 0.50 WHEN 'email' THEN 0.35 ELSE 0.45 END::DOUBLE"
DOC_SHAPES_SQL = "h AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS hit FROM documents" for k, p in SHAPES_RE2.items()) + ")"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table whose rows are dealt out anew by key, for work that outweighs a shuffle: a file of one row group would be one task."""
    return table(spark, sf_dir, name).repartition(4 * spark.sparkContext.defaultParallelism, key)


def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("src/s"), F.col("s_suppkey"), F.lit(".js")).alias("file"), "s_suppkey", F.expr(OVERLAY).alias("text"))


OVERLAY_SQL = f"overlay AS (SELECT concat('src/s', s_suppkey, '.js') AS file, s_suppkey, {OVERLAY} AS text FROM supplier)"


def entities(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {ENTITY_VALUES} AS e(entity_id, spelling, level, ghost, ord)")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


HITS_SQL = f"hits AS (SELECT doc_id AS file, unnest(regexp_extract_all(text, '{NEEDLES_RE2}')) AS spelling FROM documents), e AS (SELECT * FROM (VALUES {ENTITY_VALUES}) AS e(entity_id, spelling, level, ghost, ord))"


def entity_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.explode(text.anchored_hits(F.col("text"), SPELLINGS)).alias("spelling"))
    return docs.join(F.broadcast(entities(spark)), "spelling")


@query(f"WITH {HITS_SQL} SELECT entity_id, count(*) AS n_hits, count(DISTINCT file) AS n_files FROM hits JOIN e USING (spelling) GROUP BY entity_id")
def q_anchored_entity_counts(spark, sf_dir):
    return rewrite.residual_by_entity(entity_hits(spark, sf_dir))


@query(f"WITH {HITS_SQL} SELECT count(*) AS n_leaks, count(DISTINCT (file, entity_id)) AS n_pairs, count(*) > 0 AS blocked FROM hits JOIN e USING (spelling)")
def q_verify_leaks(spark, sf_dir):
    return entity_hits(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_leaks"), F.count_distinct("file", "entity_id").alias("n_pairs"), (F.count(F.lit(1)) > 0).alias("blocked"))


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT doc_id, line, len(regexp_extract_all(t, '{NEEDLES_RE2}')) AS n_hits FROM l WHERE len(regexp_extract_all(t, '{NEEDLES_RE2}')) > 0""")
def q_line_numbers(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    return lines.select("doc_id", (F.col("i") + 1).cast("long").alias("line"), F.size(text.anchored_hits(F.col("t"), SPELLINGS)).cast("long").alias("n_hits")).filter("n_hits > 0")


@query(f"WITH {OVERLAY_SQL} SELECT file, CAST(instr(text, 'tenant-') - 1 AS BIGINT) AS start, regexp_extract(text, 'tenant-eu-[0-9]+') AS hit FROM overlay")
def q_hit_offsets(spark, sf_dir):
    pattern = text.shape_pattern("tenant_id")
    rows = overlay(spark, sf_dir)
    return rows.select("file", F.get(text.hit_starts(F.col("text"), pattern), 0).cast("long").alias("start"), F.regexp_extract("text", pattern, 0).alias("hit"))


@query("WITH " + OVERLAY_SQL + ", h AS (" + " UNION ALL ".join(f"SELECT file, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS hit FROM overlay" for k, p in SHAPES_RE2.items()) + ") SELECT * FROM h")
def q_shape_hits(spark, sf_dir):
    rows = overlay(spark, sf_dir).select("file", F.explode(text.shape_hits(F.col("text"))).alias("h"))
    return rows.select("file", "h.kind", F.col("h.text").alias("hit"))


@query(f"WITH {DOC_SHAPES_SQL} SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM h GROUP BY kind")
def q_shape_counts(spark, sf_dir):
    rows = dealt(spark, sf_dir, "documents", "doc_id").select("doc_id", F.explode(text.shape_hits(F.col("text"))).alias("h"))
    return rows.groupBy("h.kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query(f"WITH {OVERLAY_SQL}, h AS (" + " UNION ALL ".join(f"SELECT file, text, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS hit FROM overlay" for k, p in SHAPES_RE2.items()) + """),
p AS (SELECT file, kind, hit, instr(text, hit) - 1 AS start FROM h) SELECT file, string_agg(concat(start, ':', kind, ':', hit), ' ' ORDER BY start, -length(hit)) AS shapes FROM p GROUP BY file""")
def q_placed_shapes(spark, sf_dir):
    hits = F.transform(text.placed_shapes(F.col("text")), lambda h: F.concat_ws(":", h["start"].cast("string"), h["kind"], h["text"]))
    return overlay(spark, sf_dir).select("file", F.array_join(hits, " ").alias("shapes"))


CAMEL_SQL = r"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(tok, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), '([0-9]+)', ' \1 ', 'g')), '[^a-z0-9]+'), lambda x: x <> '')"


@query(f"WITH {OVERLAY_SQL}, t AS (SELECT file, unnest(regexp_extract_all(text, '[A-Za-z0-9]+(?:[-_.:/@][A-Za-z0-9]+)+|[A-Za-z0-9]{{2,}}')) AS tok FROM overlay) SELECT file, tok, array_to_string({CAMEL_SQL}, '-') AS norm, CAST(len({CAMEL_SQL}) AS BIGINT) AS n_segments FROM t")
def q_token_segments(spark, sf_dir):
    rows = overlay(spark, sf_dir).select("file", F.explode(text.tokens(F.col("text"))).alias("tok"))
    return rows.select("file", "tok", text.norm(F.col("tok")).alias("norm"), F.size(text.segments(F.col("tok"))).cast("long").alias("n_segments"))


#: Words that tell nothing, for the SQL alone.
STOPS_SQL = (
    "client clients provider providers service services vendor vendors config endpoint api url key secret data systems system core app platform gateway internal flight search request response"
    " default primary main base http https server handler module export common create update delete option options params result status error message number object schema model route router"
    " controller middleware validate validation logger logging token value index helper wrapper factory adapter manager context secondary package inventory schedule schedules email account"
    " region header prod production development staging availability reset password verify refresh access bearer strategy callback connection collection document transport format console process"
    " global window return await async class const function example sample test spec mock"
)


@query(f"""WITH s AS (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS segment FROM documents)
SELECT segment, count(*) AS n, length(segment) >= 5 AND NOT regexp_matches(segment, '^[0-9]+$') AND NOT list_contains(string_split('{STOPS_SQL}', ' '), segment) AS distinctive FROM s GROUP BY segment""")
def q_distinctive_segments(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.explode(text.words(F.col("text"))).alias("segment"))
    return rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).withColumn("distinctive", text.distinctive(F.col("segment")))


RUN_SQL = "concat('-', array_to_string(regexp_extract_all(lower(p_name), '[a-z]+'), '-'), '-')"


@query(f"""SELECT p_partkey, CASE WHEN contains({RUN_SQL}, concat('-', w, '-')) THEN length(substr({RUN_SQL}, 1, instr({RUN_SQL}, concat('-', w, '-')))) - length(replace(substr({RUN_SQL}, 1, instr({RUN_SQL}, concat('-', w, '-'))), '-', '')) - 1 ELSE -1 END AS at
FROM part, (SELECT array_to_string(list_slice(regexp_extract_all(lower(p_name), '[a-z]+'), 2, 3), '-') AS w FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part)) AS n""")
def q_contains_run(spark, sf_dir):
    """Where the second and third word of the first part's name run through all names."""
    rows = table(spark, sf_dir, "part").select("p_partkey", text.segments(F.col("p_name")).alias("s"))
    run = rows.agg(F.min_by(F.slice("s", 2, 2), "p_partkey")).first()[0] or []  # two words
    return rows.select("p_partkey", text.contains_run(F.col("s"), F.array(*map(F.lit, run)).cast("array<string>")).alias("at"))


KIND_CASES = [("const ", "definition"), ("// see ", "comment"), ("import x from", "import"), ("url = '", "string"), ("call(", "identifier")]


@query("SELECT s_suppkey, CASE s_suppkey % 5 " + " ".join(f"WHEN {i} THEN '{k}'" for i, (_, k) in enumerate(KIND_CASES)) + " END AS kind FROM supplier")
def q_node_kind(spark, sf_dir):
    prefix = F.element_at(F.array(*[F.lit(p) for p, _ in KIND_CASES]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.node_kind(F.lit("src/a.js"), prefix).alias("kind"))


SIGNALS_SQL = "SELECT user_id, list_sort(list(DISTINCT least(round(abs(value) / 200, 2), 1.0))) AS ws FROM events GROUP BY user_id"


@query(f"""WITH s AS ({SIGNALS_SQL}), p AS (SELECT user_id, list_filter(ws, lambda x: x > 0) AS ws FROM s)
SELECT user_id, CASE WHEN len(ws) = 0 THEN 0.0 WHEN list_max(ws) >= 1 THEN 1.0 ELSE round(1.0 - list_reduce(list_prepend(CAST(1.0 AS DOUBLE), ws), lambda a, x: a * (1.0::DOUBLE - x)), 4) END AS score FROM p""")
def q_noisy_or(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.least(scoring.rounded(F.abs("value") / 200, 2), F.lit(1.0)).alias("w"))
    return rows.groupBy("user_id").agg(F.collect_set("w").alias("ws")).select("user_id", scoring.noisy_or(F.col("ws")).alias("score"))


@query("""WITH c AS (SELECT o_orderkey, round(o_totalprice % 1000 / 1000, 4) AS score, o_orderkey % 2 = 0 AS hard, CASE o_orderkey % 4 WHEN 0 THEN 'restricted' WHEN 1 THEN 'public' WHEN 2 THEN 'internal' ELSE 'confidential' END AS level, o_custkey % 3 = 0 AS resolved FROM orders)
SELECT o_orderkey, CASE WHEN score >= 0.9 AND hard AND level = 'restricted' THEN 'review' WHEN score >= 0.9 AND hard AND resolved THEN 'auto' WHEN score >= 0.45 THEN 'review' ELSE 'ignore' END AS action FROM c""")
def q_classify(spark, sf_dir):
    k = F.col("o_orderkey")
    level = F.element_at(F.array(*map(F.lit, ("restricted", "public", "internal", "confidential"))), (k % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", scoring.rounded(F.col("o_totalprice") % 1000 / 1000, 4).alias("score"), (k % 2 == 0).alias("hard"), level.alias("level"), (F.col("o_custkey") % 3 == 0).alias("resolved"))
    return rows.select("o_orderkey", scoring.classify(F.col("score"), F.col("hard"), F.col("level"), F.col("resolved")).alias("action"))


SIGNAL_NAMES = {"click": "shape", "view": "fuzzy", "purchase": "exact", "signup": "acronym", "error": "semantic"}
NAME_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SIGNAL_NAMES.items()) + " ELSE 'weak' END"
LABEL_SQL = "CASE name WHEN 'shape' THEN 'structural shape' WHEN 'fuzzy' THEN 'lexical + AST' WHEN 'exact' THEN 'exact' WHEN 'acronym' THEN 'acronym' WHEN 'semantic' THEN 'semantic' ELSE 'weak / no evidence' END"


@query(f"""WITH s AS (SELECT user_id, {NAME_SQL} AS name, max(greatest(round(value / 200, 2) - 0.1, 0)) AS w FROM events WHERE event_id % 3 > 0 OR event_type = 'click' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, name) AS n, count(*) OVER (PARTITION BY user_id) AS many FROM s WHERE w > 0),
l AS (SELECT user_id, CASE WHEN max(many) = 1 AND max(name) = 'semantic' THEN 'semantic only' ELSE string_agg({LABEL_SQL}, ' + ' ORDER BY n) FILTER (n <= 3) END AS label FROM r GROUP BY user_id)
SELECT DISTINCT s.user_id, coalesce(label, 'weak / no evidence') AS label FROM s LEFT JOIN l USING (user_id)""")
def q_evidence_label(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for pair in SIGNAL_NAMES.items() for x in pair])
    rows = table(spark, sf_dir, "events").filter("event_id % 3 > 0 or event_type = 'click'").select("user_id", F.coalesce(F.element_at(names, F.col("event_type")), F.lit("weak")).alias("name"), F.greatest(scoring.rounded(F.col("value") / 200, 2) - 0.1, F.lit(0)).alias("weight"))
    best = rows.groupBy("user_id", "name").agg(F.max("weight").alias("weight"))
    signals = best.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("name", "weight"))).alias("s"))
    return signals.select("user_id", scoring.evidence_label(F.col("s")).alias("label"))


STEMS = [("svc_booking", "booking core", 0), ("svc_supplier", "supplier", 1), ("svc_brand", "brand", 2)]


@query(f"""WITH {OVERLAY_SQL}, t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9]+(?:[-_.:/@][A-Za-z0-9]+)+|[A-Za-z0-9]{{2,}}')) AS tok FROM overlay),
s AS (SELECT tok, concat('-', array_to_string({CAMEL_SQL}, '-'), '-') AS n FROM t),
m AS (SELECT tok, entity_id, ord, CASE WHEN contains(n, concat('-', replace(stem, ' ', '-'), '-')) THEN 0.85 WHEN NOT contains(stem, ' ') AND length(stem) >= 5 AND contains(n, concat('-', stem)) THEN 0.60 ELSE 0.0 END AS w FROM s, (VALUES {', '.join(map(str, STEMS))}) AS p(entity_id, stem, ord))
SELECT tok, arg_max(entity_id, w * 100 - ord) AS entity_id, CAST(max(w) AS DOUBLE) AS weight FROM m WHERE w > 0 GROUP BY tok""")
def q_profile_argmax(spark, sf_dir):
    surfaces = overlay(spark, sf_dir).select(F.explode(text.tokens(F.col("text"))).alias("tok")).distinct().withColumn("seg", text.segments(F.col("tok")))
    weights = [F.struct(scoring.stem_weight(F.col("seg"), F.split(F.lit(stem), " ")).alias("w"), F.lit(-n).alias("o"), F.lit(i).alias("entity_id")) for i, stem, n in STEMS]
    best = surfaces.select("tok", F.array_max(F.array(*weights)).alias("b"))
    return best.filter("b.w > 0").select("tok", "b.entity_id", F.col("b.w").alias("weight"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 0.7 ELSE 0.22 END::DOUBLE AS weight FROM nation")
def q_acronym(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", scoring.acronym_weight(F.lit("MAS"), F.lit("Meridian Aero Systems"), F.col("n_nationkey") % 2 == 0).alias("weight"))


RULES = [(s, g) for _, s, _, g in ENTITIES if s not in ("the", "and")] + [("the", "vendor-a")]
REDACT_SQL, COUNT_SQL = "text", "0"
for _old, _new in sorted(RULES, key=lambda r: (-len(r[0]), r[0])):
    COUNT_SQL = f"{COUNT_SQL} + (length({REDACT_SQL}) - length(replace({REDACT_SQL}, '{_old}', ''))) // {len(_old)}"
    REDACT_SQL = f"replace({REDACT_SQL}, '{_old}', '{_new}')"


@query(f"SELECT doc_id, sha256({REDACT_SQL}) AS redacted_sha256, CAST({COUNT_SQL} AS BIGINT) AS n_replaced FROM documents")
def q_baseline_redact(spark, sf_dir):
    out, n = rewrite.redact(F.col("text"), RULES)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(out, 256).alias("redacted_sha256"), n.cast("long").alias("n_replaced"))


@query("SELECT s_suppkey, concat('call client-a(service-a', s_suppkey, ') end') AS rewritten, 2 AS n_spans FROM supplier")
def q_span_selection(spark, sf_dir):
    span = lambda a, b, rank, ghost: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(rank).alias("rank"), F.lit(ghost).alias("ghost"))
    source = F.concat(F.lit("call northwind(bookingCore"), F.col("s_suppkey"), F.lit(") end"))
    spans = F.array(span(5, 10, 0, "x"), span(5, 14, 1, "client-a"), span(15, 26, 2, "service-a"), span(22, 26, 3, "y"))
    picked = rewrite.picked_spans(spans)
    return table(spark, sf_dir, "supplier").select("s_suppkey", rewrite.spliced(source, picked).alias("rewritten"), F.size(picked).alias("n_spans"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'serviceA' WHEN 1 THEN 'SERVICE_A_URL' ELSE 'myServiceA' END AS rewritten FROM supplier")
def q_casing_rewrite(spark, sf_dir):
    token = F.element_at(F.array(*map(F.lit, ("bookingCore", "BOOKING_CORE_URL", "myBookingCore"))), (F.col("s_suppkey") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", token.alias("token"))
    done = rows.select("token").distinct().withColumn("rewritten", splicer(["booking", "core"], ["service", "a"])("token"))  # distinct tokens only
    return rows.join(F.broadcast(done), "token").select("s_suppkey", "rewritten")


ENTITY_FIELDS = "id, real, kind, level, strategy, ghost, source, approved_by, rewrite_imports, match, ord"


def configured(spark, *rows: str) -> DataFrame:
    """Entities from SQL rows: id, real, kind, level, strategy, ghost, source, match (kind:value pairs joined by bars)."""
    values = ", ".join(f"({r}, {i})" for i, r in enumerate(rows))
    match = "transform(filter(split(m, '[|]'), x -> x <> ''), x -> named_struct('kind', split(x, ':', 2)[0], 'value', split(x, ':', 2)[1])) AS match"
    return spark.sql(f"SELECT id, real, kind, level, strategy, ghost, source, CAST(NULL AS STRING) AS approved_by, false AS rewrite_imports, {match}, ord FROM VALUES {values} AS e(id, real, kind, level, strategy, ghost, source, m, ord)")


#: Entities of prose: a word in all its casings, a name of several words that is removed, one that is not, and a literal.
PROSE = (
    "'vendor_the', 'the', 'vendor', 'internal', 'semantic_alias', 'vendor-a', 'seed', ''",
    "'secret_cc', 'Licensed under CC BY-NC 4.0', 'secret', 'restricted', 'remove', '', 'seed', ''",
    "'vendor_lic', 'Licensed under', 'vendor', 'confidential', 'semantic_alias', 'vendor-b', 'seed', ''",
    "'domain_com', '.example.com', 'domain', 'confidential', 'synthetic_endpoint', '.host-a.test', 'seed', 'regex:[0-9]{4}-[0-9]{2}-[0-9]{2}'",
)
TRANSFORM_SQL = (
    "regexp_replace(regexp_replace(replace(regexp_replace(replace(replace(replace(text, 'Licensed under CC BY-NC 4.0', ''), 'Licensed under', 'vendor b'), '.example.com', '.host-a.test'),"
    r" '[0-9]{4}-[0-9]{2}-[0-9]{2}', '.host-a.test', 'g'), 'the', 'vendor-a'), '\bThe\b', 'VendorA', 'g'), '\bTHE\b', 'VENDOR-A', 'g')"
)


@query(f"SELECT doc_id, md5({TRANSFORM_SQL}) AS out_md5, {TRANSFORM_SQL} <> text AS changed FROM documents")
def q_transform_text(spark, sf_dir):
    """Every whole document rewritten by rules."""
    found = rules.taken(rules.rules(configured(spark, *PROSE)))
    out = rules.joined(rules.transformed(rules.one_node("comment", F.col("text")), found, hits=False))
    return table(spark, sf_dir, "documents").select("doc_id", "text", out.alias("out")).select("doc_id", F.md5("out").alias("out_md5"), (F.col("out") != F.col("text")).alias("changed"))


@query("SELECT page_id, replace(replace(url, 'example', 'site-a'), 'http', 'web') AS renamed FROM pages")
def q_path_rename(spark, sf_dir):
    found = rules.taken(rules.rules(configured(spark, "'d', 'example', 'domain', 'internal', 'generalize', 'site-a', 'seed', 'literal:http'").withColumn("ghost", F.lit("site-a"))))
    found = [r._replace(ghost="web") if r.pattern == "http" else r for r in found]
    return table(spark, sf_dir, "pages").select("page_id", rules.renamed(F.col("url"), found).alias("renamed"))


REST_SQL = r"(len(regexp_extract_all({0}, '\bThe\b')) + len(regexp_extract_all({0}, '\bTHE\b')))"
BASE_SQL = "replace(replace(replace(replace(text, 'Licensed under CC BY-NC 4.0', ''), 'Licensed under', 'vendor-b'), '.example.com', '.host-a.test'), 'the', 'vendor-a')"
REAL_SQL = "sum(len(regexp_extract_all(text, '{}')))"


@query(rf"""WITH h AS (SELECT unnest(regexp_extract_all(text, '\b(?:Licensed under CC BY-NC 4\.0|Licensed under|the)\b|\.example\.com\b')) AS s FROM documents),
r AS (SELECT count(*) FILTER (s = 'the') AS t, count(*) FILTER (s = 'Licensed under') AS l, count(*) FILTER (s LIKE '%4.0') AS c FROM h),
b AS (SELECT sum({REST_SQL.format(BASE_SQL)}) AS t, sum(len(regexp_extract_all({BASE_SQL}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'))) AS d FROM documents)
SELECT e.id AS entity_id, CAST(e.n AS BIGINT) AS real_occurrences, CAST(e.b AS BIGINT) AS baseline_residual, CAST(0 AS BIGINT) AS compile_residual, e.n > 0 OR e.b > 0 AS exercised, true AS passed, e.b > 0 AS hard
FROM (SELECT 'vendor_the' AS id, r.t AS n, b.t AS b FROM r, b UNION ALL SELECT 'secret_cc', r.c, 0 FROM r UNION ALL SELECT 'vendor_lic', r.l, 0 FROM r) AS e""")
def q_eval_cases(spark, sf_dir):
    """What plain replacement and what rules leave in all documents, counted by scanning what they made of them."""
    return evaluate.cases(table(spark, sf_dir, "documents").select("text"), configured(spark, *PROSE[:3])).drop("kind", "level")


DECISIONS_SQL = "d AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS action, count(*) AS n_records FROM events GROUP BY user_id)"


@query(f"WITH {DECISIONS_SQL} SELECT user_id, action, n_records FROM d")
def q_latest_decision(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("action"), "ts", "event_id")
    return stores.latest(rows, "user_id", "ts", "event_id", count="n_records").select("user_id", "action", "n_records")


AGREE_SQL = "(proposed IN ('auto', 'review')) = (reviewer IN ('accept', 'escalate'))"


@query(f"""WITH r AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS k FROM events GROUP BY user_id),
d AS (SELECT CASE user_id % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'review' ELSE 'ignore' END AS proposed, CASE k % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'ignore' ELSE 'escalate' END AS reviewer FROM r)
SELECT proposed, count(*) AS n, count(*) FILTER ({AGREE_SQL}) AS n_agree, round(count(*) FILTER ({AGREE_SQL}) / count(*), 3) AS rate, count(*) FILTER (reviewer = 'escalate') AS escalations,
count(*) FILTER (NOT {AGREE_SQL}) AS overrides FROM d GROUP BY ROLLUP (proposed)""")
def q_agreement(spark, sf_dir):
    last = stores.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id")
    pick = lambda c, words: F.element_at(F.array(*map(F.lit, words)), (F.col(c) % 3 + 1).cast("int"))
    return stores.agreement(last.select(pick("user_id", ("auto", "review", "ignore")).alias("proposed"), pick("event_id", ("accept", "ignore", "escalate")).alias("reviewer")))


def decision_log(spark, sf_dir):
    """Events as decisions: a key and a reviewer's action each, some with an approver."""
    act = F.create_map(*[F.lit(x) for pair in {"purchase": "accept", "view": "ignore", "click": "accept", "error": "escalate"}.items() for x in pair])
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), "user_id").alias("key"), F.concat(F.lit("e"), "user_id").alias("entity_id"), "ts", "event_id", F.coalesce(F.element_at(act, F.col("event_type")), F.lit("ignore")).alias("reviewer_action"),
        F.when(F.col("value") > 50, F.concat(F.lit("u"), F.col("event_id") % 10)).alias("approved_by"),
    )


LOG_SQL = """l AS (SELECT concat('e', user_id) AS key, arg_max(event_type, (ts, event_id)) AS t, arg_max(value, (ts, event_id)) AS v, arg_max(event_id, (ts, event_id)) AS i FROM events GROUP BY user_id)"""


@query(f"""WITH {LOG_SQL} SELECT key, 'accepted' AS list, NULL AS approved_by FROM l WHERE t IN ('purchase', 'click', 'error') UNION ALL SELECT key, 'ignored', NULL FROM l WHERE t IN ('view', 'signup')
UNION ALL SELECT key, 'cleared', concat('u', i % 10) FROM l WHERE t IN ('purchase', 'click') AND v > 50""")
def q_decision_views(spark, sf_dir):
    newest = stores.latest(decision_log(spark, sf_dir), "key", "ts", "event_id")
    rows = lambda df, name, by=F.lit(None).cast("string"): df.select("key", F.lit(name).alias("list"), by.alias("approved_by"))
    clear = stores.cleared(newest).withColumnRenamed("entity_id", "key")
    return rows(stores.accepted(newest), "accepted").unionByName(rows(stores.ignored_keys(newest), "ignored")).unionByName(rows(clear, "cleared", F.col("approved_by")))


@query(f"""WITH {LOG_SQL}, a AS (SELECT key, CASE t WHEN 'purchase' THEN 'accept' WHEN 'click' THEN 'accept' WHEN 'error' THEN 'escalate' ELSE 'ignore' END AS act FROM l)
SELECT c_custkey, coalesce(act, 'none') AS decision FROM customer LEFT JOIN a ON key = concat('e', c_custkey)""")
def q_candidate_decisions(spark, sf_dir):
    newest = stores.latest(decision_log(spark, sf_dir), "key", "ts", "event_id")
    found = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("e"), "c_custkey").alias("entity_id"), F.col("c_name").alias("surface"))
    return stores.with_decisions(found, newest).select("c_custkey", F.coalesce("reviewer_action", F.lit("none")).alias("decision"))


SNAPSHOTS_SQL = """o AS (SELECT c_custkey AS id, concat('alias-', c_custkey) AS ghost, c_custkey % 5 = 0 AS frozen FROM customer), n AS (SELECT s_suppkey AS id, concat('alias-', CASE WHEN s_suppkey % 5 = 0 AND {} THEN s_suppkey ELSE s_suppkey % 7 END) AS ghost FROM supplier)"""


def snapshots(spark, sf_dir, keep: bool):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("alias-"), "c_custkey").alias("ghost"), (F.col("c_custkey") % 5 == 0).alias("frozen"))
    n = F.when((F.col("s_suppkey") % 5 == 0) & F.lit(keep), F.col("s_suppkey")).otherwise(F.col("s_suppkey") % 7)
    return old, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("alias-"), n).alias("ghost"))


@query("WITH " + SNAPSHOTS_SQL.format("true") + """ SELECT coalesce(o.id, n.id) AS id, coalesce(n.ghost, o.ghost) AS ghost, CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'keep' ELSE 'update' END AS outcome FROM o FULL JOIN n ON o.id = n.id""")
def q_mapping_upsert(spark, sf_dir):
    return stores.upsert(*snapshots(spark, sf_dir, True), "id", "ghost", "frozen")


@query("WITH " + SNAPSHOTS_SQL.format("false") + " SELECT id, o.ghost AS held, n.ghost AS wanted FROM o JOIN n USING (id) WHERE o.frozen AND o.ghost <> n.ghost")
def q_mapping_conflicts(spark, sf_dir):
    return stores.conflicts(*snapshots(spark, sf_dir, False), "id", "ghost", "frozen")


@query("SELECT concat('e', s_suppkey) AS id, 'config' AS origin FROM supplier UNION ALL SELECT concat('e', c_custkey), 'mapping' FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def q_merged_entities(spark, sf_dir):
    own = table(spark, sf_dir, "supplier").select(F.concat(F.lit("e"), "s_suppkey").alias("id"), F.lit("config").alias("origin"), F.lit(1).alias("ord"))
    entries = table(spark, sf_dir, "customer").select(F.concat(F.lit("e"), "c_custkey").alias("entity_id"), F.lit("mapping").alias("origin"), F.lit(True).alias("frozen"))
    return config.with_mapping_only(own, entries).select("id", "origin")


FAULTY = """SELECT concat('e', c_custkey % 700) AS id, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END AS real, CASE c_custkey % 6 WHEN 0 THEN 'thing' WHEN 1 THEN 'secret' ELSE 'vendor' END AS kind,
CASE c_custkey % 5 WHEN 0 THEN 'secretive' WHEN 1 THEN 'public' ELSE 'restricted' END AS level, 'remove' AS strategy, CASE c_custkey % 3 WHEN 0 THEN 'seed' WHEN 1 THEN 'human' ELSE 'discovered' END AS source,
CASE WHEN c_custkey % 2 = 0 THEN 'me' END AS approved_by FROM customer"""


@query(f"""WITH e AS ({FAULTY}) SELECT id, fault, count(*) AS n FROM (SELECT id, 'the id is met twice' AS fault FROM e GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, 'no real' FROM e WHERE real = ''
UNION ALL SELECT id, concat('no such kind: ', kind) FROM e WHERE kind = 'thing' UNION ALL SELECT id, concat('no such level: ', level) FROM e WHERE level = 'secretive') GROUP BY ALL""")
def q_config_faults(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    rows = spark.sql(FAULTY).withColumn("match", F.lit(None).cast("array<struct<kind:string,value:string>>"))
    return config.faults(rows).groupBy("id", "fault").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH e AS ({FAULTY}) SELECT level, count(*) AS n, count(*) FILTER (level = 'restricted' AND source IN ('human', 'discovered') AND approved_by IS NULL) AS n_pending, count(*) FILTER (source = 'seed') AS n_seeds FROM e GROUP BY level""")
def q_config_summary(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    rows = spark.sql(FAULTY)
    more = lambda df, name: df.groupBy("level").agg(F.count(F.lit(1)).alias(name))
    out = config.by_level(rows).join(more(config.pending(rows), "n_pending"), "level", "left").join(more(config.seeds(rows), "n_seeds"), "level", "left")
    return out.na.fill(0, ["n_pending", "n_seeds"])


EDGES_SQL = """edges AS (SELECT DISTINCT concat('c', o_custkey) AS src, concat('o', o_orderkey) AS dst FROM orders
UNION SELECT DISTINCT concat('o', l_orderkey), concat('p', l_partkey) FROM lineitem UNION SELECT DISTINCT concat('p', l_partkey), concat('s', l_suppkey) FROM lineitem)"""


@query(f"""WITH RECURSIVE {EDGES_SQL}, w AS (SELECT concat('c', c_custkey) AS node, round(0.95::DOUBLE - c_custkey % 5 * 0.1::DOUBLE, 2) AS score, 0 AS hops FROM customer
UNION ALL SELECT e.dst, round(w.score * 0.85::DOUBLE, 4), w.hops + 1 FROM w JOIN edges e ON e.src = w.node WHERE w.hops < 3)
SELECT node, max(score) AS score, min(hops) AS hops FROM w GROUP BY node""")
def q_taint(spark, sf_dir):
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    edge = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), F.col(x)).alias("src"), F.concat(F.lit(b), F.col(y)).alias("dst"))
    parts = sinks.stored(edge(items.select("l_partkey", "l_suppkey").distinct(), "p", "l_partkey", "s", "l_suppkey"), "edges")  # many items a pair; the others hardly repeat
    edges = edge(orders, "c", "o_custkey", "o", "o_orderkey").unionByName(edge(items, "o", "l_orderkey", "p", "l_partkey")).unionByName(parts)
    seeds = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node"), scoring.rounded(0.95 - F.col("c_custkey") % 5 * 0.1, 2).alias("score"))
    return graph.taint(edges, seeds, named=False)


#: A document as the text of a template that stands in another one's code.
TEMPLATE_TEXT = "regexp_replace(text, '[`$\\\\{}]', '', 'g')"


@query(f"""WITH c AS (SELECT doc_id, {TEMPLATE_TEXT} AS t FROM documents WHERE text <> '')
SELECT doc_id, concat('const,d', doc_id, ',f,acme,r,it') AS names, md5(concat(t, t, 's')) AS strings_md5, CAST(length(t) + 15 + length(doc_id::VARCHAR) AS BIGINT) AS inner_start FROM c""")
def q_template_nodes(spark, sf_dir):
    """Documents within templates within templates: their text is a string, what stands in ${} is code, and quotes in patterns begin nothing."""
    clean = F.regexp_replace("text", r"[`$\\{}]", "")
    code = F.concat(F.lit("const d"), "doc_id", F.lit(" = `"), clean, F.lit("${ f(`"), clean, F.lit("${acme}`) / 2 / 's'.x }`; r = /['\"`]/; // it's\nit"))
    rows = table(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", source.placed_nodes(code).alias("n"))
    some = lambda kind: F.transform(F.filter("n", lambda n: n["kind"] == kind), lambda n: n["text"])
    names = F.filter(some("identifier"), lambda x: x != "x")
    inner = F.get(F.filter("n", lambda n: (n["kind"] == "identifier") & (n["text"] == "f")), 0)["start"]
    return rows.select("doc_id", F.array_join(names, ",").alias("names"), F.md5(F.array_join(some("string"), "")).alias("strings_md5"), (inner + 1).cast("long").alias("inner_start"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents),
e AS (SELECT doc_id, list_distinct(w) AS d, list_distinct(list_filter(list_transform(range(1, len(w)), lambda i: CASE WHEN w[i] <> w[i + 1] THEN concat(w[i], '_>', w[i + 1], '_ alias') END), lambda x: x IS NOT NULL)) AS pairs FROM w WHERE len(w) > 0),
a AS (SELECT doc_id, pairs || list_transform(d, lambda x: concat('env:', x, '>member:m.', x, ' env')) || list_transform(d, lambda x: concat('process>member:m.', x, ' expr')) || list_transform(d, lambda x: concat('member:m.', x, '>m member-of')) AS flow FROM e)
SELECT doc_id, CAST(len(flow) AS BIGINT) AS n_edges, md5(array_to_string(list_sort(flow), ',')) AS edges_md5 FROM a""")
def q_code_edges(spark, sf_dir):
    """Documents as code: each word is assigned to the next one, and taken from the surroundings into a member."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    rows = dealt(spark, sf_dir, "documents", "doc_id").filter(F.col("text").rlike("[A-Za-z]")).select("doc_id", words.alias("w"))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat(b, F.lit("_ = "), a, F.lit("_")))
    members = F.transform(F.array_distinct("w"), lambda x: F.concat(F.lit("m."), x, F.lit(" = process.env."), x))
    flow = source.edges(F.array_join(F.concat(pairs, members), "\n"))
    shown = F.transform(flow, lambda e: F.concat(e["src"], F.lit(">"), e["dst"], F.lit(" "), e["kind"]))
    return rows.select("doc_id", flow.alias("flow"), shown.alias("shown")).select("doc_id", F.size("flow").cast("long").alias("n_edges"), F.md5(F.array_join(F.sort_array("shown"), ",")).alias("edges_md5"))


@query("""SELECT p_partkey, concat('Meridian Brand|', replace(p_name, ' ', '-'), '|M', p_partkey, '/', p_name, '|x', p_size) AS items FROM part""")
def q_alias_enum(spark, sf_dir):
    doc = F.concat(
        F.lit("/* known internally as: - Meridian "), F.regexp_replace("p_brand", "#", "#"), F.lit("\n * - "), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("\n * - M"), "p_partkey", F.lit(".\n * - for them all\n\n also: aka\n- "),
        "p_name", F.lit("\n- this is no name\n- x"), "p_size", F.lit("\n\nAliases: - one alone"),
    )
    groups = F.transform(text.alias_groups(doc), lambda g: F.array_join(g, "|"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(groups, "/").alias("items"))


@query("SELECT c_custkey, concat('owner ', c_name, ' end ', lpad(CAST(c_custkey AS STRING), 8, '0')) AS plain FROM customer")
def q_decode_base64(spark, sf_dir):
    plain = F.concat(F.lit("owner "), F.col("c_name"), F.lit(" end "), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    doc = F.concat(F.lit("const k = '"), F.regexp_replace(F.base64(plain.cast("binary")), "[\r\n]", ""), F.lit("';"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.get(text.decoded_base64(doc), 0).alias("plain"))


@query("SELECT s_suppkey, concat('sky_route_', s_suppkey) AS joined, concat('skyroute', s_suppkey) AS concatenated FROM supplier")
def q_decode_join(spark, sf_dir):
    k = F.col("s_suppkey")
    joined = F.concat(F.lit("x = ['sky', 'route', '"), k, F.lit("'].join('_');"))
    added = F.concat(F.lit("x = 'sky' + 'route' + '"), k, F.lit("';"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.get(text.folded_joins(joined), 0).alias("joined"), F.get(text.folded_concats(added), 0).alias("concatenated"))


@query("SELECT s_suppkey, concat('sky_route_', s_suppkey, '|it''s-', s_suppkey) AS joined, concat('skyroute', s_suppkey, '|a\"b', s_suppkey) AS concatenated FROM supplier")
def q_decode_quotes(spark, sf_dir):
    """Either quotes, mixed, and white space where the language allows it."""
    k = F.col("s_suppkey")
    joined = F.concat(F.lit('x = ["sky", \'route\', "'), k, F.lit('"] . join( "_" ); y = [ "it\'s", \''), k, F.lit("', ].join('-')"))
    added = F.concat(F.lit('x = "sky" + \'route\'\n  + "'), k, F.lit('"; y = \'a"b\'+"'), k, F.lit('";'))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(text.folded_joins(joined), "|").alias("joined"), F.array_join(text.folded_concats(added), "|").alias("concatenated"))


@query("""WITH s AS (SELECT user_id AS grp, event_type AS name, max(round(abs(value) / 300, 3)) AS w FROM events GROUP BY ALL)
SELECT grp, arg_max(name, (w, name)) AS strongest, count(*) AS n_signals, max(w) AS weight FROM s GROUP BY grp""")
def q_candidate_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("grp"), F.col("event_type").alias("name")).agg(F.max(scoring.rounded(F.abs("value") / 300, 3)).alias("w"))
    return rows.groupBy("grp").agg(F.max_by("name", F.struct("w", "name")).alias("strongest"), F.count(F.lit(1)).alias("n_signals"), F.max("w").alias("weight"))


@query("""WITH found AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_quantity >= 50), want AS (SELECT s_suppkey AS id FROM supplier)
SELECT (SELECT count(*) FROM want) AS n_expected, (SELECT count(*) FROM want WHERE id IN (SELECT id FROM found)) AS n_found, round((SELECT count(*) FROM want WHERE id IN (SELECT id FROM found)) / (SELECT count(*) FROM want), 3) AS recall""")
def q_recall(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").filter("l_quantity >= 50").select(F.col("l_suppkey").alias("id")).distinct().withColumn("hit", F.lit(1))
    want = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return want.join(found, "id", "left").agg(F.count(F.lit(1)).alias("n_expected"), F.count("hit").alias("n_found"), scoring.rounded(F.count("hit") / F.count(F.lit(1)), 3).alias("recall"))


PROBES_AT_ONCE = 2_000


@query("""WITH q AS (SELECT vec_id AS probe, embedding AS q FROM embeddings WHERE vec_id % 100 = 0)
SELECT probe, vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_dot_product(CAST(q AS DOUBLE[]), CAST(q AS DOUBLE[]))), 4) AS similarity
FROM embeddings, q WHERE vec_id <> probe QUALIFY row_number() OVER (PARTITION BY probe ORDER BY similarity DESC, vec_id) <= 10""")
def q_embedding_similarity(spark, sf_dir):
    """The ten vectors most like each probe (every id divisible by 100), against all vectors, probes in blocks of bounded size."""
    rows = table(spark, sf_dir, "embeddings")
    return scoring.most_similar(rows.filter("vec_id % 100 = 0"), rows, "vec_id", "embedding", 10, PROBES_AT_ONCE)


TARGETS = ("large brushed copper", "small polished steel", "red widget")


@query(f"""WITH t AS (SELECT p_partkey, lower(p_name) AS n, unnest([{', '.join(f"'{t}'" for t in TARGETS)}]) AS q FROM part),
g AS (SELECT p_partkey, list_distinct([substr(n, i, 3) FOR i IN range(1, length(n) - 1)]) AS a, list_distinct([substr(q, i, 3) FOR i IN range(1, length(q) - 1)]) AS b FROM t),
s AS (SELECT p_partkey, max(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / sqrt(CAST(len(a) AS DOUBLE) * len(b)) ELSE 0.0 END) AS m FROM g GROUP BY p_partkey)
SELECT p_partkey, round(m, 4) AS similarity, CASE WHEN least(round(m * 0.5, 4), 0.45) >= 0.15 THEN least(round(m * 0.5, 4), 0.45) ELSE 0.0 END::DOUBLE AS weight FROM s""")
def q_trigram_similarity(spark, sf_dir):
    best = F.greatest(*[scoring.trigram_cosine(F.col("p_name"), F.lit(t)) for t in TARGETS])
    rows = table(spark, sf_dir, "part").select("p_partkey", best.alias("similarity"))
    return rows.select("p_partkey", scoring.rounded(F.col("similarity"), 4).alias("similarity"), scoring.semantic_weight(F.col("similarity")).alias("weight"))


#: Names and aliases of the profiles that surfaces are held against.
FUZZY_NAMES = [("finish_lbc", "large brushed copper"), ("finish_lbc", "large brushed copper fittings"), ("finish_sps", "small polished steel")]


@query()
def q_fuzzy(spark, sf_dir):
    profiles = F.array(*[F.struct(F.lit(i).alias("entity_id"), F.lit(t).alias("target")) for i, t in FUZZY_NAMES])
    names = table(spark, sf_dir, "part").select("p_name").distinct().select("p_name", F.inline(profiles))
    names = names.withColumn("ratio", fuzzy_ratios()("p_name", "target")).groupBy("p_name", "entity_id").agg(F.max("ratio").alias("ratio"))
    return names.withColumn("weight", scoring.fuzzy_weight(F.col("ratio")))


DIFF_SQL = "l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), d AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM l)"


def document_diffs(spark, sf_dir):
    """Every document as a diff of one file whose lines are by turns kept, taken out and put in; doc_id, n, line."""
    tag = F.element_at(F.array(F.lit(" "), F.lit("-"), F.lit("+")), (F.col("i") % 3 + 1).cast("int"))
    body = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", (F.col("i") + 4).alias("n"), F.concat(tag, "line").alias("line"))
    heads = ["diff --git a/que.js b/que.js", "--- a/que.js", "+++ b/que.js", "@@ -1 +1 @@ que"]
    head = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.array(*map(F.lit, heads))).alias("n", "line"))
    return head.unionByName(body)


@query(f"WITH {DIFF_SQL} SELECT doc_id, CAST(i + 4 AS INT) AS n, CASE i % 3 WHEN 0 THEN ' ' WHEN 1 THEN '-' ELSE '+' END AS tag, md5(line) AS content, CAST(1 AS BIGINT) AS hunk_idx, false AS is_new FROM d")
def q_diff_parse(spark, sf_dir):
    rows = files.diff_lines(document_diffs(spark, sf_dir), "doc_id", "n", "line").filter("tag is not null")
    return rows.select("doc_id", "n", "tag", F.md5("content").alias("content"), "hunk_idx", "is_new")


@query("""WITH e AS (SELECT user_id, event_id, ts, greatest(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 1) AS episode FROM events)
SELECT user_id, event_id, CAST(episode AS BIGINT) AS episode, round((epoch_us(ts) - epoch_us(first_value(ts) OVER (PARTITION BY user_id, episode ORDER BY ts, event_id))) / 1e6, 1) AS elapsed FROM e""")
def q_episode_clock(spark, sf_dir):
    order = ["ts", "event_id"]
    rows = stores.episodes(table(spark, sf_dir, "events"), "user_id", order, F.col("event_type") == "purchase")
    return stores.episode_clock(rows, ["user_id", "episode"], order, "ts").select("user_id", "event_id", F.col("episode").cast("long").alias("episode"), "elapsed")


@query("""WITH RECURSIVE free AS (SELECT b.p_brand, i, CASE WHEN i < 26 THEN chr(CAST(97 + i AS INT)) ELSE CAST(i - 25 AS STRING) END AS suffix FROM (SELECT DISTINCT p_brand FROM part) AS b, range(0, 6000) AS r(i)),
taken AS (SELECT DISTINCT p_brand, CASE WHEN p_size < 26 THEN chr(CAST(97 + p_size AS INT)) ELSE CAST(p_size - 25 AS STRING) END AS suffix FROM part WHERE p_size % 2 = 0),
f AS (SELECT p_brand, suffix, row_number() OVER (PARTITION BY p_brand ORDER BY i) AS n FROM free ANTI JOIN taken USING (p_brand, suffix)), p AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)
SELECT p_partkey, concat(p_brand, '-', suffix) AS alias FROM p JOIN f USING (p_brand, n)""")
def q_alias_allocation(spark, sf_dir):
    """Aliases for all parts by brand, past those that are taken already."""
    parts = table(spark, sf_dir, "part")
    taken = parts.filter("p_size % 2 = 0").select(F.concat("p_brand", F.lit("-"), stores.letter_suffix(F.col("p_size"))).alias("alias"))
    return stores.allocated(parts.select("p_partkey", "p_brand"), "p_brand", "p_partkey", taken=taken).select("p_partkey", "alias")


@query("""WITH s AS (SELECT p_partkey, concat('disc_', p_size) AS base FROM part), t AS (SELECT concat('disc_', p_size) AS id FROM part WHERE p_size % 7 = 0 UNION SELECT concat('disc_', p_size, '_', p_size % 4 + 2) FROM part),
c AS (SELECT base, i, CASE WHEN i = 1 THEN base ELSE concat(base, '_', i) END AS id FROM (SELECT DISTINCT base FROM s), range(1, 6000) AS r(i)),
f AS (SELECT base, id, row_number() OVER (PARTITION BY base ORDER BY i) AS n FROM c ANTI JOIN t USING (id)), p AS (SELECT p_partkey, base, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS n FROM s)
SELECT p_partkey, id AS unique_id FROM p JOIN f USING (base, n)""")
def q_unique_ids(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    rows = parts.select("p_partkey", F.concat(F.lit("disc_"), F.col("p_size")).alias("base"))
    taken = parts.filter("p_size % 7 = 0").select(F.concat(F.lit("disc_"), F.col("p_size")).alias("unique_id")).unionByName(parts.select(F.concat(F.lit("disc_"), F.col("p_size"), F.lit("_"), F.col("p_size") % 4 + 2).alias("unique_id")))
    return stores.unique_ids(rows, "base", "p_partkey", taken=taken).select("p_partkey", "unique_id")


@query("""SELECT c_custkey, concat('sha256:', sha256(c_name)) AS key, substr(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 28) AS slug FROM customer""")
def q_hash_slug(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.surface_key(F.col("c_name")).alias("key"), text.slug(F.col("c_name")).alias("slug"))


@query(r"""WITH f AS (SELECT page_id, concat(regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1), '.', ['js', 'tsx', 'TF', 'md', 'png', 'json', 'ts'][page_id % 7 + 1]) AS file FROM pages)
SELECT page_id, ['javascript', 'tsx', 'hcl', 'scoped', 'opaque', 'scoped', 'typescript'][page_id % 7 + 1] AS lang, file LIKE '%/en/%' OR file LIKE 'en/%' OR file LIKE '%.md' OR regexp_matches(file, '(^|/)[0-3][^/]*\.png$') AS excluded FROM f""")
def q_language_router(spark, sf_dir):
    end = F.element_at(F.array(*map(F.lit, ("js", "tsx", "TF", "md", "png", "json", "ts"))), (F.col("page_id") % 7 + 1).cast("int"))
    file = F.concat(F.regexp_extract("url", "^[a-z]+://[^/]*/([^?#]*)", 1), F.lit("."), end)
    return table(spark, sf_dir, "pages").select("page_id", files.language(file).alias("lang"), files.excluded(file, ["*/en/*", "*.md", "[0-3]*.png"]).alias("excluded"))


@query("""WITH k AS (SELECT user_id % 50 AS surface, event_type AS layer, round(abs(value) / 400, 3) AS w FROM events),
m AS (SELECT surface, layer, max(w) AS w FROM k GROUP BY ALL), g AS (SELECT surface, list_sort(list(least(w, 1.0))) AS ws, count(*) AS n_layers FROM m GROUP BY surface)
SELECT surface, n_layers, CASE WHEN list_max(ws) >= 1 THEN 1.0 ELSE round(1.0 - list_reduce(list_prepend(CAST(1.0 AS DOUBLE), list_filter(ws, lambda x: x > 0)), lambda a, x: a * (1.0::DOUBLE - x)), 4) END AS score FROM g WHERE surface % 10 <> 0""")
def q_screen_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("surface"), F.col("event_type").alias("layer"), scoring.rounded(F.abs("value") / 400, 3).alias("w"))
    known = spark.range(0, 50, 10).select(F.col("id").alias("surface"))  # ghosts that are known already
    merged = rows.groupBy("surface", "layer").agg(F.max("w").alias("w")).groupBy("surface").agg(F.collect_list("w").alias("ws"), F.count(F.lit(1)).alias("n_layers"))
    return merged.join(F.broadcast(known), "surface", "left_anti").select("surface", "n_layers", scoring.noisy_or(F.col("ws")).alias("score"))


@query(f"WITH {DECISIONS_SQL} SELECT user_id, action, n_records FROM d")
def q_stream_latest(spark, sf_dir):
    stream = logs.parquet_stream(spark, sf_dir, "events.parquet")
    rows = logs.latest_per_key(stream, "user_id", "event_type", "ts", "event_id")
    return logs.drained(spark, rows, "stream_latest", "complete").withColumnRenamed("event_type", "action")


@query("""WITH e AS (SELECT user_id, event_id, ts, greatest(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 1) AS episode FROM events WHERE ts IS NOT NULL),
w AS (SELECT max(epoch_us(ts)) // 1000 - 3600000 AS watermark FROM events)
SELECT user_id, event_id, ts, CAST(episode AS BIGINT) AS episode FROM e, w WHERE (epoch_us(ts) // 3600000000 + 1) * 3600000 <= watermark""")
def q_stream_episodes(spark, sf_dir):
    """Episodes as the watermark settles them, hour by hour; the last hour's events still wait when the stream has read all."""
    stream = logs.parquet_stream(spark, sf_dir, "events.parquet")
    kind = stream.schema["ts"].dataType.simpleString()
    rows = logs.streamed_episodes(stream, "user_id", "ts", F.col("event_type") == "purchase", tie="event_id")
    return logs.drained(spark, rows, "stream_episodes", rocksdb=True).select("user_id", "event_id", F.col("ts").cast(kind).alias("ts"), "episode")


@query("""WITH w AS (SELECT max(epoch_us(ts)) // 1000 - 7200000 AS watermark FROM events), h AS (SELECT epoch_us(ts) // 3600000000 AS hour, event_type AS action FROM events WHERE ts IS NOT NULL)
SELECT hour, action, count(*) AS n FROM h, w WHERE (hour + 1) * 3600000 <= watermark GROUP BY hour, action""")
def q_stream_windows(spark, sf_dir):
    """Events by hour and kind, of the hours that the watermark has closed."""
    stream = logs.parquet_stream(spark, sf_dir, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = logs.counts_by_window(stream, "ts", "event_type")
    done = logs.drained(spark, rows.select((F.unix_seconds("window.start") / 3600).cast("long").alias("hour"), F.col("event_type").alias("action"), "n"), "stream_windows")
    return done


@query(f"""WITH {DOC_SHAPES_SQL}, w AS (SELECT doc_id, {WEIGHTS_SQL} AS w FROM h), g AS (SELECT doc_id, list_sort(list(w)) AS ws, count(*) AS n_hits FROM w GROUP BY doc_id),
s AS (SELECT doc_id, n_hits, round(1.0 - list_reduce(list_prepend(CAST(1.0 AS DOUBLE), ws), lambda a, x: a * (1.0::DOUBLE - x)), 4) AS score FROM g)
SELECT doc_id, coalesce(n_hits, 0) AS n_hits, coalesce(score, 0.0) AS score, coalesce(score, 0.0) >= 0.3 AS blocked FROM documents LEFT JOIN s USING (doc_id)""")
def q_stream_screen(spark, sf_dir):
    stream = logs.screened(logs.parquet_stream(spark, sf_dir, "documents.parquet"))
    return logs.drained(spark, stream.select("doc_id", F.size("hits").cast("long").alias("n_hits"), "score", "blocked"), "stream_screen")


#: Aliases on their way back: entity, ghost, real, identifier.
MAPPING = "SELECT * FROM VALUES ('v1', 'vendor-a', 'Sky Route', 'skyRoute'), ('v2', 'vendor-ab', 'Meridian', NULL), ('s1', 'service-a', 'bookingCore', NULL), ('x', '', 'gone', NULL) AS m(entity_id, ghost, real, identifier)"
WORDS = "SELECT * FROM VALUES ('w1', 'que', 'client$b', NULL), ('w2', 'the', 'vendor-a', NULL) AS m(entity_id, ghost, real, identifier)"


def mapping_rules(spark, sql):
    return restore.unambiguous(restore.reverse_rules(spark.sql(sql)))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\bque\b', 'client$b', 'g'), '\bthe\b', 'vendor-a', 'g')) AS restored_md5 FROM documents""")
def q_reverse_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(restore.restored(F.col("text"), mapping_rules(spark, WORDS), casings=False)).alias("restored_md5"))


@query("SELECT s_suppkey, concat('use Sky Route, Meridian and Sky Route; skyRouteUrl', s_suppkey, ' SKY_ROUTE_KEY x_vendor-ac bookingCore') AS restored FROM supplier")
def q_reverse_translate(spark, sf_dir):
    text_ = F.concat(F.lit("use vendor-a, vendor-ab and Vendor A; vendorAUrl"), F.col("s_suppkey"), F.lit(" VENDOR_A_KEY x_vendor-ac serviceA"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", restore.restored(text_, mapping_rules(spark, MAPPING)).alias("restored"))


RESTORE_SQL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\bque\b', 'client$b', 'g'), '\bthe\b', 'vendor-a', 'g'), '\bQue\b', 'ClientB', 'g'), '\bThe\b', 'VendorA', 'g'), '\bQUE\b', 'CLIENT-B', 'g'), '\bTHE\b', 'VENDOR-A', 'g')"


@query(f"""WITH {DIFF_SQL}, h AS (SELECT doc_id, unnest(['diff --git a/client$b.js b/client$b.js', '--- a/client$b.js', '+++ b/client$b.js', '@@ -1 +1 @@ que']) AS line, unnest([0, 1, 2, 3]) AS n FROM documents)
SELECT doc_id, CAST(n AS INT) AS n, md5(line) AS restored FROM h UNION ALL SELECT doc_id, CAST(i + 4 AS INT), md5(concat(CASE i % 3 WHEN 0 THEN ' ' WHEN 1 THEN '-' ELSE '+' END, {RESTORE_SQL.format("line")})) FROM d""")
def q_diff_reversal(spark, sf_dir):
    return restore.restored_lines(document_diffs(spark, sf_dir), "line", mapping_rules(spark, WORDS)).select("doc_id", "n", F.md5("restored").alias("restored"))


@query("SELECT doc_id, CAST(1 AS BIGINT) AS n_files, CAST(1 AS BIGINT) AS n_hunks FROM documents")
def q_diff_sizes(spark, sf_dir):
    return restore.diff_sizes(document_diffs(spark, sf_dir), "doc_id", "line")


@query("""SELECT s_suppkey AS file, t.number, t.tag, CASE WHEN t.tag = '+' THEN 'new bookingCore' WHEN s_suppkey % 2 = 0 THEN concat('real ', t.number + 1, ' of ', s_suppkey) ELSE 'old bookingCore' END AS restored
FROM supplier, (VALUES (1, ' '), (2, '-'), (3, '+'), (4, ' ')) AS t(number, tag) WHERE NOT (s_suppkey % 2 = 0 AND t.number = 4)
UNION ALL SELECT s_suppkey, 4, ' ', concat('real 4 of ', s_suppkey) FROM supplier WHERE s_suppkey % 2 = 0""")
def q_anchored_replay(spark, sf_dir):
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"))
    changes = keys.select("file", F.posexplode(F.array(*map(F.lit, " -+ "))).alias("number", "tag")).withColumn("number", F.col("number") + 1)
    content = F.when(F.col("tag") == "+", "new service-a").otherwise("old service-a")
    changes = changes.select("file", "number", F.lit(1).alias("hunk"), F.lit(2).alias("old_start"), "tag", content.alias("content"))
    public = keys.select("file", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("n")).withColumn("line", F.lit("x"))
    real = keys.select("file", F.explode(F.sequence(F.lit(1), (F.lit(5) + F.col("file") % 2).cast("int"))).alias("n"))
    real = real.withColumn("line", F.concat(F.lit("real "), F.col("n"), F.lit(" of "), F.col("file")))
    return restore.replayed(changes, public, real, mapping_rules(spark, MAPPING)).select("file", "number", "tag", "restored")


@query("""SELECT doc_id, CASE WHEN length(text) > 600 THEN concat(substr(text, 1, 600), '[+', length(text) - 600, ' chars]') ELSE text END AS clipped FROM documents""")
def q_clipped_log(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sinks.clipped(F.col("text")).alias("clipped"))


@query("SELECT c_custkey, 'op_000000000000' AS operation_id, 'veilspark' AS component, 'spark' AS actor, 'seen' AS event, sha256(c_name) AS real_sha256 FROM customer")
def q_audit_events(spark, sf_dir):
    return sinks.audit_events(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", "seen")


SOURCE = ("'v1', 'skyRoute', 'vendor', 'internal', 'semantic_alias', 'vendor-a', 'seed', 'identifier:sky-route'", "'s1', 'booking-core', 'internal_service', 'internal', 'semantic_alias', 'service-a', 'seed', ''")


def source_rules(spark):
    return rules.taken(rules.rules(configured(spark, *SOURCE)))


@query("""SELECT s_suppkey, concat('import x from "@skyRoute/sdk";\nimport y from "./vendorA";\n// VendorA ', s_suppkey, '\nconst vendorA = SERVICE_A_URL + f_', s_suppkey, '(''service-a \\'' // VENDOR_A_KEY''); /* vendor-a\n*/ a-serviceA myServiceA') AS rewritten, '@skyRoute/sdk' AS kept, CAST(9 AS BIGINT) AS n_rewritten FROM supplier""")
def q_source_rewrite(spark, sf_dir):
    k = F.col("s_suppkey")
    code = F.concat(F.lit('import x from "@skyRoute/sdk";\nimport y from "./skyRoute";\n// SkyRoute '), k, F.lit("\nconst skyRoute = BOOKING_CORE_URL + f_"), k, F.lit("('booking-core \\' // SKY_ROUTE_KEY'); /* sky-route\n*/ a-bookingCore myBookingCore"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", rules.transformed(source.nodes(code), source_rules(spark)).alias("done"))
    hits = rules.all_hits(F.col("done"))
    kept = F.array_distinct(F.transform(F.filter(hits, lambda h: h["kept"]), lambda h: h["specifier"]))
    return rows.select("s_suppkey", rules.joined(F.col("done")).alias("rewritten"), F.array_join(kept, ",").alias("kept"), F.size(F.filter(hits, lambda h: ~h["kept"])).cast("long").alias("n_rewritten"))


@query("""SELECT doc_id, md5(text) AS text_md5 FROM documents""")
def q_source_nodes_whole(spark, sf_dir):
    """Lexing loses nothing: the pieces of every text make it up."""
    rows = dealt(spark, sf_dir, "documents", "doc_id").select("doc_id", source.nodes(F.col("text"), hash_comments=True).alias("nodes"))
    return rows.select("doc_id", F.md5(F.array_join(F.transform("nodes", lambda n: n["text"]), "")).alias("text_md5"))


@query("""SELECT s_suppkey, concat('{"name": "service-a", "dependencies": {"@x/booking-core": "^', s_suppkey, '", "b": "file:service-a"}, "scripts": {"vendorA": "y"}, "overrides" : { "a": {"booking-core": "service-a"}, "skyRoute": "1" } }') AS rewritten, '@x/booking-core,booking-core,skyRoute' AS kept FROM supplier""")
def q_package_rewrite(spark, sf_dir):
    text_ = F.concat(F.lit('{"name": "booking-core", "dependencies": {"@x/booking-core": "^'), F.col("s_suppkey"), F.lit('", "b": "file:booking-core"}, "scripts": {"skyRoute": "y"}, "overrides" : { "a": {"booking-core": "booking-core"}, "skyRoute": "1" } }'))
    done = rules.transformed(source.package_nodes(text_), source_rules(spark))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", done.alias("done"))
    kept = F.transform(F.filter(rules.all_hits(F.col("done")), lambda h: h["kept"]), lambda h: h["specifier"])
    return rows.select("s_suppkey", rules.joined(F.col("done")).alias("rewritten"), F.array_join(kept, ",").alias("kept"))


@query(f"""WITH l AS (SELECT doc_id, {TRANSFORM_SQL} AS out, text FROM documents) SELECT count(*) AS n_scanned, count(*) FILTER (out <> text) AS n_changed, count(*) FILTER (doc_id % 2 = 0) AS n_renamed FROM l""")
def q_file_counters(spark, sf_dir):
    """Documents as text files, half of which have a name that is rewritten."""
    found = rules.taken(rules.rules(configured(spark, *PROSE)))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.when(F.col("doc_id") % 2 == 0, "src/the_").otherwise("src/"), F.col("doc_id"), F.lit(".md")).alias("file"), "text")
    nodes = source.file_nodes(F.col("file"), files.language(F.col("file")), F.col("text"))
    return rules.counters(rules.compiled(docs, found, nodes)).drop("n_hits")


@query(f"""WITH o AS (SELECT doc_id, {TRANSFORM_SQL} AS out FROM documents) SELECT doc_id, len(regexp_extract_all(out, '\\bCC BY\\b|\\bThe\\b')) > 0 AS rejected, md5(CASE WHEN len(regexp_extract_all(out, '\\bCC BY\\b|\\bThe\\b')) = 0 THEN out END) AS out_md5 FROM o""")
def q_task_compile(spark, sf_dir):
    """Documents as tasks; whichever still holds a spelling after rewriting is rejected and has no text."""
    found = rules.taken(rules.rules(configured(spark, *PROSE)))
    rows = compiling.tasks(table(spark, sf_dir, "documents").select("doc_id", "text"), found, ["CC BY", "The"])
    return rows.select("doc_id", "rejected", F.md5("out").alias("out_md5"))


@query("""WITH c AS (SELECT p_name AS surface, count(*) AS n FROM part GROUP BY p_name HAVING count(*) >= 2), o AS (SELECT surface, row_number() OVER (ORDER BY surface) AS n FROM c)
SELECT concat('disc_', replace(surface, ' ', '_')) AS id, concat('vendor-', CASE WHEN n + 1 <= 26 THEN chr(CAST(96 + n + 1 AS INT)) ELSE CAST(n + 1 - 26 AS STRING) END) AS ghost, concat('identifier:', upper(replace(surface, ' ', '_')), '|literal:', upper(surface)) AS match FROM o""")
def q_minted_entities(spark, sf_dir):
    """Names of several parts as sure proposals, beside one entity that has the first alias."""
    seen = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("surface")).agg(F.count(F.lit(1)).alias("n"))
    found = seen.select(
        "surface", F.lit("vendor").alias("kind"), F.lit(None).cast("string").alias("level"), F.lit(None).cast("string").alias("entity_id"), F.when(F.col("n") >= 2, "auto").otherwise("review").alias("action"),
        F.array(F.upper(F.replace("surface", F.lit(" "), F.lit("_"))), F.upper("surface"), "surface").alias("spellings"),
    )
    match = F.array_join(F.transform("match", lambda m: F.concat(m["kind"], F.lit(":"), m["value"])), "|")
    return compiling.minted(found, configured(spark, *PROSE[:1])).select("id", "ghost", match.alias("match"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN concat('e', user_id) ELSE concat('sha256:', sha256(event_type)) END AS key, CASE WHEN event_id % 3 = 0 THEN 'restricted' ELSE 'internal' END AS level FROM events""")
def q_decision_records(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("surface"), F.lit(None).cast("string").alias("key"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("e"), F.col("user_id"))).alias("entity_id"),
        F.lit(None).cast("string").alias("level"), F.lit("internal").alias("proposed_level"), F.when(F.col("event_id") % 3 == 0, "escalate").otherwise("accept").alias("reviewer_action"),
    )
    return stores.decision_records(rows).select("event_id", "key", "level")


EMAIL_SQL = "m AS (SELECT doc_id AS file, unnest(regexp_extract_all(text, '" + SHAPES_RE2["email"] + "')) AS surface FROM documents)"


@query(f"""WITH {HITS_SQL}, {EMAIL_SQL}
SELECT entity_id AS grp, entity_id, min(spelling) AS representative, 1.0::DOUBLE AS score, CASE WHEN min(level) = 'restricted' THEN 'review' ELSE 'auto' END AS action, 'exact' AS evidence, count(*) AS n_occurrences, count(DISTINCT file) AS n_files
FROM hits JOIN e USING (spelling) GROUP BY entity_id UNION ALL
SELECT lower(surface), NULL, arg_min(surface, (-length(surface), surface)), 0.363, 'ignore', 'structural shape + weak / no evidence', count(*), count(DISTINCT file) FROM m GROUP BY lower(surface) HAVING count(*) >= 2""")
def q_discover(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    one = lambda name, weight: F.array(detect.signal(name, F.lit(weight)))
    file = F.col("doc_id").cast("string").alias("file")
    known = entity_hits(spark, sf_dir).select(F.col("entity_id").alias("grp"), "entity_id", "spelling", "level", F.col("file").cast("string").alias("file"), F.col("spelling").alias("surface"), F.lit("code").alias("kind"), one("exact", 1.0).alias("signals"))
    none, surface = F.lit(None).cast("string"), F.explode(F.regexp_extract_all("text", F.lit(text.shape_pattern("email")), F.lit(0))).alias("surface")
    shapes = docs.select(file, surface).select(F.lower("surface").alias("grp"), none.alias("entity_id"), none.alias("spelling"), F.lit("internal").alias("level"), "file", "surface", F.lit("code").alias("kind"), one("shape", 0.35).alias("signals"))
    return discover.candidates(known.unionByName(shapes))


#: Entities of the source-like lines of suppliers.
SHOP = (
    "'v_sky', 'Sky Route', 'vendor', 'internal', 'semantic_alias', 'vendor-a', 'seed', 'identifier:skyRoute|literal:SKR'",
    "'s_book', 'bookingCore', 'internal_service', 'confidential', 'semantic_alias', 'service-a', 'seed', ''",
    "'c_mas', 'Meridian Aero Systems', 'client', 'restricted', 'synthetic_id', 'client-a', 'seed', 'identifier:meridian'",
)
#: A small source file for each supplier, with names in many disguises.
SHOP_CODE = (
    "concat('// partner of Sky Route, also known as: - Halcyon ', s_suppkey, '\n// - HALX\n\nimport sdk from \"@brandex', s_nationkey, '/core\";\nconst skyRouteUrl = \"https://flights.halcyon.internal/v', s_suppkey % 3, '\";\n',"
    " 'const client = bookingCore;\nlet handle', s_nationkey, ' = client;\nconst key = ', chr(39), 'merid', chr(39), ' + ', chr(39), 'ian_', chr(39), ' + ', chr(39), s_suppkey, chr(39), ';\nconst t = \"tenant-halcyon-', s_nationkey, '\"; // MAS owner ops', s_suppkey, '@halcyon.example\n', 'const meridianBase = load(\"Sky Rout\");\n')"
)


def shop_files(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("src/s"), F.col("s_suppkey"), F.lit(".js")).alias("file"), F.expr(SHOP_CODE).alias("text"))


@query()
def q_detect(spark, sf_dir):
    """The whole detector: all signals over a source file for each supplier, rolled up to candidates."""
    found = detect.occurrences(shop_files(spark, sf_dir), configured(spark, *SHOP), files.language(F.col("file")))
    return discover.candidates(found)


@query(f"""WITH {DOC_SHAPES_SQL}, k AS (SELECT doc_id, hit, max({WEIGHTS_SQL}) AS w, min(CASE kind WHEN 'email' THEN 'person' WHEN 'internal_host' THEN 'domain' WHEN 'scoped_npm_package' THEN 'vendor' WHEN 'rfc1918_ip' THEN 'infra_identifier' WHEN 'aws_account_id' THEN 'infra_identifier'
WHEN 'contract_id' THEN 'infra_identifier' WHEN 'tenant_id' THEN 'infra_identifier' ELSE 'secret' END) AS kind FROM h GROUP BY ALL), a AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\bder\\b|\\bque\\b')) AS hit FROM documents),
s AS (SELECT doc_id, hit AS surface, kind, CASE kind WHEN 'person' THEN 'restricted' WHEN 'secret' THEN 'restricted' WHEN 'vendor' THEN 'internal' ELSE 'confidential' END AS level, w AS score, 'structural shape' AS evidence FROM k
UNION ALL SELECT DISTINCT doc_id, hit, CASE hit WHEN 'der' THEN 'client' ELSE 'vendor' END, CASE hit WHEN 'der' THEN 'restricted' ELSE 'internal' END, 0.75, 'anchor' FROM a)
SELECT doc_id, surface, kind, level, score, CASE WHEN surface = 'que' THEN 'ignore' WHEN score >= 0.45 OR level = 'restricted' THEN 'review' ELSE 'ignore' END AS action, evidence, surface = 'que' AS suppressed FROM s WHERE surface NOT LIKE '%.org'""")
def q_screen(spark, sf_dir):
    """All documents as outbound text: shapes and two proposals, one of which a reviewer dismissed; known aliases are no findings."""
    return screen_findings(spark, sf_dir)


def screen_findings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    proposals = spark.sql("SELECT * FROM VALUES ('der', 'client', 'restricted'), ('que', 'vendor', 'internal') AS p(spelling, kind, level)")
    claims = spark.sql("SELECT CAST(NULL AS BIGINT) AS doc_id, '' AS surface, '' AS kind, 0.0D AS confidence")
    ghosts = docs.select(F.explode(F.regexp_extract_all("text", F.lit(text.shape_pattern("email")), F.lit(0))).alias("surface")).filter("surface like '%.org'")
    return screen.findings(docs, "doc_id", proposals, claims, ghosts, spark.sql("SELECT concat('sha256:', sha2('que', 256)) AS key"))


@query("""WITH a AS (SELECT doc_id, count(*) FILTER (hit = 'que') AS q, count(*) FILTER (hit = 'der') AS d FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\bder\\b|\\bque\\b')) AS hit FROM documents) GROUP BY doc_id)
SELECT doc_id, q > 0 AS suppressed, d > 0 AS anchored FROM a""")
def q_screen_decisions(spark, sf_dir):
    rows = screen.decisions(screen_findings(spark, sf_dir), "doc_id")
    return rows.withColumn("anchored", F.contains("evidence", F.lit("anchor"))).filter("suppressed > 0 or anchored").select("doc_id", (F.col("suppressed") > 0).alias("suppressed"), "anchored")


STORES = ['{"mapping_version": 3, "entries": []}', '{"entries": [{"real": "x", "real_sha256": "y"}]}', '[1, {"real": "x", "ghost": "g", "frozen": true}]', "real_sha256: y", '{"frozen": 1, "real": "x"}', '{"a": "mapping_version"}', "plain"]


@query("SELECT s_suppkey, s_suppkey % 7 < 4 AS leaks FROM supplier")
def q_mapping_leak(spark, sf_dir):
    doc = F.element_at(F.array(*map(F.lit, STORES)), (F.col("s_suppkey") % len(STORES) + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", gates.mapping_shaped(doc).alias("leaks"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'v1' ELSE '' END AS leaked, CASE s_suppkey % 3 WHEN 0 THEN 'SERVICE_Z' ELSE 'SERVICE_Z, serviceB' END AS unmapped FROM supplier WHERE s_suppkey % 3 < 2""")
def q_patch_checks(spark, sf_dir):
    ends = ["-serviceB\n+SERVICE_Z Sky Route", "+serviceB SERVICE_Z Sky Routes", "-SERVICE_Z Sky Route\n+services SERVICES"]
    doc = F.concat(F.lit("+++ b/Sky Route\n ctx service-a vendorA\n"), F.element_at(F.array(*map(F.lit, ends)), (F.col("s_suppkey") % 3 + 1).cast("int")))
    lines = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.split(doc, "\n")).alias("line"))
    return gates.patch_rejections(lines, "s_suppkey", "line", {"Sky Route": "v1", "Meridian": "v2"}, ["service-a", "vendor-a"], ["service", "vendor"])


@query("""SELECT s_suppkey, concat('host', s_suppkey) AS surface, 0.48::DOUBLE AS weight, true AS present FROM supplier UNION ALL SELECT s_suppkey, 'hos', 0.6, false FROM supplier""")
def q_claims(spark, sf_dir):
    k = F.col("s_suppkey")
    reply = F.concat(F.lit('Here: [{"surface": "host'), k, F.lit('", "confidence": 0.8}, {"surface": ""}, 7, {"surface": "hos", "confidence": 4}, {"surface": "host'), k, F.lit('"}] so far'))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("to host"), k, F.lit(".")).alias("text"), reply.alias("reply"))
    return gates.claim_weights(rows, "s_suppkey", "text", "reply")


SCREEN_SQL = "f AS (SELECT round(o_totalprice % 1000 / 1000, 4) AS score, o_orderstatus AS evidence, CASE WHEN o_totalprice % 1000 >= 450 OR o_custkey % 3 = 0 THEN 'review' ELSE 'ignore' END AS action FROM orders)"


@query(f"WITH {SCREEN_SQL} SELECT count(*) FILTER (action <> 'ignore') AS n_flagged, count(*) FILTER (action <> 'ignore') > 0 AS blocked, max(score) AS top_score, string_agg(DISTINCT evidence, '; ' ORDER BY evidence) FILTER (action <> 'ignore') AS evidence FROM f")
def q_screen_summary(spark, sf_dir):
    score = scoring.rounded(F.col("o_totalprice") % 1000 / 1000, 4)
    signals = F.array(F.struct(F.lit("shape").alias("name"), score.alias("weight")))
    level = F.when(F.col("o_custkey") % 3 == 0, "restricted").otherwise("internal")
    action = F.when(F.col("o_totalprice") % 1000 >= 450, "review").otherwise("ignore")
    return gates.screen_summary(table(spark, sf_dir, "orders").select(score.alias("score"), F.col("o_orderstatus").alias("evidence"), gates.floored(action, level, signals).alias("action")))


CASES_SQL = "c AS (SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS baseline, count(*) AS compile FROM part GROUP BY p_brand)"
GAIN_SQL = "CASE WHEN baseline <= 0 THEN '—' ELSE concat('-', baseline - compile, ' (', CAST(round_even(100 * (baseline - compile) / baseline, 0) AS BIGINT), '%)') END"


@query(f"""WITH {CASES_SQL} SELECT p_brand, {GAIN_SQL} AS gain, concat('| ', p_brand, ' | ', baseline, ' | ', compile, ' |') AS line, concat('"', p_brand, ', ""', baseline, '""', '"') AS field FROM c""")
def q_eval_report(spark, sf_dir):
    cases = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum("p_size").alias("baseline"), F.count(F.lit(1)).alias("compile"))
    field = F.concat("p_brand", F.lit(', "'), "baseline", F.lit('"'))
    return cases.select("p_brand", gates.improvement(F.col("baseline"), F.col("compile")).alias("gain"), gates.markdown_row(*map(F.col, cases.columns)).alias("line"), gates.csv_field(field).alias("field"))


@query(f"WITH {CASES_SQL} SELECT CAST(sum(baseline) AS BIGINT) AS baseline, CAST(sum(compile) AS BIGINT) AS compile, sum(compile) <= 0 AND sum(baseline) > sum(compile) AS passed FROM c")
def q_leak_gate(spark, sf_dir):
    cases = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum("p_size").alias("baseline"), F.count(F.lit(1)).alias("compile"))
    return gates.verdict(cases, "baseline", "compile")


@query(f"WITH {OVERLAY_SQL} SELECT file, s_suppkey % 2 = 0 AS corroborated FROM overlay")
def q_corroborated(spark, sf_dir):
    body = F.when(F.col("s_suppkey") % 2 == 0, F.col("text")).otherwise(F.lit("booking of suppliers"))
    segments = F.flatten(F.transform(text.tokens(body), text.segments))
    return overlay(spark, sf_dir).select("file", discover.corroborated(segments, [["booking", "core"], ["nobody"]]).alias("corroborated"))


@query(f"""WITH l AS (SELECT doc_id, text, {TRANSFORM_SQL} AS out FROM documents)
SELECT doc_id, concat(CASE WHEN doc_id % 2 = 0 THEN 'src/vendor-a_' ELSE 'src/' END, doc_id, '.env') AS new_file, md5(out) AS out_md5,
count(*) OVER () AS n_scanned, count(*) FILTER (out <> text) OVER () AS n_changed, count(*) FILTER (doc_id % 2 = 0) OVER () AS n_renamed FROM l""")
def q_compile(spark, sf_dir):
    """A whole compile run over the documents as files: rewritten, gated, published and read back, with the counters of the pass that wrote it."""
    name = F.concat(F.when(F.col("doc_id") % 2 == 0, "src/the_").otherwise("src/"), F.col("doc_id"), F.lit(".env"))
    docs = table(spark, sf_dir, "documents").select(name.alias("file"), "text")
    done = running.compile_run(docs, configured(spark, *PROSE), f"{sinks.shared_folder(spark)}/published-{sinks.operation_id()}")
    counts = [F.lit(done.counters[c]).cast("long").alias(c) for c in ("n_scanned", "n_changed", "n_renamed")]
    return done.files.select(F.regexp_extract("file", "([0-9]+)[.]env$", 1).cast("long").alias("doc_id"), "new_file", F.md5("new_text").alias("out_md5"), *counts)


#: Texts of entities that contexts are held against.
ENTITY_TEXTS = (("e_heron", "Heron Station"), ("e_heron", "the other heron"), ("e_tion", "mention ration"), ("e_que", "que los quell"), ("e_short", "ou"))
ENTITY_TEXT_VALUES = ", ".join(f"('{i}', '{t}')" for i, t in ENTITY_TEXTS)


@query(f"""WITH l AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[.,\n]')) AS line FROM conversations), e AS (SELECT * FROM (VALUES {ENTITY_TEXT_VALUES}) AS e(entity_id, text)),
n AS (SELECT line, lower(regexp_replace(line, '[^A-Za-z0-9]+', '', 'g')) AS j FROM l), m AS (SELECT entity_id, lower(regexp_replace(text, '[^A-Za-z0-9]+', '', 'g')) AS j FROM e),
c AS (SELECT line, CASE WHEN len(j) >= 3 THEN list_distinct(list_transform(range(1, len(j) - 1), lambda i: substr(j, i, 3))) WHEN len(j) > 0 THEN [j] ELSE [] END AS g FROM n),
t AS (SELECT entity_id, CASE WHEN len(j) >= 3 THEN list_distinct(list_transform(range(1, len(j) - 1), lambda i: substr(j, i, 3))) ELSE [j] END AS g FROM m),
s AS (SELECT line, entity_id, max(len(list_intersect(c.g, t.g)) / sqrt(len(c.g)::DOUBLE * len(t.g))) AS x FROM c, t WHERE len(c.g) > 0 GROUP BY ALL)
SELECT md5(line) AS context_md5, entity_id, round(x, 6) AS similarity, least(round(x * 0.5, 4), 0.45)::DOUBLE AS weight FROM s WHERE x >= 0.3""")
def q_semantic_contexts(spark, sf_dir):
    """Distinct pieces of all conversations as contexts, against texts of entities through an inverted index."""
    lines = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", "[.,\n]")).alias("line")).distinct()
    texts = spark.sql(f"SELECT * FROM VALUES {ENTITY_TEXT_VALUES} AS e(entity_id, text)")
    rows = similar.semantic_pairs(lines.select(F.col("line").alias("id"), F.col("line").alias("text")), texts)
    return rows.select(F.md5("id").alias("context_md5"), "entity_id", scoring.rounded(F.col("similarity"), 6).alias("similarity"), scoring.semantic_weight(F.col("similarity")).alias("weight"))


#: Stems by profile, each of words that must all stand in a file.
DIVIDED = ((0, ["the", "er", "st"]), (0, ["licensed", "under"]), (1, ["que", "los"]), (1, ["un", "en", "de", "la"]), (2, ["nobody"]), (3, ["an"]))
DIVIDED_SQL = ", ".join(f"({i}, {s!r})" for i, s in DIVIDED)


@query(f"""WITH w AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x))) AS ws FROM documents), p AS (SELECT * FROM (VALUES {DIVIDED_SQL}) AS p(ord, stem))
SELECT DISTINCT doc_id, ord FROM w, p WHERE list_has_all(ws, stem)""")
def q_corroborated_documents(spark, sf_dir):
    """Profiles of which a document holds all parts of some stem, by counting parts that an index knows."""
    stems = spark.createDataFrame([(i, s) for i, s in DIVIDED], "ord int, stem array<string>")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), text.words(F.col("text")).alias("parts"))
    return detect.corroborated(rows, stems).select(F.col("file").alias("doc_id"), "ord")


@query()
def q_fuzzy_join(spark, sf_dir):
    """Every pair of a part's, customer's or supplier's name and a part's or configured one that is alike, parts also turned round, with the number of rows
    that have each; only candidates are compared."""
    column = lambda name, value, alias: table(spark, sf_dir, name).select(value.alias(alias))
    part, turned = F.col("p_name"), F.concat_ws(" ", F.reverse(F.split("p_name", " ")))
    surfaces = column("part", part, "surface").unionByName(column("customer", F.col("c_name"), "surface")).unionByName(column("supplier", F.col("s_name"), "surface"))
    names = column("part", part, "name").unionByName(column("part", turned, "name")).unionByName(spark.createDataFrame([(t,) for _, t in FUZZY_NAMES], "name string"))
    surfaces, names = surfaces.groupBy("surface").agg(F.count(F.lit(1)).alias("n_surfaces")), names.groupBy("name").agg(F.count(F.lit(1)).alias("n_names"))
    pairs = similar.fuzzy_pairs(surfaces, names).withColumn("weight", scoring.fuzzy_weight(F.col("ratio")))
    return pairs.join(surfaces, "surface").join(names, "name").select("surface", "name", "ratio", "weight", "n_surfaces", "n_names")


#: Parts as candidates: those of some sizes have an entity, and size and brand give score and level.
PART_CANDIDATES = (
    "p_name AS surface, CASE WHEN p_size % 3 = 0 THEN p_brand END AS entity_id, CAST(p_size AS DOUBLE) / 50 AS score, 'lexical' AS evidence, "
    "CASE WHEN p_size >= 45 AND p_size % 3 = 0 THEN 'auto' WHEN p_size >= 22 THEN 'review' ELSE 'ignore' END AS action"
)


def part_candidates(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(*PART_CANDIDATES.split(", "))


@query(f"""WITH c AS (SELECT {PART_CANDIDATES} FROM part) SELECT count(*) AS candidates, count(*) FILTER (action = 'auto') AS auto, count(*) FILTER (action = 'review') AS review,
count(*) FILTER (action = 'ignore') AS ignore, count(*) FILTER (entity_id IS NULL AND action <> 'ignore') AS proposed FROM c""")
def q_action_counts(spark, sf_dir):
    return views.by_action(part_candidates(spark, sf_dir))


@query(f"WITH c AS (SELECT {PART_CANDIDATES} FROM part) SELECT surface, count(*) AS n, max(score) AS score FROM c WHERE entity_id IS NULL AND action <> 'ignore' GROUP BY surface")
def q_open_proposals(spark, sf_dir):
    return views.open_proposals(part_candidates(spark, sf_dir)).groupBy("surface").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score"))


@query(f"""WITH c AS (SELECT {PART_CANDIDATES} FROM part) SELECT substr(surface, 1, 38) AS surface, printf('%.2f', score) AS score, evidence, '[' || action || ']' AS action, coalesce(entity_id, '(new)') AS tag
FROM c ORDER BY c.score DESC, coalesce(entity_id, '~'), c.surface LIMIT 40""")
def q_candidate_table(spark, sf_dir):
    """The best forty, as they are printed."""
    return views.candidate_table(part_candidates(spark, sf_dir), 40)


@query("SELECT s_suppkey, s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50 AND l_returnflag = 'R') AS found FROM supplier")
def q_covered(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").filter("l_quantity >= 50 and l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey"))
    return views.covered(found, table(spark, sf_dir, "supplier"), "s_suppkey")


@query("SELECT DISTINCT alias FROM (SELECT lower(p_brand) AS alias FROM part UNION ALL SELECT lower(concat('brand#', s_nationkey)) FROM supplier)")
def q_known_aliases(spark, sf_dir):
    return views.known_aliases(table(spark, sf_dir, "part").select(F.lower("p_brand").alias("ghost")), table(spark, sf_dir, "supplier").select(F.lower(F.concat(F.lit("brand#"), "s_nationkey")).alias("ghost")))


@query("SELECT user_id, event_id, ts, value FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def q_latest_matching(spark, sf_dir):
    return views.latest_matching(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], event_type="purchase").select("user_id", "event_id", "ts", "value")


@query("SELECT event_id, user_id FROM events WHERE user_id % 7 IN (1, 3) AND event_type NOT IN ('view', 'click')")
def q_log_subset(spark, sf_dir):
    log = table(spark, sf_dir, "events").withColumn("component", F.col("user_id") % 7)
    return views.log_subset(log, "component", "event_type", [1, 3], ["view", "click"]).select("event_id", "user_id")


@query("SELECT user_id, event_type, CAST(sum(coalesce(CAST(floor(value) AS BIGINT), 0)) AS BIGINT) AS total_tokens FROM events GROUP BY ALL")
def q_token_totals(spark, sf_dir):
    return views.totals(table(spark, sf_dir, "events").withColumn("tokens", F.floor("value").cast("long")), ["user_id", "event_type"], "tokens")


@query("""WITH m AS (SELECT user_id, max(event_id) AS mark FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT e.user_id, e.event_id FROM events e LEFT JOIN m USING (user_id) WHERE mark IS NULL OR event_id > mark""")
def q_handoff(spark, sf_dir):
    """What each user did after the last purchase."""
    return views.newer_than_marker(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type") == "purchase").select("user_id", "event_id")


#: Aliases that are words of names of parts, with what they stand for.
SLUG_PAIRS = [("red", "Halcyon Cargo"), ("red-bolt", "Sky_Route!"), ("gear", "red"), ("cold", "Cold")]


@query("""WITH s AS (SELECT p_partkey, concat('-', replace(p_name, ' ', '-'), '-') AS s FROM part)
SELECT p_partkey, trim(replace(replace(replace(replace(s, '-red-bolt-', '-sky-route-'), '-gear-', '-red-'), '-red-', '-halcyon-cargo-'), '-red-', '-halcyon-cargo-'), '-') AS slug FROM s""")
def q_decoded_slugs(spark, sf_dir):
    """Names of parts as slugs; what one alias brings in is decoded by a shorter one after it."""
    return table(spark, sf_dir, "part").select("p_partkey", views.decoded_slug(F.replace("p_name", F.lit(" "), F.lit("-")), SLUG_PAIRS).alias("slug"))


@query("SELECT doc_id, CAST(len(string_split(CASE WHEN ends_with(text, chr(10)) THEN left(text, len(text) - 1) ELSE text END, chr(10))) AS BIGINT) AS n_lines, CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END::BIGINT AS trailing, md5(string_split(text, chr(10))[1]) AS first_md5 FROM documents")
def q_body_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", views.body_lines(F.col("text")).alias("b"))
    return rows.select("doc_id", F.size("b.lines").cast("long").alias("n_lines"), F.char_length("b.trailing").cast("long").alias("trailing"), F.md5(F.get("b.lines", 0)).alias("first_md5"))


@query("SELECT p_partkey, lower(p_name) IN ('sky route', 'cold bolt', 'new gear', 'skyroute') AS configured FROM part")
def q_configured_surfaces(spark, sf_dir):
    known = configured(spark, "'a', 'Sky Route', 'vendor', 'internal', 'semantic_alias', 'vendor-a', 'seed', 'identifier:skyRoute|regex:x+'", "'b', 'COLD bolt', 'vendor', 'internal', 'semantic_alias', 'vendor-b', 'seed', 'literal:New GEAR'")
    return views.configured(table(spark, sf_dir, "part"), "p_name", known).select("p_partkey", "configured")


@query("""SELECT concat('d', doc_id % 100, '/', doc_id, '.txt') AS file, md5(coalesce(text, '')) AS text_md5, false AS is_binary FROM documents
UNION ALL SELECT concat('raw/', doc_id, '.bin'), NULL, true FROM documents WHERE doc_id % 10 = 0 AND text IS NOT NULL""")
def q_file_tree(spark, sf_dir):
    """All documents as a tree of real files, those of every tenth id also as binaries, read back."""
    docs = table(spark, sf_dir, "documents")
    place = F.concat(F.lit("d"), F.col("doc_id") % 100, F.lit("/"), "doc_id", F.lit(".txt"))
    raw = docs.filter("doc_id % 10 = 0 and text is not null").select(F.concat(F.lit("raw/"), "doc_id", F.lit(".bin")).alias("file"), F.concat(F.unhex(F.lit("FF00")), F.encode("text", "UTF-8")).alias("content"))
    out = f"{sinks.shared_folder(spark)}/files-{sinks.operation_id()}"
    tree.published(docs.select(place.alias("new_file"), F.col("text").alias("new_text")), out, raw)
    return files.text_files(spark, out).select("file", F.md5("text").alias("text_md5"), "is_binary")


@query("""WITH n AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 2 DESC, c_custkey) - 1 AS n FROM customer)
SELECT c_custkey, concat('client', c_nationkey, '-', CASE WHEN n < 26 THEN chr(CAST(97 + n AS INTEGER)) ELSE CAST(n - 25 AS VARCHAR) END) AS alias, CAST(2 AS BIGINT) AS version FROM n""")
def q_mapping_versions(spark, sf_dir):
    """Aliases of customers in two versions of a mapping store: the second run keeps what the first one gave."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("client"), "c_nationkey").alias("prefix"))
    store = f"{sinks.shared_folder(spark)}/mapping-{sinks.operation_id()}"
    versions.allocated(store, rows.filter("c_custkey % 2 = 1"), "c_custkey", "prefix", "c_custkey")
    last = versions.allocated(store, rows, "c_custkey", "prefix", "c_custkey")
    return versions.read(spark, store).withColumn("version", F.lit(last).cast("long"))
