"""The configuration and the mapping store as tables, with the checks that stop a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of an entity, the kinds, levels and strategies it may have.
ENTITY = (
    "id string, real string, kind string, level string, strategy string, ghost string, note string, source string, approved_by string, rewrite_imports boolean,"
    " match array<struct<kind:string,value:string>>"
)
KINDS = ("vendor", "client", "internal_service", "infra_identifier", "domain", "secret", "person")
LEVELS = ("public", "internal", "confidential", "restricted")
STRATEGIES = ("semantic_alias", "synthetic_id", "synthetic_endpoint", "generalize", "remove")
MATCHES = ("literal", "regex", "identifier")
#: What an entity of a kind is called, replaced by, and how secret it is if nobody says otherwise.
PREFIX = {"vendor": "vendor", "client": "client", "internal_service": "service", "infra_identifier": "id", "domain": "host", "secret": "secret", "person": "person"}
STRATEGY = {"secret": "remove", "client": "synthetic_id", "person": "synthetic_id", "infra_identifier": "synthetic_id", "domain": "synthetic_endpoint"}
LEVEL = {"vendor": "internal", "client": "restricted", "internal_service": "confidential", "infra_identifier": "confidential", "domain": "confidential", "secret": "restricted", "person": "restricted"}
MAPPING = "mapping_version int, created string, updated string, entries array<struct<entity_id:string,real:string,kind:string,level:string,strategy:string,ghost:string,frozen:boolean>>"


def entities_of(spark: SparkSession, path: str) -> DataFrame:
    """The entities of a YAML file, one row each in order (ord), or ValueError for what `faults` finds."""
    import yaml

    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).limit(1).collect())  # one small file
    given = (yaml.safe_load(text) or {}).get("entities", [])
    names = [f.split(" ")[0] for f in ENTITY.split(", ")]
    unknown = sorted({k for e in given for k in e} - set(names))
    if unknown:
        raise ValueError(f"unknown fields of entities: {unknown}")
    rows = [tuple([tuple((m["kind"], m["value"]) for m in e["match"]) if n == "match" and e.get("match") else e.get(n) for n in names] + [i]) for i, e in enumerate(given)]
    out = spark.createDataFrame(rows, ENTITY + ", ord int")
    found = faults(out).limit(20).collect()
    if found:
        raise ValueError("; ".join(f"{r['id']}: {r['fault']}" for r in found))
    return out


def faults(entities: DataFrame) -> DataFrame:
    """id, fault: ids met twice, missing fields, and values that are none of the known ones."""
    known = lambda c, some: F.when(~F.coalesce(F.col(c).isin(*some), F.lit(False)), F.concat(F.lit(f"no such {c}: "), F.coalesce(c, F.lit("null"))))
    missing = [F.when(F.coalesce(F.col(c), F.lit("")) == "", f"no {c}") for c in ("id", "real")]
    odd = F.when(F.exists(F.coalesce("match", F.array().cast("array<struct<kind:string,value:string>>")), lambda m: ~m["kind"].isin(*MATCHES)), "no such kind of match")
    each = F.filter(F.array(*missing, known("kind", KINDS), known("level", LEVELS), known("strategy", STRATEGIES), odd), lambda x: x.isNotNull())
    twice = entities.groupBy("id").count().filter("count > 1").select("id", F.lit("the id is met twice").alias("fault"))
    return entities.select("id", F.explode(each).alias("fault")).unionByName(twice)


def pending(entities: DataFrame) -> DataFrame:
    """Restricted entities that were found or added and that nobody approved; a run with any of them stops."""
    return entities.filter("level = 'restricted' and coalesce(source, 'seed') in ('discovered', 'human') and coalesce(approved_by, '') = ''")


def seeds(entities: DataFrame) -> DataFrame:
    return entities.filter("coalesce(source, 'seed') = 'seed'")


def by_level(entities: DataFrame) -> DataFrame:
    return entities.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def mapping_entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MAPPING).option("multiLine", "true").json(path).select(F.inline("entries"))


def with_mapping_only(entities: DataFrame, entries: DataFrame) -> DataFrame:
    """The configured entities, and those that the mapping alone knows."""
    more = entries.join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_anti").withColumnRenamed("entity_id", "id")
    return entities.unionByName(more.select(*[c for c in more.columns if c in entities.columns]), allowMissingColumns=True)


def spellings(entities: DataFrame) -> DataFrame:
    """spelling, entity_id of real names, literals and identifiers; the first declared owner (by ord) counts."""
    given = F.coalesce("match", F.array().cast("array<struct<kind:string,value:string>>"))
    more = F.transform(F.filter(given, lambda m: m["kind"].isin("literal", "identifier")), lambda m: m["value"])
    rows = entities.select(F.explode(F.array_distinct(F.concat(F.array("real"), more))).alias("spelling"), "id", "ord").filter("spelling <> ''")
    return rows.groupBy("spelling").agg(F.min_by("id", "ord").alias("entity_id"))
