"""A corpus pipeline of five stages, from raw documents to packed sequences.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame;
all but the last return the columns of documents. Each result is written as Parquet and read again; what a stage
wrote on its way goes when its result is there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import exact_dedup, language_id, packing, simhash, suffix_dedup
from veilspark.llm.common import documents, own_names, scratch, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows of docs; rows without a language (null, or no letter) go."""
    pred, score = own_names(docs.columns, "lang_pred", "lang_score")
    named = language_id.identify(docs, language_id.train(docs), pred, score)
    return named.filter(F.col(pred) != "und").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (runs of white space count as one space) the row with the smallest doc_id stays."""
    index = exact_dedup.DigestIndex(spark, f"corpus_index_{uuid.uuid4().hex}")
    kept = exact_dedup.distinct_documents(docs, index, "corpus")
    index.drop()  # this run's alone; what was decided stands in tables of its own
    return kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the row with the smallest doc_id stays."""
    return simhash.one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every 200-byte string that starts in two places is taken out of text; n_chars is counted anew."""
    return suffix_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets."""
    return packing.packed(docs)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeated_passages),
    ("packing", pack),
]

#: No SQL expresses trained costs, byte suffixes or a tokenizer; tests hold run() against a plain model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
    return docs
