"""Corpus pipeline: toxic documents go, then exact copies, then near copies;
what stays has its personal data replaced and is packed into sequences.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``.
Stages with Python set the session's Arrow batches to 1000 rows or less.

Defined cases: an empty table gives empty stages.  Rows are told apart by id
and text, so rows that share an id are documents of their own: a copy or near
copy among them goes, a clean text among them stays, and rows equal in both
count as copies.  Null ids come last where the smallest id stays.  Null and
empty texts are never near copies of each other (exact dedup keeps one).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetrina.llm import exact_dedup, jaccard_join, packing, pii, toxicity
from vetrina.llm.common import materialize, small_batches, table

#: No SQL states a learned score or the packing; tests compare brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Train on the labels of the given documents, drop those predicted toxic."""
    small_batches(spark)
    return toxicity.reject_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest id stays."""
    return exact_dedup.exact_dedup(docs).where("kept").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked texts, the one with the smallest id stays; rows
    are told apart by id and text."""
    small_batches(spark)
    return jaccard_join.one_of_each_class(docs).select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates for personal data; n_chars follows the new text."""
    small_batches(spark)
    clean = pii.replace_pii(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of what is left."""
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, keep_ids=False)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near duplicates", drop_near_copies), ("personal data", replace_personal_data), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
