"""A pipeline over documents: each stage calls one operator, and works on all that the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import jaccard, langid, mixing, packing, secrets
from fathomline.llm.shared import cut, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that the identifier rejects go.

    NULL texts and texts without a letter have no language, so they go. Repeated rows stay, each for itself. Languages are learned from the labelled
    rows; without any, no language is known and nothing stays.
    """
    return langid.predict(docs, langid.train(docs)).filter(~F.col("rejected")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id; documents without a word all stay.

    Repeated rows are copies. Of rows that share an id, each text counts for itself; a NULL id is greater than all others.
    """
    return jaccard.dedupe(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark, ``n_chars`` set to the new length; NULL texts stay NULL."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each draw, cut where a target ends inside one; ``n_chars`` is the length of what is taken.

    NULL texts and texts without a word take no part. A NULL source is a source of its own, the last.
    """
    mixed = mixing.mix(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens. Repeated rows are documents of their own; NULL texts count as empty."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: No SQL: language identification and mixing draw on trained weights and seeded draws. The tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each written and read again by the next. Columns besides those of the stages go along; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"pipeline-{k}")
    return docs
