"""A training corpus in five stages, each a table that the next one reads.

``STAGES`` are applied in order to ``documents``: reject by quality, keep one document of each group of
near-duplicates, sanitise personal data, mix the sources to their target weights, and pack the rest
into training sequences. Every stage reads all that the one before kept and returns the columns of
``documents``; the last gives the packed pieces. SQL cannot express them (a fitted classifier, hashed
signatures, a random draw, a tokenizer), so ``ORACLE_SQL`` is None and the tests hold the stages
against plain loops.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.llm import minhash, mixing, packing, pii, quality
from tablescout.llm.queries import tokenizer_file
from tablescout.sources.lineage import checkpoint_folder
from tablescout.sources.tables import read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled ones do not vote down; labels come from ``labels``."""
    return quality.good_documents(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id."""
    return minhash.without_near_duplicates(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with identifiers and the words that reveal them replaced."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix; one that is taken several times comes as several rows."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and offset."""
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), end_id=2, with_ids=False)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("PII", pii_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again."""
    folder = f"{checkpoint_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
