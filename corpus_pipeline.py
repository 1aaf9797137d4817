"""Corpus pipeline: language ID, near-duplicate removal, secret scan, mixing, packing.

Each step takes the documents that the one before kept, as a table, and returns documents; the last
returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import language_id, mixing, packing, secret_scan, simhash
from gristmill.llm.common import cut, read
from gristmill.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a language go, which are those without a letter. A missing label is filled."""
    return language_id.keep_identified(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays, that of the least id."""
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; n_chars follows."""
    return secret_scan.redact_secrets(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice."""
    mixed = mixing.mix(docs).filter("mix_copies > 0")
    return mixed.withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequence and place in it."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", remove_near_copies),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: No step but the last could be said in SQL, and that one by a tokenizer; each is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps applied to ``documents``; what a step keeps is a table of its own, in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
