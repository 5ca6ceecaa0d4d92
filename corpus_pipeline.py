"""Cleaning pipeline: toxicity, exact dedup, near dedup, repeated passages, packing.

Each stage reads all that its predecessor kept and returns the columns of ``documents``, except the last,
which returns the packed pieces. ``run`` writes every stage as a table in the shared folder and reads it
again, so a lost executor never costs more than its stage.

Rows without identifier go through every stage: the first and the last treat them by their text, exact
and near dedup leave them in, as nothing could name the copy that stays. Null texts count as empty, and of
several empty texts one stays. A table without rows gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import exact_dedup, near_dedup, packing, suffix_dedup, toxicity
from auditlake.llm.common import materialize, table
from auditlake.llm.queries import tokenizer_path

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def _exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest identifier."""
    return exact_dedup.drop_copies(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the least identifier."""
    dropped = near_dedup.near_dedup(docs).where(~F.col("kept")).select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def _suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 200 bytes or more that repeat.

    Characters that such a passage covers only in part stay, so the text is whole characters.
    """
    found = suffix_dedup.drop_passages(docs)
    return found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=2, with_ids=False, release=True)


STAGES = [
    ("toxicity", _toxicity),
    ("exact_dedup", _exact_dedup),
    ("near_dedup", _near_dedup),
    ("suffix_dedup", _suffix_dedup),
    ("best_fit_packing", _packing),
]

# Classifier, near dedup and packing have no SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
