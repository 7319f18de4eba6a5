"""Corpus preparation from end to end: five operators, each on what the one before kept.

STAGES names them in order; each function takes (spark, docs, sf_dir) and gives a
DataFrame. All but the last keep the columns of documents.

Every stage takes any table with doc_id and text: null and empty texts count as
empty, rows may repeat, further columns pass through whatever their names, very
long texts are read whole, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, latent, order_minhash, pii, quality
from plumbline.llm._io import release, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking does not reject; an empty text is judged like any other, a score of exactly 0.5 stays."""
    return quality.keep_good(docs, quality.learnt(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates; one row of rows that repeat an id, all rows without one."""
    return order_minhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; with an empty benchmark all of them."""
    return latent.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by marks and n_chars counted anew; a null text stays null."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text they decode to; a null text has no tokens."""
    return bpe.encode_and_decode(docs).drop("decoded")


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]

#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        release(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
