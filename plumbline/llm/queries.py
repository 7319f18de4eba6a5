"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe, latent, licenses, metric_join, order_minhash, pii, quality, shards, sql, substring, warc
from plumbline.llm._io import shared_dir, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op2_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learnt(docs, table(spark, sf_dir, "labels")))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write(table(spark, sf_dir, "pages"), shared_dir(spark, "warc"))
    return warc.read(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(table(spark, sf_dir, "documents"))


def op5_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.link(table(spark, sf_dir, "embeddings"))


def op6_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_training_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "shards")
    shards.write(table(spark, sf_dir, "documents"), path)
    return shards.read(spark, path, ids=False)


def op8_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(table(spark, sf_dir, "documents"), keep_ids=False)


def op9_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_quality_ranking, op3_warc_revisits, op4_order_minhash, op5_metric_range_join, op6_latent_decontamination, op7_training_shards, op8_bpe_trie, op9_license_templates, op10_pii_deobfuscation)}


def oracle_sql() -> dict[str, str]:
    """Of the queries that SQL can express; the others are tested against brute force, the library they follow or held-out labels."""
    return {"op1_substring_dedup": sql.OP1, "op3_warc_revisits": sql.OP3, "op5_metric_range_join": sql.OP5, "op9_license_templates": sql.op9()}
