"""Sealed runs: what went in, what came out, and lists of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def seal(root: str, run_id: str, findings: DataFrame, inputs: DataFrame, ok: bool = True, error: str | None = None, started: str = "1970-01-01 00:00:00") -> None:
    """Writes a run below root/run=<id>: its findings, its inputs (path, content) as SHA-256 and length, and a manifest with their numbers. A run sealed before is written anew."""
    path = f"{root}/run={run_id}"
    findings.write.mode("overwrite").parquet(f"{path}/findings")
    inputs.select("path", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("bytes")).write.mode("overwrite").parquet(f"{path}/inputs")
    spark = findings.sparkSession
    counts = [spark.read.schema(df.schema if name == "findings" else "path string, sha256 string, bytes long").parquet(f"{path}/{name}").count() for name, df in (("findings", findings), ("inputs", inputs))]
    row = [(run_id, ok, error, started, *counts)]
    spark.createDataFrame(row, "run_id string, ok boolean, error string, started string, n_findings long, n_inputs long").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def runs(spark: SparkSession, root: str, most: int | None = None) -> DataFrame:
    """Manifests below root, the newest first; `most` of them if given."""
    schema = "run_id string, ok boolean, error string, started string, n_findings long, n_inputs long"
    every = spark.read.schema(schema).json(f"{root}/run=*/manifest").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("started"), "run_id")))
    return (every if most is None else every.filter(F.col("rank") <= most)).orderBy("rank")


def changed_inputs(spark: SparkSession, root: str, before: str, after: str) -> DataFrame:
    """(path, status): inputs that two runs have in different states: added, gone or changed."""
    read = lambda r, c: spark.read.parquet(f"{root}/run={r}/inputs").select("path", F.col("sha256").alias(c))
    j = read(before, "a").join(read(after, "b"), "path", "full_outer").filter("NOT a <=> b")
    return j.select("path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "gone").otherwise("changed").alias("status"))


def artifact(matrix: DataFrame) -> DataFrame:
    """(body): rows of the n matrix as JSON, nulls left out."""
    return matrix.select(F.to_json(F.struct(*matrix.columns)).alias("body"))
