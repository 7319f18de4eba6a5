"""Findings as new measurements arrive.

Checks that compare whole sources cannot be told from one micro-batch alone, so
each batch's sources are screened again from the stored measurements, and only
findings not told before go out. Windowed statistics of event streams use
watermarks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from plumbline.operators import pairs, vectors


#: Parts of the store by source.
PARTS = 256


def finding_id(pattern: str, *keys: str) -> F.Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", F.lit(pattern), *(F.col(k) for k in keys)), 256), 1, 16)


def duplicate_findings(obs: DataFrame, least: int = 4) -> DataFrame:
    """(finding_id, pattern_id, source, group_a, group_b, n): a source's groups that hold the vector of an earlier one, group_a."""
    found = pairs.duplicates_within_source(vectors.vectors(obs), least).filter("group_key <> class_group")
    pattern = "P-SOURCE-DUPLICATE-VALUES"
    return found.select(finding_id(pattern, "source", "class_group", "group_key", "n").alias("finding_id"), F.lit(pattern).alias("pattern_id"), "source", F.col("class_group").alias("group_a"), F.col("group_key").alias("group_b"), "n")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def screen(stream: DataFrame, store: str, checkpoint: str, check: Callable[[DataFrame], DataFrame] = duplicate_findings) -> StreamingQuery:
    """Starts screening of a stream of obs (source, group_key, value). Findings land below store/findings, one folder per batch.

    Each batch writes its own folders, overwritten if the batch is run again, so
    every finding is told exactly once. The store is cut by a hash of the source:
    a batch reads only the parts that hold its sources.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows.withColumn("part", F.pmod(F.xxhash64("source"), F.lit(PARTS)).cast("int")).write.mode("overwrite").partitionBy("part").parquet(f"{store}/obs/batch={number}")
        new = _stored(spark, f"{store}/obs/batch={number}")
        if new is None:
            return
        parts = [r["part"] for r in new.select("part").distinct().collect()]
        every = spark.read.option("basePath", f"{store}/obs").parquet(f"{store}/obs").filter(F.col("part").isin(parts) & (F.col("batch") <= number)).drop("batch", "part")
        touched = new.select("source").distinct()
        found = check(every.join(touched, "source", "left_semi"))
        told = _stored(spark, f"{store}/findings")
        if told is not None:
            found = found.join(told.filter(F.col("batch") < number).select("finding_id"), "finding_id", "left_anti")
        found.write.mode("overwrite").parquet(f"{store}/findings/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Count and mean of events (ts, event_type, value) per window and type; rows later than `late` are left out of closed windows."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of events (ts, user_id): runs without a pause of `gap`."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
