"""One-to-one and best matches: digitised plots against tables, residues of statistics programs against tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pairs_off(a: np.ndarray, b: np.ndarray, tolerance: float) -> int:
    """How many values of two sorted vectors pair off within the tolerance: both are walked from the low end, which pairs off as many as any order can."""
    i = j = hits = 0
    while i < len(a) and j < len(b):
        gap = a[i] - b[j]
        if abs(gap) <= tolerance:
            i, j, hits = i + 1, j + 1, hits + 1
        elif gap < 0:
            i += 1
        else:
            j += 1
    return hits


def coverage(a: Column, b: Column, tolerance: float = 0.25) -> Column:
    """Values of two sorted vectors that pair off within the tolerance, over the longer length."""

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([pairs_off(p, q, tolerance) / max(len(p), len(q), 1) for p, q in zip(x, y, strict=True)], dtype="float64")

    return score(F.coalesce(a, F.array().cast("array<double>")), F.coalesce(b, F.array().cast("array<double>")))


def best_tables(plots: DataFrame, tables: DataFrame, tolerance: float = 0.25, least: float = 0.85) -> DataFrame:
    """Each plot (plot, folder, group_key, vals) with the table (source, folder, group_key, vals) of its folder that matches most groups, then best: (plot, source, n_groups, mean_score).

    A share of `least` of the longer vector needs lengths that near, so groups
    meet by folder and bands of length.
    """
    width = -math.log(min(0.99, max(0.05, least)))
    band = F.floor(F.log(F.greatest(F.size("vals"), F.lit(1))) / width)
    p = plots.withColumn("band", F.explode(F.array(*(band + i for i in (-1, 0, 1)))))
    t = tables.withColumn("band", band).select("source", "folder", "band", F.col("group_key").alias("t_group"), F.col("vals").alias("t_vals"))
    near = p.join(t, ["folder", "band"]).filter(F.least(F.size("vals"), F.size("t_vals")) >= least * F.greatest(F.size("vals"), F.size("t_vals")))
    scored = near.withColumn("score", coverage(F.col("vals"), F.col("t_vals"), tolerance)).filter(F.col("score") >= least)
    per_group = scored.groupBy("plot", "source", "group_key").agg(F.max("score").alias("score"))
    per_table = per_group.groupBy("plot", "source").agg(F.count("*").alias("n_groups"), F.avg("score").alias("mean_score"))
    best = per_table.groupBy("plot").agg(F.max_by(F.struct("source", "n_groups", "mean_score"), F.struct("n_groups", F.round("mean_score", 9).alias("m"), F.col("source"))).alias("b"))
    return best.select("plot", "b.source", "b.n_groups", F.round("b.mean_score", 6).alias("mean_score"))


def residue_errors(residues: DataFrame, stats: DataFrame) -> DataFrame:
    """(path, source, mean_error): each residue (path, folder, mean_a, mean_b) against the tables (source, folder, group_key, mean) of its folder.

    The error is the smallest sum of mean differences over two groups of a table.
    It needs each mean's two nearest groups only, never pairs of groups.
    """
    both = residues.select("path", "folder", "mean_a", "mean_b").join(stats.select("source", "folder", "group_key", "mean"), "folder")
    both = both.withColumns({"da": F.struct(F.abs(F.col("mean_a") - F.col("mean")).alias("d"), F.col("group_key").alias("g")), "db": F.struct(F.abs(F.col("mean_b") - F.col("mean")).alias("d"), F.col("group_key").alias("g"))})
    keys = ["path", "source"]
    first = both.groupBy(*keys).agg(F.min("da").alias("a1"), F.min("db").alias("b1"), F.count("*").alias("k")).filter("k >= 2")
    next_to = both.select(*keys, "da", "db").join(first, keys)
    second = next_to.groupBy(*keys).agg(F.first("a1").alias("a1"), F.first("b1").alias("b1"), F.min(F.when(F.col("da.g") != F.col("a1.g"), F.col("da.d"))).alias("a2"), F.min(F.when(F.col("db.g") != F.col("b1.g"), F.col("db.d"))).alias("b2"))
    apart = F.when(F.col("a1.g") != F.col("b1.g"), F.col("a1.d") + F.col("b1.d")).otherwise(F.least(F.col("a1.d") + F.col("b2"), F.col("a2") + F.col("b1.d")))
    return second.select(*keys, apart.alias("mean_error"))


def unmatched_residues(residues: DataFrame, stats: DataFrame, floor: float = 1.0) -> DataFrame:
    """Residues that no table explains: the best error is `floor` at least, and above max(0.15, 10 % of the means' size)."""
    e = residue_errors(residues, stats).groupBy("path").agg(F.min_by(F.struct("source", "mean_error"), "mean_error").alias("b"))
    j = e.join(residues, "path")
    allowed = F.greatest(F.lit(0.15), 0.1 * F.greatest(F.abs("mean_a"), F.abs("mean_b")))
    return j.filter((F.col("b.mean_error") >= floor) & (F.col("b.mean_error") > allowed)).select("path", F.col("b.source").alias("source"), F.round("b.mean_error", 6).alias("mean_error"))


def contrast_errors(contrasts: DataFrame, stats: DataFrame) -> DataFrame:
    """(path, source, error): mean |estimate - (mean of label - mean of ref)| of contrasts (path, source, label, ref, estimate)."""
    m = lambda name: stats.select("source", F.col("group_key").alias(name), F.col("mean").alias(f"m_{name}"))
    j = contrasts.join(m("label"), ["source", "label"]).join(m("ref"), ["source", "ref"])
    return j.groupBy("path", "source").agg(F.avg(F.abs(F.col("estimate") - (F.col("m_label") - F.col("m_ref")))).alias("error"))


def local_files(names: DataFrame, files: DataFrame) -> DataFrame:
    """Paths as scripts write them (script, name) to files (path, modified): by base name; the same folder first, then the newest."""
    base = lambda c: F.lower(F.element_at(F.split(c, "[/\\\\]"), -1))
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    n = names.withColumn("base", base(F.col("name")))
    f = files.withColumn("base", base(F.col("path")))
    rank = F.struct((folder(F.col("script")) == folder(F.col("path"))).cast("int").alias("near"), "modified", "path")
    return n.join(f, "base").groupBy("script", "name").agg(F.max_by("path", rank).alias("path"))


def shape_cards(claims: DataFrame, tables: DataFrame) -> DataFrame:
    """Statements whose list of n has a table's number of groups and lies near its sizes, each within max(1, 20 %), without being equal: (claim_id, source, stated, found)."""
    c = claims.groupBy("claim_id").agg(F.sort_array(F.collect_list("n")).alias("stated")).withColumn("k", F.size("stated"))
    t = tables.groupBy("source").agg(F.sort_array(F.collect_list("n")).alias("found")).withColumn("k", F.size("found"))
    # Near lists have their smallest and largest n in neighbouring bands: sizes that differ by a fifth, or by one, differ by one band at most.
    band = lambda x: F.floor(F.log(F.greatest(x, F.lit(1))) / math.log(2))
    near_bands = lambda x: F.explode(F.array(*(band(x) + i for i in (-1, 0, 1))))
    c = c.withColumn("low", near_bands(F.element_at("stated", 1))).withColumn("high", near_bands(F.element_at("stated", -1)))
    t = t.withColumns({"low": band(F.element_at("found", 1)), "high": band(F.element_at("found", -1))})
    near = F.forall(F.arrays_zip(F.col("stated").alias("a"), F.col("found").alias("b")), lambda p: F.abs(p["a"] - p["b"]) <= F.greatest(F.lit(1), F.ceil(0.2 * p["b"])))
    return c.join(t, ["k", "low", "high"]).filter(near & (F.col("stated") != F.col("found"))).select("claim_id", "source", F.array_join("stated", ",").alias("stated"), F.array_join("found", ",").alias("found"))
