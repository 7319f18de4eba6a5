"""Digitised plots and printed residues: identical plots and panels, plots and residues against tables of another side.

Plots come as (plot, side, group_key, vals), panels as (page, panel, group_key, vals),
values sorted ascending.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.matching import coverage


def _met(a: DataFrame, b: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Rows of a (.., vals) and b (.., o_vals) with equal keys whose lengths and lowest and highest values allow a score of `least`, with it."""
    width = -math.log(min(0.99, max(0.05, least)))
    band = lambda c: F.floor(F.log(F.greatest(F.size(c), F.lit(1))) / width)
    left = a.withColumn("band", F.explode(F.array(*(band("vals") + i for i in (-1, 0, 1)))))
    met = left.join(b.withColumn("band", band("o_vals")), [*keys, "band"]).filter(F.least(F.size("vals"), F.size("o_vals")) >= least * F.greatest(F.size("vals"), F.size("o_vals")))
    return met.withColumn("score", coverage(F.col("vals"), F.col("o_vals"), 0.25)).filter(F.col("score") >= least)


def _one_to_one(scored: DataFrame, pair: list[str], groups: tuple[str, str]) -> DataFrame:
    """(pair, n_groups, mean_score): groups of two panels matched one to one, best scores first; a pair has few groups, so they meet in one row."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(groups[0]).alias("x"), F.col(groups[1]).alias("y"))))
    start = F.struct(F.array().cast("array<string>").alias("xs"), F.array().cast("array<string>").alias("ys"), F.lit(0).alias("n"), F.lit(0.0).alias("t"))

    def step(acc: Column, e: Column) -> Column:
        free = ~F.array_contains(acc["xs"], e["x"]) & ~F.array_contains(acc["ys"], e["y"])
        taken = F.struct(F.array_append(acc["xs"], e["x"]).alias("xs"), F.array_append(acc["ys"], e["y"]).alias("ys"), (acc["n"] + 1).alias("n"), (acc["t"] - e["s"]).alias("t"))
        return F.when(free, taken).otherwise(acc)

    g = scored.groupBy(*pair).agg(F.aggregate(order, start, step).alias("m"))
    return g.select(*pair, F.col("m.n").alias("n_groups"), F.round(F.col("m.t") / F.greatest(F.col("m.n"), F.lit(1)), 6).alias("mean_score"))


def identical_plots(plots: DataFrame, groups: int = 2, least: float = 0.95) -> DataFrame:
    """(plot_a, plot_b, n_groups, mean_score): plots of different sides that share the values of `groups` groups of the same name at least."""
    a = plots.select(F.col("plot").alias("plot_a"), F.col("side").alias("side_a"), "group_key", "vals")
    b = plots.select(F.col("plot").alias("plot_b"), F.col("side").alias("side_b"), "group_key", F.col("vals").alias("o_vals"))
    met = _met(a, b, ["group_key"], least).filter("plot_a < plot_b AND side_a <> side_b")
    g = met.groupBy("plot_a", "plot_b").agg(F.count_distinct("group_key").alias("n_groups"), F.round(F.avg("score"), 6).alias("mean_score"))
    return g.filter(F.col("n_groups") >= groups)


def identical_panels(panels: DataFrame, groups: int = 2, least: float = 0.98, gap: int = 3, across: bool = False) -> DataFrame:
    """(page_a, panel_a, page_b, panel_b, n_groups, mean_score): panels of a page whose letters lie `gap` apart at least, or, across, of different pages, that show the same groups."""
    a = panels.select(F.col("page").alias("page_a"), F.col("panel").alias("panel_a"), F.col("group_key").alias("g_a"), "vals", F.bround(F.element_at("vals", 1)).alias("low"))
    b = panels.select(F.col("page").alias("page_b"), F.col("panel").alias("panel_b"), F.col("group_key").alias("g_b"), F.col("vals").alias("o_vals"), F.explode(F.array(*(F.bround(F.element_at("vals", 1)) + i for i in (-1.0, 0.0, 1.0)))).alias("low"))
    met = _met(a, b, ["low"], least).filter("page_a < page_b" if across else "page_a = page_b AND panel_a < panel_b")
    met = met if across else met.filter(F.ascii("panel_b") - F.ascii("panel_a") >= gap)
    keys = ["page_a", "panel_a", "page_b", "panel_b"]
    return _one_to_one(met.dropDuplicates([*keys, "g_a", "g_b"]), keys, ("g_a", "g_b")).filter(F.col("n_groups") >= groups)


def other_side(best: DataFrame, tables: DataFrame, least: float = 0.9, groups: int = 2, close: float = 0.05) -> DataFrame:
    """(plot, expected, found, score): plots whose best table (plot, side, source, n_groups, mean_score) is of another side than theirs, while no table of their own side comes within `close`.

    tables: (source, side). Of each plot the best rows of all tables are given.
    """
    j = best.join(tables.select("source", F.col("side").alias("t_side")), "source")
    top = j.groupBy("plot", "side").agg(F.max_by(F.struct("t_side", "mean_score", "n_groups"), F.struct("mean_score", "n_groups", "source")).alias("b"), F.max(F.when(F.col("side") == F.col("t_side"), F.col("mean_score"))).alias("own"))
    wrong = (F.col("b.t_side") != F.col("side")) & (F.col("b.mean_score") >= least) & (F.col("b.n_groups") >= groups) & (F.coalesce("own", F.lit(0.0)) < F.col("b.mean_score") - close)
    return top.filter(wrong).select("plot", F.col("side").alias("expected"), F.col("b.t_side").alias("found"), F.col("b.mean_score").alias("score"))


def diverging(residues: DataFrame, plots: DataFrame) -> DataFrame:
    """(folder, residue, plot, residue_side, plot_side): residues and plots of a folder (folder, path, side of its best table) that lead to different sides."""
    r = residues.select("folder", F.col("path").alias("residue"), F.col("side").alias("residue_side"))
    p = plots.select("folder", F.col("path").alias("plot"), F.col("side").alias("plot_side"))
    firsts = p.groupBy("folder", "plot_side").agg(F.min("plot").alias("plot"))
    return r.join(firsts, "folder").filter("residue_side <> plot_side").select("folder", "residue", "plot", "residue_side", "plot_side")


def contrasts(residues: DataFrame) -> DataFrame:
    """(path, label, ref, estimate, p) of printed contrasts in residues (path, text): lines such as "KO - WT   1.25  0.3  4.1  0.002", once each."""
    number = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
    line = rf"(?m)^\s*([A-Za-z][A-Za-z0-9_.+]*) - ([A-Za-z][A-Za-z0-9_.+]*)(?: == 0)?\s+({number})((?:\s+{number})*?)\s+(?:<\s*)?({number})\s*[*.]*\s*$"
    found = residues.select("path", F.explode(F.regexp_extract_all("text", F.lit(line), 0)).alias("l"))
    part = lambda g: F.regexp_extract("l", line, g)
    return found.select("path", part(1).alias("label"), part(2).alias("ref"), part(3).cast("double").alias("estimate"), part(5).cast("double").alias("p")).distinct()


def axes(marks: DataFrame) -> DataFrame:
    """(axis, slope, intercept, n): the straight line by which tick marks (axis, at, value) turn places into values, for axes of two different places at least."""
    g = marks.groupBy("axis").agg(F.regr_slope("value", "at").alias("slope"), F.regr_intercept("value", "at").alias("intercept"), F.count("*").alias("n"), F.count_distinct("at").alias("k"))
    return g.filter("k >= 2").drop("k")


def visible_counts(matrix: DataFrame, counts: DataFrame) -> DataFrame:
    """The n matrix with the dots seen in each panel's figure (figure, panel, group_key, dots), for reference: no mismatch rests on them."""
    return matrix.join(counts, ["figure", "panel", "group_key"], "left")


def count_matrices(headers: DataFrame) -> DataFrame:
    """(directory, status): folders of single-cell counts (directory, n_barcodes, n_features, rows, cols, entries): whether names and matrix have the same dimensions."""
    kinds = {"no_matrix": F.col("rows").isNull(), "features": F.col("n_features") != F.col("rows"), "barcodes": F.col("n_barcodes") != F.col("cols"), "empty": F.col("entries") == 0}
    told = F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in kinds.items()))), ",")
    return headers.select("directory", F.when(told == "", "ok").otherwise(told).alias("status"))


def matrix_headers(files: DataFrame) -> DataFrame:
    """(directory, n_barcodes, n_features, rows, cols, entries) of text files (path, value: a line) of folders that hold barcodes, features (or genes) and a matrix."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    f = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("directory"), F.when(name.rlike("^barcodes"), "b").when(name.rlike("^(features|genes)"), "f").when(name.rlike(r"^matrix.*\.mtx"), "m").alias("kind"), "value")
    size = F.regexp_extract_all("value", F.lit(r"^\s*([0-9]+)\s+([0-9]+)\s+([0-9]+)\s*$"), 0)
    head = F.when((F.col("kind") == "m") & (F.size(size) > 0), F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("long")))
    # The line of dimensions is the largest of a matrix: no entry lies beyond it.
    g = f.groupBy("directory").agg(F.count_if((F.col("kind") == "b") & (F.trim("value") != "")).alias("n_barcodes"), F.count_if((F.col("kind") == "f") & (F.trim("value") != "")).alias("n_features"), F.max(head).alias("h"), F.count_distinct("kind").alias("kinds"))
    return g.filter("kinds = 3").select("directory", "n_barcodes", "n_features", F.col("h")[0].alias("rows"), F.col("h")[1].alias("cols"), F.col("h")[2].alias("entries"))
