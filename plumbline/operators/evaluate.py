"""Findings against gold sets and earlier runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def precision_recall(gold: DataFrame, found: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Per `by`: hits, n_gold, n_found, recall, precision; duplicates count once."""
    g, f = gold.select(*by, *keys).distinct(), found.select(*by, *keys).distinct()
    both = g.withColumn("in_g", F.lit(1)).join(f.withColumn("in_f", F.lit(1)), [*by, *keys], "full_outer")
    out = both.groupBy(*by).agg(F.sum(F.coalesce(F.col("in_g") * F.col("in_f"), F.lit(0))).alias("hits"), F.count("in_g").alias("n_gold"), F.count("in_f").alias("n_found"))
    return out.withColumns({"recall": F.round(F.try_divide(F.col("hits").cast("double"), F.col("n_gold")), 6), "precision": F.round(F.try_divide(F.col("hits").cast("double"), F.col("n_found")), 6)})


def rollup(scores: DataFrame, first: str, second: str) -> DataFrame:
    """Sums of hits and n_gold and micro recall by first, by second and over all, marked by level."""
    scores.createOrReplaceTempView("_plumbline_scores")
    return scores.sparkSession.sql(f"""
        SELECT {first}, {second}, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(n_gold) AS BIGINT) AS n_gold, CAST(grouping_id() AS BIGINT) AS level,
               round(try_divide(CAST(sum(hits) AS DOUBLE), sum(n_gold)), 6) AS micro_recall
        FROM _plumbline_scores GROUP BY GROUPING SETS (({first}), ({second}), ())""")


def pattern_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("pattern_id").agg(F.count_if(~F.col("demoted")).alias("n_active"), F.count_if("demoted").alias("n_demoted"))


def against_baseline(now: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_now, n_before, verdict) where counts differ: regression if there are more findings, improvement if fewer."""
    j = now.select(*keys, F.col("n").alias("n_now")).join(before.select(*keys, F.col("n").alias("n_before")), keys, "full_outer").select(*keys, F.coalesce("n_now", F.lit(0)).cast("long").alias("n_now"), F.coalesce("n_before", F.lit(0)).cast("long").alias("n_before"))
    return j.filter("n_now <> n_before").withColumn("verdict", F.when(F.col("n_now") > F.col("n_before"), "regression").otherwise("improvement"))


def unexplained(counts: DataFrame, accepted: DataFrame, keys: list[str]) -> DataFrame:
    """Counts less accepted ones, where positive."""
    j = counts.join(accepted.select(*keys, F.col("n").alias("_ok")), keys, "left").withColumn("left_over", F.col("n") - F.coalesce("_ok", F.lit(0)))
    return j.filter("left_over > 0").select(*keys, F.col("left_over").cast("long").alias("left_over"))


def gate(now: DataFrame, before: DataFrame) -> DataFrame:
    """(split, passed) of scores (split, hits, n_gold, recall, precision): recall may fall by max(1 / n, 0.02), precision not at all."""
    j = now.alias("a").join(before.alias("b"), "split")
    slack = F.greatest(F.try_divide(F.lit(1.0), F.col("a.n_gold")), F.lit(0.02))
    return j.select("split", ((F.col("a.recall") >= F.col("b.recall") - slack - 1e-9) & (F.col("a.precision") >= F.col("b.precision") - 1e-9)).alias("passed"))


def iou(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> F.Column:
    """Overlap over union of two boxes, each given by its columns left, top, right, bottom."""
    l1, t1, r1, b1 = map(F.col, a)
    l2, t2, r2, b2 = map(F.col, b)
    inner = F.greatest(F.lit(0.0), F.least(r1, r2) - F.greatest(l1, l2)) * F.greatest(F.lit(0.0), F.least(b1, b2) - F.greatest(t1, t2))
    return F.coalesce(F.try_divide(inner, (r1 - l1) * (b1 - t1) + (r2 - l2) * (b2 - t2) - inner), F.lit(0.0))


def bootstrap_recall(cases: DataFrame, iterations: int = 1000, seed: int = 0) -> DataFrame:
    """(split, recall, low, high): micro recall of cases (split, hits, n_gold) with a seeded 95 % interval.

    Cases are weighted by Poisson counts drawn per (case, iteration), so partial
    sums meet instead of cases and a split may be of any size.
    """
    draws = cases.select("split", "hits", "n_gold", F.xxhash64("split", "case").alias("h"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in frames:
            for split, hits, n, h in zip(pdf["split"], pdf["hits"], pdf["n_gold"], pdf["h"], strict=True):
                w = np.random.default_rng([seed, h & 0xFFFFFFFFFFFFFFFF]).poisson(1.0, iterations)
                own = sums.setdefault(split, np.zeros((2, iterations)))
                own += np.outer([hits, n], w)
        rows = [(s, i, a[0, i], a[1, i]) for s, a in sums.items() for i in range(iterations)]
        yield pd.DataFrame(rows, columns=["split", "i", "hits", "n"])

    sums = draws.mapInPandas(run, "split string, i int, hits double, n double").groupBy("split", "i").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    ci = sums.filter("n > 0").groupBy("split").agg(F.percentile(F.col("hits") / F.col("n"), F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    micro = cases.groupBy("split").agg(F.try_divide(F.sum("hits").cast("double"), F.sum("n_gold")).alias("recall"))
    return micro.join(ci, "split").select("split", F.round("recall", 6).alias("recall"), F.round(F.col("p")[0], 6).alias("low"), F.round(F.col("p")[1], 6).alias("high"))


def supports(item: str = "i", found: str = "f") -> F.Column:
    """A finding (pattern_id, panel, evidence, tags) supports a gold item: a tag in common, the item's pattern or none asked for, and its panel or its evidence."""
    tags = F.arrays_overlap(F.col(f"{item}.tags"), F.col(f"{found}.tags"))
    pattern = F.col(f"{item}.pattern_id").isNull() | (F.col(f"{item}.pattern_id") == F.col(f"{found}.pattern_id"))
    panel = F.col(f"{item}.panel") == F.col(f"{found}.panel")
    evidence = F.contains(F.lower(F.col(f"{found}.evidence")), F.lower(F.col(f"{item}.evidence")))
    return tags & pattern & F.coalesce(panel | evidence, panel, evidence, F.lit(False))


def matched_items(items: DataFrame, found: DataFrame) -> DataFrame:
    """items (case, item, pattern_id, panel, evidence, tags) with matched: whether a finding of the case (pattern_id, panel, evidence, tags) supports them. They meet by tag."""
    i = items.withColumn("tag", F.explode("tags")).alias("i")
    f = found.withColumn("tag", F.explode("tags")).alias("f")
    hits = i.join(f, (F.col("i.case") == F.col("f.case")) & (F.col("i.tag") == F.col("f.tag"))).filter(supports()).select(F.col("i.case").alias("case"), F.col("i.item").alias("item")).distinct()
    return items.join(hits.withColumn("matched", F.lit(True)), ["case", "item"], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def layers(items: DataFrame) -> DataFrame:
    """items (.., matched, skipped, parsed, linked, checked) with the layer that lost them: none, skipped, parser, linking, check or match."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return items.withColumn("layer", F.when(yes("matched"), "none").when(yes("skipped"), "skipped").when(~yes("parsed"), "parser").when(~yes("linked"), "linking").when(~yes("checked"), "check").otherwise("match"))


def layer_summary(diagnosed: DataFrame) -> DataFrame:
    """(layer, n_items, share) over all items."""
    total = F.sum("n_items").over(Window.partitionBy(F.lit(0)))
    return diagnosed.groupBy("layer").agg(F.count("*").alias("n_items")).withColumn("share", F.round(F.col("n_items") / total, 6))


def clean_summary(findings: DataFrame, papers: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(pattern_id, n, n_unexplained, papers_with, per_paper) of findings (paper, pattern_id) on clean papers (paper); expected (pattern_id, paper, n) are explained."""
    each = findings.join(papers, "paper", "left_semi").groupBy("pattern_id", "paper").agg(F.count("*").alias("n"))
    each = each.join(expected.select("pattern_id", "paper", F.col("n").alias("ok")), ["pattern_id", "paper"], "left") if expected is not None else each.withColumn("ok", F.lit(0))
    each = each.withColumn("rest", F.greatest(F.col("n") - F.coalesce("ok", F.lit(0)), F.lit(0)))
    k = papers.agg(F.count_distinct("paper").alias("k"))
    g = each.groupBy("pattern_id").agg(F.sum("n").alias("n"), F.sum("rest").cast("long").alias("n_unexplained"), F.count_if(F.col("rest") > 0).alias("papers_with"))
    return g.crossJoin(F.broadcast(k)).select("pattern_id", "n", "n_unexplained", "papers_with", F.round(F.col("n_unexplained") / F.greatest(F.col("k"), F.lit(1)), 3).alias("per_paper"))


def dashboard(items: DataFrame, findings: DataFrame, clean: DataFrame) -> DataFrame:
    """(pattern_id, n_gold, hits, n_found, recall, precision, clean_n): gold items (pattern_id, matched), findings (pattern_id, supported) and clean_summary's rows side by side."""
    g = items.groupBy("pattern_id").agg(F.count("*").alias("n_gold"), F.count_if("matched").alias("hits"))
    f = findings.groupBy("pattern_id").agg(F.count("*").alias("n_found"), F.count_if("supported").alias("supported"))
    j = g.join(f, "pattern_id", "full_outer").join(clean.select("pattern_id", F.col("n_unexplained").alias("clean_n")), "pattern_id", "full_outer").na.fill(0, ["n_gold", "hits", "n_found", "supported", "clean_n"])
    share = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b)), 6)
    return j.select("pattern_id", "n_gold", "hits", "n_found", share("hits", "n_gold").alias("recall"), share("supported", "n_found").alias("precision"), "clean_n")


def input_gaps(links: DataFrame, states: tuple[str, ...] = ("linked", "soft", "unlinked", "no_data")) -> DataFrame:
    """(status, n): links by status, those without any among them."""
    every = links.sparkSession.createDataFrame([(s,) for s in states], "status string")
    return every.join(links.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def contributions(scores: DataFrame) -> DataFrame:
    """(rule, split, hits, lost): what each rule adds: hits with it less hits without it, of scores (rule, split, enabled, hits)."""
    g = scores.groupBy("rule", "split").agg(F.sum(F.when(F.col("enabled"), F.col("hits")).otherwise(0)).alias("with_it"), F.sum(F.when(~F.col("enabled"), F.col("hits")).otherwise(0)).alias("without"))
    return g.select("rule", "split", (F.col("with_it") - F.col("without")).cast("long").alias("hits"), F.greatest(F.col("without") - F.col("with_it"), F.lit(0)).cast("long").alias("lost"))


def bakeoff(profiles: DataFrame, backends: DataFrame) -> DataFrame:
    """(profile, backend, status): profiles (profile, backend) that can run: ready where the backend (backend, available) is there, unavailable or unknown else."""
    j = profiles.join(backends, "backend", "left")
    return j.select("profile", "backend", F.when(F.col("available").isNull(), "unknown").when(F.col("available"), "ready").otherwise("unavailable").alias("status"))


def planted_recall(planted: DataFrame, found: DataFrame) -> DataFrame:
    """(n, hits, recall, n_cited, n_cited_found): planted pairs (a, b, cited) against found pairs (a, b) in either order; cited ones should not be found."""
    order = lambda d: d.withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")}).drop("a", "b")
    j = order(planted).join(order(found).select("x", "y").distinct().withColumn("hit", F.lit(True)), ["x", "y"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    g = j.agg(F.count_if(~F.col("cited")).alias("n"), F.count_if(~F.col("cited") & F.col("hit")).alias("hits"), F.count_if("cited").alias("n_cited"), F.count_if(F.col("cited") & F.col("hit")).alias("n_cited_found"))
    return g.withColumn("recall", F.round(F.try_divide(F.col("hits").cast("double"), F.col("n")), 6))


def coverage(checks: DataFrame, ran: DataFrame, inputs: DataFrame) -> DataFrame:
    """(check, status, n_findings): for each check (check, needs: array of inputs) whether it ran (check, n_findings), or which of the inputs (input) it lacked."""
    have = inputs.agg(F.coalesce(F.collect_set("input"), F.array().cast("array<string>")).alias("have"))
    j = checks.crossJoin(F.broadcast(have)).withColumn("lacks", F.array_sort(F.array_except("needs", "have"))).join(ran, "check", "left")
    status = F.when(F.col("n_findings").isNotNull(), "ran").when(F.size("lacks") > 0, F.concat(F.lit("skipped: no "), F.array_join("lacks", ", "))).otherwise("not run")
    return j.select("check", status.alias("status"), F.coalesce("n_findings", F.lit(0)).cast("long").alias("n_findings"))
