"""Rules of the checks on literal rows."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import arrays, claims, stats, text
from plumbline.operators import catalog, evaluate, graph, nearest, ordered, pairs, refs, similarity, vectors


def obs(spark, groups):
    return spark.createDataFrame([("f", g, float(v)) for g, vs in groups.items() for v in vs], "source string, group_key string, value double")


def test_duplicates_and_controls(spark):
    same = [1.01, 1.12, 0.98, 1.07, 1.15]
    out = pairs.duplicates_within_source(vectors.vectors(obs(spark, {"gene_a": same, "gene_b": same, "ctrl1": [1, 2, 3, 4], "ctrl2": [1, 2, 3, 4]}))).collect()
    assert sorted((r["group_key"], r["class_group"], r["n"], r["n_links"]) for r in out) == [("gene_a", "gene_a", 5, 1), ("gene_b", "gene_a", 5, 1)]


def test_ratio(spark):
    out = pairs.ratios_within_source(vectors.vectors(obs(spark, {"lo": [1, 1.5, 2, 2.5, 3], "hi": [10, 15, 20, 25, 30], "zero": [0, 15, 20, 25, 30]}))).collect()
    assert [(r["group_a"], r["group_b"], r["k"]) for r in out] == [("hi", "lo", 10)]


@pytest.mark.parametrize(("a", "b", "kind"), [([1.0, 1.1, 1.2, 1.3, 1.4, 1.5, 1.6], [1.1, 1.2, 1.3, 1.4, 1.5], "endpoint_dropout"), ([1.0, 2.0, 3.0], [1.0, 2.0, 3.0], "exact"), ([1.0, 2.0, 4.0, 5.0], [1.0, 2.0, 3.0, 4.0, 5.0], "subset"), ([1.0, 2.0], [2.0, 3.0, 4.0], None)])
def test_share_kinds(spark, a, b, kind):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    assert df.select(arrays.share_kind(F.col("a"), F.col("b"))).first()[0] == kind


def test_stated_sd_and_mean(spark):
    o = obs(spark, {"g": [1.0, 2.0, 3.0, 10.0]})
    stated = spark.createDataFrame([("f", "g", 3.54, "3.54")], "source string, group_key string, stated double, printed string")
    assert vectors.check_sds(o, stated).first()["kind"] == "population"
    mean = spark.createDataFrame([("f", "g", 2.0, "2.0")], "source string, group_key string, stated double, printed string")
    assert vectors.check_means(vectors.vectors(o), mean).first()["status"] == "dropped_value"


def test_p_values():
    assert stats.t_p(2.228, 10) == pytest.approx(0.05, abs=1e-4) and stats.t_p(12.706, 1) == pytest.approx(0.05, abs=1e-4)
    assert stats.f_p(4.26, 2, 9) == pytest.approx(0.05, abs=1e-3)


def test_repeating_fractions(spark):
    df = vectors.derived_precision(obs(spark, {"treated": [0.3333, 0.6667, 1.3333, 0.1429, 0.5714], "ctrl": [1.25, 0.75, 1.5, 0.5, 1.0]}))
    assert {r["group_key"]: r["kind"] for r in df.collect()} == {"treated": "repeating_fraction", "ctrl": None}


def test_survival(spark):
    rows = [("c", d, s, float(a), 20) for d, s, a in ((0, 1.0, 20), (1, 0.85, 17), (2, 0.775, 14), (3, 0.5, 10))]
    out = ordered.survival_audit(spark.createDataFrame(rows, "curve string, ord int, survival double, alive double, n0 int")).collect()
    assert [(r["ord"], r["expected"], r["not_whole"], r["alive_gap"]) for r in out] == [(2, 15.5, True, True)]


def test_cohort(spark):
    rows = [("a", i, v) for i, v in enumerate((1.0, 0.8, 0.6, 0.4))] + [("b", i, v) for i, v in enumerate((0.5, 0.4, 0.3))]
    out = ordered.cohort_sizes(spark.createDataFrame(rows, "curve string, ord int, survival double"), 50).collect()
    assert {r["curve"]: r["n"] for r in out} == {"a": 5, "b": None}


def test_nearest_claim(spark):
    groups = spark.createDataFrame([("s", "a", 1.0), ("s", "b", 2.0), ("s", "c", 9.0)], "source string, group_key string, y double")
    claims = spark.createDataFrame([("s", "1", 1.6), ("s", "2", 100.0), ("s", "3", -5.0), ("t", "4", 1.0), ("s", "5", 1.5)], "source string, claim_id string, x double")
    assert {(r["claim_id"], r["group_key"]) for r in nearest.nearest(claims, groups).collect()} == {("1", "b"), ("2", "c"), ("3", "a"), ("5", "a")}


def test_exclusion_ids(spark):
    mk = lambda ids: spark.createDataFrame([("s", i) for i in ids], "source string, id string")
    out = refs.id_sets(mk(["f5", "F9"]), mk(["F5", "F6"])).collect()
    assert {(r["id"], r["status"]) for r in out} == {("F5", "matched"), ("F9", "phantom"), ("F6", "undeclared")}


def test_matching_by_title(spark):
    cols = "string, doi string, year int, title string"
    bib = spark.createDataFrame([("e1", None, 2001, "Growth of small flies"), ("e2", "d2", 2002, "x"), ("e3", None, 2003, "nothing like it")], f"entry {cols}")
    files = spark.createDataFrame([("f1", None, 2001, "growth of small flies in spring"), ("f2", "d2", 1999, "other"), ("f3", None, 2001, "growth of small flies revised")], f"file {cols}")
    assert {(r["entry"], r["status"], r["file"]) for r in refs.matched_by_priority(bib, files).collect()} == {("e1", "ambiguous", None), ("e2", "matched", "f2"), ("e3", "unmatched", None)}


def test_lineage(spark):
    py = "import pandas as pd\nd = pd.read_csv('a.csv')\nwt = d[d.g == 'wt']\nplt.plot(wt)\nplt.bar(wt)\nwt.to_csv('ko.csv')"
    r = "d <- read.csv('b.csv')\nsub <- d[d$x > 1, ]\nplot(sub)\nwrite.csv(sub, 'out.csv')"
    e = graph.script_edges(spark.createDataFrame([("p.py", py), ("q.R", r), ("bad.py", "def")], "path string, code string"))
    got = {tuple(x) for x in e.collect()}
    assert {("p.py", "a.csv", "d", "read"), ("p.py", "d", "wt", "derive"), ("p.py", "wt", "ko.csv", "save"), ("q.R", "b.csv", "d", "read"), ("q.R", "sub", "out.csv", "save")} <= got
    assert [tuple(x) for x in graph.save_conflicts(e, ["wt", "ko"]).collect()] == [("p.py", "wt", "ko.csv")]
    assert [x["src"] for x in graph.plotted_twice(e).collect()] == ["wt"]


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (5, 5)], "a int, b int")
    assert {(r["id"], r["component"]) for r in graph.components(e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (10, 10), (11, 10)}


def test_images():
    import numpy as np

    r = np.random.default_rng(1)
    a = r.random((80, 90))
    assert similarity.correlation(a, a) == pytest.approx(1) and similarity.correlation(a, a * 0) == 0
    assert similarity.containment(a[20:50, 30:60], a) == pytest.approx(1) and similarity.containment(r.random((30, 30)), a) < 0.5
    assert similarity.descriptor(a) @ similarity.descriptor(a) == pytest.approx(1)


def test_gate(spark):
    cols = "split string, hits long, n_gold long, recall double, precision double"
    now, before = spark.createDataFrame([("a", 8, 10, 0.8, 0.9), ("b", 8, 10, 0.7, 0.9)], cols), spark.createDataFrame([("a", 9, 10, 0.9, 0.9), ("b", 9, 10, 0.9, 0.9)], cols)
    assert {(r["split"], r["passed"]) for r in evaluate.gate(now, before).collect()} == {("a", True), ("b", False)}


def test_catalog(spark):
    assert len(catalog.PATTERNS) == 38 and catalog.enabled(catalog.rules(spark)).count() == 37


@pytest.mark.parametrize(("s", "want"), [("c-e", "c,d,e"), ("bcf", "b,c,f"), ("a, b", "a,b"), ("D, E and H", "d,e,h"), ("K–M", "k,l,m")])
def test_panel_letters(spark, s, want):
    assert spark.createDataFrame([(s,)], "s string").select(F.array_join(text.panel_letters(F.col("s")), ",")).first()[0] == want


@pytest.mark.parametrize(("s", "want"), [("1,234.5", 1234.5), ("12 %", 12.0), ("-1e-3", -0.001), ("abc", None), ("1.2.3", None), ("", None)])
def test_numbers(spark, s, want):
    from plumbline.sources.grids import number

    assert spark.createDataFrame([(s,)], "s string").select(text.parse_number(F.col("s"))).first()[0] == want == number(s)


def test_redacted_keeps_whole_texts(spark):
    long = "word " * 5000 + "a@b.org"
    row = spark.createDataFrame([(long,)], "t string").select(text.redacted(F.col("t")).alias("whole"), text.redacted(F.col("t"), 10).alias("cut")).first()
    assert row["whole"] == long[:25000] + "[EMAIL]" and row["cut"] == long[:10]


def test_claims_of_many_digits(spark):
    """Numbers and ids are read whole, however long; what no long holds has no n."""
    df = spark.createDataFrame([("Animals F12345 and m1234567 were excluded. ~1234567 rats per vial, 12345678 colonies and 99999999999999999999 cells. Taken with a 12345x lens.",)], "t string")
    t = F.col("t")
    r = df.select(claims.declared_exclusions(t).alias("ids"), claims.cohort(t)["n"].alias("n"), claims.counted(t).alias("counts"), claims.magnifications(t).alias("m")).first()
    assert r["ids"] == ["F12345", "M1234567"] and r["n"] == 1234567 and r["m"] == [12345.0]
    assert [tuple(c) for c in r["counts"]] == [(12345678, "colonies"), (None, "cells")]
