"""Findings, matches and panels on literal rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import catalog, findings, matching, panels


def obs(spark, rows):
    return spark.createDataFrame([(s, g, float(v)) for s, g, vs in rows for v in vs], "source string, group_key string, value double")


def texts(spark, *lines):
    return spark.createDataFrame([("d", t) for t in lines], "doc string, text string")


def test_screening(spark):
    ctrl = [1.0, 1.1, 1.2, 1.35, 1.5]
    rows = [("a", "ctrl", ctrl), ("a", "mut", [3.0, 3.5, 4.2, 5.1, 6.3]), ("a", "het", [3.0, 3.5, 4.2, 5.1, 6.3]), ("b", "ctrl", ctrl), ("b", "mut", [10.0, 11.0, 12.0, 13.5, 15.0])]
    def run(*lines):
        return {(r["pattern_id"], r["severity"], r["location"]) for r in findings.screened(obs(spark, rows), texts(spark, *lines), catalog.rules(spark)).collect()}

    base = {("P-SOURCE-DUPLICATE-VALUES", "warning", "a: het = mut"), ("P-SOURCE-RATIO-ARTIFACT", "warning", "b: ctrl / mut")}
    shared = {("P-SHARED-CONTROL-UNDISCLOSED", "warning", "a: ctrl"), ("P-SHARED-CONTROL-UNDISCLOSED", "warning", "b: ctrl")}
    assert run("Differences by t-test.") == base | shared | {("P-STAT-MULTIPLICITY-GAP", "warning", "a")}
    assert run("The same control was used.") == base
    assert run("control data") == base | {(p, "info", x) for p, _, x in shared}


def test_methods_and_sides(spark):
    scripts = spark.createDataFrame([("x.R", "t.test(a, b)")], "path string, code string")
    out = findings.stat_method(texts(spark, "One-way ANOVA"), scripts).collect()
    assert [(r["pattern_id"], r["sources"]) for r in out] == [("P-STAT-METHOD-INCONSISTENT", ["x.R"])]
    paths = spark.createDataFrame([("d/alpha_1.csv",), ("d/beta_1.csv",), ("e/alpha.csv",)], "path string")
    assert [r["location"] for r in findings.side_conflicts(paths, ["alpha", "beta"]).collect()] == ["d"]


@pytest.mark.parametrize(("a", "b", "want"), [([1.0, 2.0, 3.0], [1.1, 2.2, 9.0], 2 / 3), ([1.0], [1.0, 1.1], 0.5), ([], [1.0], 0.0), ([1.0, 1.2], [1.2, 1.4], 1.0)])
def test_coverage(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    assert df.select(matching.coverage(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


def test_residues(spark):
    res = spark.createDataFrame([("r", "f", 10.0, 20.0), ("ok", "f", 2.0, 1.0)], "path string, folder string, mean_a double, mean_b double")
    st = spark.createDataFrame([("t", "f", "a", 1.0), ("t", "f", "b", 2.0)], "source string, folder string, group_key string, mean double")
    assert [tuple(r) for r in matching.unmatched_residues(res, st).collect()] == [("r", "t", 27.0)]


def test_local_files_and_cards(spark):
    names = spark.createDataFrame([("s/p.R", "C:\\x\\Data.csv")], "script string, name string")
    files = spark.createDataFrame([("o/data.csv", 9), ("s/data.csv", 1)], "path string, modified long")
    assert matching.local_files(names, files).first()["path"] == "s/data.csv"
    claims = spark.createDataFrame([("c", 5), ("c", 10)], "claim_id string, n long")
    tables = spark.createDataFrame([("t", 5), ("t", 11), ("u", 5), ("u", 10), ("v", 5), ("v", 30)], "source string, n long")
    assert [tuple(r) for r in matching.shape_cards(claims, tables).collect()] == [("c", "t", "5,10", "5,11")]


def test_panels(spark):
    r = np.random.default_rng(1)
    page = np.full((300, 400), 255.0)
    page[10:140, 10:190] = r.integers(0, 200, (130, 180))
    page[10:140, 210:390] = r.integers(0, 200, (130, 180))
    page[160:290, 10:390] = r.integers(0, 200, (130, 380))
    assert panels.split(page) == [(10, 10, 190, 140), (210, 10, 390, 140), (10, 160, 390, 290)]
    a, b = r.random((40, 80)), r.random((40, 80))
    b[:, 20:40] = a[:, 60:80]
    assert [(i, j) for i, j, _ in panels.reused_lanes(a, b)] == [(3, 1)] and panels.reused_lanes(a, a) == []
    labels = spark.createDataFrame([(1, "a", 0.0, 0.0, 100.0, 100.0), (1, "b", 50.0, 2.0, 100.0, 100.0), (1, "c", 0.0, 60.0, 100.0, 100.0)], "page int, letter string, x double, y double, page_w double, page_h double")
    assert {tuple(x)[1:] for x in panels.panels_from_labels(labels).collect()} == {("a", 0.0, 0.0, 50.0, 60.0), ("b", 50.0, 2.0, 100.0, 60.0), ("c", 0.0, 60.0, 100.0, 100.0)}
