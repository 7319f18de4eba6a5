"""Sheets with several titled tables, and the checks on them."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import blocks as checks
from plumbline.sources import blocks, grids

SHEET = """Figure 2b Growth of flies,,,,Fig. 2c Weight,
,WT,KO,,Group,Weight
1,1.5,2.5,,a,10
2,2.5,3.5,,a,12
3,3.5,4.5,,b,20
Mean,2.5,3.5,,b,22
SD,1,1.1,,,
,,,,,
Some note,,,,,
Time,Alive,,,,
0,20,,,,
1,18,,,,
2,11,,,,
"""


@pytest.fixture(scope="module")
def rows(spark):
    files = spark.createDataFrame([("d/Source_Data_Fig2.csv", bytearray(SHEET.encode())), ("d/plain.csv", bytearray(b"a,b\n1,2\n3,4\n"))], "path string, content binary")
    return blocks.with_figures(blocks.blocks(grids.cells(files))).cache()


def test_blocks(rows):
    got = {(r["block"], r["title"], r["number"], r["panels"], r["explicit"]) for r in rows.collect()}
    assert got == {(0, "Figure 2b Growth of flies", "2", "b", True), (1, "Fig. 2c Weight", "2", "c", True), (2, "Some note", "2", "", False)}
    wt = rows.filter("block = 0 AND header = 'WT'").orderBy("row").collect()
    assert [(r["role"], r["num"]) for r in wt] == [("value", 1.5), ("value", 2.5), ("value", 3.5), ("mean", 2.5), ("sd", 1.0)]
    assert {(r["header"], r["role"]) for r in rows.filter("block = 1").collect()} == {("Group", "category"), ("Weight", "value")}


def test_layouts_and_ns(rows):
    assert {(r["block"], r["layout"]) for r in checks.layout(rows).collect()} == {(0, "single"), (1, "long"), (2, "xy")}
    assert {(r["panel"], r["group_key"], r["n"]) for r in checks.block_ns(rows).collect()} == {("b", "WT", 3), ("b", "KO", 3), ("c", "a", 2), ("c", "b", 2)}


def test_summaries(rows):
    assert {(r["header"], r["mean_status"], r["sd_status"]) for r in checks.summaries(rows).collect()} == {("WT", "ok", "sample"), ("KO", "ok", "unexplained")}


def test_copies(spark):
    cols = "path string, sheet string, block long, number string, panels string, explicit boolean, title string, col long, header string, role string, row long, num double, str string"
    vals = [1.0, 2.0, 3.0, 4.0, 9.0]
    make = lambda b, number, explicit, title, v: [("f", "s", b, number, "a", explicit, title, 1, "x", "value", i, x, None) for i, x in enumerate(v)]
    df = spark.createDataFrame(make(1, "1", True, "Fig 1a: dose", vals) + make(2, "2", True, "Fig. 2 dose", vals[::-1]) + make(3, "9", False, "", vals) + make(4, "4", True, "t", vals[:4]), cols)
    c = checks.columns(df)
    assert {(r["number_b"], r["same_condition"], r["n_in_order"]) for r in checks.reused_columns(c.filter("block < 3")).collect()} == {("2", True, 0)}
    assert {r["number"] for r in checks.reconciled(c).filter(F.col("block") == 3).collect()} == {"1"}
    assert sorted(r["n_copies"] for r in checks.distinct_blocks(c).collect()) == [1, 1, 2]


def test_layout_of_long_blocks(spark):
    """A block of any length keeps its layout, and so its n."""
    rows = spark.range(2001).selectExpr("'f' AS path", "'s' AS sheet", "1L AS block", "'1' AS number", "'a' AS panels", "0L AS col", "'WT' AS header", "'value' AS role", "id AS row", "double(id) AS num", "cast(null AS string) AS str")
    both = rows.union(rows.filter("row < 3").selectExpr("path", "sheet", "block", "number", "panels", "1L", "'KO'", "role", "row", "num", "str"))
    axis = both.withColumn("header", F.when(F.col("col") == 0, "Time").otherwise(F.col("header")))
    assert [r["layout"] for r in checks.layout(both).collect()] == ["wide"] and [r["layout"] for r in checks.layout(axis).collect()] == ["xy"]
    assert {(r["group_key"], r["n"]) for r in checks.block_ns(both).collect()} == {("WT", 2001), ("KO", 3)}


def test_printed_digits(spark):
    """A mean printed as 4.10 is told to two decimals, one without a text to its shortest notation."""
    vals = [1.0, 2.0, 3.0, 10.45]
    cell = lambda b, role, row, num, text=None: ("f", "s", b, 1, "x", role, row, num, text)
    rows = [cell(b, "value", i, x) for b in (1, 2) for i, x in enumerate(vals)] + [cell(1, "mean", 9, 4.1, "4.10"), cell(2, "mean", 9, 4.1)]
    df = spark.createDataFrame(rows, "path string, sheet string, block long, col long, header string, role string, row long, num double, str string")
    assert {(r["block"], r["mean_status"]) for r in checks.summaries(df).collect()} == {(1, "unexplained"), (2, "ok")}
