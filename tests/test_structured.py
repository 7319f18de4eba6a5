"""Extractor output and sinks."""

from plumbline.operators import findings, structured, vectors
from plumbline.sources import sinks


def test_legends(spark):
    raw = [("1", 'Sure: {"panels": [{"panel": "A ", "group": "wt", "n": 5, "n_max": 3, "confidence": 0.9}, {"panel": "b", "n": 0}, {"panel": "c", "n": 4, "confidence": 0.1}], "error_bar_type": "SEM"} done'), ("2", "nothing"), ("3", '{"tests": ["t"]}'), ("4", None)]
    df = spark.createDataFrame(raw, "figure string, raw string")
    got = structured.coerced(df)
    assert {r["figure"]: r["legend"] and r["legend"]["error_bar_type"] for r in got.collect()} == {"1": "sem", "2": None, "3": "unknown", "4": None}
    assert [tuple(r) for r in structured.panel_ns(got, ["figure"]).collect()] == [("1", "a", "wt", 5, None)]
    assert {r["figure"]: r["errors"] for r in structured.errors(df).collect()} == {"1": ["bad panels"], "2": ["no object"], "3": ["no panels"], "4": ["no object"]}


def test_votes_and_scores(spark):
    cols = "figure string, panel string, group string, n long"
    a, b = spark.createDataFrame([("1", "a", "", 5), ("1", "b", "", 6)], cols), spark.createDataFrame([("1", "a", "", 5), ("1", "b", "", 7)], cols)
    assert [tuple(r) for r in structured.voted(a, b, ["figure"]).collect()] == [("1", "a", "", 5)]
    gold = spark.createDataFrame([("1", "a", "", 4, 6, False), ("1", "c", "", 2, None, False), ("1", "b", "", None, None, True)], cols + ", n_max long, forbidden boolean")
    assert tuple(structured.extraction_scores(gold, a, ["figure"]).first()) == (0.5, 0.5, 0.5, 1)


def test_sinks(spark, tmp_path):
    obs = spark.createDataFrame([("s", g, float(v)) for g in ("a<b", "c") for v in (1, 2, 3, 5)], "source string, group_key string, value double")
    found = findings.duplicates(vectors.vectors(obs))
    sinks.write_findings(found, str(tmp_path / "f"))
    assert spark.read.json(str(tmp_path / "f")).count() == 1
    page = sinks.html_report(found)
    assert "a&lt;b = c" in page and "<td>P-SOURCE-DUPLICATE-VALUES</td>" in page
    for k in ("x", "y"):
        sinks.append_history(spark, k, {"recall": 1}, str(tmp_path / "h"))
    assert spark.read.json(str(tmp_path / "h")).count() == 2
