"""Extraction from literal paragraphs and the checks on it."""

from plumbline.operators import manuscript, refs


def paragraphs(spark, *texts):
    return spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc string, ord long, text string")


def test_panel_ns(spark):
    p = paragraphs(spark, "Figure 1. (a) Survival, n = 12. (b-d) Counts, n = 3-5 per group. (e) No number.", "n = 7 overall", None)
    got = {tuple(r)[1:] for r in manuscript.panel_ns(p).collect()}
    assert got == {(0, "a", 12, None), (0, "b", 3, 5), (0, "c", 3, 5), (0, "d", 3, 5), (1, "", 7, None)}


def test_references(spark):
    p = paragraphs(spark, "As shown [1-3, 5] and (Smith et al., 2019; Jones, 2020).", "References", "[1] Alpha B. A title (2001).", "continued line", "[2] Beta C. Other (2002). 10.1000/xyz.", "[4] Smith D. Third (2019).", "Figure legends", "[9] not one (1999)")
    bib = manuscript.bibliography(p)
    assert {(r["key"], r["alias"], r["year"], r["doi"]) for r in bib.collect()} == {("1", "alpha_2001", 2001, None), ("2", "beta_2002", 2002, "10.1000/xyz"), ("4", "smith_2019", 2019, None)}
    cites = manuscript.citations(p.filter("ord = 0"))
    assert {r["key"] for r in refs.missing_entries(cites, bib).collect()} == {"3", "5", "jones_2020"}
    assert {r["key"] for r in refs.orphan_entries(bib, cites).collect()} == set()


def test_antibodies(spark):
    p = paragraphs(spark, "mouse anti-FOO (HPA012345); rabbit anti-BAR raised in goat; rabbit anti-BAZ, ab12345", "goat anti-BAZ ab12345; donkey anti-chicken IgG; goat anti-mouse secondary")
    got = {tuple(r)[1:] for r in manuscript.antibody_conflicts(manuscript.antibodies(p)).collect()}
    assert got == {("catalog_host", "HPA012345|mouse|rabbit"), ("inline", "BAR|rabbit|goat"), ("identity", "AB12345|goat|rabbit"), ("unmatched_secondary", "chicken")}


def test_scale_bars(spark):
    mk = lambda rows: spark.createDataFrame(rows, "figure string, um double")
    assert [tuple(r) for r in manuscript.scale_bar_conflicts(mk([("1", 50.0)]), mk([("1", 50.0), ("1", 20.0), ("2", 9.0)])).collect()] == [("1", 20.0)]
