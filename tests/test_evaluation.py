"""Catalog files, coverage, planted pairs, emitters."""

import pytest

from plumbline.operators import catalog, emitters, evaluate


def test_catalog_files(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"patterns": [{"pattern_id": "P-A", "priority": "P0", "enabled": true}, {"pattern_id": "P-B", "status": "planned"}]}')
    c = catalog.load(spark, str(tmp_path / "c.json"))
    assert {(r["pattern_id"], r["priority"], r["status"], r["enabled"]) for r in c.collect()} == {("P-A", "P0", None, True), ("P-B", None, "planned", None)}
    catalog.save(c, str(tmp_path / "out"))
    assert {r["pattern_id"] for r in spark.read.json(str(tmp_path / "out")).collect()} == {"P-A", "P-B"}
    assert [r["text"] for r in catalog.as_yaml(c).orderBy("pattern_id").collect()] == ['- id: "P-A"\n  priority: "P0"\n  enabled: true', '- id: "P-B"\n  status: "planned"\n  enabled: false']
    assert "title" not in catalog.shared(c).first()["payload"]
    mined = spark.createDataFrame([("a", 9000, False), ("b", 800, False), ("c", 5, True), ("d", 7, False)], "reason string, n_life long, mapped boolean")
    assert {(r["reason"], r["advice"], r["score"]) for r in catalog.unmapped(mined, ["b"], ["d"]).collect()} == {("a", "propose", 0.85), ("b", "skip", 0.1), ("d", "defer", 0.2)}


def test_coverage_and_gaps(spark):
    checks = spark.createDataFrame([("x", ["docs"]), ("y", ["docs", "images"]), ("z", [])], "check string, needs array<string>")
    ran = spark.createDataFrame([("x", 3)], "check string, n_findings int")
    inputs = spark.createDataFrame([("docs",)], "input string")
    assert {tuple(r) for r in evaluate.coverage(checks, ran, inputs).collect()} == {("x", "ran", 3), ("y", "skipped: no images", 0), ("z", "not run", 0)}
    links = spark.createDataFrame([("linked",), ("linked",)], "status string")
    assert {tuple(r) for r in evaluate.input_gaps(links).collect()} == {("linked", 2), ("soft", 0), ("unlinked", 0), ("no_data", 0)}
    planted = spark.createDataFrame([("a", "b", False), ("c", "d", False), ("e", "f", True)], "a string, b string, cited boolean")
    found = spark.createDataFrame([("b", "a")], "a string, b string")
    assert tuple(evaluate.planted_recall(planted, found).first()) == (2, 1, 1, 0, 0.5)
    profiles = spark.createDataFrame([("p", "x"), ("q", "y"), ("r", "z")], "profile string, backend string")
    backends = spark.createDataFrame([("x", True), ("y", False)], "backend string, available boolean")
    assert {r["status"] for r in evaluate.bakeoff(profiles, backends).collect()} == {"ready", "unavailable", "unknown"}
    items = spark.createDataFrame([("P", True), ("P", False)], "pattern_id string, matched boolean")
    said = spark.createDataFrame([("P", True), ("Q", False)], "pattern_id string, supported boolean")
    clean = spark.createDataFrame([("Q", 4)], "pattern_id string, n_unexplained long")
    assert {tuple(r) for r in evaluate.dashboard(items, said, clean).collect()} == {("P", 2, 1, 1, 0.5, 1.0, 0), ("Q", 0, 0, 1, None, 0.0, 4)}


def test_every_pattern_has_an_emitter(spark):
    assert set(emitters.EMITTERS) == set(catalog.PATTERNS)


@pytest.mark.parametrize("pattern", sorted(emitters.EMITTERS))
def test_emitters(spark, pattern):
    """A row with the emitter's columns becomes one finding or is left out by its condition."""
    e = emitters.EMITTERS[pattern]
    kinds = {"duplicate": "true", "same_condition": "false", "pattern_id": f"'{pattern}'", "status": "'phantom'", "kind": "CASE WHEN 'P' = 'P' THEN 'duplicate' END", "kinds": "'year'"}
    kinds["kind"] = {"P-VECTOR-SUBSET-UNDISCLOSED": "'subset'", "P-SOURCE-DATA-LEGEND-N": "'n_differs'", "P-SOURCE-DATA-PANEL-REF-DUP": "'duplicate_reference'"}.get(pattern, "'duplicate'")
    names = {*e.location, *e.sources, *e.metrics, *e.attrs, *([e.weak] if e.weak else []), *(w for w in kinds if e.where and w in e.where.split())}
    extra = {"mean_status": "'unexplained'", "sd_status": "'population'", "sem_status": "'ok'"} if "status" in (e.where or "") and "mean" in pattern.lower() + (e.where or "") or "sd_status" in (e.where or "") else {}
    columns = {n: "9" for n in names} | {n: v for n, v in kinds.items() if n in names or (e.where and n in e.where)} | extra
    columns |= {"class_group": "'other'", "group_key": "'mine'"} if "class_group" in (e.where or "") else {}
    df = spark.range(1).selectExpr(*(f"{v} AS {n}" for n, v in columns.items()))
    out = emitters.emit(pattern, df).collect()
    assert len(out) == 1 and out[0]["pattern_id"] == pattern and out[0]["severity"] in ("warning", "info")
