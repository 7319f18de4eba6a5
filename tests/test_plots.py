"""Identical plots and panels, residues, runs and answers."""

from plumbline.operators import archive, plots, structured, vectors


def test_plots(spark):
    v = [[1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0], [1.0, 9.0, 17.0, 25.0]]
    p = spark.createDataFrame([("p", "left", "g", v[0]), ("p", "left", "h", v[1]), ("q", "right", "g", v[0]), ("q", "right", "h", v[1]), ("r", "right", "g", v[2])], "plot string, side string, group_key string, vals array<double>")
    assert [tuple(r) for r in plots.identical_plots(p).collect()] == [("p", "q", 2, 1.0)]
    rows = [(1, x, g, w) for x, ws in (("a", v[:2]), ("e", v[1::-1]), ("b", v[:2])) for g, w in zip("gh", ws, strict=True)] + [(2, "a", "g", v[0]), (2, "a", "h", v[1])]
    panels = spark.createDataFrame(rows, "page int, panel string, group_key string, vals array<double>")
    assert {tuple(r) for r in plots.identical_panels(panels).collect()} == {(1, "a", 1, "e", 2, 1.0), (1, "b", 1, "e", 2, 1.0)}
    assert {tuple(r)[:4] for r in plots.identical_panels(panels, across=True).collect()} == {(1, x, 2, "a") for x in "abe"}


def test_sides(spark):
    best = spark.createDataFrame([("p", "ko", "t1", 2, 0.95), ("p", "ko", "t2", 2, 0.5), ("q", "ko", "t1", 2, 0.95), ("q", "ko", "t2", 2, 0.93)], "plot string, side string, source string, n_groups int, mean_score double")
    tables = spark.createDataFrame([("t1", "wt"), ("t2", "ko")], "source string, side string")
    assert [tuple(r) for r in plots.other_side(best, tables).collect()] == [("p", "ko", "wt", 0.95)]
    side = "folder string, path string, side string"
    assert [tuple(r)[1:3] for r in plots.diverging(spark.createDataFrame([("f", "r", "wt")], side), spark.createDataFrame([("f", "x", "ko"), ("f", "y", "wt")], side)).collect()] == [("r", "x")]


def test_residues_and_axes(spark):
    text = "Dunnett\n KO - WT   1.25  0.30  4.10  0.002 **\nHET - WT == 0  -0.5 0.1 <0.001 \nKO - WT   1.25  0.30  4.10  0.002 **\nnothing here\n"
    got = {tuple(r)[1:] for r in plots.contrasts(spark.createDataFrame([("x", text)], "path string, text string")).collect()}
    assert got == {("KO", "WT", 1.25, 0.002), ("HET", "WT", -0.5, 0.001)}
    marks = spark.createDataFrame([("y", 100.0, 0.0), ("y", 50.0, 5.0), ("y", 0.0, 10.0), ("x", 1.0, 1.0)], "axis string, at double, value double")
    assert [tuple(r) for r in plots.axes(marks).collect()] == [("y", -0.1, 10.0, 3)]


def test_count_matrices(spark):
    lines = [("d/barcodes.tsv", "A"), ("d/barcodes.tsv", "B"), ("d/features.tsv", "x"), ("d/matrix.mtx", "%%MatrixMarket"), ("d/matrix.mtx", "1 2 2"), ("d/matrix.mtx", "1 1 7"), ("e/barcodes.tsv", "A"), ("e/genes.tsv", "x"), ("e/matrix.mtx", "3 2 1"), ("f/matrix.mtx", "1 1 1")]
    h = plots.matrix_headers(spark.createDataFrame(lines, "path string, value string"))
    assert {tuple(r) for r in plots.count_matrices(h).collect()} == {("d", "ok"), ("e", "features,barcodes")}


def test_runs(spark, tmp_path):
    f = spark.createDataFrame([("a",), ("b",)], "finding_id string")
    files = lambda *rows: spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    archive.seal(str(tmp_path), "one", f, files(("x", b"1"), ("y", b"2")), started="2001-01-01 00:00:00")
    archive.seal(str(tmp_path), "two", f.limit(0), files(("x", b"9"), ("z", b"2")), ok=False, error="no", started="2002-01-01 00:00:00")
    assert [(r["run_id"], r["ok"], r["n_findings"], r["n_inputs"]) for r in archive.runs(spark, str(tmp_path)).collect()] == [("two", False, 0, 2), ("one", True, 2, 2)]
    assert archive.runs(spark, str(tmp_path), 1).count() == 1
    assert {tuple(r) for r in archive.changed_inputs(spark, str(tmp_path), "one", "two").collect()} == {("x", "changed"), ("y", "gone"), ("z", "added")}
    assert archive.artifact(spark.createDataFrame([("1", None)], "figure string, n long")).first()[0] == '{"figure":"1"}'


def test_answers(spark):
    body = '{"A": {"kind": "Plot", "n": "5"}, "b": {"kind": "photo", "n": "x"}, "12": {"kind": "plot"}}'
    got = {tuple(r) for r in structured.panel_map(spark.createDataFrame([(1, body), (2, "no json")], "id int, body string")).collect()}
    assert got == {(1, "a", "plot", 5), (1, "b", "unknown", None)}
    calls = spark.createDataFrame([("x", True, 3, 1.0), ("x", False, 0, 2.0), ("y", True, 0, 1.0)], "extractor string, ok boolean, n_rows int, seconds double")
    assert {(r["extractor"], r["status"]) for r in structured.extractor_status(calls).collect()} == {("x", "partial"), ("y", "empty")}
    words = structured.vocabulary(spark.createDataFrame([('{"sides": {"Left": [" L ", "left"]}}',)], "body string"))
    assert {tuple(r) for r in words.collect()} == {("sides", "left", "l"), ("sides", "left", "left")}
    stats = spark.createDataFrame([("s", 3), ("s", 4)], "source string, n long")
    assert vectors.total_n(stats).first()["n"] == 7
