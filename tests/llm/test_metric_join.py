import numpy as np

from plumbline.llm import metric_join

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, cell int"


def brute(rows, cosine):
    def sane(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            a, b = rows[i], rows[j]
            if i != j and a[2] is not None and a[2] == b[2] and sane(a[1]) and sane(b[1]) and len(a[1]) == len(b[1]):
                x, y = np.float32(a[1]).astype(float), np.float32(b[1]).astype(float)
                link[i, j] = x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine
    comp = [r[0] for r in rows]
    for _ in range(n):
        comp = [min([comp[i], *(comp[j] for j in np.flatnonzero(link[i]))]) for i in range(n)]
    return {(r[0], int(link[i].sum()), comp[i], comp[i] == r[0]) for i, r in enumerate(rows)}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "CELL", 16)
    monkeypatch.setattr(metric_join, "BLOCK", 24)
    r = np.random.default_rng(4)
    rows = []
    for label in (1, 2):
        centres = r.normal(size=(12, 8))
        for i in range(90):
            rows.append((len(rows) * 3 % 541, (centres[i % 12] + r.normal(size=8) * 0.25).tolist(), label))
    rows += [(1001, rows[0][1], 1), (1002, rows[0][1], 1), (1003, None, 1), (1004, [0.0] * 8, 1), (1005, [float("nan")] * 8, 1), (1006, [None, *[1.0] * 7], 1), (1007, rows[0][1], None), (1008, [1.0, 2.0], 1), (1009, [float("inf")] * 8, 2), (1010, [], 2)]
    assert len({x[0] for x in rows}) == len(rows)
    out = metric_join.link(spark.createDataFrame([(*x, "a", "b", 1) for x in rows], SCHEMA)).collect()
    assert {tuple(x) for x in out} == brute(rows, 0.93)
    assert len(out) == len(rows)


def test_empty_and_null_ids(spark):
    assert metric_join.link(spark.createDataFrame([], SCHEMA)).collect() == []
    out = metric_join.link(spark.createDataFrame([(None, [1.0], 1, "", "", 0), (1, [1.0], 1, "", "", 0), (1, [1.0], 1, "", "", 0)], SCHEMA)).collect()
    assert sorted([tuple(x) for x in out], key=str) == [(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True)]
