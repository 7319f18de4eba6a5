"""Scans of small drawn images."""

import io
import zipfile

import numpy as np
import pytest

from plumbline.operators import images


@pytest.fixture(scope="module")
def pictures(spark):
    r = np.random.default_rng(4)
    smooth = lambda: np.kron(r.random((12, 12)) * 255, np.ones((8, 8)))
    a, b, c = smooth(), smooth(), smooth()
    d = np.concatenate([b[:, :24], c[:, 24:]], axis=1)
    rows = [images.image_row(n, x) for n, x in (("a", a), ("a_inverted", 255 - a), ("a_small", a[::2, ::2]), ("b", b), ("c", c), ("part_of_c", c[24:72, 24:72]), ("d", d))]
    return spark.createDataFrame(rows, images.IMAGES).cache()


def test_duplicates(pictures):
    found = {(r["a"], r["b"]) for r in images.duplicates(pictures).filter("duplicate").collect()}
    assert found == {("a", "a_inverted"), ("a", "a_small"), ("a_inverted", "a_small")}


def test_parts_and_lanes(pictures):
    assert ("c", "part_of_c") in {(r["a"], r["b"]) for r in images.partial_pairs(pictures).collect()}
    lanes = images.lane_reuse(pictures.filter("path IN ('b', 'c', 'd')"), 4).collect()
    assert {(r["a"], r["lane_a"], r["b"], r["lane_b"]) for r in lanes} == {("b", 0, "d", 0), ("c", 1, "d", 1), ("c", 2, "d", 2), ("c", 3, "d", 3)}
    assert images.lane_reuse(pictures, told=True).count() == 0


def test_corpus_and_panels(spark, pictures):
    kinds = {(r["a"], r["b"]): r["kind"] for r in images.against_corpus(pictures.filter("path = 'a'"), pictures.filter("path <> 'a'")).collect()}
    assert kinds[("a", "a_inverted")] == "duplicate" and images.against_corpus(pictures, pictures, cited=True).count() == 0
    panels = pictures.filter("path IN ('a', 'a_small', 'b')").selectExpr("*", "CASE path WHEN 'a' THEN '1' WHEN 'b' THEN '1' ELSE '2' END AS figure")
    assert [tuple(r)[:3] for r in images.panel_reuse(panels).collect()] == [("1", "2", 1)]


def test_pixels():
    r = np.random.default_rng(1)
    p = r.random((30, 2)) * 100
    moved = p @ np.array([[0.9, 0.1], [-0.1, 0.9]]) + 5
    moved[:6] = r.random((6, 2)) * 100
    assert images.homography_inliers(p, moved, 100) == 24
    grey = np.full((60, 60), 255.0)
    for at in ((10, 10), (10, 40), (40, 20)):
        grey[at[0] : at[0] + 5, at[1] : at[1] + 5] = 0
    grey[50:52, :] = 0
    assert [(round(x[0]), round(x[1]), x[2]) for x in images.dots(grey)] == [(12, 12, 25), (12, 42, 25), (42, 22, 25)]


def test_conflicts_and_embedded(spark):
    pairs = spark.createDataFrame([("x", "y")], "a string, b string")
    claims = spark.createDataFrame([("x", 20.0), ("y", 40.0)], "path string, magnification double")
    assert images.scale_conflicts(pairs, claims).first()["claims"] == "20.0,40.0"
    files = spark.createDataFrame([("s", "f", 40.0), ("s", "g", 63.0)], "source string, path string, found double")
    stated = spark.createDataFrame([("s", 40.0), ("s", 20.0)], "source string, stated double")
    assert [tuple(r) for r in images.magnification_conflicts(stated, files).collect()] == [("s", "g", 40.0, 63.0)]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for n, c in (("1.png", b"x"), ("2.png", b"x"), ("3.png", b"y")):
            z.writestr(f"word/media/{n}", c)
    df = spark.createDataFrame([("m.docx", bytearray(buffer.getvalue())), ("bad.docx", bytearray(b"no"))], "path string, content binary")
    assert {(r["path"], r["name"]) for r in images.embedded_images(df).collect()} == {("m.docx", "word/media/1.png"), ("m.docx", "word/media/3.png"), ("bad.docx", "")}
