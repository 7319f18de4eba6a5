"""Reused images: whole copies, parts of others, panels within a set, blot lanes, previews.

Images come as (path, v: descriptor, height, width, grey: bytes of the grey
image) from `loaded`. Candidates come from cosine search of descriptors in
blocks; every candidate is then confirmed on the pixels, as it is and inverted.
Caps of desktop tools on files and pairs are not kept: all are compared.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import similarity
from plumbline.operators.storage import stored

# Thresholds of the descriptors' cosine, of correlation, and of parts.
THRESHOLD, FLOOR, CORRELATED, CONTAINED = 0.98, 0.80, 0.92, 0.92
#: Side of the grey image that is kept.
SIDE = 128
IMAGES = "path string, v array<double>, height int, width int, grey binary"


def shrunk(grey: np.ndarray, side: int = SIDE) -> np.ndarray:
    """At most `side` in its longer direction, by block means."""
    h, w = grey.shape
    scale = max(1.0, max(h, w) / side)
    nh, nw = max(1, round(h / scale)), max(1, round(w / scale))
    rows, cols = np.linspace(0, h, nh + 1).astype(int), np.linspace(0, w, nw + 1).astype(int)
    sums = np.add.reduceat(np.add.reduceat(grey.astype(np.float64), rows[:-1], axis=0), cols[:-1], axis=1)
    return sums / np.outer(np.diff(rows), np.diff(cols))


def loaded(images: DataFrame) -> DataFrame:
    """Spark's image source (image struct) as images, bytes in BGR order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, h, w, c, data in zip(pdf["path"], pdf["h"], pdf["w"], pdf["c"], pdf["data"], strict=True):
                x = np.frombuffer(data, np.uint8).reshape(h, w, c).astype(np.float64)
                grey = x[:, :, 0] if c == 1 else 0.114 * x[:, :, 0] + 0.587 * x[:, :, 1] + 0.299 * x[:, :, 2]
                rows.append(image_row(path, grey))
            yield pd.DataFrame(rows, columns=["path", "v", "height", "width", "grey"])

    flat = images.select(F.col("image.origin").alias("path"), F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("c"), F.col("image.data").alias("data"))
    return flat.mapInPandas(run, IMAGES)


def described(grey: np.ndarray) -> np.ndarray:
    """The descriptor with its hash as -1 and 1, so that an inverted image has the opposite one."""
    v = similarity.descriptor(grey)
    small, bits = v[:4096], v[4096:] > 0
    out = np.concatenate([small / max(np.linalg.norm(small), 1e-12), np.where(bits, 1.0, -1.0) / 16])
    return out / np.linalg.norm(out)


def image_row(path: str, grey: np.ndarray) -> tuple:
    small = np.clip(np.round(shrunk(grey)), 0, 255).astype(np.uint8)
    return path, described(grey).tolist(), small.shape[0], small.shape[1], small.tobytes()


def _resized(a: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    return a[np.linspace(0, a.shape[0] - 1, shape[0]).round().astype(int)][:, np.linspace(0, a.shape[1] - 1, shape[1]).round().astype(int)]


def pixel_score(a: np.ndarray, b: np.ndarray) -> float:
    """Best correlation of two images over five scales of their common size, b also inverted; flat images have 0."""
    best = 0.0
    for scale in (1.0, 0.5, 0.25, 0.75, 0.35):
        shape = max(8, int(min(a.shape[0], b.shape[0]) * scale)), max(8, int(min(a.shape[1], b.shape[1]) * scale))
        best = max(best, abs(similarity.correlation(_resized(a, shape), _resized(b, shape))))
    return best


def contained(a: np.ndarray, b: np.ndarray, low: float = 0.10, high: float = 0.85) -> float:
    """Best correlation of the smaller image with a part of the larger one: scales 0.55 to 1, four rotations, area shares low..high."""
    small, large = (a, b) if a.size <= b.size else (b, a)
    best = 0.0
    for scale in (1.0, 0.85, 0.7, 0.55):
        part = _resized(small, (max(8, int(small.shape[0] * scale)), max(8, int(small.shape[1] * scale))))
        if low <= part.size / large.size <= high:
            best = max(best, *(similarity.containment(np.rot90(part, k), large) for k in range(4)))
    return best


def homography_inliers(p0: np.ndarray, p1: np.ndarray, size: float, share: float = 0.01, rounds: int = 400, seed: int = 0) -> int:
    """Most point pairs that one projective map takes within share * size of each other, by random samples of four."""
    n = len(p0)
    if n < 4:
        return 0
    rng, best, one = np.random.default_rng(seed), 0, np.ones((n, 1))
    for _ in range(rounds):
        pick = rng.choice(n, 4, replace=False)
        rows = []
        for (x, y), (u, v) in zip(p0[pick], p1[pick], strict=True):
            rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
        h = np.linalg.svd(np.array(rows, float))[2][-1].reshape(3, 3)
        q = np.concatenate([p0, one], 1) @ h.T
        with np.errstate(divide="ignore", invalid="ignore"):
            gap = np.linalg.norm(q[:, :2] / q[:, 2:] - p1, axis=1)
        best = max(best, int((gap <= share * size).sum()))
    return best


def dots(grey: np.ndarray, least: int = 12, most: int = 900, dark: float = 128.0) -> list[tuple[float, float, int, bool]]:
    """(row, col, area, overlapped) of dark round marks: connected, of that area, sides at most 2.5 to 1, filling 0.45 of their box; larger than 1.6 medians counts as overlapped."""
    mask, seen, out = grey < dark, np.zeros(grey.shape, bool), []
    for start in zip(*np.nonzero(mask), strict=True):
        if seen[start]:
            continue
        seen[start], todo, cells = True, [start], []
        while todo:
            r, c = todo.pop()
            cells.append((r, c))
            for x in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if 0 <= x[0] < mask.shape[0] and 0 <= x[1] < mask.shape[1] and mask[x] and not seen[x]:
                    seen[x] = True
                    todo.append(x)
        a = np.array(cells)
        h, w = np.ptp(a[:, 0]) + 1, np.ptp(a[:, 1]) + 1
        if least <= len(a) <= most and max(h, w) <= 2.5 * min(h, w) and len(a) >= 0.45 * h * w:
            out.append((*a.mean(0).tolist(), len(a)))
    usual = float(np.median([x[2] for x in out])) if out else 0.0
    return [(r, c, n, n > 1.6 * usual) for r, c, n in out]


def _confirmed(pairs: DataFrame, images: DataFrame, score, name: str) -> DataFrame:
    """pairs (a, b, ..) with the score of their pixels."""
    side = lambda x: images.select(F.col("path").alias(x), F.col("grey").alias(f"g_{x}"), F.col("height").alias(f"h_{x}"), F.col("width").alias(f"w_{x}"))

    @F.pandas_udf("double")
    def scored(g1: pd.Series, h1: pd.Series, w1: pd.Series, g2: pd.Series, h2: pd.Series, w2: pd.Series) -> pd.Series:
        shape = lambda g, h, w: np.frombuffer(g, np.uint8).reshape(h, w).astype(np.float64)
        return pd.Series([score(shape(*x[:3]), shape(*x[3:])) for x in zip(g1, h1, w1, g2, h2, w2, strict=True)], dtype="float64")

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.withColumn(name, scored("g_a", "h_a", "w_a", "g_b", "h_b", "w_b")).select(*pairs.columns, name)


def candidates(queries: DataFrame, table: DataFrame, threshold: float = THRESHOLD, k: int = 50) -> DataFrame:
    """(a, b, score): images of table whose descriptor's cosine with a query, or with its inverse, reaches max(FLOOR, threshold - 0.08).

    Each query has its k best; where all k reach the floor, copies abound, and
    components over these pairs still join them.
    """
    numbered = lambda df: df.select(F.xxhash64("path").alias("id"), "path", "v")
    q, t = stored(numbered(queries), "queries"), stored(numbered(table), "images")
    hits = similarity.top_k(q, t, k, max(FLOOR, threshold - 0.08), mirrored=True)
    out = hits.join(q.select(F.col("id").alias("query"), F.col("path").alias("a")), "query").join(t.select("id", F.col("path").alias("b")), "id")
    return out.select("a", "b", "score")


def duplicates(images: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, score, pixels, duplicate): pairs of one set, a < b, that their descriptors bring together; duplicate where the pixels agree."""
    images = stored(images, "images")
    pairs = candidates(images, images, threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").groupBy("a", "b").agg(F.max("score").alias("score"))
    return _confirmed(pairs, images, pixel_score, "pixels").withColumn("duplicate", (F.col("pixels") >= CORRELATED) & (F.col("score") >= max(FLOOR, threshold - 0.08)))


def against_corpus(queries: DataFrame, corpus: DataFrame, cited: bool = False) -> DataFrame:
    """(a, b, score, pixels, part, kind): query images that stand in a corpus, whole (duplicate) or as a part (partial); a legend that cites its source turns them off."""
    both = queries.unionByName(corpus).dropDuplicates(["path"])
    pairs = _confirmed(candidates(queries, corpus), both, pixel_score, "pixels")
    out = _confirmed(pairs, both, contained, "part")
    kind = F.when(F.col("pixels") >= CORRELATED, "duplicate").when(F.col("part") >= CONTAINED, "partial")
    return out.withColumn("kind", kind).filter(F.col("kind").isNotNull() & F.lit(not cited))


def partial_pairs(images: DataFrame, threshold: float = CONTAINED) -> DataFrame:
    """(a, b, part): pairs of which one image holds a part of the other.

    Parts share no descriptor with wholes; images meet by the descriptors of
    their windows of half and three quarters of each side, a quarter apart. A
    part that lies far off all of these can be missed.
    """

    def tiles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, h, w, g in zip(pdf["path"], pdf["height"], pdf["width"], pdf["grey"], strict=True):
                x = np.frombuffer(g, np.uint8).reshape(h, w).astype(np.float64)
                cuts = [(0, h, 0, w), *((a * h // 4, (a + s) * h // 4, b * w // 4, (b + s) * w // 4) for s in (2, 3) for a in range(5 - s) for b in range(5 - s))]
                for n, (r0, r1, c0, c1) in enumerate(cuts):
                    if r1 - r0 >= 8 and c1 - c0 >= 8:
                        rows.append((f"{n}#{path}", described(x[r0:r1, c0:c1]).tolist(), path, 1, b""))
            out = pd.DataFrame(rows, columns=["path", "v", "of", "height", "grey"])
            yield out[["path", "v"]]

    each = stored(images.mapInPandas(tiles, "path string, v array<double>"), "tiles")
    met = candidates(each, each, 0.68 + 0.08, 20)
    of = lambda c: F.substring_index(c, "#", -1)
    pairs = met.select(F.least(of("a"), of("b")).alias("a"), F.greatest(of("a"), of("b")).alias("b")).filter("a <> b").distinct()
    return _confirmed(pairs, images, contained, "part").filter(F.col("part") >= threshold)


def panel_reuse(panels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(figure_a, figure_b, n_panels, pixels): figures that share panels (path, figure, v, ..) within a set.

    A figure saved twice - three panels at least, 0.6 of the smaller one's - is left out.
    """
    found = duplicates(panels.select("path", "v", "height", "width", "grey"), threshold).filter("duplicate")
    figure = lambda x: panels.select(F.col("path").alias(x), F.col("figure").alias(f"figure_{x}"))
    j = found.join(figure("a"), "a").join(figure("b"), "b").filter("figure_a <> figure_b")
    g = j.select(F.least("figure_a", "figure_b").alias("figure_a"), F.greatest("figure_a", "figure_b").alias("figure_b"), "a", "pixels").groupBy("figure_a", "figure_b").agg(F.count_distinct("a").alias("n_panels"), F.max("pixels").alias("pixels"))
    sizes = panels.groupBy("figure").agg(F.count("*").alias("n"))
    for x in ("figure_a", "figure_b"):
        g = g.join(sizes.select(F.col("figure").alias(x), F.col("n").alias(f"n_{x}")), x)
    return g.filter(~((F.col("n_panels") >= 3) & (F.col("n_panels") >= 0.6 * F.least("n_figure_a", "n_figure_b")))).select("figure_a", "figure_b", "n_panels", "pixels")


def lane_reuse(images: DataFrame, lanes: int = 4, threshold: float = 0.94, told: bool = False) -> DataFrame:
    """(a, lane_a, b, lane_b, pixels): blots of which a lane stands in another one, although the blots as a whole differ (below 0.97); a legend that tells of it turns this off."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, h, w, g in zip(pdf["path"], pdf["height"], pdf["width"], pdf["grey"], strict=True):
                x = np.frombuffer(g, np.uint8).reshape(h, w).astype(np.float64)
                rows += [image_row(f"{i}#{path}", x[:, i * w // lanes : (i + 1) * w // lanes]) for i in range(lanes) if w >= 4 * lanes]
            yield pd.DataFrame(rows, columns=["path", "v", "height", "width", "grey"])

    each = stored(images.mapInPandas(cut, IMAGES), "lanes")
    found = duplicates(each).filter(F.col("pixels") >= threshold)
    of = lambda c: F.substring_index(c, "#", -1)
    lane = lambda c: F.substring_index(c, "#", 1).cast("int")
    pairs = found.select(of("a").alias("a"), lane("a").alias("lane_a"), of("b").alias("b"), lane("b").alias("lane_b"), F.col("pixels").alias("lane_pixels")).filter("a <> b")
    whole = _confirmed(pairs.select("a", "b").distinct(), images, pixel_score, "whole").filter("whole < 0.97").select("a", "b")
    return pairs.join(whole, ["a", "b"], "left_semi").filter(F.lit(not told)).withColumnRenamed("lane_pixels", "pixels")


def match_order(localised: Column, score: Column) -> Column:
    """Matches found at a place before those of the whole image, then by score."""
    return F.struct(localised.cast("int").alias("localised"), score.alias("score"))


def scan_order(path: Column, size: Column) -> Column:
    """Files in folders of figures first, then small ones, then by path."""
    return F.struct((~F.lower(path).rlike(r"fig(ure)?[ ._-]*s?[0-9]")).cast("int").alias("far"), size.alias("size"), path.alias("path"))


def first_files(files: DataFrame, most: int, by: str | None = None) -> DataFrame:
    """The first `most` files (path, size) of each `by`, or of all, in scan order: a report's excerpt, not a filter of the scans."""
    w = Window.partitionBy(*([by] if by else [F.lit(0)])).orderBy(scan_order(F.col("path"), F.col("size")))
    return files.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most).drop("_k")


def scale_conflicts(pairs: DataFrame, claims: DataFrame) -> DataFrame:
    """(a, b, claims): near-identical images (a, b) whose legends (path, magnification) state two magnifications at least."""
    c = claims.select("path", "magnification").distinct()
    each = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("path")).join(c, "path").groupBy("a", "b").agg(F.array_sort(F.collect_set("magnification")).alias("m")).filter(F.size("m") >= 2)
    return each.select("a", "b", F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("claims"))


def magnification_conflicts(claims: DataFrame, files: DataFrame, tolerance: float = 0.12) -> DataFrame:
    """(source, path, stated, found): magnifications (source, stated) that no claim of the source brings within the tolerance of a file's (source, path, found)."""
    j = files.join(claims, "source").withColumn("gap", F.abs(F.col("stated") - F.col("found")) / F.greatest(F.col("found"), F.lit(1e-9)))
    best = j.groupBy("source", "path", "found").agg(F.min_by("stated", F.struct("gap", "stated")).alias("stated"), F.min("gap").alias("gap"))
    return best.filter(F.col("gap") > tolerance).select("source", "path", "stated", "found")


def docx_images(data: bytes) -> list[tuple[str, bytes]]:
    """(name, bytes) of the images of a manuscript, in the order of its relations."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if n.startswith("word/media/")]
        order: list[str] = []
        if "word/_rels/document.xml.rels" in z.namelist():
            order = [f"word/{r.get('Target')}" for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels")) if "image" in (r.get("Type") or "")]
        return [(n, z.read(n)) for n in [*dict.fromkeys(x for x in order if x in names), *(n for n in names if n not in order)]]


def embedded_images(files: DataFrame) -> DataFrame:
    """(path, name, sha, content) of the images in manuscripts (path, content), equal bytes once a manuscript; a file that is no manuscript gives an empty name and the reason as content."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(path, n, c) for n, c in docx_images(data)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows.append((path, "", str(e).encode()))
            yield pd.DataFrame(rows, columns=["path", "name", "content"])

    out = files.select("path", "content").mapInPandas(run, "path string, name string, content binary").withColumn("sha", F.sha2("content", 256))
    first = Window.partitionBy("path", "sha").orderBy("name")
    return out.withColumn("_k", F.row_number().over(first)).filter("_k = 1").select("path", "name", "sha", "content")
