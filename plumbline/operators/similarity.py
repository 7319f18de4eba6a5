"""Cosine search and image descriptors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries and rows of a block; a task holds one block of each.
QUERY_BLOCK, ROW_BLOCK = 2048, 32768
#: Scores that are held at once.
SCORES = 2**20


def _best(k: int, floor: float, mirrored: bool):
    def best(queries: pa.Table, rows: pa.Table) -> pa.Table:
        ids, own = queries.column("id").to_numpy(), rows.column("id").to_numpy()
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if len(ids) and len(own):
            q, x = (t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1) for t in (queries, rows))
            q, x = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30) for m in (q, x))
            out = []
            step = max(1, SCORES // len(own))
            for lo in range(0, len(ids), step):
                s = q[lo : lo + step] @ x.T
                s = np.round(np.abs(s) if mirrored else s, 9)
                s[ids[lo : lo + step, None] == own[None, :]] = -2
                if s.shape[1] > k:
                    # Everything from the k-th best score on, then in order: ties go by id.
                    at_least = np.partition(s, -k, axis=1)[:, -k]
                    r, c = np.nonzero((s >= at_least[:, None]) & (s >= max(floor, -1.5)))
                else:
                    r, c = np.nonzero(s >= max(floor, -1.5))
                order = np.lexsort((own[c], -s[r, c], r))
                r, c = r[order], c[order]
                first = np.searchsorted(r, r)
                few = np.arange(len(r)) - first < k
                out.append((ids[lo + r[few]], own[c[few]], s[r[few], c[few]]))
            found = [np.concatenate(col) for col in zip(*out, strict=True)]
        return pa.table({"query": pa.array(found[0], pa.int64()), "id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    return best


def top_k(queries: DataFrame, table: DataFrame, k: int = 5, floor: float = -1.0, mirrored: bool = False) -> DataFrame:
    """(query, rank, id, score): the k rows of table (id, v) with the highest cosine for each query (id, v), ties by id, itself left out.

    Both sides are dealt into blocks of about equal size and every block of
    queries meets every block of rows in a task of its own, which hands on k rows
    a query; nothing is gathered on the driver. mirrored takes the absolute value.
    """
    n_queries, n_rows = (max(1, -(-df.count() // most)) for df, most in ((queries, QUERY_BLOCK), (table, ROW_BLOCK)))
    deal = lambda df, n, seed, name: df.select("id", "v", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int").alias(name))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = deal(queries, n_queries, 1, "qb").withColumn("rb", every(n_rows))
    r = deal(table, n_rows, 2, "rb").withColumn("qb", every(n_queries))
    parts = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInArrow(_best(k, floor, mirrored), "query long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return parts.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).select("query", "rank", "id", "score")


def shortlisted(a_hits: DataFrame, b_hits: DataFrame) -> DataFrame:
    """Pairs that are among the best of either side: (a, b, score)."""
    both = a_hits.select(F.col("query").alias("a"), F.col("id").alias("b"), "score").union(b_hits.select(F.col("id").alias("a"), F.col("query").alias("b"), "score"))
    return both.groupBy("a", "b").agg(F.max("score").alias("score"))


def average_hash(gray: np.ndarray, size: int = 16) -> np.ndarray:
    """Block means of a grey image against their mean, as 0/1."""
    h, w = gray.shape
    rows, cols = np.linspace(0, h, size + 1).astype(int), np.linspace(0, w, size + 1).astype(int)
    means = np.array([[gray[rows[i] : max(rows[i + 1], rows[i] + 1), cols[j] : max(cols[j + 1], cols[j] + 1)].mean() for j in range(size)] for i in range(size)])
    return (means > means.mean()).astype(np.float64).ravel()


def descriptor(gray: np.ndarray) -> np.ndarray:
    """Centred 64 x 64 reduction and average hash, of length 1 together."""
    h, w = gray.shape
    small = gray[np.linspace(0, h - 1, 64).astype(int)][:, np.linspace(0, w - 1, 64).astype(int)].astype(np.float64)
    small = (small - small.mean()).ravel()
    out = np.concatenate([small / max(np.linalg.norm(small), 1e-12), average_hash(gray) / 16])
    return out / max(np.linalg.norm(out), 1e-12)


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised cross-correlation of two grey images of equal shape; 0 if one is flat."""
    a, b = a - a.mean(), b - b.mean()
    scale = np.sqrt((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / scale) if scale > 1e-9 else 0.0


def containment(small: np.ndarray, large: np.ndarray) -> float:
    """Highest correlation of the small image with any window of the large one, by FFT."""
    h, w = small.shape
    if h > large.shape[0] or w > large.shape[1]:
        return 0.0
    t = small - small.mean()
    norm = np.sqrt((t * t).sum())
    if norm < 1e-9:
        return 0.0
    shape = [large.shape[0] + h - 1, large.shape[1] + w - 1]
    corr = np.fft.irfft2(np.fft.rfft2(large, shape) * np.fft.rfft2(t[::-1, ::-1], shape), shape)[h - 1 : large.shape[0], w - 1 : large.shape[1]]
    sums = [np.pad(np.cumsum(np.cumsum(x, 0), 1), ((1, 0), (1, 0))) for x in (large.astype(np.float64), large.astype(np.float64) ** 2)]
    box = [s[h:, w:] - s[:-h, w:] - s[h:, :-w] + s[:-h, :-w] for s in sums]
    var = np.maximum(box[1] - box[0] ** 2 / (h * w), 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(var > 1e-9, corr / (np.sqrt(var) * norm), 0)
    return float(min(1.0, score.max()))


def grey_images(images: DataFrame) -> DataFrame:
    """(path, v): descriptors of Spark's image source (image struct), bytes in BGR order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, h, w, c, data in zip(pdf["path"], pdf["h"], pdf["w"], pdf["c"], pdf["data"], strict=True):
                x = np.frombuffer(data, np.uint8).reshape(h, w, c).astype(np.float64)
                grey = x[:, :, 0] if c == 1 else 0.114 * x[:, :, 0] + 0.587 * x[:, :, 1] + 0.299 * x[:, :, 2]
                rows.append((path, descriptor(grey).tolist()))
            yield pd.DataFrame(rows, columns=["path", "v"])

    flat = images.select(F.col("image.origin").alias("path"), F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("c"), F.col("image.data").alias("data"))
    return flat.mapInPandas(run, "path string, v array<double>")


def identical_files(files: DataFrame) -> DataFrame:
    """(path, keeper, n_copies) of files (path, content) with equal bytes: lengths first, digests only where lengths meet."""
    sized = files.withColumn("length", F.length("content"))
    same = sized.groupBy("length").agg(F.count("*").alias("n")).filter("n > 1").select("length")
    hashed = sized.join(same, "length", "left_semi").select("path", "length", F.sha2("content", 256).alias("sha"))
    groups = hashed.groupBy("sha").agg(F.min("path").alias("keeper"), F.count("*").alias("n_copies")).filter("n_copies > 1")
    return hashed.join(groups, "sha").select("path", "keeper", "n_copies")
