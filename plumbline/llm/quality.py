"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is a weighted sum of features of its text. The weights are
those under which labelled pairs (one of each label) come out right: logistic
loss on feature differences with an L2 penalty. The threshold is the quantile of
the strengths at the share of label 0; a score is the probability of beating a
document that stands exactly there.

Fitting takes every labelled row that is not held out; scoring reads every whole
text. A labelled row meets all rows of the other label where the rarer one has
fewer than 2 * `MEET` rows, else those of its group, `MEET` or more on average.
The loss over these pairs is minimised by Newton steps, each one pass over the
rows' features in cells; cells' sums are rounded to multiples of a power of two
and added as integers, so the weights do not depend on how rows are dealt out.
The threshold is exact.

Null and empty texts get the score of a text without characters. Labels that
contradict each other or are null are left out; with no pair left every score is
0.5. Repeated rows give repeated results, an empty table an empty one; a labelled
id that repeats is learnt from once. A score of exactly 0.5 counts as good. Very
long texts are read whole, one at a time; features take memory in proportion to
them. Only the id and text columns are read, whatever the names of others.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._io import chunks, release, stored

#: Rows of the other label that a labelled row meets on average, at least, unless there are fewer.
MEET = 256
#: Preference pairs of a fit to arrays.
PAIRS = 40_000
#: Bins of a pass that narrows the threshold.
BINS = 1024
SIGNS = b"|#$%&*!?.,;:-_@()[]{}<>/\\\"'"
WIDTH = len(SIGNS) + 18


def features(text: bytes) -> np.ndarray:
    """Of the whole text: character classes, signs, words, lines and their repetition."""
    n = len(text)
    if not n:
        return np.zeros(WIDTH, np.float32)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()] or [b""]
    n_words = max(1, len(words))
    distinct = len(set(words))
    ends = sum([not (w[-1:].isalnum() or w[-1] >= 128) for w in words])
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    used = counts[counts > 0] / n
    rest = [
        1.0, np.log1p(n), np.log1p(len(words)), upper / n, lower / n, digits / n, counts[32] / n, counts[10] / n, counts[128:].sum() / n, counts[:32].sum() / n,
        n / n_words, distinct / n_words, np.log1p(distinct) / np.log1p(len(words)) if words else 0, ends / n_words, sum([w.isupper() for w in words]) / n_words,
        len(set(lines)) / len(lines), np.log1p(n / len(lines)), -(used * np.log(used)).sum(),
    ]
    return np.array([*(counts[list(SIGNS)] / n_words), *rest], np.float32)


@dataclass(frozen=True)
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.strengths(x) - self.threshold, -60, 60)))


def fit(x: np.ndarray, good: np.ndarray, share_bad: float, pairs: int = PAIRS, l2: float = 1e-3, steps: int = 400, seed: int = 7) -> Ranking:
    """For rows in memory: weights from preference pairs drawn from them (a good row over another), then the threshold at the quantile share_bad."""
    width = x.shape[1] if x.ndim == 2 else WIDTH
    if not good.any() or good.all():
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    x = x.astype(np.float64)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(np.flatnonzero(good), pairs)] - z[rng.choice(np.flatnonzero(~good), pairs)]
    w, speed, rate = np.zeros(width), np.zeros(width), 4.0 / max(1.0, (d**2).sum(1).mean())
    for _ in range(steps):  # gradient descent with momentum
        grad = l2 * w - d.T @ (1 / (1 + np.exp(np.clip(d @ w, -60, 60)))) / pairs
        speed = 0.9 * speed - rate * grad
        w = w + speed
    s = z @ w
    order = np.argsort(s, kind="stable")
    mass = np.where(good, (1 - share_bad) / good.sum(), share_bad / (~good).sum())[order].cumsum()
    at = int(np.searchsorted(mass, share_bad - 1e-9))
    return Ranking(mean, scale, w, float(s[order[at]] + s[order[min(at + 1, len(s) - 1)]]) / 2)


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, y, x: the features) of every labelled id that is not held out and has a text."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)")
    known = known.filter(~held_out(F.col("id"))).groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("hi")).filter("y = hi").drop("hi")
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).filter(F.col("id").isNotNull() & ~held_out(F.col("id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            x = [features(t or b"").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(x, pa.binary())], ["id", "x"])

    schema = f"id {own.schema['id'].dataType.simpleString()}, x binary"
    repeated = stored(own.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "repeated")
    rows = own.mapInArrow(run, schema)
    if not repeated.isEmpty():
        # An id that repeats counts once, with the text that sorts first.
        first = own.join(repeated, "id").groupBy("id").agg(F.min(F.coalesce("text", F.lit(b""))).alias("text"))
        rows = rows.join(repeated, "id", "left_anti").union(first.mapInArrow(run, schema))
    rows = stored(rows.join(known, "id").select("id", "y", "x"), "labelled")
    release(repeated)
    return rows


def _cells(rows: DataFrame, rarer: int, n_rarer: int, n_other: int) -> tuple[DataFrame, int]:
    """(cell, y, x) with the rows of a cell in the order of their ids, and the number of groups.

    The rarer label's rows fall into groups and the other's into cells; a cell
    belongs to the group of its number modulo the groups, and holds a copy of it.
    So a pair meets in one cell or in none, and the cells below the number of
    groups hold each row of the rarer label once.
    """
    groups = max(1, n_rarer // MEET)
    cells = groups * max(1, n_other // (MEET * groups))
    group = F.pmod(F.xxhash64("id"), F.lit(groups))
    of = F.when(F.col("y") == rarer, F.sequence(group, F.lit(cells - 1).cast("long"), F.lit(groups).cast("long"))).otherwise(F.array(F.pmod(F.xxhash64("id"), F.lit(cells))))
    dealt = rows.select(F.explode(of).alias("cell"), F.struct("id", "y", "x").alias("row"))
    whole = dealt.groupBy("cell").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return stored(whole.select("cell", F.col("rows.y").alias("y"), F.col("rows.x").alias("x")), "cells"), groups


def _each(cells: DataFrame, result: Callable[[Iterator[tuple[int, np.ndarray, np.ndarray]]], Iterator[tuple[int, bytes]]]) -> list[tuple[int, np.ndarray]]:
    """What `result` gives for the (cell, good, features) of each task, as (number, array), by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every():
            for batch in batches:
                for cell, y, x in zip(*(batch.column(c) for c in ("cell", "y", "x")), strict=True):
                    yield cell.as_py(), np.array(y.as_py()) == 1, np.frombuffer(b"".join(x.as_py()), np.float32).reshape(-1, WIDTH).astype(np.float64)

        for cell, value in result(every()):
            yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int64()), pa.array([value], pa.binary())], ["cell", "value"])

    return sorted((r["cell"], bytes(r["value"])) for r in cells.mapInArrow(run, "cell long, value binary").collect())


def _moments(cells: DataFrame, once: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of the features over all rows, merged cell by cell."""

    def result(parts):
        for cell, good, x in parts:
            if len(x := x[once(cell, good)]):
                yield cell, np.concatenate([[len(x)], x.mean(0), ((x - x.mean(0)) ** 2).sum(0)]).tobytes()

    n, mean, m2 = 0.0, np.zeros(WIDTH), np.zeros(WIDTH)
    for _, raw in _each(cells, result):
        v = np.frombuffer(raw)
        size, off = v[0], v[1 : WIDTH + 1] - mean
        n += size
        mean, m2 = mean + off * size / n, m2 + v[WIDTH + 1 :] + off**2 * (n - size) * size / n
    return mean, np.sqrt(m2 / n) + 1e-6


def _pass(cells: DataFrame, ranking: Ranking, shift: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean logistic loss over the cells' pairs under the ranking's weights, its gradient and its second derivatives."""

    def result(parts):
        total = np.zeros(2 + WIDTH + WIDTH * WIDTH, np.int64)
        for _, good, x in parts:
            z = ranking.standard(x)
            g, b = z[good], z[~good]
            for at in range(0, len(g), 4 * MEET):  # of a large cell a part at a time
                total += _sums(g[at : at + 4 * MEET], b, ranking.weights, shift)
        yield 0, total.tobytes()

    total = sum([np.frombuffer(raw, np.int64).astype(object) for _, raw in _each(cells, result)])
    total = np.array([t / (1 << shift) for t in total])
    n = total[0]
    return total[1] / n, total[2 : 2 + WIDTH] / n, total[2 + WIDTH :].reshape(WIDTH, WIDTH) / n


def _sums(g: np.ndarray, b: np.ndarray, w: np.ndarray, shift: int) -> np.ndarray:
    """Over all pairs of a row of g and one of b: their number, loss, gradient and second derivatives, in units of 2 ** -shift."""
    d = (g @ w)[:, None] - (b @ w)[None, :]
    lost = 1 / (1 + np.exp(np.clip(d, -60, 60)))
    k = lost * (1 - lost)
    grad = b.T @ lost.sum(0) - g.T @ lost.sum(1)
    cross = g.T @ k @ b
    second = (g.T * k.sum(1)) @ g + (b.T * k.sum(0)) @ b - cross - cross.T
    return np.rint(np.concatenate([[d.size, np.logaddexp(0, -d).sum()], grad, second.ravel()]) * 2.0**shift).astype(np.int64)


def _weights(cells: DataFrame, mean: np.ndarray, scale: np.ndarray, pairs: int, l2: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Newton's method with halved steps on the loss over all the cells' pairs with an L2 penalty."""
    shift = max(0, min(40, 60 - math.ceil(math.log2(4 * WIDTH * 64 * pairs))))  # sums stay below 2 ** 60

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        loss, grad, second = _pass(cells, Ranking(mean, scale, w, 0.0), shift)
        return loss + l2 / 2 * float(w @ w), grad + l2 * w, second + l2 * np.eye(WIDTH)

    w = np.zeros(WIDTH)
    loss, grad, second = at(w)
    step, share = np.linalg.solve(second, grad), 1.0
    for _ in range(steps):
        if float(grad @ step) < 1e-12:
            break
        new = at(w - share * step)
        if new[0] > loss:
            share /= 2
            continue
        w, (loss, grad, second) = w - share * step, new
        step, share = np.linalg.solve(second, grad), 1.0
    return w


def _ranked(cells: DataFrame, ranking: Ranking, once: Callable, rank: int) -> float:
    """The strength at a rank, from 0, among all rows: bins are narrowed until the rank is at an end of one."""
    # The penalty holds weights to a norm of 38, so no strength is near the first ends.
    low, high, below = -1e4, 1e4, 0
    while True:

        def result(parts, low=low, high=high):
            edges = np.linspace(low, high, BINS + 1)[1:-1]
            count, least, most = np.zeros(BINS), np.full(BINS, np.inf), np.full(BINS, -np.inf)
            for cell, good, x in parts:
                s = ranking.strengths(x)[once(cell, good)]
                s = s[(s >= low) & (s <= high)]
                at = np.searchsorted(edges, s, "right")
                count += np.bincount(at, minlength=BINS)
                np.minimum.at(least, at, s)
                np.maximum.at(most, at, s)
            yield 0, np.stack([count, least, most]).tobytes()

        parts = [np.frombuffer(raw).reshape(3, BINS) for _, raw in _each(cells, result)]
        count, least, most = sum(p[0] for p in parts), np.min([p[1] for p in parts], 0), np.max([p[2] for p in parts], 0)
        before = below + np.cumsum(count) - count
        k = int(np.flatnonzero(before + count > rank)[0])
        if rank == before[k] or least[k] == most[k]:
            return float(least[k])
        if rank == before[k] + count[k] - 1:
            return float(most[k])
        low, high, below = least[k], most[k], int(before[k])


def learnt(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranking:
    """A ranking from all labelled rows that are not held out (crc32 of the id as text, modulo 3, is 1)."""
    rows = _labelled(docs, labels, id_col, text_col, label_col)
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        release(rows)
        return Ranking(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0)
    rarer = min(counts, key=lambda y: (counts[y], y))
    cells, groups = _cells(rows, rarer, counts[rarer], counts[1 - rarer])
    release(rows)

    def once(cell: int, good: np.ndarray) -> np.ndarray:
        return (good != (rarer == 1)) | (cell < groups)

    mean, scale = _moments(cells, once)
    weights = _weights(cells, mean, scale, counts[0] * counts[1] // groups)
    ranking = Ranking(mean, scale, weights, 0.0)
    threshold = (_ranked(cells, ranking, once, counts[0] - 1) + _ranked(cells, ranking, once, counts[0])) / 2
    release(cells)
    return Ranking(mean, scale, weights, threshold)


def held_out(id_col):
    return F.crc32(id_col.cast("string")) % 3 == 1


def score(docs: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' id with held_out, score and predicted for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            s = ranking.scores(np.stack([features(t or b"") for t in batch.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int")
    return out.select(F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, ranking: Ranking, text_col: str = "text") -> DataFrame:
    """The rows of docs that the ranking does not reject, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            s = ranking.scores(np.stack([features((t or "").encode()) for t in texts]))
            yield batch.filter(pa.array(s >= 0.5))

    return docs.mapInArrow(run, docs.schema)
