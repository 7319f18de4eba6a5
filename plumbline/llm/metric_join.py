"""Exact metric range join of embeddings under a cosine threshold.

On unit vectors a cosine threshold is a radius r = sqrt(2 - 2 * cosine) of the
Euclidean metric. Pivots divide the vectors of a label into cells (nearest
pivot). A vector is replicated to another cell only if it may lie within r of a
vector there: by the triangle inequality its distances to the two pivots then
differ by 2r at most, and by the bisecting hyperplane's distance (d_j^2 - d_i^2)
/ (2 d_ij) by r at most. Cells then join on their own: each of a cell's own
vectors meets all its partners there. Large cells are cut into blocks, each own
block against each block of the cell's window, so that no task holds more than
two blocks. Counts are added up; of links, each block hands on a spanning forest
only, so no group of copies is expanded into pairs. Equal vectors are compared
once, with their number as weight.

Vectors that are null, empty, zero or hold null or non-finite components, and
those without label or id, link with nothing. Vectors of different length never
link. Rows that repeat an id count one by one and share its component. An empty
table gives an empty result. Columns other than id, vector and label are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._io import stored
from plumbline.llm.graph import components

#: Vectors that a pivot stands for, and pivots of a label at most; both only steer how work is cut.
CELL, MOST_PIVOTS = 1024, 4096
#: Vectors of a block.
BLOCK = 2048


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt((x * x).sum(1, keepdims=True))
    return x / norms, norms[:, 0]


def _cells(reps: DataFrame, cosine: float) -> DataFrame:
    """(label, dim, id, mult, v, cell, own): each vector in its own cell and in those whose vectors may reach it."""
    radius = float(np.sqrt(2 - 2 * cosine)) + 1e-6
    sizes = reps.groupBy("label", "dim").agg(F.count("*").alias("n_label"))
    sizes = sizes.withColumns({"n_pivots": F.least(F.lit(MOST_PIVOTS), F.ceil(F.col("n_label") / CELL)).cast("int"), "n_parts": F.ceil(F.col("n_label") / BLOCK).cast("int")})
    dealt = reps.join(sizes, ["label", "dim"]).withColumn("h", F.xxhash64("id"))
    pivots = dealt.groupBy("label", "dim", F.expr("pmod(h, n_pivots)").alias("slot")).agg(F.min_by("v", F.struct("h", "id")).alias("v"), F.first("n_parts").alias("n_parts"))
    pivots = stored(pivots, "pivots").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    rows = dealt.withColumn("part", F.expr("cast(pmod(shiftright(h, 20), n_parts) as int)"))

    def assign(key, vectors: pa.Table, own: pa.Table) -> pa.Table:
        order = np.argsort(own.column("slot").to_numpy())
        names = own.column("slot").to_numpy()[order]
        p, _ = _unit(_matrix(own.column("v"))[order]) if len(order) else (np.zeros((0, 1)), None)
        out_row, out_cell, out_own = [], [], []
        if vectors.num_rows:
            x, _ = _unit(_matrix(vectors.column("v")))
            between = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))
            for lo in range(0, len(x), 512):
                d2 = np.maximum(2 - 2 * x[lo : lo + 512] @ p.T, 0)
                home = d2.argmin(1)
                own_d2 = d2[np.arange(len(home)), home][:, None]
                apart = np.maximum(between[home], 1e-12)
                near = (np.sqrt(d2) - np.sqrt(own_d2) <= 2 * radius) & ((d2 - own_d2) / (2 * apart) <= radius)
                near[np.arange(len(home)), home] = True
                r, c = np.nonzero(near)
                out_row.append(r + lo)
                out_cell.append(names[c])
                out_own.append(c == home[r])
        take = pa.array(np.concatenate([np.zeros(0, np.int64), *out_row]).astype(np.int64))
        columns = [vectors.column(c).take(take) for c in ("label", "dim", "id", "mult", "v")]
        return pa.Table.from_arrays([*columns, pa.array(np.concatenate([np.zeros(0, np.int64), *out_cell]).astype(np.int64)), pa.array(np.concatenate([np.zeros(0, bool), *out_own]).astype(bool))], ["label", "dim", "id", "mult", "v", "cell", "own"])

    kinds = {f.name: f.dataType.simpleString() for f in reps.schema}
    schema = f"label {kinds['label']}, dim int, id {kinds['id']}, mult long, v {kinds['v']}, cell long, own boolean"
    keys = ["label", "dim", "part"]
    own = pivots.select(F.col("label").alias("p_label"), F.col("dim").alias("p_dim"), F.col("part").alias("p_part"), F.col("slot").cast("long").alias("slot"), F.col("v").alias("v"))
    return rows.select(*keys, "id", "mult", "v").groupBy(*keys).cogroup(own.groupBy("p_label", "p_dim", "p_part")).applyInArrow(assign, schema)


def _block_links(cosine: float):
    def links(t: pa.Table) -> pa.Table:
        own = t.column("own").to_numpy()
        left, right = t.filter(pa.array(own)), t.filter(pa.array(~own))
        a_id, b_id = left.column("id").to_numpy(), right.column("id").to_numpy()
        n = np.zeros(len(a_id), np.int64)
        to = a_id.copy(), b_id.copy()
        if len(a_id) and len(b_id):
            a, b, weight = _matrix(left.column("v")), _matrix(right.column("v")), right.column("mult").to_numpy()
            (_, an), (_, bn) = _unit(a), _unit(b)
            hit = (a @ b.T) / (an[:, None] * bn[None, :]) >= cosine
            hit &= a_id[:, None] != b_id[None, :]
            n = hit @ weight
            rows, cols = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
            if len(rows):
                # Smallest id that each vector reaches within the block.
                hit, la, lb = hit[np.ix_(rows, cols)], a_id[rows].copy(), b_id[cols].copy()
                top = np.iinfo(np.int64).max
                while True:
                    na = np.minimum(la, np.where(hit, lb[None, :], top).min(1))
                    nb = np.minimum(lb, np.where(hit, na[:, None], top).min(0))
                    if (na == la).all() and (nb == lb).all():
                        break
                    la, lb = na, nb
                to[0][rows], to[1][cols] = la, lb
        moved = to[1] != b_id
        ids = np.concatenate([a_id, b_id[moved]])
        return pa.table({"id": ids, "n": np.concatenate([n, np.zeros(moved.sum(), np.int64)]), "to": np.concatenate([to[0], to[1][moved]])})

    return links


def link(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of every row: links join vectors of equal label with at least that cosine."""
    sane = "v IS NOT NULL AND size(v) > 0 AND label IS NOT NULL AND id IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    rows = rows.withColumn("ok", F.coalesce(F.expr(sane), F.lit(False))).withColumn("dim", F.when(F.col("ok"), F.size("v")))
    reps = stored(rows.filter("ok").groupBy("label", "dim", "v").agg(F.min("id").alias("id"), F.count("*").alias("mult")), "vectors")
    cells = stored(_cells(reps, cosine), "cells")
    sizes = cells.groupBy("label", "dim", "cell").agg(F.ceil(F.sum(F.col("own").cast("int")) / BLOCK).cast("int").alias("n_own"), F.ceil(F.count("*") / BLOCK).cast("int").alias("n_all"))
    dealt = cells.join(sizes.filter("n_own > 0"), ["label", "dim", "cell"]).withColumn("h", F.xxhash64("id", F.lit(1)))
    mine, others = F.expr("cast(pmod(h, n_own) as int)"), F.expr("cast(pmod(h, n_all) as int)")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["label", "dim", "cell", "i", "j"]
    left = dealt.filter("own").withColumns({"i": mine}).withColumn("j", every("n_all")).select(*keys, "id", "mult", "v", F.lit(True).alias("own"))
    right = dealt.withColumns({"j": others}).withColumn("i", every("n_own")).select(*keys, "id", "mult", "v", F.lit(False).alias("own"))
    found = stored(left.union(right).groupBy(*keys).applyInArrow(_block_links(cosine), "id long, n long, to long"), "links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n")).withColumnRenamed("id", "rep")
    linked = components(found, "id", "to").withColumnRenamed("id", "rep")
    copies = reps.select("label", "dim", "v", F.col("id").alias("rep"), "mult")
    out = rows.join(copies, ["label", "dim", "v"], "left").join(counts, "rep", "left").join(linked, "rep", "left")
    out = out.select("id", (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("mult") - 1, F.lit(0))).alias("n_links"), F.coalesce("component", "rep", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id_col)
