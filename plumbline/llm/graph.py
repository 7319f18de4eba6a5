"""Connected components of an edge table, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._io import release, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id that each end of an edge can reach.

    Each round hooks every edge's larger root below the smallest one met next to
    it, then shortens all paths; the number of rounds grows with the logarithm
    of the longest path. Minima aggregate map-side, so a vertex with very many
    edges is no hot group, and each round is cut to a table in the shared folder.
    An empty edge table has no components.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL AND x <> y")
    pairs = stored(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "edges")
    # Every vertex starts below its smallest neighbour (or itself, if that is smaller).
    ends = pairs.union(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    root = stored(ends.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("id"), F.least("x", "y").alias("root")), "roots")
    while True:
        # Shorten paths until every vertex points at a root.
        while True:
            up = root.select(F.col("id").alias("root"), F.col("root").alias("up"))
            short = stored(root.select("id", "root").join(up, "root").select("id", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")), "roots")
            release(root)
            root = short
            if short.filter("moved").isEmpty():
                break
        rx = root.select(F.col("id").alias("x"), F.col("root").alias("rx"))
        ry = root.select(F.col("id").alias("y"), F.col("root").alias("ry"))
        left = stored(pairs.join(rx, "x").join(ry, "y").filter("rx <> ry").select(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y")).distinct(), "edges")
        release(pairs)
        pairs = left
        if pairs.isEmpty():
            return root.select("id", F.col("root").alias("component"))
        hooks = stored(pairs.groupBy("y").agg(F.min("x").alias("to")), "hooks")
        hooked = stored(root.join(hooks, root.root == hooks.y, "left").select("id", F.coalesce("to", "root").alias("root")), "roots")
        release(root, hooks)
        root = hooked
