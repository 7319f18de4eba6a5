"""Lineage: what scripts read, plot and save, and what follows from what."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.storage import release, stored

# Calls that read, draw and save, by the last part of their name.
READERS = {"read_csv", "read_excel", "read_table", "read_parquet", "loadtxt", "read.csv", "read.table", "read_tsv", "read.delim", "read_xlsx"}
PLOTTERS = {"plot", "scatter", "bar", "hist", "boxplot", "barplot", "ggplot", "violinplot", "stripplot", "swarmplot", "lineplot"}
SAVERS = {"savefig", "to_csv", "to_excel", "ggsave", "write.csv", "pdf", "png", "write_csv"}
_R_CALL = re.compile(r"([A-Za-z][A-Za-z0-9._]*)\s*\(([^()]*)")
_R_SET = re.compile(r"^\s*([A-Za-z][A-Za-z0-9._]*)\s*(?:<-|=)\s*(.+)$")
_QUOTED = re.compile(r"[\"']([^\"']+)[\"']")


def python_edges(code: str) -> list[tuple[str, str, str]]:
    """(src, dst, kind) of a Python script: file -> variable, variable -> variable, variable -> plot or file."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError):
        return []
    out: list[tuple[str, str, str]] = []

    def name(call: ast.Call) -> str:
        return call.func.attr if isinstance(call.func, ast.Attribute) else call.func.id if isinstance(call.func, ast.Name) else ""

    def text(call: ast.Call) -> str | None:
        return next((a.value for a in [*call.args, *(k.value for k in call.keywords)] if isinstance(a, ast.Constant) and isinstance(a.value, str)), None)

    modules = {(a.asname or a.name).split(".")[0] for n in ast.walk(tree) if isinstance(n, ast.Import | ast.ImportFrom) for a in n.names} | {"plt", "sns", "pd", "np"}
    for node in ast.walk(tree):
        if isinstance(node, ast.Assign) and isinstance(node.targets[0], ast.Name):
            target = node.targets[0].id
            for call in (c for c in ast.walk(node.value) if isinstance(c, ast.Call) and name(c) in READERS):
                if path := text(call):
                    out.append((path, target, "read"))
            out += [(n.id, target, "derive") for n in ast.walk(node.value) if isinstance(n, ast.Name) and n.id != target and n.id not in modules]
        if isinstance(node, ast.Call):
            used = sorted({n.id for a in [node.func, *node.args, *(k.value for k in node.keywords)] for n in ast.walk(a) if isinstance(n, ast.Name)} - modules)
            if name(node) in SAVERS and (path := text(node)):
                out += [(v, path, "save") for v in used]
            elif name(node) in PLOTTERS:
                out += [(v, f"plot:{node.lineno}", "plot") for v in used]
    return sorted(set(out))


def r_edges(code: str) -> list[tuple[str, str, str]]:
    """The same of an R script, line by line."""
    out: list[tuple[str, str, str]] = []
    known: set[str] = set()
    for number, line in enumerate(code.split("\n"), 1):
        line = line.split("#")[0]
        m = _R_SET.match(line)
        target, body = (m[1], m[2]) if m else (None, line)
        used = {w for w in re.findall(r"[A-Za-z][A-Za-z0-9._]*", _QUOTED.sub("", body)) if w in known}
        for call, args in _R_CALL.findall(body):
            path = _QUOTED.search(args)
            if call in READERS and path and target:
                out.append((path[1], target, "read"))
            elif call in PLOTTERS:
                out += [(v, f"plot:{number}", "plot") for v in used]
            elif call in SAVERS and path:
                out += [(v, path[1], "save") for v in used]
        if target:
            out += [(v, target, "derive") for v in used if v != target]
            known.add(target)
    return sorted(set(out))


def script_edges(scripts: DataFrame) -> DataFrame:
    """(path, src, dst, kind) of scripts (path, code); a path ending in .r is R, others are Python. Code that does not parse has no edges."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(p, *e) for p, c in zip(pdf["path"], pdf["code"], strict=True) for e in (r_edges if p.lower().endswith(".r") else python_edges)(c or "")]
            yield pd.DataFrame(rows, columns=["path", "src", "dst", "kind"])

    return scripts.select("path", "code").mapInPandas(run, "path string, src string, dst string, kind string")


def reachable(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """(start, node, hops): what follows from each start (start) along edges (src, dst), by the fewest hops; `most` bounds them if given.

    Each round goes on from the nodes found last and keeps those not met before,
    so cycles end and a node is visited once per start, however many ways lead there.
    """
    edges = stored(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
    rounds = [stored(starts.select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("hops")).filter("start IS NOT NULL").distinct(), "walk")]
    while most is None or len(rounds) <= most:
        on = rounds[-1].join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        met = reduce(DataFrame.union, rounds).select("start", "node")
        new = stored(on.join(met, ["start", "node"], "left_anti").withColumn("hops", F.lit(len(rounds)).cast("long")), "walk")
        if new.isEmpty():
            break
        rounds.append(new)
    return reduce(DataFrame.union, rounds)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id that each end of an undirected edge can reach; an edge from a node to itself is none.

    Roots hang below the smallest root next to them, then paths are shortened
    until every node points at its root: the number of rounds grows with the
    logarithm of the longest path. Minima aggregate map-side, so a node with very
    many edges is no hot group; every round is a table in the shared folder, and
    the one before is given back.
    """
    x, y = F.least(a, b), F.greatest(a, b)
    links = stored(edges.select(x.alias("x"), y.alias("y")).filter("x IS NOT NULL AND y IS NOT NULL AND x <> y").distinct(), "links")
    ends = links.union(links.select("y", "x"))
    points = stored(ends.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("m")).select("id", F.least("id", "m").alias("to")), "points")
    while True:
        moved = True
        while moved:
            on = points.select(F.col("id").alias("to"), F.col("to").alias("next"))
            shorter = stored(points.select("id", "to").join(on, "to").select("id", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "points")
            release(points)
            points, moved = shorter, not shorter.filter("moved").isEmpty()
        root = lambda c: points.select(F.col("id").alias(c), F.col("to").alias(f"root_{c}"))  # noqa: E731, B023
        across = links.join(root("x"), "x").join(root("y"), "y").filter("root_x <> root_y")
        across = stored(across.select(F.least("root_x", "root_y").alias("x"), F.greatest("root_x", "root_y").alias("y")).distinct(), "links")
        release(links)
        links = across
        if links.isEmpty():
            return points.select("id", F.col("to").alias("component"))
        hooks = stored(links.groupBy("y").agg(F.min("x").alias("under")), "hooks")
        hung = stored(points.join(hooks, points["to"] == hooks["y"], "left").select("id", F.coalesce("under", "to").alias("to")), "points")
        release(points, hooks)
        points = hung


def save_conflicts(edges: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Saved files whose name has tokens of the vocabulary, none of which the plotted data's name has, although it has some."""
    words = F.array(*map(F.lit, vocabulary))
    has = lambda c: F.filter(words, lambda t: F.contains(F.lower(F.col(c)), t))
    s = edges.filter("kind = 'save'").withColumns({"in_data": has("src"), "in_name": has("dst")})
    return s.filter((F.size("in_data") > 0) & (F.size("in_name") > 0) & ~F.arrays_overlap("in_data", "in_name")).select("path", "src", "dst")


def plotted_twice(edges: DataFrame) -> DataFrame:
    """Data that two or more plots of a script draw."""
    return edges.filter("kind = 'plot'").groupBy("path", "src").agg(F.count_distinct("dst").alias("n_plots")).filter("n_plots >= 2")
