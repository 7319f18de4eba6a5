"""Ordered scans: curves, sections, runs. Every window is within one source, file or document."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def survival_audit(curves: DataFrame) -> DataFrame:
    """Points (curve, ord, survival, alive, n0) that no whole number of survivors explains.

    Values above 1.5 anywhere in a curve mean percent. Points outside 0..1 are
    skipped. Flags: not_whole (survival * n0 off a whole number by more than
    0.001), alive_gap (alive differs by more than 0.51), rise (more than 0.51
    above the point before).
    """
    w = Window.partitionBy("curve")
    frac = F.when(F.max("survival").over(w) > 1.5, F.col("survival") / 100).otherwise(F.col("survival"))
    kept = curves.filter("n0 >= 2").withColumn("frac", frac).filter("frac >= 0 AND frac <= 1.000001").withColumn("expected", F.col("frac") * F.col("n0"))
    before = F.lag("expected").over(w.orderBy("ord"))
    out = kept.withColumns({"not_whole": F.abs(F.col("expected") - F.round("expected")) > 1e-3, "alive_gap": F.coalesce(F.abs(F.col("alive") - F.col("expected")) > 0.51, F.lit(False)), "rise": F.coalesce(F.col("expected") - before > 0.51, F.lit(False))})
    return out.filter("not_whole OR alive_gap OR rise").select("curve", "ord", "expected", "not_whole", "alive_gap", "rise")


def falling_cohorts(series: DataFrame, least: int = 3) -> DataFrame:
    """First value of every whole-numbered series (curve, ord, value) that never rises: its cohort."""
    w = Window.partitionBy("curve").orderBy("ord")
    s = series.withColumn("up", F.coalesce(F.col("value") > F.lag("value").over(w), F.lit(False)))
    g = s.groupBy("curve").agg(F.min_by("value", "ord").alias("cohort"), F.count("*").alias("n"), F.bool_or("up").alias("up"), F.bool_and(F.col("value") == F.floor("value")).alias("whole"))
    return g.filter((F.col("n") >= least) & ~F.col("up") & F.col("whole")).select("curve", F.col("cohort").cast("long").alias("cohort"), "n")


def _replays(shares: list[float], tolerance: float, n: int) -> bool:
    """Whether deaths of whole animals among n, some leaving unobserved, give the printed survival shares."""
    now, at_risk = 1.0, n
    for share in shares:
        if share >= now - tolerance:
            continue
        found = False
        for risk in range(at_risk, 0, -1):
            deaths = round(risk * (1 - share / now)) if now else 0
            if deaths >= 1 and abs(now * (1 - deaths / risk) - share) <= tolerance:
                now, at_risk, found = now * (1 - deaths / risk), risk - deaths, True
                break
        if not found:
            return False
    return True


def cohort_sizes(curves: DataFrame, most: int = 5000, decimals: int = 3) -> DataFrame:
    """(curve, n): the smallest cohort whose whole deaths, with censoring, replay the survival curve (curve, ord, survival) to its printed precision.

    Needs three falling values from 0.99 on at least; null where none of 2..most
    fits. A curve is one group; its points are few by nature.
    """

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        shares = pdf.sort_values("ord")["survival"].tolist()
        n = None
        if len(shares) >= 3 and shares[0] >= 0.99 and all(a >= b for a, b in zip(shares, shares[1:], strict=False)):
            n = next((n for n in range(2, most + 1) if _replays(shares, 0.5 * 10**-decimals, n)), None)
        return pd.DataFrame({"curve": [str(pdf["curve"].iloc[0])], "n": pd.array([n], dtype="Int64")})

    return curves.select("curve", "ord", "survival").groupBy("curve").applyInPandas(search, "curve string, n long")


def sections(lines: DataFrame, head: Column) -> DataFrame:
    """Lines (doc, ord, line) with the last heading at or above them: head is null off headings."""
    return lines.withColumn("section", F.last(head, ignorenulls=True).over(Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)))


def joined_lines(lines: DataFrame, starts: Column) -> DataFrame:
    """(doc, entry, n_lines, text): runs of lines, a new one wherever starts holds; lines before the first start are entry 0."""
    w = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("entry", F.sum(F.when(F.coalesce(starts, F.lit(False)), 1).otherwise(0)).over(w))
    whole = marked.groupBy("doc", "entry").agg(F.count("*").alias("n_lines"), F.sort_array(F.collect_list(F.struct("ord", "line"))).alias("l"))
    return whole.select("doc", "entry", "n_lines", F.array_join(F.col("l.line"), " ").alias("text"))


def islands(rows: DataFrame, keys: list[str], order: str, gap: int = 1) -> DataFrame:
    """Runs of a whole-numbered column whose neighbours lie at most `gap` apart: (keys, first, last, n: its different numbers).

    One sort serves all: rows that begin or end a run stay, and each that begins
    one looks at the next that ends one. Nothing is gathered in hash tables.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    x = F.col(order)
    apart = lambda y, d: ~F.coalesce(d <= gap, x.isNull() & y["there"] & y["x"].isNull())
    near = F.struct(F.lit(True).alias("there"), x.alias("x"))
    marked = rows.select(*keys, order).withColumns({"_before": F.lag(near).over(w), "_after": F.lead(near).over(w), "_rank": F.dense_rank().over(w)})
    before, after = F.col("_before"), F.col("_after")
    ends = marked.select(*keys, order, "_rank", F.coalesce(apart(before, x - before["x"]), F.lit(True)).alias("_begins"), F.coalesce(apart(after, after["x"] - x), F.lit(True)).alias("_ends")).filter("_begins OR _ends")
    then = F.when(F.col("_ends"), F.struct(order, "_rank")).otherwise(F.lead(F.struct(order, "_rank")).over(w))
    runs = ends.withColumn("_then", then).filter("_begins")
    return runs.select(*keys, x.alias("first"), F.col("_then")[order].alias("last"), (F.col("_then._rank") - F.col("_rank") + 1).cast("long").alias("n"))


def dominant_run(rows: DataFrame, keys: list[str], order: str, start: int, gap: int = 1) -> DataFrame:
    """The longest run per key; one that begins at `start` wins if it is at least half as long."""
    runs = islands(rows, keys, order, gap)
    longest = runs.groupBy(*keys).agg(F.max("n").alias("most"))
    fine = runs.join(longest, keys).withColumn("rank", F.when((F.col("first") == start) & (2 * F.col("n") >= F.col("most")), 0).when(F.col("n") == F.col("most"), 1))
    return fine.filter("rank IS NOT NULL").groupBy(*keys).agg(F.min_by(F.struct("first", "last", "n"), F.struct("rank", "first")).alias("r")).select(*keys, "r.first", "r.last", "r.n")


def contiguous_prefix(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """(keys, upto): the largest m for which 1..m are all there; 0 if 1 is not."""
    w = Window.partitionBy(*keys).orderBy(number)
    n = rows.select(*keys, number).filter(F.col(number) >= 1).distinct().withColumn("rank", F.row_number().over(w))
    upto = n.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("rank") == F.col(number), F.col(number))), F.lit(0)).cast("long").alias("upto"))
    return rows.select(*keys).distinct().join(upto, keys, "left").select(*keys, F.coalesce("upto", F.lit(0).cast("long")).alias("upto"))


def strictly_rising(series: DataFrame) -> DataFrame:
    """(curve, n) of series (curve, ord, value) in which every value exceeds the one before."""
    w = Window.partitionBy("curve").orderBy("ord")
    s = series.withColumn("ok", F.coalesce(F.col("value") > F.lag("value").over(w), F.lit(True)))
    return s.groupBy("curve").agg(F.count("*").alias("n"), F.bool_and("ok").alias("ok")).filter("ok AND n >= 2").drop("ok")


def chunked(text: str, size: int, overlap: int) -> Iterator[str]:
    """Paragraphs (parted by blank lines) packed to `size` characters; a piece begins with the end of the one before; paragraphs over twice the size are cut hard."""
    held = ""
    for paragraph in (p.strip() for p in re.split(r"\n\s*\n", text)):
        if not paragraph:
            continue
        if len(paragraph) > 2 * size:
            if held:
                yield held
            yield from (paragraph[i : i + size] for i in range(0, len(paragraph), max(size - overlap, 1)))
            held = ""
        elif held and len(held) + 1 + len(paragraph) > size:
            yield held
            held = f"{held[-overlap:]} {paragraph}" if overlap else paragraph
        else:
            held = f"{held}\n{paragraph}" if held else paragraph
    if held:
        yield held


def chunks(docs: DataFrame, size: int = 1200, overlap: int = 150) -> DataFrame:
    """(doc, chunk, text) of documents (doc, text)."""
    kind = docs.schema["doc"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(d, i, c) for d, t in zip(pdf["doc"], pdf["text"], strict=True) for i, c in enumerate(chunked(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=["doc", "chunk", "text"])

    return docs.select("doc", "text").mapInPandas(run, f"doc {kind}, chunk long, text string")
