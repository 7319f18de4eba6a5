"""Claims against measured groups: nearest value, tolerance bands, unequal counts.

Claims come from a document and are few; tables may be large. Equal means are
not compared pairwise: the table's means are cut into bands as wide as needed
and a claim meets its own and the neighbouring ones, or, for a strict nearest,
the largest mean below and the smallest above it, found by running minima over
ranges of values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.storage import stored


def nearest(claims: DataFrame, groups: DataFrame) -> DataFrame:
    """Every claim (source, claim_id, x) with the nearest of its source's groups (source, group_key, y): group_key, y, gap.

    Claims and groups are sorted together into ranges of (source, value); within
    a range the group before and behind each row is a running value, and what
    lies in other ranges comes from a table with one row per range and source.
    So a large source is many tasks. Ties go to the smaller value, then group.
    """
    kind = groups.schema["group_key"].dataType.simpleString()
    each = groups.filter("y IS NOT NULL").groupBy("source", "y").agg(F.min("group_key").alias("group_key"))
    both = each.select("source", F.col("y").alias("v"), F.lit(0).alias("is_claim"), F.struct("y", "group_key").alias("g"), F.lit(None).cast("string").alias("claim_id")).unionByName(
        claims.filter("x IS NOT NULL").select("source", F.col("x").alias("v"), F.lit(1).alias("is_claim"), F.lit(None).cast(f"struct<y:double,group_key:{kind}>").alias("g"), F.col("claim_id").cast("string"))
    )
    ranged = stored(both.repartitionByRange("source", "v").withColumn("part", F.spark_partition_id()), "ranges")
    up, down = Window.partitionBy("source", "part").orderBy("v", "is_claim"), Window.partitionBy("source", "part").orderBy(F.desc("v"), "is_claim")
    rows = ranged.withColumns({"below": F.last("g", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0)), "above": F.last("g", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))})
    ends = ranged.groupBy("source", "part").agg(F.max("g").alias("top"), F.min("g").alias("bottom"))
    before, behind = Window.partitionBy("source").orderBy("part"), Window.partitionBy("source").orderBy(F.desc("part"))
    ends = ends.select("source", "part", F.last("top", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)).alias("lower"), F.last("bottom", ignorenulls=True).over(behind.rowsBetween(Window.unboundedPreceding, -1)).alias("higher"))
    out = rows.filter("is_claim = 1").join(ends, ["source", "part"]).withColumns({"below": F.coalesce("below", "lower"), "above": F.coalesce("above", "higher")})
    low, high = F.abs(F.col("v") - F.col("below.y")), F.abs(F.col("above.y") - F.col("v"))
    pick = F.when(F.col("above").isNull() | (low <= high), F.col("below")).otherwise(F.col("above"))
    return out.withColumn("pick", F.coalesce(pick, "above")).select("source", "claim_id", F.col("v").alias("x"), F.col("pick.group_key").alias("group_key"), F.col("pick.y").alias("y"), F.abs(F.col("v") - F.col("pick.y")).alias("gap")).filter("gap IS NOT NULL")


def mean_conflicts(claims: DataFrame, stats: DataFrame, rel: float = 0.08, least: float = 0.15, min_rel: float = 0.12) -> DataFrame:
    """Claimed means too far from the nearest group's: gap above max(least, rel * mean) and above min_rel of the larger one."""
    near = nearest(claims, stats.filter("n >= 2").select("source", "group_key", F.col("mean").alias("y")))
    top = F.greatest(F.abs("x"), F.abs("y"))
    return near.filter((F.col("gap") > F.greatest(F.lit(least), rel * F.abs("y"))) & (F.col("gap") >= min_rel * top))


def error_bar_swaps(claims: DataFrame, stats: DataFrame) -> DataFrame:
    """Claims (source, claim_id, x, err, kind sd or sem) near a group whose other statistic is the printed error: with `is_kind`."""
    near = nearest(claims, stats.filter("n >= 2").select("source", "group_key", F.col("mean").alias("y"))).filter(F.col("gap") <= F.greatest(F.lit(0.25), 0.15 * F.abs("y")))
    j = near.join(claims.select("source", F.col("claim_id").cast("string").alias("claim_id"), "err", "kind"), ["source", "claim_id"]).join(stats.select("source", "group_key", "sd", "sem"), ["source", "group_key"])
    fits = lambda c: F.abs(F.col("err") - F.col(c)) <= F.greatest(F.lit(0.05), 0.08 * F.col(c))
    swap = F.when(fits("sd") & ~fits("sem") & (F.col("kind") == "sem"), "sd").when(fits("sem") & ~fits("sd") & (F.col("kind") == "sd"), "sem")
    return j.withColumn("is_kind", swap).filter("is_kind IS NOT NULL").select("source", "claim_id", "group_key", "x", "err", "kind", "is_kind")


def in_band(a: DataFrame, b: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Pairs of a (.., id_a, x) and b (.., id_b, y) with equal keys and |x - y| <= width, by bands: a value meets three."""
    left = a.withColumn("band", F.explode(F.array(*(F.floor(F.col("x") / width) + i for i in (-1, 0, 1)))))
    right = b.withColumn("band", F.floor(F.col("y") / width))
    return left.join(right, [*keys, "band"]).filter(F.abs(F.col("x") - F.col("y")) <= width).drop("band")


def count_conflicts(claims: DataFrame, counts: DataFrame) -> DataFrame:
    """Stated n (source, stated_n) against a count table's groups (source, group_key, n): each pair that differs."""
    return claims.distinct().join(counts, "source").filter("n <> stated_n").select("source", "stated_n", "group_key", "n").distinct()


def ratio_conflicts(claims: DataFrame) -> DataFrame:
    """Ratios a:b (source, section, a, b) of the methods that differ from those of the same source's figures.

    A source whose methods or figures state none is compared within what it
    states anywhere: a1:b1 is then the smaller of two different ratios.
    """
    sides = claims.groupBy("source").agg(F.count_if(F.col("section") == "methods").alias("m"), F.count_if(F.col("section") == "figure").alias("f"))
    each = claims.join(sides, "source").distinct()
    m = each.filter("section = 'methods' AND f > 0").select("source", F.col("a").alias("a1"), F.col("b").alias("b1"))
    f = each.filter("section = 'figure' AND m > 0").select("source", F.col("a").alias("a2"), F.col("b").alias("b2"))
    told = m.join(f, "source").filter("a1 <> a2 OR b1 <> b2")
    rest = each.filter("m = 0 OR f = 0")
    x, y = rest.select("source", F.col("a").alias("a1"), F.col("b").alias("b1")), rest.select("source", F.col("a").alias("a2"), F.col("b").alias("b2"))
    other = x.join(y, "source").filter(F.struct("a1", "b1") < F.struct("a2", "b2"))
    return told.union(other).distinct()


def exceeds_view(bars: DataFrame, views: DataFrame, slack: float = 1.05) -> DataFrame:
    """Scale bars (source, bar_um) longer than the field of view (source, file, fov_um) of a file."""
    return bars.join(views, "source").filter(F.col("bar_um") > slack * F.col("fov_um")).select("source", "file", "bar_um", "fov_um").distinct()
