"""Checks on titled table blocks: reused columns, stated summaries, legends against blocks.

Rows of blocks (path, sheet, block, number, panels, explicit, title, col, header,
role, row, num, str) come from plumbline.sources.blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.storage import stored

BLOCK = ["path", "sheet", "block"]
#: Headers of columns along which curves run.
AXIS = r"(?i)^(x|time|days?|hours?|hrs?|minutes?|mins?|seconds?|weeks?|age|dose|conc|concentration|distance|position|frequency|wavelength|temperature)([ (_/.]|$)"


def condition(title: Column) -> Column:
    """A title without its figure label and signs: what the block's data are of."""
    t = F.regexp_replace(F.lower(title), r"\(?\s*(extended\s+data\s+)?fig(ure)?s?\.?\s*s?[0-9]+[a-z]?\s*\)?", " ")
    return F.trim(F.regexp_replace(t, r"[\s,;:/()–-]+", " "))


def columns(rows: DataFrame, decimals: int = 9) -> DataFrame:
    """(block, number, panels, explicit, title, col, header, n, vals in row order, ordered_fp, sorted_fp) of every value column."""
    v = rows.filter("role = 'value' AND num IS NOT NULL").groupBy(*BLOCK, "number", "panels", "explicit", "title", "col", "header").agg(F.sort_array(F.collect_list(F.struct("row", "num"))).alias("r"))
    vals = F.transform("r", lambda x: F.bround(x["num"], decimals))
    text = lambda a: F.sha2(F.array_join(F.transform(a, lambda x: F.format_string(f"%.{decimals}f", x)), ","), 256)
    return v.withColumn("vals", vals).select(*BLOCK, "number", "panels", "explicit", "title", "col", "header", F.size("vals").cast("long").alias("n"), "vals", text(F.col("vals")).alias("ordered_fp"), text(F.sort_array("vals")).alias("sorted_fp"))


def layout(rows: DataFrame) -> DataFrame:
    """(block, layout): long (a column groups the rows), matrix, xy (the first column is an axis and rises), wide or single, whatever its size."""
    axis = F.when((F.col("role") == "value") & F.col("header").rlike(AXIS), F.struct("row", "num"))
    per = rows.filter("role IN ('value', 'category')").groupBy(*BLOCK, "col", "role").agg(F.first("header").alias("header"), F.count("*").alias("n"), F.count_distinct("str").alias("kinds"), F.sort_array(F.collect_list(axis)).alias("r"))
    rising = F.forall(F.sequence(F.lit(1), F.greatest(F.size("r") - 1, F.lit(1))), lambda i: F.coalesce(F.try_element_at("r.num", i) < F.try_element_at("r.num", i + 1), F.lit(True)))
    named = per.withColumns({"groups": (F.col("role") == "category") & (F.col("kinds") < F.col("n")), "rising": (F.col("role") == "value") & (F.col("n") >= 3) & F.col("header").rlike(AXIS) & rising})
    summed = rows.filter("role NOT IN ('value', 'category')").select(*BLOCK).distinct().withColumn("summed", F.lit(True))
    g = named.groupBy(*BLOCK).agg(F.bool_or("groups").alias("groups"), F.bool_or(F.col("role") == "category").alias("categories"), F.count_if(F.col("role") == "value").alias("values"), F.min_by("rising", F.when(F.col("role") == "value", F.col("col"))).alias("first_rises"))
    kind = F.when(F.col("groups"), "long").when(F.col("categories"), F.when(F.col("values") >= 3, "matrix").otherwise("single"))
    kind = kind.when((F.col("values") >= 2) & F.coalesce("first_rises", F.lit(False)), "xy").when((F.col("values") >= 2) & F.col("summed").isNull(), "wide").otherwise("single")
    return g.join(summed, BLOCK, "left").select(*BLOCK, kind.alias("layout"))


def reconciled(cols: DataFrame) -> DataFrame:
    """Columns whose figure only the file's name tells take the explicit figure under which the same values stand elsewhere, the smallest of several."""
    told = cols.filter("explicit AND number IS NOT NULL").groupBy("ordered_fp", "n", "header").agg(F.min(F.struct("number", "panels")).alias("told"))
    out = cols.join(stored(told, "told"), ["ordered_fp", "n", "header"], "left")
    moved = ~F.col("explicit") & F.col("told").isNotNull()
    return out.withColumns({"number": F.when(moved, F.col("told.number")).otherwise(F.col("number")), "panels": F.when(moved, F.col("told.panels")).otherwise(F.col("panels"))}).select(*cols.columns)


def distinct_blocks(cols: DataFrame) -> DataFrame:
    """(content, n_copies, path, sheet, block): blocks of equal content once, under the first of them."""
    content = cols.groupBy(*BLOCK).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "header", "ordered_fp"))), ";"), 256).alias("content"))
    return content.groupBy("content").agg(F.count("*").alias("n_copies"), F.min(F.struct(*BLOCK)).alias("f")).select("content", "n_copies", "f.*")


def reused_columns(cols: DataFrame, least: int = 5, distinct: int = 3) -> DataFrame:
    """(number_a, panels_a, number_b, panels_b, same_condition, n_columns, n_in_order): columns of other figures or panels with the same values, in row order or not.

    Columns with equal values are a class; every member is told against the
    class' first one, so a class of any size gives one pair a member.
    """
    fine = cols.filter((F.col("n") >= least) & (F.size(F.array_distinct("vals")) >= distinct)).withColumn("condition", condition(F.col("title")))
    fine = stored(fine.select("number", "panels", "condition", *BLOCK, "col", "ordered_fp", "sorted_fp"), "columns")
    place = F.struct("number", "panels", *BLOCK, "col", "condition", "ordered_fp")
    classes = stored(fine.groupBy("sorted_fp").agg(F.min(place).alias("first"), F.count("*").alias("k")).filter("k > 1").drop("k"), "classes")
    met = fine.join(classes, "sorted_fp").filter("NOT (number <=> first.number AND panels <=> first.panels)")
    out = met.select(F.col("first.number").alias("number_a"), F.col("first.panels").alias("panels_a"), F.col("number").alias("number_b"), F.col("panels").alias("panels_b"), (F.col("condition") == F.col("first.condition")).alias("same_condition"), (F.col("ordered_fp") == F.col("first.ordered_fp")).alias("in_order"))
    return out.groupBy("number_a", "panels_a", "number_b", "panels_b", "same_condition").agg(F.count("*").alias("n_columns"), F.count_if("in_order").alias("n_in_order"))


def _near(stated: Column, value: Column, decimals: Column) -> Column:
    """Half a unit of the last digit printed, else a millionth."""
    allowed = F.when(decimals.between(0, 6), F.lit(0.5) * F.pow(F.lit(10.0), -decimals) * (1 + 1e-9)).otherwise(F.abs(value) * 1e-6)
    return F.coalesce(F.abs(stated - value) <= allowed, F.lit(False))


def summaries(rows: DataFrame) -> DataFrame:
    """(block, col, header, n, mean_status, sd_status, sem_status) of value columns of three values at least with a stated mean, SD or SEM.

    Its last digit is that of the number as printed (str), where the cell keeps it
    as text; else of the number's shortest notation.
    mean: ok, dropped_value (one value left out explains it, of four at least) or
    unexplained; sd: sample, population or unexplained; sem: ok, n_minus_1 or
    unexplained. After a dropped value the others are held against the rest.
    """
    keys = [*BLOCK, "col", "header"]
    v = rows.filter("role = 'value' AND num IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n"), F.sum("num").alias("s"), F.sum(F.col("num") * F.col("num")).alias("q"), F.collect_list("num").alias("vals"))
    printed = F.when(F.col("str").rlike(r"^\s*[+-]?[0-9]+([.][0-9]*)?\s*$"), F.trim("str"))
    text = F.coalesce(printed, F.regexp_replace(F.col("num").cast("decimal(30,10)").cast("string"), r"0+$", ""))
    stated = rows.filter("role IN ('mean', 'sd', 'sem') AND num IS NOT NULL").groupBy(*keys).agg(*(F.max(F.when(F.col("role") == k, F.struct("num", F.length(F.regexp_extract(text, r"\.([0-9]*)$", 1)).alias("decimals")))).alias(k) for k in ("mean", "sd", "sem")))
    j = v.filter("n >= 3").join(stated, keys)
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    without = F.filter("vals", lambda x: _near(F.col("mean.num"), (s - x) / (n - 1), F.col("mean.decimals")))
    plain = _near(F.col("mean.num"), s / n, F.col("mean.decimals"))
    mean_status = F.when(F.col("mean").isNull(), None).when(plain, "ok").when((n >= 4) & (F.size(without) == 1), "dropped_value").otherwise("unexplained")
    j = j.withColumn("mean_status", mean_status).withColumn("x", F.when(F.col("mean_status") == "dropped_value", without[0]))
    j = j.withColumns({"m": n - F.col("x").isNotNull().cast("int"), "s": s - F.coalesce("x", F.lit(0.0)), "q": q - F.coalesce(F.col("x") * F.col("x"), F.lit(0.0))})
    squares = F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("m"), F.lit(0.0))
    j = j.withColumns({"sd1": F.sqrt(squares / (F.col("m") - 1)), "sd0": F.sqrt(squares / F.col("m"))})
    fits = lambda c, value: _near(F.col(f"{c}.num"), value, F.col(f"{c}.decimals"))
    sd_status = F.when(F.col("sd").isNull(), None).when(fits("sd", F.col("sd1")), "sample").when(fits("sd", F.col("sd0")), "population").otherwise("unexplained")
    ref = F.coalesce("sd.num", "sd1")
    root, less = F.sqrt("m"), F.sqrt(F.col("m") - 1)
    ok = fits("sem", F.col("sd1") / root) | fits("sem", F.col("sd0") / root) | fits("sem", ref / root)
    sem_status = F.when(F.col("sem").isNull(), None).when(ok, "ok").when(fits("sem", ref / less) | fits("sem", F.col("sd1") / less), "n_minus_1").otherwise("unexplained")
    return j.select(*keys, "n", "mean_status", sd_status.alias("sd_status"), sem_status.alias("sem_status"))


def block_ns(rows: DataFrame) -> DataFrame:
    """(block, number, panel, group_key, n): how many values each group of a block has: by a grouping column, else by value column."""
    kinds = layout(rows)
    values = rows.filter("role = 'value' AND num IS NOT NULL").select(*BLOCK, "number", "panels", "col", "header", "row")
    groups = rows.filter("role = 'category'").groupBy(*BLOCK, "row").agg(F.min_by("str", "col").alias("group_key"))
    both = values.join(kinds, BLOCK).join(groups, [*BLOCK, "row"], "left")
    key = F.when(F.col("layout") == "long", F.col("group_key")).otherwise(F.col("header"))
    per = both.filter("layout IN ('long', 'wide', 'single')").groupBy(*BLOCK, "number", "panels", "col", key.alias("group_key")).agg(F.count("*").alias("n"))
    per = per.groupBy(*BLOCK, "number", "panels", "group_key").agg(F.max("n").alias("n"))
    return per.select(*BLOCK, "number", F.explode(F.split("panels", ",")).alias("panel"), "group_key", "n")


def matched_blocks(panel_ns: DataFrame, ns: DataFrame) -> DataFrame:
    """(number, panel, path, sheet, block, hits): for each panel (number, panel, group_key, n) the block under its heading that holds most of its n, then the first."""
    stated = panel_ns.groupBy("number", "panel", "n").agg(F.count("*").alias("c1"))
    found = ns.groupBy(*BLOCK, "number", "panel", "n").agg(F.count("*").alias("c2"))
    hits = found.join(stated, ["number", "panel", "n"], "left").groupBy("number", "panel", *BLOCK).agg(F.sum(F.least("c1", "c2")).alias("hits")).join(panel_ns.select("number", "panel").distinct(), ["number", "panel"], "left_semi")
    last = Window.partitionBy("number", "panel").orderBy(F.desc(F.coalesce("hits", F.lit(0))), *BLOCK)
    return hits.withColumn("rank", F.row_number().over(last)).filter("rank = 1").select("number", "panel", *BLOCK, F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


def panel_findings(panel_ns: DataFrame, ns: DataFrame) -> DataFrame:
    """(number, panel, kind, group_key, stated, found): panels that several blocks claim with other numbers (duplicate_reference), and stated n that a panel's block has for no group (n_differs)."""
    several = ns.groupBy("number", "panel", *BLOCK).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "group_key", "n"))), ",").alias("profile"))
    twice = several.groupBy("number", "panel").agg(F.count_distinct("profile").alias("k")).filter("k > 1").select("number", "panel", F.lit("duplicate_reference").alias("kind"), F.lit(None).cast("string").alias("group_key"), F.lit(None).cast("long").alias("stated"), F.col("k").alias("found"))
    of = matched_blocks(panel_ns, ns).select("number", "panel", *BLOCK)
    own = ns.join(of, ["number", "panel", *BLOCK])
    fits = own.select("number", "panel", "n").distinct()
    closest = own.groupBy("number", "panel").agg(F.max("n").alias("found"))
    wrong = panel_ns.join(closest, ["number", "panel"]).join(fits, ["number", "panel", "n"], "left_anti")
    return twice.unionByName(wrong.select("number", "panel", F.lit("n_differs").alias("kind"), "group_key", F.col("n").cast("long").alias("stated"), F.col("found").cast("long").alias("found")))
