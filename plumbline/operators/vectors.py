"""Group vectors and their statistics.

obs: (source, group_key, value), one measurement a row. vectors: (source,
group_key, vals sorted ascending, n). A null group stays a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import arrays, stats


def vectors(obs: DataFrame) -> DataFrame:
    return obs.filter("value IS NOT NULL").groupBy("source", "group_key").agg(F.sort_array(F.collect_list("value")).alias("vals")).withColumn("n", F.size("vals").cast("long"))


def count_vectors(table: DataFrame, least: int = 3) -> DataFrame:
    """(source, group_key, n: sum of counts) of contingency tables (source, group_key, category, cnt).

    A source counts as one if it has `least` rows at least, all counts whole, and each of its groups has two categories.
    """
    per_group = table.groupBy("source", "group_key").agg(F.sum("cnt").alias("n"), F.count_distinct("category").alias("cats"), F.count("*").alias("rows"), F.bool_and(F.col("cnt") == F.floor("cnt")).alias("whole"))
    fine = per_group.groupBy("source").agg(F.min("cats").alias("least"), F.sum("rows").alias("all_rows"), F.bool_and("whole").alias("all_whole")).filter((F.col("least") >= 2) & (F.col("all_rows") >= least) & F.col("all_whole"))
    return per_group.join(fine, "source", "left_semi").select("source", "group_key", F.col("n").cast("long").alias("n"))


def group_stats(obs: DataFrame) -> DataFrame:
    """n, mean, sd (0 for a single value), sem and median of every group."""
    out = obs.groupBy("source", "group_key").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"), F.median("value").alias("median"))
    return out.withColumn("sem", F.try_divide(F.col("sd"), F.sqrt(F.col("n").cast("double"))))


def pairwise_tests(group: DataFrame) -> DataFrame:
    """Welch's and Student's t for every pair of a source's groups, from group_stats(); pairs stay within a source."""
    a = group.filter("n > 0").select("source", F.col("group_key").alias("group_a"), *(F.col(c).alias(f"{c}1") for c in ("n", "mean", "sd")))
    b = group.filter("n > 0").select("source", F.col("group_key").alias("group_b"), *(F.col(c).alias(f"{c}2") for c in ("n", "mean", "sd")))
    args = [F.col("n1"), F.col("mean1"), F.col("sd1") * F.col("sd1"), F.col("n2"), F.col("mean2"), F.col("sd2") * F.col("sd2")]
    (wt, wdf), (st, sdf) = stats.welch(*args), stats.student(*args)
    pairs = a.join(b, "source").filter("group_a < group_b")
    return pairs.select("source", "group_a", "group_b", wt.alias("welch_t"), wdf.alias("welch_df"), st.alias("student_t"), sdf.alias("student_df"))


def with_p_values(tests: DataFrame) -> DataFrame:
    return tests.withColumns({"welch_p": stats.t_p_value("welch_t", "welch_df"), "student_p": stats.t_p_value("student_t", F.col("student_df").cast("double"))})


def anova(obs: DataFrame) -> DataFrame:
    """One-way F per source with three groups at least: from group sizes and means and the sums of squares around them."""
    g = obs.groupBy("source", "group_key").agg(F.count("value").alias("n"), F.avg("value").alias("m"), (F.var_pop("value") * F.count("value")).alias("ss")).filter("n > 0")
    s = g.groupBy("source").agg(F.count("*").alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum("ss").alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("raw"))
    between = F.col("raw") - F.col("n") * F.col("grand") * F.col("grand")
    f = F.try_divide(between / (F.col("k") - 1), F.try_divide(F.col("within"), F.col("n") - F.col("k")))
    return s.filter("k >= 3").select("source", "k", "n", f.alias("f"), (F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2"))


def fingerprints(v: DataFrame, decimals: tuple[int, ...] = (6,)) -> DataFrame:
    """Hashes of the vectors at the given precisions: fp_<decimals>."""
    return v.select("source", "group_key", "n", *(arrays.value_hash(arrays.rounded(F.col("vals"), d), d).alias(f"fp_{d}") for d in decimals))


def printed_tolerance(stated: F.Column, text: F.Column) -> F.Column:
    """Half a unit of the last printed digit (6 decimals at most); a relative 1e-6 where none is printed."""
    digits = F.length(F.regexp_extract(text, r"\.([0-9]+)$", 1))
    return F.when((digits > 0) & (digits <= 6), F.lit(0.5) * F.pow(F.lit(10.0), -digits) * (1 + 1e-9)).otherwise(F.abs(stated) * 1e-6)


def check_means(v: DataFrame, stated: DataFrame) -> DataFrame:
    """status of each stated mean (source, group_key, stated, printed): ok, dropped_value (exactly one value left out explains it, n >= 4) or unexplained."""
    j = v.filter("n >= 3").join(stated, ["source", "group_key"])
    total = F.aggregate("vals", F.lit(0.0), lambda s, x: s + x)
    near = lambda x: F.abs(x - F.col("stated")) <= printed_tolerance(F.col("stated"), F.col("printed"))
    hits = lambda t: F.size(F.filter("vals", lambda x: near((t - x) / (F.col("n") - 1))))
    status = arrays.let(total, lambda t: F.when(near(t / F.col("n")), "ok").when((F.col("n") >= 4) & (hits(t) == 1), "dropped_value").otherwise("unexplained"))
    return j.select("source", "group_key", "n", "stated", status.alias("status"))


def check_sds(obs: DataFrame, stated: DataFrame) -> DataFrame:
    """kind of each stated SD: sample, population (divisor n), sem, sem_population or unexplained."""
    s = obs.groupBy("source", "group_key").agg(F.count("value").alias("n"), F.stddev_samp("value").alias("sd1"), F.stddev_pop("value").alias("sd0")).filter("n >= 3")
    j = s.join(stated, ["source", "group_key"])
    near = lambda x: F.abs(x - F.col("stated")) <= printed_tolerance(F.col("stated"), F.col("printed"))
    n = F.col("n").cast("double")
    kind = F.when(near(F.col("sd1")), "sample").when(near(F.col("sd0")), "population").when(near(F.col("sd1") / F.sqrt(n)), "sem").when(near(F.col("sd1") / F.sqrt(n - 1)), "sem_population").otherwise("unexplained")
    return j.select("source", "group_key", "n", "stated", kind.alias("kind"))


def derived_precision(obs: DataFrame) -> DataFrame:
    """Groups whose values look computed: of the values that are no whole numbers at least 3 and half are repeating fractions, or 3 and 80 % have excess digits.

    A value's digits are those of its shortest decimal notation.
    """
    text = F.regexp_extract(F.format_string("%.10f", F.abs(F.col("value"))), r"^[0-9]+\.([0-9]*?)0*$", 1)
    v = obs.filter("value IS NOT NULL").withColumn("digits", F.length(text))
    q = arrays.repeating_fraction(F.col("value"), F.pow(F.lit(10.0), -F.col("digits")))
    significant = F.length(F.regexp_replace(F.concat(F.floor(F.abs(F.col("value"))).cast("string"), text), "^0+", ""))
    v = v.withColumns({"repeats": F.coalesce((F.col("digits") >= 4) & q.isNotNull(), F.lit(False)), "excess": (F.col("digits") >= 5) & (significant >= 6)})
    g = v.groupBy("source", "group_key").agg(F.count("*").alias("n"), F.count_if("repeats").alias("n_repeating"), F.count_if("excess").alias("n_excess"), F.count_if(F.col("value") != F.floor("value")).alias("n_parts"))
    kind = F.when((F.col("n_repeating") >= 3) & (F.col("n_repeating") >= 0.5 * F.col("n_parts")), "repeating_fraction").when((F.col("n_excess") >= 3) & (F.col("n_excess") >= 0.8 * F.col("n_parts")), "excess_precision")
    return g.withColumn("kind", kind).drop("n_parts")


def total_n(stats: DataFrame) -> DataFrame:
    """(source, n): the values of all groups."""
    return stats.groupBy("source").agg(F.sum("n").alias("n"))


def stats_close(n1: F.Column, m1: F.Column, s1: F.Column, n2: F.Column, m2: F.Column, s2: F.Column, mean_eps: float = 1e-3, sd_eps: float = 1e-3, same_n: bool = True) -> F.Column:
    """Mean and SD within eps of each other, n equal if asked for."""
    near = (F.abs(m1 - m2) <= mean_eps) & (F.abs(s1 - s2) <= sd_eps)
    return F.coalesce(near & (n1 == n2) if same_n else near, F.lit(False))
