"""Vectors that share values.

Equal vectors are found by hash and told as classes: every member with the
class' smallest (source, group) and its number of links, so a class of any size
gives one row per member. Pairs are made between different vectors only (one
stands for its equals), and only where an index brings them together: rarest
values for sets, scale-free bands for multiples. Tables that join their own
aggregate are stored first, so that adaptive execution can split a hot key. Spark
takes a stored table for as large as its file, though values that repeat are some
hundred times that in memory, so these joins are never broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import arrays
from plumbline.operators.storage import stored as _stored
from plumbline.operators.vectors import vectors

# What marks a group as a control.
CONTROLS = ("ctrl", "control", "cont", "wt", "wild", "vehicle", "mock", "sham", "baseline", "parent", "untreated")


def stored(df: DataFrame, what: str) -> DataFrame:
    """df stored, for sort-merge joins only."""
    return _stored(df, what).hint("merge")


def control_like(group: F.Column) -> F.Column:
    low = F.lower(group)
    return F.exists(F.array(*map(F.lit, CONTROLS)), lambda c: F.contains(low, c))


def _hashed(v: DataFrame, least: int, decimals: int) -> DataFrame:
    vals = arrays.rounded(F.col("vals"), decimals)
    return v.filter(F.col("n") >= least).select("source", "group_key", "n", arrays.value_hash(vals, decimals).alias("fp"))


def equal_across_sources(v: DataFrame, least: int = 3, decimals: int = 6) -> DataFrame:
    """(source, group_key, class_source, class_group, n_links): vectors of `least` values that another source holds as well.

    n_links counts the equal vectors of other sources. Class minima and counts
    aggregate map-side; members meet their class from a stored table.
    """
    hashed = stored(_hashed(v, least, decimals), "hashed")
    per_source = hashed.groupBy("fp", "n", "source").agg(F.count("*").alias("own"), F.min(F.struct("source", "group_key")).alias("first"))
    per_source = stored(per_source, "per-source")
    classes = per_source.groupBy("fp", "n").agg(F.sum("own").alias("total"), F.min("first").alias("first"), F.count("*").alias("sources")).filter("sources > 1")
    classes = stored(classes, "classes")
    joined = hashed.join(classes, ["fp", "n"]).join(per_source.select("fp", "n", "source", "own"), ["fp", "n", "source"])
    return joined.select("source", "group_key", "n", F.col("first.source").alias("class_source"), F.col("first.group_key").alias("class_group"), (F.col("total") - F.col("own")).alias("n_links"))


def duplicates_within_source(v: DataFrame, least: int = 4, decimals: int = 6) -> DataFrame:
    """(source, group_key, class_group, n, n_links): groups of a source whose vector others of it hold as well.

    n_links counts the others, without those of which both look like controls;
    groups without such a link are left out.
    """
    hashed = stored(_hashed(v, least, decimals).withColumn("control", control_like(F.col("group_key"))), "hashed")
    classes = hashed.groupBy("source", "fp", "n").agg(F.count("*").alias("total"), F.sum(F.col("control").cast("int")).alias("controls"), F.min("group_key").alias("class_group")).filter("total > 1")
    joined = hashed.join(stored(classes, "classes"), ["source", "fp", "n"])
    links = F.col("total") - F.when(F.col("control"), F.col("controls")).otherwise(1)
    return joined.withColumn("n_links", links).filter("n_links > 0").select("source", "group_key", "class_group", "n", "n_links")


def distinct_vectors(v: DataFrame, least: int, decimals: int = 6) -> DataFrame:
    """(source, group_key, vals, members): each different vector of a source once, under its smallest group."""
    vals = v.filter(F.col("n") >= least).withColumn("vals", arrays.rounded(F.col("vals"), decimals))
    return vals.groupBy("source", "vals").agg(F.min("group_key").alias("group_key"), F.count("*").alias("members")).select("source", "group_key", "vals", "members")


def ratios_within_source(v: DataFrame, least: int = 4) -> DataFrame:
    """(source, group_a, group_b, k, n): different vectors of a source of which one is k times the other, rank by rank.

    Multiples agree in what does not depend on scale: the number of zeros, the
    first and the last value over the sum of sizes. They meet in bands of these; a
    vector near the edge of its band, by more than integer_ratio's tolerance moves
    it, stands in the next band too.
    """
    size = F.aggregate("vals", F.lit(0.0), lambda s, x: s + F.abs(x))
    other = F.filter("vals", lambda x: x != 0)
    place = lambda x: x / F.col("size") * 1e4
    each = distinct_vectors(v, least).withColumn("size", size).filter("size > 0").withColumn("other", other)
    each = each.select("source", "group_key", "vals", F.size("vals").alias("n"), F.size("other").alias("nonzero"), place(F.element_at("other", 1)).alias("first"), place(F.element_at("other", -1)).alias("last"))
    each = stored(each, "vectors")
    near = lambda c: F.explode(F.array_distinct(F.array(*(F.floor(F.col(c) + i) for i in (-0.03, 0.03)))))
    a = each.select("source", F.col("group_key").alias("group_a"), F.col("vals").alias("a"), "n", "nonzero", "first", "last").withColumn("first", near("first")).withColumn("last", near("last"))
    b = each.select("source", F.col("group_key").alias("group_b"), F.col("vals").alias("b"), "n", "nonzero", F.floor("first").alias("first"), F.floor("last").alias("last"))
    met = a.join(b, ["source", "n", "nonzero", "first", "last"]).filter("group_a < group_b")
    k = arrays.integer_ratio(F.col("a"), F.col("b"))
    return met.select("source", "group_a", "group_b", k.alias("k"), F.col("n").cast("long").alias("n")).filter("k IS NOT NULL")


def overlapping(items: DataFrame, share: float) -> DataFrame:
    """(scope, id_a, id_b, common, n_a, n_b): items (scope, id, tokens: an array without repetition) that have `share` of the smaller one's tokens in common.

    Of two such items the smaller one's rarest tokens - all but as many as `share`
    of them, and one more - hold one of the other's. So items meet by these few
    tokens only, never by the common ones. a is the smaller item, then the smaller id.
    """
    each = stored(items.filter(F.size("tokens") > 0).select("scope", "id", "tokens", F.size("tokens").alias("n")), "items")
    places = each.select("scope", "id", "n", F.explode("tokens").alias("token"))
    seen = stored(places.groupBy("scope", "token").agg(F.count("*").alias("df")), "tokens")
    ordered = places.join(seen, ["scope", "token"]).groupBy("scope", "id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("o"), F.first("n").alias("n"))
    rare = ordered.select("scope", F.col("id").alias("id_a"), F.col("n").alias("n_a"), F.explode(F.slice("o", F.lit(1), F.col("n") - F.ceil(F.col("n") * share - 1e-9).cast("int") + 1)).alias("e"))
    a = rare.select("scope", "id_a", "n_a", F.col("e.token").alias("token"))
    b = places.select("scope", F.col("id").alias("id_b"), F.col("n").alias("n_b"), "token")
    met = a.join(b, ["scope", "token"]).filter("n_a < n_b OR n_a = n_b AND id_a < id_b").select("scope", "id_a", "id_b", "n_a", "n_b").distinct()
    ta, tb = each.select("scope", F.col("id").alias("id_a"), F.col("tokens").alias("ta")), each.select("scope", F.col("id").alias("id_b"), F.col("tokens").alias("tb"))
    both = met.join(ta, ["scope", "id_a"]).join(tb, ["scope", "id_b"]).withColumn("common", F.size(F.array_intersect("ta", "tb")))
    return both.filter(F.col("common") >= F.col("n_a") * share - 1e-9).select("scope", "id_a", "id_b", "common", "n_a", "n_b")


def shares_within_source(v: DataFrame, least: int = 3) -> DataFrame:
    """(source, group_a, group_b, kind): different vectors of a source that share values, and how (endpoint_dropout, subset, high_jaccard).

    In each kind one vector's different values lie in the other, all or 0.95 of
    them, so they meet by rarest values. Equal vectors are told by duplicates_within_source.
    """
    each = stored(distinct_vectors(v, least), "vectors")
    met = overlapping(each.select(F.col("source").alias("scope"), F.col("group_key").alias("id"), F.array_distinct("vals").alias("tokens")), 0.95)
    pairs = met.select(F.col("scope").alias("source"), F.least("id_a", "id_b").alias("group_a"), F.greatest("id_a", "id_b").alias("group_b"))
    a = each.select("source", F.col("group_key").alias("group_a"), F.col("vals").alias("a"))
    b = each.select("source", F.col("group_key").alias("group_b"), F.col("vals").alias("b"))
    out = pairs.join(a, ["source", "group_a"]).join(b, ["source", "group_b"])
    return out.select("source", "group_a", "group_b", arrays.share_kind(F.col("a"), F.col("b")).alias("kind")).filter("kind IS NOT NULL")


def multiset_overlaps(v: DataFrame, share: float = 0.5) -> DataFrame:
    """(source, group_a, group_b, hits): vectors of a source that have `share` of the shorter one's values in common, repetitions counted.

    A vector is its different values with their counts. As in overlapping(), the
    smaller one's rarest values, with all but as many repetitions as `share` and
    one more, hold one of the other's; hits are summed value by value.
    """
    each = v.select(F.col("source").alias("scope"), F.col("group_key").alias("id"), F.col("n"), F.explode("vals").alias("value"))
    each = stored(each.groupBy("scope", "id", "n", "value").agg(F.count("*").alias("k")), "counts")
    seen = stored(each.groupBy("scope", "value").agg(F.count("*").alias("df")), "values")
    by_rarity = Window.partitionBy("scope", "id").orderBy("df", "value").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("k").over(by_rarity), F.lit(0))
    rare = each.join(seen, ["scope", "value"]).withColumn("before", before).filter(F.col("before") <= F.col("n") - F.ceil(F.col("n") * share - 1e-9))
    a, b = (d.select("scope", "value", F.col("id").alias(f"id_{x}"), F.col("n").alias(f"n_{x}")) for d, x in ((rare, "a"), (each, "b")))
    met = a.join(b, ["scope", "value"]).filter("n_a < n_b OR n_a = n_b AND id_a < id_b").select("scope", "id_a", "id_b", "n_a").distinct()
    ka, kb = (each.select("scope", "value", F.col("id").alias(f"id_{x}"), F.col("k").alias(f"k_{x}")) for x in "ab")
    hits = met.join(ka, ["scope", "id_a"]).join(kb, ["scope", "id_b", "value"]).groupBy("scope", "id_a", "id_b", "n_a").agg(F.sum(F.least("k_a", "k_b")).alias("hits"))
    return hits.filter(F.col("hits") >= F.col("n_a") * share - 1e-9).select(F.col("scope").alias("source"), F.least("id_a", "id_b").alias("group_a"), F.greatest("id_a", "id_b").alias("group_b"), "hits")


def value_sets(obs: DataFrame, least: int = 5) -> DataFrame:
    """(source, group_key, vals, set_id): the different values of every vector; equal sets have one id."""
    sets = vectors(obs).select("source", "group_key", F.array_sort(F.array_distinct("vals")).alias("vals")).filter(F.size("vals") >= least)
    return sets.withColumn("set_id", arrays.value_hash(F.col("vals")))


def set_members(obs: DataFrame, least: int = 5) -> DataFrame:
    """Vectors with equal sets are one class (source, group_key, set_id, n_set)."""
    return value_sets(obs, least).select("source", "group_key", "set_id", F.size("vals").cast("long").alias("n_set"))


def similar_sets(obs: DataFrame, threshold: float = 0.95, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of value sets under a Jaccard threshold. members: see set_members(). Pairs: set_a, set_b, jaccard.

    A set of m values has at most `most` values that only it or the other one
    holds. Values that more than half of the sets hold are turned round, so that a
    set is told by what it has beyond them and what it lacks of them (`odd`); what
    sets differ by stays the same, and dense sets become short. Short sets meet in
    what is left of them when as many values are taken away as they may differ by:
    no other sets do. Longer ones meet all others by the most + 1 rarest of their
    odd values, and are compared.
    """
    distinct = stored(value_sets(obs, least).select("set_id", "vals", F.size("vals").alias("m")).dropDuplicates(["set_id"]), "sets")
    seen = stored(distinct.select(F.explode("vals").alias("x")).groupBy("x").agg(F.count("*").alias("df")), "values")
    total = distinct.agg(F.count("*").alias("total"))
    # At most twice as many as an average set has.
    frequent = seen.crossJoin(F.broadcast(total)).filter("2 * df > total").agg(F.collect_list("x").alias("frequent"))
    most = F.floor((F.col("m") + F.floor(F.col("m") / threshold + 1e-9)) * (1 - threshold) / (1 + threshold) + 1e-9).cast("int")
    each = distinct.crossJoin(F.broadcast(frequent)).select("set_id", "m", "vals", most.alias("most"), F.array_sort(F.concat(F.array_except("vals", "frequent"), F.array_except("frequent", "vals"))).alias("odd"))
    each = stored(each.withColumn("short", (F.size("odd") <= 8) & (F.col("most") <= 3)), "odd")

    left = [F.array("odd")]
    for _ in range(3):
        left.append(F.array_distinct(F.flatten(F.transform(left[-1], lambda o: F.transform(o, lambda x: F.array_remove(o, x))))))
    told = lambda i: lambda core: F.struct(F.lit(i).alias("i"), core.alias("core"))
    kept = F.explode(F.concat(*(F.when(F.col("most") >= i, F.transform(o, told(i))).otherwise(F.array().cast("array<struct<i:int,core:array<double>>>")) for i, o in enumerate(left))))
    cores = each.filter("short").select("set_id", "m", "most", kept.alias("k")).select("set_id", "m", "most", "k.i", "k.core")
    # a has lost i values and b j of them, i at most j.
    a = cores.select("core", "i", F.explode(F.when(2 * F.col("i") <= F.col("most"), F.sequence("i", F.col("most") - F.col("i")))).alias("j"), F.col("set_id").alias("set_a"), F.col("m").alias("ma"))
    b = cores.select("core", F.col("i").alias("j"), F.explode(F.sequence(F.lit(0), F.least("i", F.col("most") - F.col("i")))).alias("i"), F.col("set_id").alias("set_b"), F.col("m").alias("mb"))
    met = a.join(b, ["core", "i", "j"]).filter("set_a <> set_b")
    ends = (F.least("set_a", "set_b").alias("set_a"), F.greatest("set_a", "set_b").alias("set_b"))
    apart = met.select(*ends, (F.col("ma") + F.col("mb")).alias("both"), (F.col("i") + F.col("j")).alias("apart")).groupBy("set_a", "set_b", "both").agg(F.min("apart").alias("apart"))
    near = apart.select("set_a", "set_b", ((F.col("both") - F.col("apart")) / (F.col("both") + F.col("apart"))).alias("jaccard"))

    places = each.select("set_id", "m", "most", "short", F.size("odd").alias("n_odd"), F.explode("odd").alias("x")).join(seen.crossJoin(F.broadcast(total)).select("x", F.least("df", F.col("total") - F.col("df")).alias("df")), "x")
    rank = F.row_number().over(Window.partitionBy("set_id").orderBy("df", "x"))
    index = places.withColumn("rank", rank).filter("rank <= most + 1").select("set_id", "m", "short", "x")
    index = index.unionByName(each.filter(F.size("odd") <= F.col("most")).select("set_id", "m", "short", F.lit(None).cast("double").alias("x")))
    la, lb = index.filter("NOT short").select("x", F.col("set_id").alias("set_a"), F.col("m").alias("ma")), index.select("x", F.col("set_id").alias("set_b"), F.col("m").alias("mb"), "short")
    long = la.join(lb, la["x"].eqNullSafe(lb["x"])).filter((F.col("short") | (F.col("set_a") < F.col("set_b"))) & (F.least("ma", "mb") >= threshold * F.greatest("ma", "mb"))).select(*ends).distinct()
    va, vb = (each.select(F.col("set_id").alias(f"set_{x}"), F.col("vals").alias(f"v{x}")) for x in "ab")
    compared = long.join(va, "set_a").join(vb, "set_b").select("set_a", "set_b", arrays.jaccard(F.col("va"), F.col("vb")).alias("jaccard"))
    return set_members(obs, least), near.unionByName(compared).filter(F.col("jaccard") >= threshold)


def profile_matches(claims: DataFrame, files: DataFrame) -> DataFrame:
    """Statements' lists of n against files' lists of group sizes, as multisets.

    claims: (claim_id, n), files: (file_id, n), one number a row. A file matches
    with all numbers of a statement or all but one (of three at least); a statement with a
    rival of as many hits is left out.
    """
    c = claims.groupBy("claim_id", "n").agg(F.count("*").alias("c1"))
    f = files.groupBy("file_id", "n").agg(F.count("*").alias("c2"))
    k = claims.groupBy("claim_id").agg(F.count("*").alias("k"))
    hits = c.join(f, "n").groupBy("claim_id", "file_id").agg(F.sum(F.least("c1", "c2")).alias("hits")).join(k, "claim_id")
    fine = hits.filter((F.col("hits") == F.col("k")) | ((F.col("k") >= 3) & (F.col("hits") == F.col("k") - 1)))
    best = fine.groupBy("claim_id").agg(F.max("hits").alias("hits"))
    top = fine.join(best, ["claim_id", "hits"])
    return top.groupBy("claim_id", "hits", "k").agg(F.min("file_id").alias("file_id"), F.count("*").alias("rivals")).filter("rivals = 1").drop("rivals")
