"""Vectors, statistics and value sharing over line items, parts and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import arrays
from plumbline.operators import nearest, pairs, vectors
from plumbline.plans.registry import query, table


def obs(spark: SparkSession, d: str, name: str, source: str, group: str, value: str) -> DataFrame:
    """A table as measurements."""
    return table(spark, d, name).selectExpr(f"cast({source} as string) AS source", f"cast({group} as string) AS group_key", f"cast({value} as double) AS value")


def quantities(spark: SparkSession, d: str) -> DataFrame:
    return obs(spark, d, "lineitem", "l_suppkey", "l_returnflag", "l_quantity")


def line_numbers(spark: SparkSession, d: str) -> DataFrame:
    return obs(spark, d, "lineitem", "l_orderkey", "l_linestatus", "l_linenumber")


def discounts(spark: SparkSession, d: str) -> DataFrame:
    return obs(spark, d, "lineitem", "l_partkey", "concat(l_returnflag, l_linestatus)", "l_discount")


def balances(spark: SparkSession, d: str) -> DataFrame:
    return obs(spark, d, "customer", "c_nationkey", "c_mktsegment", "c_acctbal")


def sizes(spark: SparkSession, d: str) -> DataFrame:
    return obs(spark, d, "part", "p_brand", "p_type", "p_size")


OBS_Q = "SELECT CAST(l_suppkey AS VARCHAR) AS source, l_returnflag AS group_key, CAST(l_quantity AS DOUBLE) AS value FROM lineitem"
OBS_L = "SELECT CAST(l_orderkey AS VARCHAR) AS source, l_linestatus AS group_key, CAST(l_linenumber AS DOUBLE) AS value FROM lineitem"
OBS_D = "SELECT CAST(l_partkey AS VARCHAR) AS source, concat(l_returnflag, l_linestatus) AS group_key, CAST(l_discount AS DOUBLE) AS value FROM lineitem"
OBS_B = "SELECT CAST(c_nationkey AS VARCHAR) AS source, c_mktsegment AS group_key, CAST(c_acctbal AS DOUBLE) AS value FROM customer"
OBS_S = "SELECT p_brand AS source, p_type AS group_key, CAST(p_size AS DOUBLE) AS value FROM part"
STATS = "SELECT source, group_key, count(value) AS n, avg(value) AS mean, coalesce(stddev_samp(value), 0.0) AS sd, median(value) AS med FROM ({obs}) GROUP BY source, group_key"
VECTORS = "SELECT source, group_key, list_sort(list(value)) AS vals, count(*) AS n FROM ({obs}) GROUP BY source, group_key"
FP = "substr(sha256(array_to_string(list_transform(vals, lambda x: printf('%.{d}f', x)), ',')), 1, 16)"


@query(f"SELECT source, group_key, n, round(mean, 4) AS mean, round(sd, 4) AS sd, round(sd / sqrt(n), 4) AS sem, round(med, 4) AS median FROM ({STATS.format(obs=OBS_Q)})")
def group_stats(spark, d):
    s = vectors.group_stats(quantities(spark, d))
    return s.select("source", "group_key", "n", *(F.round(c, 4).alias(c) for c in ("mean", "sd", "sem", "median")))


@query(f"""WITH g AS ({STATS.format(obs=OBS_Q)}),
  p AS (SELECT a.source, a.group_key AS group_a, b.group_key AS group_b, a.n AS n1, a.mean AS m1, a.sd * a.sd AS v1, b.n AS n2, b.mean AS m2, b.sd * b.sd AS v2
        FROM g a JOIN g b ON a.source = b.source AND a.group_key < b.group_key)
  SELECT source, group_a, group_b, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 4) AS welch_t,
         round((v1 / n1 + v2 / n2) ** 2 / (v1 * v1 / n1 / n1 / greatest(n1 - 1, 1) + v2 * v2 / n2 / n2 / greatest(n2 - 1, 1)), 4) AS welch_df,
         round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 4) AS student_t, n1 + n2 - 2 AS student_df FROM p""")
def pairwise_tests(spark, d):
    t = vectors.pairwise_tests(vectors.group_stats(quantities(spark, d)))
    return t.select("source", "group_a", "group_b", *(F.round(c, 4).alias(c) for c in ("welch_t", "welch_df", "student_t")), "student_df")


@query()
def pairwise_p_values(spark, d):
    t = vectors.with_p_values(vectors.pairwise_tests(vectors.group_stats(quantities(spark, d))))
    return t.select("source", "group_a", "group_b", F.round("welch_p", 6).alias("welch_p"), F.round("student_p", 6).alias("student_p"))


@query(f"""WITH g AS (SELECT source, group_key, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS ss FROM ({OBS_B}) GROUP BY source, group_key),
  s AS (SELECT source, count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(n * m) / sum(n) AS grand, sum(ss) AS w, sum(n * m * m) AS r FROM g GROUP BY source)
  SELECT source, k, n, round(((r - n * grand * grand) / (k - 1)) / (w / (n - k)), 4) AS f, k - 1 AS df1, n - k AS df2 FROM s WHERE k >= 3""")
def anova(spark, d):
    return vectors.anova(balances(spark, d)).withColumn("f", F.round("f", 4))


@query(f"SELECT source, group_key, n, {FP.format(d=6)} AS fp_6, {FP.format(d=2)} AS fp_2 FROM ({VECTORS.format(obs=OBS_S)})")
def fingerprints(spark, d):
    return vectors.fingerprints(vectors.vectors(sizes(spark, d)), (6, 2))


_EXACT = f"""WITH v AS (SELECT source, group_key, n, {FP.format(d=6)} AS fp FROM ({VECTORS.format(obs="{obs}")}) WHERE n >= {{n}}),
  o AS (SELECT fp, n, source, count(*) AS own, min(group_key) AS g FROM v GROUP BY fp, n, source),
  c AS (SELECT fp, n, sum(own) AS total, min({{{{'s': source, 'g': g}}}}) AS f FROM o GROUP BY fp, n HAVING count(*) > 1)
  SELECT v.source, v.group_key, v.n, c.f.s AS class_source, c.f.g AS class_group, CAST(c.total - o.own AS BIGINT) AS n_links FROM v JOIN o USING (fp, n, source) JOIN c USING (fp, n)"""


@query(_EXACT.format(obs=OBS_D, n=3).replace("{{", "{").replace("}}", "}"))
def exact_across_sources(spark, d):
    return pairs.equal_across_sources(vectors.vectors(discounts(spark, d)), 3)


@query(f"""WITH v AS ({VECTORS.format(obs=OBS_L)}), c AS (SELECT source, vals, count(*) AS total, min(group_key) AS class_group FROM v WHERE n >= 2 GROUP BY source, vals HAVING count(*) > 1)
  SELECT v.source, v.group_key, c.class_group, v.n, CAST(c.total - 1 AS BIGINT) AS n_links FROM v JOIN c ON v.source = c.source AND v.vals = c.vals""")
def duplicates_within_source(spark, d):
    """min_n is 2: at the default of 4 the driver's tables hold no pair."""
    return pairs.duplicates_within_source(vectors.vectors(line_numbers(spark, d)), 2)


_REPS = f"""v AS (SELECT source, vals, n, min(group_key) AS group_key FROM ({VECTORS.format(obs="{obs}")}) GROUP BY source, vals, n)"""


@query(f"""WITH {_REPS.format(obs=OBS_L)},
  p AS (SELECT a.source, a.group_key AS group_a, b.group_key AS group_b, a.n, CASE WHEN list_sum(a.vals) <= list_sum(b.vals) THEN a.vals ELSE b.vals END AS x,
        CASE WHEN list_sum(a.vals) <= list_sum(b.vals) THEN b.vals ELSE a.vals END AS y
        FROM v a JOIN v b ON a.source = b.source AND a.group_key < b.group_key AND a.n = b.n AND a.vals <> b.vals WHERE a.n >= 2),
  r AS (SELECT *, list_sort(list_transform(list_zip(x, y), lambda q: q[2] / q[1])) AS ratios FROM p),
  k AS (SELECT *, ratios[CAST(floor(len(ratios) / 2) AS INT) + 1] AS mid FROM r)
  SELECT source, group_a, group_b, CAST(round(mid) AS BIGINT) AS k, n FROM k
  WHERE mid >= 1.5 AND round(mid) BETWEEN 2 AND 100 AND len(list_filter(ratios, lambda q: abs(q - round(mid)) > 1e-6 * round(mid))) = 0""")
def ratios_within_source(spark, d):
    return pairs.ratios_within_source(vectors.vectors(line_numbers(spark, d)), 2)


@query(f"""WITH {_REPS.format(obs=OBS_Q)},
  p AS (SELECT a.source, a.group_key AS group_a, b.group_key AS group_b, a.vals AS a, b.vals AS b, CASE WHEN a.n < b.n THEN a.vals ELSE b.vals END AS s, CASE WHEN a.n < b.n THEN b.vals ELSE a.vals END AS l
        FROM v a JOIN v b ON a.source = b.source AND a.group_key < b.group_key WHERE a.n >= 3 AND b.n >= 3),
  q AS (SELECT *, len(list_filter(range(0, len(l) - len(s) + 1), lambda i: l[i + 1 : i + len(s)] = s)) > 0 AS slice,
        len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 OR len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS sub, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS jac FROM p)
  SELECT source, group_a, group_b, CASE WHEN len(a) <> len(b) AND slice THEN 'endpoint_dropout' WHEN len(s) >= 4 AND sub THEN 'subset' ELSE 'high_jaccard' END AS kind FROM q
  WHERE (len(a) <> len(b) AND slice) OR (len(s) >= 4 AND sub) OR (len(s) >= 5 AND jac >= 0.95)""")
def shares_within_source(spark, d):
    return pairs.shares_within_source(vectors.vectors(quantities(spark, d)), 3)


_SETS = f"""s AS (SELECT source, group_key, list_sort(list_distinct(vals)) AS vals FROM ({VECTORS.format(obs=OBS_Q)}) WHERE len(list_distinct(vals)) >= 5),
  h AS (SELECT source, group_key, vals, {FP.format(d=6)} AS set_id FROM s), u AS (SELECT set_id, any_value(vals) AS vals FROM h GROUP BY set_id)"""


@query(f"WITH {_SETS} SELECT source, group_key, set_id, len(vals) AS n_set FROM h")
def value_sets(spark, d):
    return pairs.set_members(quantities(spark, d))


@query(f"""WITH {_SETS}, p AS (SELECT a.set_id AS set_a, b.set_id AS set_b, len(list_intersect(a.vals, b.vals)) / len(list_distinct(list_concat(a.vals, b.vals))) AS jaccard FROM u a JOIN u b ON a.set_id < b.set_id)
  SELECT set_a, set_b, round(jaccard, 6) AS jaccard FROM p WHERE jaccard >= 0.95""")
def similar_set_pairs(spark, d):
    return pairs.similar_sets(quantities(spark, d))[1].withColumn("jaccard", F.round("jaccard", 6))


@query(f"""WITH c AS (SELECT CAST(c_nationkey AS VARCHAR) AS claim_id, count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment),
  f AS (SELECT p_brand AS file_id, count(*) AS n FROM part GROUP BY p_brand, p_type),
  cc AS (SELECT claim_id, n, count(*) AS c1 FROM c GROUP BY claim_id, n), ff AS (SELECT file_id, n, count(*) AS c2 FROM f GROUP BY file_id, n),
  k AS (SELECT claim_id, count(*) AS k FROM c GROUP BY claim_id),
  h AS (SELECT claim_id, file_id, CAST(sum(least(c1, c2)) AS BIGINT) AS hits FROM cc JOIN ff USING (n) GROUP BY claim_id, file_id),
  g AS (SELECT * FROM h JOIN k USING (claim_id) WHERE hits = k OR (k >= 3 AND hits = k - 1)),
  t AS (SELECT * FROM g WHERE hits = (SELECT max(hits) FROM g x WHERE x.claim_id = g.claim_id))
  SELECT claim_id, hits, k, min(file_id) AS file_id FROM t GROUP BY claim_id, hits, k HAVING count(*) = 1""")
def n_profiles(spark, d):
    claims = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("string").alias("claim_id"), "c_mktsegment").agg(F.count("*").alias("n")).select("claim_id", "n")
    files = table(spark, d, "part").groupBy(F.col("p_brand").alias("file_id"), "p_type").agg(F.count("*").alias("n")).select("file_id", "n")
    return pairs.profile_matches(claims, files)


@query(f"""WITH g AS (SELECT source, group_key, count(*) AS n, sum(CAST(value AS DECIMAL(18, 2))) AS total, max(CAST(value AS DECIMAL(18, 2))) AS top, list(CAST(value AS DECIMAL(18, 2))) AS vals FROM ({OBS_B}) GROUP BY source, group_key HAVING count(*) >= 3),
  s AS (SELECT *, round(CAST((total - top) AS DOUBLE) / (n - 1) + 1e-7, 2) AS stated FROM g),
  h AS (SELECT *, abs(CAST(total AS DOUBLE) / n - stated) <= 0.005000000005 AS ok, len(list_filter(vals, lambda x: abs(CAST(total - x AS DOUBLE) / (n - 1) - stated) <= 0.005000000005)) AS hits FROM s)
  SELECT source, group_key, n, stated, CASE WHEN ok THEN 'ok' WHEN n >= 4 AND hits = 1 THEN 'dropped_value' ELSE 'unexplained' END AS status FROM h""")
def stated_means(spark, d):
    """The stated means leave each group's largest value out, as two printed decimals."""
    o = balances(spark, d)
    g = o.groupBy("source", "group_key").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"), F.max(F.col("value").cast("decimal(18,2)")).alias("top")).filter("n >= 3")
    stated = F.round((F.col("total") - F.col("top")).cast("double") / (F.col("n") - 1) + 1e-7, 2)
    return vectors.check_means(vectors.vectors(o), g.select("source", "group_key", stated.alias("stated"), F.format_string("%.2f", stated).alias("printed")))


@query(f"""WITH g AS (SELECT source, group_key, count(*) AS n, stddev_samp(value) AS s1, stddev_pop(value) AS s0 FROM ({OBS_B}) GROUP BY source, group_key HAVING count(*) >= 3),
  s AS (SELECT *, round(s0, 2) AS stated FROM g)
  SELECT source, group_key, n, stated, CASE WHEN abs(s1 - stated) <= 0.005000000005 THEN 'sample' WHEN abs(s0 - stated) <= 0.005000000005 THEN 'population' ELSE 'other' END AS kind FROM s""")
def stated_sds(spark, d):
    """The stated SDs are those of a population."""
    o = balances(spark, d)
    s0 = o.groupBy("source", "group_key").agg(F.round(F.stddev_pop("value"), 2).alias("stated")).filter("stated IS NOT NULL")
    return vectors.check_sds(o, s0.withColumn("printed", F.format_string("%.2f", F.col("stated"))))


@query(f"""WITH t AS (SELECT c_mktsegment AS source, CAST(c_nationkey AS VARCHAR) AS group_key, CAST(c_custkey AS VARCHAR) AS category, CAST(c_acctbal AS DOUBLE) AS cnt FROM customer),
  u AS (SELECT 'orders' AS source, o_orderstatus AS group_key, o_orderpriority AS category, count(*) AS cnt FROM orders GROUP BY ALL)
  SELECT source, group_key, CAST(sum(cnt) AS BIGINT) AS n FROM u GROUP BY source, group_key""")
def contingency_counts(spark, d):
    cells = table(spark, d, "orders").groupBy(F.lit("orders").alias("source"), F.col("o_orderstatus").alias("group_key"), F.col("o_orderpriority").alias("category")).agg(F.count("*").alias("cnt"))
    reals = table(spark, d, "customer").selectExpr("c_mktsegment AS source", "cast(c_nationkey as string) AS group_key", "cast(c_custkey as string) AS category", "c_acctbal AS cnt")
    return vectors.count_vectors(cells.select("source", "group_key", "category", F.col("cnt").cast("double").alias("cnt")).union(reals))


@query(f"""WITH v AS (SELECT source, group_key, value, regexp_extract(printf('%.10f', abs(value)), '^[0-9]+\\.([0-9]*?)0*$', 1) AS t FROM (SELECT CAST(l_suppkey AS VARCHAR) AS source, l_returnflag AS group_key, l_quantity / 7 AS value FROM lineitem)),
  w AS (SELECT source, group_key, length(t) AS digits, length(regexp_replace(concat(CAST(CAST(floor(abs(value)) AS BIGINT) AS VARCHAR), t), '^0+', '')) AS sig FROM v)
  SELECT source, group_key, count(*) AS n, count(*) FILTER (digits >= 5 AND sig >= 6) AS n_excess FROM w GROUP BY source, group_key""")
def excess_digits(spark, d):
    o = obs(spark, d, "lineitem", "l_suppkey", "l_returnflag", "l_quantity / 7")
    return vectors.derived_precision(o).select("source", "group_key", "n", "n_excess")


@query()
def repeating_fractions(spark, d):
    """Quantities over 7, printed with four decimals."""
    return vectors.derived_precision(obs(spark, d, "lineitem", "l_suppkey", "l_returnflag", "round(l_quantity / 7, 4)"))


@query(f"""WITH g AS (SELECT source, group_key, avg(value) AS y FROM ({OBS_B}) GROUP BY source, group_key),
  c AS (SELECT CAST(n_nationkey AS VARCHAR) AS source, CAST(n_nationkey AS VARCHAR) || '/' || q AS claim_id, CAST(q * 1000 + n_nationkey AS DOUBLE) AS x FROM nation CROSS JOIN (VALUES (1), (3), (5), (8)) t(q)),
  j AS (SELECT source, claim_id, x, group_key, y, abs(x - y) AS gap, row_number() OVER (PARTITION BY source, claim_id ORDER BY abs(x - y), y, group_key) AS rn FROM c JOIN g USING (source))
  SELECT source, claim_id, x, group_key, round(y, 4) AS y, round(gap, 4) AS gap FROM j WHERE rn = 1 AND gap > greatest(0.15, 0.08 * abs(y)) AND gap >= 0.12 * greatest(abs(x), abs(y))""")
def claimed_means(spark, d):
    claims = table(spark, d, "nation").crossJoin(F.broadcast(spark.createDataFrame([(1,), (3,), (5,), (8,)], "q int")))
    claims = claims.selectExpr("cast(n_nationkey as string) AS source", "concat(n_nationkey, '/', q) AS claim_id", "cast(q * 1000 + n_nationkey as double) AS x")
    stats = vectors.group_stats(balances(spark, d)).withColumn("n", F.lit(2))
    return nearest.mean_conflicts(claims, stats).select("source", "claim_id", "x", "group_key", F.round("y", 4).alias("y"), F.round("gap", 4).alias("gap"))


@query(f"""WITH g AS ({STATS.format(obs=OBS_B)}), c AS (SELECT source, group_key AS claim_id, round(mean, 1) AS x, round(sd, 1) AS err FROM g WHERE n >= 2),
  j AS (SELECT c.source, c.claim_id, g.group_key, c.x, c.err, g.mean, g.sd, g.sd / sqrt(g.n) AS sem, row_number() OVER (PARTITION BY c.source, c.claim_id ORDER BY abs(c.x - g.mean), g.mean, g.group_key) AS rn FROM c JOIN g ON c.source = g.source WHERE g.n >= 2)
  SELECT source, claim_id, group_key, x, err, 'sem' AS kind, 'sd' AS is_kind FROM j WHERE rn = 1 AND abs(x - mean) <= greatest(0.25, 0.15 * abs(mean)) AND abs(err - sd) <= greatest(0.05, 0.08 * sd) AND NOT abs(err - sem) <= greatest(0.05, 0.08 * sem)""")
def error_bar_swaps(spark, d):
    """Every group's mean with its SD, claimed as SEM."""
    stats = vectors.group_stats(balances(spark, d))
    claims = stats.filter("n >= 2").select("source", F.col("group_key").alias("claim_id"), F.round("mean", 1).alias("x"), F.round("sd", 1).alias("err"), F.lit("sem").alias("kind"))
    return nearest.error_bar_swaps(claims, stats)


@query("""SELECT c_nationkey AS nation, c_custkey AS id_a, s_suppkey AS id_b, CAST(c_acctbal AS DOUBLE) AS x, CAST(s_acctbal AS DOUBLE) AS y
  FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE abs(c_acctbal - s_acctbal) <= 5.0""")
def balance_bands(spark, d):
    a = table(spark, d, "customer").selectExpr("c_nationkey AS nation", "c_custkey AS id_a", "cast(c_acctbal as double) AS x")
    b = table(spark, d, "supplier").selectExpr("s_nationkey AS nation", "s_suppkey AS id_b", "cast(s_acctbal as double) AS y")
    return nearest.in_band(a, b, ["nation"], 5.0)


@query("""WITH g AS (SELECT c_mktsegment AS source, CAST(c_nationkey AS VARCHAR) AS group_key, count(*) AS n FROM customer GROUP BY ALL),
  c AS (SELECT DISTINCT c_mktsegment AS source, CAST(5 AS BIGINT) AS stated_n FROM customer UNION SELECT DISTINCT c_mktsegment, CAST(1000000 AS BIGINT) FROM customer)
  SELECT DISTINCT c.source, c.stated_n, g.group_key, g.n FROM c JOIN g ON c.source = g.source WHERE g.n <> c.stated_n""")
def count_conflicts(spark, d):
    counts = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("source"), F.col("c_nationkey").cast("string").alias("group_key")).agg(F.count("*").alias("n"))
    stated = table(spark, d, "customer").select(F.col("c_mktsegment").alias("source"), F.explode(F.array(F.lit(5).cast("long"), F.lit(1000000).cast("long"))).alias("stated_n")).distinct()
    return nearest.count_conflicts(stated, counts)


@query("""WITH r AS (SELECT o_orderpriority AS source, CAST(month(o_orderdate) % 3 + 1 AS BIGINT) AS a, CAST(month(o_orderdate) % 4 + 1 AS BIGINT) AS b, CASE WHEN o_orderstatus = 'F' THEN 'methods' ELSE 'figure' END AS section FROM orders)
  SELECT DISTINCT m.source, m.a AS a1, m.b AS b1, f.a AS a2, f.b AS b2 FROM (SELECT DISTINCT * FROM r WHERE section = 'methods') m JOIN (SELECT DISTINCT * FROM r WHERE section = 'figure') f ON m.source = f.source WHERE m.a <> f.a OR m.b <> f.b""")
def ratio_conflicts(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderpriority AS source", "cast(month(o_orderdate) % 3 + 1 as long) AS a", "cast(month(o_orderdate) % 4 + 1 as long) AS b", "CASE WHEN o_orderstatus = 'F' THEN 'methods' ELSE 'figure' END AS section")
    return nearest.ratio_conflicts(o.distinct())


@query("""SELECT DISTINCT p_brand AS source, CAST(p_partkey AS VARCHAR) AS file, 40.0::DOUBLE AS bar_um, CAST(p_size AS DOUBLE) AS fov_um FROM part WHERE 40.0 > 1.05 * p_size""")
def bars_beyond_view(spark, d):
    p = table(spark, d, "part")
    bars = p.select(F.col("p_brand").alias("source"), F.lit(40.0).alias("bar_um")).distinct()
    return nearest.exceeds_view(bars, p.selectExpr("p_brand AS source", "cast(p_partkey as string) AS file", "cast(p_size as double) AS fov_um"))


@query(f"""WITH v AS ({VECTORS.format(obs=OBS_S)}), p AS (SELECT a.source, a.group_key AS group_a, b.group_key AS group_b, least(a.n, b.n) AS n,
  CAST(list_sum(list_transform(list_distinct(a.vals), lambda x: least(len(list_filter(a.vals, lambda y: y = x)), len(list_filter(b.vals, lambda y: y = x))))) AS BIGINT) AS hits
  FROM v a JOIN v b ON a.source = b.source AND a.group_key < b.group_key) SELECT source, group_a, group_b, hits FROM p WHERE hits >= 0.5 * n""")
def multiset_overlaps(spark, d):
    return pairs.multiset_overlaps(vectors.vectors(sizes(spark, d)), 0.5)


_Z = "list_transform({v}[1:m], lambda e: CASE WHEN {s} > 0 THEN (e - list_avg({v}[1:m])) / {s} ELSE 0.0 END)"


@query(f"""WITH v AS ({VECTORS.format(obs=OBS_B)}), w AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, group_key) AS r FROM v),
  p AS (SELECT a.source, a.group_key, b.group_key AS largest, a.vals AS x, b.vals AS y, a.n AS n1, b.n AS n2, CAST(least(a.n, b.n) AS INT) AS m FROM w a JOIN w b ON a.source = b.source AND b.r = 1 WHERE a.r > 1),
  s AS (SELECT *, list_stddev_pop(x[1:m]) AS sx, list_stddev_pop(y[1:m]) AS sy FROM p),
  z AS (SELECT *, {_Z.format(v="x", s="sx")} AS zx, {_Z.format(v="y", s="sy")} AS zy FROM s)
  SELECT source, group_key, largest, CASE WHEN m >= 4 AND abs(n1 - n2) <= 2 THEN round(greatest(0.0, 1 - list_avg(list_transform(list_zip(zx, zy), lambda q: abs(q[1] - q[2]))) / 2) + 1e-9, 6) ELSE 0.0 END AS score FROM z""")
def shape_similarity(spark, d):
    """The shape of every group of a source against its largest group's."""
    v = vectors.vectors(balances(spark, d))
    top = v.groupBy("source").agg(F.max_by(F.struct("group_key", "vals"), F.struct("n", F.transform(F.split("group_key", ""), lambda c: -F.ascii(c)))).alias("t"))
    both = v.join(top, "source").filter(F.col("group_key") != F.col("t.group_key"))
    return both.select("source", "group_key", F.col("t.group_key").alias("largest"), F.round(arrays.z_similarity(F.col("vals"), F.col("t.vals")) + F.when((F.least("n", F.size("t.vals")) >= 4) & (F.abs(F.col("n") - F.size("t.vals")) <= 2), 1e-9).otherwise(0.0), 6).alias("score"))


@query("""SELECT CAST(c_nationkey AS VARCHAR) AS source, count(DISTINCT c_mktsegment) AS n_groups, count(DISTINCT c_mktsegment) * (count(DISTINCT c_mktsegment) - 1) // 2 AS n_pairs FROM customer GROUP BY c_nationkey HAVING count(DISTINCT c_mktsegment) >= 3""")
def multiplicity(spark, d):
    """Sources with three groups at least, and the comparisons they allow."""
    g = vectors.group_stats(balances(spark, d)).filter("n >= 1").groupBy("source").agg(F.count("*").alias("n_groups")).filter("n_groups >= 3")
    return g.withColumn("n_pairs", F.expr("n_groups * (n_groups - 1) div 2"))
