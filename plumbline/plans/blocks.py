"""Block checks over customers: nations as blocks of a workbook, market segments as columns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import blocks
from plumbline.plans.registry import query, table

_ROWS = """r0 AS (SELECT CAST(c_nationkey AS INT) AS k, c_mktsegment AS header, CAST(c_acctbal AS DOUBLE) AS num, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS row FROM customer)"""


def _rows(spark, d):
    """A block per nation under figure nation mod 7, panel a, b or c; every fourth nation's block stands again, its rows turned round, under the next figure."""
    w = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")
    r = table(spark, d, "customer").select(F.col("c_nationkey").cast("int").alias("k"), F.col("c_mktsegment").alias("header"), F.col("c_acctbal").cast("double").alias("num"), F.row_number().over(w).cast("long").alias("row"))
    panel = F.char(97 + F.col("k") % 3)
    own = r.select(F.lit("f.xlsx").alias("path"), F.lit("s").alias("sheet"), F.col("k").cast("long").alias("block"), (F.col("k") % 7).cast("string").alias("number"), panel.alias("panels"), F.lit(True).alias("explicit"), F.concat(F.lit("Figure "), F.col("k") % 7, panel, F.lit(" growth")).alias("title"), F.ascii("header").cast("long").alias("col"), "header", F.lit("value").alias("role"), "row", "num", F.lit(None).cast("string").alias("str"))
    copy = own.filter("block % 4 = 0").withColumns({"block": F.col("block") + 100, "number": F.expr("cast((block % 7 + 1) as string)"), "row": -F.col("row"), "title": F.concat(F.lit("Fig. "), F.expr("block % 7 + 1"), F.lit(": growth"))})
    return own.union(copy)


@query(f"""WITH {_ROWS}, n AS (SELECT k, header, count(*) AS c, count(DISTINCT num) AS u, list(num ORDER BY row) AS v FROM r0 GROUP BY k, header HAVING count(*) >= 5 AND count(DISTINCT num) >= 3)
  SELECT CAST(k % 7 AS VARCHAR) AS number_a, chr(97 + k % 3) AS panels_a, CAST(k % 7 + 1 AS VARCHAR) AS number_b, chr(97 + k % 3) AS panels_b, TRUE AS same_condition, count(*) AS n_columns, count(*) FILTER (v = list_reverse(v)) AS n_in_order
  FROM n WHERE k % 4 = 0 GROUP BY k % 7, k % 3""")
def reused_columns(spark, d):
    return blocks.reused_columns(blocks.columns(_rows(spark, d)))


@query(f"""WITH {_ROWS}, g AS (SELECT k, header, count(*) AS n, avg(num) AS m, (sum(num) - max(num)) / (count(*) - 1) AS lo, stddev_samp(num) AS s1, stddev_pop(num) AS s0, list(num) AS v, sum(num) AS s FROM r0 GROUP BY k, header HAVING count(*) >= 3),
  t AS (SELECT *, round(CASE k % 3 WHEN 0 THEN m WHEN 1 THEN lo ELSE m + 50 END, 2) AS mean, round(CASE k % 2 WHEN 0 THEN s1 ELSE s0 END, 2) AS sd FROM g),
  h AS (SELECT *, abs(m - mean) <= 0.005000000005 AS ok, len(list_filter(v, lambda x: abs((s - x) / (n - 1) - mean) <= 0.005000000005)) AS hits FROM t)
  SELECT k AS block, header, n, CASE WHEN ok THEN 'ok' WHEN n >= 4 AND hits = 1 THEN 'dropped_value' ELSE 'unexplained' END AS mean_status,
    CASE WHEN ok OR NOT (n >= 4 AND hits = 1) THEN CASE WHEN abs(s1 - sd) <= 0.005000000005 THEN 'sample' WHEN abs(s0 - sd) <= 0.005000000005 THEN 'population' ELSE 'unexplained' END END AS sd_status FROM h""")
def block_summaries(spark, d):
    """Stated means are right, without the largest value or 50 too high; SDs are a sample's or a population's. Where a value was dropped, the SD is not compared."""
    rows = _rows(spark, d).filter("block < 100")
    keys = [c for c in rows.columns if c not in ("role", "row", "num", "str")]
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("num").alias("m"), F.sum("num").alias("s"), F.max("num").alias("top"), F.stddev_samp("num").alias("s1"), F.stddev_pop("num").alias("s0")).filter("n >= 3")
    mean = F.when(F.col("block") % 3 == 0, F.col("m")).when(F.col("block") % 3 == 1, (F.col("s") - F.col("top")) / (F.col("n") - 1)).otherwise(F.col("m") + 50)
    sd = F.when(F.col("block") % 2 == 0, F.col("s1")).otherwise(F.col("s0"))
    told = g.select(*keys, F.explode(F.array(*(F.struct(F.lit(k).alias("role"), F.lit(10**9).cast("long").alias("row"), F.round(v, 2).alias("num")) for k, v in (("mean", mean), ("sd", sd))))).alias("t")).select(*keys, "t.*").withColumn("str", F.format_string("%.2f", F.col("num")))
    out = blocks.summaries(rows.unionByName(told))
    return out.select(F.col("block").cast("int").alias("block"), "header", "n", "mean_status", F.when(F.col("mean_status") != "dropped_value", F.col("sd_status")).alias("sd_status"))


@query(f"""WITH {_ROWS}, g AS (SELECT k, header, count(*) AS n FROM r0 GROUP BY k, header), b AS (SELECT k AS block, CAST(k % 7 AS VARCHAR) AS number, chr(97 + k % 3) AS panel, header, n FROM g),
  c AS (SELECT block, number, panel, header, n + CASE WHEN header = 'BUILDING' THEN 100000 ELSE 0 END AS n FROM b WHERE block < 21),
  pr AS (SELECT number, panel, block, string_agg(header || '=' || n, ',' ORDER BY header || '=' || n) AS profile FROM b GROUP BY ALL), tw AS (SELECT number, panel, count(DISTINCT profile) AS k FROM pr GROUP BY ALL HAVING count(DISTINCT profile) > 1),
  s AS (SELECT number, panel, n, count(*) AS c1 FROM c GROUP BY ALL), f AS (SELECT number, panel, block, n, count(*) AS c2 FROM b GROUP BY ALL),
  h AS (SELECT number, panel, block, coalesce(sum(least(c1, c2)), 0) AS hits FROM f LEFT JOIN s USING (number, panel, n) GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY number, panel ORDER BY hits DESC, block) AS r FROM h),
  own AS (SELECT b.* FROM b JOIN o USING (number, panel, block) WHERE r = 1), top AS (SELECT number, panel, max(n) AS found FROM own GROUP BY ALL)
  SELECT number, panel, 'duplicate_reference' AS kind, NULL AS group_key, CAST(NULL AS BIGINT) AS stated, k AS found FROM tw
  UNION ALL SELECT c.number, c.panel, 'n_differs', c.header, c.n, top.found FROM c JOIN top USING (number, panel) WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.number = c.number AND own.panel = c.panel AND own.n = c.n)""")
def block_panels(spark, d):
    """Legends state the n of every nation's segments, BUILDING's wrong; nations that share a figure and panel are several blocks under one heading."""
    ns = blocks.block_ns(_rows(spark, d).filter("block < 100"))
    stated = ns.filter("block < 21").select("number", "panel", "group_key", (F.col("n") + F.when(F.col("group_key") == "BUILDING", 100000).otherwise(0)).alias("n"))
    return blocks.panel_findings(stated, ns)
