"""Evaluation, catalog upkeep and manuscripts' findings over labels, orders and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import catalog, emitters, evaluate, pairs, vectors
from plumbline.plans.measurements import OBS_L, VECTORS, line_numbers
from plumbline.plans.registry import query, table


@query(f"""WITH v AS ({VECTORS.format(obs=OBS_L)}), c AS (SELECT source, vals, min(group_key) AS g FROM v WHERE n >= 2 GROUP BY source, vals HAVING count(*) > 1)
  SELECT 'P-SOURCE-DUPLICATE-VALUES' AS pattern_id, v.source || ': ' || v.group_key AS location, 'warning' AS severity, CAST(v.n AS DOUBLE) AS n, c.g AS class_group FROM v JOIN c ON v.source = c.source AND v.vals = c.vals WHERE v.group_key <> c.g""")
def emitted_duplicates(spark, d):
    f = emitters.emit("P-SOURCE-DUPLICATE-VALUES", pairs.duplicates_within_source(vectors.vectors(line_numbers(spark, d)), 2))
    return f.select("pattern_id", "location", "severity", F.col("metrics")["n"].alias("n"), F.col("attrs")["class_group"].alias("class_group"))


@query("""WITH i AS (SELECT CAST(o_custkey AS VARCHAR) AS c, CAST(o_orderkey AS VARCHAR) AS item, o_orderstatus AS tag, o_orderpriority AS panel FROM orders WHERE o_orderkey % 5 = 0),
  f AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS c, o_orderstatus AS tag, o_orderpriority AS panel FROM orders WHERE o_orderkey % 5 = 1),
  m AS (SELECT i.item, EXISTS (SELECT 1 FROM f WHERE f.c = i.c AND f.tag = i.tag AND f.panel = i.panel) AS matched, i.tag FROM i),
  l AS (SELECT CASE WHEN matched THEN 'none' WHEN tag = 'P' THEN 'skipped' WHEN tag = 'F' THEN 'parser' ELSE 'match' END AS layer FROM m)
  SELECT layer, count(*) AS n_items, round(count(*) / (SELECT count(*) FROM l), 6) AS share FROM l GROUP BY layer""")
def lost_by_layer(spark, d):
    """Orders as gold items and as findings of their customer's case; open ones count as skipped, filled ones as not parsed."""
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("case"), F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("panel"), F.lit(None).cast("string").alias("evidence"), F.lit(None).cast("string").alias("pattern_id"), F.array("o_orderstatus").alias("tags"))
    items = o.filter("k % 5 = 0").withColumn("item", F.col("k").cast("string")).drop("k")
    m = evaluate.matched_items(items, o.filter("k % 5 = 1").drop("k"))
    told = m.withColumns({"skipped": F.col("tags")[0] == "P", "parsed": F.col("tags")[0] != "F", "linked": F.lit(True), "checked": F.lit(True)})
    return evaluate.layer_summary(evaluate.layers(told))


@query("""WITH f AS (SELECT CAST(o_custkey % 50 AS VARCHAR) AS paper, o_orderpriority AS pattern_id, count(*) AS n FROM orders WHERE o_custkey % 50 < 20 GROUP BY ALL),
  r AS (SELECT paper, pattern_id, n, greatest(n - CASE WHEN CAST(paper AS INT) % 2 = 0 THEN 10 ELSE 0 END, 0) AS rest FROM f)
  SELECT pattern_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(rest) AS BIGINT) AS n_unexplained, count(*) FILTER (rest > 0) AS papers_with, round(sum(rest) / 20, 3) AS per_paper FROM r GROUP BY pattern_id""")
def clean_papers(spark, d):
    """Customers in fifty papers, twenty of them clean; in every second one ten findings of each kind are expected."""
    f = table(spark, d, "orders").select((F.col("o_custkey") % 50).cast("string").alias("paper"), F.col("o_orderpriority").alias("pattern_id"))
    papers = spark.range(20).select(F.col("id").cast("string").alias("paper"))
    expected = f.select("pattern_id").distinct().crossJoin(papers.filter("cast(paper as int) % 2 = 0")).withColumn("n", F.lit(10))
    return evaluate.clean_summary(f, papers, expected)


@query("""WITH a AS (SELECT 'P' || c_custkey AS pattern_id, 'P1' AS priority, 'planned' AS status, c_custkey % 2 = 0 AS enabled, c_custkey % 7 = 0 AS locked FROM customer WHERE c_custkey % 3 <> 0),
  s AS (SELECT 'P' || c_custkey AS pattern_id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'P0' END AS priority, 'implemented' AS status, true AS enabled FROM customer WHERE c_custkey % 5 <> 0)
  SELECT coalesce(a.pattern_id, s.pattern_id) AS pattern_id, CASE WHEN coalesce(a.locked, false) THEN a.priority ELSE coalesce(s.priority, a.priority) END AS priority, CASE WHEN coalesce(a.locked, false) THEN a.status ELSE coalesce(s.status, a.status) END AS status,
    coalesce(a.enabled, s.enabled) AS enabled, CASE WHEN a.pattern_id IS NULL THEN 'added' WHEN s.pattern_id IS NULL THEN 'own' WHEN coalesce(a.locked, false) THEN 'locked' ELSE 'synced' END AS origin FROM a FULL JOIN s ON a.pattern_id = s.pattern_id""")
def synced_catalog(spark, d):
    c = table(spark, d, "customer").withColumn("pattern_id", F.concat(F.lit("P"), "c_custkey"))
    active = c.filter("c_custkey % 3 <> 0").selectExpr("pattern_id", "'P1' AS priority", "'planned' AS status", "c_custkey % 2 = 0 AS enabled", "c_custkey % 7 = 0 AS locked")
    shipped = c.filter("c_custkey % 5 <> 0").selectExpr("pattern_id", "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'P0' END AS priority", "'implemented' AS status", "true AS enabled")
    return catalog.synced(active, shipped)


@query("""WITH p AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus <> 'P'), s AS (SELECT 'r' || (o_custkey % 9) AS rule, o_orderstatus AS split, o_orderkey % 3 > 0 AS enabled, o_orderkey % 11 AS hits FROM orders)
  SELECT rule, split, CAST(sum(CASE WHEN enabled THEN hits ELSE 0 END) - sum(CASE WHEN enabled THEN 0 ELSE hits END) AS BIGINT) AS hits, CAST(greatest(sum(CASE WHEN enabled THEN 0 ELSE hits END) - sum(CASE WHEN enabled THEN hits ELSE 0 END), 0) AS BIGINT) AS lost FROM s GROUP BY rule, split""")
def rule_contributions(spark, d):
    s = table(spark, d, "orders").selectExpr("concat('r', o_custkey % 9) AS rule", "o_orderstatus AS split", "o_orderkey % 3 > 0 AS enabled", "o_orderkey % 11 AS hits")
    return evaluate.contributions(s)


@query("""WITH e AS (SELECT 'E' || p_partkey AS entry, 'F' || p_partkey AS file, p_partkey % 3 = 0 AS d, p_partkey % 4 AS y, p_partkey % 5 = 0 AS t FROM part), k AS (SELECT entry, file, array_to_string(list_filter([CASE WHEN d THEN 'doi' END, CASE WHEN y > 1 THEN 'year' END, CASE WHEN t THEN 'title' END], lambda x: x IS NOT NULL), ',') AS kinds FROM e)
  SELECT * FROM k WHERE kinds <> ''""")
def reference_meta(spark, d):
    """Parts as references whose papers differ in DOI, year or title by their key."""
    p = table(spark, d, "part").selectExpr("concat('E', p_partkey) AS entry", "concat('10.1/', p_partkey) AS doi", "2000 AS year", "'growth of small flies' AS title", "concat('F', p_partkey) AS file",
        "CASE WHEN p_partkey % 3 = 0 THEN '10.1/x' ELSE concat('10.1/', p_partkey) END AS file_doi", "2000 + p_partkey % 4 AS file_year", "CASE WHEN p_partkey % 5 = 0 THEN 'weight of large worms' ELSE 'Growth of small flies' END AS file_title")
    return emitters.meta_conflicts(p)
