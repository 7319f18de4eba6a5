"""Findings, matches and layouts over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import catalog, findings, matching, panels, vectors
from plumbline.plans.measurements import OBS_B, OBS_S, STATS, VECTORS, balances, line_numbers
from plumbline.plans.registry import query, table


@query(f"""SELECT source AS location, CAST(count(*) AS DOUBLE) AS n_groups FROM (SELECT source, group_key FROM ({OBS_B}) GROUP BY source, group_key HAVING count(value) >= 2)
  WHERE (SELECT n_regionkey FROM nation WHERE CAST(n_nationkey AS VARCHAR) = source) IN (0, 3) GROUP BY source HAVING count(*) >= 3""")
def multiplicity_findings(spark, d):
    """Nations as sources, regions as manuscripts; those of key 0 and 3 name t-tests, 1 and 4 name a correction too, 2 names none."""
    k = F.col("r_regionkey")
    said = F.when(k % 3 == 0, "Groups were compared by t-test.").when(k % 3 == 1, "We used t-tests with Bonferroni's correction.").otherwise("Groups were looked at.")
    texts = table(spark, d, "region").select(k.cast("string").alias("doc"), said.alias("text"))
    of = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("source"), F.col("n_regionkey").cast("string").alias("doc"))
    return findings.multiplicity_gap(balances(spark, d), texts, manuscripts=of).select("location", F.col("metrics")["n_groups"].alias("n_groups"))


@query()
def screened_findings(spark, d):
    """All measurement checks over orders' line numbers, with the documents as texts."""
    return findings.screened(line_numbers(spark, d), table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"), catalog.rules(spark), 2).select("finding_id", "pattern_id", "severity", "demoted", "location")


@query(f"""WITH g AS ({STATS.format(obs=OBS_B)}), r AS (SELECT source AS path, min(mean) + 20000 AS a, max(mean) + 20000 AS b FROM g GROUP BY source HAVING count(*) >= 2),
  p AS (SELECT r.path, least(abs(a - x.mean) + abs(b - y.mean), abs(a - y.mean) + abs(b - x.mean)) AS gap, greatest(abs(a), abs(b)) AS size FROM r JOIN g x ON x.source = r.path JOIN g y ON y.source = r.path AND x.group_key < y.group_key)
  SELECT path, path AS source, round(min(gap) + 1e-6, 2) AS mean_error FROM p GROUP BY path HAVING min(gap) >= 1 AND min(gap) > greatest(0.15, 0.1 * any_value(size))""")
def unmatched_residues(spark, d):
    """Each nation's smallest and largest segment mean, 20,000 too high, as a residue."""
    s = vectors.group_stats(balances(spark, d)).withColumn("folder", F.col("source"))
    r = s.groupBy("folder").agg(F.col("folder").alias("path"), (F.min("mean") + 20000).alias("mean_a"), (F.max("mean") + 20000).alias("mean_b"), F.count("*").alias("k")).filter("k >= 2").drop("k")
    return matching.unmatched_residues(r, s).withColumn("mean_error", F.round(F.col("mean_error") + 1e-6, 2))


@query(f"""WITH v AS ({VECTORS.format(obs=OBS_S)}), p AS (SELECT source AS folder, source || '/' || group_key AS plot, vals FROM v WHERE ascii(group_key) % 2 = 0 OR n % 3 > 0),
  h AS (SELECT plot, folder || '#' AS source, CAST(list_sum(list_transform(list_distinct(p.vals), lambda x: least(len(list_filter(p.vals, lambda y: y = x)), len(list_filter(v.vals, lambda y: y = x))))) AS DOUBLE) / greatest(len(p.vals), len(v.vals)) AS score FROM p JOIN v ON p.folder = v.source)
  SELECT plot, source, CAST(1 AS BIGINT) AS n_groups, round(max(score), 6) AS mean_score FROM h WHERE score >= 0.85 GROUP BY plot, source""")
def plot_tables(spark, d):
    """Types' sizes as plots, drawn 0.1 too high, or 0.6 too high for some, which then find nothing; each against all types of its brand."""
    v = vectors.vectors(table(spark, d, "part").selectExpr("p_brand AS source", "p_type AS group_key", "double(p_size) AS value"))
    off = F.when((F.ascii("group_key") % 2 == 0) | (F.col("n") % 3 > 0), 0.1).otherwise(0.6)
    plots = v.select(F.concat_ws("/", "source", "group_key").alias("plot"), F.col("source").alias("folder"), "group_key", F.transform("vals", lambda x: x + off).alias("vals"))
    tables = v.select(F.concat("source", F.lit("#")).alias("source"), F.col("source").alias("folder"), "group_key", "vals")
    return matching.best_tables(plots, tables)


@query("""WITH t AS (SELECT c_nationkey AS source, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL), s AS (SELECT source, list_sort(list(n)) AS found FROM t GROUP BY source), c AS (SELECT source AS claim_id, list_sort(list(n + CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END)) AS stated FROM t GROUP BY source)
  SELECT claim_id, source, array_to_string(stated, ',') AS stated, array_to_string(found, ',') AS found FROM c JOIN s ON len(stated) = len(found)
  WHERE stated <> found AND len(list_filter(list_zip(stated, found), lambda p: abs(p[1] - p[2]) > greatest(1, ceil(0.2 * p[2])))) = 0""")
def shape_cards(spark, d):
    t = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("source"), "c_mktsegment").agg(F.count("*").alias("n"))
    claims = t.select(F.col("source").alias("claim_id"), (F.col("n") + (F.col("c_mktsegment") == "BUILDING").cast("int")).alias("n"))
    return matching.shape_cards(claims, t.select("source", "n"))


@query("""WITH l AS (SELECT p_brand AS page, p_partkey AS letter, CAST(p_size * 10 AS DOUBLE) AS x, CAST(p_partkey AS DOUBLE) * 100 AS y FROM part)
  SELECT page, letter, x AS x0, y AS y0, 1000.0::DOUBLE AS x1, coalesce(lead(y) OVER (PARTITION BY page ORDER BY y), 1e9::DOUBLE) AS y1 FROM l""")
def panel_boxes(spark, d):
    """Parts as letters, one a line."""
    p = table(spark, d, "part").selectExpr("p_brand AS page", "p_partkey AS letter", "double(p_size * 10) AS x", "double(p_partkey) * 100 AS y", "1000D AS page_w", "1e9D AS page_h")
    return panels.panels_from_labels(p)
