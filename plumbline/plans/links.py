"""Linking and n checks over orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import arrays
from plumbline.operators import links, vectors
from plumbline.plans.measurements import OBS_Q, STATS, quantities
from plumbline.plans.registry import query, table


def _tables(spark, d):
    """Quantities of suppliers, ten figures; every seventh supplier's groups stand under a heading."""
    o = quantities(spark, d)
    v = vectors.vectors(o).select("source", "group_key", arrays.value_hash(F.col("vals")).alias("fp"))
    t = vectors.group_stats(o).join(v, ["source", "group_key"]).withColumn("figure", F.expr("cast(source as int) % 10"))
    return t.withColumn("panel", F.when(F.expr("cast(source as int) % 7 = 0"), F.concat(F.lit("s"), F.col("source"))))


def _claims(spark, d):
    """Every third group is claimed with its own n, the others with one more; every fifth has the value hash as anchor; a panel for each supplier."""
    t = _tables(spark, d).withColumn("k", F.expr("cast(source as int) + ascii(group_key)"))
    return t.select(F.concat_ws("/", "source", "group_key").alias("claim_id"), "figure", F.concat(F.lit("s"), F.col("source")).alias("panel"), "group_key", F.when((F.col("k") % 3 == 0) | F.expr("cast(source as int) % 11 = 0"), F.col("n")).otherwise(F.col("n") + 1).alias("n"), F.when(F.col("k") % 5 == 0, F.col("fp")).alias("anchor_fp"), F.when(F.col("k") % 2 == 0, F.col("mean")).alias("mean"), F.when(F.col("k") % 2 == 0, F.col("sd")).alias("sd"))


_SQL = f"""WITH t AS (SELECT *, CAST(source AS INT) % 10 AS figure, CAST(source AS INT) + ascii(group_key) AS k FROM ({STATS.format(obs=OBS_Q)})),
  c AS (SELECT source || '/' || group_key AS claim_id, source AS own, source AS panel, figure, group_key, CASE WHEN k % 3 = 0 OR CAST(source AS INT) % 11 = 0 THEN n ELSE n + 1 END AS n, k % 5 = 0 AS anchored, CASE WHEN k % 2 = 0 THEN mean END AS mean, CASE WHEN k % 2 = 0 THEN sd END AS sd FROM t),
  cc AS (SELECT panel, n, count(*) AS c1 FROM c GROUP BY ALL), ff AS (SELECT source, n, count(*) AS c2 FROM t GROUP BY ALL), kk AS (SELECT panel, count(*) AS k FROM c GROUP BY panel),
  gg AS (SELECT * FROM (SELECT panel, source, sum(least(c1, c2)) AS hits FROM cc JOIN ff USING (n) GROUP BY ALL) JOIN kk USING (panel) WHERE hits = k OR (k >= 3 AND hits = k - 1)),
  pp AS (SELECT panel, min(source) AS source FROM gg WHERE hits = (SELECT max(hits) FROM gg x WHERE x.panel = gg.panel) GROUP BY panel HAVING count(*) = 1),
  h AS (SELECT claim_id, 100 AS score, 'heading' AS tier, own AS source FROM c WHERE CAST(own AS INT) % 7 = 0
    UNION ALL SELECT claim_id, 95 AS score, 'anchor_hash' AS tier, own AS source FROM c WHERE anchored
    UNION ALL SELECT claim_id, 90, 'unique_n', t.source FROM c JOIN t ON c.figure = t.figure AND c.n = t.n
    UNION ALL SELECT claim_id, 75, 'n_profile', pp.source FROM c JOIN pp USING (panel) JOIN t ON t.source = pp.source AND t.n = c.n
    UNION ALL SELECT claim_id, 70, 'anchor_stats', t.source FROM c JOIN t ON c.figure = t.figure AND c.n = t.n WHERE abs(c.mean - t.mean) <= 1e-3 AND abs(c.sd - t.sd) <= 1e-3
    UNION ALL SELECT claim_id, 65, 'mean', t.source FROM c JOIN t ON c.figure = t.figure AND c.n = t.n WHERE abs(c.mean - t.mean) <= greatest(0.05, 0.08 * abs(t.mean))
    UNION ALL SELECT claim_id, 60, 'n_and_group', t.source FROM c JOIN t ON c.figure = t.figure AND c.n = t.n AND lower(c.group_key) = lower(t.group_key)
    UNION ALL SELECT claim_id, 55, 'cross_folder', t.source FROM c JOIN t ON c.figure <> t.figure AND c.n = t.n AND lower(c.group_key) = lower(t.group_key)),
  u AS (SELECT claim_id, score, tier, min(source) AS source FROM h GROUP BY claim_id, score, tier HAVING count(DISTINCT source) = 1),
  b AS (SELECT claim_id, max(score) AS score, arg_max(tier, score) AS tier, arg_max(source, score) AS source FROM u GROUP BY claim_id)
  SELECT c.claim_id, b.source, b.tier, CAST(coalesce(b.score, 0) AS BIGINT) AS score, CASE WHEN b.tier IS NULL THEN 'unlinked' ELSE 'linked' END AS status FROM c LEFT JOIN b USING (claim_id)"""


@query(_SQL)
def tiered_links(spark, d):
    return links.linked(_claims(spark, d), _tables(spark, d)).select("claim_id", "source", "tier", "score", "status")


_MATRIX = """WITH c AS (SELECT o_orderpriority AS figure, o_orderstatus AS panel, CAST(month(o_orderdate) AS VARCHAR) AS group_key, count(*) AS n FROM orders GROUP BY ALL),
  m AS (SELECT figure, panel, group_key, n AS manuscript, CASE WHEN n % 3 = 0 THEN n + 1 ELSE n END AS data, CASE WHEN n % 5 = 0 THEN n + 2 ELSE n END AS stats FROM c)"""


def _matrix(spark, d):
    c = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("figure"), F.col("o_orderstatus").alias("panel"), F.month("o_orderdate").cast("string").alias("group_key")).agg(F.count("*").alias("n"))
    sides = F.array(*(F.struct(F.lit(s).alias("side"), n.alias("n"), F.lit(sure).alias("confidence"), F.lit(low).alias("lower_bound")) for s, n, sure, low in (("manuscript", F.col("n"), 1.0, False), ("data", F.expr("CASE WHEN n % 3 = 0 THEN n + 1 ELSE n END"), 0.9, False), ("plot", F.col("n") + 7, 0.1, False), ("stats", F.expr("CASE WHEN n % 5 = 0 THEN n + 2 ELSE n END"), 0.7, True))))
    return links.n_matrix(c.select("figure", "panel", "group_key", F.explode(sides).alias("s")).select("figure", "panel", "group_key", "s.*"))


@query(f"{_MATRIX} SELECT figure, panel, group_key, manuscript, data, manuscript + 7 AS plot, stats, manuscript <> data OR least(manuscript, data) < stats AS mismatch FROM m")
def n_matrix(spark, d):
    return _matrix(spark, d)


@query(f"{_MATRIX} SELECT figure, panel, group_key, CASE WHEN data > manuscript THEN 'P-EXCLUSION-UNDECLARED' ELSE 'P-N-MISMATCH-LEGEND-VS-DATA' END AS pattern_id, manuscript, data FROM m WHERE manuscript <> data OR least(manuscript, data) < stats")
def n_findings(spark, d):
    return links.n_findings(_matrix(spark, d))
