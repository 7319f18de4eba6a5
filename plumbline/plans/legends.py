"""Legends made of parts' columns: the SQL knows the numbers that the text states."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import legends
from plumbline.plans.registry import query, spread, table


def _legends(spark, d):
    """Four ways to state n, by part key."""
    p = spread(table(spark, d, "part")).select("p_partkey", (F.col("p_partkey") % 4).alias("k"), (F.col("p_size") + 2).cast("string").alias("n"), (F.col("p_size") + 9).cast("string").alias("m"))
    lit = F.lit
    text = (
        F.when(F.col("k") == 0, F.concat(lit("Growth. (a) Length of WT (n = "), "n", lit(") and KO (n = "), "m", lit("). (b) Weight, n = "), "m", lit(" mice.")))
        .when(F.col("k") == 1, F.concat(lit("a, Length; n = "), "n", lit(" WT and "), "m", lit(" KO. b, Weight of the same; n ≥ "), "n", lit(".")))
        .when(F.col("k") == 2, F.concat(lit("a, First. b, Second. c, Third. WT and KO, n = "), "n", lit(" and "), "m", lit(", respectively.")))
        .otherwise(F.concat(lit("Growth. (a) One. (b) Two. (c) Three; n = "), "n", lit("-"), "m", lit(" cells in a-b.")))
    )
    return p.select(F.col("p_partkey").cast("string").alias("doc"), lit("1").alias("figure"), text.alias("text"))


@query("""WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS doc, p_partkey % 4 AS k, CAST(p_size + 2 AS BIGINT) AS n, CAST(p_size + 9 AS BIGINT) AS m FROM part),
  r AS (SELECT doc, unnest(CASE k WHEN 0 THEN [{'p': 'a', 'g': 'WT', 'n': n, 'x': NULL, 'l': false}, {'p': 'a', 'g': 'KO', 'n': m, 'x': NULL, 'l': false}, {'p': 'b', 'g': NULL, 'n': m, 'x': NULL, 'l': false}]
    WHEN 1 THEN [{'p': 'a', 'g': 'WT', 'n': n, 'x': NULL, 'l': false}, {'p': 'a', 'g': 'KO', 'n': m, 'x': NULL, 'l': false}, {'p': 'b', 'g': NULL, 'n': n, 'x': NULL, 'l': true}]
    WHEN 2 THEN [{'p': 'c', 'g': 'WT', 'n': n, 'x': NULL, 'l': false}, {'p': 'c', 'g': 'KO', 'n': m, 'x': NULL, 'l': false}]
    ELSE [{'p': 'a', 'g': NULL, 'n': n, 'x': m, 'l': false}, {'p': 'b', 'g': NULL, 'n': n, 'x': m, 'l': false}] END) AS s FROM p)
  SELECT doc, '1' AS figure, s.p AS panel, s.g AS group_key, s.n AS n, CAST(s.x AS BIGINT) AS n_max, s.l AS lower_bound FROM r""")
def legend_ns(spark, d):
    return legends.panel_ns(_legends(spark, d))


@query("""WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS doc, CAST(p_size % 5 + 1 AS INT) AS f FROM part)
  SELECT doc, CAST(f AS VARCHAR) AS figure, 'Growth of ' || doc || '. Second part. And more' AS legend, CAST(1 AS BIGINT) AS n_mentions FROM p UNION ALL SELECT doc, 'ED' || f, 'Weight of ' || doc || '. Last words', CAST(0 AS BIGINT) FROM p""")
def gathered_legends(spark, d):
    """A manuscript of seven paragraphs for every part: text, a legend of two paragraphs, one of extended data, and a continued one."""
    p = spread(table(spark, d, "part")).select(F.col("p_partkey").cast("string").alias("doc"), (F.col("p_size") % 5 + 1).cast("string").alias("f"))
    lines = (F.concat(F.lit("As seen in Fig. "), "f", F.lit(", it grew.")), F.concat(F.lit("Figure "), "f", F.lit(". Growth of "), "doc", F.lit(".")), F.lit("Second part."), F.concat(F.lit("Extended Data Figure "), "f", F.lit(": Weight of "), "doc", F.lit(".")), F.lit("Last words"), F.concat(F.lit("Figure "), "f", F.lit(" (continued). And more")))
    paragraphs = p.select("doc", F.posexplode(F.array(*lines)).alias("ord", "text"))
    found = legends.gathered(paragraphs)
    return legends.figure_bundles(paragraphs.filter("ord = 0"), found).select("doc", "figure", "legend", "n_mentions")
