"""Claims, labels and paths: sentences made of the tables' columns, so that the SQL knows what they state without reading them."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import claims, labels
from plumbline.plans.registry import query, spread, table

def _sentences():
    """For each kind of claim the sentence that makes it and what reads it back."""
    return {
        "means": (F.concat(F.lit("A mean of "), F.col("a"), F.lit(" mm; values averaged "), F.col("b"), F.lit(".")), lambda s: F.array_join(F.transform(claims.mean_claims(s), lambda x: F.round(x).cast("long").cast("string")), ",")),
        "hints": (F.concat(F.lit("WT: "), F.col("a"), F.lit(" ± "), F.col("b"), F.lit(" (n = "), F.col("c"), F.lit("), mut: 2 +/- 1")), lambda s: F.array_join(F.transform(claims.numeric_hints(s), lambda h: F.concat_ws("/", h["label"], h["mean"].cast("long").cast("string"), h["err"].cast("long").cast("string"), h["n"].cast("string"))), ",")),
        "counts": (F.concat(F.col("a"), F.lit(" colonies and n = "), F.col("b"), F.lit(" (C) were seen.")), lambda s: F.array_join(F.transform(claims.counted(s), lambda h: F.concat_ws("/", h["n"].cast("string"), h["what"])), ",")),
        "pairs": (F.concat(F.lit("g"), F.col("a"), F.lit(" vs g"), F.col("b"), F.lit(", the vs a")), lambda s: F.array_join(claims.compared_pairs(s), ",")),
        "cohorts": (F.concat(F.lit("~"), F.col("a"), F.lit(" flies per vial")), lambda s: F.concat_ws("/", claims.cohort(s)["n"].cast("string"), claims.cohort(s)["approximate"].cast("string"))),
        "exclusions": (F.concat(F.lit("Animals F"), F.col("a"), F.lit(" and m"), F.col("b"), F.lit(" were excluded.")), lambda s: F.array_join(claims.declared_exclusions(s), ",")),
        "scales": (F.concat(F.lit("Scale bar, "), F.col("a"), F.lit(" µm. Taken with a "), F.col("b"), F.lit("x lens.")), lambda s: F.concat_ws("/", F.array_join(F.transform(claims.scale_bars(s), lambda x: x["um"].cast("long").cast("string")), ","), F.array_join(F.transform(claims.magnifications(s), lambda x: x.cast("long").cast("string")), ","))),
        "citations": (F.concat(F.lit("It rose by "), F.col("a"), F.lit("% ["), F.col("b"), F.lit("]. Adapted from others. Nothing more.")), lambda s: F.concat_ws("/", F.array_join(F.transform(claims.cited_sentences(s), lambda x: F.concat_ws(":", F.array_join(x["cites"], "+"), x["percents"][0].cast("long").cast("string"))), ","), claims.cites_source(s).cast("string"))),
        "meta": (F.concat(F.lit("Growth of many small things "), F.col("a"), F.lit("\nJournal of growth\ndoi:10.1234/x."), F.col("b"), F.lit(".\n(1999)")), lambda s: F.concat_ws("/", claims.pdf_meta(s)["doi"], claims.pdf_meta(s)["year"].cast("string"), claims.pdf_meta(s)["title"])),
        "spans": (F.concat(F.lit("a, first n = 3. b, second n = "), F.col("a"), F.lit(", then n = "), F.col("b"), F.lit(". c, last n = 9")), lambda s: F.array_join(F.transform(claims.panel_n_spans(s, F.lit("b")), lambda x: x["phrase"]), ",")),
        "panels": (F.concat(F.lit("See Fig. "), F.col("c"), F.lit("b-d and Figure S"), F.col("c"), F.lit("a.")), lambda s: F.array_join(F.transform(labels.referenced_panels(s), lambda x: F.concat(x["figure"], x["panel"])), ",")),
        "figures": (F.concat(F.lit("In Figs "), F.col("c"), F.lit("-"), F.col("c") + 2, F.lit(" and Fig. S"), F.col("c")), lambda s: F.array_join(labels.mentioned_figures(s), ",")),
        "spanned": (F.concat(F.lit("x "), F.col("a"), F.lit(" normalized to "), F.col("b")), claims.disclosure_span),
    }


@query("""WITH p AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS a, CAST(p_partkey + 1 AS VARCHAR) AS b, CAST(p_size % 9 + 1 AS INT) AS c, p_partkey % 90 + 10 AS m FROM part),
  t AS (SELECT p_partkey, unnest([{'k': 'means', 'v': a || ',' || b}, {'k': 'hints', 'v': 'wt/' || a || '/' || b || '/' || c || ',mut/2/1'}, {'k': 'counts', 'v': a || '/colonies,' || b || '/c'},
    {'k': 'pairs', 'v': least('g' || a, 'g' || b) || '|' || greatest('g' || a, 'g' || b)}, {'k': 'cohorts', 'v': a || '/true'}, {'k': 'exclusions', 'v': 'F' || a || ',M' || b}, {'k': 'scales', 'v': a || '/' || b},
    {'k': 'citations', 'v': b || ':' || a || '/true'}, {'k': 'meta', 'v': '10.1234/x.' || b || '/1999/Growth of many small things ' || a}, {'k': 'spans', 'v': 'n = ' || a || ',n = ' || b},
    {'k': 'panels', 'v': c || 'b,' || c || 'c,' || c || 'd,S' || c || 'a'}, {'k': 'figures', 'v': array_to_string(list_sort([CAST(c AS VARCHAR), CAST(c + 1 AS VARCHAR), CAST(c + 2 AS VARCHAR), 'S' || c]), ',')}, {'k': 'spanned', 'v': 'x ' || a || ' normalized to ' || b}]) AS s FROM p)
  SELECT p_partkey, s.k AS kind, s.v AS stated FROM t""")
def stated_claims(spark, d):
    """Each kind of claim in a sentence of its own for every part, read back by its extractor."""
    p = spread(table(spark, d, "part")).select("p_partkey", F.col("p_partkey").cast("string").alias("a"), (F.col("p_partkey") + 1).cast("string").alias("b"), (F.col("p_size") % 9 + 1).cast("int").alias("c"))
    each = F.array(*(F.struct(F.lit(k).alias("kind"), text.cast("string").alias("text")) for k, (text, _) in _sentences().items()))
    rows = p.select("p_partkey", F.explode(each).alias("s")).select("p_partkey", "s.kind", "s.text")
    stated = F.lit(None).cast("string")
    for k, (_, read) in _sentences().items():
        stated = F.when(F.col("kind") == k, read(F.col("text"))).otherwise(stated)
    return rows.select("p_partkey", "kind", stated.alias("stated"))


@query("""WITH p AS (SELECT p_partkey, p_size % 4 AS k, CAST(p_size % 9 + 1 AS VARCHAR) AS f FROM part)
  SELECT p_partkey, k IN (0, 1) AS claims, k <> 3 AND k <> 1 OR k = 1 AS compatible, TRUE AS soft, CASE k WHEN 0 THEN 'data/Fig' || f WHEN 1 THEN 'data/Figure_0' || f || '/raw' WHEN 2 THEN 'data/exp' ELSE 'other' END AS unit,
    k = 2 AS plot, CASE k WHEN 0 THEN 'wt' WHEN 1 THEN 'cont' WHEN 2 THEN 'all' ELSE 'all' END AS group_key, k = 3 AS counted FROM p""".replace("'data/Figure_0' || f || '/raw'", "'data/Figure_0' || f"))
def path_evidence(spark, d):
    """Paths of four layouts against the figure that part of them name."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 4).alias("k"), (F.col("p_size") % 9 + 1).cast("string").alias("f"))
    path = F.when(F.col("k") == 0, F.concat(F.lit("data/Fig"), "f", F.lit("/WT.csv"))).when(F.col("k") == 1, F.concat(F.lit("data/Figure_0"), "f", F.lit("/raw/control 1.csv"))).when(F.col("k") == 2, F.lit("data/exp/sub/quant_x.csv")).otherwise(F.lit("other/colony.csv"))
    p = p.withColumn("path", path)
    c = F.col("path"), F.col("f")
    return p.select("p_partkey", labels.path_claims_figure(*c).alias("claims"), labels.path_compatible(*c).alias("compatible"), labels.path_soft_compatible(*c).alias("soft"), labels.experiment_unit(c[0]).alias("unit"), labels.is_plot_table(c[0]).alias("plot"), labels.group_from_path(c[0]).alias("group_key"), labels.is_count_table(c[0]).alias("counted"))


@query("""WITH p AS (SELECT p_partkey, p_size % 5 AS k, CAST(p_size % 9 + 1 AS VARCHAR) AS f FROM part)
  SELECT p_partkey, CASE k WHEN 0 THEN f WHEN 1 THEN f WHEN 2 THEN 'S' || f WHEN 3 THEN f END AS number, CASE k WHEN 0 THEN '' WHEN 1 THEN 'b,c,d' WHEN 2 THEN 'a,c' WHEN 3 THEN 'b' END AS panels, k = 1 AND k < 4 AS extended FROM p""".replace("k = 1 AND k < 4 AS extended", "CASE WHEN k < 4 THEN k = 1 END AS extended"))
def figure_labels(spark, d):
    """Cells that are labels of figures, and cells that are not."""
    f = F.col("f")
    cell = F.when(F.col("k") == 0, F.concat(F.lit("Figure "), f)).when(F.col("k") == 1, F.concat(F.lit("Extended Data Fig. "), f, F.lit("b-d"))).when(F.col("k") == 2, F.concat(F.lit("Supp Fig "), f, F.lit("a, c"))).when(F.col("k") == 3, F.concat(F.lit("fig"), f, F.lit("b"))).otherwise(F.concat(F.lit("growth "), f))
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 5).alias("k"), (F.col("p_size") % 9 + 1).cast("string").alias("f")).withColumn("l", labels.figure_label(cell))
    return p.select("p_partkey", "l.number", F.array_join("l.panels", ",").alias("panels"), "l.extended")


@query("""WITH g AS (SELECT DISTINCT p_brand AS figure, lower(replace(p_brand, '#', '')) AS stem FROM part), k AS (SELECT figure, stem, unnest(['-/-', ' mutant', '+/+', ' RNAi']) AS e FROM g)
  SELECT figure, stem || e AS legend, stem || 'ko' AS tab FROM k WHERE e IN ('-/-', ' mutant') UNION ALL SELECT figure, stem || ' RNAi', stem || 'ko' FROM g""")
def key_aliases(spark, d):
    """Groups of a legend by genotype, against a table that names each gene's knock-out; they meet by the gene's other names."""
    g = table(spark, d, "part").select(F.col("p_brand").alias("figure"), F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))).alias("stem")).distinct()
    legend = g.select("figure", F.explode(F.array(*(F.concat("stem", F.lit(e)) for e in ("-/-", " mutant", " RNAi")))).alias("legend"))
    tab = g.select("figure", F.concat("stem", F.lit("ko")).alias("tab"))
    keys = lambda df, c: df.withColumn("key", F.explode(labels.expanded_keys(F.col(c))))
    return keys(legend, "legend").join(keys(tab, "tab"), ["figure", "key"]).select("figure", "legend", "tab").distinct()
