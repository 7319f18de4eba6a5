"""Keys, catalogs, evaluation and lineage over orders, customers, parts, events and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import catalog, evaluate, graph, refs, similarity
from plumbline.plans.registry import query, table


@query("""SELECT DISTINCT CAST(o_orderpriority AS VARCHAR) AS doc, CAST(o_custkey AS VARCHAR) AS key FROM orders o
  WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment = 'BUILDING') AND CAST(o_custkey AS VARCHAR) NOT IN (SELECT 'x' || c_custkey FROM customer)""")
def missing_entries(spark, d):
    """Orders cite customers; each priority's bibliography holds the customers of one segment."""
    o = table(spark, d, "orders").selectExpr("cast(o_orderpriority as string) AS doc", "cast(o_custkey as string) AS key")
    bib = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").selectExpr("cast(c_custkey as string) AS key", "concat('x', c_custkey) AS alias")
    return refs.missing_entries(o, o.distinct().join(bib, "key").select("doc", "key", "alias"))


@query("""SELECT CAST(c_nationkey AS VARCHAR) AS doc, CAST(c_custkey AS VARCHAR) AS key FROM customer c
  WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')""")
def orphan_entries(spark, d):
    """Customers that no open order of status P cites."""
    bib = table(spark, d, "customer").selectExpr("cast(c_nationkey as string) AS doc", "cast(c_custkey as string) AS key", "c_name AS alias")
    cites = table(spark, d, "orders").filter("o_orderstatus = 'P'").selectExpr("cast(o_custkey as string) AS key").join(bib.select("doc", "key"), "key")
    return refs.orphan_entries(bib, cites.select("doc", "key")).select("doc", "key")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return refs.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""WITH t AS (SELECT CAST(o_custkey AS VARCHAR) AS entry, list_sort(list_distinct(list(CAST(year(o_orderdate) AS VARCHAR)))) AS y FROM orders GROUP BY o_custkey)
  SELECT entry, array_to_string(y, ',') AS years FROM t WHERE len(y) >= 2""")
def conflicting_years(spark, d):
    """Each customer's order years, written as parenthesised years of one entry."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("entry")).agg(F.concat_ws(" ", F.sort_array(F.collect_list(F.concat(F.lit("("), F.year("o_orderdate").cast("string"), F.lit(")"))))).alias("text"))
    return refs.conflicting_years(o)


@query("""WITH a AS (SELECT DISTINCT CAST(o_orderpriority AS VARCHAR) AS source, 'C' || o_custkey AS id FROM orders WHERE o_orderstatus = 'F'),
  b AS (SELECT DISTINCT CAST(o_orderpriority AS VARCHAR) AS source, 'C' || o_custkey AS id FROM orders WHERE o_orderstatus = 'O')
  SELECT coalesce(a.source, b.source) AS source, coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'undeclared' WHEN b.id IS NULL THEN 'phantom' ELSE 'matched' END AS status
  FROM a FULL JOIN b ON a.source = b.source AND a.id = b.id""")
def id_sets(spark, d):
    o = table(spark, d, "orders").selectExpr("cast(o_orderpriority as string) AS source", "concat('c', o_custkey) AS id", "o_orderstatus")
    return refs.id_sets(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"))


@query("""WITH a AS (SELECT DISTINCT p_brand AS key, p_type AS label FROM part WHERE p_size <= 2), b AS (SELECT DISTINCT p_brand AS key, p_type AS label FROM part WHERE p_size > 49)
  SELECT key, (SELECT count(*) FROM a x WHERE x.key = k.key) AS n_config, (SELECT count(*) FROM b x WHERE x.key = k.key) AS n_table FROM (SELECT DISTINCT key FROM a) k
  WHERE n_config >= 1 AND n_table >= 1 AND NOT EXISTS (SELECT 1 FROM a JOIN b USING (key, label) WHERE a.key = k.key)""")
def disjoint_labels(spark, d):
    """With one label at least a side; the default of two leaves few sets in the small tables."""
    p = table(spark, d, "part").selectExpr("p_brand AS key", "p_type AS label", "p_size")
    return refs.disjoint_labels(p.filter("p_size <= 2").select("key", "label"), p.filter("p_size > 49").select("key", "label"), 1)


@query("""WITH a AS (SELECT DISTINCT p_brand AS figure, p_type AS label FROM part), b AS (SELECT DISTINCT p_brand AS figure, p_type AS label FROM part WHERE p_size > 45)
  SELECT figure, label FROM a WHERE figure IN (SELECT figure FROM b) AND NOT EXISTS (SELECT 1 FROM b WHERE b.figure = a.figure AND b.label = a.label)""")
def missing_labels(spark, d):
    p = table(spark, d, "part").selectExpr("p_brand AS figure", "p_type AS label", "p_size")
    return refs.missing_labels(p.select("figure", "label"), p.filter("p_size > 45").select("figure", "label"))


@query("""WITH a AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY ALL), b AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)
  SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment)""")
def upsert(spark, d):
    c = table(spark, d, "customer")
    by = lambda x: x.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return refs.upsert(by(c.filter("c_acctbal > 5000")), by(c), ["c_nationkey", "c_mktsegment"])


@query("""WITH a AS (SELECT c_custkey AS k, c_mktsegment AS seg, CAST(c_nationkey AS BIGINT) AS nat FROM customer WHERE c_acctbal > 0),
  b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'OTHER' ELSE c_mktsegment END AS seg, CAST(CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE c_nationkey END AS BIGINT) AS nat FROM customer WHERE c_acctbal < 9000)
  SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'only_left' WHEN a.k IS NULL THEN 'only_right' WHEN a.seg <> b.seg OR a.nat <> b.nat THEN 'changed' ELSE 'same' END AS status,
  CASE WHEN a.k IS NULL OR b.k IS NULL THEN '' WHEN a.seg <> b.seg AND a.nat <> b.nat THEN 'seg,nat' WHEN a.seg <> b.seg THEN 'seg' WHEN a.nat <> b.nat THEN 'nat' ELSE '' END AS changed FROM a FULL JOIN b ON a.k = b.k""")
def catalog_diff(spark, d):
    """Two versions of the customers compared field by field."""
    c = table(spark, d, "customer")
    a = c.filter("c_acctbal > 0").selectExpr("c_custkey AS k", "c_mktsegment AS seg", "cast(c_nationkey as long) AS nat")
    b = c.filter("c_acctbal < 9000").selectExpr("c_custkey AS k", "CASE WHEN c_custkey % 3 = 0 THEN 'OTHER' ELSE c_mktsegment END AS seg", "cast(CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE c_nationkey END as long) AS nat")
    return refs.compared(a, b, ["k"], ["seg", "nat"])


@query("""WITH p AS (SELECT *, list_distinct(list_filter(string_split(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) > 2)) AS w FROM part),
  e AS (SELECT 'E' || p_partkey AS entry, CASE WHEN p_partkey % 2 = 0 THEN 'd' || p_partkey END AS doi, 1990 + p_size AS year, w FROM p), f AS (SELECT 'F' || p_partkey AS file, 'd' || p_partkey AS doi, 1990 + p_size AS year, w FROM p WHERE p_partkey % 3 <> 0),
  h1 AS (SELECT entry, file FROM e JOIN f USING (doi)), h2 AS (SELECT entry, file FROM e JOIN f ON e.year = f.year WHERE entry NOT IN (SELECT entry FROM h1) AND len(list_intersect(e.w, f.w)) >= 0.6 * least(len(e.w), len(f.w))),
  g AS (SELECT entry, 1 AS rule, count(DISTINCT file) AS n, min(file) AS file FROM h1 GROUP BY entry UNION ALL SELECT entry, 2, count(DISTINCT file), min(file) FROM h2 GROUP BY entry)
  SELECT e.entry, CASE WHEN g.n IS NULL THEN 'unmatched' WHEN g.n = 1 THEN 'matched' ELSE 'ambiguous' END AS status, CASE WHEN g.n = 1 THEN g.file END AS file, g.rule FROM e LEFT JOIN g USING (entry)""")
def matched_by_doi(spark, d):
    """Parts as entries and files: half of the entries have a DOI, a third of the files are gone; what no DOI finds, its title within a year may."""
    p = table(spark, d, "part").withColumns({"year": F.col("p_size") + 1990, "title": F.concat_ws(" ", "p_name", "p_type")})
    bib = p.selectExpr("concat('E', p_partkey) AS entry", "CASE WHEN p_partkey % 2 = 0 THEN concat('d', p_partkey) END AS doi", "year", "title")
    files = p.filter("p_partkey % 3 <> 0").selectExpr("concat('F', p_partkey) AS file", "concat('d', p_partkey) AS doi", "year", "title")
    return refs.matched_by_priority(bib, files)


# -- catalog --------------------------------------------------------------------------------------

FINDINGS = "SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'P-SOURCE-DUPLICATE-VALUES' WHEN '2-HIGH' THEN 'P-REF-ORPHAN-ENTRY' WHEN '3-MEDIUM' THEN 'P-UNKNOWN' WHEN '4-NOT SPECIFIED' THEN NULL ELSE 'P-COUNT-N-MISMATCH' END AS pattern_id, o_orderkey FROM orders"


def _findings(spark, d):
    return table(spark, d, "orders").selectExpr(FINDINGS.removeprefix("SELECT ").removesuffix(", o_orderkey FROM orders"), "o_orderkey", "o_orderstatus")


@query(f"SELECT pattern_id, count(*) AS n FROM ({FINDINGS}) WHERE pattern_id IS NULL OR pattern_id IN ('P-SOURCE-DUPLICATE-VALUES', 'P-COUNT-N-MISMATCH') GROUP BY pattern_id")
def active_findings(spark, d):
    return catalog.active(_findings(spark, d), catalog.rules(spark)).groupBy("pattern_id").agg(F.count("*").alias("n"))


@query(f"SELECT pattern_id, count(*) AS n FROM ({FINDINGS}) WHERE pattern_id IN ('P-REF-ORPHAN-ENTRY', 'P-UNKNOWN') GROUP BY pattern_id")
def suppressed_findings(spark, d):
    return catalog.suppressed(_findings(spark, d), catalog.rules(spark)).groupBy("pattern_id").agg(F.count("*").alias("n"))


@query("SELECT 'implemented' AS status, CAST(38 AS BIGINT) AS n, CAST(37 AS BIGINT) AS n_enabled")
def catalog_status(spark, d):
    return catalog.status_counts(catalog.rules(spark))


@query(f"SELECT pattern_id, count(*) FILTER (o_orderstatus <> 'P') AS n_active, count(*) FILTER (o_orderstatus = 'P') AS n_demoted FROM (SELECT f.*, o_orderstatus FROM ({FINDINGS}) f JOIN orders USING (o_orderkey)) GROUP BY pattern_id")
def pattern_counts(spark, d):
    return evaluate.pattern_counts(_findings(spark, d).withColumn("demoted", F.col("o_orderstatus") == "P"))


_MINED = """e AS (SELECT DISTINCT p_partkey, r AS reason, p_type LIKE '%A%' AS life FROM (SELECT p_partkey, p_type, unnest(string_split(p_name, ' ')) AS r FROM part) WHERE r <> ''),
  m AS (SELECT reason, count(*) AS n, count(*) FILTER (life) AS n_life FROM e GROUP BY reason HAVING count(*) FILTER (life) > 0)"""


def _mined(spark, d):
    records = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("subjects"), F.translate("p_name", " ", ";").alias("reasons"))
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("reason")).distinct().filter("length(reason) % 2 = 0")
    return catalog.mined_reasons(records, words, ["A"]), words.withColumn("pattern_id", F.concat(F.lit("P-"), F.upper(F.substring("reason", 1, 1))))


@query(f"WITH {_MINED} SELECT reason, n, n_life, length(reason) % 2 = 0 AS mapped FROM m")
def mined_reasons(spark, d):
    """Words of part names as reasons; types with an A are life science; words of even length are mapped."""
    return _mined(spark, d)[0]


@query(f"""WITH {_MINED}, h AS (SELECT 'P-' || upper(substr(reason, 1, 1)) AS pattern_id, CAST(sum(n_life) AS BIGINT) AS heat FROM m WHERE length(reason) % 2 = 0 GROUP BY ALL)
  SELECT pattern_id, heat, CASE WHEN heat >= 5000 THEN 'P0' ELSE 'P1' END AS suggested, round(least(1.0, heat / 15000.0), 6)::DOUBLE AS score FROM h ORDER BY heat DESC, pattern_id LIMIT 25""")
def triage(spark, d):
    mined, mapping = _mined(spark, d)
    return catalog.triage(catalog.heat(mined, mapping), catalog.rules(spark))


@query("""SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'P-COUNT-N-MISMATCH' ELSE 'P-REF-MISSING-ENTRY' END AS pattern_id, l_linenumber % 2 = 0 AND p_size > 25 AS demoted, count(*) AS n
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY ALL""")
def demoted_pictures(spark, d):
    findings = table(spark, d, "lineitem").selectExpr("CASE WHEN l_linenumber % 2 = 0 THEN 'P-COUNT-N-MISMATCH' ELSE 'P-REF-MISSING-ENTRY' END AS pattern_id", "l_partkey AS figure", "'a' AS panel")
    panels = table(spark, d, "part").selectExpr("p_partkey AS figure", "'a' AS panel", "CASE WHEN p_size > 25 THEN 'picture' ELSE 'plot' END AS kind")
    return catalog.demoted_pictures(findings, panels).groupBy("pattern_id", "demoted").agg(F.count("*").alias("n"))


# -- evaluation -----------------------------------------------------------------------------------

_CASES = "SELECT lang AS split, source AS style, doc_id, quality, toxic, n_chars FROM documents JOIN labels USING (doc_id)"


def _cases(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").selectExpr("lang AS split", "source AS style", "doc_id", "quality", "toxic", "n_chars")


@query(f"""SELECT split, count(*) FILTER (quality = 1 AND n_chars > 1000) AS hits, count(*) FILTER (quality = 1) AS n_gold, count(*) FILTER (n_chars > 1000) AS n_found,
  round(count(*) FILTER (quality = 1 AND n_chars > 1000) / count(*) FILTER (quality = 1), 6) AS recall, round(count(*) FILTER (quality = 1 AND n_chars > 1000) / count(*) FILTER (n_chars > 1000), 6) AS precision FROM ({_CASES}) GROUP BY split""")
def precision_recall(spark, d):
    """Long documents as findings of good ones."""
    c = _cases(spark, d)
    return evaluate.precision_recall(c.filter("quality = 1"), c.filter("n_chars > 1000"), ["doc_id"], ["split"])


_SCORES = f"SELECT split, style, count(*) FILTER (quality = 1 AND n_chars > 1000) AS hits, count(*) FILTER (quality = 1) AS n_gold FROM ({_CASES}) GROUP BY split, style"


def _scores(spark, d):
    return _cases(spark, d).groupBy("split", "style").agg(F.count_if(F.expr("quality = 1 AND n_chars > 1000")).alias("hits"), F.count_if(F.expr("quality = 1")).alias("n_gold"))


@query(f"""SELECT split, style, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(n_gold) AS BIGINT) AS n_gold, CAST(grouping(split, style) AS BIGINT) AS level, round(sum(hits) / nullif(sum(n_gold), 0), 6) AS micro_recall
  FROM ({_SCORES}) GROUP BY GROUPING SETS ((split), (style), ())""")
def score_rollup(spark, d):
    return evaluate.rollup(_scores(spark, d), "split", "style")


@query()
def bootstrap_recall(spark, d):
    return evaluate.bootstrap_recall(_scores(spark, d).withColumnRenamed("style", "case"), 500)


@query("""WITH a AS (SELECT o_orderpriority AS p, o_orderstatus AS c, count(*) AS n FROM orders WHERE year(o_orderdate) >= 1995 GROUP BY ALL), b AS (SELECT o_orderpriority AS p, o_orderstatus AS c, count(*) AS n FROM orders WHERE year(o_orderdate) < 1995 GROUP BY ALL)
  SELECT p, c, coalesce(a.n, 0) AS n_now, coalesce(b.n, 0) AS n_before, CASE WHEN coalesce(a.n, 0) > coalesce(b.n, 0) THEN 'regression' ELSE 'improvement' END AS verdict FROM a FULL JOIN b USING (p, c) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def against_baseline(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderpriority AS p", "o_orderstatus AS c", "year(o_orderdate) AS y")
    by = lambda x: x.groupBy("p", "c").agg(F.count("*").alias("n"))
    return evaluate.against_baseline(by(o.filter("y >= 1995")), by(o.filter("y < 1995")), ["p", "c"])


@query("""WITH a AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL), b AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
  SELECT p, a.n - coalesce(b.n, 0) AS left_over FROM a LEFT JOIN b USING (p) WHERE a.n > coalesce(b.n, 0)""")
def unexplained_counts(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderpriority", "p")
    by = lambda x: x.groupBy("p").agg(F.count("*").alias("n"))
    return evaluate.unexplained(by(o), by(o.filter("o_orderstatus = 'F'")), ["p"])


@query("""WITH b AS (SELECT p_partkey AS k, CAST(p_size % 7 AS DOUBLE) AS l, CAST(p_size % 5 AS DOUBLE) AS t, p_size % 7 + 4.0::DOUBLE AS r, p_size % 5 + 3.0::DOUBLE AS b, 2.0::DOUBLE AS l2, 2.0::DOUBLE AS t2, 6.0::DOUBLE AS r2, 6.0::DOUBLE AS b2 FROM part),
  i AS (SELECT k, greatest(0, least(r, r2) - greatest(l, l2)) * greatest(0, least(b, b2) - greatest(t, t2)) AS i, (r - l) * (b - t) + (r2 - l2) * (b2 - t2) AS s FROM b) SELECT k, round(i / (s - i), 6) AS iou FROM i""")
def box_overlaps(spark, d):
    b = table(spark, d, "part").selectExpr("p_partkey AS k", "double(p_size % 7) AS l", "double(p_size % 5) AS t", "double(p_size % 7 + 4) AS r", "double(p_size % 5 + 3) AS b", "2.0D AS l2", "2.0D AS t2", "6.0D AS r2", "6.0D AS b2")
    return b.select("k", F.round(evaluate.iou(("l", "t", "r", "b"), ("l2", "t2", "r2", "b2")), 6).alias("iou"))


# -- lineage, files, vectors ------------------------------------------------------------------------


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION SELECT DISTINCT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
  w(start, node, hops) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region UNION ALL SELECT w.start, e.dst, w.hops + 1 FROM w JOIN e ON w.node = e.src)
  SELECT start, node, CAST(min(hops) AS BIGINT) AS hops FROM w GROUP BY start, node""")
def reachable(spark, d):
    e = table(spark, d, "nation").selectExpr("concat('r', n_regionkey) AS src", "concat('n', n_nationkey) AS dst").union(table(spark, d, "supplier").selectExpr("concat('n', s_nationkey)", "concat('s', s_suppkey)"))
    return graph.reachable(e, table(spark, d, "region").selectExpr("concat('r', r_regionkey) AS start"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT p_brand AS a, p_brand || '/' || p_type AS b FROM part), n AS (SELECT a AS id FROM e UNION SELECT b FROM e)
  SELECT id, split_part(id, '/', 1) AS component FROM n""")
def components(spark, d):
    e = table(spark, d, "part").selectExpr("p_brand AS a", "concat(p_brand, '/', p_type) AS b")
    return graph.components(e)


@query("""WITH p AS (SELECT CAST(doc_id AS VARCHAR) AS path, text FROM documents), k AS (SELECT text, min(path) AS keeper, count(*) AS n_copies FROM p GROUP BY text HAVING count(*) > 1)
  SELECT path, keeper, n_copies FROM p JOIN k USING (text)""")
def identical_files(spark, d):
    return similarity.identical_files(table(spark, d, "documents").selectExpr("cast(doc_id as string) AS path", "cast(text as binary) AS content"))


@query("""WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), q AS (SELECT * FROM v WHERE id % 20 = 0),
  s AS (SELECT q.id AS query, v.id, round(list_dot_product(q.v, v.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(v.v, v.v)), 9) AS score FROM q JOIN v ON q.id <> v.id),
  r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) SELECT query, rank, id, round(score, 6) AS score FROM r WHERE rank <= 5""")
def cosine_top_k(spark, d):
    """Queries are the rows whose id is divisible by 20."""
    v = table(spark, d, "embeddings").filter("embedding IS NOT NULL").selectExpr("vec_id AS id", "embedding AS v")
    return similarity.top_k(v.filter("id % 20 = 0"), v).withColumn("score", F.round("score", 6))


_HALF = """SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM (SELECT q.id AS query, v.id, round(list_dot_product(q.v, v.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(v.v, v.v)), 9) AS score FROM v q JOIN v ON {q} AND {v} WHERE q.id % 20 = 0)"""


@query(f"""WITH v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL),
  a AS ({_HALF.format(q="q.label < 5", v="v.label >= 5")}), b AS ({_HALF.format(q="q.label >= 5", v="v.label < 5")}),
  u AS (SELECT query AS a, id AS b, score FROM a WHERE rank <= 3 UNION ALL SELECT id, query, score FROM b WHERE rank <= 3) SELECT a, b, round(max(score), 6) AS score FROM u GROUP BY a, b""")
def cosine_shortlist(spark, d):
    """Best partners across two halves of the labels, from either side."""
    v = table(spark, d, "embeddings").filter("embedding IS NOT NULL").selectExpr("vec_id AS id", "embedding AS v", "label")
    a, b = v.filter("label < 5 AND id % 20 = 0").drop("label"), v.filter("label >= 5 AND id % 20 = 0").drop("label")
    return similarity.shortlisted(similarity.top_k(a, v.filter("label >= 5").drop("label"), 3), similarity.top_k(b, v.filter("label < 5").drop("label"), 3)).withColumn("score", F.round("score", 6))


_EDGES = """b AS (SELECT DISTINCT regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS b FROM part), e AS (SELECT b || '.py' AS path, unnest([{'src': b || '.csv', 'dst': 'df', 'kind': 'read'}, {'src': 'df', 'dst': 'wt', 'kind': 'derive'},
  {'src': 'wt', 'dst': 'plot:4', 'kind': 'plot'}, {'src': 'wt', 'dst': 'plot:5', 'kind': 'plot'}, {'src': 'wt', 'dst': 'ko_' || b || '.csv', 'kind': 'save'}]) AS s FROM b)"""


@query(f"WITH {_EDGES} SELECT path, s.src AS src, s.dst AS dst, s.kind AS kind FROM e")
def script_lineage(spark, d):
    """Edges of one small script per brand."""
    code = "import pandas as pd\ndf = pd.read_csv('{0}.csv')\nwt = df[df.g == 'wt']\nplt.plot(wt)\nplt.bar(wt)\nwt.to_csv('ko_{0}.csv')\n"
    s = table(spark, d, "part").select(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "").alias("b")).distinct()
    return graph.script_edges(s.select(F.concat("b", F.lit(".py")).alias("path"), F.replace(F.lit(code), F.lit("{0}"), F.col("b")).alias("code")))


@query(f"WITH {_EDGES} SELECT path, 'wt' AS src, s.dst AS dst, CAST(0 AS BIGINT) AS n_plots FROM e WHERE s.kind = 'save' UNION ALL SELECT DISTINCT path, 'wt', NULL, CAST(2 AS BIGINT) FROM e")
def script_conflicts(spark, d):
    e = script_lineage(spark, d)
    return graph.save_conflicts(e, ["wt", "ko"]).withColumn("n_plots", F.lit(0).cast("long")).unionByName(graph.plotted_twice(e).withColumn("dst", F.lit(None).cast("string")))
