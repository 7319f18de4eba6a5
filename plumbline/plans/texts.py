"""Ordered scans, retrieval and text functions over events, documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import ordered, pairs, retrieval
from plumbline.plans.registry import query, table


def _lines(spark, d):
    """(doc, ord, line) of documents."""
    return table(spark, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("ord", "line")).select("doc", F.col("ord").cast("long").alias("ord"), "line")


LINES = "SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS ord FROM documents WHERE text IS NOT NULL"
CURVES = "SELECT user_id AS curve, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, CAST(value AS DOUBLE) AS value FROM events WHERE value IS NOT NULL"


def _series(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events").filter("value IS NOT NULL")
    return e.select(F.col("user_id").alias("curve"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("ord"), F.col("value").cast("double").alias("value"))


@query(f"""WITH s AS (SELECT curve, ord, value, max(value) OVER (PARTITION BY curve) AS m FROM ({CURVES})),
  f AS (SELECT curve, ord, CASE WHEN m > 1.5 THEN value / 100 ELSE value END AS frac FROM s),
  e AS (SELECT curve, ord, frac * 20 AS expected FROM f WHERE frac >= 0 AND frac <= 1.000001),
  g AS (SELECT *, coalesce(expected - lag(expected) OVER (PARTITION BY curve ORDER BY ord) > 0.51, false) AS rise, abs(expected - round(expected)) > 1e-3 AS not_whole, coalesce(abs(10 - expected) > 0.51, false) AS alive_gap FROM e)
  SELECT curve, ord, round(expected, 6) AS expected, not_whole, alive_gap, rise FROM g WHERE not_whole OR alive_gap OR rise""")
def survival_audit(spark, d):
    """Every user's values as a survival curve of 20 animals, 10 of them alive."""
    s = _series(spark, d).withColumnRenamed("value", "survival").withColumns({"alive": F.lit(10.0), "n0": F.lit(20)})
    return ordered.survival_audit(s).withColumn("expected", F.round("expected", 6))


@query(f"""WITH s AS (SELECT curve, ord, floor(100 / ord) AS value FROM ({CURVES})), u AS (SELECT *, coalesce(value > lag(value) OVER (PARTITION BY curve ORDER BY ord), false) AS up FROM s)
  SELECT curve, CAST(arg_min(value, ord) AS BIGINT) AS cohort, count(*) AS n FROM u GROUP BY curve HAVING count(*) >= 3 AND NOT bool_or(up)""")
def falling_cohorts(spark, d):
    """Counts that fall as 100 / ord."""
    return ordered.falling_cohorts(_series(spark, d).withColumn("value", F.floor(F.lit(100) / F.col("ord"))))


@query(f"""WITH v AS (SELECT curve, ord, CASE WHEN curve % 3 = 0 THEN value ELSE ord + value / 1e9 END AS value FROM ({CURVES})),
  s AS (SELECT *, coalesce(value > lag(value) OVER (PARTITION BY curve ORDER BY ord), true) AS ok FROM v)
  SELECT curve, count(*) AS n FROM s GROUP BY curve HAVING count(*) >= 2 AND bool_and(ok)""")
def rising_starts(spark, d):
    """Whole curves; two thirds of the users have their values raised by their order."""
    value = F.when(F.col("curve") % 3 == 0, F.col("value")).otherwise(F.col("ord") + F.col("value") / 1e9)
    return ordered.strictly_rising(_series(spark, d).withColumn("value", value))


@query()
def cohort_sizes(spark, d):
    """Survival curves of 5 + user mod 40 animals of which one dies at each event, printed with three decimals."""
    s = _series(spark, d).withColumn("n", 5 + F.col("curve") % 40)
    s = s.withColumn("survival", F.round(F.greatest(F.lit(0), F.col("n") - F.col("ord") + 1) / F.col("n"), 3))
    return ordered.cohort_sizes(s.select(F.col("curve").cast("string").alias("curve"), "ord", "survival"))


@query(f"""WITH l AS ({LINES}), s AS (SELECT doc, ord, last_value(CASE WHEN length(line) < 40 THEN lower(line) END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY ord ROWS UNBOUNDED PRECEDING) AS section FROM l)
  SELECT doc, count(*) AS n_lines, count(section) AS n_in_section, count(DISTINCT section) AS n_sections FROM s GROUP BY doc""")
def sections(spark, d):
    """Short lines as headings."""
    s = ordered.sections(_lines(spark, d), F.when(F.length("line") < 40, F.lower("line")))
    return s.groupBy("doc").agg(F.count("*").alias("n_lines"), F.count("section").alias("n_in_section"), F.count_distinct("section").alias("n_sections"))


@query(f"""WITH l AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[A-E]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY ord ROWS UNBOUNDED PRECEDING) AS entry FROM ({LINES}))
  SELECT doc, CAST(entry AS BIGINT) AS entry, count(*) AS n_lines, sha256(string_agg(line, ' ' ORDER BY ord)) AS text_sha FROM l GROUP BY doc, entry""")
def joined_lines(spark, d):
    """Lines that begin with A to E start an entry."""
    return ordered.joined_lines(_lines(spark, d), F.col("line").rlike("^[A-E]")).select("doc", "entry", "n_lines", F.sha2("text", 256).alias("text_sha"))


@query("""WITH r AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), g AS (SELECT *, CASE WHEN l_partkey - lag(l_partkey) OVER w <= 20 THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_partkey)),
  i AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS run FROM g) SELECT l_suppkey, min(l_partkey) AS first, max(l_partkey) AS last, count(*) AS n FROM i GROUP BY l_suppkey, run""")
def islands(spark, d):
    return ordered.islands(table(spark, d, "lineitem"), ["l_suppkey"], "l_partkey", 20)


@query("""WITH r AS (SELECT DISTINCT p_brand, CAST(p_size AS BIGINT) AS s FROM part), g AS (SELECT p_brand, s, s - row_number() OVER (PARTITION BY p_brand ORDER BY s) AS run FROM r),
  i AS (SELECT p_brand, min(s) AS first, max(s) AS last, count(*) AS n FROM g GROUP BY p_brand, run), m AS (SELECT *, max(n) OVER (PARTITION BY p_brand) AS most FROM i),
  k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN first = 1 AND 2 * n >= most THEN 0 ELSE 1 END, first) AS rn FROM m WHERE n = most OR (first = 1 AND 2 * n >= most)) SELECT p_brand, first, last, n FROM k WHERE rn = 1""")
def dominant_runs(spark, d):
    return ordered.dominant_run(table(spark, d, "part").select("p_brand", F.col("p_size").cast("long").alias("s")), ["p_brand"], "s", 1)


@query("""WITH r AS (SELECT DISTINCT l_orderkey, CAST(l_linenumber AS BIGINT) AS k FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY k) AS rn FROM r)
  SELECT l_orderkey, coalesce(max(k) FILTER (k = rn), 0) AS upto FROM n GROUP BY l_orderkey""")
def contiguous_prefix(spark, d):
    return ordered.contiguous_prefix(table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("k")), ["l_orderkey"], "k")


@query("""WITH t AS (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) >= 3)) AS term FROM documents),
  q0 AS (SELECT item_id, unnest(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) >= 3)) AS term FROM benchmark WHERE item_id % 20 = 0),
  q AS (SELECT item_id AS query, term, count(*) AS qtf FROM q0 GROUP BY ALL), d AS (SELECT doc_id AS doc, term, count(*) AS tf FROM t GROUP BY ALL),
  z AS (SELECT doc, sum(tf) AS len FROM d GROUP BY doc), a AS (SELECT count(*) AS n, avg(len) AS al FROM z), f AS (SELECT term, count(*) AS df FROM d GROUP BY term),
  s AS (SELECT query, doc, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))), 6) AS score FROM q JOIN d USING (term) JOIN f USING (term) JOIN z USING (doc), a GROUP BY query, doc),
  r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s) SELECT query, rank, doc, round(score, 4) AS score FROM r WHERE rank <= 3""")
def bm25_top_k(spark, d):
    """Benchmark items whose id is divisible by 20 as queries against all documents."""
    q = table(spark, d, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("query"), "text")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    return retrieval.bm25(q, docs).withColumn("score", F.round("score", 4))


@query("""WITH p AS (SELECT p_partkey AS claim_id, p_partkey % 5 AS k, p_size % 3 AS m FROM part)
  SELECT claim_id, CASE WHEN k = 4 THEN 'no_passage' ELSE 'reviewed' END AS status, CASE WHEN k = 0 AND m <> 0 THEN 'numeric' WHEN k = 1 AND m = 0 THEN 'polarity' WHEN k = 2 AND m <> 0 THEN 'year' WHEN k = 3 AND m = 1 THEN 'numeric,polarity' ELSE '' END AS kinds FROM p""")
def contradictions(spark, d):
    """Claims of parts against passages that state another percentage, the opposite, another year, two of these, or nothing."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("claim_id"), (F.col("p_partkey") % 5).alias("k"), (F.col("p_size") % 3).alias("m"))
    k, m = F.col("k"), F.col("m")
    claim = F.when(k == 0, F.concat(F.lit("it rose by "), 50 + m, F.lit("% here"))).when(k == 1, "survival increased").when(k == 2, F.concat(F.lit("as in "), 1999 + m)).when(k == 3, F.lit("it increased by 30%")).otherwise("lost")
    passage = F.when(k == 0, F.lit("it rose by 50% there")).when(k == 1, F.when(m == 0, "survival decreased").otherwise("survival was higher")).when(k == 2, "nothing").when(k == 3, F.when(m == 1, "it was reduced by 20%").otherwise("30% more, elevated"))
    year = F.when(k == 2, F.lit(1999)).when(k == 1, F.lit(2001)).cast("int")
    return retrieval.contradictions(p.select("claim_id", claim.alias("claim"), passage.alias("passage"), year.alias("source_year")))


_NUM = "CASE WHEN regexp_matches({t}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN CAST({t} AS DOUBLE) END"
_CELL = "regexp_replace(regexp_replace(trim(s), ',([0-9]{3})', '\\1', 'g'), '\\s*%$', '')"


@query(f"""WITH c AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN ' ' || CAST(c_custkey AS VARCHAR) || '%' WHEN 1 THEN '1,' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || '.5' WHEN 2 THEN 'N/A' WHEN 3 THEN c_mktsegment ELSE CAST(c_custkey AS VARCHAR) || 'e-2' END AS s FROM customer)
  SELECT c_custkey, {_NUM.format(t=_CELL)} AS number, CASE WHEN lower(trim(s)) = 'n/a' THEN 'empty' WHEN {_NUM.format(t=_CELL)} IS NOT NULL THEN 'num' ELSE 'str' END AS kind FROM c""")
def cell_kinds(spark, d):
    s = F.expr("CASE c_custkey % 5 WHEN 0 THEN concat(' ', c_custkey, '%') WHEN 1 THEN concat('1,', lpad(cast(c_custkey % 1000 as string), 3, '0'), '.5') WHEN 2 THEN 'N/A' WHEN 3 THEN c_mktsegment ELSE concat(c_custkey, 'e-2') END")
    return table(spark, d, "customer").select("c_custkey", text.parse_number(s).alias("number"), text.cell_kind(s).alias("kind"))


@query("""SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS title FROM part""")
def normalized_titles(spark, d):
    return table(spark, d, "part").select("p_partkey", text.normalized_title(F.col("p_name")).alias("title"))


@query("""WITH t AS (SELECT DISTINCT p_name || ' ' || p_type AS n FROM part), w AS (SELECT n, list_distinct(list_filter(string_split(regexp_replace(lower(n), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')) AS w FROM t)
  SELECT a.n AS title_a, b.n AS title_b, round(len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)), 6) AS overlap FROM w a JOIN w b ON a.n < b.n WHERE len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) >= 0.6""")
def title_overlaps(spark, d):
    """Different part titles meet by their rarest words."""
    names = table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("id")).distinct()
    met = pairs.overlapping(names.select(F.lit(0).alias("scope"), "id", F.array_distinct(text.tokens(F.col("id"), 1)).alias("tokens")), 0.6)
    return met.select(F.least("id_a", "id_b").alias("title_a"), F.greatest("id_a", "id_b").alias("title_b"), F.round(F.col("common") / F.col("n_a"), 6).alias("overlap"))


@query("""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^ \\n\\t]+', '[URL]', 'g'), '10\\.[0-9]{4,9}/[^ \\n\\t]+', '[DOI]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]', '[ID]', 'g'), '(?:PMID|pmid|PMCID|pmcid):? ?(?:PMC)?[0-9]+', '[ID]', 'g'), '\\n{3,}', chr(10) || chr(10), 'g') AS r FROM documents)
  SELECT doc_id, CAST(length(r) AS BIGINT) AS n, sha256(r) AS sha FROM t""")
def redacted(spark, d):
    t = table(spark, d, "documents").select("doc_id", text.redacted(F.col("text")).alias("r"))
    return t.select("doc_id", F.length("r").cast("long").alias("n"), F.sha2("r", 256).alias("sha"))


@query()
def chunks(spark, d):
    c = ordered.chunks(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"))
    return c.select("doc", "chunk", F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("sha"))


@query("""SELECT conv_id, CAST(turn AS BIGINT) AS turn, CASE WHEN regexp_matches(lower(text), '(same|shared|common) control') THEN 'explicit' ELSE 'none' END AS disclosure,
  len(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) >= 3)) AS n_tokens FROM conversations""")
def cues(spark, d):
    return table(spark, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), text.disclosure(F.col("text")).alias("disclosure"), F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"))


_LABELS = [("Fig. 1c-e and g", "n = 6; 1.2±0.3, 2.0 +/- 0.5 at 1:3", "[1-4, 7]"), ("Supplementary Figure 2", "N=12 scale bar 50 µm or 0.2 mm", "3"), ("Extended Data Fig. 4", "mean ± SEM", "9-12"), ("Table 5", "shared control", "1-40"), ("text", "", "")]


@query("""SELECT * FROM (VALUES ('Fig. 1c-e and g', '1', 'c,d,e,g', '6', '1.2±0.3,2.0±0.5', '1:3', '', '1,2,3,4,7', 'unknown'), ('Supplementary Figure 2', 'S2', '', '12', '', '', '50.0,200.0', '3', 'unknown'),
  ('Extended Data Fig. 4', 'ED4', '', '', '', '', '', '9,10,11,12', 'sem'), ('Table 5', 'T5', '', '', '', '', '', '1,40', 'unknown'), ('text', NULL, '', '', '', '', '', '', 'unknown')) t(label, key, panels, ns, means, ratios, lengths, refs, bar)""")
def claims(spark, d):
    """Literal labels and claims; the driver's documents hold none."""
    df = spark.createDataFrame(_LABELS, "label string, body string, refs_text string")
    j = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    panels = F.when(F.col("label").rlike("^Fig[.] [0-9]+[a-z]"), text.panel_letters(F.regexp_extract("label", r"[0-9]+([a-z].*)$", 1))).otherwise(F.array().cast("array<string>"))
    b = F.col("body")
    return df.select("label", text.figure_key(F.col("label")).alias("key"), j(panels).alias("panels"), j(text.stated_ns(b)).alias("ns"), j(text.mean_error_claims(b)).alias("means"), j(text.ratio_claims(b)).alias("ratios"), j(text.lengths_um(b)).alias("lengths"), j(text.expanded_numbers(F.col("refs_text"))).alias("refs"), text.error_bar_kind(b).alias("bar"))


@query("""SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.k')) AS n_k FROM events GROUP BY event_type""")
def coerced_props(spark, d):
    """events.props as JSON under a forced schema; what does not fit is null."""
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k string", {"mode": "PERMISSIVE"}).alias("p"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count("p.k").alias("n_k"))
