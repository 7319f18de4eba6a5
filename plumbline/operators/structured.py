"""Extractor output as JSON: forced into a schema, checked, flattened, voted on.

Extraction may use a model; it comes in as a column of text that a pandas UDF of
the user's choice has made, and everything after that is deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a legend's extraction may hold.
LEGEND = "panels array<struct<panel:string,group:string,n:long,n_max:long,confidence:double>>, tests array<string>, p_values array<string>, citation boolean, error_bar_type string, independence_claims array<string>, exclusion_criteria array<string>"
ERROR_BARS = ("sem", "sd", "ci", "range", "unknown")


def json_object(raw: Column) -> Column:
    """The stretch from a text's first { to its last }, null if there is none."""
    return F.nullif(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), F.lit(""))


def coerced(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df with `legend`: the JSON in column raw under LEGEND. Panels without a letter or with n below 1 go, unknown error bars become unknown, letters are lower-cased."""
    parsed = F.from_json(json_object(F.col(raw)), LEGEND, {"mode": "PERMISSIVE"})
    panels = F.transform(F.filter(F.coalesce("_p.panels", F.array().cast("array<struct<panel:string,group:string,n:long,n_max:long,confidence:double>>")), lambda p: p["panel"].isNotNull() & (F.length(F.trim(p["panel"])) > 0) & (p["n"] >= 1)), lambda p: p.withField("panel", F.lower(F.trim(p["panel"]))).withField("n_max", F.when(p["n_max"] >= p["n"], p["n_max"])))
    bars = F.when(F.lower("_p.error_bar_type").isin(*ERROR_BARS), F.lower("_p.error_bar_type")).otherwise("unknown")
    out = df.withColumn("_p", parsed)
    return out.withColumn("legend", F.when(F.col("_p").isNotNull(), F.col("_p").withField("panels", panels).withField("error_bar_type", bars))).drop("_p")


def errors(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df with `errors`: what is wrong with the JSON in column raw, empty if nothing."""
    obj = json_object(F.col(raw))
    p = F.from_json(obj, LEGEND, {"mode": "PERMISSIVE"})
    bad = F.size(F.filter(F.coalesce(p["panels"], F.array().cast("array<struct<panel:string,group:string,n:long,n_max:long,confidence:double>>")), lambda x: x["panel"].isNull() | x["n"].isNull() | (x["n"] < 1)))
    return df.withColumn("errors", F.array_compact(F.array(F.when(obj.isNull(), F.lit("no object")), F.when(obj.isNotNull() & p["panels"].isNull(), F.lit("no panels")), F.when(bad > 0, F.lit("bad panels")))))


def panel_ns(df: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """(keys, panel, group, n, n_max) of coerced legends; panels whose confidence is below `least` go, those without one stay."""
    p = df.select(*keys, F.explode("legend.panels").alias("p")).filter(F.coalesce("p.confidence", F.lit(1.0)) >= least)
    return p.select(*keys, "p.panel", F.coalesce("p.group", F.lit("")).alias("group"), "p.n", "p.n_max")


def voted(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, panel, group, n) that both readings have."""
    on = [*keys, "panel", "group", "n"]
    return a.select(*on).distinct().join(b.select(*on).distinct(), on, "left_semi")


def extraction_scores(gold: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(recall, precision, f1, n_forbidden) of found (keys, panel, group, n) against gold (keys, panel, group, n, n_max, forbidden): a gold range takes any n within it; found rows on forbidden panels count apart."""
    on = [*keys, "panel", "group"]
    want, never = gold.filter("NOT forbidden"), gold.filter("forbidden").select(*keys, "panel").distinct()
    seen = found.select(*on, F.col("n").alias("_n")).distinct()
    hits = want.join(seen, on).filter((F.col("_n") >= F.col("n")) & (F.col("_n") <= F.coalesce("n_max", "n")))
    count = lambda d, name: d.agg(F.count("*").alias(name))
    all_ = count(hits.select(*on, "n").distinct(), "h").crossJoin(count(want.select(*on, "n").distinct(), "g")).crossJoin(count(seen, "f")).crossJoin(count(hits.select(*on, "_n").distinct(), "hf")).crossJoin(count(seen.join(never, [*keys, "panel"], "left_semi"), "bad"))
    recall, precision = F.coalesce(F.try_divide(F.col("h").cast("double"), F.col("g")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("hf").cast("double"), F.col("f")), F.lit(0.0))
    return all_.select(recall.alias("recall"), precision.alias("precision"), F.coalesce(F.try_divide(2 * recall * precision, recall + precision), F.lit(0.0)).alias("f1"), F.col("bad").alias("n_forbidden"))


def panel_map(answers: DataFrame, letters: str = "abcdefghijklmnopqrstuvwxyz") -> DataFrame:
    """(id, panel, kind, n) of answers (id, body: JSON of panels by letter): letters lower-cased, kinds other than plot, picture, diagram and table unknown, n as a number where it is one."""
    read = answers.withColumn("m", F.from_json("body", "map<string,struct<kind:string,n:string>>", {"mode": "PERMISSIVE"}))
    each = read.select("id", F.explode("m").alias("letter", "p"))
    panel = F.lower(F.trim("letter"))
    kind = F.when(F.lower("p.kind").isin("plot", "picture", "diagram", "table"), F.lower("p.kind")).otherwise("unknown")
    return each.filter(panel.isin(*letters)).groupBy("id", panel.alias("panel")).agg(F.min(kind).alias("kind"), F.max(F.col("p.n").try_cast("long")).alias("n"))


def extractor_status(runs: DataFrame) -> DataFrame:
    """(extractor, n, n_ok, n_empty, n_failed, seconds, status) of an extractor's calls (extractor, ok, n_rows, seconds)."""
    g = runs.groupBy("extractor").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.count_if(F.col("ok") & (F.col("n_rows") == 0)).alias("n_empty"), F.count_if(~F.col("ok")).alias("n_failed"), F.round(F.sum("seconds"), 3).alias("seconds"))
    status = F.when(F.col("n_ok") == 0, "failed").when(F.col("n_failed") > 0, "partial").when(F.col("n_empty") == F.col("n"), "empty").otherwise("ok")
    return g.withColumn("status", status)


def vocabulary(configs: DataFrame) -> DataFrame:
    """(kind, key, word) of users' vocabularies (body: JSON with sides, aliases and groups, each a map of words): what rules are parametrised with."""
    schema = "sides map<string,array<string>>, aliases map<string,array<string>>, groups map<string,array<string>>"
    read = configs.select(F.from_json("body", schema, {"mode": "PERMISSIVE"}).alias("c"))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"c.{k}").alias("m")) for k in ("sides", "aliases", "groups")))
    each = read.select(F.explode(kinds).alias("k")).filter("k.m IS NOT NULL").select("k.kind", F.explode("k.m").alias("key", "words"))
    return each.select("kind", "key", F.explode("words").alias("word")).select("kind", F.lower("key").alias("key"), F.lower(F.trim("word")).alias("word")).filter("word <> ''").distinct()
