"""Checks as findings: one schema, suppression and demotion by what the text discloses.

A finding: (finding_id, pattern_id, severity warning or info, demoted, location,
sources, metrics, attrs). Texts come as (doc, text); measurements as obs. All
emitters are lazy; `screened` unites them and applies the catalog.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import catalog, ordered, pairs, vectors

SCHEMA = "finding_id string, pattern_id string, severity string, demoted boolean, location string, sources array<string>, metrics map<string,double>, attrs map<string,string>"


def finding(df: DataFrame, pattern: str | Column, location: Column, sources: Column, metrics: dict[str, Column] | None = None, attrs: dict[str, Column] | None = None, weak: Column | None = None) -> DataFrame:
    """Rows of df as findings; where `weak` holds they are information only."""
    pair = lambda d, kind: F.map_filter(F.create_map(*(x for k, v in d.items() for x in (F.lit(k), v.cast(kind)))), lambda k, v: v.isNotNull()) if d else F.create_map().cast(f"map<string,{kind}>")
    pid = F.lit(pattern) if isinstance(pattern, str) else pattern
    weak = F.lit(False) if weak is None else F.coalesce(weak, F.lit(False))
    out = df.select(pid.alias("pattern_id"), F.when(weak, "info").otherwise("warning").alias("severity"), weak.alias("demoted"), location.alias("location"), sources.alias("sources"), pair(metrics or {}, "double").alias("metrics"), pair(attrs or {}, "string").alias("attrs"))
    key = F.concat_ws("\x1f", "pattern_id", "location", F.array_join(F.array_sort("sources"), "\x1e"), F.array_join(F.array_sort(F.map_keys("attrs")), ","), F.to_json("attrs"))
    return out.select(F.substring(F.sha2(key, 256), 1, 16).alias("finding_id"), *out.columns)


def disclosures(texts: DataFrame) -> DataFrame:
    """(doc, level, independent, exclusion, derived, t, corrected) of every manuscript (doc, text): what its text says of shared controls, independence, exclusions, normalisation and tests."""
    low = F.lower("text")
    rank = F.when(text.disclosure(F.col("text")) == "explicit", 2).when(text.disclosure(F.col("text")) == "weak", 1).otherwise(0)
    said = {
        "independent": "independent(ly)? (experiment|replicate|sample|cohort|biological)|biologically independent", "exclusion": "exclud|outlier|omitted",
        "derived": "normali[sz]ed|relative to|fold change|percent of control", "t": "t[- ]test", "corrected": "bonferroni|tukey|dunnett|holm|benjamini|fdr|multiple comparison|anova",
    }
    g = texts.groupBy("doc").agg(F.max(rank).alias("r"), *(F.coalesce(F.bool_or(low.rlike(p)), F.lit(False)).alias(c) for c, p in said.items()))
    return g.select("doc", F.when(F.col("r") == 2, "explicit").when(F.col("r") == 1, "weak").otherwise("none").alias("level"), *said)


def with_disclosures(rows: DataFrame, texts: DataFrame, manuscripts: DataFrame | None) -> DataFrame:
    """rows (source, ..) with what their manuscript's text says; manuscripts: (source, doc), one each. Without it all sources and texts are one manuscript's. A source without a manuscript has no text."""
    if manuscripts is None:
        told, of = F.broadcast(disclosures(texts.withColumn("doc", F.lit("")))), rows.withColumn("doc", F.when(F.col("source").isNotNull(), F.lit("")))
    else:
        told, of = disclosures(texts).withColumn("doc", F.col("doc").cast("string")), rows.join(manuscripts.select("source", F.col("doc").cast("string").alias("doc")), "source", "left")
    named = of.join(told, "doc", "left")
    return named.withColumns({"level": F.coalesce("level", F.lit("none")), **{c: F.coalesce(c, F.lit(False)) for c in ("independent", "exclusion", "derived", "t", "corrected")}})


def duplicates(v: DataFrame, least: int = 4) -> DataFrame:
    """One finding for every group that stands behind its class' first one, and for the first one none."""
    d = pairs.duplicates_within_source(v, least).filter("group_key <> class_group")
    return finding(d, "P-SOURCE-DUPLICATE-VALUES", F.concat_ws(": ", "source", F.concat_ws(" = ", "class_group", "group_key")), F.array("source"), {"n": F.col("n"), "n_links": F.col("n_links")}, {"group_a": F.col("class_group"), "group_b": F.col("group_key")})


def ratios(v: DataFrame, least: int = 4) -> DataFrame:
    d = pairs.ratios_within_source(v, least)
    return finding(d, "P-SOURCE-RATIO-ARTIFACT", F.concat_ws(": ", "source", F.concat_ws(" / ", "group_a", "group_b")), F.array("source"), {"k": F.col("k"), "n": F.col("n")}, {"group_a": F.col("group_a"), "group_b": F.col("group_b")})


def shared_controls(v: DataFrame, texts: DataFrame, least: int = 4, manuscripts: DataFrame | None = None) -> DataFrame:
    """Control-like vectors that several sources hold. A manuscript's explicit disclosure drops its own, a weak one demotes them."""
    d = pairs.equal_across_sources(v.filter(pairs.control_like(F.col("group_key"))), least)
    d = with_disclosures(d, texts, manuscripts).filter("level <> 'explicit'")
    return finding(d, "P-SHARED-CONTROL-UNDISCLOSED", F.concat_ws(": ", "source", "group_key"), F.array("source", "class_source"), {"n_links": F.col("n_links"), "n": F.col("n")}, {"class_group": F.col("class_group")}, F.col("level") == "weak")


def vector_subsets(v: DataFrame, texts: DataFrame, least: int = 4, manuscripts: DataFrame | None = None) -> DataFrame:
    """Groups of a source of which one holds the other's values, where its manuscript claims independence."""
    d = pairs.shares_within_source(v, least).filter("kind IN ('subset', 'endpoint_dropout')")
    d = with_disclosures(d, texts, manuscripts).filter("independent AND level <> 'explicit'")
    return finding(d, "P-VECTOR-SUBSET-UNDISCLOSED", F.concat_ws(": ", "source", F.concat_ws(" / ", "group_a", "group_b")), F.array("source"), None, {"kind": F.col("kind")}, F.col("level") == "weak")


def derived_values(obs: DataFrame, texts: DataFrame, manuscripts: DataFrame | None = None) -> DataFrame:
    """Sources with computed-looking groups; a manuscript that tells of normalisation demotes its own."""
    d = vectors.derived_precision(obs).filter("kind IS NOT NULL").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("group_key")), ",").alias("groups"), F.sum("n_repeating").alias("r"), F.sum("n_excess").alias("e"))
    d = with_disclosures(d, texts, manuscripts)
    return finding(d, "P-DERIVED-VALUE-PRECISION", F.col("source"), F.array("source"), {"n_repeating": F.col("r"), "n_excess": F.col("e")}, {"groups": F.col("groups")}, F.col("derived"))


def multiplicity_gap(obs: DataFrame, texts: DataFrame, least: int = 3, manuscripts: DataFrame | None = None) -> DataFrame:
    """Sources with three groups at least, whose manuscript names t-tests and no correction."""
    g = obs.groupBy("source", "group_key").agg(F.count("value").alias("n")).filter("n >= 2").groupBy("source").agg(F.count("*").alias("k")).filter(F.col("k") >= least)
    g = with_disclosures(g, texts, manuscripts).filter("t AND NOT corrected")
    return finding(g, "P-STAT-MULTIPLICITY-GAP", F.col("source"), F.array("source"), {"n_groups": F.col("k")})


def stat_method(texts: DataFrame, scripts: DataFrame) -> DataFrame:
    """ANOVA in the text, only t-tests in the scripts (path, code)."""
    low, code = F.lower("text"), F.lower("code")
    t = texts.agg(F.coalesce(F.bool_or(low.rlike("anova")), F.lit(False)).alias("anova"))
    s = scripts.agg(F.coalesce(F.bool_or(code.rlike(r"t\.test|ttest")), F.lit(False)).alias("t"), F.coalesce(F.bool_or(code.rlike(r"aov|anova|f_oneway|lm\(")), F.lit(False)).alias("f"), F.array_sort(F.collect_set(F.when(code.rlike(r"t\.test|ttest"), F.col("path")))).alias("paths"))
    return finding(t.crossJoin(s).filter("anova AND t AND NOT f"), "P-STAT-METHOD-INCONSISTENT", F.lit("methods"), F.col("paths"))


def survival(curves: DataFrame) -> DataFrame:
    """One finding per curve with points that no whole number explains; curves (.., approximate) are left out where n0 is approximate."""
    c = curves.filter(~F.coalesce(F.col("approximate"), F.lit(False))) if "approximate" in curves.columns else curves
    g = ordered.survival_audit(c).groupBy("curve").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return finding(g, "P-SURVIVAL-COUNT-NONINTEGER", F.col("curve").cast("string"), F.array(F.col("curve").cast("string")), {"n_points": F.col("n"), "first": F.col("first")})


def side_conflicts(paths: DataFrame, sides: list[str]) -> DataFrame:
    """Folders whose files (path) name two sides at least."""
    words = F.array(*map(F.lit, sides))
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    d = paths.select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.explode(F.filter(words, lambda s: F.contains(name, s))).alias("side"), "path")
    g = d.groupBy("dir").agg(F.array_sort(F.collect_set("side")).alias("found"), F.array_sort(F.collect_set("path")).alias("paths")).filter(F.size("found") >= 2)
    return finding(g, "P-FILENAME-CONTENT-MISMATCH", F.col("dir"), F.col("paths"), None, {"sides": F.array_join("found", ",")})


def screened(obs: DataFrame, texts: DataFrame, rules: DataFrame, least: int = 4, manuscripts: DataFrame | None = None) -> DataFrame:
    """All checks that measurements and texts allow, without what the catalog turns off."""
    v = vectors.vectors(obs)
    parts = [duplicates(v, least), ratios(v, least), shared_controls(v, texts, least, manuscripts), vector_subsets(v, texts, least, manuscripts), derived_values(obs, texts, manuscripts), multiplicity_gap(obs, texts, manuscripts=manuscripts)]
    return catalog.active(reduce(DataFrame.unionByName, parts), rules)
