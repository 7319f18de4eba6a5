"""The rule catalog: filter, diff, mining of reasons, triage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The catalog's patterns with their priorities.
PATTERNS = {
    "P-DATA-SWAP-CROSS-CONDITION": "P0", "P-N-MISMATCH-LEGEND-VS-DATA": "P0", "P-N-INCONSISTENT-ACROSS-IDENTICAL-PLOTS": None, "P-IMAGE-REUSE-UNCITED": "P0",
    "P-IMAGE-DUPLICATE-INTERNAL": "P0", "P-FILENAME-CONTENT-MISMATCH": "P1", "P-SHARED-CONTROL-UNDISCLOSED": "P1", "P-STATS-RECALC-MISMATCH": "P0",
    "P-STAT-METHOD-INCONSISTENT": "P1", "P-CONFIG-ANNOTATION-MISMATCH": None, "P-REF-LABEL-MISMATCH": None, "P-IMAGE-PARTIAL-REUSE": "P0",
    "P-BLOT-LANE-REUSE": "P0", "P-VECTOR-SUBSET-UNDISCLOSED": "P0", "P-ERRORBAR-SEM-SD-MISMATCH": "P1", "P-STAT-MULTIPLICITY-GAP": "P1",
    "P-NUMERIC-CROSSREF-MISMATCH": "P0", "P-SCALE-MAG-INCONSISTENT": "P2", "P-COUNT-N-MISMATCH": "P2", "P-SOURCE-DUPLICATE-VALUES": "P0",
    "P-SOURCE-RATIO-ARTIFACT": "P0", "P-DERIVED-VALUE-PRECISION": "P2", "P-SURVIVAL-COUNT-NONINTEGER": "P1", "P-METHODS-CLAIM-MISMATCH": "P0",
    "P-EXCLUSION-UNDECLARED": "P0", "P-REF-MISSING-ENTRY": "P1", "P-REF-DUPLICATE-KEY": "P1", "P-REF-META-INCONSISTENT": "P1",
    "P-REF-ORPHAN-ENTRY": "P2", "P-REF-PDF-META-MISMATCH": "P1", "P-REF-CLAIM-CONTRADICTION": "P1", "P-SOURCE-DATA-CROSS-FIGURE-REUSE": "P0",
    "P-SOURCE-DATA-SUMMARY-MISMATCH": "P1", "P-SOURCE-DATA-POPULATION-SD": "P2", "P-SOURCE-DATA-LEGEND-N": "P0", "P-SOURCE-DATA-PANEL-REF-DUP": "P2",
    "P-SCALE-BAR-LEGEND-MISMATCH": "P1", "P-ANTIBODY-HOST-MISMATCH": "P1",
}


def rules(spark: SparkSession) -> DataFrame:
    """(pattern_id, priority, status, enabled): the 38 patterns; orphans are off unless asked for."""
    rows = [(p, prio, "implemented", p != "P-REF-ORPHAN-ENTRY") for p, prio in PATTERNS.items()]
    return spark.createDataFrame(rows, "pattern_id string, priority string, status string, enabled boolean")


def enabled(catalog: DataFrame) -> DataFrame:
    return catalog.filter(F.coalesce("enabled", F.col("status") == "implemented"))


def active(findings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Findings whose pattern is enabled, or that have none."""
    on = enabled(catalog).select("pattern_id")
    return findings.join(on.withColumn("_on", F.lit(True)), "pattern_id", "left").filter("_on OR pattern_id IS NULL").drop("_on")


def suppressed(findings: DataFrame, catalog: DataFrame) -> DataFrame:
    return findings.filter("pattern_id IS NOT NULL").join(enabled(catalog).select("pattern_id"), "pattern_id", "left_anti")


def status_counts(catalog: DataFrame) -> DataFrame:
    on = F.coalesce("enabled", F.col("status") == "implemented")
    return catalog.groupBy("status").agg(F.count("*").alias("n"), F.count_if(on).alias("n_enabled"))


def mined_reasons(records: DataFrame, mapping: DataFrame, prefixes: list[str]) -> DataFrame:
    """(reason, n, n_life, mapped) of records (id, subjects, reasons, both `;` lists); n_life counts those with a life-science subject.

    mapping: (reason, pattern_id). Reasons without a life-science record do not appear.
    """
    split = lambda c: F.filter(F.transform(F.split(F.col(c), ";"), lambda x: F.trim(x)), lambda x: x != "")
    life = F.exists(split("subjects"), lambda s: F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.contains(s, p)))
    each = records.select(F.explode(F.array_distinct(split("reasons"))).alias("reason"), F.coalesce(life, F.lit(False)).alias("life"))
    counts = each.groupBy("reason").agg(F.count("*").alias("n"), F.count_if("life").alias("n_life")).filter("n_life > 0")
    known = mapping.select("reason").distinct().withColumn("mapped", F.lit(True))
    return counts.join(known, "reason", "left").withColumn("mapped", F.coalesce("mapped", F.lit(False)))


def heat(mined: DataFrame, mapping: DataFrame) -> DataFrame:
    """(pattern_id, heat): the counts of a pattern's reasons."""
    return mined.join(mapping.distinct(), "reason").groupBy("pattern_id").agg(F.sum("n_life").alias("heat"))


def triage(hot: DataFrame, catalog: DataFrame, top: int = 25) -> DataFrame:
    """(pattern_id, heat, suggested, score): the hottest patterns with a suggested priority; a report of the `top` first."""
    j = hot.join(catalog.select("pattern_id", "status"), "pattern_id", "left")
    planned = F.col("status") == "planned"
    suggested = F.when(planned & (F.col("heat") >= 2000), "P0").when(planned & (F.col("heat") >= 500), "P1").when(planned, "P2").when(F.col("heat") >= 5000, "P0").otherwise("P1")
    return j.select("pattern_id", "heat", suggested.alias("suggested"), F.round(F.least(F.lit(1.0), F.col("heat") / 15000.0), 6).alias("score")).orderBy(F.desc("heat"), "pattern_id").limit(top)


def unmapped(mined: DataFrame, skipped: list[str], deferred: list[str]) -> DataFrame:
    """(reason, n_life, advice, score): reasons without a pattern; skip 0.1, defer 0.2, else what their number is worth, 0.85 at most."""
    r = mined.filter("NOT mapped")
    skip, defer = F.col("reason").isin(skipped), F.col("reason").isin(deferred)
    score = F.when(skip, 0.1).when(defer, 0.2).otherwise(F.least(F.lit(0.85), F.col("n_life") / 8000.0))
    return r.select("reason", "n_life", F.when(skip, "skip").when(defer, "defer").otherwise("propose").alias("advice"), F.round(score, 6).alias("score"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """A catalog file: JSON with a list `patterns` of objects, or one object a line. Missing fields are null."""
    schema = "pattern_id string, priority string, status string, enabled boolean, title string, locked boolean"
    whole = spark.read.schema(f"patterns array<struct<{', '.join(x.replace(' ', ': ') for x in schema.split(', ')).replace(': ', ':')}>>, {schema}").json(path, multiLine=True)
    return whole.select(F.explode(F.coalesce("patterns", F.array(F.struct(*(F.col(x.split()[0]) for x in schema.split(", ")))))).alias("p")).select("p.*").filter("pattern_id IS NOT NULL")


def save(catalog: DataFrame, path: str) -> None:
    """The catalog as JSON lines, one file, in place of what stands there."""
    catalog.orderBy("pattern_id").coalesce(1).write.mode("overwrite").json(path)


def as_yaml(catalog: DataFrame) -> DataFrame:
    """(pattern_id, text): every pattern as an entry of a YAML list; the catalog is bounded, so a caller may join the entries."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    lines = [F.concat(F.lit("- id: "), quoted("pattern_id"))] + [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"  {c}: "), quoted(c))) for c in ("priority", "status")] + [F.concat(F.lit("  enabled: "), F.coalesce("enabled", F.lit(False)).cast("string"))]
    return catalog.select("pattern_id", F.concat_ws("\n", *lines).alias("text"))


def synced(active: DataFrame, shipped: DataFrame) -> DataFrame:
    """The active catalog brought up to the shipped one: new patterns come in, priority and status follow it unless the pattern is locked by hand, `enabled` stays what it was."""
    a, s = active.alias("a"), shipped.alias("s")
    j = a.join(s, F.col("a.pattern_id") == F.col("s.pattern_id"), "full_outer")
    locked = F.coalesce(F.col("a.locked"), F.lit(False))
    field = lambda c: F.when(locked, F.col(f"a.{c}")).otherwise(F.coalesce(f"s.{c}", f"a.{c}")).alias(c)
    origin = F.when(F.col("a.pattern_id").isNull(), "added").when(F.col("s.pattern_id").isNull(), "own").when(locked, "locked").otherwise("synced")
    return j.select(F.coalesce("a.pattern_id", "s.pattern_id").alias("pattern_id"), field("priority"), field("status"), F.coalesce("a.enabled", "s.enabled").alias("enabled"), origin.alias("origin"))


def shared(catalog: DataFrame, fields: tuple[str, ...] = ("pattern_id", "priority", "status", "enabled")) -> DataFrame:
    """(payload): allowed fields of every pattern as JSON, nothing else of the catalog."""
    return catalog.select(F.to_json(F.struct(*(f for f in fields if f in catalog.columns))).alias("payload"))


def demoted_pictures(findings: DataFrame, panels: DataFrame) -> DataFrame:
    """findings (pattern_id, figure, panel, ..) with `demoted` for n patterns on panels (figure, panel, kind) that are pictures."""
    kinds = F.lit("P-N-MISMATCH-LEGEND-VS-DATA"), F.lit("P-N-INCONSISTENT-ACROSS-IDENTICAL-PLOTS"), F.lit("P-SOURCE-DATA-LEGEND-N"), F.lit("P-COUNT-N-MISMATCH")
    j = findings.join(panels, ["figure", "panel"], "left")
    return j.withColumn("demoted", F.col("pattern_id").isin(*kinds) & F.coalesce(F.col("kind") == "picture", F.lit(False))).drop("kind")
