"""Where findings and metrics go."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_findings(findings: DataFrame, path: str) -> None:
    """JSON lines, one folder per pattern."""
    findings.withColumn("pattern", F.coalesce("pattern_id", F.lit("none"))).write.mode("overwrite").partitionBy("pattern").json(path)


def append_history(spark: SparkSession, kind: str, metrics: dict, path: str, at: str | None = None) -> None:
    """One more line of metrics; `at` is an ISO time, now if not given."""
    row = spark.createDataFrame([(kind, json.dumps(metrics, sort_keys=True), at)], "kind string, metrics string, at string")
    row.withColumn("at", F.coalesce("at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))).coalesce(1).write.mode("append").json(path)


def html_report(findings: DataFrame, title: str = "Findings") -> str:
    """A page with one row per finding, warnings first. Findings are read partition by partition; for the result of one screening, not for whole corpora."""
    rows = []
    for r in findings.orderBy("demoted", "pattern_id", "location").toLocalIterator():
        cells = (r["pattern_id"], r["severity"], r["location"], ", ".join(r["sources"] or []), json.dumps({**(r["metrics"] or {}), **(r["attrs"] or {})}, sort_keys=True))
        rows.append(f'<tr class="{html.escape(r["severity"])}">' + "".join(f"<td>{html.escape(str(c or ''))}</td>" for c in cells) + "</tr>")
    head = "".join(f"<th>{h}</th>" for h in ("pattern", "severity", "location", "sources", "details"))
    return f"<!DOCTYPE html><meta charset='utf-8'><title>{html.escape(title)}</title><table><tr>{head}</tr>{''.join(rows)}</table>"
