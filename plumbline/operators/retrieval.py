"""Passages for claims: BM25 over an inverted index, then contradictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text


def _terms(docs: DataFrame, id_col: str, shortest: int) -> DataFrame:
    return docs.select(id_col, F.explode(text.tokens(F.col("text"), shortest)).alias("term"))


def bm25(queries: DataFrame, docs: DataFrame, k: int = 3, k1: float = 1.2, b: float = 0.75, shortest: int = 3) -> DataFrame:
    """(query, rank, doc, score): the k best documents (doc, text) of each query (query, text), scores above 0, ties by doc.

    Frequencies and lengths are over all documents; lengths are told where a text
    is read. Only terms of queries are counted and reach the join, so a posting
    list is joined once per query term, and a query's own frequency multiplies.
    """
    q = _terms(queries, "query", shortest).groupBy("query", "term").agg(F.count("*").alias("qtf"))
    size = docs.filter("text IS NOT NULL").select("doc", F.size(text.tokens(F.col("text"), shortest)).cast("long").alias("len")).filter("len > 0").groupBy("doc").agg(F.sum("len").alias("len"))
    total = size.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    asked = _terms(docs, "doc", shortest).join(q.select("term").distinct(), "term", "left_semi").groupBy("doc", "term").agg(F.count("*").alias("tf"))
    df = asked.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(total)).select("term", "avg_len", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    hits = asked.join(idf, "term").join(size, "doc").join(q, "term")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = hits.groupBy("query", "doc").agg(F.sum(part).alias("score")).filter("score > 0").withColumn("score", F.round("score", 6))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))
    return scored.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).select("query", "rank", "doc", "score")


def contradictions(reviewed: DataFrame) -> DataFrame:
    """Claims with their passage (claim_id, claim, passage, source_year): numeric, polarity and year contradictions as kinds.

    A claim without passage has status no_passage and no kinds.
    """
    percents = lambda c: F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(r"([0-9]+(?:\.[0-9]+)?) *%"), 1))
    years = F.regexp_extract_all("claim", F.lit(r"((?:19|20)[0-9]{2})"), 1)
    numeric = (F.size(percents("claim")) > 0) & (F.size(percents("passage")) > 0) & ~F.arrays_overlap(percents("claim"), percents("passage"))
    opposed = text.polarity(F.col("claim")) * text.polarity(F.col("passage")) < 0
    year = (F.size(years) > 0) & F.col("source_year").isNotNull() & ~F.array_contains(years, F.col("source_year").cast("string"))
    kinds = F.array_compact(F.array(F.when(numeric, F.lit("numeric")), F.when(opposed, F.lit("polarity")), F.when(year, F.lit("year"))))
    status = F.when(F.col("passage").isNull(), "no_passage").otherwise("reviewed")
    return reviewed.select("claim_id", status.alias("status"), F.when(F.col("passage").isNotNull(), F.array_join(kinds, ",")).otherwise("").alias("kinds"))
