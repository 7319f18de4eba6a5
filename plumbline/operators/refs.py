"""Keys against keys: references, labels, identifiers, catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import pairs
from plumbline.operators.storage import stored


def missing_entries(cites: DataFrame, bib: DataFrame) -> DataFrame:
    """Cited keys (doc, key) that the bibliography (doc, key, alias) has under neither name, once each."""
    known = bib.select("doc", "key").union(bib.select("doc", F.col("alias").alias("key")))
    return cites.select("doc", "key").distinct().join(known, ["doc", "key"], "left_anti")


def orphan_entries(bib: DataFrame, cites: DataFrame) -> DataFrame:
    """Entries that are cited under neither of their names."""
    cited = cites.select("doc", F.col("key").alias("k")).distinct()
    by_key = bib.join(cited, (bib.doc == cited.doc) & (bib.key == cited.k), "left_anti")
    again = cites.select(F.col("doc").alias("d"), F.col("key").alias("k")).distinct()
    return by_key.join(again, (F.col("doc") == F.col("d")) & (F.col("alias") == F.col("k")), "left_anti")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def conflicting_years(rows: DataFrame) -> DataFrame:
    """Entries (entry, text) with two or more different years in parentheses."""
    years = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\(((?:19|20)[0-9]{2})[a-z]?\)"), 1)))
    return rows.withColumn("years", years).filter(F.size("years") >= 2).select("entry", F.array_join("years", ",").alias("years"))


def id_sets(declared: DataFrame, omitted: DataFrame) -> DataFrame:
    """Full outer comparison of two id sets (source, id): matched, undeclared (omitted only) or phantom (declared only)."""
    a = declared.select("source", F.upper("id").alias("id")).distinct().withColumn("in_a", F.lit(True))
    b = omitted.select("source", F.upper("id").alias("id")).distinct().withColumn("in_b", F.lit(True))
    status = F.when(F.col("in_a").isNull(), "undeclared").when(F.col("in_b").isNull(), "phantom").otherwise("matched")
    return a.join(b, ["source", "id"], "full_outer").select("source", "id", status.alias("status"))


def disjoint_labels(config: DataFrame, table: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of same-keyed label sets (key, label), both of `least` labels at least, with none in common."""
    a = config.distinct().groupBy("key").agg(F.count("*").alias("n_config"))
    b = table.distinct().groupBy("key").agg(F.count("*").alias("n_table"))
    common = config.join(table, ["key", "label"], "left_semi").select("key").distinct()
    return a.join(b, "key").filter((F.col("n_config") >= least) & (F.col("n_table") >= least)).join(common, "key", "left_anti")


def missing_labels(cited: DataFrame, drawn: DataFrame) -> DataFrame:
    """Labels (figure, label) cited but not drawn, for figures with anything drawn at all."""
    return cited.distinct().join(drawn.select("figure").distinct(), "figure", "left_semi").join(drawn, ["figure", "label"], "left_anti")


def upsert(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; where keys meet, those of the first. Columns have to be equal."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def compared(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Full outer comparison: same, changed (with the names of the changed fields), only_left or only_right."""
    a = left.select(*keys, F.struct(*fields).alias("l"))
    b = right.select(*keys, F.struct(*fields).alias("r"))
    names = F.array_compact(F.array(*(F.when(~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}")), F.lit(f)) for f in fields)))
    status = F.when(F.col("r").isNull(), "only_left").when(F.col("l").isNull(), "only_right").when(F.size(names) > 0, "changed").otherwise("same")
    changed = F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), F.array_join(names, ",")).otherwise("")
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"), changed.alias("changed"))


def matched_by_priority(bib: DataFrame, files: DataFrame) -> DataFrame:
    """Entries (entry, doi, year, title) to files (file, doi, year, title): by DOI, else by year and title overlap of 0.6.

    status: matched, ambiguous (more than one by the best rule) or unmatched.
    """
    # Files of one DOI, and files of one year whose titles have the same words, are told once, by their smallest and largest name: one file or several.
    ends = (F.min("file").alias("low"), F.max("file").alias("high"))
    known = stored(files.filter("doi IS NOT NULL").groupBy("doi").agg(*ends), "by-doi").hint("merge")
    by_doi = bib.filter("doi IS NOT NULL").select("entry", "doi").join(known, "doi").select("entry", F.lit(1).alias("rule"), "low", "high")
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " "), " "), lambda t: F.length(t) > 2)))
    # Only entries whose DOI leads nowhere look for their title, by its rarest words within the year.
    open_entries = stored(bib.join(by_doi.select("entry").distinct(), "entry", "left_anti").select("entry", "year", words.alias("tokens")), "open").hint("merge")
    titled = stored(files.select("file", "year", words.alias("tokens")).groupBy("year", "tokens").agg(*ends), "titles").hint("merge")
    sides = open_entries.select("year", "tokens").distinct().withColumn("side", F.lit("entry")).union(titled.select("year", "tokens", F.lit("file")))
    met = pairs.overlapping(sides.select(F.col("year").alias("scope"), F.struct("side", "tokens").alias("id"), "tokens"), 0.6).filter("id_a.side <> id_b.side")
    of = lambda side: F.when(F.col("id_a.side") == side, F.col("id_a.tokens")).otherwise(F.col("id_b.tokens"))
    met = met.select(F.col("scope").alias("year"), of("entry").alias("asked"), of("file").alias("tokens"))
    by_title = met.join(titled, ["year", "tokens"]).groupBy("year", "asked").agg(F.min("low").alias("low"), F.max("high").alias("high")).withColumnRenamed("asked", "tokens")
    hits = by_doi.union(open_entries.join(by_title, ["year", "tokens"]).select("entry", F.lit(2).alias("rule"), "low", "high"))
    best = hits.groupBy("entry").agg(F.min("rule").alias("rule"), F.min(F.when(F.col("rule") == 1, F.col("low"))).alias("l1"), F.max(F.when(F.col("rule") == 1, F.col("high"))).alias("h1"), F.min("low").alias("l2"), F.max("high").alias("h2"))
    low, high = (F.when(F.col("rule") == 1, F.col(f"{x}1")).otherwise(F.col(f"{x}2")) for x in "lh")
    top = best.select("entry", "rule", low.alias("file"), F.when(low == high, 1).otherwise(2).alias("n"))
    status = F.when(F.col("n").isNull(), "unmatched").when(F.col("n") == 1, "matched").otherwise("ambiguous")
    return bib.select("entry").join(top, "entry", "left").select("entry", status.alias("status"), F.when(F.col("n") == 1, F.col("file")).alias("file"), "rule")
