"""Linking claims to data: tiers of evidence, the best one decides.

claims: (claim_id, figure, panel, group_key, n, and optionally anchor_fp, mean,
sd). tables: (source, figure, group_key, n, fp, mean, sd, and optionally panel:
the heading under which a group stands). A tier links a claim only if all its
hits come from one source. What a key leads to is told once per key - the number
of sources and the best hit - and claims join that table, so a key that very
many groups share costs one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import labels
from plumbline.operators import pairs
from plumbline.operators.storage import stored

# The tiers with their scores, the strongest first.
TIERS = {"heading": 100, "anchor_hash": 95, "unique_n": 90, "n_profile": 75, "anchor_stats": 70, "mean": 65, "n_and_group": 60, "cross_folder": 55, "synonym": 40}
HIT = ["source", "group_key", "n"]


def _best(order: Column | None = None) -> Column:
    return F.max_by(F.struct(*HIT), F.struct("n", "source", "group_key") if order is None else order).alias("hit")


def _by_key(tables: DataFrame, **keys: Column) -> DataFrame:
    """(keys, hit) of the keys that lead to one source."""
    each = tables.withColumns(keys).groupBy(*keys, "source").agg(_best())
    one = each.groupBy(*keys).agg(F.count("*").alias("sources"), F.first("hit").alias("hit")).filter("sources = 1")
    return one.drop("sources")


def _tier(hits: DataFrame, tier: str) -> DataFrame:
    return hits.select("claim_id", F.col("hit.source").alias("source"), F.col("hit.group_key").alias("linked_group"), F.col("hit.n").alias("linked_n"), F.lit(tier).alias("tier"), F.lit(TIERS[tier]).cast("long").alias("score"))


def _one_source(hits: DataFrame) -> DataFrame:
    """(claim_id, hit) of claims whose hits (claim_id, source, group_key, n) come from one source."""
    return hits.groupBy("claim_id").agg(F.min("source").alias("lo"), F.max("source").alias("hi"), _best()).filter("lo = hi")


def _near(c: DataFrame, t: DataFrame, width: float, log: bool, fits: Column) -> DataFrame:
    """Claims and groups of equal figure and n whose means lie in the same or neighbouring bands, and fit."""
    band = lambda x: F.floor((F.log(F.greatest(F.abs(x), F.lit(1e-3))) if log else x) / width)
    left = c.filter("mean IS NOT NULL").select("claim_id", "figure", F.col("n").alias("t_n"), F.col("mean").alias("c_mean"), F.col("sd").alias("c_sd")).withColumn("band", F.explode(F.array(*(band(F.col("c_mean")) + i for i in (-1, 0, 1)))))
    right = t.filter("mean IS NOT NULL").select("figure", F.col("n").alias("t_n"), "source", "group_key", "n", F.col("mean").alias("t_mean"), F.col("sd").alias("t_sd"), band(F.col("mean")).alias("band")).distinct()
    return left.join(right, ["figure", "t_n", "band"]).filter(fits)


def _abroad(c: DataFrame, t: DataFrame) -> DataFrame:
    """(claim_id, hit): claims whose n and group one source has outside the claim's own figure.

    A key that leads to more sources than the claim's own figure and one more
    cannot link, so at most two rows a key are left to look at.
    """
    keys = {"k_n": F.col("n"), "k_group": F.lower("group_key")}
    here = t.withColumns(keys).groupBy(*keys, "figure", "source").agg(_best()).groupBy(*keys, "figure").agg(F.count("*").alias("sources"), F.first("hit").alias("hit"))
    here = stored(here, "by-figure")
    total = here.groupBy(*keys).agg(F.sum("sources").alias("total"))
    asked = c.withColumns(keys).select("claim_id", *keys, F.col("figure").alias("c_figure")).join(total, list(keys))
    own = here.select(*keys, F.col("figure").alias("c_figure"), F.col("sources").alias("own"))
    one = asked.join(own, [*keys, "c_figure"], "left").filter(F.col("total") - F.coalesce("own", F.lit(0)) == 1)
    return one.join(here, list(keys)).filter("figure <> c_figure").select("claim_id", "hit")


def _profiles(c: DataFrame, t: DataFrame) -> DataFrame:
    """(claim_id, hit): claims of a panel whose list of n is a source's list of group sizes, or all of it but one (pairs.profile_matches)."""
    panel = F.to_json(F.struct("figure", "panel"))
    found = pairs.profile_matches(c.filter("n IS NOT NULL").select(panel.alias("claim_id"), "n"), t.select(F.col("source").alias("file_id"), "n")).select(F.col("claim_id").alias("panel_id"), F.col("file_id").alias("source"))
    each = c.withColumn("panel_id", panel).join(found, "panel_id").select("claim_id", "source", F.col("n").alias("c_n"))
    groups = t.groupBy("source", F.col("n").alias("c_n")).agg(_best())
    return each.join(groups, ["source", "c_n"]).select("claim_id", "hit")


def _synonyms(c: DataFrame, t: DataFrame) -> DataFrame:
    """(claim_id, hit): claims whose group, by its other names, is a group of the same figure under another name."""
    names = lambda d: d.withColumns({"token": F.explode(labels.expanded_keys(F.col("group_key"))), "plain": labels.group_token(F.col("group_key"))})
    keys = names(t).groupBy("figure", "token", "source").agg(_best(), F.min("plain").alias("plain")).groupBy("figure", "token").agg(F.count("*").alias("sources"), F.first("hit").alias("hit"), F.first("plain").alias("t_plain")).filter("sources = 1")
    hits = names(c).join(keys, ["figure", "token"]).filter("plain <> t_plain").select("claim_id", "hit.*")
    return _one_source(hits)


def candidates(claims: DataFrame, tables: DataFrame) -> DataFrame:
    """Every tier's link of every claim: (claim_id, source, linked_group, linked_n, tier, score)."""
    optional = lambda df, names: df.withColumns({x: F.lit(None).cast(kind) for x, kind in names.items() if x not in df.columns})
    t = stored(optional(tables, {"panel": "string", "fp": "string", "mean": "double", "sd": "double"}).select("source", "figure", "panel", "group_key", "n", "fp", "mean", "sd"), "tables")
    c = stored(optional(claims, {"anchor_fp": "string", "mean": "double", "sd": "double"}), "claims")
    figure, panel, n, group = F.col("figure"), F.col("panel"), F.col("n"), F.lower("group_key")
    at = lambda **keys: c.withColumns(keys).select("claim_id", *keys)
    hits = {
        "heading": at(k1=figure, k2=panel, k3=group).join(_by_key(t.filter("panel IS NOT NULL"), k1=figure, k2=panel, k3=group), ["k1", "k2", "k3"]),
        "anchor_hash": at(k1=F.col("anchor_fp")).join(_by_key(t.filter("fp IS NOT NULL"), k1=F.col("fp")), ["k1"]),
        "unique_n": at(k1=figure, k2=n).join(_by_key(t, k1=figure, k2=n), ["k1", "k2"]),
        "n_profile": _profiles(c, t),
        "anchor_stats": _one_source(_near(c, t, 1e-3, False, (F.abs(F.col("c_mean") - F.col("t_mean")) <= 1e-3) & (F.abs(F.col("c_sd") - F.col("t_sd")) <= 1e-3))),
        "mean": _one_source(_near(c, t, 0.1, True, F.abs(F.col("c_mean") - F.col("t_mean")) <= F.greatest(F.lit(0.05), 0.08 * F.abs("t_mean")))),
        "n_and_group": at(k1=figure, k2=n, k3=group).join(_by_key(t, k1=figure, k2=n, k3=group), ["k1", "k2", "k3"]),
        "cross_folder": _abroad(c, t),
        "synonym": _synonyms(c, t),
    }
    return reduce(DataFrame.unionByName, [_tier(found, tier) for tier, found in hits.items()])


def linked(claims: DataFrame, tables: DataFrame) -> DataFrame:
    """Each claim with its strongest link, or status unlinked."""
    best = candidates(claims, tables).groupBy("claim_id").agg(F.max_by(F.struct("source", "linked_group", "linked_n", "tier", "score"), "score").alias("l"))
    out = claims.select("claim_id", "figure", "panel", "group_key", "n").join(best, "claim_id", "left")
    return out.select("claim_id", "figure", "panel", "group_key", "n", "l.source", "l.linked_group", "l.linked_n", "l.tier", F.coalesce("l.score", F.lit(0).cast("long")).alias("score"), F.when(F.col("l").isNull(), "unlinked").otherwise("linked").alias("status"))


def resolved_tables(panels: DataFrame, files: DataFrame, least: int = 8) -> DataFrame:
    """(claim_id, path, score): the file with the best soft evidence for each panel (claim_id, figure, panel, group_key, n).

    files: (path, group_key, n). Files meet panels by group or by n within what
    their path allows. A file under another figure needs both. A rival file of
    the same n, or within two points, refuses the link unless the group matches.
    """
    f = files.select("path", labels.group_token(F.col("group_key")).alias("t_group"), F.col("n").alias("t_n"))
    p = panels.select("claim_id", "figure", "panel", labels.group_token(F.col("group_key")).alias("group"), "n")
    met = p.join(f, (F.col("group") == F.col("t_group")) & (F.col("group") != "")).union(p.join(f, F.col("n") == F.col("t_n"))).distinct()
    group_matched, n_matched = F.coalesce((F.col("group") == F.col("t_group")) & (F.col("group") != ""), F.lit(False)), F.coalesce(F.col("n") == F.col("t_n"), F.lit(False))
    claims, soft = labels.path_claims_figure(F.col("path"), F.col("figure")), labels.path_soft_compatible(F.col("path"), F.col("figure"))
    points = score_table(F.col("path"), F.col("figure"), F.col("panel"), group_matched, n_matched)
    scored = met.withColumns({"group_matched": group_matched, "n_matched": n_matched, "score": points, "other": ~soft & ~claims}).filter("(NOT other OR group_matched AND n_matched)").filter(F.col("score") >= least)
    per_file = scored.groupBy("claim_id", "path").agg(F.max("score").alias("score"), F.bool_or("group_matched").alias("group_matched"), F.bool_or("n_matched").alias("n_matched"))
    best = per_file.groupBy("claim_id").agg(F.max_by(F.struct("path", "score", "group_matched", "n_matched"), F.struct("score", F.col("group_matched").cast("int").alias("g"), "path")).alias("b"))
    rivals = per_file.join(best, "claim_id").filter((F.col("path") != F.col("b.path")) & ((F.col("n_matched") & F.col("b.n_matched")) | (F.col("score") >= F.col("b.score") - 2))).select("claim_id").distinct()
    return best.join(rivals.withColumn("rival", F.lit(True)), "claim_id", "left").filter("b.group_matched OR rival IS NULL").select("claim_id", "b.path", "b.score")


def score_table(path: Column, figure: Column, panel: Column, group_matched: Column, n_matched: Column) -> Column:
    """Points for a file as a panel's data: its folder or name names the figure, the panel, another figure; its groups and n match; it is plot data."""
    add = lambda c, w: F.when(F.coalesce(c, F.lit(False)), F.lit(w)).otherwise(0)
    claims, compatible, soft = labels.path_claims_figure(path, figure), labels.path_compatible(path, figure), labels.path_soft_compatible(path, figure)
    folder = labels.path_claims_figure(labels.experiment_unit(path), figure)
    names_panel = claims & labels.path_names_panel(path, figure, panel)
    other = labels.path_names_figure(path) & ~claims
    ext = F.lower(path).rlike(r"\.(csv|tsv|txt|xlsx|xls|pzfx)$")
    return add(folder, 12) + add(claims & ~folder, 8) + add(names_panel, 12) + add(other, -4) + F.when(compatible, 6).when(soft, 2).otherwise(-15) + add(group_matched, 10) + add(n_matched, 4) + add(labels.is_plot_table(path), 3) + add(ext, 1)


def weak_links(rows: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Guessed links (claim_id, n, linked_n, confidence) whose n is near the stated one and differs: within max(1, a fifth)."""
    near = F.abs(F.col("n") - F.col("linked_n")) <= F.greatest(F.lit(1.0), 0.2 * F.col("n"))
    return rows.filter((F.col("confidence") < threshold) & near & (F.col("n") != F.col("linked_n"))).select("claim_id", "n", "linked_n", "confidence")


def confidence(score: F.Column, tier: F.Column) -> F.Column:
    """Score over 100 within 0..1; 0 for soft links and none."""
    return F.when(tier.isNull() | (tier == "soft"), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score / 100.0)))


def n_matrix(cells: DataFrame, least: float = 0.4) -> DataFrame:
    """(figure, panel, group_key, manuscript, data, plot, stats, mismatch) of cells (figure, panel, group_key, side, n, confidence, lower_bound).

    A mismatch is more than one n among confident cells; a lower bound agrees with any n that is not below it.
    """
    keys = ["figure", "panel", "group_key"]
    sure = F.coalesce(F.col("confidence"), F.lit(0.0)) >= least
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("n"))).alias(s)
    exact = F.collect_set(F.when(sure & ~F.col("lower_bound"), F.col("n")))
    bound = F.max(F.when(sure & F.col("lower_bound"), F.col("n")))
    g = cells.groupBy(*keys).agg(side("manuscript"), side("data"), side("plot"), side("stats"), exact.alias("_exact"), bound.alias("_bound"))
    clash = (F.size("_exact") > 1) | F.coalesce(F.array_min("_exact") < F.col("_bound"), F.lit(False))
    return g.select(*keys, "manuscript", "data", "plot", "stats", clash.alias("mismatch"))


def n_findings(matrix: DataFrame, exclusion_mentioned: bool = False) -> DataFrame:
    """Mismatches as findings: more data than stated, with no exclusion told, is an undeclared exclusion; else an n mismatch."""
    more = (F.col("data") > F.col("manuscript")) & F.lit(not exclusion_mentioned)
    pattern = F.when(more, "P-EXCLUSION-UNDECLARED").otherwise("P-N-MISMATCH-LEGEND-VS-DATA")
    return matrix.filter("mismatch").select("figure", "panel", "group_key", pattern.alias("pattern_id"), "manuscript", "data")
