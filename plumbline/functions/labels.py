"""Figure labels, paths and group names as Columns: what belongs to which figure, and what is the same group under another name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import panel_letters

# Names that stand for the same kind of group.
SYNONYMS = (
    ("wt", "wildtype", "wild", "control", "ctrl", "cont", "vehicle", "0"),
    ("mut", "mutant", "ko", "null", "knockout"),
    ("kd", "knockdown", "rnai", "sirna"),
)
# Endings of gene names that tell a genotype.
GENOTYPES = ("null", "mutant", "mut", "ko", "kd", "rnai", "het", "wt")
# Words of paths that tell an experiment.
PATH_WORDS = ("control", "wt", "kd", "rnai")


def compact(path: Column) -> Column:
    """Lower case without spaces, underscores and dashes."""
    return F.regexp_replace(F.lower(path), r"[ _-]+", "")


def file_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def _plain(number: Column) -> Column:
    return F.regexp_replace(F.upper(number.cast("string")), r"^(S?)0+([0-9])", "$1$2")


def path_figures(path: Column) -> Column:
    """Numbers of all figures that a path names: 3, S2."""
    return F.array_distinct(F.transform(F.regexp_extract_all(compact(path), F.lit(r"fig(?:ure)?\.?(s?[0-9]+)"), 1), _plain))


def path_names_figure(path: Column) -> Column:
    return F.size(path_figures(path)) > 0


def path_claims_figure(path: Column, figure: Column) -> Column:
    """The path names this figure; a supplementary one also by the folder of supplements. Without a figure every path does."""
    own = F.array_contains(path_figures(path), _plain(figure))
    supplement = F.startswith(_plain(figure), F.lit("S")) & compact(path).rlike("supplement|suppinfo|figsupp")
    return F.when(figure.isNull(), True).otherwise(F.coalesce(own | supplement, F.lit(False)))


def is_plot_table(path: Column) -> Column:
    """Exports of plots: Prism files, spreadsheets named graph* or quant_*, Source Data workbooks."""
    name = file_name(path)
    return name.rlike(r"\.pzfx?$") | name.rlike(r"^(graph|quant_).*\.(xlsx|xls|csv)$") | name.rlike(r"source[ _-]?data.*\.(xlsx|xls)$")


def is_count_table(path: Column) -> Column:
    return file_name(path).rlike("colon(y|ies)|count|gate|event|cfu|foci")


def path_compatible(path: Column, figure: Column) -> Column:
    """The path claims the figure, or names none and is an export of a plot."""
    return path_claims_figure(path, figure) | (~path_names_figure(path) & is_plot_table(path) & ~F.startswith(F.coalesce(_plain(figure), F.lit("")), F.lit("S")))


def path_soft_compatible(path: Column, figure: Column) -> Column:
    """Nothing in the path speaks for another figure; any path may hold a supplementary figure's data."""
    return path_compatible(path, figure) | ~path_names_figure(path) | F.coalesce(F.startswith(_plain(figure), F.lit("S")), F.lit(False))


def path_names_panel(path: Column, figure: Column, panel: Column) -> Column:
    """fig2b, panel_b or pan-b."""
    p = F.lower(panel)
    name = F.concat(F.lit("(fig(ure)?"), F.lower(figure.cast("string")), p, F.lit("|pan(el)?"), p, F.lit(")([^a-z0-9]|$)"))
    return F.coalesce(F.regexp_like(compact(path), name), F.lit(False))


def experiment_unit(path: Column) -> Column:
    """The folder that bundles an experiment: the nearest one named for a figure, else what stands below data/, else the file's own."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    order = F.transform(folders, lambda f, i: F.when(F.lower(f).rlike(r"^(ed[ _-]*)?fig(ure)?[ ._-]*s?[0-9]+"), i + 1).otherwise(0))
    by_figure = F.array_max(order)
    at_data = F.array_position(F.transform(folders, F.lower), "data").cast("int")
    below = F.when(by_figure > 0, by_figure).when(at_data > 0, F.least(at_data + 1, F.size(folders))).otherwise(F.size(folders))
    return F.array_join(F.slice(folders, F.lit(1), F.greatest(below, F.lit(0))), "/")


def figure_from_filename(path: Column) -> Column:
    """(number, panels, extended) of the one figure that a file's name tells, else null."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z0-9]+$", "")
    pattern = r"(?i)((?:ed|ext|extended)[ _-]*(?:data)?[ _-]*)?fig(?:ure|s)?[ ._-]*(s?[0-9]+)([a-z]{0,3})(?:[^a-z0-9]|$)"
    part = lambda g: F.regexp_extract(stem, pattern, g)
    return F.when(F.size(F.regexp_extract_all(F.lower(stem), F.lit(r"fig(?:ure|s)?[ ._-]*s?[0-9]+"), 0)) == 1, F.struct(_plain(part(2)).alias("number"), panel_letters(part(3)).alias("panels"), (part(1) != "").alias("extended")))


def figure_label(s: Column) -> Column:
    """(number, panels, extended) of a string that is a figure label as a whole: "Extended Data Fig. 4c-e", "Supp Fig 2", "S3b"; else null."""
    t = F.trim(s)
    pattern = r"(?i)^(extended data |ed |ext\.? data |supp(?:lementary|l)?\.? )?(fig(?:ure|s)?\.? ?)?(s?[0-9]{1,2}) ?((?:[a-z](?: ?(?:[-–,&+]| and ) ?)?){0,8})[.:]?$"
    part = lambda g: F.regexp_extract(t, pattern, g)
    letters = F.regexp_replace(F.lower(part(4)), "and", ",")
    runs = F.filter(F.split(letters, r"[^a-z]+"), lambda r: F.length(r) > 0)
    rising = F.forall(runs, lambda r: F.array_join(F.array_sort(F.array_distinct(F.split(r, ""))), "") == r)
    prefix = F.when(F.lower(part(1)).startswith("supp") & ~F.upper(part(3)).startswith("S"), "S").otherwise("")
    named = (part(2) != "") | (part(1) != "") | F.upper(part(3)).startswith("S")
    number = F.concat(prefix, _plain(part(3)))
    return F.when((F.length(t) <= 60) & named & (part(3) != "") & rising, F.struct(number.alias("number"), panel_letters(letters).alias("panels"), F.lower(part(1)).rlike("^e").alias("extended")))


def sheet_label(sheet: Column, file_number: Column, short_names: Column) -> Column:
    """(number, panels) that a sheet's name tells: a whole label, or, where sheets are named that way, "2a" or only letters of the file's figure."""
    full = figure_label(sheet)
    short = lambda g: F.regexp_extract(F.trim(sheet), r"(?i)^(s?[0-9]{0,2}) ?([a-z]{1,6})(?:[._ ]?p?[0-9]+)?$", g)
    letters = F.lower(short(2))
    rising = (letters != "") & (F.array_join(F.array_sort(F.array_distinct(F.split(letters, ""))), "") == letters)
    number = F.when(short(1) != "", _plain(short(1))).otherwise(file_number.cast("string"))
    return F.when(full.isNotNull(), F.struct(full["number"].alias("number"), full["panels"].alias("panels"))).when(short_names & rising & number.isNotNull(), F.struct(number.alias("number"), panel_letters(letters).alias("panels")))


def experiment_tokens(path: Column, words: tuple[str, ...] = PATH_WORDS) -> Column:
    """Words of a vocabulary and figures (fig3) that a path holds."""
    flat = compact(path)
    found = F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(flat, w))
    return F.array_sort(F.array_union(found, F.transform(path_figures(path), lambda f: F.concat(F.lit("fig"), F.lower(f)))))


def experiments_distinct(a: Column, b: Column) -> Column:
    """Two paths speak of different experiments, or one of none."""
    x, y = experiment_tokens(a), experiment_tokens(b)
    return (F.size(x) == 0) | (F.size(y) == 0) | (x != y)


def group_from_path(path: Column) -> Column:
    """cont, wt or all by a file's name."""
    stem = compact(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z0-9]+$", ""))
    return F.when(stem.startswith("cont") | F.contains(stem, F.lit("control")), "cont").when(stem.startswith("wt") | F.contains(stem, F.lit("wildtype")), "wt").otherwise("all")


def group_token(s: Column) -> Column:
    """Lower case letters and digits only; genotype signs become words: -/- null, +/- het, +/+ wt."""
    t = F.regexp_replace(F.lower(F.trim(s)), "[−–—]", "-")
    for sign, word in ((r"-\s*/\s*-", "null"), (r"\+\s*/\s*-", "het"), (r"\+\s*/\s*\+", "wt")):
        t = F.regexp_replace(t, sign, word)
    return F.regexp_replace(t, "[^a-z0-9]+", "")


def expanded_keys(s: Column) -> Column:
    """A group's token, its gene with every genotype ending if it has one, and all synonyms of what it is; sorted."""
    token = group_token(s)
    ends = "|".join(sorted(GENOTYPES, key=len, reverse=True))
    stem = F.regexp_extract(token, rf"^([a-z][a-z0-9]*?)({ends})$", 1)
    family = F.array(*(F.lit(e) for e in ("mutant", "mut", "null", "ko")))
    kin = F.when(stem != "", F.concat(F.array(stem), F.transform(family, lambda e: F.concat(stem, e)))).otherwise(F.array().cast("array<string>"))
    same = F.flatten(F.array(*(F.when(F.array_contains(F.array(*map(F.lit, g)), token), F.array(*map(F.lit, g))).otherwise(F.array().cast("array<string>")) for g in SYNONYMS)))
    return F.array_sort(F.filter(F.array_distinct(F.concat(F.array(token), kin, same)), lambda x: x != ""))


def figure_order(number: Column) -> Column:
    """Sorts figures as read: 1, 2, 10, then S1, S2, then the rest."""
    digits = F.regexp_extract(number, r"([0-9]+)", 1).try_cast("int")
    return F.struct(F.when(number.rlike("^[0-9]+$"), 0).when(number.rlike("(?i)^s"), 1).otherwise(2).alias("kind"), digits.alias("n"), number.alias("text"))


def cleaned_legend(s: Column) -> Column:
    """Thin and hard spaces as plain ones, zero-width characters gone."""
    return F.regexp_replace(F.regexp_replace(s, "[  -   　]", " "), "[​-‍⁠﻿­]", "")


def referenced_panels(s: Column) -> Column:
    """(figure, panel) references of a text, "Fig. 1c-e" and "Figs 2a, S3b" as one each."""
    found = F.regexp_extract_all(s, F.lit(r"(?i)(?:figs?|figures?)\.? ?(s?[0-9]{1,2} ?[a-z](?: ?[-–] ?[a-z])?(?:, ?[a-z](?: ?[-–] ?[a-z])?(?![a-z]))*)(?![a-z])"), 1)

    def each(ref: Column) -> Column:
        number = _plain(F.regexp_extract(ref, r"(?i)^(s?[0-9]+)", 1))
        return F.transform(panel_letters(F.regexp_replace(ref, r"(?i)^s?[0-9]+", "")), lambda p: F.struct(number.alias("figure"), p.alias("panel")))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(found, each))))


def mentioned_figures(s: Column, widest: int = 8) -> Column:
    """Numbers of figures that a text mentions; a range counts whole if it is no wider than `widest`."""
    found = F.regexp_extract_all(s, F.lit(r"(?i)(?:figs?|figures?)\.? ?(s?[0-9]{1,2}(?: ?[-–] ?s?[0-9]{1,2})?)"), 1)

    def each(ref: Column) -> Column:
        prefix = F.when(F.upper(ref).startswith("S"), "S").otherwise("")
        ends = F.transform(F.regexp_extract_all(ref, F.lit(r"([0-9]+)"), 1), lambda d: d.cast("int"))
        lo, hi = F.element_at(ends, 1), F.element_at(ends, -1)
        numbers = F.when((hi >= lo) & (hi - lo <= widest), F.sequence(lo, F.greatest(lo, hi))).otherwise(ends)
        return F.transform(numbers, lambda n: F.concat(prefix, n.cast("string")))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(found, each))))
