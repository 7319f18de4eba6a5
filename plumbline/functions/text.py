"""Numbers, labels, cues and claims in text, as Columns; patterns avoid look-around so that other engines read them alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells that count as empty.
MISSING = ("", "na", "n/a", "nan", "null", "none", "-", "--", "#n/a", "#div/0!", "#value!", "#ref!", "inf", "-inf")


def parse_number(s: Column, decimal_comma: bool = False) -> Column:
    """A cell's number: thousands separators, decimal comma, percent sign, exponent; null if it is none."""
    t = F.trim(s)
    t = F.regexp_replace(F.regexp_replace(t, r"\.([0-9]{3})", "$1"), ",", ".") if decimal_comma else F.regexp_replace(t, r",([0-9]{3})", "$1")
    t = F.regexp_replace(t, r"\s*%$", "")
    return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))


def cell_kind(s: Column) -> Column:
    """empty, num or str."""
    return F.when(s.isNull() | F.lower(F.trim(s)).isin(*MISSING), "empty").when(parse_number(s).isNotNull(), "num").otherwise("str")


def normalized_title(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


def normalized_doi(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(s)), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", ""), r"[.,;)]+$", "")


def normalized_group(s: Column) -> Column:
    """Lower case, letters and digits only; + and - after a name become pos and neg."""
    t = F.regexp_replace(F.regexp_replace(F.lower(s), r"\+/\+", "wt"), r"-/-", "ko")
    return F.regexp_replace(t, "[^a-z0-9]+", "")


def tokens(s: Column, shortest: int = 3) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "), " "), lambda t: F.length(t) >= shortest)


def title_overlap(a: Column, b: Column) -> Column:
    """Common distinct words over those of the shorter title."""
    x, y = F.array_distinct(tokens(a, 1)), F.array_distinct(tokens(b, 1))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.least(F.size(x), F.size(y)).cast("double")), F.lit(0.0))


def redacted(s: Column, most: int | None = None) -> Column:
    """Without web addresses, DOIs, e-mail addresses and labelled ids (ORCID, PMID, PMCID); runs of line breaks squeezed; cut to `most` characters if given."""
    t = F.regexp_replace(s, r"https?://[^ \n\t]+", "[URL]")
    t = F.regexp_replace(t, r"10\.[0-9]{4,9}/[^ \n\t]+", "[DOI]")
    t = F.regexp_replace(t, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]")
    t = F.regexp_replace(t, r"[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]", "[ID]")
    t = F.regexp_replace(t, r"(?:PMID|pmid|PMCID|pmcid):? ?(?:PMC)?[0-9]+", "[ID]")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return t if most is None else F.substring(t, 1, most)


def safe_title(s: Column) -> Column:
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(F.regexp_replace(s, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", ""), 1, 80), F.lit("")), F.lit("untitled"))


# -- figures and panels -----------------------------------------------------------------------------


def figure_key(s: Column) -> Column:
    """Canonical key of a figure label: 1, S2, ED3 or T1; null if it is none."""
    n = F.regexp_extract(s, r"([0-9]+)", 1)
    low = F.lower(F.trim(s))
    return (
        F.when(n == "", F.lit(None).cast("string"))
        .when(low.rlike(r"^extended data"), F.concat(F.lit("ED"), n))
        .when(low.rlike(r"^(supp|supplementary|suppl)|^fig(ure|\.)? *s[0-9]"), F.concat(F.lit("S"), n))
        .when(low.rlike(r"^table"), F.concat(F.lit("T"), n))
        .when(low.rlike(r"^fig"), n)
    )


def panel_letters(s: Column) -> Column:
    """Letters of a panel run, lower-cased: "c-e" is c,d,e; "bcf" and "a, b" are their letters."""
    t = F.regexp_replace(F.lower(s), "[–—−]", "-")
    t = F.regexp_replace(F.regexp_replace(t, " and |&", ","), r"\s+", "")
    parts = F.regexp_extract_all(t, F.lit(r"([a-z]-[a-z]|[a-z])"), 1)
    codes = lambda p: F.sequence(F.ascii(F.substring(p, 1, 1)), F.ascii(F.substring(p, -1, 1)))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.transform(codes(p), lambda c: F.char(c))))))


def expanded_numbers(s: Column, widest: int = 20) -> Column:
    """Numbers of a citation list: "1-4, 7" is 1,2,3,4,7; ranges wider than `widest` stay their ends."""
    parts = F.regexp_extract_all(F.regexp_replace(F.regexp_replace(s, "[–—−]", "-"), r"\s+", ""), F.lit(r"([0-9]+-[0-9]+|[0-9]+)"), 1)

    def numbers(p: Column) -> Column:
        a, b = F.element_at(F.split(p, "-"), 1).cast("int"), F.element_at(F.split(p, "-"), -1).cast("int")
        return F.when((b >= a) & (b - a <= widest), F.sequence(a, F.greatest(a, b))).otherwise(F.array(a, b))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, numbers))))


# -- claims ------------------------------------------------------------------------------------------


def stated_ns(s: Column) -> Column:
    """All numbers stated as n = ..."""
    return F.transform(F.regexp_extract_all(s, F.lit(r"[nN] *= *([0-9]+)"), 1), lambda x: x.cast("long"))


def mean_error_claims(s: Column) -> Column:
    """"mean ± err" claims as text, like 1.2±0.3."""
    return F.transform(F.regexp_extract_all(s, F.lit(r"([0-9]+\.?[0-9]* *(?:±|\+/-) *[0-9]+\.?[0-9]*)"), 1), lambda x: F.regexp_replace(F.regexp_replace(x, " ", ""), r"\+/-", "±"))


def ratio_claims(s: Column) -> Column:
    """Ratios a:b of small whole numbers."""
    return F.transform(F.regexp_extract_all(s, F.lit(r"([0-9]{1,3} *: *[0-9]{1,3})"), 1), lambda x: F.regexp_replace(x, " ", ""))


def lengths_um(s: Column) -> Column:
    """Lengths in nm, µm or mm, in micrometres."""
    found = F.regexp_extract_all(s, F.lit(r"([0-9]+\.?[0-9]* *(?:nm|µm|μm|um|mm))"), 1)

    def um(x: Column) -> Column:
        unit = F.when(x.rlike("nm$"), 0.001).when(x.rlike("mm$"), 1000.0).otherwise(1.0)
        return F.regexp_extract(x, r"^([0-9]+\.?[0-9]*)", 1).cast("double") * unit

    return F.transform(found, um)


def error_bar_kind(s: Column) -> Column:
    """sem, sd, ci, range or unknown: the only one named; where several are, what stands as "± SEM", "mean (SD)" or "error bars ... SD", else unknown."""
    low = F.lower(s)
    kinds = {"sem": r"\bs\.?e\.?m\b|standard error", "sd": r"\bs\.?d\b|standard deviation", "ci": r"confidence interval|95% *ci", "range": r"min(imum)? to max|\brange\b"}
    named = F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(k)) for k, p in kinds.items())))
    shown = F.regexp_extract(low, r"(?:±|\+/-|error bars[^.;]*?|mean \() *\b(s\.?e\.?m|s\.?d|standard error|standard deviation|95% *ci|confidence interval|range)\b", 1)
    first = F.when(shown.rlike("^s[.]?e|error"), "sem").when(shown.rlike("^s[.]?d|deviation"), "sd").when(shown.rlike("ci|confidence"), "ci").when(shown == "range", "range")
    return F.when(F.size(named) == 1, named[0]).when(F.size(named) > 1, F.coalesce(first, F.lit("unknown"))).otherwise("unknown")


def disclosure(s: Column) -> Column:
    """explicit, weak or none: whether a text says that controls are shared."""
    low = F.lower(s)
    explicit = low.rlike(r"(same|shared|common) control|control[s]? (was|were) shared|controls? (is|are) the same")
    return F.when(explicit, "explicit").when(low.rlike(r"control (data|group)|previously (shown|reported)|pooled"), "weak").otherwise("none")


def polarity(s: Column) -> Column:
    """1 for increase, -1 for decrease, 0 for neither or both."""
    low = F.lower(s)
    up = low.rlike("increas|elevat|upregulat|higher|enhanc").cast("int")
    return up - low.rlike("decreas|reduc|downregulat|lower|impair").cast("int")
