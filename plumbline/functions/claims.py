"""What sentences state: means, counts, comparisons, cohorts, exclusions, scales, citations. All as Columns of arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"
# Words that are no groups of a comparison.
NO_GROUPS = ("the", "a", "an", "and", "or", "of", "in", "for", "to", "all", "each", "other", "both", "versus", "vs")
# States of an id in a table that say it was left out, or kept.
LEFT_OUT, KEPT = ("0", "false", "no", "n", "out", "exclude", "excluded", "omit", "omitted", "drop", "dropped", "removed"), ("1", "true", "yes", "y", "in", "include", "included", "keep", "kept")


def _all(s: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(s, F.lit(pattern), group)


def _group(x: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(x, pattern, group)


def mean_claims(s: Column) -> Column:
    """Numbers stated as a mean or average: "mean of 4.2", "averaged 7", "mean = 3.1"."""
    p = rf"(?i)\b(?:mean|average)[a-z]*(?: (?:value|weight|length|score|size))?(?: ?[=:] ?| (?:of|was|is|at) | )({NUMBER})"
    return F.array_distinct(F.transform(_all(s, p, 1), lambda x: x.cast("double")))


def numeric_hints(s: Column) -> Column:
    """(label, mean, err, n) of "label: 4.2 ± 0.3 (n = 8)"; err and n may be missing."""
    p = rf"([A-Za-z][A-Za-z0-9+/-]*) ?[:=,] ?({NUMBER}) ?(?:±|\+/-) ?({NUMBER})(?: ?\(n ?= ?([0-9]+)\))?"
    one = lambda x: F.struct(F.lower(_group(x, p, 1)).alias("label"), _group(x, p, 2).cast("double").alias("mean"), _group(x, p, 3).cast("double").alias("err"), F.nullif(_group(x, p, 4), F.lit("")).cast("long").alias("n"))
    return F.array_distinct(F.transform(_all(s, p), one))


def counted(s: Column) -> Column:
    """(n, what) of counts in legends: "8 colonies", "12 cells", and "n = 8 (A)" with the letter."""
    words = r"(?i)\b([0-9]+) (colonies|cells|animals|mice|flies|larvae|embryos|fields|events|foci|replicates|experiments|samples|wells|worms|plants)\b"
    letters = r"(?i)\bn ?= ?([0-9]+) ?\(([a-z])\)"
    one = lambda p: lambda x: F.struct(_group(x, p, 1).try_cast("long").alias("n"), F.lower(_group(x, p, 2)).alias("what"))
    return F.array_distinct(F.concat(F.transform(_all(s, words), one(words)), F.transform(_all(s, letters), one(letters))))


def compared_pairs(s: Column) -> Column:
    """Unordered pairs of "A vs B", words that name no group left out: "a|b" in alphabetical order."""
    p = r"(?i)([a-z0-9][a-z0-9+/-]*) (?:vs\.?|versus|compared (?:with|to)) ([a-z0-9][a-z0-9+/-]*)"
    pair = lambda x: F.array_sort(F.array(F.lower(_group(x, p, 1)), F.lower(_group(x, p, 2))))
    both = F.transform(_all(s, p), pair)
    fine = F.filter(both, lambda q: ~q[0].isin(*NO_GROUPS) & ~q[1].isin(*NO_GROUPS) & (q[0] != q[1]))
    return F.array_sort(F.array_distinct(F.transform(fine, lambda q: F.concat_ws("|", q))))


def cohort(s: Column) -> Column:
    """(n, approximate) of "20 flies per vial", "N = 40 per cohort", "~100 animals per group"; null without."""
    p = r"(?i)(~|about |approximately |around )?(?:n ?= ?)?([0-9]+)(?: [a-z]+)? (?:per|in each|for each) (?:vial|cohort|group|genotype|condition|cage|plate)"
    found = _group(s, p, 2)
    return F.when(found != "", F.struct(found.try_cast("long").alias("n"), (_group(s, p, 1) != "").alias("approximate")))


def declared_exclusions(s: Column) -> Column:
    """Upper-cased ids that a text says were excluded: "animals F5, F9 and M12 were excluded", "excluded: F5"."""
    ids = r"[A-Za-z]{1,3}-?[0-9]+"
    runs = _all(s, rf"({ids}(?:(?:, and |, | and ){ids})*) (?:was|were) (?:excluded|omitted|removed)|(?:excluded|excluding|omitted|omitting|exclusion of)(?:[:,]| animals?| samples?| mice| flies| subjects?)* ({ids}(?:(?:, and |, | and ){ids})*)")
    return F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit(rf"\b({ids})\b"), 1))), F.upper)))


def left_out(status: Column, column: Column) -> Column:
    """Whether a table's status cell says that its row was left out: by its word, the other way round in columns named for exclusion; unknown words are null."""
    word = F.lower(F.trim(status.cast("string")))
    plain = F.when(word.isin(*LEFT_OUT), True).when(word.isin(*KEPT), False)
    inverted = F.lower(column).rlike("exclu|omit|drop|remov")
    named = word.rlike("^(exclu|omit|drop|remov)")
    return F.when(inverted & ~named, ~plain).otherwise(plain)


def magnifications(s: Column) -> Column:
    """Magnifications stated as 40x, 63 × or ×20."""
    p = r"(?i)\b([0-9]+(?:\.[0-9])?) ?[x×](?:[^a-z0-9]|$)|[x×] ?([0-9]+)\b"
    return F.array_sort(F.array_distinct(F.transform(_all(s, p), lambda x: F.regexp_extract(x, r"([0-9]+(?:\.[0-9])?)", 1).cast("double"))))


def scale_bars(s: Column) -> Column:
    """(um, flexible) of the clauses that speak of scale bars; flexible: the clause says that lengths vary or gives several."""
    clauses = F.filter(F.split(s, r"[;.](?:\s|$)"), lambda c: F.lower(c).rlike("scale ?bars?|\\bbars?\\b"))

    def of(clause: Column) -> Column:
        lengths = F.regexp_extract_all(clause, F.lit(r"([0-9]+(?:\.[0-9]+)? ?(?:nm|µm|μm|um|mm))"), 1)
        flexible = (F.size(lengths) > 1) | F.lower(clause).rlike("as indicated|varies|unless")
        return F.transform(lengths, lambda x: F.struct(length_um(x).alias("um"), flexible.alias("flexible")))

    return F.array_distinct(F.flatten(F.transform(clauses, of)))


def length_um(x: Column) -> Column:
    """A bare length label such as "50 µm" in micrometres; null for anything else."""
    p = r"^\s*([0-9]+(?:\.[0-9]+)?) ?(nm|µm|μm|um|mm)\s*$"
    unit = F.when(_group(x, p, 2) == "nm", 0.001).when(_group(x, p, 2) == "mm", 1000.0).otherwise(1.0)
    return F.nullif(_group(x, p, 1), F.lit("")).cast("double") * unit


def cites_source(s: Column) -> Column:
    """The text says that something is taken from elsewhere."""
    return F.lower(s).rlike(r"reproduced (from|with)|adapted from|modified from|reprinted|taken from|data from ref|from \(?[a-z-]+ et al|previously (published|reported) in")


def disclosure_span(s: Column, cues: str = r"normali[sz]ed|relative to|fold[ -]change|percent of control|% of control|ratio to", around: int = 40) -> Column:
    """The first cue that values are derived, with up to `around` characters on both sides; null without one."""
    at = F.regexp_instr(F.lower(s), F.lit(f"({cues})"))
    found = F.regexp_extract(F.lower(s), f"({cues})", 1)
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substring(s, start, at - start + F.length(found) + around))


def panel_n_spans(legend: Column, panel: Column) -> Column:
    """(start, phrase) of "n = ..." phrases in the part of a legend that speaks of a panel: from its letter to the next one's."""
    opening = F.concat(F.lit(r"(?:^|[\s(])\(?"), F.lower(panel), F.lit(r"(?:\)|,|\.|:)\s"))
    low = F.lower(legend)
    start = F.regexp_instr(low, opening)
    rest = F.substring(low, start + 3, F.length(legend))
    length = F.regexp_instr(rest, F.lit(r"(?:^|[\s(])\(?[a-z](?:\)|,|\.|:)\s"))
    own = F.when(length > 0, F.substring(rest, F.lit(1), length)).otherwise(rest)
    phrases = F.regexp_extract_all(own, F.lit(r"(n ?= ?[0-9]+)"), 1)
    return F.when(start > 0, F.transform(phrases, lambda p: F.struct((F.position(p, own) + start + 2).alias("start"), p.alias("phrase")))).otherwise(F.array().cast("array<struct<start:int,phrase:string>>"))


def cited_sentences(s: Column) -> Column:
    """(sentence, cites, percents, polarity, years) of every sentence with a bracketed citation."""
    sentences = F.filter(F.split(s, r"(?<=[.!?])\s+"), lambda x: x.rlike(r"\[[0-9]+(?:[-–, ]+[0-9]+)*\]"))

    def facts(x: Column) -> Column:
        low = F.lower(x)
        up, down = low.rlike("increas|elevat|upregulat|higher|enhanc").cast("int"), low.rlike("decreas|reduc|downregulat|lower|impair").cast("int")
        return F.struct(
            x.alias("sentence"), F.regexp_extract_all(x, F.lit(r"\[([0-9]+(?:[-–, ]+[0-9]+)*)\]"), 1).alias("cites"),
            F.transform(F.regexp_extract_all(x, F.lit(r"([0-9]+(?:\.[0-9]+)?) ?%"), 1), lambda p: p.cast("double")).alias("percents"), (up - down).alias("polarity"),
            F.transform(F.regexp_extract_all(x, F.lit(r"\b((?:19|20)[0-9]{2})\b"), 1), lambda y: y.cast("int")).alias("years"),
        )

    return F.transform(sentences, facts)


def pdf_meta(s: Column) -> Column:
    """(doi, year, title) of a paper's first page: the first DOI, the first year in parentheses or after a copyright sign, the first long line that is neither."""
    doi = F.regexp_replace(F.lower(F.regexp_extract(s, r"(10\.[0-9]{4,9}/[^\s\"<>]+)", 1)), r"[.,;)]+$", "")
    year = F.regexp_extract(s, r"(?:\(|©\s?|[Cc]opyright\s)((?:19|20)[0-9]{2})\b", 1)
    lines = F.filter(F.transform(F.split(s, r"\n"), lambda x: F.trim(x)), lambda x: (F.length(x) >= 20) & ~F.lower(x).rlike(r"doi|https?://|www\.|©|copyright|journal|volume|received|accepted"))
    return F.struct(F.nullif(doi, F.lit("")).alias("doi"), F.nullif(year, F.lit("")).cast("int").alias("year"), F.try_element_at(lines, F.lit(1)).alias("title"))
