"""Figure legends: where they stand in a manuscript, which panels they speak of, and which n they state for whom."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import labels

PANEL_NS = "doc string, figure string, panel string, group_key string, n long, n_max long, lower_bound boolean"
#: Paragraphs that a legend has at most, its heading among them.
LEGEND_PARAGRAPHS = 12
# Words after an n that count things and name no group.
COUNTED = frozenset("animals cells mice rats flies larvae embryos samples fields replicates experiments independent biological technical images neurons plants wells worms colonies patients donors each per in of from".split())

_HEAD = re.compile(r"^\s*((?:extended data |supplementary |supp(?:l)?\.? )?fig(?:ure)?\.? ?s?\d{1,2})\s*(?:\(?(?:continued|cont\.?)\)?)?\s*[.:|–—-]?\s+", re.I)
_CONTINUED = re.compile(r"\bcont(?:inued|\.)", re.I)
#: How panels may open: "(a) ...", "a, ...", "a: ...", "a. ...", or a bare bold letter before a capital.
_STYLES = {
    "brackets": re.compile(r"\(([A-Za-z](?:\s?[-–,]\s?[A-Za-z])*)\)\s"),
    "comma": re.compile(r"(?:^|[.;]\s+)([a-z](?:\s?[-–]\s?[a-z]|(?:,\s?[a-z])+)?),\s"),
    "colon": re.compile(r"(?:^|[.;]\s+)([A-Za-z](?:\s?[-–]\s?[A-Za-z])?)[:.]\s"),
    "bare": re.compile(r"(?:^|[.;]\s+)([a-z](?:\s?[-–]\s?[a-z])?)\s(?=[A-Z])"),
}
_WORD = r"[A-Za-z][A-Za-z0-9+/*-]*"
_N = r"[nN]\s*(?P<rel>=|≥|>=|>)\s*(?P<n>\d+)(?:\s*[-–]\s*(?P<max>\d+))?"
_LIST = re.compile(rf"[nN]\s*=\s*(?P<list>\d+\s+{_WORD}(?:(?:,\s*(?:and\s+)?|\s+and\s+)\d+\s+{_WORD})+)")
_IN_BRACKETS = re.compile(rf"(?P<group>{_WORD})\s*\(\s*{_N}[^)]*\)")
_FOR = re.compile(rf"{_N}\s+(?:for|in)\s+(?:the\s+)?(?P<group>{_WORD})")
_RUN = re.compile(rf"{_N}[^.;]*?\b(?:in|for)\s+(?:panels?\s+)?\(?(?P<panels>[a-z]\s?[-–]\s?[a-z]|[a-z](?:,\s?[a-z])+)\)?(?![a-z])")
_RESPECTIVELY = re.compile(rf"(?P<groups>{_WORD}(?:,\s*{_WORD})*\s+and\s+{_WORD})[^.;]*?[nN]\s*=\s*(?P<ns>\d+(?:,\s*\d+)*\s*(?:,\s*)?and\s+\d+),?\s+respectively")
_ANY = re.compile(_N)
_LEAST = re.compile(r"at least (?P<n>\d+)\s+(?:animals|cells|mice|samples|replicates|experiments|flies|embryos)")


def expanded(run: str) -> list[str]:
    """Letters of "b-d" or "a, c"."""
    out = []
    for part in re.split(r"\s*,\s*", run.lower()):
        ends = re.split(r"\s?[-–]\s?", part)
        out += [chr(c) for c in range(ord(ends[0]), ord(ends[-1]) + 1)] if len(ends) == 2 and len(ends[0]) == len(ends[1]) == 1 and ends[0] <= ends[1] else [x for x in ends if len(x) == 1]
    return out


def sections(text: str) -> list[tuple[list[str], str]]:
    """(panels, what is said of them) by the style that opens most panels in order; what stands before the first opening belongs to none."""
    best: list[tuple[list[str], int, int]] = []
    for style in _STYLES.values():
        found, last = [], "`"
        for m in style.finditer(text):
            panels = expanded(m[1])
            if panels and last < panels[0] and (found or panels[0] == "a") and ord(panels[0]) - ord(last) <= 3:
                found.append((panels, m.start(), m.end()))
                last = panels[-1]
        if sum(len(p) for p, _, _ in found) > sum(len(p) for p, _, _ in best):
            best = found
    if not best:
        return [([], text)]
    ends = [s for _, s, _ in best[1:]] + [len(text)]
    return [([], text[: best[0][1]])] + [(panels, text[begin:end]) for (panels, _, begin), end in zip(best, ends, strict=True)]


def clause_ns(text: str) -> Iterator[tuple[list[str] | None, str | None, int, int | None, bool]]:
    """(panels it names itself, group, n, n_max, lower_bound) of every statement of n; earlier readings take their words away from later ones."""
    taken: list[tuple[int, int]] = []

    def free(m: re.Match) -> bool:
        return not any(a < m.end() and m.start() < b for a, b in taken)

    def one(m: re.Match) -> tuple[int, int | None, bool]:
        return int(m["n"]), int(m["max"]) if m["max"] else None, m["rel"] != "="

    for m in _RESPECTIVELY.finditer(text):
        groups, ns = re.findall(_WORD, re.sub(r"\band\b", ",", m["groups"])), re.findall(r"\d+", m["ns"])
        if len(groups) >= len(ns):
            taken.append(m.span())
            yield from ((None, g, int(n), None, False) for g, n in zip(groups[-len(ns) :], ns, strict=True))
    for m in filter(free, _LIST.finditer(text)):
        pairs = re.findall(rf"(\d+)\s+({_WORD})", m["list"])
        if not any(g.lower() in COUNTED for _, g in pairs):
            taken.append(m.span())
            yield from ((None, g, int(n), None, False) for n, g in pairs)
    for m in filter(free, _RUN.finditer(text)):
        taken.append(m.span())
        yield expanded(m["panels"]), None, *one(m)
    for pattern in (_IN_BRACKETS, _FOR):
        for m in filter(free, pattern.finditer(text)):
            if m["group"].lower() not in COUNTED and len(m["group"]) > 1:
                taken.append(m.span())
                yield None, m["group"], *one(m)
    for m in filter(free, _ANY.finditer(text)):
        taken.append(m.span())
        yield None, None, *one(m)
    for m in filter(free, _LEAST.finditer(text)):
        yield None, None, int(m["n"]), None, True


def panel_rows(text: str) -> list[tuple[str, str | None, int, int | None, bool]]:
    """(panel, group, n, n_max, lower_bound) of a legend, once each. An n outside any panel's part that names no panels holds for all panels that state none."""
    parts = sections(text)
    every = [p for panels, _ in parts for p in panels]
    out, general = [], []
    for panels, said in parts:
        for named, group, n, most, low in clause_ns(said):
            if named or panels:
                out += [(p, group, n, most, low) for p in named or panels]
            else:
                general.append((group, n, most, low))
    stated = {r[0] for r in out}
    out += [(p, *g) for g in general for p in (every or [""]) if p not in stated]
    return list(dict.fromkeys(out))


def panel_ns(legends: DataFrame) -> DataFrame:
    """Legends (doc, figure, text) as panel sample sizes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(doc, figure, *r) for doc, figure, text in zip(pdf["doc"], pdf["figure"], pdf["text"], strict=True) for r in panel_rows(text or "")]
            out = pd.DataFrame(rows, columns=["doc", "figure", "panel", "group_key", "n", "n_max", "lower_bound"])
            out["n_max"] = out["n_max"].astype("Int64")
            yield out

    return legends.select(F.col("doc").cast("string").alias("doc"), "figure", labels.cleaned_legend(F.col("text")).alias("text")).mapInPandas(run, PANEL_NS)


def gathered(paragraphs: DataFrame) -> DataFrame:
    """(doc, figure, text): legends of paragraphs (doc, ord, text): a heading and what follows it, up to the next heading and LEGEND_PARAGRAPHS; continued ones are joined."""
    t = labels.cleaned_legend(F.col("text"))
    pattern = _HEAD.pattern.replace("(?:", "(?:")
    head = F.regexp_extract(t, f"(?i){pattern}", 1)
    number = labels.figure_label(F.regexp_replace(head, r"\s+", " "))["number"]
    extended = F.lower(head).startswith("ext")
    figure = F.when(head != "", F.concat(F.when(extended, "ED").otherwise(""), number))
    by_doc = Window.partitionBy("doc").orderBy("ord")
    rows = paragraphs.select("doc", "ord", t.alias("text"), figure.alias("figure"))
    rows = rows.withColumn("run", F.count("figure").over(by_doc)).filter("run > 0")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("doc", "run").orderBy("ord"))).filter(F.col("k") <= LEGEND_PARAGRAPHS)
    each = rows.groupBy("doc", "run").agg(F.max("figure").alias("figure"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ").alias("text"))
    body = F.regexp_replace("text", f"(?i){pattern}", "")
    return each.groupBy("doc", "figure").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run", body.alias("body")))), lambda x: x["body"]), " ").alias("text"))


def captions(pages: DataFrame) -> DataFrame:
    """(doc, figure, text): captions in running text (doc, text), cut by the style of headings that opens most figures."""

    styles = [re.compile(rf"(?:^|\n)\s*({name}\s?s?\d{{1,2}}){stop}", re.I) for name in (r"fig(?:ure)?\.?", r"extended data fig(?:ure)?\.?") for stop in (r"[.:]\s", r"\s?\|\s", r"\.?\s[–—-]\s", r"\s(?=[A-Z])")]

    def cut(text: str) -> list[tuple[str, str]]:
        best: list[re.Match] = []
        for s in styles:
            found = list(s.finditer(text))
            if len({m[1].lower() for m in found}) > len({m[1].lower() for m in best}):
                best = found
        ends = [m.start() for m in best[1:]] + [len(text)]
        out = []
        for m, end in zip(best, ends, strict=True):
            body = text[m.end() : end]
            body = re.split(r"\n\s*\n", body, maxsplit=1)[0]
            digits = re.search(r"s?\d+", m[1], re.I)
            out.append((("ED" if m[1].lower().startswith("ext") else "") + digits[0].upper(), " ".join(body.split())))
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(d, f, t) for d, text in zip(pdf["doc"], pdf["text"], strict=True) for f, t in cut(text or "")]
            yield pd.DataFrame(rows, columns=["doc", "figure", "text"])

    return pages.select(F.col("doc").cast("string").alias("doc"), "text").mapInPandas(run, "doc string, figure string, text string")


def figure_bundles(paragraphs: DataFrame, legends: DataFrame) -> DataFrame:
    """(doc, figure, legend, mentions, n_mentions): each legend (doc, figure, text) with the paragraphs (doc, ord, text) that mention its figure, in order."""
    said = paragraphs.select("doc", "ord", "text", F.explode(labels.mentioned_figures(F.col("text"))).alias("figure"))
    mentions = said.join(legends.select("doc", "figure").distinct(), ["doc", "figure"], "left_semi").groupBy("doc", "figure").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("mentions"), F.count("*").alias("n_mentions"))
    out = legends.withColumnRenamed("text", "legend").join(mentions, ["doc", "figure"], "left")
    return out.select("doc", "figure", "legend", F.coalesce("mentions", F.lit("")).alias("mentions"), F.coalesce("n_mentions", F.lit(0)).alias("n_mentions"))


def missing_legends(legends: DataFrame, mentioned: DataFrame) -> DataFrame:
    """(doc, figure): plain figures up to the highest number without a gap among the mentioned (doc, figure), that have no legend."""
    numbers = mentioned.filter(F.col("figure").rlike("^[0-9]+$")).select("doc", F.col("figure").cast("int").alias("k")).distinct()
    upto = numbers.withColumn("rn", F.row_number().over(Window.partitionBy("doc").orderBy("k"))).filter("k = rn").select("doc", F.col("k").cast("string").alias("figure"))
    return upto.join(legends.select("doc", "figure"), ["doc", "figure"], "left_anti")
