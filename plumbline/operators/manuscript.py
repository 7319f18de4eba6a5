"""What manuscripts state: panel sample sizes, references and citations, antibodies, scale bars - and checks on them.

Paragraphs come as (doc, ord, text). Extraction is per paragraph in Arrow
batches; comparison is joins and aggregates.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import ordered

# Species names and what they are called here.
SPECIES = {"rabbit": "rabbit", "rb": "rabbit", "mouse": "mouse", "ms": "mouse", "rat": "rat", "goat": "goat", "donkey": "donkey", "chicken": "chicken", "guinea pig": "guinea pig", "sheep": "sheep", "human": "human", "hamster": "hamster", "llama": "llama", "horse": "horse", "bovine": "bovine"}
# Words after "anti" that make no antibody.
NO_TARGETS = frozenset("aging allergic apoptotic arrhythmic bacterial biotic biotics body bodies cancer clockwise coagulant convulsant correlated correlation depressant depressants diabetic emetic epileptic fungal gen genic hypertensive infective inflammatory malarial microbial mitotic oxidant oxidants oxidative parallel parasitic proliferative psychotic sense septic thrombotic tumor tumour viral".split())
# Letters with which makers' product numbers begin, their digits at least, and the host that all of that kind have.
MAKERS = (("AB_", 3, None), ("HPA", 6, "rabbit"), ("AMAB", 5, "mouse"), ("SC-", 2, None), ("AB", 3, None))
_CLONAL = frozenset(("monoclonal", "polyclonal", "affinity-purified", "purified", "recombinant"))
_RAISED = frozenset(("raised", "produced", "made", "generated", "developed"))
_OF_SECONDARIES = frozenset("igg igm iga ig secondary secondaries antibody antibodies alexa hrp conjugated conjugate fluor and or".split())


def product(word: str) -> tuple[str, str | None] | None:
    """(number, host of its kind) of a word that is a maker's product number."""
    big = word.upper()
    for start, least, host in MAKERS:
        rest = big.removeprefix(start)
        if rest != big and rest.isdigit() and len(rest) >= least:
            return big, host
    return None


def _sentences(text: str) -> Iterator[list[str]]:
    """Words of every sentence; one ends at a semicolon, a bar, or a full stop before a capital. A comma stays a word of its own."""
    own: list[str] = []
    for word in text.replace(",", " , ").replace(";", " ; ").replace("|", " | ").replace("(", " ").replace(")", " , ").replace(":", " ").split():
        if word in (";", "|"):
            yield own
            own = []
            continue
        if own and own[-1].endswith(".") and word[0].isupper():
            yield own
            own = []
        own.append(word)
    yield own


def _species_at(words: list[str], i: int) -> tuple[str, int] | None:
    """The species that begins at word i, and the number of its words."""
    for n in (2, 1):
        if 0 <= i and i + n <= len(words) and (name := SPECIES.get(" ".join(words[i : i + n]).lower().strip("."))):
            return name, n
    return None


def _target(words: list[str], i: int) -> tuple[str, int] | None:
    """The target of an antibody that word i names, and where its description begins."""
    low = words[i].lower()
    if low == "anti" and i + 1 < len(words):
        name, after = words[i + 1], i + 2
    elif low.startswith("anti-") and len(low) > 5:
        name, after = words[i][5:], i + 1
    else:
        return None
    if name.lower() == "guinea" and after < len(words) and words[after].lower().startswith("pig"):
        name, after = "guinea pig", after + 1
    name = name.rstrip(".")
    return (name, after) if name[:1].isalnum() and name.lower() not in NO_TARGETS else None


def antibody_mentions(text: str) -> Iterator[tuple]:
    """(target, host, host_after, secondary, catalog_host, identity) of each antibody that a text names; its description goes on to the next one or the sentence's end."""
    for words in _sentences(text):
        named = [(i, *t) for i in range(len(words)) if (t := _target(words, i))]
        for k, (i, name, begin) in enumerate(named):
            said = [w.rstrip(".") for w in words[begin : named[k + 1][0] if k + 1 < len(named) else len(words)]]
            low = [w.lower() for w in said]
            at = i - 1
            while at >= 0 and words[at].lower() in _CLONAL:
                at -= 1
            one, two = _species_at(words, at), _species_at(words, at - 1)
            before = two[0] if two and two[1] == 2 else one[0] if one and one[1] == 1 else None
            target = SPECIES.get(name.lower(), name)
            follows = next((w for w in low if w != ","), "")
            secondary = target in SPECIES.values() and target != "human" and (not low or low[0] == "," or follows in _OF_SECONDARIES)
            after = None
            for j in range(len(said)):
                here = _species_at(said, j)
                raised = j >= 2 and low[j - 1] == "in" and low[j - 2] in _RAISED
                told = j >= 1 and low[j - 1] in ("host", "species", "=")
                if here and (raised or told or (j + here[1] < len(low) and low[j + here[1]] in ("monoclonal", "polyclonal", "origin"))):
                    after = here[0]
                    break
            number = next((p for w in said if (p := product(w))), None)
            ident, kind_host = number or (None, None)
            if secondary:
                after = kind_host = None
            yield target, before or after, after if before else None, secondary, kind_host, ident


_N = re.compile(r"\bn\s*=\s*(\d+)(?:\s*(?:-|–|to)\s*(\d+))?", re.I)
_PANEL = re.compile(r"\(([a-zA-Z](?:\s*[-–,]\s*[a-zA-Z])*)\)|(?:^|[.;]\s+)([a-zA-Z](?:\s*[-–,]\s*[a-zA-Z])*)\s*[,:]\s", re.M)


def _letters(run: str) -> list[str]:
    out: list[str] = []
    for part in re.split(r"\s*,\s*", run.lower().replace("–", "-")):
        a, _, b = part.replace(" ", "").partition("-")
        out += [chr(c) for c in range(ord(a), ord(b or a) + 1)] if a else []
    return out


def legend_ns(text: str) -> Iterator[tuple]:
    """(panel, n, n_max) of a legend: each "n = .." belongs to the panels opened last before it, or to none; n_max is a range's end."""
    opened = [(m.start(), _letters(m[1] or m[2])) for m in _PANEL.finditer(text)]
    for m in _N.finditer(text):
        panels = next((p for at, p in reversed(opened) if at < m.start()), [""])
        for p in panels:
            yield p, int(m[1]), int(m[2]) if m[2] else None


_AUTHOR_YEAR = re.compile(r"([A-Z][\w'’-]+)(?:\s+(?:et al\.?|and|&)\s*(?:[A-Z][\w'’-]+)?)?,?\s+((?:19|20)\d{2})[a-z]?")


def cited_keys(text: str) -> Iterator[tuple]:
    """(key) of in-text citations: numbers of [1-4, 7], ranges to 20 wide, and surname_year of (Author, 2020; ..)."""
    for m in re.finditer(r"\[(\d+(?:\s*[-–,]\s*\d+)*)\]", text):
        for part in re.split(r"\s*,\s*", m[1].replace("–", "-")):
            a, _, b = part.replace(" ", "").partition("-")
            wide = int(b) - int(a) if b else 0
            for n in range(int(a), int(b) + 1) if 0 < wide <= 20 else {int(a), int(b or a)}:
                yield (str(n),)
    for m in re.finditer(r"\(([^()]*(?:19|20)\d{2}[^()]*)\)", text):
        for a in _AUTHOR_YEAR.finditer(m[1]):
            yield (f"{a[1].lower()}_{a[2]}",)


def entry(text: str) -> Iterator[tuple]:
    """(key, alias, year, doi) of a bibliography entry: its number or surname_year, and the other as alias."""
    number = re.match(r"\s*\[?(\d+)[\].)]\s+", text)
    body = text[number.end() :] if number else text
    surname, year = re.match(r"\s*([A-Z][\w'’-]+)", body), re.search(r"\(?((?:19|20)\d{2})[a-z]?\)?", body)
    doi = re.search(r"10\.\d{4,9}/[^\s;,]+", body)
    name = f"{surname[1].lower()}_{year[1]}" if surname and year else None
    if number or name:
        yield number[1] if number else name, name, int(year[1]) if year else None, doi[0].rstrip(".") if doi else None


def _each(paragraphs: DataFrame, parse: Callable, schema: str) -> DataFrame:
    kind = paragraphs.schema["doc"].dataType.simpleString()
    names = ["doc", "ord", *(x.strip().split(" ")[0] for x in schema.split(","))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(d, o, *r) for d, o, t in zip(pdf["doc"], pdf["ord"], pdf["text"], strict=True) for r in parse(t or "")]
            out = pd.DataFrame(rows, columns=names)
            for x in schema.split(","):
                name, what = x.split()
                if what in ("int", "long"):
                    out[name] = out[name].astype("Int64")
            yield out

    return paragraphs.select("doc", "ord", "text").mapInPandas(run, f"doc {kind}, ord long, {schema}")


def panel_ns(paragraphs: DataFrame) -> DataFrame:
    """(doc, ord, panel, n, n_max) of legends."""
    return _each(paragraphs, legend_ns, "panel string, n long, n_max long")


def citations(paragraphs: DataFrame) -> DataFrame:
    """(doc, ord, key), those in the bibliography itself left out by the caller."""
    return _each(paragraphs, cited_keys, "key string")


def bibliography(paragraphs: DataFrame) -> DataFrame:
    """(doc, ord, key, alias, year, doi): entries between a heading References or Bibliography and the next heading; lines that start no entry go on with the one before."""
    head = F.lower(F.trim("line")).rlike("^(references|bibliography|literature cited)$")
    stop = F.lower(F.trim("line")).rlike("^(figure legends?|supplement.*|appendix.*|acknowledg.*|tables?)$")
    marked = ordered.sections(paragraphs.withColumnRenamed("text", "line"), F.when(head, "refs").when(stop, "other"))
    lines = marked.filter(F.col("section") == "refs").filter(~head).select("doc", "ord", "line")
    starts = F.col("line").rlike(r"^\s*(\[?[0-9]+[\].)]\s|[A-Z][A-Za-z'’-]+,? .*(19|20)[0-9]{2})")
    whole = ordered.joined_lines(lines, starts).filter("entry > 0").select("doc", F.col("entry").alias("ord"), "text")
    return _each(whole, entry, "key string, alias string, year long, doi string")


def antibodies(paragraphs: DataFrame) -> DataFrame:
    return _each(paragraphs, antibody_mentions, "target string, host string, host_after string, secondary boolean, catalog_host string, identity string")


def antibody_conflicts(mentions: DataFrame) -> DataFrame:
    """(doc, check, detail): product number against host, two hosts in one description, one identity with several hosts, a secondary against its own host's species only, a secondary for which no primary has the host."""
    m = mentions.filter("NOT secondary AND host IS NOT NULL")
    number = m.filter("catalog_host IS NOT NULL AND catalog_host <> host").select("doc", F.lit("catalog_host").alias("check"), F.concat_ws("|", "identity", "host", "catalog_host").alias("detail"))
    inline = m.filter("host_after IS NOT NULL AND host_after <> host").select("doc", F.lit("inline").alias("check"), F.concat_ws("|", "target", "host", "host_after").alias("detail"))
    same = m.filter("identity IS NOT NULL").groupBy("doc", "identity").agg(F.array_sort(F.collect_set("host")).alias("hosts")).filter(F.size("hosts") > 1)
    identity = same.select("doc", F.lit("identity").alias("check"), F.concat_ws("|", "identity", F.array_join("hosts", "|")).alias("detail"))
    second = mentions.filter("secondary")
    own = second.filter("host = target").select("doc", F.lit("self_secondary").alias("check"), F.col("target").alias("detail"))
    hosts = m.select("doc", F.col("host").alias("target")).distinct()
    known = second.join(hosts.select("doc").distinct(), "doc", "left_semi")
    lone = known.join(hosts, ["doc", "target"], "left_anti").select("doc", F.lit("unmatched_secondary").alias("check"), F.col("target").alias("detail"))
    return number.union(inline).union(identity).union(own).union(lone).distinct()


def scale_bar_conflicts(stated: DataFrame, drawn: DataFrame) -> DataFrame:
    """Drawn lengths (figure, um) that the figure's legend does not state (within 1e-6), for figures with a legend."""
    s = stated.select("figure", F.round(F.col("um"), 6).alias("um")).distinct()
    return drawn.select("figure", F.round(F.col("um"), 6).alias("um")).distinct().join(s.select("figure").distinct(), "figure", "left_semi").join(s, ["figure", "um"], "left_anti")
