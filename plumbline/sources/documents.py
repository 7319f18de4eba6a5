"""Manuscripts, vendor files and residues."""

from __future__ import annotations

import io
import json
import plistlib
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.grids import decoded, number

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> list[str]:
    """Paragraphs in reading order, tables and text boxes included, deleted revisions left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))

    def text(node) -> str:
        if node.tag == f"{_W}del":
            return ""
        own = node.text or "" if node.tag == f"{_W}t" else "\t" if node.tag == f"{_W}tab" else "\n" if node.tag == f"{_W}br" else ""
        return own + "".join(text(x) for x in node if x.tag != f"{_W}p")

    return [t for p in root.iter(f"{_W}p") if (t := text(p).strip())]


def pzfx_cells(data: bytes) -> list[tuple[str, str, int, float]]:
    """(table, column, row, value) of a Prism XML file; cells marked as excluded are left out."""
    root = ElementTree.fromstring(data)
    ns = root.tag[: root.tag.index("}") + 1] if root.tag.startswith("{") else ""
    out = []
    for table in root.iter(f"{ns}Table"):
        title = "".join(table.find(f"{ns}Title").itertext()).strip() if table.find(f"{ns}Title") is not None else table.get("ID", "")
        for column in [*table.findall(f"{ns}XColumn"), *table.findall(f"{ns}YColumn")]:
            head = column.find(f"{ns}Title")
            name = "".join(head.itertext()).strip() if head is not None else "X"
            for sub in column.findall(f"{ns}Subcolumn"):
                for row, d in enumerate(sub.findall(f"{ns}d")):
                    v = number("".join(d.itertext()))
                    if v is not None and d.get("Excluded") != "1":
                        out.append((title, name, row, v))
    return out


def residue(data: bytes) -> dict:
    """What a console clipping says: test, t, df, p and the means compared; missing parts are None."""
    try:
        plist = plistlib.loads(data)
        parts = plist.get("UTI-Data", plist) if isinstance(plist, dict) else {}
        text = next((v if isinstance(v, str) else decoded(v) for k, v in parts.items() if "text" in k and isinstance(v, str | bytes)), "")
    except Exception:  # noqa: BLE001  not a property list: plain text
        text = decoded(data)
    low = text.lower()
    first = lambda p: float(m[1]) if (m := re.search(p, text)) else None
    means = re.search(r"mean in group[^\n]*\n\s*([-+0-9.eE]+)\s+([-+0-9.eE]+)", text)
    name = "welch" if "welch" in low else "paired" if "paired t-test" in low else "student" if "two sample t-test" in low else "anova" if "anova" in low or "f value" in low else "dunnett" if "dunnett" in low else None
    return {"test": name, "t": first(r"\bt = ([-+0-9.eE]+)"), "df": first(r"\bdf = ([-+0-9.eE]+)"), "p": first(r"p-value [=<] ([-+0-9.eE]+)"), "mean_a": float(means[1]) if means else None, "mean_b": float(means[2]) if means else None}


def acquisition(data: bytes) -> dict:
    """Magnification, aperture and pixel size from XML anywhere in a microscope file, in UTF-8 or UTF-16."""
    for text in (data.decode("latin-1"), data.decode("utf-16-le", "ignore"), data[1:].decode("utf-16-le", "ignore")):
        first = lambda *ps: next((float(m[1]) for p in ps if (m := re.search(p, text))), None)  # noqa: B023, E731
        out = {"magnification": first(r"<(?:Nominal)?Magnification>([0-9.]+)<", r'[Mm]agnification="([0-9.]+)"'), "aperture": first(r"<LensNA>([0-9.]+)<", r'NumericalAperture="([0-9.]+)"'), "pixel_um": None}
        if (m := first(r'<Distance Id="X">\s*<Value>([-0-9.eE]+)<', r'PhysicalSizeX="([0-9.eE-]+)"')) is not None:
            out["pixel_um"] = m * 1e6 if m < 1e-3 else m
        if any(v is not None for v in out.values()):
            return out
    return {"magnification": None, "aperture": None, "pixel_um": None}


UNREAD = (ElementTree.ParseError, zipfile.BadZipFile, KeyError, ValueError)


def unreadable(files: DataFrame, parse=lambda data: docx_text(data)) -> DataFrame:
    """(path, reason) of the files (path, content) that a parser of this module - docx_text, pzfx_cells, residue - cannot read: readers leave them out, this names them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    parse(data)
                except UNREAD as e:
                    out.append((path, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "reason"])

    return files.select("path", "content").mapInPandas(run, "path string, reason string")


def _mapped(files: DataFrame, schema: str, rows) -> DataFrame:
    """Rows of the files that can be read as this kind; unreadable() names the others."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    out += [(path, *r) for r in rows(data)]
                except UNREAD:
                    continue  # not a file of this kind
            yield pd.DataFrame(out, columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def paragraphs(files: DataFrame) -> DataFrame:
    """(path, ord, text) of DOCX files."""
    return _mapped(files, "path string, ord long, text string", lambda d: enumerate(docx_text(d)))


def prism(files: DataFrame) -> DataFrame:
    """(path, table, column, row, value) of Prism XML files."""
    return _mapped(files, "path string, table string, column string, row long, value double", pzfx_cells)


def residues(files: DataFrame) -> DataFrame:
    """(path, test, t, df, p, mean_a, mean_b) of console clippings."""
    return _mapped(files, "path string, test string, t double, df double, p double, mean_a double, mean_b double", lambda d: [tuple(residue(d).values())])


def acquisitions(files: DataFrame) -> DataFrame:
    """(path, magnification, aperture, pixel_um) of microscope files."""
    return _mapped(files, "path string, magnification double, aperture double, pixel_um double", lambda d: [tuple(acquisition(d).values())])


def sidecars(files: DataFrame) -> DataFrame:
    """(path, magnification) of <stem>.meta.json files; path is the stem."""
    rows = files.filter(F.lower("path").endswith(".meta.json")).select(F.regexp_replace("path", r"\.meta\.json$", "").alias("path"), F.decode("content", "UTF-8").alias("j"))
    return rows.select("path", F.from_json("j", "objective_magnification double").getField("objective_magnification").alias("magnification")).filter("magnification IS NOT NULL")


def matrix_shapes(lines: DataFrame) -> DataFrame:
    """(path, n_rows, n_cols, n_entries) of MatrixMarket files given as lines (path, ord, line): the first line that is no comment."""
    first = lines.filter(~F.col("line").startswith("%") & (F.trim("line") != "")).groupBy("path").agg(F.min_by("line", "ord").alias("l"))
    n = lambda i: F.element_at(F.split(F.trim("l"), r"\s+"), i).try_cast("long")
    return first.select("path", n(1).alias("n_rows"), n(2).alias("n_cols"), n(3).alias("n_entries"))


def config_groups(text: str) -> list[str]:
    """Entries of lists under keys like groups, genotypes or conditions of a simple YAML or JSON text."""
    try:
        found = json.loads(text)
    except ValueError:
        out, on = [], False
        for line in text.splitlines():
            if m := re.match(r"\s*([A-Za-z_]+)\s*:\s*(.*)$", line):
                on = bool(re.fullmatch(r"groups?|genotypes?|conditions?|strains?", m[1], re.I))
                if on and m[2].startswith("["):
                    out += [x.strip(" '\"") for x in m[2].strip("[]").split(",")]
            elif on and (m := re.match(r"\s*-\s*(.+?)\s*$", line)):
                out.append(m[1].strip("'\""))
        return out

    def walk(x, on=False):
        if isinstance(x, dict):
            for k, v in x.items():
                yield from walk(v, bool(re.fullmatch(r"groups?|genotypes?|conditions?|strains?", k, re.I)))
        elif isinstance(x, list):
            for v in x:
                yield from walk(v, on)
        elif on:
            yield str(x)

    return list(walk(found))


def configs(files: DataFrame) -> DataFrame:
    """(path, label) of configuration files."""
    return _mapped(files, "path string, label string", lambda d: [(x,) for x in config_groups(decoded(d))])
