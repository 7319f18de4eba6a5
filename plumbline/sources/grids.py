"""Tables of any layout as cells (path, sheet, row, col, kind, num, str)."""

from __future__ import annotations

import csv
import gzip
import io
import re
import zipfile
from collections import Counter
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import MISSING

CELLS = "path string, sheet string, row long, col long, kind string, num double, str string"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def decoded(data: bytes) -> str:
    """Text by its byte order mark, else UTF-8, else Windows-1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def magic(data: bytes) -> str:
    """zip, ole, gzip or text, by the first bytes."""
    return "zip" if data[:4] == b"PK\x03\x04" else "ole" if data[:4] == b"\xd0\xcf\x11\xe0" else "gzip" if data[:2] == b"\x1f\x8b" else "text"


def delimiter(lines: list[str]) -> str | None:
    """Of tab, comma, semicolon and bar the one that cuts most lines into one and the same number of fields; of equals the one with more fields. None if none cuts."""

    def fit(d: str) -> tuple[int, int]:
        widths = Counter(len(row) for row in csv.reader(lines, delimiter=d) if len(row) > 1)
        width, rows = max(widths.items(), key=lambda x: (x[1], x[0]), default=(0, 0))
        return rows, width

    fits = {d: fit(d) for d in "\t;,|"}
    best = max(fits, key=fits.get)
    return best if fits[best][0] else None


def number(s: str, decimal_comma: bool = False) -> float | None:
    """As plumbline.functions.text.parse_number."""
    t = s.strip()
    t = re.sub(r"\.(\d{3})", r"\1", t).replace(",", ".") if decimal_comma else re.sub(r",(\d{3})", r"\1", t)
    t = re.sub(r"\s*%$", "", t)
    return float(t) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", t, re.A) else None


def cell(v: str | None, decimal_comma: bool = False) -> tuple[str, float | None, str | None]:
    if v is None or v.strip().lower() in MISSING:
        return "empty", None, None
    n = number(v, decimal_comma)
    return ("num", n, None) if n is not None and abs(n) != float("inf") else ("str", None, v.strip())


def text_rows(data: bytes) -> tuple[list[list[str]], bool]:
    """Rows of a delimited file, and whether its decimals are commas (they are where semicolons part the fields)."""
    text = decoded(gzip.decompress(data) if magic(data) == "gzip" else data)
    lines = text.splitlines()
    d = delimiter(lines)
    rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=d)) if d else [re.split(r" {2,}", x) for x in lines]
    return rows, d == ";"


def xlsx_rows(data: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, col, text) of the cells of a workbook that hold something."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = targets[sheet.get(f"{_REL}id")].lstrip("/")
        root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
        for r, row in enumerate(root.iter(f"{_MAIN}row")):
            for c, cell_ in enumerate(row.iter(f"{_MAIN}c")):
                ref = re.fullmatch(r"([A-Z]+)(\d+)", cell_.get("r", ""))
                col = c if not ref else sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(ref[1]))) - 1
                v, kind = cell_.find(f"{_MAIN}v"), cell_.get("t")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in cell_.iter(f"{_MAIN}t"))
                elif v is None or v.text is None or kind == "e":
                    continue
                else:
                    text = shared[int(v.text)] if kind == "s" else v.text
                yield sheet.get("name"), int(ref[2]) - 1 if ref else r, col, text


def cells(files: DataFrame) -> DataFrame:
    """Cells of delimited files and workbooks (path, content). A file that cannot be read gives one cell of kind error with the reason; nothing is cut off."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    if magic(data) == "zip":
                        rows = [(path, s, r, c, *cell(v)) for s, r, c, v in xlsx_rows(data)]
                    elif magic(data) == "ole":
                        raise ValueError("old binary workbooks are not readable here")
                    else:
                        table, comma = text_rows(data)
                        rows = [(path, "", r, c, *cell(v, comma)) for r, row in enumerate(table) for c, v in enumerate(row)]
                except (ValueError, KeyError, OSError, zipfile.BadZipFile, ElementTree.ParseError, csv.Error) as e:
                    rows = [(path, "", 0, 0, "error", None, str(e))]
                yield pd.DataFrame(rows, columns=["path", "sheet", "row", "col", "kind", "num", "str"])

    return files.select("path", "content").mapInPandas(run, CELLS)


def header_rows(c: DataFrame, search: int = 60) -> DataFrame:
    """(path, sheet, header): the first row within `search` with two texts at least, no fewer than numbers, above two rows with numbers."""
    rows = c.filter("kind <> 'error'").groupBy("path", "sheet", "row").agg(F.count_if(F.col("kind") == "num").alias("nums"), F.count_if(F.col("kind") == "str").alias("strs"))
    w = Window.partitionBy("path", "sheet").orderBy("row")
    ok = (F.col("row") < search) & (F.col("strs") >= 2) & (F.col("strs") >= F.col("nums")) & (F.lead("nums", 1).over(w) >= 1) & (F.lead("nums", 2).over(w) >= 1)
    return rows.withColumn("ok", ok).filter("ok").groupBy("path", "sheet").agg(F.min("row").alias("header"))


def columns(c: DataFrame) -> DataFrame:
    """(path, sheet, name, col, row, kind, num, str): the cells below each sheet's header, named; repeated names get a suffix."""
    h = header_rows(c)
    below = c.join(h, ["path", "sheet"])
    raw = below.filter("row = header AND kind <> 'empty'").select("path", "sheet", "col", F.coalesce("str", F.col("num").cast("string")).alias("raw"))
    again = F.row_number().over(Window.partitionBy("path", "sheet", "raw").orderBy("col"))
    names = raw.withColumn("k", again).select("path", "sheet", "col", F.when(F.col("k") > 1, F.concat("raw", F.lit("."), F.col("k") - 1)).otherwise(F.col("raw")).alias("name"))
    return below.filter("row > header AND kind <> 'empty'").join(names, ["path", "sheet", "col"]).select("path", "sheet", "name", "col", "row", "kind", "num", "str")


def roles(named: DataFrame) -> DataFrame:
    """(path, sheet, group_col, value_col): the first text column with 2..30 different entries, fewer than rows, and the first with three numbers that is no id or date."""
    per = named.groupBy("path", "sheet", "name").agg(F.min("col").alias("col"), F.count("*").alias("n"), F.count_if(F.col("kind") == "num").alias("nums"), F.count_distinct("str").alias("distinct"))
    sized = per.withColumn("rows", F.max("n").over(Window.partitionBy("path", "sheet")))
    low = F.lower("name")
    preferred = low.rlike("group|genotype|condition|treatment|label|strain")
    is_group = (F.col("nums") == 0) & F.col("distinct").between(2, 30) & (F.col("distinct") < F.col("rows"))
    is_value = (F.col("nums") >= 3) & ~low.rlike("^id$|_id$|date|^day$|^index$")
    pick = lambda cond, first: F.min_by(F.when(cond, F.col("name")), F.when(cond, F.struct(first.cast("int"), F.col("col"))))
    out = sized.groupBy("path", "sheet").agg(pick(is_group, ~preferred).alias("group_col"), pick(is_value, ~(low == "value")).alias("value_col"))
    return out.filter("value_col IS NOT NULL")


def observations(c: DataFrame) -> DataFrame:
    """Cells as measurements (source, group_key, value): a row's group entry and its value; without a group column the group is null."""
    named = columns(c)
    r = roles(named)
    v = named.join(r, ["path", "sheet"])
    value = v.filter("name = value_col AND kind = 'num'").select("path", "sheet", "row", F.col("num").alias("value"))
    group = v.filter("name = group_col").select("path", "sheet", "row", F.col("str").alias("group_key"))
    return value.join(group, ["path", "sheet", "row"], "left").select(F.concat_ws("#", "path", "sheet").alias("source"), "group_key", "value")
