"""Titled table blocks inside sheets: several tables on one sheet, each under its own heading.

Cells (plumbline.sources.grids) become rows of blocks. A block begins at a run of
texts with numbers below it and goes on down to an empty row or the next such
run. Its heading is what stands above, and tells which figure it belongs to.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import labels

BLOCKS = "path string, sheet string, block long, header_row long, title string, col long, header string, role string, row long, num double, str string"
# Rows that sum up what stands above, by their first cell.
SUMMARIES = {"mean": "mean", "average": "mean", "sd": "sd", "s.d.": "sd", "stdev": "sd", "std": "sd", "sem": "sem", "s.e.m.": "sem", "se": "sem", "median": "median", "n": "n"}
_INDEX = re.compile(r"^(#|no\.?|nr\.?|index|row|id|sample|replicate)?$", re.I)
TITLE_ROWS = 4


class Sheet:
    """The cells of a sheet by row and column."""

    def __init__(self, pdf: pd.DataFrame):
        self.rows: dict[int, dict[int, tuple[str, float, str]]] = {}
        for r, c, kind, num, text in zip(pdf["row"], pdf["col"], pdf["kind"], pdf["num"], pdf["str"], strict=True):
            if kind in ("num", "str"):
                self.rows.setdefault(int(r), {})[int(c)] = kind, num, text

    def runs(self, r: int) -> Iterator[tuple[int, int]]:
        """Runs (first, last column) of texts in row r of which half at least stand on a number; a number between two texts over numbers is a label too."""
        row, below = self.rows.get(r, {}), self.rows.get(r + 1, {})
        on_number = lambda c: below.get(c, ("",))[0] == "num"
        is_label = lambda c: row.get(c, ("",))[0] == "str" or (row.get(c, ("",))[0] == "num" and row.get(c - 1, ("",))[0] == "str" == row.get(c + 1, ("",))[0] and on_number(c))
        start = None
        for c in range(min(row, default=0), max(row, default=-1) + 2):
            if is_label(c):
                start = c if start is None else start
            elif start is not None:
                if 2 * sum(map(on_number, range(start, c))) >= c - start:
                    yield start, c - 1
                start = None

    def text(self, r: int, c: int) -> str | None:
        kind, num, text = self.rows.get(r, {}).get(c, ("", None, None))
        return text if kind == "str" else f"{num:g}" if kind == "num" else None

    def title(self, r: int, c0: int, c1: int, taken: set[tuple[int, int]]) -> str:
        """The nearest text above the run, or above its left end, that belongs to no other block."""
        for up in range(r - 1, max(-1, r - 1 - TITLE_ROWS), -1):
            for c in [c0, *range(c0 + 1, c1 + 1), *range(c0 - 1, -1, -1)]:
                if (up, c) not in taken and self.rows.get(up, {}).get(c, ("",))[0] == "str":
                    return self.rows[up][c][2]
        return ""

    def blocks(self) -> Iterator[tuple]:
        """(block, header_row, title, col, header, role, row, num, str) of every cell below a header."""
        taken: set[tuple[int, int]] = set()
        number = 0
        for r in sorted(self.rows):
            for c0, c1 in self.runs(r):
                if any((r, c) in taken for c in range(c0, c1 + 1)):
                    continue
                title = self.title(r, c0, c1, taken)
                rows, at = [], r + 1
                while any(c in self.rows.get(at, {}) for c in range(c0, c1 + 1)) and not (at > r + 1 and any(a <= c1 and c0 <= b for a, b in self.runs(at))):
                    rows.append(at)
                    at += 1
                taken.update((x, c) for x in [r, *rows] for c in range(c0, c1 + 1))
                yield from self.block(number, r, title, c0, c1, rows)
                number += 1

    def block(self, number: int, r: int, title: str, c0: int, c1: int, rows: list[int]) -> Iterator[tuple]:
        # What a row sums up may be told in its first cell or left of it.
        told = {x: next((SUMMARIES[t.strip().lower()] for c in (c0, c0 - 1) if (t := self.text(x, c)) and t.strip().lower() in SUMMARIES), None) for x in rows}
        plain = [x for x in rows if not told[x]]
        for c in range(c0, c1 + 1):
            header = (self.text(r, c) or "").strip()
            own = [self.rows.get(x, {}).get(c) for x in plain]
            nums = [v[1] for v in own if v and v[0] == "num"]
            texts = sum(1 for v in own if v and v[0] == "str")
            if nums and c == c0 and _INDEX.match(header) and nums == list(range(int(nums[0]), int(nums[0]) + len(nums))) and not texts:
                continue  # numbers its rows
            role = "value" if len(nums) >= max(1, texts) else "category"
            for x in rows:
                kind, num, text = self.rows.get(x, {}).get(c, ("", None, None))
                if kind and not (told[x] and kind == "str"):
                    yield number, r, title, c, header, told[x] or role, x, num if kind == "num" else None, text


def blocks(cells: DataFrame) -> DataFrame:
    """Cells as rows of blocks; a sheet is read by one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(Sheet(pdf).blocks())
        out = pd.DataFrame(rows, columns=["block", "header_row", "title", "col", "header", "role", "row", "num", "str"])
        out.insert(0, "path", pdf["path"].iloc[0])
        out.insert(1, "sheet", pdf["sheet"].iloc[0])
        return out

    return cells.filter("kind <> 'error'").groupBy("path", "sheet").applyInPandas(run, BLOCKS)


def with_figures(rows: DataFrame) -> DataFrame:
    """rows with number, panels and explicit: the figure that a block's title begins with, else its sheet's, else its file's (explicit false).

    A workbook in which no block's title or sheet tells a figure is no Source Data and gives no rows.
    """
    head = F.regexp_extract("title", r"(?i)^\s*((?:extended data |supp(?:lementary)?\.? )?fig(?:ure)?s?\.? ?s?[0-9]{1,2} ?(?:[a-z](?:[-–,&][a-z])*)?)(?:[^a-z0-9]|$)", 1)
    own = labels.figure_label(head)
    of_file = labels.figure_from_filename(F.col("path"))
    sheets = labels.sheet_label(F.col("sheet"), of_file["number"], F.lit(True))
    told = F.coalesce(F.when(own.isNotNull(), F.struct(own["number"].alias("number"), own["panels"].alias("panels"))), sheets)
    out = rows.withColumn("_f", told)
    known = out.filter("_f IS NOT NULL").select("path").distinct()
    label = F.coalesce("_f", F.when(of_file.isNotNull(), F.struct(of_file["number"].alias("number"), of_file["panels"].alias("panels"))))
    return out.join(known, "path", "left_semi").select(*rows.columns, label["number"].alias("number"), F.array_join(label["panels"], ",").alias("panels"), F.col("_f").isNotNull().alias("explicit"))
