"""Workbooks (.xlsx, .xlsm) as rows of text cells, with merged ranges expanded; no spreadsheet library is needed."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def cell_position(ref: str) -> tuple[int, int]:
    """Row and column, from 0, of a reference such as B12."""
    m = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref)
    if not m:
        raise ValueError(ref)
    col = 0
    for c in m.group(1):
        col = col * 26 + ord(c) - 64
    return int(m.group(2)) - 1, col - 1


def parse_workbook(content: bytes, merges: bool = True) -> Iterator[tuple[str, bool, int, list[str | None]]]:
    """``(sheet, is_active, row_idx, cells)`` of every row, sheets in order; the value of a merged range stands in all its cells."""
    z = zipfile.ZipFile(io.BytesIO(content))
    names = set(z.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS):
            shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    view = book.find("m:bookViews/m:workbookView", _NS)
    active = int(view.get("activeTab", "0")) if view is not None else 0
    for i, s in enumerate(book.findall("m:sheets/m:sheet", _NS)):
        target = rels[s.get(_REL)].lstrip("/")
        root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
        grid: dict[tuple[int, int], str] = {}
        for c in root.iter(f"{{{_NS['m']}}}c"):
            kind, v = c.get("t"), c.find("m:v", _NS)
            if kind == "inlineStr":
                text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
            elif v is None or v.text is None:
                continue
            else:
                text = shared[int(v.text)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}.get(v.text, v.text) if kind == "b" else v.text
            grid[cell_position(c.get("r"))] = text
        if merges:
            for m in root.findall("m:mergeCells/m:mergeCell", _NS):
                a, b = m.get("ref").split(":")
                (r1, c1), (r2, c2) = cell_position(a), cell_position(b)
                top = grid.get((r1, c1))
                if top is not None:
                    for r in range(r1, r2 + 1):
                        for k in range(c1, c2 + 1):
                            grid[r, k] = top
        width = max((c for _, c in grid), default=-1) + 1
        for r in sorted({r for r, _ in grid}):
            yield s.get("name"), i == active, r, [grid.get((r, c)) for c in range(width)]


def read_workbooks(spark: SparkSession, path: str, merges: bool = True) -> DataFrame:
    """``(file_name, sheet, is_active, row_idx, cells)`` of all workbooks under ``path``; files are read side by side."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(p.rsplit("/", 1)[-1], *r) for r in parse_workbook(bytes(c), merges)]
                yield pd.DataFrame(rows, columns=["file_name", "sheet", "is_active", "row_idx", "cells"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "file_name string, sheet string, is_active boolean, row_idx int, cells array<string>")


def preferred_sheet(rows: DataFrame, sentinel: str) -> DataFrame:
    """The active sheet of each file if it holds the sentinel, else the first that does."""
    from pyspark.sql import functions as F

    hit = rows.filter(F.exists("cells", lambda c: F.lower(F.coalesce(c, F.lit(""))).contains(sentinel.lower())))
    return hit.groupBy("file_name").agg(F.min_by("sheet", F.struct((~F.col("is_active")).cast("int"), "row_idx", "sheet")).alias("sheet"))
