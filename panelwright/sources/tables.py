"""Readers and writers of the table formats, with the fallbacks irregular files need."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workbook import read_workbooks


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv_lines(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("utf-8", "windows-1252", "iso-8859-1")) -> DataFrame:
    """Headerless text cells ``(file_name, row_idx, cells)`` of CSV files, first encoding that decodes each file.

    Files are read whole, one record each, since quoted line breaks and row
    numbers need it; a file's size is bounded by what a person typed. Lines
    that cannot be parsed are skipped, a byte order mark is dropped.
    """

    def parse(batches):  # noqa: ANN001, ANN202
        import csv
        import io

        import pandas as pd

        for pdf in batches:
            out = []
            for p, raw in zip(pdf["path"], pdf["content"], strict=True):
                raw, text = bytes(raw), None
                for e in encodings:
                    try:
                        text = raw.decode(e)
                        break
                    except UnicodeDecodeError:
                        continue
                text = (text if text is not None else raw.decode("latin-1")).removeprefix("﻿")
                reader, i = csv.reader(io.StringIO(text, newline="")), 0
                while True:
                    try:
                        row = next(reader)
                    except StopIteration:
                        break
                    except csv.Error:
                        continue
                    out.append((os.path.basename(p), i, row))
                    i += 1
            yield pd.DataFrame(out, columns=["file_name", "row_idx", "cells"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "file_name string, row_idx int, cells array<string>")


def read_csv(spark: SparkSession, path: str, columns: Callable[[str], bool] | None = None, skip: int = 0) -> DataFrame:
    """CSV with a header row; ``columns`` prunes at the scan, ``skip`` lines of preamble are dropped."""
    if skip:
        raw = read_csv_lines(spark, path)
        head = raw.filter(F.col("row_idx") == skip).select("cells").first()
        names = [c.strip() for c in (head["cells"] if head else [])]
        body = raw.filter(F.col("row_idx") > skip)
        keep = [(i, n) for i, n in enumerate(names) if columns is None or columns(n)]
        return body.select(*[F.get("cells", i).alias(n) for i, n in keep])
    df = spark.read.csv(path, header=True, mode="DROPMALFORMED")
    return df if columns is None else df.select(*[c for c in df.columns if columns(c)])


def load(spark: SparkSession, path: str) -> DataFrame:
    """Cells of one file by its suffix: workbooks by sheet, CSV as one sheet."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix in (".xlsx", ".xlsm"):
        return read_workbooks(spark, path)
    if suffix == ".csv":
        return read_csv_lines(spark, path).withColumn("sheet", F.lit("csv"))
    if suffix == ".xls":
        raise ValueError("the old binary workbook format needs a reader that is not installed; save as .xlsx")
    raise ValueError(f"no reader for {suffix}")


def load_directory(spark: SparkSession, pattern: str, read: Callable[[SparkSession, str], DataFrame] = load) -> tuple[DataFrame | None, dict[str, str]]:
    """All files of a pattern in name order on top of each other, and the error of each file that failed alone."""
    import glob

    out, errors = None, {}
    for p in sorted(glob.glob(pattern)):
        try:
            f = read(spark, p)
            f.limit(1).count()
            out = f if out is None else out.unionByName(f, allowMissingColumns=True)
        except Exception as e:  # noqa: BLE001
            errors[os.path.basename(p)] = str(e)[:300]
    return out, errors


def header_row(rows: DataFrame, sentinel: str, exact: bool = True, scan: int = 15) -> DataFrame:
    """The first row of each file that has a cell equal to (or holding) the sentinel."""
    low = F.transform("cells", lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))
    s = sentinel.lower()
    hit = F.exists(low, lambda c: (c == s) if exact else c.contains(s))
    return rows.filter(hit & (F.col("row_idx") < scan)).groupBy("file_name").agg(F.min("row_idx").alias("header_row"))


def largest_sheet(rows: DataFrame) -> DataFrame:
    """The sheet of each file with most rows, ties to the first by name."""
    n = rows.groupBy("file_name", "sheet").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("file_name").agg(F.min_by("sheet", F.struct(-F.col("n"), F.col("sheet"))).alias("sheet"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_text(df: DataFrame, path: str, title: str) -> None:
    """A small report as aligned text; rows stream through the driver one by one."""
    cols = df.columns
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"{title}\n{'=' * len(title)}\n" + " | ".join(cols) + "\n")
        for r in df.toLocalIterator():
            f.write(" | ".join("" if r[c] is None else str(r[c]) for c in cols) + "\n")


def convert_folder(spark: SparkSession, folder: str) -> list[str]:
    """Every parquet table of a folder written as CSV beside it."""
    import glob

    done = []
    for p in sorted(glob.glob(os.path.join(folder, "*.parquet"))):
        write_csv(spark.read.parquet(p), p[: -len(".parquet")] + ".csv")
        done.append(os.path.basename(p))
    return done
