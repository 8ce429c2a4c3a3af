"""Wide and long forms, schema alignment and column order."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpivot_years(df: DataFrame, ids: list[str], pattern: str, year: str = "year", value: str = "value") -> DataFrame:
    """Columns whose names match ``pattern`` (one group: the year) as rows; null cells are left out."""
    cols = [(c, m.group(1)) for c in df.columns if (m := re.fullmatch(pattern, c))]
    cells = F.array(*[F.struct(F.lit(int(y)).alias(year), F.col(c).cast("double").alias(value)) for c, y in cols])
    return df.select(*ids, F.explode(cells).alias("c")).select(*ids, "c.*").filter(F.col(value).isNotNull() & ~F.isnan(value))


def snapshots_to_long(df: DataFrame, ids: list[str], measures: list[str], years: list[int], year: str = "fiscal_year") -> DataFrame:
    """``measure_year`` columns as one row per id and year; a year none of whose columns exist is skipped."""
    have = [y for y in years if any(f"{m}_{y}" in df.columns for m in measures)]
    rows = [F.struct(F.lit(y).alias(year), *[(F.col(f"{m}_{y}") if f"{m}_{y}" in df.columns else F.lit(None).cast("double")).alias(m) for m in measures]) for y in have]
    return df.select(*ids, F.explode(F.array(*rows)).alias("r")).select(*ids, "r.*")


def contingency(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of ``row`` by ``column``; ``values`` are listed, so no extra pass finds them; absent cells are 0."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Frames of differing columns on top of each other, missing columns null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def ordered(df: DataFrame, first: list[str]) -> DataFrame:
    """Known columns first, in their order, extras behind them."""
    head = [c for c in first if c in df.columns]
    return df.select(*head, *[c for c in df.columns if c not in head])


def drop_suffixed(df: DataFrame, suffix: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.endswith(suffix)])


def find_column(df: DataFrame, candidates: list[str], wanted: str | None = None) -> str | None:
    """The first candidate the frame has, by name in any case; an explicit wish wins."""
    by_name = {c.lower(): c for c in df.columns}
    for c in [wanted] if wanted else candidates:
        if c and c.lower() in by_name:
            return by_name[c.lower()]
    return None


def collapse(df: DataFrame, is_part, key: list[str], means: list[str], keep: dict[str, object]) -> DataFrame:  # noqa: ANN001
    """Rows that are parts of one entity as one row of plain means; other measures are nulled, other rows stay."""
    parts = df.filter(is_part).groupBy(*key).agg(*[F.avg(m).alias(m) for m in means])
    for c, v in keep.items():
        parts = parts.withColumn(c, F.lit(v))
    return df.filter(~is_part).unionByName(parts, allowMissingColumns=True)


def drop_empty_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows of which any column holds something; all columns, or those of ``columns``."""
    return df.dropna("all", subset=columns)


def preview(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows by ``order``, for a report."""
    return df.orderBy(*order).limit(n)
