"""All named queries of the core and their SQL."""

from __future__ import annotations

from . import files, models, panel, panel_sql, quality, quality_sql

FLAGSHIP = "feature_matrix"


def queries() -> dict:
    return panel.queries() | files.queries() | models.queries() | quality.queries()


def oracle_sql() -> dict[str, str]:
    return dict(panel_sql.SQL) | files.SQL | models.SQL | dict(quality_sql.SQL)
