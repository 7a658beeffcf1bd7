"""Filtering, searching, ordering and paging results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The order of severities.
SEVERITY = {"HIGH": 0, "MEDIUM": 1, "LOW": 2, "NONE": 3}


def matching(rows: DataFrame, equal: dict[str, str] | None = None, exclude: dict[str, str] | None = None, either: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Rows whose columns have one of a comma list's values, or have none of it; ``either`` asks any of some columns."""
    values = lambda text: [v.strip() for v in text.split(",") if v.strip()]
    for column, text in (equal or {}).items():
        columns = (either or {}).get(column, (column,))
        cond = F.lit(False)
        for c in columns:
            cond = cond | F.coalesce(F.col(c).isin(*values(text)), F.lit(False))
        rows = rows.filter(cond)
    for column, text in (exclude or {}).items():
        rows = rows.filter(~F.coalesce(F.col(column).isin(*values(text)), F.lit(False)))
    return rows


def containing(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows of which some column holds the text, whatever its case; the text is no pattern."""
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.coalesce(F.lower(F.col(c).cast("string")).contains(text.lower()), F.lit(False))
    return rows.filter(cond)


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def severity_rank(c: Column) -> Column:
    return F.coalesce(F.create_map(*(x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))))[c], F.lit(3))


def ranked_exceptions(rows: DataFrame, severity: str, difference: str, keep: int) -> DataFrame:
    return rows.orderBy(severity_rank(F.col(severity)), F.desc(F.abs(F.col(difference))), *[c for c in ("id",) if c in rows.columns]).limit(keep)


def with_state(rows: DataFrame, states: DataFrame, key: str, column: str = "workflow_state", default: str = "OPEN") -> DataFrame:
    return rows.join(states.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(default)))
