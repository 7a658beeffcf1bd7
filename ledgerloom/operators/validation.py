"""Checks of ingested rows: what stops a file, what sets a row aside, what only warns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# First cells of rows that are totals, not records.
FOOTERS = ("total", "grand_total", "subtotal", "closing_balance", "opening_balance")
FOOTER_PATTERN = r"(?i)\b(opening balance|closing balance|grand total|subtotal|total)\b"
SEVERITIES = ("error", "row_exception", "warning", "info")


def is_footer(first_key: Column, keys: Column, header: Column) -> Column:
    """A total, or the header once more: at least three of its keys."""
    return first_key.isin(*FOOTERS) | (F.size(F.array_intersect(keys, header)) >= 3)


def row_exceptions(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Adds messages, all checks that fail, and validation_state; such rows stay but take no part in matching."""
    messages = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())))
    state = F.when(F.size("messages") > 0, "UNAVAILABLE_FOR_MATCHING").otherwise("AVAILABLE")
    return rows.withColumn("messages", messages).withColumn("validation_state", state)


def issues(rows: DataFrame, checks: dict[str, tuple[str, Column]], row_no: str, sample: int = 20) -> DataFrame:
    """(problem, severity, rows, first_rows): each failing check with its count and its first rows' numbers."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(name).alias("problem"), F.lit(s).alias("severity"))) for name, (s, ok) in checks.items())))
    each = rows.select(F.col(row_no).alias("row_no"), F.explode(failed).alias("f")).select("row_no", "f.*")
    each = each.withColumn("_salt", F.pmod("row_no", F.lit(64)))
    # the first rows of each of 64 parts hold the first rows of all; a rank limit keeps every list short
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("row_no"))
    some = each.withColumn("_k", first("problem", "severity", "_salt")).filter(F.col("_k") <= sample)
    some = some.withColumn("_k", first("problem", "severity")).filter(F.col("_k") <= sample)
    lists = some.groupBy("problem", "severity").agg(F.array_sort(F.collect_list("row_no")).alias("first_rows"))
    counts = each.groupBy("problem", "severity").agg(F.count("*").alias("rows"))
    return counts.join(lists, ["problem", "severity"])


def file_status(issue_table: DataFrame) -> DataFrame:
    has = lambda s: F.max((F.col("severity") == s).cast("int")) == 1
    return issue_table.agg(F.when(has("error"), "BLOCKED").when(has("row_exception"), "READY_WITH_EXCEPTIONS").when(has("warning"), "READY_WITH_WARNINGS").otherwise("VALID").alias("status"))


def header_score(cells: Column, aliases: dict[str, tuple[str, bool]]) -> Column:
    """Recognised cells, required ones four times; aliases: key -> (column, required)."""
    known = F.array(*map(F.lit, aliases))
    required = F.array(*(F.lit(k) for k, (_, r) in aliases.items() if r))
    return F.size(F.array_intersect(cells, known)) + 3 * F.size(F.array_intersect(cells, required))
