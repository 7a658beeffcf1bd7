"""Repeated records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def flag_repeats(rows: DataFrame, key: list[Column], order: list[Column], id_col: str) -> DataFrame:
    """duplicate_of: the id of the first row with the same key, null for that row itself."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("duplicate_of", F.when(F.row_number().over(w) > 1, F.first(id_col).over(w)))


def flag_all_repeats(rows: DataFrame, key: list[Column]) -> DataFrame:
    """duplicate_review on every row whose key, complete in all parts, stands more than once."""
    complete = F.lit(True)
    for c in key:
        complete = complete & c.isNotNull()
    return rows.withColumn("duplicate_review", complete & (F.count(F.lit(1)).over(Window.partitionBy(*key)) > 1))
