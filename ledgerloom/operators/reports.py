"""Summaries of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.amounts import MONEY, zero_sum


def by_quarter(results: DataFrame) -> DataFrame:
    """Totals of both sides by quarter of the books, else of the statement, else a dash."""
    q = F.coalesce("book_quarter", "statement_quarter", F.lit("—")).alias("quarter")
    return results.groupBy(q).agg(zero_sum(F.col("book_amount")).cast(MONEY).alias("books"), zero_sum(F.col("statement_amount")).cast(MONEY).alias("statement"), F.count("*").alias("rows"))


def status_counts(results: DataFrame, column: str, values: list[str], by: list[str]) -> DataFrame:
    """One column of counts for each status."""
    return results.groupBy(*by).agg(*(F.count_if(F.col(column) == v).alias(v.lower()) for v in values))


def once_per_group(results: DataFrame, group: str, amount: str, by: list[str]) -> DataFrame:
    """Sums in which every match group counts once."""
    single = results.select(*by, group, amount).groupBy(*by, group).agg(F.max(amount).alias(amount))
    return single.groupBy(*by).agg(zero_sum(F.col(amount)).cast(MONEY).alias("total"), F.count("*").alias("groups"))


def deductor_overview(statements: DataFrame) -> DataFrame:
    """Each deductor's rows, totals and sections, and whether expected and deducted tax agree."""
    out = statements.groupBy("tan", "name").agg(
        F.count("*").alias("records"), zero_sum(F.col("expected")).cast(MONEY).alias("expected"), zero_sum(F.col("deducted")).cast(MONEY).alias("deducted"), F.countDistinct("section").alias("sections")
    )
    gap = F.col("deducted") - F.col("expected")
    return out.withColumn("difference", gap.cast(MONEY)).withColumn("status", F.when(F.abs(gap) <= 10, "CONSISTENT_WITH_CONFIGURED_RULE").otherwise("TDS_DIFFERENCE"))


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, rows) of every distinct value of each column that is not blank."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns)))
    return rows.select(pairs.alias("p")).select("p.*").filter("value is not null and value != ''").groupBy("facet", "value").agg(F.count("*").alias("rows"))


def top_per_category(rows: DataFrame, category: str, order: list[Column], keep: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(category).orderBy(*order))).filter(F.col("rank") <= keep)


def conservation(selected: DataFrame, parts: DataFrame, id_col: str, amount: str) -> DataFrame:
    """Whether distinct ids of the parts hold the amount of the selected rows: (selected_total, parts_total, conserved)."""
    once = lambda df, name: df.groupBy(id_col).agg(F.max(amount).alias(amount)).agg(zero_sum(F.col(amount)).cast(MONEY).alias(name))
    both = once(selected, "selected_total").join(once(parts, "parts_total"))  # one row each
    return both.withColumn("conserved", F.col("selected_total") == F.col("parts_total"))
