"""Auditing filed returns against the ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tiered_candidates(rows: DataFrame, ledger: DataFrame, tiers: list[tuple[str, str, str]]) -> DataFrame:
    """(row_id, ledger_id, tier): the candidates of the first tier that has any, for each return row.

    Every tier (label, column of rows, column of ledger) is an equi-join.
    """
    parts = []
    for i, (_, a, b) in enumerate(tiers):
        x = rows.select(F.col("id").alias("row_id"), F.col(a).alias("_k")).filter("_k is not null")
        parts.append(x.join(ledger.select(F.col("id").alias("ledger_id"), F.col(b).alias("_k")), "_k").select("row_id", "ledger_id", F.lit(i).alias("_t")))
    union = reduce(DataFrame.unionByName, parts).repartition("row_id").distinct()  # dealt once for both steps
    first = F.min("_t").over(Window.partitionBy("row_id"))
    tier = F.get(F.array(*(F.lit(label) for label, _, _ in tiers)), F.col("_t")).alias("tier")
    return union.withColumn("_first", first).filter("_t = _first").select("row_id", "ledger_id", tier)


def confirmed(candidates: DataFrame) -> DataFrame:
    """Candidates that are their row's only one and that no other single-candidate row claims."""
    n = candidates.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("row_id"))).filter("_n = 1")
    return n.withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy("ledger_id"))).filter("_m = 1").drop("_n", "_m")


def only_rows(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key stands once."""
    return rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key))).filter("_n = 1").drop("_n")


def missing_in_return(ledger: DataFrame, candidates: DataFrame) -> DataFrame:
    return ledger.join(candidates.select(F.col("ledger_id").alias("id")).distinct(), "id", "left_anti")


def full_reconcile(returned: DataFrame, ledger: DataFrame, key: str, amount: str) -> DataFrame:
    """Both sides by key: MATCHED, DIFFERENCE, MISSING_IN_BOOKS or MISSING_IN_RETURN."""
    r = returned.select(key, F.col(amount).alias("returned"), F.lit(True).alias("_r"))
    b = ledger.select(key, F.col(amount).alias("booked"), F.lit(True).alias("_b"))
    both = r.join(b, key, "full")
    status = F.when(F.col("_b").isNull(), "MISSING_IN_BOOKS").when(F.col("_r").isNull(), "MISSING_IN_RETURN").when(F.col("returned") == F.col("booked"), "MATCHED").otherwise("DIFFERENCE")
    return both.select(key, "returned", "booked", status.alias("status"))


def row_status(matched: Column, correction: Column, conflict: Column, calculated: Column, parts: list[Column], deposited: Column) -> Column:
    """A return row's overall status from its parts, each MATCHED, DIFFERENCE or REVIEW_REQUIRED."""
    any_of = lambda value: reduce(lambda x, y: x | y, [F.coalesce(p == value, F.lit(False)) for p in parts])
    return (
        F.when(correction, "CORRECTION_REVIEW_REQUIRED").when(conflict, "CONFLICT").when(~calculated, "REVIEW_REQUIRED").when(~matched, "MISSING_IN_BOOKS")
        .when(any_of("REVIEW_REQUIRED"), "REVIEW_REQUIRED").when(any_of("DIFFERENCE"), "DIFFERENCE").when(~deposited, "MISSING_IN_DEPOSIT_EVIDENCE").otherwise("MATCHED")
    )
