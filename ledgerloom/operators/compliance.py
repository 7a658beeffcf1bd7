"""Withholding on payments: thresholds, rates, deposits, interest and government control totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.amounts import MONEY, percent_of, strict_sum
from ..functions.dates import interest_periods


def prior_total(amount: Column, partition: list[Column], order: list[Column]) -> Column:
    """The sum over the rows before this one."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(amount).over(w), F.lit(0)).cast(MONEY)


def taxable_subject(amount: Column, prior: Column, per_transaction: Column, aggregate: Column, excess_only: Column) -> Column:
    """What of the amount is taxed where either threshold is set: both are exceeded by more only, not by as much."""
    cumulative = prior + amount
    single = F.coalesce(amount > per_transaction, F.lit(False))
    total = F.coalesce(cumulative > aggregate, F.lit(False))
    excess = cumulative - F.greatest(prior, aggregate)
    return F.when(total & F.coalesce(excess_only, F.lit(False)), excess).when(single | total, amount).otherwise(0).cast(MONEY)


def single_threshold_subject(amount: Column, prior: Column, threshold: Column, mode: Column, excess_only: Column) -> Column:
    """The same with the one threshold of older rules, which is reached by as much; null for an unknown mode."""
    cumulative = prior + amount
    crossing = F.when(cumulative < threshold, 0).when(cumulative == threshold, F.when(excess_only, 0).otherwise(amount)).otherwise(F.when(excess_only, cumulative - F.greatest(prior, threshold)).otherwise(amount))
    return F.when(mode == "PER_TRANSACTION", F.when(amount >= threshold, amount).otherwise(0)).when(mode.isin("AGGREGATE", "BOTH"), crossing).cast(MONEY)


def rate(certificate: Column, certificate_valid: Column, pan_state: Column, no_pan_rate: Column, rule_rate: Column) -> Column:
    """The rate in percent; null where it must be reviewed."""
    return (
        F.when(certificate.isNotNull(), F.when(certificate_valid, certificate))
        .when(pan_state.isin("NOT_PROVIDED", "FORMAT_INVALID", "INVALID"), no_pan_rate)
        .otherwise(rule_rate)
    )


def deduction_status(actual: Column, expected: Column) -> Column:
    return (
        F.when(expected.isNull(), "NOT_DETERMINABLE").when(actual.isNull(), "ACTUAL_TDS_NOT_PROVIDED")
        .when(actual == expected, "COMPLIANT").when(actual < expected, "SHORT_DEDUCTION").otherwise("EXCESS_DEDUCTION")
    )


def calculation_status(law: Column, nature: Column, duplicate: Column, rule_state: Column, base: Column, subject: Column, rate_: Column) -> Column:
    """The first of the conditions that fails, in their order."""
    return (
        F.when(law == "LAW_NOT_DETERMINABLE", "LAW_NOT_DETERMINABLE")
        .when(nature.isNull(), "REVIEW_REQUIRED")
        .when(duplicate, "REVIEW_REQUIRED")
        .when(rule_state != "FOUND", "RULE_NOT_FOUND")
        .when(base.isNull(), "INSUFFICIENT_DATA")
        .when(base < 0, "REVIEW_REQUIRED")
        .when(subject.isNull(), "REVIEW_REQUIRED")
        .when(rate_.isNull(), "REVIEW_REQUIRED")
        .otherwise("CALCULATED")
    )


def deposits(liabilities: DataFrame, evidence: DataFrame) -> DataFrame:
    """Liabilities (id, expected, deducted_on, due_on) with what evidence (reference, amount, day) shows.

    deposited is null without evidence or with evidence that lacks its amount; deposited_on only if all days are known.
    """
    of = evidence.groupBy(F.col("reference").alias("id")).agg(
        strict_sum(F.col("amount")).alias("deposited"), F.when(F.count("day") == F.count(F.lit(1)), F.max("day")).alias("deposited_on"), F.min("day").alias("first_day"), F.count("*").alias("records")
    )
    joined = liabilities.join(of, "id", "left")
    amount = F.when(F.col("records").isNull(), "DEPOSIT_MISSING").when(F.col("deposited").isNull(), "REVIEW_REQUIRED").when(F.col("deposited") == F.col("expected"), "DEPOSIT_MATCHED").when(F.col("deposited") < F.col("expected"), "DEPOSIT_SHORT").otherwise("DEPOSIT_EXCESS")
    early = F.col("first_day") < F.col("deducted_on")
    time = F.when(F.col("records").isNull(), "NOT_DETERMINABLE").when(F.col("deposited_on").isNull() | early, "REVIEW_REQUIRED").when(F.col("deposited_on") > F.col("due_on"), "LATE").otherwise("ON_TIME")
    out = joined.withColumn("amount_status", amount).withColumn("time_status", time)
    wrong = F.col("amount_status").isin("DEPOSIT_SHORT", "DEPOSIT_EXCESS")
    overall = (
        F.when(F.col("amount_status") == "DEPOSIT_MISSING", "MISSING_DEPOSIT_EVIDENCE")
        .when((F.col("amount_status") == "REVIEW_REQUIRED") | (F.col("time_status") == "REVIEW_REQUIRED"), "REVIEW_REQUIRED")
        .when(wrong & (F.col("time_status") == "LATE"), "DEPOSIT_AND_TIMELINESS_EXCEPTION")
        .when(wrong, "DEPOSIT_AMOUNT_EXCEPTION")
        .when(F.col("time_status") == "LATE", "DEPOSIT_TIMELINESS_EXCEPTION")
        .otherwise("FULLY_DEPOSIT_COMPLIANT")
    )
    return out.withColumn("overall", overall).drop("first_day", "records")


def interest(base: Column, rate_: Column, start: Column, end: Column, due: Column | None = None, method: str = "CALENDAR_MONTH_OR_PART", block_days: int = 30) -> Column:
    """Simple interest for the months or blocks of a delay; with ``due`` only if the end lies after it."""
    periods = interest_periods(start, end, method, block_days)
    charged = F.when((due.isNotNull() & (end <= due)) if due is not None else F.lit(False), 0).otherwise(periods)
    return percent_of(base, (rate_ * charged).cast("decimal(12,4)"))


def shortfall(expected: Column, actual: Column) -> Column:
    return F.greatest(F.lit(0).cast(MONEY), expected - actual)


def control_totals(calculated: DataFrame, government: DataFrame, keys: list[str]) -> DataFrame:
    """Our total, which is null unless every row has its amount, against the government's, which skips missing ones."""
    ours = calculated.groupBy(*keys).agg(strict_sum(F.col("actual")).cast(MONEY).alias("ours"), F.count("*").alias("records"))
    theirs = government.groupBy(*keys).agg(F.sum("amount").cast(MONEY).alias("theirs"))
    both = ours.join(theirs, keys, "full")
    status = F.when(F.col("ours").isNull() | F.col("theirs").isNull(), "NOT_DETERMINABLE").when(F.col("ours") == F.col("theirs"), "TDS_CONTROL_MATCH").otherwise("TDS_CONTROL_DIFFERENCE")
    return both.withColumn("control_status", status).withColumn("difference", (F.col("ours") - F.col("theirs")).cast(MONEY))
