"""Tax on payments by statutory rules: every payment with its rule, threshold, rate, expected tax, and why not where there is none.

A payment goes up a ladder of conditions; the first that fails is its reason.  Those that reach the threshold add to the
running total of their deductee, year, rule and nature, in the order of the credit date, else the payment date, else last,
whatever becomes of them further up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import MONEY
from ..functions.dates import governing_law
from ..functions.text import blank_to_null, pan_status
from ..operators import compliance, statutory
from ..sources.shared import kept
from . import greedy

# Fixed value: the control contract that contractor evidence names.
CONTRACT = "CONTRACTOR_WITHHOLDING_V1"
#: Rounding precisions that a rule may ask for.
PRECISIONS = (0, 1, 2, 3, 4)
WIDE = "decimal(38,8)"
# What a failed condition makes of a payment: (calculation, compliance).
REVIEW, NO_RULE = ("REVIEW_REQUIRED", "REVIEW_REQUIRED"), ("RULE_NOT_FOUND", "REVIEW_REQUIRED")
OPTIONAL = {
    "payment_nature": "string", "section": "string", "duplicate_status": "string", "residency_given": "string", "deductee_type": "string", "recipient_category": "string", "payer_category": "string",
    "organization_id": "string", "client_id": "string", "assignment_id": "string", "deductee_pan": "string", "vendor_code": "string", "deductee_name": "string", "taxable_amount": MONEY, "tds_deducted": MONEY,
    "certificate_number": "string", "certificate_from": "date", "certificate_to": "date", "certificate_pan": "string", "certificate_nature": "string", "certificate_rate": MONEY,
    "facts": "array<struct<fact_type:string,value_code:string,condition:string,status:string,reference:string>>", "control_contract": "string",
    "residency_status": "string", "residency_reference": "string", "payer_status": "string", "payer_reference": "string", "exception_status": "string", "exception_type": "string", "exception_reference": "string",
    "personal_attested": "boolean", "personal_payer_type": "string", "personal_reference": "string", "carriage_count": "int", "carriage_business": "string", "carriage_declaration": "string", "carriage_pan": "string",
    "carriage_particulars": "string", "material_status": "string", "material_reference": "string",
}
RULE_OPTIONAL = {
    "scope": "string", "organization_id": "string", "client_id": "string", "assignment_id": "string", "active": "boolean", "financial_year": "string", "effective_from": "date", "effective_to": "date", "deductee_type": "string",
    "generalized": "boolean", "residency": "string", "recipient_category": "string", "payer_category": "string", "requirements": "array<struct<fact_type:string,value_code:string,condition:string>>", "section": "string",
    "historical_section": "string", "priority": "int", "rate": MONEY, "no_pan_rate": MONEY, "per_transaction": MONEY, "aggregate": MONEY, "threshold": MONEY, "threshold_type": "string", "excess_only": "boolean",
    "basis": "string", "base_field": "string", "rounding_precision": "int", "rounding_method": "string",
}
#: What the threshold and the rounding read of a rule.
TERMS = ("per_transaction", "aggregate", "threshold", "threshold_type", "excess_only", "rounding_method", "rounding_precision")
#: Columns that say something of a contractor's control.
CONTROL = tuple(c for c in OPTIONAL if c.startswith(("residency_s", "residency_r", "payer_s", "payer_r", "exception_", "personal_", "carriage_", "material_")))


def _with(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def _either(*conditions: Column) -> Column:
    return reduce(lambda x, y: x | y, conditions)


def ruled(payments: DataFrame, rules: DataFrame, last_day_of_old: str) -> DataFrame:
    """payments with act, event_date, nature, residency, rule, rule_state, rate and what contractor evidence says.

    payments: (transaction_id, row_no, credit_date, payment_date, financial_year, amount) and any of OPTIONAL;
    rules: (rule_id, act, nature, lifecycle) and any of RULE_OPTIONAL.
    """
    t, rules = _with(payments, OPTIONAL), _with(rules, RULE_OPTIONAL)
    if "pan_status" not in t.columns:
        t = t.withColumn("pan_status", pan_status(F.col("deductee_pan")))
    law = governing_law(F.col("credit_date"), F.col("payment_date"), last_day_of_old)
    t = t.withColumns({
        "act": F.when(law != "LAW_NOT_DETERMINABLE", law), "event_date": F.least("credit_date", "payment_date"), "nature": statutory.payment_nature(F.col("payment_nature")),
        "residency": statutory.residency(F.col("residency_given"), F.col("residency_status")), "pan": F.col("deductee_pan"),
    })
    t = statutory.select_statutory(t, rules)
    row = {c: F.col(c) for c in t.columns}
    rate, source = statutory.determined_rate(F.col("rule"), row, F.col("event_date"))
    fits, why = statutory.contractor_applicability(row)
    supplied = _either(blank_to_null(F.col("control_contract")).isNotNull(), *(F.col(c).isNotNull() for c in CONTROL))
    return t.withColumns({"_rate": rate, "_rate_source": source, "_fits": fits, "_why": why, "_supplied": supplied})


def _threshold(rule: Column, current: Column, prior: Column) -> tuple[Column, Column]:
    """(what of the amount is taxed, null for an unknown mode; the threshold's status)."""
    cumulative = prior + current
    mode = F.upper(F.coalesce(blank_to_null(rule["threshold_type"]), F.lit("NO_THRESHOLD")))
    both = rule["per_transaction"].isNotNull() | rule["aggregate"].isNotNull()
    per, total = F.coalesce(current > rule["per_transaction"], F.lit(False)), F.coalesce(cumulative > rule["aggregate"], F.lit(False))
    none = rule["threshold"].isNull() | (mode == "NO_THRESHOLD")
    excess = F.coalesce(rule["excess_only"], F.lit(False)) | (mode == "AGGREGATE_EXCESS")
    single = compliance.single_threshold_subject(current, prior, rule["threshold"], F.when(mode == "AGGREGATE_EXCESS", "AGGREGATE").otherwise(mode), excess)
    subject = F.when(both, compliance.taxable_subject(current, prior, rule["per_transaction"], rule["aggregate"], mode == "AGGREGATE_EXCESS")).when(none, current).otherwise(single)
    met = F.when(mode == "PER_TRANSACTION", current).otherwise(cumulative)
    status = (
        F.when(both & per & total, "PER_TRANSACTION_AND_AGGREGATE_THRESHOLD_MET").when(both & per, "PER_TRANSACTION_THRESHOLD_MET").when(both & total, "AGGREGATE_THRESHOLD_MET").when(both, "BELOW_CONFIGURED_THRESHOLDS")
        .when(none, "NOT_APPLICABLE").when(single.isNull(), "NOT_DETERMINABLE").when(met < rule["threshold"], "BELOW_THRESHOLD").when(met == rule["threshold"], "THRESHOLD_REACHED").otherwise("ABOVE_THRESHOLD")
    )
    return subject.cast(MONEY), status


def _base(t: DataFrame, amount: Column, taxable: Column) -> Column:
    """What the rule taxes of such a payment."""
    rule, given = F.col("rule"), {"amount": amount, "taxable_amount": taxable}
    basis = F.lower(F.coalesce(blank_to_null(rule["basis"]), F.lit("full_amount")))
    numbers = [f.name for f in t.schema.fields if f.dataType.simpleString().startswith("decimal")]
    fields = F.create_map(*(x for c in numbers for x in (F.lit(c), given.get(c, F.col(c)).cast("decimal(38,2)"))))
    return F.when(basis == "taxable_amount", taxable).when(basis == "full_amount", amount).when(basis == "rule_defined_base", F.try_element_at(fields, rule["base_field"])).cast(MONEY)


def _pick(ladder: list[tuple], k: int) -> Column:
    return F.coalesce(*(F.when(c[0], c[k] if isinstance(c[k], Column) else F.lit(c[k])) for c in ladder))


def _first() -> list[tuple]:
    """(condition, reason, calculation, compliance), in this order; those of base are the last."""
    rule, state, base = F.col("rule"), F.col("rule_state"), F.col("base")
    fits, why, supplied = F.col("_fits"), F.col("_why"), F.col("_supplied")
    contract = F.coalesce(F.col("control_contract") == CONTRACT, F.lit(False))
    review_states = ("SECTION_CONFLICT", "RECIPIENT_RESIDENCY_REQUIRED", "CLASSIFICATION_FACT_REQUIRED")
    return [
        (F.col("act").isNull(), F.lit("LAW_NOT_DETERMINABLE"), "LAW_NOT_DETERMINABLE", "LAW_EXCEPTION"),
        (F.col("nature").isNull(), F.lit("PAYMENT_NATURE_NOT_DETERMINABLE"), *REVIEW),
        (F.coalesce(F.col("duplicate_status") == "DUPLICATE_REVIEW", F.lit(False)), F.lit("DUPLICATE_REVIEW"), *REVIEW),
        (rule.isNull() & state.isin(*review_states), state, *REVIEW),
        (rule.isNull(), state, *NO_RULE),
        (supplied & ~contract, F.lit("CONTRACTOR_CONTROL_CONTRACT_INVALID"), *REVIEW),
        (supplied & (fits == "NOT_APPLICABLE"), why, "NOT_APPLICABLE", "RULE_EXCEPTION"),
        (supplied & (fits != "APPLICABLE"), why, *REVIEW),
        ((F.col("act") == "INCOME_TAX_ACT_2025") & ~F.coalesce(rule["section"].startswith("393"), F.lit(False)), F.lit("NEW_ACT_REFERENCE_REQUIRED"), *REVIEW),
        (base.isNull(), F.lit("AMOUNT_UNAVAILABLE"), "INSUFFICIENT_DATA", "DATA_EXCEPTION"),
        (base < 0, F.lit("NEGATIVE_AMOUNT_REVIEW"), *REVIEW),
    ]


def _settled(t: DataFrame) -> DataFrame:
    """Rows with base, prior, _terms and what the first conditions made of them: up the rest of the ladder."""
    rule = F.col("_terms")
    subject, status = _threshold(rule, F.col("base"), F.col("prior"))
    t = t.withColumn("_through", F.col("_reason").isNull())
    through = F.col("_through")
    t = t.withColumns({"subject": F.when(through, subject), "threshold_status": F.when(through, status), "cumulative": F.when(through, F.col("prior") + F.col("base")).cast(MONEY)})
    method, precision = F.upper(F.coalesce(blank_to_null(rule["rounding_method"]), F.lit("HALF_UP"))), F.coalesce(rule["rounding_precision"], F.lit(2))
    second = [
        (F.col("subject").isNull(), F.lit("THRESHOLD_NOT_DETERMINABLE"), *REVIEW),
        (F.col("_rate").isNull(), F.col("_rate_source"), *REVIEW),
        ((method != "HALF_UP") | ~precision.isin(*PRECISIONS), F.lit("ROUNDING_METHOD_UNSUPPORTED"), *REVIEW),
    ]
    t = t.withColumns({"_reason": F.coalesce("_reason", _pick(second, 1)), "_calculation": F.coalesce("_calculation", _pick(second, 2)), "_compliance": F.coalesce("_compliance", _pick(second, 3))})
    exact = (F.col("subject") * F.col("_rate") * F.lit("0.01").cast("decimal(3,2)")).cast(WIDE)
    rounded = F.coalesce(*(F.when(precision == p, F.round(exact, p)) for p in PRECISIONS)).cast("decimal(22,4)")
    done = F.col("_reason").isNull()
    t = t.withColumn("expected", F.when(done, rounded).when(F.col("_calculation") == "NOT_APPLICABLE", F.lit(0)).cast("decimal(22,4)"))
    actual = F.col("tds_deducted").cast("decimal(22,4)")
    deduction = F.when(done, compliance.deduction_status(actual, F.col("expected"))).when(F.col("_calculation") == "NOT_APPLICABLE", "NOT_APPLICABLE").otherwise("NOT_DETERMINABLE")
    t = t.withColumn("deduction_status", deduction)
    found = F.when(done, F.when(F.col("deduction_status") == "ACTUAL_TDS_NOT_PROVIDED", "NOT_DETERMINABLE").otherwise(F.col("deduction_status"))).otherwise(F.col("_compliance"))
    return t.withColumns({
        "prior": F.when(through, F.col("prior")), "rate": F.when(through, F.col("_rate")), "rate_source": F.when(through, F.col("_rate_source")), "difference": F.when(done, actual - F.col("expected")),
        "calculation_status": F.coalesce("_calculation", F.lit("CALCULATED")), "compliance_status": found,
    })


def calculate(payments: DataFrame, rules: DataFrame, last_day_of_old: str = "2026-03-31") -> DataFrame:
    """(transaction_id, assignment_id, act, nature, rule_id, prior, cumulative, subject, threshold_status, rate, rate_source,
    expected, actual, difference, calculation_status, deduction_status, compliance_status, reason_code)."""
    t = ruled(payments, rules, last_day_of_old)
    t = t.withColumn("base", _base(t, F.col("amount"), F.col("taxable_amount")))
    deductee = F.coalesce(*(blank_to_null(F.col(c)) for c in ("deductee_pan", "vendor_code", "deductee_name")))
    # the rest of the ladder reads no more than this
    t = kept(t.select(
        "transaction_id", "assignment_id", "row_no", "financial_year", "act", "nature", "tds_deducted", "base", "_rate", "_rate_source", F.col("rule")["rule_id"].alias("_rule"), F.struct(*(F.col("rule")[c].alias(c) for c in TERMS)).alias("_terms"),
        *(_pick(_first(), k).alias(c) for k, c in ((1, "_reason"), (2, "_calculation"), (3, "_compliance"))), deductee.alias("_deductee"), F.coalesce("credit_date", "payment_date", F.lit("9999-12-31").cast("date")).alias("_day"),
    ))
    reached = greedy.running_total(t.filter("_reason is null"), ["assignment_id", "financial_year", "_deductee", "_rule", "nature"], [F.col("_day").asc(), F.coalesce("row_no", F.lit(0)).asc()], "base", "_prior")
    t = reached.unionByName(t.filter("_reason is not null").withColumn("_prior", F.lit(None).cast("decimal(38,2)")), allowMissingColumns=True)
    return _settled(t.withColumn("prior", F.col("_prior").cast(MONEY))).select(
        "transaction_id", "assignment_id", "act", "nature", F.col("_rule").alias("rule_id"), "prior", "cumulative", "subject", "threshold_status", "rate", "rate_source", "expected", F.col("tds_deducted").alias("actual"),
        "difference", "calculation_status", "deduction_status", "compliance_status", F.col("_reason").alias("reason_code"),
    )


def calculator(requests: DataFrame, rules: DataFrame, last_day_of_old: str = "2026-03-31") -> DataFrame:
    """Single payments through the same ladder: calculate's columns, and payment_mode, gross, net and status.

    requests: payments with payment_mode (GROSS or NET_OF_TDS) and previous_aggregate, what was paid before.  That counts
    only where such a payment would: as one of the request's own rule and ledger it passes the conditions that the request
    passes, but for those of its base.  A net amount is grossed up by the rule's rate, if the rule has no threshold mode.
    Each request is a ledger of its own, so its row is all that it takes: nothing is sorted, joined or stored.
    """
    t = _with(requests, {"payment_mode": "string", "previous_aggregate": MONEY})
    mode = F.upper(F.coalesce(blank_to_null(F.col("payment_mode")), F.lit("GROSS")))
    t = t.withColumn("payment_mode", mode).withColumn("assignment_id", F.col("transaction_id").cast("string"))
    t = ruled(t, rules, last_day_of_old)
    net, rule, rate = F.col("payment_mode") == "NET_OF_TDS", F.col("rule"), F.col("_rate")
    reason = (
        F.when(~F.col("payment_mode").isin("GROSS", "NET_OF_TDS"), "PAYMENT_MODE_INVALID").when(F.col("amount").isNull() | (F.col("amount") < 0), "AMOUNT_UNAVAILABLE")
        .when(net & rule.isNull(), F.col("rule_state")).when(net & rate.isNull(), F.col("_rate_source"))
        .when(net & (F.upper(F.coalesce(blank_to_null(rule["threshold_type"]), F.lit("NO_THRESHOLD"))) != "NO_THRESHOLD"), "NET_MODE_THRESHOLD_REVIEW").when(net & (rate >= 100), "NET_MODE_RATE_INVALID")
    )
    refused = F.col("_refused")
    status = F.when(refused == "AMOUNT_UNAVAILABLE", "MISSING_REQUIRED_INPUT").when(net & rule.isNull() & (refused == F.col("rule_state")), "RULE_NOT_FOUND").otherwise("REVIEW_REQUIRED")
    share = (F.lit(1).cast(WIDE) - rate.cast(WIDE) * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(12,6)")
    gross = F.round(F.when(net, F.col("amount").cast("decimal(24,8)") / share).otherwise(F.col("amount")), 2).cast(MONEY)
    own, before = _base(t, F.col("_gross"), F.col("taxable_amount")), _base(t, F.col("previous_aggregate"), F.lit(None).cast(MONEY))
    t = t.withColumn("_refused", reason)
    t = t.withColumns({"_state": F.when(refused.isNotNull(), status), "_gross": F.when(refused.isNull(), gross)})
    t = t.withColumns({"base": own, "prior": F.coalesce(F.when((F.col("previous_aggregate") > 0) & (before >= 0), before), F.lit(0)).cast(MONEY), "_terms": F.when(rule.isNotNull(), F.struct(*(rule[c].alias(c) for c in TERMS)))})
    t = t.withColumns({"_reason": F.coalesce("_refused", _pick(_first(), 1)), "_calculation": F.coalesce("_state", _pick(_first(), 2)), "_compliance": _pick(_first(), 3)})
    asked = lambda c: F.when(refused.isNull(), c)
    done = F.col("calculation_status") == "CALCULATED"
    return _settled(t).select(
        "transaction_id", "payment_mode", F.col("amount").alias("entered"), F.when(done, F.col("_gross")).alias("gross"), F.when(done, F.col("_gross") - F.col("expected")).alias("net"), asked(rule["rule_id"]).alias("rule_id"),
        F.col("prior").alias("threshold_consumed"), "subject", "threshold_status", "rate", "expected", asked(F.col("tds_deducted")).alias("actual"), "difference", asked(F.col("deduction_status")).alias("deduction_status"),
        F.col("calculation_status").alias("status"), F.col("_reason").alias("reason_code"),
    )
