"""Choosing statutory rules and policies for payments, and what the evidence for a choice says.

Rules and policies are configuration, kept by hand: MOST_RULES at most, which is checked.  They travel as one array beside
every payment, and a choice is a chain of filters over it, so no payment is joined, shuffled or multiplied.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import deposit_deadline
from ..functions.text import blank_to_null

MOST_RULES = 10_000
# The controlled vocabularies.
RESIDENCIES = ("RESIDENT", "NON_RESIDENT", "FOREIGN_COMPANY")
NATURES = (
    "contractor", "professional_fee", "technical_service", "rent_machinery", "rent_building", "commission", "brokerage", "purchase_of_goods", "interest", "other_specified_payment",
    "salary", "provident_fund", "insurance_commission", "commission_brokerage", "rent", "immovable_property", "jda", "compulsory_acquisition", "mutual_fund_units", "business_trust",
    "investment_fund", "securitisation_trust", "interest_securities", "interest_other", "professional_service", "director_remuneration", "royalty", "dividend", "life_insurance",
    "senior_citizen", "benefit_perquisite", "ecommerce", "virtual_digital_asset", "lottery", "online_game", "horse_race", "lottery_commission", "cash_withdrawal",
    "national_savings_scheme", "partner_remuneration_interest", "non_resident_interest", "non_resident_capital_gain", "non_resident_other_income", "foreign_sports_person",
)
NATURE_ALIASES = {"contract": "contractor", "professional fees": "professional_fee", "technical services": "technical_service"}
EXCEPTION_STATUSES = ("NO_EXCEPTION_CONFIRMED", "EXCEPTION_CONFIRMED", "NOT_ASSESSED", "INSUFFICIENT_EVIDENCE")
PERSONAL, CARRIAGE = "PERSONAL_PURPOSE_INDIVIDUAL_HUF", "GOODS_CARRIAGE"
MATERIAL_STATUSES = ("NO_CUSTOMER_SUPPLIED_MATERIAL_CONFIRMED", "CUSTOMER_SUPPLIED_MATERIAL_NOT_SEPARATELY_STATED", "CUSTOMER_SUPPLIED_MATERIAL_SEPARATELY_STATED", "INSUFFICIENT_EVIDENCE")


def with_rules(rows: DataFrame, rules: DataFrame, name: str) -> DataFrame:
    """rows with all rules as one array; ValueError beyond MOST_RULES."""
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules are no configuration")
    return rows.withColumn(name, rules.agg(F.sort_array(F.collect_list(F.struct(*rules.columns)))).scalar())


def payment_nature(given: Column) -> Column:
    """The controlled nature that a source names, else null."""
    value = F.replace(F.lower(F.trim(given)), F.lit("-"), F.lit("_"))
    known = F.when(value.isin(*NATURES), value)
    for alias, nature in NATURE_ALIASES.items():
        known = F.when(value == alias, nature).otherwise(known)
    return known


def nature_status(given: Column) -> Column:
    return F.when(payment_nature(given).isNotNull(), "CLASSIFIED").when(blank_to_null(given).isNotNull(), "REVIEW_REQUIRED").otherwise("NOT_DETERMINABLE")


def residency(given: Column, contractor: Column) -> Column:
    """A controlled value that was given, else what contractor evidence confirms; never drawn from an identifier."""
    value = F.upper(F.trim(given))
    return F.when(value.isin(*RESIDENCIES), value).when(F.upper(contractor) == "CONFIRMED_RESIDENT", "RESIDENT").when(F.upper(contractor) == "CONFIRMED_NON_RESIDENT", "NON_RESIDENT")


def pan_evidence(operational: Column, reference: Column) -> Column:
    stated = F.upper(operational)
    backed = (stated == "VERIFIED") & blank_to_null(reference).isNotNull()
    return F.when(F.coalesce(backed, F.lit(False)), "EVIDENCE_BACKED").when(stated == "UNAVAILABLE", "EVIDENCE_UNAVAILABLE").otherwise("NOT_VERIFIED")


def in_scope(rule: Column, row) -> Column:
    """GLOBAL fits all; ORGANIZATION, CLIENT and ASSIGNMENT ask for one more equal identifier each."""
    scope = F.upper(F.coalesce(blank_to_null(rule["scope"]), F.lit("GLOBAL")))
    same = lambda c: rule[c].eqNullSafe(row[c])
    inner = (scope != "ASSIGNMENT") | same("assignment_id")
    return (scope == "GLOBAL") | (same("organization_id") & ((scope == "ORGANIZATION") | (same("client_id") & inner)))


def _effective(rule: Column, day: Column) -> Column:
    return F.coalesce(day.between(F.coalesce(rule["effective_from"], F.lit("0001-01-01").cast("date")), F.coalesce(rule["effective_to"], F.lit("9999-12-31").cast("date"))), F.lit(False))


def _open_or(wanted: Column, given: Column) -> Column:
    """The rule asks for nothing, or for just this."""
    return blank_to_null(wanted).isNull() | wanted.eqNullSafe(given)


def _best(candidates: Column) -> Column:
    """Of an array of rules, those of the highest priority."""
    top = F.array_max(F.transform(candidates, lambda r: F.coalesce(r["priority"], F.lit(0))))
    return F.filter(candidates, lambda r: F.coalesce(r["priority"], F.lit(0)) == top)


def select_statutory(payments: DataFrame, rules: DataFrame) -> DataFrame:
    """payments with ``rule``, the only one of highest priority that its whole chain of conditions leaves, and ``rule_state``.

    payments: act, event_date, section, nature, residency, financial_year, deductee_type, recipient_category, payer_category,
    organization_id, client_id, assignment_id, facts.  rules: the same conditions, active, lifecycle, priority, generalized,
    historical_section, requirements.  Where nothing is left, the state names what failed: residency, a fact, the section.
    """
    row = {c: F.col(c) for c in payments.columns}
    section = F.upper(blank_to_null(row["section"]))
    t = with_rules(payments, rules, "_rules")
    conditions = lambda r: reduce(lambda x, y: x & y, [
        in_scope(r, row), F.coalesce(r["active"], F.lit(True)), F.coalesce(r["lifecycle"] == "ACTIVE", F.lit(False)), r["act"].eqNullSafe(row["act"]), _open_or(r["financial_year"], row["financial_year"]),
        _effective(r, row["event_date"]),
        blank_to_null(r["nature"]).isNull() | F.when(row["nature"].isNotNull(), r["nature"] == row["nature"]).otherwise(section.isNotNull()),
        _open_or(r["deductee_type"], row["deductee_type"]),
    ])
    general = lambda r: ~F.coalesce(r["generalized"], F.lit(False)) | (
        (blank_to_null(r["residency"]).isNull() | F.coalesce(r["residency"] == row["residency"], F.lit(False))) & _open_or(r["recipient_category"], row["recipient_category"]) & _open_or(r["payer_category"], row["payer_category"])
    )
    proven = lambda q: F.exists(
        F.coalesce(row["facts"], F.array().cast(payments.schema["facts"].dataType)),
        lambda f: (f["fact_type"] == q["fact_type"]) & (f["value_code"] == q["value_code"]) & f["condition"].eqNullSafe(q["condition"]) & (f["status"] == "VERIFIED") & blank_to_null(f["reference"]).isNotNull(),
    )
    facts = lambda r: F.coalesce(F.forall(r["requirements"], proven), F.lit(True))
    named = lambda r: section.isNull() | blank_to_null(r["section"]).isNull() | F.coalesce(section == F.upper(r["section"]), F.lit(False)) | F.coalesce(section == F.upper(r["historical_section"]), F.lit(False))
    t = t.withColumn("_in", F.filter("_rules", conditions)).withColumn("_general", F.filter("_in", general))
    t = t.withColumn("_facts", F.filter("_general", facts)).withColumn("_named", F.filter("_facts", named)).withColumn("_best", _best(F.col("_named")))
    lacks = row["residency"].isNull() & F.exists("_in", lambda r: F.coalesce(r["generalized"], F.lit(False)) & blank_to_null(r["residency"]).isNotNull())
    state = (
        F.when(row["act"].isNull() | row["event_date"].isNull(), "LAW_NOT_DETERMINABLE")
        .when((F.size("_named") == 0) & lacks, "RECIPIENT_RESIDENCY_REQUIRED").when((F.size("_named") == 0) & (F.size("_facts") < F.size("_general")), "CLASSIFICATION_FACT_REQUIRED")
        .when((F.size("_named") == 0) & (F.size("_named") < F.size("_facts")), "SECTION_CONFLICT").when(F.size("_named") == 0, "RULE_NOT_FOUND")
        .when(F.size("_best") != 1, "RULE_AMBIGUOUS").when(section.isNotNull(), "SECTION_CONFIRMED").otherwise("SECTION_MISSING")
    )
    t = t.withColumn("rule_state", state)
    return t.withColumn("rule", F.when(F.col("rule_state").isin("SECTION_CONFIRMED", "SECTION_MISSING"), F.get("_best", F.lit(0)))).drop("_rules", "_in", "_general", "_facts", "_named", "_best")


def determined_rate(rule: Column, row, day: Column) -> tuple[Column, Column]:
    """(the rate in percent, where it comes from): a valid certificate, the rate without a PAN, the rule's own."""
    valid = (
        blank_to_null(row["certificate_number"]).isNotNull() & day.between(row["certificate_from"], row["certificate_to"])
        & (blank_to_null(row["certificate_pan"]).isNull() | (F.upper(row["certificate_pan"]) == F.upper(row["pan"]))) & _open_or(row["certificate_nature"], row["nature"])
    )
    valid = F.coalesce(valid, F.lit(False))
    certified, no_pan = row["certificate_rate"].isNotNull(), row["pan_status"].isin("NOT_PROVIDED", "FORMAT_INVALID", "INVALID")
    rate = F.when(rule.isNull() | day.isNull(), None).when(certified, F.when(valid, row["certificate_rate"])).when(no_pan, rule["no_pan_rate"]).otherwise(rule["rate"])
    source = (
        F.when(rule.isNull() | day.isNull(), "RATE_NOT_DETERMINABLE").when(certified, F.when(valid, "VALID_LOWER_OR_NIL_CERTIFICATE").otherwise("CERTIFICATE_INVALID_OR_EXPIRED"))
        .when(no_pan, F.when(rule["no_pan_rate"].isNull(), "PAN_TREATMENT_UNAVAILABLE").otherwise("CONFIGURED_NO_PAN_RATE"))
        .when(rule["rate"].isNull(), "RATE_NOT_DETERMINABLE").otherwise("CONFIGURED_RULE")
    )
    return rate, source


def contractor_applicability(row) -> tuple[Column, Column]:
    """(APPLICABLE, NOT_APPLICABLE or REVIEW_REQUIRED, why): the first thing that the evidence lacks or rules out."""
    upper = lambda c, default: F.upper(F.coalesce(blank_to_null(row[c]), F.lit(default)))
    given = lambda c: blank_to_null(row[c]).isNotNull()
    lives, pays, excepted = upper("residency_status", "INSUFFICIENT_EVIDENCE"), upper("payer_status", "INSUFFICIENT_EVIDENCE"), upper("exception_status", "NOT_ASSESSED")
    kind, material = F.upper(F.coalesce(row["exception_type"], F.lit(""))), upper("material_status", "INSUFFICIENT_EVIDENCE")
    personal = F.coalesce(row["personal_attested"], F.lit(False)) & F.coalesce(row["personal_payer_type"] == "INDIVIDUAL_HUF", F.lit(False)) & given("personal_reference")
    carriage = F.coalesce(row["carriage_count"].between(0, 10), F.lit(False)) & given("carriage_business") & given("carriage_declaration") & given("carriage_pan") & given("carriage_particulars")
    asserted = (kind != "") | row["personal_attested"].isNotNull() | row["carriage_count"].isNotNull() | reduce(
        lambda x, y: x | y, map(given, ("personal_payer_type", "personal_reference", "carriage_business", "carriage_declaration", "carriage_pan", "carriage_particulars"))
    )
    review, no, yes = "REVIEW_REQUIRED", "NOT_APPLICABLE", "APPLICABLE"
    confirmed = excepted == "EXCEPTION_CONFIRMED"
    ladder = [
        (~lives.isin("CONFIRMED_RESIDENT", "CONFIRMED_NON_RESIDENT", "INSUFFICIENT_EVIDENCE") | ~given("residency_reference"), review, "CONTRACTOR_RESIDENCY_EVIDENCE_REQUIRED"),
        (lives == "CONFIRMED_NON_RESIDENT", no, "CONTRACTOR_RECIPIENT_CONFIRMED_NON_RESIDENT"),
        (lives != "CONFIRMED_RESIDENT", review, "CONTRACTOR_RESIDENCY_UNRESOLVED"),
        (~pays.isin("CONFIRMED_ELIGIBLE", "CONFIRMED_INELIGIBLE", "INSUFFICIENT_EVIDENCE") | ~given("payer_reference"), review, "PAYER_ELIGIBILITY_EVIDENCE_REQUIRED"),
        ((pays == "CONFIRMED_INELIGIBLE") & (confirmed | (kind != "")), review, "CONTRACTOR_EVIDENCE_CONTRADICTORY"),
        (pays == "CONFIRMED_INELIGIBLE", no, "PAYER_CONFIRMED_INELIGIBLE"),
        (pays != "CONFIRMED_ELIGIBLE", review, "PAYER_ELIGIBILITY_UNRESOLVED"),
        (~excepted.isin(*EXCEPTION_STATUSES), review, "CONTRACTOR_EXCEPTION_STATUS_INVALID"),
        (confirmed & (~kind.isin(PERSONAL, CARRIAGE) | ~given("exception_reference")), review, "CONTRACTOR_EXCEPTION_EVIDENCE_REQUIRED"),
        (confirmed & (kind == PERSONAL) & ~personal, review, "PERSONAL_PURPOSE_EVIDENCE_REQUIRED"),
        (confirmed & (kind == CARRIAGE) & ~carriage, review, "GOODS_CARRIAGE_EVIDENCE_REQUIRED"),
        (confirmed & (kind == PERSONAL), no, f"CONTRACTOR_EXCEPTION_{PERSONAL}"),
        (confirmed, no, f"CONTRACTOR_EXCEPTION_{CARRIAGE}"),
        ((excepted == "NO_EXCEPTION_CONFIRMED") & asserted, review, "CONTRACTOR_EVIDENCE_CONTRADICTORY"),
        ((excepted != "NO_EXCEPTION_CONFIRMED") | ~given("exception_reference"), review, "CONTRACTOR_EXCEPTION_NOT_ASSESSED"),
        (~material.isin(*MATERIAL_STATUSES) | ~given("material_reference"), review, "CONTRACTOR_INVOICE_MATERIAL_EVIDENCE_REQUIRED"),
        (material == "CUSTOMER_SUPPLIED_MATERIAL_SEPARATELY_STATED", review, "CONTRACTOR_MATERIAL_BASE_REVIEW_REQUIRED"),
        (material == "INSUFFICIENT_EVIDENCE", review, "CONTRACTOR_INVOICE_MATERIAL_UNRESOLVED"),
        (F.lit(True), yes, "CONTRACTOR_APPLICABILITY_CONFIRMED"),
    ]
    pick = lambda k: F.coalesce(*(F.when(x[0], F.lit(x[k])) for x in ladder))
    return pick(1), pick(2)


def due_date_policy(rows: DataFrame, policies: DataFrame) -> DataFrame:
    """rows with the due date of the one approved policy that fits, else why it must be reviewed.

    rows: act, financial_year, deductee_type, section, deductor_type, challan_route, deduction_date.  policies: the same,
    approved, effective_from, effective_to, mode, days, month, day.
    """
    r = {c: F.col(c) for c in rows.columns}
    t = with_rules(rows, policies, "_policies")
    fits = lambda p: reduce(lambda x, y: x & y, [
        F.coalesce(p["approved"], F.lit(False)), p["act"].eqNullSafe(r["act"]), p["financial_year"].eqNullSafe(r["financial_year"]), _open_or(p["deductee_type"], r["deductee_type"]),
        blank_to_null(r["section"]).isNull() | p["section"].eqNullSafe(r["section"]), p["deductor_type"].eqNullSafe(r["deductor_type"]), p["challan_route"].eqNullSafe(r["challan_route"]), _effective(p, r["deduction_date"]),
    ])
    t = t.withColumn("_fit", F.filter("_policies", fits))
    p = F.get("_fit", F.lit(0))
    day = r["deduction_date"]
    fixed = F.try_to_date(F.concat_ws("-", F.year(day) + (p["month"] < F.month(day)).cast("int"), p["month"], p["day"]), "yyyy-M-d")
    due = (
        F.when(p["mode"] == "DEDUCTION_DATE", day).when((p["mode"] == "MONTH_END_PLUS_DAYS") & (p["days"] >= 0), F.date_add(deposit_deadline(day, "MONTH_END_PLUS_DAYS", 0), p["days"]))
        .when(p["mode"] == "FIXED_MONTH_DAY", fixed)
    )
    reason = (
        F.when(day.isNull(), "DEDUCTION_DATE_REQUIRED").when(~F.coalesce(r["deductor_type"].isin("GOVERNMENT_OFFICE", "OTHER_DEDUCTOR"), F.lit(False)), "DEDUCTOR_TYPE_REQUIRED")
        .when((r["deductor_type"] == "GOVERNMENT_OFFICE") & ~F.coalesce(r["challan_route"].isin("WITH_CHALLAN", "WITHOUT_CHALLAN"), F.lit(False)), "CHALLAN_ROUTE_REQUIRED")
        .when(F.size("_fit") == 0, "DUE_DATE_POLICY_NOT_CONFIGURED").when(F.size("_fit") > 1, "DUE_DATE_POLICY_AMBIGUOUS").when(due.isNull(), "DUE_DATE_POLICY_INVALID").otherwise("CONFIGURED_DUE_DATE")
    )
    t = t.withColumn("reason", reason)
    return t.withColumn("due_date", F.when(F.col("reason") == "CONFIGURED_DUE_DATE", due)).drop("_policies", "_fit")


def _chosen(rows: DataFrame, policies: DataFrame, fits, out: str, absent: str, ambiguous: str) -> DataFrame:
    t = with_rules(rows, policies, "_all").withColumn("_best", _best(F.filter("_all", fits)))
    state = F.when(F.size("_best") == 0, absent).when(F.size("_best") > 1, ambiguous).otherwise("FOUND")
    return t.withColumn(f"{out}_state", state).withColumn(out, F.when(F.size("_best") == 1, F.get("_best", F.lit(0)))).drop("_all", "_best")


def interest_rule(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (interest_type, act, event_date, nature, deductee_type) with the one governed rule of highest priority."""
    r = {c: F.col(c) for c in rows.columns}
    fits = lambda x: (
        (x["interest_type"] == r["interest_type"]) & F.coalesce(x["active"], F.lit(True)) & F.coalesce(x["lifecycle"].isin("APPROVED", "ACTIVE"), F.lit(False)) & F.coalesce(x["governed"], F.lit(False))
        & x["act"].eqNullSafe(r["act"]) & _effective(x, r["event_date"]) & _open_or(x["nature"], r["nature"]) & _open_or(x["deductee_type"], r["deductee_type"])
    )
    return _chosen(rows, rules, fits, "interest_rule", "RULE_NOT_FOUND", "RULE_AMBIGUOUS")


def deposit_policy(rows: DataFrame, policies: DataFrame) -> DataFrame:
    """rows (financial_year, event_date) with the one approved policy of highest priority; an open list of years fits all."""
    r = {c: F.col(c) for c in rows.columns}
    fits = lambda p: (
        F.coalesce(p["active"], F.lit(False)) & F.coalesce(p["status"].isin("APPROVED", "ACTIVE"), F.lit(False))
        & ((F.coalesce(F.size(p["financial_years"]), F.lit(0)) <= 0) | F.coalesce(F.array_contains(p["financial_years"], r["financial_year"]), F.lit(False)))
        & (r["event_date"].isNull() | _effective(p, r["event_date"]))
    )
    return _chosen(rows, policies, fits, "policy", "PHASE5_POLICY_NOT_FOUND", "PHASE5_POLICY_AMBIGUOUS")
