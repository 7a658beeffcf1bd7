"""Choices of rules and policies, and names that are held against one another, against plain loops."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.text import NAME_STOPWORDS
from ledgerloom.operators import evidence, statutory

DAY = datetime.date
RULE = (
    "rule_id int, scope string, organization_id string, client_id string, assignment_id string, active boolean, lifecycle string, act string, financial_year string, effective_from date, effective_to date, "
    "nature string, deductee_type string, generalized boolean, residency string, recipient_category string, payer_category string, requirements array<struct<fact_type:string,value_code:string,condition:string>>, "
    "section string, historical_section string, priority int, rate decimal(18,2), no_pan_rate decimal(18,2)"
)
PAYMENT = (
    "id int, act string, event_date date, section string, nature string, residency string, financial_year string, deductee_type string, recipient_category string, payer_category string, organization_id string, "
    "client_id string, assignment_id string, facts array<struct<fact_type:string,value_code:string,condition:string,status:string,reference:string>>"
)


def names(schema):
    depth, out, word = 0, [], ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(word.split()[0])
            word = ""
        else:
            word += c
    return out


def select(p, rules):
    """(rule, state) of one payment by loops."""
    if p["act"] is None or p["event_date"] is None:
        return None, "LAW_NOT_DETERMINABLE"
    found, lacks, unproven, conflict = [], False, False, False
    for r in rules:
        scope = r["scope"] or "GLOBAL"
        wanted = {"GLOBAL": [], "ORGANIZATION": ["organization_id"], "CLIENT": ["organization_id", "client_id"], "ASSIGNMENT": ["organization_id", "client_id", "assignment_id"]}[scope]
        if any(r[c] != p[c] for c in wanted) or r["active"] is False or r["lifecycle"] != "ACTIVE" or r["act"] != p["act"] or r["financial_year"] not in (None, p["financial_year"]):
            continue
        if not (r["effective_from"] or DAY.min) <= p["event_date"] <= (r["effective_to"] or DAY.max):
            continue
        if r["nature"] and (r["nature"] != p["nature"] if p["nature"] else not p["section"]):
            continue
        if r["deductee_type"] and r["deductee_type"] != p["deductee_type"]:
            continue
        lacks |= bool(p["residency"] is None and r["generalized"] and r["residency"])
        if r["generalized"] and any(r[c] and r[c] != p[c] for c in ("residency", "recipient_category", "payer_category")):
            continue
        good = lambda q: any(f[:3] == q and f[3] == "VERIFIED" and f[4] for f in p["facts"] or [])
        if not all(map(good, r["requirements"] or [])):
            unproven = True
            continue
        if p["section"] and r["section"] and p["section"].upper() not in (r["section"].upper(), (r["historical_section"] or "").upper()):
            conflict = True
            continue
        found.append(r)
    if not found:
        return None, "RECIPIENT_RESIDENCY_REQUIRED" if lacks else "CLASSIFICATION_FACT_REQUIRED" if unproven else "SECTION_CONFLICT" if conflict else "RULE_NOT_FOUND"
    top = max(r["priority"] or 0 for r in found)
    best = [r for r in found if (r["priority"] or 0) == top]
    if len(best) > 1:
        return None, "RULE_AMBIGUOUS"
    return best[0]["rule_id"], "SECTION_CONFIRMED" if p["section"] else "SECTION_MISSING"


STATES = {"LAW_NOT_DETERMINABLE", "RECIPIENT_RESIDENCY_REQUIRED", "CLASSIFICATION_FACT_REQUIRED", "SECTION_CONFLICT", "RULE_NOT_FOUND", "RULE_AMBIGUOUS", "SECTION_CONFIRMED", "SECTION_MISSING"}


def test_statutory_rules_match_loops(spark):
    assert set().union(*(statutory_states(spark, seed, n) for seed, n in ((5, 14), (6, 5), (7, 5), (8, 4)))) == STATES


def statutory_states(spark, seed, n_rules):
    rng = random.Random(seed)
    pick = rng.choice
    fact = ("KIND", "A", None)
    rules = [
        (i, pick([None, "GLOBAL", "GLOBAL", "ORGANIZATION", "CLIENT", "ASSIGNMENT"]), pick(["o", "p"]), pick(["c", "d"]), "a", pick([True, True, None, False]), pick(["ACTIVE", "ACTIVE", "ACTIVE", "DRAFT"]), pick(["OLD", "NEW"]), pick([None, None, "2024-25"]),
         pick([None, DAY(2024, 1, 1)]), pick([None, DAY(2024, 6, 30)]), pick([None, "rent", "contractor"]), pick([None, None, "COMPANY"]), pick([True, False, None]), pick([None, "RESIDENT"]), pick([None, None, "PERSON"]), None,
         pick([None, None, [], [fact]]), pick([None, "194C", "194I"]), pick([None, "194"]), pick([None, 1, 2, 3]), None, None)
        for i in range(n_rules)
    ]
    payments = [
        (i, pick(["OLD", "NEW", "NEW", None]), pick([DAY(2023, 5, 1), DAY(2024, 3, 1), DAY(2024, 6, 30), DAY(2025, 1, 1), None]), pick([None, None, "194c", "194I", "194", "999"]), pick([None, "rent", "contractor"]), pick([None, "RESIDENT", "NON_RESIDENT"]),
         pick(["2024-25", "2023-24"]), pick([None, "COMPANY"]), pick([None, "PERSON"]), None, "o", pick(["c", "d"]), pick(["a", "b"]), pick([None, [], [(*fact, "VERIFIED", "r")], [(*fact, "VERIFIED", "")], [(*fact, "CLAIMED", "r")]]))
        for i in range(400)
    ]
    out = statutory.select_statutory(spark.createDataFrame(payments, PAYMENT), spark.createDataFrame(rules, RULE)).select("id", F.col("rule.rule_id").alias("rule"), "rule_state").collect()
    as_dicts = lambda rows, schema: [dict(zip(names(schema), r)) for r in rows]
    want = {p["id"]: select(p, as_dicts(rules, RULE)) for p in as_dicts(payments, PAYMENT)}
    assert {r["id"]: (r["rule"], r["rule_state"]) for r in out} == want
    plan = statutory.select_statutory(spark.createDataFrame(payments, PAYMENT), spark.createDataFrame(rules, RULE))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    return {s for _, s in want.values()}


def test_rates(spark):
    rule = F.struct(F.lit(2).cast("decimal(18,2)").alias("rate"), F.when(F.col("k") == 1, 20).cast("decimal(18,2)").alias("no_pan_rate"))
    schema = "k int, certificate_rate int, certificate_number string, certificate_from date, certificate_to date, certificate_pan string, certificate_nature string, pan string, nature string, pan_status string"
    a, b = DAY(2024, 1, 1), DAY(2024, 12, 31)
    rows = [
        ((0, 1, "C1", a, b, None, None, "P", "rent", "x"), 1, "VALID_LOWER_OR_NIL_CERTIFICATE"), ((0, 0, "C1", a, b, "p", "rent", "P", "rent", "x"), 0, "VALID_LOWER_OR_NIL_CERTIFICATE"),
        ((0, 1, None, a, b, None, None, "P", "rent", "x"), None, "CERTIFICATE_INVALID_OR_EXPIRED"), ((0, 1, "C1", None, b, None, None, "P", "rent", "x"), None, "CERTIFICATE_INVALID_OR_EXPIRED"),
        ((0, 1, "C1", a, a, None, None, "P", "rent", "x"), None, "CERTIFICATE_INVALID_OR_EXPIRED"), ((0, 1, "C1", a, b, "Q", None, "P", "rent", "x"), None, "CERTIFICATE_INVALID_OR_EXPIRED"),
        ((0, 1, "C1", a, b, None, "fee", "P", "rent", "x"), None, "CERTIFICATE_INVALID_OR_EXPIRED"), ((1, None, None, None, None, None, None, None, "rent", "NOT_PROVIDED"), 20, "CONFIGURED_NO_PAN_RATE"),
        ((0, None, None, None, None, None, None, "x", "rent", "FORMAT_INVALID"), None, "PAN_TREATMENT_UNAVAILABLE"), ((0, None, None, None, None, None, None, "P", "rent", "FORMAT_VALID_UNVERIFIED"), 2, "CONFIGURED_RULE"),
    ]
    t = spark.createDataFrame([r for r, _, _ in rows], schema)
    rate, source = statutory.determined_rate(rule, {c: F.col(c) for c in t.columns}, F.lit("2024-06-01").cast("date"))
    assert [(None if r[0] is None else int(r[0]), r[1]) for r in t.select(rate, source).collect()] == [(x, y) for _, x, y in rows]


BASE = {
    "residency_status": "CONFIRMED_RESIDENT", "residency_reference": "r", "payer_status": "CONFIRMED_ELIGIBLE", "payer_reference": "r", "exception_status": "NO_EXCEPTION_CONFIRMED", "exception_type": None, "exception_reference": "r",
    "personal_attested": None, "personal_payer_type": None, "personal_reference": None, "carriage_count": None, "carriage_business": None, "carriage_declaration": None, "carriage_pan": None, "carriage_particulars": None,
    "material_status": "NO_CUSTOMER_SUPPLIED_MATERIAL_CONFIRMED", "material_reference": "r",
}
CARRIAGE = {"exception_status": "EXCEPTION_CONFIRMED", "exception_type": "GOODS_CARRIAGE", "carriage_count": 10, "carriage_business": "r", "carriage_declaration": "r", "carriage_pan": "r", "carriage_particulars": "r"}
PERSONAL = {"exception_status": "EXCEPTION_CONFIRMED", "exception_type": "PERSONAL_PURPOSE_INDIVIDUAL_HUF", "personal_attested": True, "personal_payer_type": "INDIVIDUAL_HUF", "personal_reference": "r"}
LADDER = [
    ({}, "APPLICABLE", "CONTRACTOR_APPLICABILITY_CONFIRMED"),
    ({"residency_reference": " "}, "REVIEW_REQUIRED", "CONTRACTOR_RESIDENCY_EVIDENCE_REQUIRED"),
    ({"residency_status": "odd"}, "REVIEW_REQUIRED", "CONTRACTOR_RESIDENCY_EVIDENCE_REQUIRED"),
    ({"residency_status": "confirmed_non_resident", "payer_reference": None}, "NOT_APPLICABLE", "CONTRACTOR_RECIPIENT_CONFIRMED_NON_RESIDENT"),
    ({"residency_status": None}, "REVIEW_REQUIRED", "CONTRACTOR_RESIDENCY_UNRESOLVED"),
    ({"payer_reference": None}, "REVIEW_REQUIRED", "PAYER_ELIGIBILITY_EVIDENCE_REQUIRED"),
    ({"payer_status": "CONFIRMED_INELIGIBLE", "exception_type": "GOODS_CARRIAGE"}, "REVIEW_REQUIRED", "CONTRACTOR_EVIDENCE_CONTRADICTORY"),
    ({"payer_status": "CONFIRMED_INELIGIBLE"}, "NOT_APPLICABLE", "PAYER_CONFIRMED_INELIGIBLE"),
    ({"payer_status": None}, "REVIEW_REQUIRED", "PAYER_ELIGIBILITY_UNRESOLVED"),
    ({"exception_status": "odd"}, "REVIEW_REQUIRED", "CONTRACTOR_EXCEPTION_STATUS_INVALID"),
    ({**CARRIAGE, "exception_type": "OTHER"}, "REVIEW_REQUIRED", "CONTRACTOR_EXCEPTION_EVIDENCE_REQUIRED"),
    ({**PERSONAL, "personal_attested": None}, "REVIEW_REQUIRED", "PERSONAL_PURPOSE_EVIDENCE_REQUIRED"),
    ({**CARRIAGE, "carriage_count": 11}, "REVIEW_REQUIRED", "GOODS_CARRIAGE_EVIDENCE_REQUIRED"),
    (PERSONAL, "NOT_APPLICABLE", "CONTRACTOR_EXCEPTION_PERSONAL_PURPOSE_INDIVIDUAL_HUF"),
    (CARRIAGE, "NOT_APPLICABLE", "CONTRACTOR_EXCEPTION_GOODS_CARRIAGE"),
    ({"carriage_count": 0}, "REVIEW_REQUIRED", "CONTRACTOR_EVIDENCE_CONTRADICTORY"),
    ({"exception_status": None}, "REVIEW_REQUIRED", "CONTRACTOR_EXCEPTION_NOT_ASSESSED"),
    ({"exception_reference": None}, "REVIEW_REQUIRED", "CONTRACTOR_EXCEPTION_NOT_ASSESSED"),
    ({"material_reference": None}, "REVIEW_REQUIRED", "CONTRACTOR_INVOICE_MATERIAL_EVIDENCE_REQUIRED"),
    ({"material_status": "CUSTOMER_SUPPLIED_MATERIAL_SEPARATELY_STATED"}, "REVIEW_REQUIRED", "CONTRACTOR_MATERIAL_BASE_REVIEW_REQUIRED"),
    ({"material_status": None}, "REVIEW_REQUIRED", "CONTRACTOR_INVOICE_MATERIAL_UNRESOLVED"),
]


def test_contractor_applicability(spark):
    kinds = {"personal_attested": "boolean", "carriage_count": "int"}
    t = spark.createDataFrame([tuple((BASE | change).values()) for change, _, _ in LADDER], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in BASE))
    status, reason = statutory.contractor_applicability({c: F.col(c) for c in BASE})
    assert [tuple(r) for r in t.select(status, reason).collect()] == [(s, r) for _, s, r in LADDER]


def test_due_dates_and_policies(spark):
    policies = spark.createDataFrame(
        [
            ("NEW", "2024-25", None, None, "OTHER_DEDUCTOR", None, True, None, DAY(2024, 8, 31), "MONTH_END_PLUS_DAYS", 7, None, None), ("NEW", "2024-25", None, None, "OTHER_DEDUCTOR", None, True, DAY(2025, 3, 1), None, "FIXED_MONTH_DAY", None, 4, 30),
            ("NEW", "2024-25", None, None, "GOVERNMENT_OFFICE", "WITHOUT_CHALLAN", True, None, None, "DEDUCTION_DATE", None, None, None), ("NEW", "2024-25", None, None, "GOVERNMENT_OFFICE", "WITH_CHALLAN", True, None, None, "MONTH_END_PLUS_DAYS", -1, None, None),
            ("OLD", "2024-25", None, None, "OTHER_DEDUCTOR", None, True, None, None, "DEDUCTION_DATE", None, None, None), ("OLD", "2024-25", None, None, "OTHER_DEDUCTOR", None, True, None, None, "DEDUCTION_DATE", None, None, None),
        ],
        "act string, financial_year string, deductee_type string, section string, deductor_type string, challan_route string, approved boolean, effective_from date, effective_to date, mode string, days int, month int, day int",
    )
    rows = [
        (("NEW", "OTHER_DEDUCTOR", None, DAY(2024, 2, 10)), DAY(2024, 3, 7), "CONFIGURED_DUE_DATE"), (("NEW", "OTHER_DEDUCTOR", None, DAY(2025, 3, 15)), DAY(2025, 4, 30), "CONFIGURED_DUE_DATE"),
        (("NEW", "OTHER_DEDUCTOR", None, DAY(2025, 5, 1)), DAY(2026, 4, 30), "CONFIGURED_DUE_DATE"), (("NEW", "OTHER_DEDUCTOR", None, DAY(2024, 10, 1)), None, "DUE_DATE_POLICY_NOT_CONFIGURED"),
        (("NEW", "OTHER_DEDUCTOR", None, None), None, "DEDUCTION_DATE_REQUIRED"), (("NEW", None, None, DAY(2024, 2, 10)), None, "DEDUCTOR_TYPE_REQUIRED"), (("NEW", "GOVERNMENT_OFFICE", None, DAY(2024, 2, 10)), None, "CHALLAN_ROUTE_REQUIRED"),
        (("NEW", "GOVERNMENT_OFFICE", "WITHOUT_CHALLAN", DAY(2024, 2, 10)), DAY(2024, 2, 10), "CONFIGURED_DUE_DATE"), (("NEW", "GOVERNMENT_OFFICE", "WITH_CHALLAN", DAY(2024, 2, 10)), None, "DUE_DATE_POLICY_INVALID"),
        (("OLD", "OTHER_DEDUCTOR", None, DAY(2024, 2, 10)), None, "DUE_DATE_POLICY_AMBIGUOUS"),
    ]
    t = spark.createDataFrame([(a, "2024-25", None, None, d, c, day) for (a, d, c, day), _, _ in rows], "act string, financial_year string, deductee_type string, section string, deductor_type string, challan_route string, deduction_date date")
    assert [(r["due_date"], r["reason"]) for r in statutory.due_date_policy(t, policies).collect()] == [(x, y) for _, x, y in rows]

    p = spark.createDataFrame([(1, True, "APPROVED", ["2024-25"], None, None, 1), (2, True, "ACTIVE", None, None, DAY(2024, 1, 1), 1), (3, True, "ACTIVE", [], DAY(2025, 1, 1), None, 5), (4, None, "ACTIVE", [], None, None, 9)],
                              "policy_id int, active boolean, status string, financial_years array<string>, effective_from date, effective_to date, priority int")
    t = spark.createDataFrame([("2024-25", DAY(2024, 5, 1)), ("2024-25", DAY(2023, 5, 1)), ("2023-24", DAY(2023, 5, 1)), ("2023-24", DAY(2024, 5, 1)), ("2023-24", None)], "financial_year string, event_date date")
    found = statutory.deposit_policy(t, p).select("policy.policy_id", "policy_state").collect()
    assert [tuple(r) for r in found] == [(1, "FOUND"), (None, "PHASE5_POLICY_AMBIGUOUS"), (2, "FOUND"), (None, "PHASE5_POLICY_NOT_FOUND"), (3, "FOUND")]

    rules = spark.createDataFrame([(1, "LATE", None, "ACTIVE", True, "NEW", None, None, None, None, 1), (2, "LATE", True, "APPROVED", True, "NEW", DAY(2024, 1, 1), None, "rent", None, 2), (3, "LATE", True, "ACTIVE", True, "NEW", DAY(2025, 1, 1), None, "rent", None, 2), (4, "LATE", True, "ACTIVE", False, "NEW", None, None, None, None, 9)],
                                  "rule_id int, interest_type string, active boolean, lifecycle string, governed boolean, act string, effective_from date, effective_to date, nature string, deductee_type string, priority int")
    t = spark.createDataFrame([("LATE", "NEW", DAY(2023, 5, 1), "rent", None), ("LATE", "NEW", DAY(2024, 5, 1), "rent", None), ("LATE", "NEW", DAY(2025, 5, 1), "rent", "x"), ("LATE", "NEW", DAY(2025, 5, 1), "fee", None), ("LATE", "OLD", DAY(2025, 5, 1), "fee", None), ("LATE", "NEW", None, "fee", None)],
                              "interest_type string, act string, event_date date, nature string, deductee_type string")
    found = statutory.interest_rule(t, rules).select("interest_rule.rule_id", "interest_rule_state").collect()
    assert [tuple(r) for r in found] == [(1, "FOUND"), (2, "FOUND"), (None, "RULE_AMBIGUOUS"), (1, "FOUND"), (None, "RULE_NOT_FOUND"), (None, "RULE_NOT_FOUND")]
    with pytest.raises(ValueError):
        statutory.with_rules(t, spark.range(statutory.MOST_RULES + 1), "r")


def review(sales, statement):
    words = lambda name, out: [w for w in name.split() if w not in out]
    a, b = (words(x, evidence.ALIGNED_WORDS) for x in (statement, sales))
    at = n = 0
    for w in a:
        hit = [i for i in range(at, len(b)) if b[i] == w or (min(len(b[i]), len(w)) >= 5 and (b[i].startswith(w) or w.startswith(b[i])))]
        if not hit:
            break
        at, n = hit[0] + 1, n + 1
    shared = set(words(sales, NAME_STOPWORDS)) & set(words(statement, NAME_STOPWORDS))
    if n >= 2 and a[0] == b[0]:
        return "EMBEDDED_DEDUCTOR_NAME_VARIANT"
    return "PARTIAL_NORMALIZED_SALES_NAME" if len(shared) >= 2 or any(len(w) >= 6 for w in shared) else None


def test_names_of_sales_and_deductors_match_loops(spark):
    pool = ["ALPHA", "ALPHABET", "OF", "UNIT", "HOSPITAL", "STEEL", "STEELS", "THE", "ZINC", "LONGWORD", "A"]
    rng = random.Random(3)
    pairs = [(" ".join(rng.choices(pool, k=rng.randrange(1, 5))), " ".join(rng.choices(pool, k=rng.randrange(1, 5)))) for _ in range(400)] + [("", "ALPHA"), ("ALPHA", "")]
    pairs += list(itertools.product(["UNIT OF ALPHA STEEL", "ALPHA STEEL ZINC"], ["ALPHA STEELS", "ALPHA ZINC STEEL", "ALPHABET STEEL"]))
    t = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, sales string, statement string")
    found = dict(map(tuple, t.select("id", evidence.sales_review(F.col("sales"), F.col("statement"))).collect()))
    want = {i: review(*p) for i, p in enumerate(pairs)}
    assert found == want and set(want.values()) == {"EMBEDDED_DEDUCTOR_NAME_VARIANT", "PARTIAL_NORMALIZED_SALES_NAME", None}


def test_order_lines_are_moved_once_for_an_audit_of_returns(spark, sf_dir):
    """The keys of both sides are made once; candidates are dealt once for their distinct rows and their tiers."""
    from ledgerloom.queries import QUERIES

    plan = QUERIES["missing_in_return"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "part.parquet" not in plan
    tiers = QUERIES["tiered_candidates"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert tiers.count("Exchange hashpartitioning(row_id") == 1
