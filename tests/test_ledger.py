"""The ladder of the statutory calculation against a plain loop, and the calculator."""

import datetime
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import ledger

D = datetime.date
RULES = "rule_id int, act string, nature string, lifecycle string, section string, rate decimal(18,2), no_pan_rate decimal(18,2), per_transaction decimal(18,2), aggregate decimal(18,2), threshold decimal(18,2), threshold_type string, excess_only boolean, basis string, base_field string, rounding_precision int, rounding_method string"
PAYMENTS = "transaction_id string, row_no int, credit_date date, payment_date date, financial_year string, payment_nature string, duplicate_status string, amount decimal(18,2), taxable_amount decimal(18,2), fee decimal(18,2), deductee_pan string, vendor_code string, tds_deducted decimal(18,2)"
OLD, NEW = "INCOME_TAX_ACT_1961", "INCOME_TAX_ACT_2025"
TABLE = [
    (1, OLD, "contractor", "ACTIVE", "194C", 1, 20, 30000, 100000, None, "AGGREGATE", False, None, None, 2, None),
    (2, OLD, "professional_fee", "ACTIVE", "194J", 10, None, None, 50000, None, "AGGREGATE_EXCESS", None, "taxable_amount", None, None, "HALF_UP"),
    (3, OLD, "rent", "ACTIVE", "194I", 2, 20, None, None, 40000, "PER_TRANSACTION", None, None, None, 0, None),
    (4, OLD, "royalty", "ACTIVE", "194J", 10, 20, None, None, 60000, "AGGREGATE", True, None, None, 3, None),
    (5, OLD, "dividend", "ACTIVE", "194", 10, 20, None, None, 60000, "SOMETIMES", None, None, None, 2, None),
    (6, OLD, "interest", "ACTIVE", "194A", 10, 20, None, None, None, None, None, "rule_defined_base", "fee", 2, None),
    (7, OLD, "commission", "ACTIVE", "194H", 5, 20, None, None, None, None, None, "full_amount", None, 2, "DOWN"),
    (8, NEW, "contractor", "ACTIVE", "194C", 1, 20, None, None, None, None, None, None, None, 2, None),
    (9, NEW, "rent", "ACTIVE", "393(1)", 2, 20, None, None, 70000, "BOTH", None, "sometimes", None, 2, None),
    (10, NEW, "royalty", "ACTIVE", "393(2)", 10, 20, None, None, 45000, "AGGREGATE_EXCESS", None, None, None, 2, None),
    (11, OLD, "brokerage", "DRAFT", "194H", 5, 20, None, None, None, None, None, None, None, 2, None),
]


def money(x):
    return None if x is None else Decimal(x)


def expected(rows):
    """By the order of days, each payment up the ladder."""
    totals, out = {}, {}
    for r in sorted(rows, key=lambda r: (r["credit_date"] or r["payment_date"] or D(9999, 12, 31), r["row_no"] or 0)):
        say = lambda reason, state="REVIEW_REQUIRED": out.__setitem__(r["transaction_id"], (state, reason, None, None))  # noqa: B023, E731
        days = [d for d in (r["credit_date"], r["payment_date"]) if d]
        nature = {"professional fees": "professional_fee"}.get(r["payment_nature"], r["payment_nature"])
        if not days:
            say("LAW_NOT_DETERMINABLE", "LAW_NOT_DETERMINABLE")
            continue
        if nature not in ("contractor", "professional_fee", "rent", "royalty", "dividend", "interest", "commission", "brokerage"):
            say("PAYMENT_NATURE_NOT_DETERMINABLE")
            continue
        if r["duplicate_status"] == "DUPLICATE_REVIEW":
            say("DUPLICATE_REVIEW")
            continue
        act = OLD if min(days) <= D(2026, 3, 31) else NEW
        found = [t for t in TABLE if t[1] == act and t[2] == nature and t[3] == "ACTIVE"]
        if not found:
            say("RULE_NOT_FOUND", "RULE_NOT_FOUND")
            continue
        number, _, _, _, section, rate, no_pan, per, aggregate, threshold, kind, excess, basis, field, precision, method = found[0]
        if act == NEW and not section.startswith("393"):
            say("NEW_ACT_REFERENCE_REQUIRED")
            continue
        base = r[{"full_amount": "amount", "taxable_amount": "taxable_amount", "rule_defined_base": field}[basis or "full_amount"]] if basis != "sometimes" else None
        if base is None:
            say("AMOUNT_UNAVAILABLE", "INSUFFICIENT_DATA")
            continue
        if base < 0:
            say("NEGATIVE_AMOUNT_REVIEW")
            continue
        key = (r["financial_year"], r["deductee_pan"] or r["vendor_code"], number)
        prior = totals.get(key, Decimal(0))
        total = totals[key] = prior + base
        excess = excess or kind == "AGGREGATE_EXCESS"
        if per is not None or aggregate is not None:
            single, over = per is not None and base > per, aggregate is not None and total > aggregate
            subject = total - max(prior, aggregate) if over and kind == "AGGREGATE_EXCESS" else base if single or over else 0
        elif threshold is None or kind in (None, "NO_THRESHOLD"):
            subject = base
        elif kind == "PER_TRANSACTION":
            subject = base if base >= threshold else 0
        elif kind in ("AGGREGATE", "BOTH", "AGGREGATE_EXCESS"):
            subject = 0 if total < threshold or (total == threshold and excess) else total - max(prior, threshold) if excess else base
        else:
            say("THRESHOLD_NOT_DETERMINABLE")
            continue
        if r["deductee_pan"] is None or len(r["deductee_pan"]) != 10:
            rate = no_pan
        if rate is None:
            say("PAN_TREATMENT_UNAVAILABLE")
            continue
        if method not in (None, "HALF_UP"):
            say("ROUNDING_METHOD_UNSUPPORTED")
            continue
        tax = (Decimal(subject) * rate / 100).quantize(Decimal(1).scaleb(-(2 if precision is None else precision)), ROUND_HALF_UP)
        out[r["transaction_id"]] = ("CALCULATED", None, tax, prior)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_the_ladder(spark, seed):
    rng = random.Random(seed)
    names = [x.split()[0] for x in PAYMENTS.split(", ")]
    amount = lambda: rng.choice([None, Decimal(rng.randrange(-500, 9000000)) / 100, Decimal(25000), Decimal(50000), Decimal("0.5"), Decimal("1234.55")])
    day = lambda: rng.choice([None, *[D(2025, 4, 1) + datetime.timedelta(rng.randrange(500)) for _ in range(5)]])
    rows = []
    for k in range(700):
        values = (f"t{k}", rng.choice([k, k, None]), day(), day(), rng.choice(["2025-26", "2025-26", "2026-27"]), rng.choice(["contractor", "professional fees", "rent", "royalty", "dividend", "interest", "commission", "brokerage", "odd", None]), rng.choice([None] * 9 + ["DUPLICATE_REVIEW"]), amount(), amount(), amount(), rng.choice(["ABCDE1234F", "ABCDE1234G", None, "x"]), rng.choice(["v1", "v2"]), amount())
        rows.append(dict(zip(names, values)))
    rows = [r | {"row_no": k + 1} for k, r in enumerate(rows)]
    df = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], PAYMENTS).repartition(5)
    rules = spark.createDataFrame([tuple(money(x) if 5 <= k <= 9 else x for k, x in enumerate(t)) for t in TABLE], RULES)
    got = {r["transaction_id"]: r for r in ledger.calculate(df, rules).collect()}
    want = expected(rows)
    assert {i: (r["calculation_status"], r["reason_code"], r["expected"]) for i, r in got.items()} == {i: w[:3] for i, w in want.items()}
    assert all(got[i]["prior"] == w[3] for i, w in want.items() if w[0] == "CALCULATED")
    assert {w[1] for w in want.values()} >= {"PAN_TREATMENT_UNAVAILABLE", "THRESHOLD_NOT_DETERMINABLE", "NEW_ACT_REFERENCE_REQUIRED", "ROUNDING_METHOD_UNSUPPORTED", "RULE_NOT_FOUND", None}
    for r in rows:
        g = got[r["transaction_id"]]
        if g["calculation_status"] == "CALCULATED":
            gap = None if r["tds_deducted"] is None else r["tds_deducted"] - g["expected"]
            assert g["deduction_status"] == ("ACTUAL_TDS_NOT_PROVIDED" if gap is None else "COMPLIANT" if gap == 0 else "SHORT_DEDUCTION" if gap < 0 else "EXCESS_DEDUCTION") and g["difference"] == gap


def one(spark, **given):
    values = {"transaction_id": "q", "row_no": 1, "credit_date": D(2025, 5, 1), "payment_date": None, "financial_year": "2025-26", "amount": Decimal(1000), "deductee_pan": "ABCDE1234F"} | given
    kinds = {"row_no": "int", "credit_date": "date", "payment_date": "date", "amount": "decimal(18,2)", "previous_aggregate": "decimal(18,2)", "certificate_rate": "decimal(18,2)", "certificate_from": "date", "certificate_to": "date", "tds_deducted": "decimal(18,2)", "personal_attested": "boolean", "carriage_count": "int"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds.get(k, 'string')}" for k in values))


def several(spark, given):
    """A payment for each of these, numbered; what one does not give is null."""
    out = None
    for k, values in enumerate(given):
        df = one(spark, **({"transaction_id": str(k)} | values))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame([tuple(money(x) if 5 <= k <= 9 else x for k, x in enumerate(t)) for t in TABLE], RULES)


def test_five_rows_cross_the_threshold_with_the_last(spark, rules):
    df = spark.range(5).selectExpr("concat('t', id) as transaction_id", "cast(id as int) as row_no", "date'2025-05-01' as credit_date", "cast(null as date) as payment_date", "'2025-26' as financial_year", "'contract' as payment_nature", "cast(25000 as decimal(18,2)) as amount", "'ABCDE1234F' as deductee_pan")
    assert [r["expected"] for r in ledger.calculate(df, rules).orderBy("transaction_id").collect()] == [0, 0, 0, 0, 250]


def test_contractor_control_and_certificates(spark, rules):
    good = {"control_contract": ledger.CONTRACT, "residency_status": "CONFIRMED_RESIDENT", "residency_reference": "r", "payer_status": "CONFIRMED_ELIGIBLE", "payer_reference": "r", "exception_status": "NO_EXCEPTION_CONFIRMED", "exception_reference": "r", "material_status": "NO_CUSTOMER_SUPPLIED_MATERIAL_CONFIRMED", "material_reference": "r"}
    certificate = {"certificate_number": "c", "certificate_rate": Decimal("0.5"), "certificate_from": D(2025, 4, 1), "certificate_to": D(2026, 3, 31)}
    cases = [
        (good, ("CALCULATED", None, 400)),
        (good | {"control_contract": "other"}, ("REVIEW_REQUIRED", "CONTRACTOR_CONTROL_CONTRACT_INVALID", None)),
        ({"residency_status": "CONFIRMED_RESIDENT"}, ("REVIEW_REQUIRED", "CONTRACTOR_CONTROL_CONTRACT_INVALID", None)),
        (good | {"payer_status": "CONFIRMED_INELIGIBLE"}, ("NOT_APPLICABLE", "PAYER_CONFIRMED_INELIGIBLE", 0)),
        (good | {"payer_status": "x"}, ("REVIEW_REQUIRED", "PAYER_ELIGIBILITY_EVIDENCE_REQUIRED", None)),
        (certificate, ("CALCULATED", None, 200)),
        (certificate | {"certificate_to": D(2025, 4, 2)}, ("REVIEW_REQUIRED", "CERTIFICATE_INVALID_OR_EXPIRED", None)),
        ({"section": "194J"}, ("REVIEW_REQUIRED", "SECTION_CONFLICT", None)),
    ]
    got = {r["transaction_id"]: (r["calculation_status"], r["reason_code"], r["expected"]) for r in ledger.calculate(several(spark, [{"payment_nature": "contractor", "amount": Decimal(40000), "vendor_code": str(k), **g} for k, (g, _) in enumerate(cases)]), rules).collect()}
    assert got == {str(k): w for k, (_, w) in enumerate(cases)}


CASES = [
    ({"payment_nature": "royalty", "amount": Decimal(10000), "previous_aggregate": Decimal(49000)}, ("CALCULATED", None, 0, 10000)),  # below
    ({"payment_nature": "royalty", "amount": Decimal(11000), "previous_aggregate": Decimal(49000)}, ("CALCULATED", None, 0, 11000)),  # at
    ({"payment_nature": "royalty", "amount": Decimal(15000), "previous_aggregate": Decimal(49000)}, ("CALCULATED", None, 400, 14600)),  # above: 10 % of 4,000
    ({"payment_nature": "royalty", "amount": Decimal(15000)}, ("CALCULATED", None, 0, 15000)),
    ({"payment_nature": "professional fees", "amount": Decimal(15000), "previous_aggregate": Decimal(90000)}, ("INSUFFICIENT_DATA", "AMOUNT_UNAVAILABLE", None, None)),
    ({"payment_nature": "interest", "payment_mode": "net_of_tds", "amount": Decimal(900)}, ("INSUFFICIENT_DATA", "AMOUNT_UNAVAILABLE", None, None)),
    ({"payment_nature": "royalty", "payment_mode": "NET_OF_TDS"}, ("REVIEW_REQUIRED", "NET_MODE_THRESHOLD_REVIEW", None, None)),
    ({"payment_nature": "brokerage", "payment_mode": "NET_OF_TDS"}, ("RULE_NOT_FOUND", "RULE_NOT_FOUND", None, None)),
    ({"payment_nature": "royalty", "payment_mode": "SOMEHOW"}, ("REVIEW_REQUIRED", "PAYMENT_MODE_INVALID", None, None)),
    ({"payment_nature": "royalty", "amount": Decimal(-1)}, ("MISSING_REQUIRED_INPUT", "AMOUNT_UNAVAILABLE", None, None)),
]


def test_calculator(spark, rules):
    got = {r["transaction_id"]: (r["status"], r["reason_code"], r["expected"], r["net"]) for r in ledger.calculator(several(spark, [g for g, _ in CASES]), rules).collect()}
    assert got == {str(k): w for k, (_, w) in enumerate(CASES)}


def test_net_amounts_are_grossed_up(spark, rules):
    plain = rules.withColumn("threshold_type", F.when(F.col("rule_id") == 4, F.lit(None)).otherwise(F.col("threshold_type"))).withColumn("threshold", F.lit(None).cast("decimal(18,2)"))
    r = ledger.calculator(one(spark, payment_nature="royalty", payment_mode="NET_OF_TDS", amount=Decimal("900.01")), plain).first()
    assert (r["status"], r["entered"], r["gross"], r["expected"], r["net"]) == ("CALCULATED", Decimal("900.01"), Decimal("1000.01"), Decimal("100.001"), Decimal("900.009"))


def test_the_calculator_needs_nothing_but_a_request_s_row(spark, rules, monkeypatch):
    stored = []
    monkeypatch.setattr(ledger, "kept", lambda df: stored.append(df) or df)
    twice = several(spark, [CASES[2][0], CASES[0][0]]).withColumn("transaction_id", F.lit("same"))
    out = ledger.calculator(twice, rules)
    assert sorted((r["expected"], r["threshold_consumed"]) for r in out.collect()) == [(0, 49000), (400, 49000)]
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("Subquery")[0]
    assert not stored and "Join" not in plan and "Sort" not in plan and "Window" not in plan and "RepartitionBy" not in plan
