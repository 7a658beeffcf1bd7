"""Governed rules, the state of work and reports over the driver's tables, with the SQL that their rows are held to."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.amounts import MONEY
from .operators import governance, rules
from .plans.frames import STATEMENTS_SQL, load, statements
from .queries import _with, query
from .queries_evidence import _case
from .sources.tables import return_rows


def _key():
    return F.col("o_orderkey")


_CALCULATION = _case("o_orderkey", ["'RULE_NOT_FOUND'", "'INSUFFICIENT_DATA'", "'LAW_NOT_DETERMINABLE'", "'REVIEW_REQUIRED'", "'CALCULATED'", "NULL", "'CALCULATED'"])
_DEDUCTION = _case("o_custkey", ["'ACTUAL_TDS_NOT_PROVIDED'", "'SHORT_DEDUCTION'", "'EXCESS_DEDUCTION'", "'COMPLIANT'", "NULL"])
_COMPLIANCE = _case("o_custkey", ["''", "'COMPLIANCE_OPEN'", "NULL"])


@query(f"""SELECT id, CASE WHEN c = 'LAW_NOT_DETERMINABLE' THEN 'REVIEW_REQUIRED' WHEN c != 'CALCULATED' THEN c WHEN d = 'COMPLIANT' THEN 'MATCHED' WHEN d IS NOT NULL THEN d WHEN x = 'COMPLIANCE_OPEN' THEN x ELSE 'NOT_DETERMINABLE' END AS status
FROM (SELECT o_orderkey AS id, {_CALCULATION} AS c, {_DEDUCTION} AS d, {_COMPLIANCE} AS x FROM orders)""")
def transaction_statuses(spark, d):
    status = governance.transaction_status(*(F.expr(x) for x in (_CALCULATION, _DEDUCTION, _COMPLIANCE)))
    return load(spark, d, "orders").select(_key().alias("id"), status.alias("status"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 11 WHEN 0 THEN 'POLICY_AMBIGUOUS' WHEN 1 THEN 'DUE_DATE_POLICY_NOT_CONFIGURED' WHEN 2 THEN 'DUE_DATE_POLICY_SNAPSHOT_INVALID' WHEN 3 THEN 'DUE_DATE_POLICY_SNAPSHOT_INVALID'
WHEN 4 THEN 'DUE_DATE_POLICY_SNAPSHOT_INVALID' WHEN 5 THEN 'DUE_DATE_POLICY_SNAPSHOT_INVALID' WHEN 7 THEN 'DUE_DATE_POLICY_SNAPSHOT_INVALID' WHEN 8 THEN 'DUE_DATE_POLICY_SNAPSHOT_INVALID' END AS error FROM orders""")
def due_date_gate(spark, d):
    """0 and 1: undecided; 2: no day; 3: inactive; 4: nothing frozen; 5: approved by nobody; 6: provisional; 7: provisional
    with a mark missing; 8: no branch inputs; 9 and 10: sound."""
    k = _key() % 11
    provisional = k.isin(6, 7)
    mark = lambda value: F.when(provisional, F.lit(value))
    snapshot = F.struct(
        F.lit("CONTRACTOR_DEPOSIT_DUE_DATE").alias("policy_kind"), (k != 3).alias("active"), F.lit("ACTIVE").alias("lifecycle"), F.lit("VERIFIED").alias("source_traceability_status"),
        _key().alias("rule_id"), F.lit("v1").alias("rule_version"), F.when(~provisional, "2025-01-01").alias("approved_at"), F.when(~provisional & (k != 5), "u1").alias("approved_by"),
        mark("PROVISIONAL_UAT").alias("policy_status"), mark(False).alias("ca_approved"), mark("isolated_e2e_only").alias("environment"),
        mark("PROVISIONAL").alias("assumption_status"), F.when(k == 6, True).alias("source_gap"), mark(True).alias("ca_review_required"),
    )
    status, reason = F.when(k > 1, "DETERMINED").when(k == 0, "OPEN"), F.when(k == 0, "POLICY_AMBIGUOUS").otherwise("")
    due, inputs = F.when(k != 2, F.col("o_orderdate").cast("date")), F.when(k != 8, F.struct(F.lit(1)))
    error = governance.due_date_error(status, reason, due, F.when(k != 4, snapshot), inputs)
    return load(spark, d, "orders").select(_key().alias("id"), error.alias("error"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 1 THEN 'source_locator' WHEN 3 THEN 'source_authority,verified_at' ELSE '' END AS missing,
CASE p_partkey % 8 WHEN 2 THEN 'source_url must be an absolute https URL' WHEN 4 THEN 'source_document_sha256 must be a SHA-256 hex digest' WHEN 5 THEN 'source_retrieved_at must use YYYY-MM-DD' ELSE '' END AS errors,
CASE WHEN p_partkey % 8 IN (0, 6, 7) THEN 'VERIFIED' ELSE 'VERIFICATION_REQUIRED' END AS traceability, CASE WHEN p_partkey % 3 = 0 THEN 'CA_APPROVAL_RECORDED' ELSE 'CA_APPROVAL_NOT_RECORDED' END AS approval FROM part""")
def rule_traceability(spark, d):
    k = F.col("p_partkey")
    case = lambda n, value, other: F.when(k % 8 == n, value).otherwise(other)
    text = F.lit
    rows = load(spark, d, "part").select(
        k.alias("id"), case(3, " ", "Board").alias("source_authority"), text("").alias("source"), text("").alias("source_provision_reference"), text(None).cast("string").alias("provision_reference"), text("s. 393").alias("section_reference"),
        F.when(k % 8 == 2, "http://example.org/x").when(k % 8 == 6, " HTTPS://example.org ").when(~(k % 8).isin(1, 7), "https://example.org/x").alias("source_url"),
        F.when(k % 8 == 7, "rule.pdf").alias("source_document_filename"), F.when(k % 8 == 7, F.sha2(k.cast("string"), 256)).when(k % 8 == 4, "abc").when(k % 8 == 1, F.sha2(k.cast("string"), 256)).alias("source_document_sha256"),
        text("Act").alias("source_document_title"), text("2025-04-01").alias("effective_from"), text("2026-03-31").alias("effective_to"), case(5, "2025-02-30", "2025-03-01").alias("source_retrieved_at"),
        text("seen").alias("source_verification_evidence"), case(3, "", "2025-03-02").alias("source_verified_at"), F.when(k % 3 == 1, "DRAFT").otherwise("ACTIVE").alias("lifecycle"),
        text("2025-03-03").alias("approved_at"), text("u1").alias("approved_by"), F.when(k % 3 == 0, "a1").otherwise("").alias("approval_reference"), text("CA").alias("approval_authority"),
    )
    return governance.traceability(rows).select("id", F.array_join("missing_fields", ",").alias("missing"), F.array_join("validation_errors", ",").alias("errors"), "traceability", "approval")


@query("""WITH r AS (SELECT o_custkey AS family, o_orderkey AS rule, o_orderkey % 6 AS k, CASE o_orderkey % 6 WHEN 0 THEN o_orderkey * 10 + 2 WHEN 2 THEN o_orderkey * 10 + 2 END AS active_at, CASE o_orderkey % 6 WHEN 2 THEN o_orderkey * 10 + 9000 END AS ended_at FROM orders),
n AS (SELECT a.*, (SELECT min(b.active_at) FROM r b WHERE b.family = a.family AND b.active_at > a.active_at) AS after FROM r a)
SELECT family, rule, CASE WHEN k IN (0, 2) AND after IS NOT NULL AND (ended_at IS NULL OR after < ended_at) THEN 'SUPERSEDED' WHEN k = 0 THEN 'ACTIVE' WHEN k = 1 THEN 'APPROVED' WHEN k = 2 THEN 'DEACTIVATED' WHEN k = 5 THEN 'DEACTIVATED' ELSE 'DRAFT' END AS state,
CASE WHEN k = 1 OR k = 4 OR (k = 2 AND after < ended_at) THEN 1 WHEN k = 5 THEN 1 ELSE 0 END AS refused FROM n""")
def rule_lifecycles(spark, d):
    """By turns: activated; activated before its approval; activated and much later deactivated; untouched; approved as a
    draft; deactivated once approved, then activated."""
    k, at = _key() % 6, _key() * 10
    event = lambda n, action, after=None: F.struct((at + (n if after is None else after)).alias("at"), F.lit(action).alias("action"))
    ready = [event(0, "SUBMITTED"), event(1, "APPROVED")]
    acts = (
        F.when(k == 0, F.array(*ready, event(2, "ACTIVATED"))).when(k == 1, F.array(event(0, "SUBMITTED"), event(1, "ACTIVATED"), event(2, "APPROVED")))
        .when(k == 2, F.array(*ready, event(2, "ACTIVATED"), event(3, "DEACTIVATED", 9000))).when(k == 4, F.array(event(0, "APPROVED")))
        .when(k == 5, F.array(*ready, event(2, "DEACTIVATED"), event(3, "ACTIVATED"))).otherwise(F.array(event(0, None)))
    )
    events = load(spark, d, "orders").select(F.col("o_custkey").alias("family"), _key().alias("rule"), F.explode(acts).alias("e")).select("family", "rule", "e.*")
    return governance.lifecycles(events)


_KINDS = ["'ledger'", "'calculation'", "'deposit'", "'interest'", "'government_evidence'", "'government_verification'"]


@query(f"""WITH v AS (SELECT o_custkey AS c, {_case('o_orderkey', _KINDS)} AS kind, o_orderkey AS version, o_orderkey % 5 AS n, o_orderkey // 7 % 2 AS op FROM orders),
l AS (SELECT c, kind, arg_max(n, version) AS n, arg_max(op, version) AS op FROM v GROUP BY ALL),
p AS (SELECT c_custkey AS c, c_custkey % 4 = 0 AS locked, max(CASE WHEN kind = 'ledger' THEN n END) AS rows_, max(CASE WHEN kind = 'ledger' THEN op END) AS ledger, max(CASE WHEN kind = 'calculation' THEN op END) AS calculation, max(CASE WHEN kind = 'deposit' THEN op END) AS deposit,
  max(CASE WHEN kind = 'interest' THEN op END) AS interest, coalesce(bool_or(kind = 'government_evidence'), FALSE) AS ge, coalesce(bool_or(kind = 'government_verification'), FALSE) AS gv FROM customer LEFT JOIN l ON c = c_custkey GROUP BY 1, 2)
SELECT c AS assignment, 'assignment' AS stage, 'COMPLETED' AS status FROM p UNION ALL SELECT c, 'data_collection', CASE WHEN ledger IS NULL THEN 'NOT_STARTED' ELSE 'COMPLETED' END FROM p
UNION ALL SELECT c, 'classification', CASE WHEN ledger IS NULL THEN 'NOT_STARTED' WHEN ledger = 1 THEN 'BLOCKED' WHEN rows_ = 0 THEN 'IN_PROGRESS' ELSE 'COMPLETED' END FROM p
UNION ALL SELECT c, 'tds_review', coalesce(['COMPLETED', 'BLOCKED'][calculation + 1], 'NOT_STARTED') FROM p UNION ALL SELECT c, 'deposit', coalesce(['COMPLETED', 'BLOCKED'][deposit + 1], 'NOT_STARTED') FROM p UNION ALL SELECT c, 'interest', coalesce(['COMPLETED', 'BLOCKED'][interest + 1], 'NOT_STARTED') FROM p
UNION ALL SELECT c, 'government_evidence', CASE WHEN ge THEN 'COMPLETED' ELSE 'NOT_STARTED' END FROM p UNION ALL SELECT c, 'government_evidence_verification', CASE WHEN gv THEN 'COMPLETED' ELSE 'NOT_STARTED' END FROM p UNION ALL SELECT c, 'return_compliance', 'NOT_STARTED' FROM p
UNION ALL SELECT c, 'ca_review', CASE WHEN locked THEN 'COMPLETED' WHEN calculation IS NOT NULL THEN 'IN_PROGRESS' ELSE 'NOT_STARTED' END FROM p UNION ALL SELECT c, unnest(['approval', 'lock']), CASE WHEN locked THEN 'COMPLETED' ELSE 'NOT_STARTED' END FROM p""")
def workspace_stages(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("assignment"), F.when(F.col("c_custkey") % 4 == 0, "LOCKED").alias("status"))
    v = load(spark, d, "orders").select(F.col("o_custkey").alias("assignment"), F.expr(_case("o_orderkey", _KINDS)).alias("kind"), _key().alias("version"), (_key() % 5).alias("rows"), (F.floor(_key() / 7) % 2).alias("open"))
    return governance.workspace_stages(c, v)


@query("""WITH s AS (SELECT o_orderkey AS id, ['CONFIRMED', 'CONFLICT', '', NULL][o_orderkey % 4 + 1] AS i, ['AMOUNT_MATCHED', NULL, 'AMOUNT_DIFFERENCE'][o_orderkey % 3 + 1] AS a, ['MATCHED', 'DIFFERENCE', 'TDS_MATCHED', NULL, ''][o_orderkey % 5 + 1] AS t FROM orders)
SELECT id, concat_ws(',', CASE WHEN i = 'CONFIRMED' THEN NULL WHEN i = 'CONFLICT' THEN i ELSE 'UNMAPPED' END, CASE WHEN a = 'AMOUNT_MATCHED' THEN NULL ELSE coalesce(a, 'AMOUNT_NOT_DETERMINABLE') END, CASE WHEN t LIKE '%MATCHED' THEN NULL WHEN t = 'DIFFERENCE' THEN t ELSE 'TDS_NOT_DETERMINABLE' END) AS issues
FROM s WHERE NOT (coalesce(i, '') = 'CONFIRMED' AND coalesce(a, '') = 'AMOUNT_MATCHED' AND coalesce(t, '') LIKE '%MATCHED')""")
def exception_issues(spark, d):
    identity = F.when(_key() % 4 == 0, "CONFIRMED").when(_key() % 4 == 1, "CONFLICT").when(_key() % 4 == 2, "")
    amount = F.when(_key() % 3 == 0, "AMOUNT_MATCHED").when(_key() % 3 == 2, "AMOUNT_DIFFERENCE")
    tds = F.when(_key() % 5 == 0, "MATCHED").when(_key() % 5 == 1, "DIFFERENCE").when(_key() % 5 == 2, "TDS_MATCHED").when(_key() % 5 == 4, "")
    rows = load(spark, d, "orders").select(_key().alias("id"), governance.relationship_issues(identity, amount, tds).alias("issues"))
    return rows.filter(F.size("issues") > 0).withColumn("issues", F.array_join("issues", ","))


@query("""SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN '26Q' WHEN 1 THEN 'FORM_140' WHEN 2 THEN 'FORM_144' WHEN 4 THEN '27Q' END AS form, p_partkey % 4 IN (0, 1) AS is_payment FROM part""")
def return_forms_and_roles(spark, d):
    k = F.col("p_partkey")
    text = F.when(k % 6 == 0, "return 26q of").when(k % 6 == 1, "26Q, now Form  140").when(k % 6 == 3, "a26Qb").when(k % 6 == 5, F.concat(F.repeat(F.lit("x"), 8000), F.lit(" 26Q")))
    name = F.when(k % 6 == 2, "FORM144 q1.txt").when(k % 6 == 4, "27q.txt")
    kind, description = F.when(k % 4 == 0, "TDS Payment"), F.when(k % 4 == 1, F.concat(F.lit("TDS\t paid "), "p_name")).when(k % 4 == 2, "mtds paid").otherwise(F.col("p_name"))
    return load(spark, d, "part").select(k.alias("id"), governance.return_form(text, name).alias("form"), governance.is_tds_payment(kind, description).alias("is_payment"))


@query("""SELECT unnest(['vendor', 'amount', 'section']) AS field, unnest([count(*) FILTER (WHERE o_orderkey % 3 = 0 OR o_orderkey % 7 = 0), count(*) FILTER (WHERE o_custkey % 2 = 0), 0]) AS missing FROM orders""")
def missing_field_profile(spark, d):
    vendor = F.when(_key() % 3 == 0, "").when(_key() % 7 != 0, "v")
    rows = load(spark, d, "orders").select(vendor.alias("vendor"), F.when(F.col("o_custkey") % 2 == 1, F.col("o_totalprice")).alias("amount"), F.col("o_orderpriority").alias("section"))
    return governance.missing_counts(rows, ["vendor", "amount", "section"])


@query(_with(STATEMENTS_SQL) + """SELECT tan, sum(tax) AS total_tax_deducted, ['EXACT', 'HIGH_CONFIDENCE', 'REVIEW_REQUIRED', 'UNMAPPED'][tan % 4 + 1] AS status, [3, 2, 0, 1][tan % 4 + 1]::INTEGER AS queue_rank FROM stmts GROUP BY tan""", decimals="total_tax_deducted")
def identity_queue(spark, d):
    items = statements(spark, d).groupBy("tan").agg(F.sum("tax").alias("total_tax_deducted"))
    k = F.col("tan") % 4
    return governance.identity_queue(items.withColumn("status", F.when(k == 0, "EXACT").when(k == 1, "HIGH_CONFIDENCE").when(k == 2, "REVIEW_REQUIRED").otherwise("UNMAPPED")))


_RESULTS = ["'MATCHED_CLAIMABLE'", "'MISSING_IN_26AS'", "'AMOUNT_MISMATCH'", "'DUPLICATE'", "'MATCHED_NOT_CLAIMABLE'", "'IDENTITY_UNMAPPED'"]
_RESULTS_SQL = f"""r AS (SELECT id, {_case('id', _RESULTS)} AS result, CASE WHEN id % 5 < 3 THEN quarter WHEN id % 5 = 3 THEN '' END AS bq, quarter AS sq, CASE WHEN id % 2 = 0 THEN amount END AS expected, tax, tan, customer FROM stmts)"""


def _results(spark, d):
    k = F.col("id")
    books_quarter = F.when(k % 5 < 3, F.col("quarter")).when(k % 5 == 3, "")
    tans = F.when(k % 3 == 0, F.array(F.col("tan").cast("string"), F.lit("T"))).otherwise(F.array().cast("array<string>"))
    return statements(spark, d).select(
        "id", k.alias("transaction_id"), F.expr(_case("id", _RESULTS)).alias("result"), books_quarter.alias("books_quarter"), F.col("quarter").alias("statement_quarter"), F.when(k % 2 == 0, F.col("amount")).alias("expected"), F.col("tax").alias("deducted"),
        (F.col("amount") - F.col("tax")).cast(MONEY).alias("difference"), F.when(k % 4 == 0, "").otherwise(F.col("customer").cast("string")).alias("customer"), F.lit("D").alias("deductor"), F.col("tan").cast("string").alias("tan"), tans.alias("matched_tans"), F.lit("HIGH").alias("severity"),
    )


@query(_with(STATEMENTS_SQL, _RESULTS_SQL) + """SELECT CASE WHEN id % 4 = 0 THEN 'D' ELSE customer::VARCHAR END AS customer, CASE WHEN id % 3 = 0 THEN tan::VARCHAR || ', T' ELSE tan::VARCHAR END AS tans, id AS transaction_id, sq AS quarter, expected, tax AS deducted,
(amount - s.tax)::DECIMAL(18,2) AS difference, result AS issue FROM r JOIN (SELECT id, amount, tax FROM stmts) s USING (id) WHERE id % 6 NOT IN (0, 3)""".replace("tax AS deducted", "r.tax AS deducted"), decimals="expected deducted difference")
def party_followup(spark, d):
    return governance.party_followup(_results(spark, d))


@query(_with(STATEMENTS_SQL, _RESULTS_SQL) + """SELECT id, 'HIGH' AS severity, sq AS quarter, coalesce(expected, tax) AS amount, result, CASE WHEN id % 7 = 0 THEN 'RESOLVED' ELSE 'OPEN' END AS status, CASE WHEN id % 7 = 0 THEN 'seen | ' || id ELSE '' END AS notes FROM r WHERE id % 6 != 0""", decimals="amount")
def exception_report(spark, d):
    states = statements(spark, d).filter("id % 7 = 0").select("id", F.lit("RESOLVED").alias("status"), F.array(F.lit("seen"), F.col("id").cast("string")).alias("notes"))
    return governance.exception_report(_results(spark, d), states)


@query(_with(STATEMENTS_SQL) + """, s AS (SELECT CASE WHEN tan % 9 != 0 THEN tan END AS tan, CASE WHEN id % 4 != 0 THEN amount END AS expected, tax, id FROM stmts)
SELECT count(*) AS results, count(DISTINCT tan) AS deductors, sum(expected) AS expected_total, sum(tax) AS deducted_total, sum(expected) - sum(tax) AS difference, count(*) FILTER (WHERE id % 4 = 1) AS consistent, count(*) FILTER (WHERE id % 4 > 1) AS differing, count(*) FILTER (WHERE id % 4 = 0) AS not_determinable FROM s""", decimals="expected_total deducted_total difference")
def statement_only_summary(spark, d):
    k = F.col("id") % 4
    status = F.when(k == 0, "NOT_DETERMINABLE").when(k == 1, "CONSISTENT_WITH_CONFIGURED_RULE").otherwise("TDS_DIFFERENCE")
    rows = statements(spark, d).select(F.when(F.col("tan") % 9 != 0, F.col("tan").cast("string")).otherwise("").alias("tan"), F.when(k != 0, F.col("amount")).alias("expected"), F.col("tax").alias("deducted"), status.alias("status"))
    return governance.statement_only_summary(rows)


@query("""SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'MISSING_TDS_LEDGER_COUNTERPART' ELSE 'MISSING_SALES_AND_TDS_COUNTERPART' END AS reason, count(*) AS rows FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1""")
def unmapped_reasons(spark, d):
    sales = F.when(_key() % 3 == 0, F.array(_key())).when(_key() % 3 == 1, F.array().cast("array<bigint>"))
    rows = load(spark, d, "orders").select(F.when(F.col("o_custkey") % 2 == 0, "UNMAPPED").otherwise("CONFIRMED").alias("identity"), sales.alias("sales_ids"))
    return governance.unmapped_reasons(rows)


@query("""SELECT o_orderkey AS rule_id, CASE o_orderkey % 13 WHEN 1 THEN 'SECTION_REQUIRED' WHEN 2 THEN 'FINANCIAL_YEAR_FORMAT' WHEN 3 THEN 'RATE_NOT_NUMERIC' WHEN 4 THEN 'RATE_NEGATIVE' WHEN 5 THEN 'THRESHOLD_NOT_NUMERIC' WHEN 6 THEN 'THRESHOLD_NEGATIVE'
WHEN 7 THEN 'THRESHOLD_TYPE_UNSUPPORTED' WHEN 8 THEN 'CALCULATION_BASE_UNSUPPORTED' WHEN 9 THEN 'EFFECTIVE_RANGE_INVALID' WHEN 10 THEN 'VERSION_INVALID' WHEN 11 THEN 'SOURCE_REQUIRED' ELSE
CASE WHEN o_orderkey % 13 != 12 AND EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = o.o_custkey AND b.o_orderkey != o.o_orderkey AND b.o_orderkey % 13 != 12 AND b.o_orderkey % 13 NOT IN (1, 2, 9)
  AND b.o_orderdate::DATE <= o.o_orderdate::DATE + 60 AND o.o_orderdate::DATE <= b.o_orderdate::DATE + 60) THEN 'OVERLAPPING_ACTIVE_RULE' END END AS error FROM orders o""")
def rule_validation(spark, d):
    """Every rule against all of them: each remainder by 13 but the first and the last has a fault of its own, the last is inactive."""
    k = _key() % 13
    day = F.col("o_orderdate").cast("date")
    fault = lambda n, bad, good: F.when(k == n, bad).otherwise(good)
    table = load(spark, d, "orders").select(
        _key().alias("rule_id"), fault(1, " ", F.concat(F.lit("s"), F.col("o_custkey"))).alias("section"), fault(2, "2025", "2025-26").alias("financial_year"), F.when(k == 3, "ten").when(k == 4, "-1").otherwise(" 7.50").alias("rate"),
        F.when(k == 5, "much").when(k == 6, "-5").when(k == 0, "30000").otherwise("").alias("threshold"), F.when(k == 7, "DAILY").when(k == 0, "annual").otherwise("").alias("threshold_type"), fault(8, "GROSS", "books_tds_base").alias("calculation_base"),
        F.when(k != 9, day.cast("string")).alias("effective_from"), F.date_add(day, 60).cast("string").alias("effective_to"), fault(10, "0", "").alias("version"), F.lit("Act").alias("source"), fault(11, "", "s. 1").alias("source_reference"), F.when(k == 12, False).alias("is_active"),
    )
    return rules.validated(table, table).select("rule_id", "error")


@query("""SELECT o_orderkey + 10 AS row_no, 'T' || o_orderkey AS transaction_id, 'ABCDE1234F' AS deductee_pan, (o_orderkey % 100 + 1000.5)::DECIMAL(18,2) AS tds_amount, 'Rao, ' || o_custkey AS deductee_name, CASE WHEN o_orderkey % 2 = 0 THEN '194C' END AS section
FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 5 = 4""", decimals="tds_amount")
def return_csv_rows(spark, d):
    """By remainders of 5: 1 has no transaction, 2 no PAN, 3 no number; 0 and 4 are sound."""
    k = _key() % 5
    section = F.when(_key() % 2 == 0, "194C").otherwise(" ")
    tax = F.when(k == 3, "n/a").otherwise(F.concat(F.lit('"1,0'), F.lpad((_key() % 100).cast("string"), 2, "0"), F.lit('.50"')))
    cells = [F.when(k != 1, F.concat(F.lit("T"), _key())).otherwise(""), F.when(k == 2, "ABCDE1234").otherwise(" abcde1234f"), tax, F.concat(F.lit('"Rao, '), F.col("o_custkey"), F.lit('"')), section]
    body = load(spark, d, "orders").select((_key() + 10).alias("row_no"), F.concat_ws(",", *cells).alias("value"))
    head = spark.createDataFrame([(1, "Form 26Q, regular"), (2, ""), (3, "Voucher Number,PAN,Tax Deducted,Deductee-Name,Section Code")], "row_no long, value string")
    return return_rows(head.union(body)).select("row_no", "transaction_id", "deductee_pan", "tds_amount", "deductee_name", "section")
