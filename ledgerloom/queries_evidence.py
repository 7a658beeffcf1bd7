"""Normalisers, statutory choices and evidence over the driver's tables, with the SQL that their rows are held to.

The tables are first turned into text as an export would hold them, so that what is tested begins with raw cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text
from .functions.amounts import MONEY
from .operators import evidence, normalise, statutory
from .plans.frames import STATEMENTS_SQL, fy_sql, load, quarter_sql, statements
from .queries import _with, query


def _case(column: str, values: list[str], n: int | None = None) -> str:
    """An expression that takes the values in turn, by the column's remainder; in Spark's SQL and DuckDB's alike."""
    return "CASE " + f"{column} % {n or len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


# -- normalisers --------------------------------------------------------------------------------------------------

_LEDGERS = _case("o_orderkey", ["'TDS Receivable A/c'", "'Sales'", "'Tax: tds receivable'", "'TDS Receivable'", "'TDS Payable'", "NULL"])
_MEMO = _case("o_orderkey", ["'x'", "NULL", "'y'", "'Closing balance c/f'"], 4)
_RAW_BOOKS = f"""SELECT o_orderkey AS row_no, {_case('o_orderkey', ["' '", "'V' || o_orderkey", "NULL"])} AS transaction_id, {_case('o_orderkey', ["'D' || o_orderkey", "''"])} AS document_number,
  'Customer & Sons ' || o_custkey || ' Pvt. Ltd.' AS customer_name, ' c ' || o_custkey AS customer_code, cast(o_totalprice AS DECIMAL(18,2)) || '' AS taxable_value,
  {_case('o_orderkey', ["'FY 2024/2025'", "''", "'1999-00'", "NULL"])} AS financial_year, {_case('o_orderkey', ["'yes'", "'N'", "NULL", "'1'", "'0'"])} AS advance, {_LEDGERS} AS source_ledger, {_MEMO} AS narration,
  {_case('o_orderkey', ["'' || cast(o_totalprice AS DECIMAL(18,2))", "'0.00'", "NULL"], 7)} AS debit_amount, {_case('o_orderkey', ["'5.00'", "'(3.00)'", "''"], 5)} AS credit_amount, o_orderdate AS day FROM orders"""


def _raw(spark, d: str, table: str, sql: str, *missing: str, dealt: str | None = None) -> DataFrame:
    """The rows of the SQL over the table, with further columns that hold nothing; dealt by an expression, so that what
    groups them by it moves the table's own short values and not the texts made of them."""
    given = load(spark, d, table)
    rows = spark.sql(sql.replace(f"FROM {table}", "FROM {t}"), t=given.repartition(F.expr(dealt)) if dealt else given)
    return rows.withColumns({c: F.lit(None).cast("string") for c in missing})


def _raw_books(spark, d: str) -> DataFrame:
    rows = _raw(spark, d, "orders", _RAW_BOOKS, "party_pan", "party_gstin", "section", "gst_value", "tds_expected", "tds_base_amount", "voucher_type", "source_period")
    return rows.withColumn("document_date", F.date_format("day", "dd-MM-yyyy"))


_BOOKS_SQL = f"""raw AS ({_RAW_BOOKS}), numbered AS (SELECT *, row_number() OVER (ORDER BY row_no) AS i FROM raw),
norm AS (SELECT row_no, coalesce(nullif(trim(transaction_id), ''), nullif(document_number, ''), 'SYS-BOOK-' || lpad(i::VARCHAR, greatest(4, length(i::VARCHAR))::INTEGER, '0')) AS transaction_id,
  CASE WHEN nullif(trim(transaction_id), '') IS NULL AND nullif(document_number, '') IS NULL THEN 'SYSTEM_GENERATED' ELSE 'SOURCE_PROVIDED' END AS transaction_id_source,
  'CUSTOMER AND SONS ' || split_part(customer_name, ' ', 4) AS customer_name_norm, upper(replace(customer_code, ' ', '')) AS customer_code, taxable_value::DECIMAL(18,2) AS taxable_value,
  CASE row_no % 4 WHEN 0 THEN '2024-25' WHEN 2 THEN '1999-00' ELSE {fy_sql('day::DATE')} END AS financial_year, CASE row_no % 4 WHEN 0 THEN 'EXPLICIT' WHEN 2 THEN 'EXPLICIT' ELSE 'DERIVED_FROM_DATE' END AS financial_year_source,
  {quarter_sql('day::DATE')} AS quarter, coalesce(advance IN ('yes', '1'), FALSE) AS advance, nullif(debit_amount, '')::DECIMAL(18,2) AS debit,
  CASE credit_amount WHEN '(3.00)' THEN -3 WHEN '5.00' THEN 5 END::DECIMAL(18,2) AS credit,
  contains(upper(coalesce(source_ledger, '')), 'TDS') AND contains(upper(source_ledger), 'RECEIVABLE') AND NOT contains(coalesce(narration, ''), 'Closing balance') AS receivable FROM numbered)"""


@query("WITH " + _BOOKS_SQL + " SELECT row_no, transaction_id, transaction_id_source, customer_name_norm, customer_code, taxable_value, financial_year, financial_year_source, quarter, advance FROM norm", decimals="taxable_value")
def normalize_books(spark, d):
    names = ["row_no", "transaction_id", "transaction_id_source", "customer_name_norm", "customer_code", "taxable_value", "financial_year", "financial_year_source", "quarter", "advance"]
    return normalise.books(_raw_books(spark, d)).select(names)


_STATES = """CASE WHEN NOT receivable THEN 'EXCLUDED_NON_TDS_ACCOUNTING_ROW' WHEN debit > 0 THEN 'AVAILABLE' WHEN credit > 0 THEN 'ACCOUNTING_ADJUSTMENT_REVIEW' ELSE 'ACCOUNTING_ROLE_REVIEW_REQUIRED' END"""


@query("WITH " + _BOOKS_SQL + f""" SELECT row_no, {_STATES} AS validation_state, CASE WHEN receivable THEN CASE WHEN debit > 0 THEN 'DEBIT' WHEN credit > 0 THEN 'CREDIT' ELSE 'UNDETERMINED' END END AS accounting_direction,
  CASE WHEN receivable AND debit > 0 THEN debit END AS tds_expected, receivable AND coalesce(debit > 0, FALSE) AS matching_eligible FROM norm""", decimals="tds_expected")
def accounting_semantics(spark, d):
    return normalise.accounting_semantics(normalise.books(_raw_books(spark, d))).select("row_no", "validation_state", "accounting_direction", "tds_expected", "matching_eligible")


@query("WITH " + _BOOKS_SQL + f""", s AS (SELECT receivable AS r, {_STATES} AS v FROM norm) SELECT count(*)::BIGINT AS total_source_rows, count(*) FILTER (WHERE r)::BIGINT AS tds_receivable_rows, count(*) FILTER (WHERE v = 'AVAILABLE')::BIGINT AS tds_receivable_debit_rows,
  count(*) FILTER (WHERE v = 'ACCOUNTING_ADJUSTMENT_REVIEW')::BIGINT AS tds_receivable_credit_rows, count(*) FILTER (WHERE v[:8] = 'EXCLUDED')::BIGINT AS non_tds_rows_excluded, count(*) FILTER (WHERE v[:10] = 'ACCOUNTING')::BIGINT AS accounting_role_review_rows FROM s""")
def accounting_summary(spark, d):
    return normalise.semantics_summary(normalise.accounting_semantics(normalise.books(_raw_books(spark, d))))


_RAW_STATEMENT = f"""SELECT l_orderkey * 10 + l_linenumber AS row_no, {_case('l_orderkey', ["NULL", "'R-' || l_orderkey || '-' || l_linenumber"])} AS statement_id, ' abcd ' || l_suppkey AS tan, 'M/s. Alpha ' || l_suppkey || ' Company' AS deductor_name,
  cast(l_tax AS DECIMAL(18,2)) || '' AS tax_deducted, {_case('l_linenumber', ["''", "'12.50'", "'n/a'"])} AS tds_deposited, {_case('l_suppkey', ["' u '", "''", "'F'", "NULL", "'provisional'"])} AS status, '194 c' AS section,
  cast(l_extendedprice AS DECIMAL(18,2)) || '' AS amount_paid, l_shipdate AS day FROM lineitem"""


@query(f"""WITH raw AS ({_RAW_STATEMENT}), n AS (SELECT *, row_number() OVER (ORDER BY row_no) AS i FROM (SELECT DISTINCT ON (row_no) * FROM raw ORDER BY row_no, amount_paid, tax_deducted, day, tan))
SELECT row_no, coalesce(statement_id, 'SYS-26AS-' || lpad(i::VARCHAR, greatest(4, length(i::VARCHAR))::INTEGER, '0')) AS statement_id, upper(replace(tan, ' ', '')) AS tan, 'M S ALPHA ' || split_part(deductor_name, ' ', 3) AS deductor_name_norm,
  tax_deducted::DECIMAL(18,2) AS tax_deducted, try_cast(nullif(tds_deposited, '') AS DECIMAL(18,2)) AS tds_deposited, tds_deposited != '12.50' AS deposited_not_reported, coalesce(nullif(upper(trim(status)), '')[1], 'F') AS status, '194C' AS section,
  {fy_sql('day::DATE')} AS financial_year FROM n""", decimals="tax_deducted tds_deposited")
def normalize_statement(spark, d):
    raw = _raw(spark, d, "lineitem", _RAW_STATEMENT, "deductor_pan", "financial_year", dealt="l_orderkey * 10 + l_linenumber").withColumn("transaction_date", F.date_format("day", "yyyy/M/d"))
    first = raw.groupBy("row_no").agg(F.min_by(F.struct(*(c for c in raw.columns if c != "row_no")), F.struct("amount_paid", "tax_deducted", "day", "tan")).alias("r")).select("row_no", "r.*")
    return normalise.statement(first).select("row_no", "statement_id", "tan", "deductor_name_norm", "tax_deducted", "tds_deposited", "deposited_not_reported", "status", "section", "financial_year")


_RAW_MASTER = f"""SELECT c_custkey AS row_no, 'c' || c_custkey AS customer_code, 'The Firm ' || c_custkey || ' Enterprises' AS customer_name, 'pan' || c_custkey AS pan, NULL AS gstin,
  {_case('c_custkey', ["'abcd; ef gh|ij'", "NULL", "'x1 , ,x2'"])} AS tan, {_case('c_custkey', ["'A / B'", "''"])} AS aliases FROM customer"""


@query(f"""WITH raw AS ({_RAW_MASTER}) SELECT row_no, upper(customer_code) AS customer_code, upper(pan) AS pan, 'FIRM ' || row_no AS customer_name_norm,
  CASE row_no % 3 WHEN 0 THEN 'ABCD+EFGH+IJ' WHEN 1 THEN '' ELSE 'X1+X2' END AS tans, CASE row_no % 2 WHEN 0 THEN 'A+B' ELSE '' END AS aliases FROM raw""")
def normalize_customers(spark, d):
    rows = normalise.customers(_raw(spark, d, "customer", _RAW_MASTER))
    return rows.select("row_no", "customer_code", "pan", "customer_name_norm", F.array_join("tans", "+").alias("tans"), F.array_join("aliases", "+").alias("aliases"))


_RAW_RECEIVABLE = f"""SELECT o_orderkey AS row_no, {_case('o_orderkey', ["''", "'T' || o_orderkey", "NULL"])} AS tds_transaction_id, 'Beta ' || o_custkey || ' LLP' AS party_name, 'p ' || o_custkey AS party_pan, NULL AS party_gstin, NULL AS tan,
  'ref' AS reference, '₹ ' || cast(o_totalprice AS DECIMAL(18,2)) AS tds_expected, NULL AS tds_base_amount, '194j' AS section, {_case('o_orderkey', ["'2023'", "NULL"])} AS financial_year, o_orderdate AS day FROM orders"""


@query(f"""WITH raw AS ({_RAW_RECEIVABLE}), n AS (SELECT *, row_number() OVER (ORDER BY row_no) AS i FROM raw)
SELECT row_no, CASE row_no % 3 WHEN 1 THEN 'T' || row_no ELSE 'SYS-TDS-' || lpad(i::VARCHAR, greatest(4, length(i::VARCHAR))::INTEGER, '0') END AS tds_transaction_id, 'BETA ' || split_part(party_name, ' ', 2) AS party_name_norm,
  'P' || split_part(party_pan, ' ', 2) AS party_pan, substr(tds_expected, 3)::DECIMAL(18,2) AS tds_expected, CASE row_no % 2 WHEN 0 THEN '2023-24' ELSE {fy_sql('day::DATE')} END AS financial_year,
  CASE row_no % 2 WHEN 0 THEN 'EXPLICIT' ELSE 'DERIVED_FROM_DATE' END AS financial_year_source, {quarter_sql('day::DATE')} AS quarter FROM n""", decimals="tds_expected")
def normalize_tds_receivable(spark, d):
    raw = _raw(spark, d, "orders", _RAW_RECEIVABLE).withColumn("transaction_date", F.date_format("day", "d.M.yyyy"))
    return normalise.receivable(raw).select("row_no", "tds_transaction_id", "party_name_norm", "party_pan", "tds_expected", "financial_year", "financial_year_source", "quarter")


_RAW_SALES = f"""SELECT o_orderkey AS row_no, NULL AS sales_transaction_id, 'Gamma ' || o_custkey || ' Inc' AS customer_name, NULL AS customer_pan, ' g' || o_custkey AS customer_gstin, 'I' || o_orderkey AS invoice_number,
  {_case('o_orderkey', ["'100.00'", "NULL", "'-'", "''"])} AS sales_amount, {_case('o_orderkey', ["'7.00'", "NULL", "NULL", "'8.00'"])} AS invoice_value, {_case('o_orderkey', ["NULL", "NULL", "'5.00'"], 4)} AS taxable_amount,
  {_case('o_orderkey', ["'FY 2019-20'", "'01-06-2018'", "'April'", "NULL", "'2017/18'"])} AS period, ' ' AS state, 'r' AS reference, {_case('o_orderkey', ["'2015-16'", "NULL"], 7)} AS financial_year, o_orderdate AS day FROM orders"""


@query(f"""WITH raw AS ({_RAW_SALES}), n AS (SELECT *, row_number() OVER (ORDER BY row_no) AS i, row_no % 5 AS k FROM raw)
SELECT row_no, 'SYS-SALES-' || lpad(i::VARCHAR, greatest(4, length(i::VARCHAR))::INTEGER, '0') AS sales_transaction_id, 'GAMMA ' || split_part(customer_name, ' ', 2) AS customer_name_norm, upper(trim(customer_gstin)) AS customer_gstin,
  try_cast(nullif(sales_amount, '') AS DECIMAL(18,2)) AS sales_amount, CASE row_no % 4 WHEN 0 THEN 'SOURCE_SPECIFIC_AMOUNT' WHEN 1 THEN 'NOT_DETERMINABLE' ELSE 'REVIEW_REQUIRED' END AS sales_amount_basis,
  coalesce(financial_year, CASE k WHEN 0 THEN '2019-20' WHEN 1 THEN '2018-19' WHEN 4 THEN '2017-18' ELSE {fy_sql('day::DATE')} END) AS financial_year,
  CASE k WHEN 0 THEN 'SOURCE_COLUMN' WHEN 4 THEN 'SOURCE_COLUMN' WHEN 1 THEN 'PERIOD_DERIVED_DATE' ELSE 'INVOICE_DATE' END AS financial_year_source FROM n""", decimals="sales_amount")
def normalize_sales_registry(spark, d):
    raw = _raw(spark, d, "orders", _RAW_SALES).withColumn("invoice_date", F.date_format("day", "d MMM yyyy"))
    return normalise.sales(raw).select("row_no", "sales_transaction_id", "customer_name_norm", "customer_gstin", "sales_amount", "sales_amount_basis", "financial_year", "financial_year_source")


@query(f"""SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN '1990-91' END) AS none_missing, '2021-22' AS all_missing FROM orders""")
def assignment_year(spark, d):
    rows = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "1990-91").alias("financial_year"))
    some = normalise.assignment_year(rows, "2021-22", "2020-21").withColumnRenamed("financial_year", "none_missing")
    every = normalise.assignment_year(rows.withColumn("financial_year", F.lit(None).cast("string")), None, "2021-22").withColumnRenamed("financial_year", "all_missing")
    return some.join(every, "id")


_RAW_PAYMENTS = f"""SELECT o_orderkey AS row_no, {_case('o_orderkey', ["'P' || o_orderkey % 40", "''", "NULL"])} AS transaction_id, NULL AS invoice_number, {_case('o_orderkey', ["'Vendor ' || o_custkey", "NULL"])} AS deductee_name,
  {_case('o_orderkey', ["NULL", "'Payee'", "NULL", "NULL"])} AS source_payee_name, NULL AS source_counterparty_description, {_case('o_orderkey', ["NULL", "NULL", "NULL", "'v' || o_custkey", "NULL"], 7)} AS vendor_code,
  {_case('o_orderkey', ["'abcde1234f'", "NULL", "'bad'"])} AS deductee_pan, {_case('o_orderkey', ["'100.00'", "''", "'abc'", "NULL", "NULL"])} AS amount, {_case('o_orderkey', ["NULL", "'50.00'", "'0.00'", "'5.00'"])} AS source_debit_amount,
  {_case('o_orderkey', ["NULL", "'0'", "'0.00'", "'6.00'"])} AS source_credit_amount, {_case('o_orderkey', ["'2024-25'", "NULL", "'2024-26'"], 9)} AS financial_year, 'rent' AS description, NULL AS tds_deducted,
  {_case('o_orderkey', ["'15-06-2023'", "'05/06/2023'", "NULL", "NULL", "'2023-06-15'"], 6)} AS transaction_date, NULL AS credit_date, {_case('o_orderkey', ["NULL", "NULL", "'31-12-2022'"], 6)} AS payment_date FROM orders"""

_LEDGER_SQL = f"""raw AS ({_RAW_PAYMENTS}),
a AS (SELECT row_no, row_no % 6 AS k, coalesce(deductee_name, source_payee_name) AS party, vendor_code, CASE row_no % 3 WHEN 0 THEN 'FORMAT_VALID_UNVERIFIED' WHEN 1 THEN 'NOT_PROVIDED' ELSE 'FORMAT_INVALID' END AS pan_status,
  deductee_pan IS NOT NULL AS pan, CASE WHEN amount = '100.00' THEN 100 WHEN row_no % 4 = 1 THEN 50 WHEN row_no % 4 = 2 THEN 0 END::DECIMAL(18,2) AS amount, amount = 'abc' AS bad, row_no % 4 = 3 AND nullif(amount, '') IS NULL AS twice,
  CASE row_no % 9 WHEN 0 THEN '2024-25' END AS given_fy, row_no % 9 = 2 AS bad_fy, CASE row_no % 6 WHEN 0 THEN DATE '2023-06-15' WHEN 4 THEN DATE '2023-06-15' WHEN 2 THEN DATE '2022-12-31' END AS day,
  coalesce(nullif(transaction_id, ''), 'SYS-TDS-' || row_no) AS transaction_id FROM raw),
b AS (SELECT *, coalesce(given_fy, CASE WHEN day IS NOT NULL THEN {fy_sql('day')} END) AS fy, party IS NOT NULL OR vendor_code IS NOT NULL OR pan AS known FROM a),
c AS (SELECT *, coalesce(bad, FALSE)::INTEGER + coalesce(twice, FALSE)::INTEGER + (k = 1)::INTEGER + bad_fy::INTEGER + (fy IS NULL)::INTEGER + (NOT known)::INTEGER + (amount IS NULL)::INTEGER AS n_issues,
  coalesce(upper(party), upper(vendor_code)) IS NOT NULL AND day IS NOT NULL AND amount IS NOT NULL AND count(*) OVER (PARTITION BY upper(coalesce(party, vendor_code)), transaction_id, day, amount) > 1 AS duplicate_review FROM b),
led AS (SELECT *, CASE WHEN NOT known OR amount IS NULL THEN 'INVALID' WHEN k = 1 OR fy IS NULL OR duplicate_review THEN 'REVIEW_REQUIRED' WHEN pan_status != 'FORMAT_VALID_UNVERIFIED' OR n_issues > 0 THEN 'WARNING' ELSE 'VALID' END AS validation_status FROM c)"""


def _payment_ledger(spark, d: str) -> DataFrame:
    return normalise.payment_ledger(_raw(spark, d, "orders", _RAW_PAYMENTS))


@query("WITH " + _LEDGER_SQL + " SELECT row_no, transaction_id, party AS deductee_name, pan_status, amount, fy AS financial_year, n_issues::INTEGER AS n_issues, duplicate_review, validation_status FROM led", decimals="amount")
def payment_ledger(spark, d):
    return _payment_ledger(spark, d).select("row_no", "transaction_id", "deductee_name", "pan_status", "amount", "financial_year", F.size("issues").alias("n_issues"), "duplicate_review", "validation_status")


@query("WITH " + _LEDGER_SQL + """ SELECT count(*)::BIGINT AS total_rows, count(*) FILTER (WHERE validation_status = 'WARNING')::BIGINT AS warning_rows, count(*) FILTER (WHERE validation_status = 'INVALID')::BIGINT AS invalid_rows,
  count(*) FILTER (WHERE duplicate_review)::BIGINT AS duplicate_rows, count(*) FILTER (WHERE party IS NULL)::BIGINT AS no_deductee_name, count(*) FILTER (WHERE amount IS NULL)::BIGINT AS no_amount, count(*) FILTER (WHERE fy IS NULL)::BIGINT AS no_financial_year,
  count(*) FILTER (WHERE pan_status = 'FORMAT_INVALID')::BIGINT AS pan_format_invalid, count(*) FILTER (WHERE validation_status = 'INVALID') = 0 AS can_commit FROM led""")
def ledger_profile(spark, d):
    return normalise.ledger_summary(_payment_ledger(spark, d)).select("total_rows", "warning_rows", "invalid_rows", "duplicate_rows", "no_deductee_name", "no_amount", "no_financial_year", "pan_format_invalid", "can_commit")


# -- names --------------------------------------------------------------------------------------------------------

_SUFFIX = "['PVT', 'PRIVATE', 'LTD', 'LIMITED', 'LLP', 'INC', 'CO', 'COMPANY', 'CORP', 'CORPORATION', 'THE', 'PLC', 'P', 'L', 'ENTERPRISES', 'ENTERPRISE']"
_WORDS = "['PVT', 'PRIVATE', 'LTD', 'LIMITED', 'LLP', 'INC', 'CO', 'COMPANY', 'CORP', 'CORPORATION', 'THE', 'PLC', 'P', 'L', 'ENTERPRISES', 'ENTERPRISE', 'LLC', 'AND', 'INDIA', 'OPC']"


@query(f"""WITH n AS (SELECT p_partkey AS id, string_split(upper(p_name), ' ') AS w, {_WORDS}[p_partkey % 20 + 1] AS s, {_WORDS}[p_partkey // 20 % 20 + 1] AS t FROM part),
a AS (SELECT id, list_filter(list_concat([s], w, [t]), lambda x: NOT list_contains({_SUFFIX}, x)) AS c FROM n) SELECT id, array_to_string(c, ' ') AS core, array_to_string(c, '') AS compact FROM a""")
def core_names_all_words(spark, d):
    words = F.array(*(F.lit(w) for w in (*text.LEGAL_WORDS, "LLC", "AND", "INDIA", "OPC")))
    p = load(spark, d, "part")
    k = F.col("p_partkey")
    name = F.concat_ws(" ", F.get(words, (k % 20).cast("int")), "p_name", F.get(words, (F.floor(k / 20) % 20).cast("int")))
    return p.select(k.alias("id"), text.core_name(name).alias("core"), text.compact_name(name).alias("compact"))


_NAMES = "SELECT p_partkey AS id, upper(p_name || ' and ' || p_type) AS w FROM part"


@query(f"""WITH n AS ({_NAMES}), x AS (SELECT id, string_split(w, ' ') AS b, CASE id % 4 WHEN 0 THEN [string_split(w, ' ')[1], string_split(w, ' ')[2], 'X'] WHEN 1 THEN [string_split(w, ' ')[2]] WHEN 2 THEN [string_split(w, ' ')[1][1] || string_split(w, ' ')[2][1] || string_split(w, ' ')[4][1], 'Y'] ELSE ['ZZ', 'QQ'] END AS a FROM n),
y AS (SELECT *, len(list_intersect(list_distinct(a), b)) AS shared, array_to_string(list_transform(list_filter(b, lambda w: len(w) > 1 AND NOT list_contains(['A', 'AN', 'AND', 'OF', 'THE', 'PRIVATE', 'LIMITED', 'PVT', 'LTD'], w)), lambda w: w[1]), '') AS initials FROM x)
SELECT id, CASE WHEN shared >= 2 THEN 'PARTIAL_NORMALIZED_NAME' WHEN shared = len(list_distinct(a)) THEN 'NAME_PREFIX_VARIANT' WHEN len(a[1]) BETWEEN 3 AND 8 AND starts_with(initials, a[1]) THEN 'ACRONYM_FAMILY_CANDIDATE' END AS evidence FROM y""")
def tds_review_evidence(spark, d):
    p = spark.sql(_NAMES.replace("FROM part", "FROM {t}"), t=load(spark, d, "part"))
    w = F.split("w", " ")
    k = F.col("id") % 4
    lead = F.concat(*(F.substring(F.get(w, F.lit(i)), 1, 1) for i in (0, 1, 3)))
    ledger = F.when(k == 0, F.concat_ws(" ", F.get(w, F.lit(0)), F.get(w, F.lit(1)), F.lit("X"))).when(k == 1, F.get(w, F.lit(1))).when(k == 2, F.concat(lead, F.lit(" Y"))).otherwise("ZZ QQ")
    return p.select("id", evidence.tds_review(ledger, F.col("w")).alias("evidence"))


@query("""WITH x AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'T' || c_nationkey || '-' || c_custkey % 50 END AS tan, c_mktsegment || ' ' || c_custkey % 30 AS core FROM customer),
y AS (SELECT s_suppkey AS id, 'T' || s_nationkey || '-' || s_suppkey % 50 AS tan, CASE s_suppkey % 2 WHEN 0 THEN 'BUILDING ' || s_suppkey % 30 ELSE 'MACHI NERY' || s_suppkey % 30 END AS core FROM supplier)
SELECT x.id AS left_id, y.id AS right_id, CASE WHEN x.tan = y.tan THEN 'EXACT_TAN' WHEN x.core = y.core THEN CASE WHEN x.tan IS NOT NULL THEN 'CONFLICTING_TAN' ELSE 'EXACT_TDS_DEDUCTOR_NAME' END ELSE 'COMPACT_NORMALIZED_NAME' END AS evidence
FROM x JOIN y ON x.tan = y.tan OR x.core = y.core OR replace(x.core, ' ', '') = replace(y.core, ' ', '')""")
def tds_statement_evidence(spark, d):
    c, s = load(spark, d, "customer"), load(spark, d, "supplier")
    named = lambda df: df.withColumn("compact", F.replace("core", F.lit(" "), F.lit("")))
    part = lambda a, b: F.concat(F.lit("T"), F.col(a).cast("string"), F.lit("-"), (F.col(b) % 50).cast("string"))
    x = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, part("c_nationkey", "c_custkey")).alias("tan"), F.concat_ws(" ", "c_mktsegment", (F.col("c_custkey") % 30).cast("string")).alias("core"))
    k = (F.col("s_suppkey") % 30).cast("string")
    y = s.select(F.col("s_suppkey").alias("id"), part("s_nationkey", "s_suppkey").alias("tan"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("BUILDING "), k)).otherwise(F.concat(F.lit("MACHI NERY"), k)).alias("core"))
    return evidence.tds_statement_evidence(named(x), named(y))


_LABELS = ["EXACT_TAN", "EXACT_PAN", "CONFLICTING_TAN", "26AS_EXPLICIT_PAN", "EXACT_TDS_DEDUCTOR_NAME", "EXACT_SALES_DEDUCTOR_NAME"]


@query(f"""WITH r AS (SELECT o_orderkey AS id, o_orderkey % 2 AS s, o_orderkey // 2 % 2 AS t, o_orderkey // 4 % 2 AS f, list_filter([{', '.join(f"CASE WHEN o_custkey // {2 ** i} % 2 = 1 THEN '{x}' END" for i, x in enumerate(_LABELS))}], lambda x: x IS NOT NULL) AS e, o_orderkey // 8 % 2 = 1 AS anchored FROM orders),
c AS (SELECT *, len(list_intersect(e, ['EXACT_PAN', '26AS_EXPLICIT_PAN'])) > 0 AND len(list_intersect(e, ['EXACT_TAN', 'EXACT_TDS_DEDUCTOR_NAME'])) > 0 AS proven, array_to_string(list_sort(e), '__') AS j FROM r),
m AS (SELECT id, CASE WHEN list_contains(e, 'CONFLICTING_TAN') THEN 'CONFLICT:CONFLICTING_TAN' WHEN anchored AND f = 1 AND (s = 0 OR t = 0) THEN 'CONFIRMED:26AS_SOURCE_TAN_NAME_FY' WHEN s = 1 AND f = 1 AND list_contains(e, '26AS_EXPLICIT_PAN') THEN 'CONFIRMED:26AS_EXPLICIT_PAN'
  WHEN s = 1 AND f = 1 AND t = 0 AND list_contains(e, 'EXACT_SALES_DEDUCTOR_NAME') THEN 'REVIEW_REQUIRED:EXACT_SALES_DEDUCTOR_NAME' WHEN s + t + f < 3 THEN 'UNMAPPED:INCOMPLETE_RELATIONSHIP'
  WHEN proven AND list_contains(e, 'EXACT_PAN') AND list_contains(e, 'EXACT_TAN') THEN 'CONFIRMED:TDS_PAN_TO_TAN' WHEN proven THEN 'CONFIRMED:' || j ELSE 'REVIEW_REQUIRED:' || coalesce(nullif(j, ''), 'NONE') END AS v FROM c)
SELECT id, split_part(v, ':', 1) AS status, split_part(v, ':', 2) AS method FROM m""")
def relationship_identity(spark, d):
    k = F.col("o_orderkey")
    bit = lambda n: (F.floor(k / n) % 2).cast("int")
    found = F.array_compact(F.array(*(F.when(F.floor(F.col("o_custkey") / 2**i) % 2 == 1, F.lit(x)) for i, x in enumerate(_LABELS))))
    status, method = evidence.relationship_identity(bit(1), bit(2), bit(4), found, bit(8) == 1, F.lit(False))
    return load(spark, d, "orders").select(k.alias("id"), status.alias("status"), method.alias("method"))


@query(_with(STATEMENTS_SQL) + """, g AS (SELECT tan, customer, count(*) AS n, sum(tax) AS stated, count(*) FILTER (WHERE section = 'R') AS l, sum(tax) FILTER (WHERE section = 'R') AS booked, count(*) FILTER (WHERE section = 'A') AS c FROM stmts GROUP BY 1, 2)
SELECT tan, customer, CASE WHEN l > 0 AND booked IS NULL THEN 'TDS_NOT_DETERMINABLE' WHEN l > 0 AND (abs(booked - stated) <= 10 OR abs(booked - stated) <= greatest(abs(booked), abs(stated), 1) * 0.01::DECIMAL(3,2)) THEN 'TDS_MATCHED' WHEN l > 0 THEN 'TDS_DIFFERENCE' ELSE 'MISSING_IN_TDS' END AS comparison,
  CASE WHEN l > 0 AND (abs(booked - stated) <= 10 OR abs(booked - stated) <= greatest(abs(booked), abs(stated), 1) * 0.01::DECIMAL(3,2)) THEN 'MATCHED' WHEN l > 0 THEN 'DIFFERENCE' WHEN c > 0 THEN 'REVIEW_REQUIRED' ELSE 'MISSING_TDS_LEDGER_COUNTERPART' END AS reconciliation,
  CASE WHEN l > 0 THEN 'CONFIRMED' WHEN c > 0 THEN 'REVIEW_REQUIRED' ELSE 'UNMAPPED' END AS identity FROM g""")
def tds_check(spark, d):
    r = F.col("section") == "R"
    g = statements(spark, d).groupBy("tan", "customer").agg(F.count("*").alias("n"), F.sum("tax").cast(MONEY).alias("stated"), F.count_if(r).alias("l"), F.sum(F.when(r, F.col("tax"))).cast(MONEY).alias("booked"), F.count_if(F.col("section") == "A").alias("c"))
    comparison, reconciliation, who = evidence.tds_check(F.col("l"), F.col("c"), F.col("n"), F.col("booked"), F.col("stated"))
    return g.select("tan", "customer", comparison.alias("comparison"), reconciliation.alias("reconciliation"), who.alias("identity"))


@query("""WITH p AS (SELECT o_custkey % 300 AS anchor_id, o_orderkey % 500 AS sale_id, o_orderpriority[1] AS k FROM orders)
SELECT anchor_id, sale_id, CASE WHEN bool_or(k IN ('1', '2')) THEN 'LINKED' ELSE 'CANDIDATE' END AS link FROM p GROUP BY 1, 2""")
def anchor_links(spark, d):
    p = load(spark, d, "orders").select((F.col("o_custkey") % 300).alias("anchor_id"), (F.col("o_orderkey") % 500).alias("sale_id"), F.substring("o_orderpriority", 1, 1).isin("1", "2").alias("good"))
    return evidence.anchor_links(p.filter("good"), p.filter("not good"))


@query("""WITH s AS (SELECT o_orderkey AS id, o_custkey AS customer, o_totalprice::DECIMAL(18,2) AS taxable, o_orderkey % 4 = 0 AS linked FROM orders)
SELECT count(DISTINCT customer)::BIGINT AS customers_total, count(DISTINCT customer) FILTER (WHERE linked)::BIGINT AS customers_linked, count(DISTINCT customer) FILTER (WHERE NOT linked)::BIGINT AS customers_without_counterpart,
  count(*) FILTER (WHERE NOT linked)::BIGINT AS rows_excluded, sum(taxable) FILTER (WHERE NOT linked)::DECIMAL(18,2) AS taxable_excluded FROM s""", decimals="taxable_excluded")
def sales_coverage(spark, d):
    s = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.col("o_totalprice").cast(MONEY).alias("taxable"))
    return evidence.sales_coverage(s, s.filter("id % 4 = 0"))


# -- deposits, government records, challans -----------------------------------------------------------------------

_DEPOSIT_ROWS = f"""SELECT o_orderkey AS row_no, {_case('o_orderkey', ["'D' || o_custkey % 90", "NULL", "' '"])} AS deposit_id, {_case('o_orderkey', ["'C' || o_orderkey % 4", "NULL"], 3)} AS challan, {_case('o_orderkey', ["'ABCD12345E'", "'bad'", "NULL", "'zzzz99999z'"])} AS tan,
  {_case('o_orderkey', ["'2024-25'", "NULL", "'2023-24'"])} AS financial_year, cast({_case('o_orderkey', ["10.00", "-1.00", "NULL", "5.00", "6.00", "7.00", "8.00"])} AS DECIMAL(18,2)) AS tds_amount, cast(1.00 AS DECIMAL(18,2)) AS interest_amount,
  cast({_case('o_orderkey', ["0.00", "NULL"])} AS DECIMAL(18,2)) AS fee_amount, cast({_case('o_orderkey', ["11.00", "0.00", "3.00", "6.00", "7.00"], 7)} AS DECIMAL(18,2)) AS total_amount FROM orders"""


@query(f"""WITH r AS ({_DEPOSIT_ROWS}), a AS (SELECT *, nullif(trim(deposit_id), '') IS NOT NULL AND challan IS NOT NULL AND row_number() OVER (PARTITION BY nullif(trim(deposit_id), ''), challan ORDER BY row_no) > 1 AS duplicate FROM r),
i AS (SELECT *, coalesce((tds_amount < 0)::INTEGER, 0) + coalesce((total_amount < 0)::INTEGER, 0) + coalesce((tan = 'bad')::INTEGER, 0) AS hard,
  coalesce((financial_year != '2024-25')::INTEGER, 0) + coalesce((upper(tan) != 'ABCD12345E')::INTEGER, 0) + coalesce((abs(total_amount - tds_amount - interest_amount - fee_amount) > 0.01)::INTEGER, 0) + (tds_amount IS NULL)::INTEGER + duplicate::INTEGER AS soft FROM a)
SELECT row_no, duplicate, (hard + soft)::INTEGER AS n_issues, CASE WHEN hard > 0 THEN 'INVALID' WHEN soft > 0 THEN 'REVIEW_REQUIRED' ELSE 'VALID' END AS validation_status FROM i""")
def deposit_evidence_checks(spark, d):
    rows = evidence.deposit_issues(_raw(spark, d, "orders", _DEPOSIT_ROWS), "2024-25", "ABCD12345E")
    return rows.select("row_no", "duplicate", F.size("issues").alias("n_issues"), "validation_status")


_GOVERNMENT_ROWS = f"""SELECT o_orderkey AS row_no, {_case('o_orderkey', ["'1'", "'2.0'", "'x'", "NULL"])} AS serial, {_case('o_orderkey', ["'N' || o_custkey % 5", "NULL", "'M'"])} AS name, {_case('o_orderkey', ["'abcd12345e'", "'q'", "NULL"], 5)} AS tan,
  '1,000' AS amount_paid, {_case('o_orderkey', ["'5.00'", "'abc'", "NULL", "''", "'6'", "'7'", "'8'"])} AS tax_deducted, NULL AS tds_deposited FROM orders"""


@query(f"""WITH r AS ({_GOVERNMENT_ROWS}), a AS (SELECT *, count(*) OVER (PARTITION BY serial, name, tan, nullif(tax_deducted, '')) > 1 AS again, coalesce((serial = 'x')::INTEGER, 0) + (name IS NULL)::INTEGER + coalesce((tan = 'q')::INTEGER, 0) + coalesce((tax_deducted = 'abc')::INTEGER, 0) AS hard FROM r)
SELECT row_no, (hard + again::INTEGER)::INTEGER AS n_issues, CASE WHEN hard > 0 THEN 'INVALID' WHEN again THEN 'WARNING' ELSE 'VALID' END AS row_status FROM a""")
def government_evidence_checks(spark, d):
    return evidence.government_issues(_raw(spark, d, "orders", _GOVERNMENT_ROWS)).select("row_no", F.size("issues").alias("n_issues"), "row_status")


@query(_with(STATEMENTS_SQL) + f"""SELECT id FROM stmts WHERE (CASE WHEN id % 3 = 0 THEN '1997-98' END IS NULL OR id % 3 = 0) AND {fy_sql("CASE WHEN id % 5 = 0 THEN DATE '1997-06-01' ELSE day END")} = '1997-98'
  AND coalesce(CASE WHEN id % 4 = 0 THEN 'Q3' END, 'Q1') = 'Q1' AND {quarter_sql("CASE WHEN id % 5 = 0 THEN DATE '1997-06-01' ELSE day END")} = 'Q1'""")
def period_filter(spark, d):
    s = statements(spark, d)
    event = F.when(F.col("id") % 5 == 0, F.lit("1997-06-01").cast("date")).otherwise(F.col("day"))
    return s.filter(evidence.in_period(F.when(F.col("id") % 3 == 0, "1997-98"), F.when(F.col("id") % 4 == 0, "Q3"), event, "1997-98", "Q1")).select("id")


@query("""WITH a AS (SELECT c_custkey AS assignment, CASE WHEN c_custkey % 5 != 0 THEN 'T' || c_custkey % 7 END AS tan, '2024-25' AS fy FROM customer),
g AS (SELECT o_custkey AS assignment, list_sort(list_distinct(list('T' || o_custkey % 7 || CASE WHEN o_custkey % 11 = 0 THEN 'X' ELSE '' END))) AS tans, max(CASE WHEN o_custkey % 3 != 0 THEN '2024-25' WHEN o_custkey % 2 = 0 THEN '2023-24' END) AS gfy, sum(o_totalprice::DECIMAL(18,2)) AS gtax FROM orders GROUP BY 1),
c AS (SELECT o_custkey AS assignment, CASE WHEN count(*) = count(t) THEN sum(t) END AS itax FROM (SELECT o_custkey, CASE WHEN o_orderkey % 97 != 0 THEN o_totalprice::DECIMAL(18,2) + (o_custkey % 4 = 0)::INTEGER END AS t FROM orders WHERE o_custkey % 13 != 0) GROUP BY 1),
s AS (SELECT a.assignment, CASE WHEN a.tan IS NULL OR tans IS NULL THEN 'IDENTITY_NOT_DETERMINABLE' WHEN tans = [a.tan] THEN 'IDENTITY_SUPPORTED' ELSE 'IDENTITY_REVIEW_REQUIRED' END AS identity_status,
  CASE WHEN gfy IS NULL THEN 'PERIOD_NOT_DETERMINABLE' WHEN gfy = fy THEN 'PERIOD_SUPPORTED' ELSE 'PERIOD_REVIEW_REQUIRED' END AS period_status,
  CASE WHEN c.assignment IS NULL OR gtax IS NULL THEN 'NOT_DETERMINABLE' WHEN itax IS NULL THEN 'TDS_CONTROL_REVIEW' WHEN itax = gtax THEN 'TDS_CONTROL_MATCH' ELSE 'TDS_CONTROL_DIFFERENCE' END AS control_status
  FROM a LEFT JOIN g USING (assignment) LEFT JOIN c USING (assignment))
SELECT *, CASE WHEN identity_status = 'IDENTITY_REVIEW_REQUIRED' THEN identity_status WHEN period_status = 'PERIOD_REVIEW_REQUIRED' THEN period_status WHEN control_status = 'TDS_CONTROL_DIFFERENCE' THEN control_status
  WHEN identity_status = 'IDENTITY_SUPPORTED' AND period_status = 'PERIOD_SUPPORTED' AND control_status = 'TDS_CONTROL_MATCH' THEN 'SUPPORTED'
  WHEN identity_status = 'IDENTITY_NOT_DETERMINABLE' AND period_status = 'PERIOD_NOT_DETERMINABLE' AND control_status = 'NOT_DETERMINABLE' THEN 'NOT_DETERMINABLE' ELSE 'PARTIALLY_SUPPORTED' END AS overall FROM s""")
def government_verification(spark, d):
    c, o = load(spark, d, "customer"), load(spark, d, "orders").withColumn("k", F.col("o_custkey"))
    t = F.concat(F.lit("T"), (F.col("k") % 7).cast("string"))
    a = c.select(F.col("c_custkey").alias("assignment"), F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("T"), (F.col("c_custkey") % 7).cast("string"))).alias("tan"), F.lit("2024-25").alias("fy"))
    price = F.col("o_totalprice").cast(MONEY)
    g = o.select(F.col("k").alias("assignment"), F.when(F.col("k") % 11 == 0, F.concat(t, F.lit("X"))).otherwise(t).alias("tan"), F.when(F.col("k") % 3 != 0, "2024-25").when(F.col("k") % 2 == 0, "2023-24").alias("fy"), price.alias("tax"))
    x = o.filter("k % 13 != 0").select(F.col("k").alias("assignment"), F.lit("2024-25").alias("fy"), F.when(F.col("o_orderkey") % 97 != 0, price + (F.col("k") % 4 == 0).cast("int")).cast(MONEY).alias("actual"))
    return evidence.government_control(a, g, x).drop("internal_tax", "government_tax")


@query("SELECT o_custkey AS customer, max_by(o_orderpriority, o_orderkey) AS section, max(o_orderkey) AS id FROM orders GROUP BY 1")
def last_duplicate_wins(spark, d):
    rows = load(spark, d, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("section"), F.col("o_orderkey").alias("position"))
    return evidence.last_of_each(rows, ["customer"], "position").drop("position")


@query("""WITH e AS (SELECT o_custkey AS customer, o_orderkey % 7 AS evidence_id, max_by(CASE o_orderkey % 3 WHEN 0 THEN 'SUGGESTED' ELSE 'ESTABLISHED' END, o_orderkey) AS relation, max_by(CASE o_orderkey % 5 WHEN 0 THEN 'INVALID' ELSE 'VALID' END, o_orderkey) AS status,
  max_by(o_totalprice::DECIMAL(18,2), o_orderkey) AS amount FROM orders GROUP BY 1, 2) SELECT customer, sum(amount)::DECIMAL(18,2) AS total, count(*)::BIGINT AS pieces FROM e WHERE relation = 'ESTABLISHED' AND status != 'INVALID' GROUP BY 1""", decimals="total")
def established_evidence_total(spark, d):
    k = F.col("o_orderkey")
    rows = load(spark, d, "orders").select(F.col("o_custkey").alias("customer"), (k % 7).alias("evidence_id"), k.alias("position"), F.when(k % 3 == 0, "SUGGESTED").otherwise("ESTABLISHED").alias("relation"), F.when(k % 5 == 0, "INVALID").otherwise("VALID").alias("status"), F.col("o_totalprice").cast(MONEY).alias("amount"))
    return evidence.established_total(rows, ["customer"])


@query("""WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 's:' || o_orderkey ELSE 'b:' || o_orderkey // 8 END AS k FROM orders), e AS (SELECT o_orderkey + 1000000 AS id, CASE WHEN o_orderkey % 2 = 0 THEN 's:' || o_orderkey ELSE 'b:' || o_orderkey // 8 END AS k FROM orders),
x AS (SELECT k, min(id) AS id FROM c GROUP BY 1 HAVING count(*) = 1), y AS (SELECT k, min(id) AS id FROM e GROUP BY 1 HAVING count(*) = 1), m AS (SELECT x.id, y.id AS e FROM x JOIN y USING (k))
SELECT c.id AS challan_id, m.e AS evidence_id, CASE WHEN m.e IS NULL THEN 'REVIEW_REQUIRED' ELSE 'MATCHED' END AS match FROM c LEFT JOIN m USING (id)""")
def challan_to_evidence(spark, d):
    k = F.col("o_orderkey")
    batch = F.floor(k / 8).cast("string")
    o = load(spark, d, "orders")
    c = o.select(k.alias("id"), F.when(k % 3 == 0, k.cast("string")).alias("serial"), batch.alias("batch"))
    e = o.select((k + 1000000).alias("id"), F.when(k % 2 == 0, k.cast("string")).alias("serial"), batch.alias("batch"))
    return evidence.challan_evidence(c, e)


@query(_with(STATEMENTS_SQL) + """, e AS (SELECT id AS seq, id % 3 = 0 OR id % 2 = 0 AS counts, customer, tan, tax, CASE WHEN section = 'R' THEN NULL ELSE tax END AS deposited, section, status FROM stmts)
SELECT tan, max_by(section, seq) AS deductor, max_by(customer, seq) AS customer, max_by(status, seq) AS identity, count(*) FILTER (WHERE counts)::BIGINT AS entries, coalesce(sum(tax) FILTER (WHERE counts), 0)::DECIMAL(18,2) AS deducted,
  coalesce(sum(deposited) FILTER (WHERE counts), 0)::DECIMAL(18,2) AS deposited, count(*) FILTER (WHERE counts AND seq % 5 < 2)::BIGINT AS matched FROM e GROUP BY tan""", decimals="deducted deposited")
def tan_summary(spark, d):
    s = statements(spark, d)
    entry = F.struct("tan", F.col("section").alias("deductor"), F.col("tax").alias("deducted"), F.when(F.col("section") != "R", F.col("tax")).alias("deposited"))
    k = F.col("id") % 5
    result = F.when(k == 0, "MATCHED_CLAIMABLE").when(k == 1, "MATCHED_NOT_CLAIMABLE").otherwise("AMOUNT_MISMATCH")
    rows = s.select(F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "26AS").otherwise("BOOKS").alias("source"), F.col("id").alias("transaction_id"), "customer", F.col("status").alias("identity"), result.alias("result"), F.when(F.col("id") % 2 == 0, F.array("id", F.col("id") + 1)).otherwise(F.array(F.col("id") - 1)).alias("books"), F.array(entry).alias("entries"))
    return evidence.tan_summary(rows)


# -- statutory choices --------------------------------------------------------------------------------------------

_GIVEN_NATURES = _case("p_partkey", ["'Contract'", "' RENT-MACHINERY '", "'barter'", "NULL", "'professional fees'", "''"])


@query(f"""SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'contractor' WHEN 1 THEN 'rent_machinery' WHEN 4 THEN 'professional_fee' END AS nature, CASE p_partkey % 6 WHEN 2 THEN 'REVIEW_REQUIRED' WHEN 3 THEN 'NOT_DETERMINABLE' WHEN 5 THEN 'NOT_DETERMINABLE' ELSE 'CLASSIFIED' END AS nature_status,
  CASE p_partkey % 4 WHEN 0 THEN 'RESIDENT' WHEN 1 THEN 'NON_RESIDENT' WHEN 2 THEN 'RESIDENT' END AS residency, CASE p_partkey % 3 WHEN 0 THEN 'EVIDENCE_BACKED' WHEN 1 THEN 'NOT_VERIFIED' ELSE 'EVIDENCE_UNAVAILABLE' END AS pan_evidence FROM part""")
def controlled_values(spark, d):
    p = load(spark, d, "part").withColumn("given", F.expr(_GIVEN_NATURES))
    k = F.col("p_partkey")
    lives = F.when(k % 4 == 0, " resident ").when(k % 4 == 3, "elsewhere")
    contractor = F.when(k % 4 == 1, "CONFIRMED_NON_RESIDENT").when(k % 4 == 2, "CONFIRMED_RESIDENT")
    operational, reference = F.when(k % 3 == 2, "unavailable").otherwise("VERIFIED"), F.when(k % 3 == 0, "ref").otherwise(" ")
    return p.select(k.alias("id"), statutory.payment_nature(F.col("given")).alias("nature"), statutory.nature_status(F.col("given")).alias("nature_status"), statutory.residency(lives, contractor).alias("residency"), statutory.pan_evidence(operational, reference).alias("pan_evidence"))
