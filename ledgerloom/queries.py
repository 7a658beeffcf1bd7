"""Every operator over the driver's tables, with the SQL that its rows are held to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import amounts, dates, text
from .functions.amounts import MONEY
from .operators import compliance, duplicates, identity, matching, relationship, reports, returns, rules, search, validation
from .plans import components, greedy, reconcile
from .plans.frames import BOOKS_SQL, PAYMENTS_SQL, RULES_SQL, STATEMENTS_SQL, books, dealt_by_size, fy_sql, load, payments, quarter_sql, statements
from .plans.frames import rules as rule_table
from .sources import shared, sinks, tables
from .streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, decimals: str = ""):
    """Registers a query; its decimals, exact up to here, are given out as doubles on both sides."""
    names = decimals.split()

    def register(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            dealt_by_size(spark, d)
            return f(spark, d).withColumns({c: F.col(c).cast("double") for c in names})

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(f'{c}::DOUBLE AS {c}' for c in names)}) FROM ({sql})" if names else sql
        return f

    return register


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# -- scalar functions ---------------------------------------------------------------------------------------------


@query(f"SELECT o_orderkey AS id, {fy_sql('o_orderdate::DATE')} AS fy, {quarter_sql('o_orderdate::DATE')} AS quarter FROM orders")
def fy_quarter_calendar(spark, d):
    return books(spark, d).select("id", "fy", "quarter")


@query("""
WITH raw AS (SELECT o_orderkey AS id, o_totalprice::DECIMAL(18,2) AS v, o_orderkey % 6 AS k FROM orders)
SELECT id, CASE k WHEN 5 THEN NULL WHEN 1 THEN -v WHEN 2 THEN -v ELSE v END::DECIMAL(18,2) AS amount FROM raw""", decimals="amount")
def parse_amount_cases(spark, d):
    v = F.col("o_totalprice").cast(MONEY).cast("string")
    k = F.col("o_orderkey") % 6
    shown = F.when(k == 1, F.concat(F.lit("("), v, F.lit(")"))).when(k == 2, F.concat(v, F.lit("-"))).when(k == 3, F.concat(F.lit("₹ "), v)).when(k == 4, F.regexp_replace(v, r"(?<=\d)(?=(\d{3})+\.)", ",")).when(k == 5, F.concat(F.lit("n/a "), v)).otherwise(v)
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), amounts.parse_amount(shown).alias("amount"))


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 8 THEN NULL ELSE o_orderdate::DATE END AS day,
  (o_orderkey % 9 = 2 AND day(o_orderdate) <= 12) AS ambiguous FROM orders""")
def parse_date_cases(spark, d):
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 9
    formats = ["yyyy-MM-dd", "dd-MM-yyyy", "d/M/yyyy", "d-MMM-yyyy", "dd.MM.yyyy", "yyyy/M/d", "d MMMM yyyy"]
    shown = F.date_format(day, formats[0])
    for i, f in enumerate(formats):
        shown = F.when(k == i, F.date_format(day, f)).otherwise(shown)
    shown = F.when(k == 7, F.datediff(day, F.lit(dates.SERIAL_EPOCH).cast("date")).cast("string")).when(k == 8, F.lit("not a date")).otherwise(shown)
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), dates.parse_date(shown).alias("day"), dates.is_ambiguous_date(shown).alias("ambiguous"))


@query(f"""
WITH y AS (SELECT o_orderkey AS id, year(o_orderdate) AS y, o_orderkey % 5 AS k FROM orders)
SELECT id, CASE WHEN k = 4 AND y % 2 = 0 THEN 'PERIOD' || y WHEN k = 4 THEN y || '-45' ELSE y || '-' || lpad(((y + 1) % 100)::VARCHAR, 2, '0') END AS lenient,
  CASE WHEN k IN (1, 2) THEN y || '-' || lpad(((y + 1) % 100)::VARCHAR, 2, '0') END AS strict FROM y""")
def fy_normalize_cases(spark, d):
    y, k = F.year("o_orderdate"), F.col("o_orderkey") % 5
    s, two, four = y.cast("string"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"), (y + 1).cast("string")
    shown = F.when(k == 0, s).when(k == 1, F.concat(F.lit("FY "), s, F.lit("-"), two)).when(k == 2, F.concat(s, F.lit("-"), four)).when(k == 3, F.concat(F.lit("fy "), s, F.lit("/"), two)).when(y % 2 == 0, F.concat(F.lit("Fy period "), s)).otherwise(F.concat(s, F.lit("-245")))
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), dates.normalize_fy(shown).alias("lenient"), dates.strict_fy(shown).alias("strict"))


@query("""
SELECT p_partkey AS id, trim(regexp_replace(lower(p_name || ' (' || p_type || ')'), '[^a-z0-9]+', '_', 'g'), '_') AS key,
  trim(regexp_replace(regexp_replace(replace(upper(p_name || ' & ' || p_brand), '&', ' AND '), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS name,
  regexp_replace(upper(p_brand || ' ' || p_partkey), '\\s+', '', 'g') AS code
FROM part""")
def header_and_name_keys(spark, d):
    p = load(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("id"), text.header_key(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).alias("key"),
        text.normalize_name(F.concat("p_name", F.lit(" & "), "p_brand")).alias("name"), text.normalize_code(F.concat("p_brand", F.lit(" "), "p_partkey")).alias("code"),
    )


@query("""
WITH n AS (SELECT c_custkey AS id, string_split(upper(replace(c_name, '#', ' ')), ' ') || ['PVT', 'LTD'] AS w FROM customer)
SELECT id, array_to_string(list_filter(w, lambda x: x NOT IN ('PVT', 'LTD')), ' ') AS core,
  array_to_string(list_filter(w, lambda x: x NOT IN ('PVT', 'LTD')), '') AS compact FROM n""")
def core_names(spark, d):
    name = F.concat(F.col("c_name"), F.lit(" Pvt. Ltd."))
    return load(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.core_name(name).alias("core"), text.compact_name(name).alias("compact"))


@query("SELECT p_partkey AS id, array_to_string(string_split(p_name, ' '), '/') AS parts, len(string_split(p_name, ' '))::INTEGER AS n FROM part")
def split_lists(spark, d):
    parts = text.split_list(F.concat(F.lit(" ;"), F.replace(F.col("p_name"), F.lit(" "), F.lit("; ")), F.lit("|")))
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(parts, "/").alias("parts"), F.size(parts).alias("n"))


@query("""
WITH v AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'ABCDE' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || 'F'
  WHEN 1 THEN 'ABCD' || lpad((c_custkey % 100000)::VARCHAR, 5, '0') || 'E' WHEN 2 THEN ' ' ELSE 'X' || c_custkey END AS v FROM customer)
SELECT id, CASE WHEN trim(v) = '' THEN 'NOT_PROVIDED' WHEN id % 4 = 0 THEN 'FORMAT_VALID_UNVERIFIED' ELSE 'FORMAT_INVALID' END AS pan,
  regexp_matches(v, '^[A-Z]{4}[0-9]{5}[A-Z]$') AS is_tan, substr(v, 1, 5) || '****' || substr(v, 10, 1) AS masked FROM v""")
def identifiers(spark, d):
    k, id_ = F.col("c_custkey") % 4, F.col("c_custkey")
    v = F.when(k == 0, F.concat(F.lit("ABCDE"), F.lpad((id_ % 10000).cast("string"), 4, "0"), F.lit("F"))).when(k == 1, F.concat(F.lit("ABCD"), F.lpad((id_ % 100000).cast("string"), 5, "0"), F.lit("E"))).when(k == 2, F.lit(" ")).otherwise(F.concat(F.lit("X"), id_))
    return load(spark, d, "customer").select(id_.alias("id"), text.pan_status(v).alias("pan"), text.is_tan(v).alias("is_tan"), text.mask_identifier(v).alias("masked"))


@query(_with(PAYMENTS_SQL) + "SELECT id, CASE WHEN day <= DATE '1998-01-01' THEN 'INCOME_TAX_ACT_1961' ELSE 'INCOME_TAX_ACT_2025' END AS law FROM payments")
def governing_law(spark, d):
    return payments(spark, d).select("id", dates.governing_law(F.col("credited"), F.col("paid"), "1998-01-01").alias("law"))


@query(_with(PAYMENTS_SQL) + """
SELECT id, CASE WHEN credited > paid THEN (year(credited) - year(paid)) * 12 + month(credited) - month(paid) + 1 ELSE 0 END::INTEGER AS months,
  CASE WHEN credited > paid THEN (credited - paid + 30) // 30 ELSE 0 END::INTEGER AS blocks,
  last_day(paid) + 7 AS after_month, make_date(year(paid) + CASE WHEN month(paid) > 4 THEN 1 ELSE 0 END, 4, 30) AS fixed_day
FROM payments""")
def interest_periods_and_deadlines(spark, d):
    paid, credited = F.col("paid"), F.col("credited")
    return payments(spark, d).select(
        "id", dates.interest_periods(paid, credited).cast("int").alias("months"), dates.interest_periods(paid, credited, "FIXED_DAY_BLOCK").cast("int").alias("blocks"),
        dates.deposit_deadline(paid, "MONTH_END_PLUS_DAYS").alias("after_month"), dates.deposit_deadline(paid, "FIXED_MONTH_DAY").alias("fixed_day"),
    )


@query("SELECT c_custkey AS id, substr(sha256(upper(replace(c_name, '#', ' '))), 1, 20) AS client FROM customer")
def client_ids(spark, d):
    return load(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.client_id(F.lit(" "), F.col("c_name")).alias("client"))


# -- sources ------------------------------------------------------------------------------------------------------

def _export(rows: DataFrame, name: str) -> str:
    """The rows as a folder of delimited files, each below a header of its own, as an accounting system gives them out."""
    path = components.shared_path(rows.sparkSession, name)
    rows.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return path


def _book_export(spark: SparkSession, d: str) -> str:
    o = load(spark, d, "orders")
    key = F.col("o_orderkey").cast("string")
    rows = o.select(
        F.concat(F.lit("V"), key).alias("Voucher No"), F.concat(F.lit('Rao "'), F.col("o_custkey").cast("string"), F.lit('" & Co')).alias("Party Name"), F.date_format("o_orderdate", "dd-MM-yyyy").alias("Voucher Date"),
        F.format_number(F.col("o_totalprice").cast(MONEY), 2).alias("Taxable Value"), F.concat(F.lit("order "), key, F.lit("\n"), F.col("o_orderpriority")).alias("Narration"),
    )
    # a total below each part's rows
    total = o.filter("o_orderkey % 1000 = 0").select(F.lit("Grand Total").alias("Voucher No"), *(F.lit("").alias(c) for c in ("Party Name", "Voucher Date")), F.lit("1").alias("Taxable Value"), F.lit("").alias("Narration"))
    return _export(rows.unionByName(total), "books-export")


@query("""SELECT 'V' || o_orderkey AS transaction_id, 'Rao "' || o_custkey || '" & Co' AS customer_name, o_orderdate::DATE AS document_date, o_totalprice::DECIMAL(18,2) AS taxable_value,
  'order ' || o_orderkey || chr(10) || o_orderpriority AS narration FROM orders""", decimals="taxable_value")
def canonical_books(spark, d):
    return tables.read_delimited(spark, _book_export(spark, d), "books").select("transaction_id", "customer_name", "document_date", "taxable_value", "narration")


@query("""SELECT 'header' AS what, 11::BIGINT AS score, true AS footer, 1::BIGINT AS least, NULL::BIGINT AS most WHERE EXISTS (FROM orders)
UNION ALL SELECT 'row', 0, false, count(*), count(*) FROM orders UNION ALL SELECT 'total', 0, true, count(*), count(*) FROM orders WHERE o_orderkey % 1000 = 0""")
def header_scores_and_footers(spark, d):
    """Lines of an export by what they are: how well they fit a header, and whether they are left out."""
    from .sources import schema

    whole = tables.records(tables.lines(spark, _book_export(spark, d)), ",").select(tables.split_cells(F.col("value"), ",").alias("cells"))
    whole, keys = whole.select(F.transform("cells", text.header_key).alias("keys")), F.col("keys")
    first = F.get(F.filter(keys, lambda k: k != ""), F.lit(0))
    header = F.array(*map(F.lit, ("voucher_no", "party_name", "voucher_date", "taxable_value", "narration")))
    score, footer = validation.header_score(keys, schema.aliases("books")).cast("long"), F.coalesce(validation.is_footer(first, keys, header), F.lit(False))
    what = F.when(first == "voucher_no", "header").when(first == "grand_total", "total").otherwise("row")
    rows = whole.select(what.alias("what"), score.alias("score"), footer.alias("footer")).groupBy("what", "score", "footer").agg(F.count("*").alias("n"))
    is_header = F.col("what") == "header"  # as many as there are files
    return rows.select("what", "score", "footer", F.when(is_header, F.least(F.col("n"), F.lit(1))).otherwise(F.col("n")).alias("least"), F.when(~is_header, F.col("n")).alias("most"))


@query(decimals="difference")
def reconciliation_of_exports(spark, d):
    """Exports of books, statement and masters as files, read, normalised, resolved and matched."""
    b, s, c = books(spark, d), statements(spark, d), load(spark, d, "customer")
    day = lambda: F.date_format("day", "dd-MM-yyyy")
    named = lambda key: F.concat(F.lit("Firm "), F.chr(F.lit(65) + F.col(key) % 26), F.lit(" "), F.col(key).cast("string"))
    book_file = b.select(F.concat(F.lit("V"), "id").alias("Voucher No"), named("customer").alias("Party Name"), F.concat(F.lit("C"), "customer").alias("Party Code"), day().alias("Voucher Date"), F.format_number("amount", 2).alias("TDS Receivable"), F.col("section").alias("Section"))
    # a deductor for each customer; every third is known by its TAN, the others by name, some under another name
    other = F.when(F.col("customer") % 5 == 0, F.concat(named("customer"), F.lit(" Branch"))).otherwise(named("customer"))
    tan = F.concat(F.lit("DELA"), F.lpad(F.col("customer").cast("string"), 5, "0"), F.lit("B"))
    statement_file = s.select(F.concat(F.lit("S"), "id").alias("Transaction Id"), tan.alias("TAN"), other.alias("Name of Deductor"), day().alias("Transaction Date"), F.format_number("amount", 2).alias("Tax Deducted"), F.format_number(F.when(F.col("section") != "R", F.col("amount")), 2).alias("TDS Deposited"), F.col("status").alias("Status of Booking"), F.col("section").alias("Section"))
    own = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("DELA"), F.lpad(F.col("c_custkey").cast("string"), 5, "0"), F.lit("B"))).otherwise("")
    master_file = c.select(F.concat(F.lit("C"), "c_custkey").alias("Customer Code"), named("c_custkey").alias("Customer Name"), own.alias("TAN"))
    read = lambda rows, name, kind: tables.read_delimited(spark, _export(rows, name), kind, raw=True)
    found = reconcile.reconcile_exports(read(book_file, "books-export", "books"), read(statement_file, "statement-export", "form26as"), read(master_file, "master-export", "customer_master"))
    return found.drop("group_id")


@query("""
WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS id, max(l_extendedprice::DECIMAL(18,2)) AS amount, min(l_shipdate::DATE) AS day, min(l_suppkey) AS supp FROM lineitem GROUP BY 1)
SELECT id::BIGINT AS row_no, '1^' || supp AS batch, 'P' || id AS pan, amount, day AS pay_date, TRUE AS complete FROM t""", decimals="amount")
def caret_returns(spark, d):
    s = statements(spark, d)
    fields = {1: F.lit("DD"), 2: F.lit("1"), 3: F.col("tan").cast("string"), 7: F.concat(F.lit("P"), "id"), 19: F.col("amount").cast("string"), 18: F.date_format("day", "ddMMyyyy")}
    line = F.array_join(F.array(*(fields.get(i, F.lit("")) for i in range(45))), "^")
    return tables.caret_records(s.select(F.col("id").alias("row_no"), line.alias("value")), "DD").select("row_no", "batch", "pan", "amount", "pay_date", "complete")


@query("""
WITH s AS (SELECT o_orderkey AS id, o_orderkey // 50 AS block, o_orderkey % 10 = 0 AS head, o_custkey AS c, o_orderkey FROM orders)
SELECT id, block, carried FROM (SELECT id, block, head, last_value(CASE WHEN head THEN c END IGNORE NULLS) OVER (PARTITION BY block ORDER BY id) AS carried FROM s) WHERE NOT head""")
def block_rows(spark, d):
    rows = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_orderkey") / 50).alias("block"), "o_custkey")
    return tables.carry_blocks(rows, F.col("id") % 10 == 0, {"carried": F.col("o_custkey")}, "id", "block").select("id", "block", "carried")


# -- validation and duplicates ------------------------------------------------------------------------------------

_DUPLICATE_KEY = "l_orderkey, l_linenumber"


@query(_with(STATEMENTS_SQL) + """
SELECT id, CASE WHEN row_number() OVER w > 1 THEN first_value(id) OVER w END AS duplicate_of
FROM stmts WINDOW w AS (PARTITION BY tan, section, status, fy, quarter ORDER BY id)""")
def duplicate_statements(spark, d):
    rows = duplicates.flag_repeats(statements(spark, d), [F.col(c) for c in ("tan", "section", "status", "fy", "quarter")], [F.col("id")], "id")
    return rows.select("id", "duplicate_of")


@query(f"SELECT l_orderkey AS id, l_linenumber AS line, count(*)::BIGINT AS n, count(*) > 1 AS duplicate_review FROM lineitem GROUP BY {_DUPLICATE_KEY}")
def duplicate_review(spark, d):
    rows = duplicates.flag_all_repeats(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), [F.col("l_orderkey"), F.col("l_linenumber")])
    return rows.groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line")).agg(F.count("*").alias("n"), F.max("duplicate_review").alias("duplicate_review"))


_CHECKS = {"amount below 1000": lambda: F.col("amount") >= 1000, "status not final": lambda: F.col("section") != "1-URGENT"}


@query(_with(BOOKS_SQL) + """
SELECT id, CASE WHEN amount < 1000 OR section = '1-URGENT' THEN 'UNAVAILABLE_FOR_MATCHING' ELSE 'AVAILABLE' END AS validation_state,
  concat_ws('; ', CASE WHEN amount < 1000 THEN 'amount below 1000' END, CASE WHEN section = '1-URGENT' THEN 'status not final' END) AS messages FROM books""")
def row_exceptions(spark, d):
    rows = validation.row_exceptions(books(spark, d), {k: f() for k, f in _CHECKS.items()})
    return rows.select("id", "validation_state", F.array_join("messages", "; ").alias("messages"))


@query(_with(BOOKS_SQL) + """, bad AS (
  SELECT 'amount below 1000' AS problem, 'row_exception' AS severity, id FROM books WHERE amount < 1000
  UNION ALL SELECT 'status not final', 'warning', id FROM books WHERE section = '1-URGENT')
SELECT problem, severity, count(*)::BIGINT AS rows, array_to_string((list(id ORDER BY id))[1:20], ',') AS first_rows FROM bad GROUP BY ALL""")
def validation_issues(spark, d):
    checks = {k: (s, f()) for (k, f), s in zip(_CHECKS.items(), ("row_exception", "warning"))}
    out = validation.issues(books(spark, d), checks, "id")
    return out.select("problem", "severity", "rows", F.array_join("first_rows", ",").alias("first_rows"))


@query(_with(BOOKS_SQL) + "SELECT CASE WHEN count(*) FILTER (WHERE amount < 1000) > 0 THEN 'READY_WITH_EXCEPTIONS' WHEN count(*) FILTER (WHERE section = '1-URGENT') > 0 THEN 'READY_WITH_WARNINGS' ELSE 'VALID' END AS status FROM books")
def file_status(spark, d):
    checks = {k: (s, f()) for (k, f), s in zip(_CHECKS.items(), ("row_exception", "warning"))}
    return validation.file_status(validation.issues(books(spark, d), checks, "id"))


@query(_with(BOOKS_SQL) + "SELECT fy, count(*)::BIGINT AS n, count(DISTINCT customer)::BIGINT AS customers FROM books GROUP BY fy")
def fy_distribution(spark, d):
    return books(spark, d).groupBy("fy").agg(F.count("*").alias("n"), F.countDistinct("customer").alias("customers"))


# -- rules --------------------------------------------------------------------------------------------------------

_IN_FORCE = "day BETWEEN coalesce(effective_from, DATE '0001-01-01') AND coalesce(effective_to, DATE '9999-12-31')"


@query(_with(PAYMENTS_SQL, RULES_SQL) + f"SELECT p.id, max_by(rule_id, version) AS rule_id, max_by(rate, version) AS rate FROM payments p LEFT JOIN rules ON {_IN_FORCE} GROUP BY p.id", decimals="rate")
def rule_lookup_versioned(spark, d):
    cond = rules.in_force(F.col("day"), F.col("effective_from"), F.col("effective_to"))
    return rules.select_best(payments(spark, d), rule_table(spark), "id", cond, F.col("version"), F.desc("version")).select("id", "rule_id", "rate")


_BEST = f"""hits AS (SELECT p.id AS pid, rule_id AS hit, priority AS hit_priority FROM payments p JOIN rules ON {_IN_FORCE}),
tops AS (SELECT pid, max(hit_priority) AS top FROM hits GROUP BY pid),
chosen AS (SELECT h.pid, count(*) AS n, max(hit) AS best_rule FROM hits h JOIN tops t ON t.pid = h.pid AND h.hit_priority = t.top GROUP BY h.pid),
best AS (
  SELECT p.*, r.*, CASE WHEN c.n IS NULL THEN 'NOT_FOUND' WHEN c.n > 1 THEN 'AMBIGUOUS' ELSE 'FOUND' END AS rule_state
  FROM payments p LEFT JOIN chosen c ON c.pid = p.id LEFT JOIN rules r ON r.rule_id = c.best_rule AND c.n = 1)"""


@query(_with(PAYMENTS_SQL, RULES_SQL, _BEST) + "SELECT id, rule_id, rule_state FROM best")
def rule_select_priority(spark, d):
    cond = rules.in_force(F.col("day"), F.col("effective_from"), F.col("effective_to"))
    return rules.select_best(payments(spark, d), rule_table(spark), "id", cond, F.col("priority")).select("id", "rule_id", "rule_state")


@query("""
SELECT o_orderkey AS id, (o_orderkey % 2 = 0 AND o_orderkey % 3 = 0) AS met FROM orders""")
def rule_fact_division(spark, d):
    k = F.col("o_orderkey")
    fact = lambda t, ok: F.struct(F.lit(t).alias("fact_type"), F.lit("Y").alias("value_code"), F.when(ok, "VERIFIED").otherwise("CLAIMED").alias("evidence_status"))
    need = F.array(*(F.struct(F.lit(t).alias("fact_type"), F.lit("Y").alias("value_code")) for t in ("contract", "resident")))
    facts = F.array(fact("contract", k % 2 == 0), fact("resident", k % 3 == 0), fact("other", k % 5 == 0))
    return load(spark, d, "orders").select(k.alias("id"), rules.requirements_met(need, facts).alias("met"))


_MAPPINGS = [("green", "GOODS", 1), ("blue", "SERVICE", 2), ("steel", "CONTRACT", 2), ("brass", "CONTRACT", 3), ("small", "GOODS", 3)]


@query(f"""
WITH m(keyword, nature, priority) AS (VALUES {', '.join(map(str, _MAPPINGS))}),
h AS (SELECT p_partkey AS id, nature, priority, max(priority) OVER (PARTITION BY p_partkey) AS top
  FROM part LEFT JOIN m ON contains(lower(p_name || ' ' || p_type), keyword)),
n AS (SELECT id, count(DISTINCT nature) AS n, min(nature) AS nature FROM h WHERE priority IS NULL OR priority = top GROUP BY id)
SELECT id, CASE WHEN n = 1 THEN nature END AS nature, CASE n WHEN 0 THEN 'NONE' WHEN 1 THEN 'MAPPED' ELSE 'CONFLICT' END AS mapping_status FROM n""")
def mapping_keyword_priority(spark, d):
    rows = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("words"))
    return rules.apply_mappings(rows, spark.createDataFrame(_MAPPINGS, "keyword string, nature string, priority int"), "id", F.col("words"))


@query(f"""WITH {RULES_SQL}
SELECT a.rule_id AS rule_a, b.rule_id AS rule_b, greatest(a.effective_from, b.effective_from) AS both_from,
  least(coalesce(a.effective_to, DATE '9999-12-31'), coalesce(b.effective_to, DATE '9999-12-31')) AS both_to
FROM rules a JOIN rules b ON a.rule_id < b.rule_id AND a.effective_from <= coalesce(b.effective_to, DATE '9999-12-31')
  AND b.effective_from <= coalesce(a.effective_to, DATE '9999-12-31')""")
def interval_overlap_conflicts(spark, d):
    return rules.overlapping(rule_table(spark), "rule_id", [])


@query("SELECT o_custkey AS customer, o_orderkey AS version, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS is_current FROM orders")
def latest_version(spark, d):
    rows = load(spark, d, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("version"))
    return rules.current_versions(rows, "customer", "version")


@query(_with(PAYMENTS_SQL) + """
SELECT id, concat_ws(',', CASE WHEN NOT amount > 30000 THEN 'below threshold' END, CASE WHEN NOT actual > 0 THEN 'nothing withheld' END) AS reasons FROM payments""")
def rule_eligibility(spark, d):
    reasons = rules.eligibility("", {"below threshold": F.col("amount") > 30000, "nothing withheld": F.col("actual") > 0})
    return payments(spark, d).select("id", F.array_join(reasons, ",").alias("reasons"))


# -- compliance ---------------------------------------------------------------------------------------------------

_PRIOR = "coalesce(sum(amount) OVER (PARTITION BY deductee, fy ORDER BY day, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DECIMAL(18,2) AS prior"


@query(_with(PAYMENTS_SQL) + f"""
SELECT id, prior, CASE WHEN prior + amount > 250000 THEN prior + amount - greatest(prior, 250000) WHEN amount > 50000 THEN amount ELSE 0 END::DECIMAL(18,2) AS excess,
  CASE WHEN prior + amount > 250000 OR amount > 50000 THEN amount ELSE 0 END::DECIMAL(18,2) AS whole,
  CASE WHEN prior + amount < 100000 THEN 0 ELSE amount END::DECIMAL(18,2) AS single
FROM (SELECT *, {_PRIOR} FROM payments)""", decimals="prior excess whole single")
def threshold_cumulative(spark, d):
    c = F.col
    rows = payments(spark, d).withColumn("prior", compliance.prior_total(c("amount"), [c("deductee"), c("fy")], [c("day"), c("id")]))
    per, total = F.lit("50000").cast(MONEY), F.lit("250000").cast(MONEY)
    return rows.select(
        "id", "prior", compliance.taxable_subject(c("amount"), c("prior"), per, total, F.lit(True)).alias("excess"),
        compliance.taxable_subject(c("amount"), c("prior"), per, total, F.lit(False)).alias("whole"),
        compliance.single_threshold_subject(c("amount"), c("prior"), F.lit("100000").cast(MONEY), F.lit("BOTH"), F.lit(False)).alias("single"),
    )


_CALCULATED = f"""prior AS (
  SELECT *, CASE WHEN rule_state = 'FOUND' THEN coalesce(sum(CASE WHEN rule_state = 'FOUND' THEN amount END) OVER (
    PARTITION BY deductee, fy, rule_id, nature ORDER BY day, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DECIMAL(18,2) END AS prior FROM best),
subj AS (
  SELECT *, CASE WHEN rule_state = 'FOUND' THEN CASE
      WHEN coalesce(prior + amount > aggregate, FALSE) AND coalesce(excess_only, FALSE) THEN prior + amount - greatest(prior, aggregate)
      WHEN coalesce(amount > per_transaction, FALSE) OR coalesce(prior + amount > aggregate, FALSE) THEN amount ELSE 0 END END::DECIMAL(18,2) AS subject FROM prior),
calc AS (
  SELECT id, deductee, fy, CASE WHEN day <= DATE '1998-01-01' THEN 'INCOME_TAX_ACT_1961' ELSE 'INCOME_TAX_ACT_2025' END AS law, rule_id, rule_state, prior, subject,
    CASE WHEN rule_state = 'FOUND' THEN round((subject * rate)::DECIMAL(30,4) * 0.01, 2)::DECIMAL(18,2) END AS expected, actual,
    CASE WHEN rule_state = 'FOUND' THEN 'CALCULATED' ELSE 'RULE_NOT_FOUND' END AS calculation_status, credited, paid FROM subj)"""


@query(_with(PAYMENTS_SQL, RULES_SQL, _BEST, _CALCULATED) + """
SELECT *, CASE WHEN expected IS NULL THEN 'NOT_DETERMINABLE' WHEN actual = expected THEN 'COMPLIANT' WHEN actual < expected THEN 'SHORT_DEDUCTION' ELSE 'EXCESS_DEDUCTION' END AS deduction_status FROM calc""", decimals="prior subject expected actual")
def ledger_calculation_status(spark, d):
    return reconcile.ledger_calculation(payments(spark, d), rule_table(spark))


_EVIDENCE_SQL = """evidence AS (
  SELECT l_orderkey * 10 + l_linenumber AS reference, CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN NULL ELSE (l_extendedprice::DECIMAL(18,2) * l_tax::DECIMAL(4,2))::DECIMAL(18,2) END AS amount,
    CASE WHEN l_quantity > 48 THEN NULL ELSE l_shipdate::DATE END AS day FROM lineitem WHERE l_orderkey % 7 != 3)"""


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    tax = (F.col("l_extendedprice").cast(MONEY) * F.col("l_tax").cast("decimal(4,2)")).cast(MONEY)
    return load(spark, d, "lineitem").filter("l_orderkey % 7 != 3").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("reference"), F.when(~((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)), tax).alias("amount"),
        F.when(F.col("l_quantity") <= 48, F.col("l_shipdate").cast("date")).alias("day"),
    )


_DEPOSITS = """owed AS (SELECT id, actual AS expected, paid AS deducted_on, last_day(paid) + 7 AS due_on FROM payments),
of_evidence AS (
  SELECT reference, CASE WHEN count(amount) = count(*) THEN sum(amount) END AS deposited, CASE WHEN count(day) = count(*) THEN max(day) END AS deposited_on, min(day) AS first_day, count(*) AS records
  FROM evidence GROUP BY reference),
dep AS (
  SELECT *, CASE WHEN records IS NULL THEN 'DEPOSIT_MISSING' WHEN deposited IS NULL THEN 'REVIEW_REQUIRED' WHEN deposited = expected THEN 'DEPOSIT_MATCHED' WHEN deposited < expected THEN 'DEPOSIT_SHORT' ELSE 'DEPOSIT_EXCESS' END AS amount_status,
    CASE WHEN records IS NULL THEN 'NOT_DETERMINABLE' WHEN deposited_on IS NULL OR first_day < deducted_on THEN 'REVIEW_REQUIRED' WHEN deposited_on > due_on THEN 'LATE' ELSE 'ON_TIME' END AS time_status
  FROM owed LEFT JOIN of_evidence ON reference = id)"""


@query(_with(PAYMENTS_SQL, _EVIDENCE_SQL, _DEPOSITS) + """
SELECT id, deposited::DECIMAL(18,2) AS deposited, deposited_on, amount_status, time_status, CASE WHEN amount_status = 'DEPOSIT_MISSING' THEN 'MISSING_DEPOSIT_EVIDENCE'
  WHEN amount_status = 'REVIEW_REQUIRED' OR time_status = 'REVIEW_REQUIRED' THEN 'REVIEW_REQUIRED'
  WHEN amount_status IN ('DEPOSIT_SHORT', 'DEPOSIT_EXCESS') AND time_status = 'LATE' THEN 'DEPOSIT_AND_TIMELINESS_EXCEPTION'
  WHEN amount_status IN ('DEPOSIT_SHORT', 'DEPOSIT_EXCESS') THEN 'DEPOSIT_AMOUNT_EXCEPTION' WHEN time_status = 'LATE' THEN 'DEPOSIT_TIMELINESS_EXCEPTION' ELSE 'FULLY_DEPOSIT_COMPLIANT' END AS overall
FROM dep""", decimals="deposited")
def deposit_status(spark, d):
    owed = payments(spark, d).select("id", F.col("actual").alias("expected"), F.col("paid").alias("deducted_on"), dates.deposit_deadline(F.col("paid"), "MONTH_END_PLUS_DAYS").alias("due_on"))
    return compliance.deposits(owed, _evidence(spark, d)).select("id", F.col("deposited").cast(MONEY).alias("deposited"), "deposited_on", "amount_status", "time_status", "overall")


@query(_with(PAYMENTS_SQL, RULES_SQL, _BEST, _CALCULATED, _EVIDENCE_SQL) + """, owed AS (SELECT id, expected, paid AS deducted_on, last_day(paid) + 7 AS due_on FROM calc WHERE expected IS NOT NULL),
of_evidence AS (SELECT reference, CASE WHEN count(day) = count(*) THEN max(day) END AS deposited_on FROM evidence GROUP BY reference),
p AS (SELECT id, expected, deposited_on, CASE WHEN deposited_on IS NULL THEN NULL WHEN deposited_on <= due_on THEN 0 WHEN deposited_on > deducted_on
    THEN (year(deposited_on) - year(deducted_on)) * 12 + month(deposited_on) - month(deducted_on) + 1 ELSE 0 END AS periods FROM owed LEFT JOIN of_evidence ON reference = id),
i AS (SELECT id, deposited_on, round((expected * (1.50::DECIMAL(18,2) * periods)::DECIMAL(12,4))::DECIMAL(34,6) * 0.01::DECIMAL(3,2), 2)::DECIMAL(18,2) AS interest FROM p)
SELECT id, interest, CASE WHEN deposited_on IS NULL THEN 'DATE_NOT_DETERMINABLE' WHEN interest > 0 THEN 'INTEREST_DUE' ELSE 'NO_INTEREST_INDICATED' END AS interest_status FROM i""", decimals="interest")
def interest_compliance(spark, d):
    calculated = reconcile.ledger_calculation(payments(spark, d), rule_table(spark))
    return reconcile.deposit_and_interest(calculated, _evidence(spark, d)).select("id", "interest", "interest_status")


@query(_with(PAYMENTS_SQL, _EVIDENCE_SQL) + """,
ours AS (SELECT year(day) AS y, CASE WHEN count(actual) = count(*) THEN sum(actual) END AS ours, count(*) AS records FROM payments GROUP BY 1),
theirs AS (SELECT year(day) AS y, sum(amount) AS theirs FROM evidence WHERE day IS NOT NULL GROUP BY 1)
SELECT coalesce(o.y, t.y)::INTEGER AS y, ours::DECIMAL(18,2) AS ours, records::BIGINT AS records, theirs::DECIMAL(18,2) AS theirs,
  CASE WHEN ours IS NULL OR theirs IS NULL THEN 'NOT_DETERMINABLE' WHEN ours = theirs THEN 'TDS_CONTROL_MATCH' ELSE 'TDS_CONTROL_DIFFERENCE' END AS control_status,
  (ours - theirs)::DECIMAL(18,2) AS difference FROM ours o FULL JOIN theirs t ON o.y = t.y""", decimals="ours theirs difference")
def government_control(spark, d):
    ours = payments(spark, d).withColumn("y", F.year("day"))
    theirs = _evidence(spark, d).filter("day is not null").withColumn("y", F.year("day"))
    return compliance.control_totals(ours, theirs, ["y"])


# -- returns ------------------------------------------------------------------------------------------------------

_RETURN_SQL = """filed AS (SELECT id, CASE WHEN id % 3 = 0 THEN id END AS txn, CASE WHEN id % 3 < 2 THEN deductee * 1000000 + (actual * 100)::BIGINT % 1000000 END AS document, deductee AS pan, actual FROM payments WHERE id % 11 != 5),
ledger AS (SELECT id, id AS txn, deductee * 1000000 + (actual * 100)::BIGINT % 1000000 AS document, deductee AS pan, actual FROM payments WHERE id % 13 != 4),
cand AS (SELECT f.id AS row_id, l.id AS ledger_id, 0 AS t, 'TRANSACTION' AS tier FROM filed f JOIN ledger l ON f.txn = l.txn
  UNION ALL SELECT f.id, l.id, 1, 'DOCUMENT' FROM filed f JOIN ledger l ON f.document = l.document),
firsts AS (SELECT row_id, min(t) AS first_t FROM cand GROUP BY row_id),
tiered AS (SELECT DISTINCT c.row_id, c.ledger_id, c.tier FROM cand c JOIN firsts f ON c.row_id = f.row_id AND c.t = f.first_t)"""


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    filed = rows.filter("id % 11 != 5").withColumn("txn", F.when(F.col("id") % 3 == 0, F.col("txn"))).withColumn("document", F.when(F.col("id") % 3 < 2, F.col("document")))
    return filed, rows.filter("id % 13 != 4")


def _returned(spark: SparkSession, d: str) -> DataFrame:
    document = F.col("deductee") * 1000000 + (F.col("actual") * 100).cast("long") % 1000000
    return payments(spark, d).select("id", F.col("id").alias("txn"), document.alias("document"), F.col("deductee").alias("pan"), "actual")


def _filed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return _sides(_returned(spark, d))


def _keys(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with their keys only, made once: every tier and the audit read them, and order lines are moved for none again."""
    return _sides(shared.kept(_returned(spark, d).select("id", "document")).withColumn("txn", F.col("id")))


def _candidates(filed: DataFrame, ledger: DataFrame) -> DataFrame:
    return returns.tiered_candidates(filed, ledger, [("TRANSACTION", "txn", "txn"), ("DOCUMENT", "document", "document")])


@query(_with(PAYMENTS_SQL, _RETURN_SQL) + "SELECT * FROM tiered")
def tiered_candidates(spark, d):
    return _candidates(*_keys(spark, d))


@query(_with(PAYMENTS_SQL, _RETURN_SQL) + """, one AS (SELECT row_id, min(ledger_id) AS ledger_id, min(tier) AS tier FROM tiered GROUP BY row_id HAVING count(*) = 1)
SELECT row_id, ledger_id, tier FROM one QUALIFY count(*) OVER (PARTITION BY ledger_id) = 1""")
def mutual_unique(spark, d):
    return returns.confirmed(_candidates(*_keys(spark, d))).select("row_id", "ledger_id", "tier")


@query(_with(PAYMENTS_SQL, _RETURN_SQL) + "SELECT id FROM ledger WHERE id NOT IN (SELECT ledger_id FROM tiered)")
def missing_in_return(spark, d):
    filed, ledger = _keys(spark, d)
    return returns.missing_in_return(ledger, _candidates(filed, ledger)).select("id")


@query(_with(PAYMENTS_SQL, _RETURN_SQL) + """
SELECT coalesce(f.id, l.id) AS id, f.actual AS returned, l.actual AS booked, CASE WHEN l.id IS NULL THEN 'MISSING_IN_BOOKS' WHEN f.id IS NULL THEN 'MISSING_IN_RETURN'
  WHEN f.actual = l.actual THEN 'MATCHED' ELSE 'DIFFERENCE' END AS status FROM filed f FULL JOIN ledger l ON f.id = l.id""", decimals="returned booked")
def full_outer_return(spark, d):
    filed, ledger = _filed(spark, d)
    return returns.full_reconcile(filed, ledger, "id", "actual")


@query(_with(PAYMENTS_SQL, RULES_SQL, _BEST, _CALCULATED, _EVIDENCE_SQL) + """,
dep AS (SELECT reference, CASE WHEN count(amount) = count(*) THEN sum(amount) END AS deposited FROM evidence GROUP BY 1)
SELECT id, CASE WHEN expected IS NULL THEN 'REVIEW_REQUIRED' WHEN deposited IS NULL AND reference IS NOT NULL THEN 'REVIEW_REQUIRED'
  WHEN actual != expected THEN 'DIFFERENCE' WHEN reference IS NOT NULL AND deposited != actual THEN 'DIFFERENCE' WHEN reference IS NULL THEN 'MISSING_IN_DEPOSIT_EVIDENCE' ELSE 'MATCHED' END AS status
FROM calc LEFT JOIN dep ON reference = id""")
def return_row_status(spark, d):
    calculated = reconcile.ledger_calculation(payments(spark, d), rule_table(spark))
    of = _evidence(spark, d).groupBy(F.col("reference").alias("id")).agg(amounts.strict_sum(F.col("amount")).alias("deposited"), F.lit(True).alias("seen"))
    joined = calculated.join(of, "id", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    tax = amounts.compare(F.col("actual"), F.col("expected"))
    challan = F.when(F.col("seen"), amounts.compare(F.col("actual"), F.col("deposited"))).otherwise("MATCHED")
    no = F.lit(False)
    return joined.select("id", returns.row_status(F.lit(True), no, no, F.col("expected").isNotNull(), [tax, challan], F.col("seen")).alias("status"))


# -- identity -----------------------------------------------------------------------------------------------------


@query("""
WITH x AS (SELECT s_suppkey AS tan, upper(replace(s_name, '#', ' ')) AS name, s_nationkey FROM supplier),
a AS (SELECT s_suppkey AS tan, s_suppkey * 10 AS code FROM supplier WHERE s_suppkey % 4 = 0),
b AS (SELECT upper(replace(s_name, '#', ' ')) AS name, max(s_suppkey) * 10 + 1 AS code FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY 1)
SELECT x.tan, coalesce(a.code, b.code) AS code, CASE WHEN a.code IS NOT NULL THEN 'MASTER_TAN' WHEN b.code IS NOT NULL THEN 'NAME' END AS method
FROM x LEFT JOIN a ON a.tan = x.tan LEFT JOIN b ON b.name = x.name""")
def identity_tiers(spark, d):
    s = load(spark, d, "supplier")
    x = s.select(F.col("s_suppkey").alias("tan"), text.normalize_name(F.col("s_name")).alias("name"))
    a = s.filter("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("tan"), (F.col("s_suppkey") * 10).alias("code"))
    b = s.filter("s_suppkey % 3 = 0").groupBy(text.normalize_name(F.col("s_name")).alias("name")).agg((F.max("s_suppkey") * 10 + 1).alias("code"))
    return identity.tiers(x, [("MASTER_TAN", a), ("NAME", b)]).select("tan", "code", "method")


@query(_with(STATEMENTS_SQL) + """, n AS (SELECT tan, section AS name, count(*) AS n, sum(tax) AS tax, list_distinct(list(quarter)) AS q FROM stmts GROUP BY 1, 2),
f AS (SELECT *, row_number() OVER (PARTITION BY tan ORDER BY n DESC, name) AS r FROM n)
SELECT tan, max(CASE WHEN r = 1 THEN name END) AS name, count(*)::BIGINT AS names, sum(n)::BIGINT AS records, sum(tax)::DECIMAL(18,2) AS tax,
  array_to_string(list_sort(list_distinct(flatten(list(q)))), ',') AS quarters FROM f GROUP BY tan""", decimals="tax")
def identity_by_tan(spark, d):
    rows = statements(spark, d).withColumn("name", F.col("section"))
    return identity.by_tan(rows).withColumn("tax", F.col("tax").cast(MONEY))


@query("""
WITH p AS (SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY 1), w AS (SELECT id, unnest(list_distinct(string_split(name, ' '))) AS word FROM p)
SELECT a.id AS left_id, b.id AS right_id, count(*)::BIGINT AS shared FROM w a JOIN w b ON a.word = b.word WHERE length(a.word) > 1 GROUP BY 1, 2""")
def token_block_candidates(spark, d):
    p = load(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    return identity.blocked_pairs(p, p)


@query("""
WITH w AS (SELECT p_partkey AS id, unnest(list_distinct(string_split(p_name, ' '))) AS word FROM part)
SELECT a.id AS left_id, b.id AS right_id, count(*)::BIGINT AS shared FROM w a JOIN w b ON a.word = b.word WHERE length(a.word) > 1 GROUP BY 1, 2""")
def token_block_candidates_all(spark, d):
    p = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return identity.blocked_pairs(p, p)


@query()
def fuzzy_topk(spark, d):
    """The most alike of all other parts that share a word, however little alike they are."""
    p = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("name"))
    return identity.fuzzy_candidates(p, p, itself=False, least=0.0)


@query()
def fuzzy_exact(spark, d):
    """All customers that share a word are candidates, whatever their ids."""
    p = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("name"))
    return identity.fuzzy_candidates(p, p, limit=None, itself=False)


@query("""
WITH m AS (SELECT 'N' || c_nationkey || c_mktsegment AS code, min(c_custkey) AS position FROM customer GROUP BY 1),
t AS (SELECT 'T' || c_custkey % 997 AS tan, 'N' || c_nationkey || c_mktsegment AS code FROM customer WHERE c_custkey % 2 = 0),
tan_of AS (SELECT tan, max_by(m.code, (m.position, m.code)) AS code FROM (SELECT DISTINCT tan, code FROM t) t JOIN m ON m.code = t.code GROUP BY tan),
d AS (SELECT DISTINCT 'T' || c_custkey % 1499 AS tan FROM customer),
map AS (SELECT 'T' || n_nationkey * 50 + 1 AS tan, 'N' || n_nationkey || 'BUILDING' AS code FROM nation)
SELECT d.tan, coalesce(tan_of.code, map.code) AS code, CASE WHEN tan_of.code IS NOT NULL THEN 'CUSTOMER_MASTER' WHEN map.code IS NOT NULL THEN 'SAVED_MAPPING' ELSE 'NONE' END AS method,
  CASE WHEN coalesce(tan_of.code, map.code) IS NULL THEN 'UNMAPPED' ELSE 'EXACT' END AS status
FROM d LEFT JOIN tan_of ON tan_of.tan = d.tan LEFT JOIN (SELECT map.* FROM map JOIN m ON m.code = map.code) map ON map.tan = d.tan""")
def identity_resolution(spark, d):
    """Deductors by the TANs of merged masters, of which the last counts, and by confirmed mappings to codes that exist."""
    c, n = load(spark, d, "customer"), load(spark, d, "nation")
    rows = c.select(
        F.concat(F.lit("N"), "c_nationkey", "c_mktsegment").alias("code"), F.concat(F.lit("firm"), "c_custkey").alias("name"), *(F.lit("").alias(x) for x in ("pan", "gstin")),
        F.when(F.col("c_custkey") % 2 == 0, F.array(F.concat(F.lit("T"), F.col("c_custkey") % 997))).otherwise(F.array().cast("array<string>")).alias("tans"), F.array().cast("array<string>").alias("aliases"), F.col("c_custkey").alias("position"),
    )
    masters = identity.merge_masters(rows).join(rows.groupBy("code").agg(F.min("position").alias("position")), "code")
    deductors = c.select(F.concat(F.lit("T"), F.col("c_custkey") % 1499).alias("tan")).distinct().withColumn("name", F.concat(F.lit("deductor"), "tan"))
    mappings = n.select(F.concat(F.lit("T"), F.col("n_nationkey") * 50 + 1).alias("tan"), F.concat(F.lit("N"), "n_nationkey", F.lit("BUILDING")).alias("code"))
    return identity.resolve(deductors, masters, mappings).select("tan", "code", "method", "status")


@query(_with(BOOKS_SQL) + """
SELECT code, name, source FROM (SELECT c_custkey AS code, c_name AS name, 'MASTER' AS source FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT customer, min(c_name), 'BOOKS' FROM books JOIN customer ON c_custkey = customer WHERE customer % 2 != 0 GROUP BY customer)""")
def customers_except_master(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"))
    return identity.customers_beyond(books(spark, d).select(F.col("customer").alias("code")).join(c, "code"), c.filter("code % 2 = 0"))


@query("""
SELECT c_nationkey AS code, min_by(c_name, c_custkey) AS name, min_by(CASE WHEN c_custkey % 5 != 0 THEN c_mktsegment END, CASE WHEN c_custkey % 5 != 0 THEN c_custkey END) AS pan,
  array_to_string(list_sort(list_distinct(list(c_mktsegment))), ',') AS aliases FROM customer GROUP BY 1""")
def merged_masters(spark, d):
    c = load(spark, d, "customer")
    rows = c.select(
        F.col("c_nationkey").alias("code"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).otherwise("").alias("pan"), F.lit("").alias("gstin"),
        F.array().cast("array<string>").alias("tans"), F.array("c_mktsegment").alias("aliases"), F.col("c_custkey").alias("position"),
    )
    return identity.merge_masters(rows).select("code", "name", "pan", F.array_join("aliases", ",").alias("aliases"))


# -- matching -----------------------------------------------------------------------------------------------------

_TOL = "abs(b.amount - s.amount) <= greatest(10::DECIMAL(18,2), abs(b.amount) * 0.01::DECIMAL(3,2))"


@query(_with(BOOKS_SQL, STATEMENTS_SQL) + f"SELECT b.id AS book_id, s.id AS statement_id, (b.amount - s.amount)::DECIMAL(18,2) AS difference FROM books b JOIN stmts s ON b.customer = s.customer AND b.fy = s.fy AND b.quarter = s.quarter AND {_TOL}", decimals="difference")
def exact_same_quarter_candidates(spark, d):
    return matching.tolerance_candidates(books(spark, d), statements(spark, d))


@query(_with(BOOKS_SQL, STATEMENTS_SQL) + f"SELECT b.id AS book_id, s.id AS statement_id, (b.amount - s.amount)::DECIMAL(18,2) AS difference FROM books b JOIN stmts s ON b.customer = s.customer AND b.fy = s.fy AND b.quarter != s.quarter AND {_TOL}", decimals="difference")
def outside_quarter_candidates(spark, d):
    return matching.tolerance_candidates(books(spark, d), statements(spark, d), same_quarter=False)


@query(_with(BOOKS_SQL) + "SELECT a.id AS id, b.id AS r_id FROM books a JOIN books b ON a.section = b.section AND a.fy = b.fy AND a.id < b.id AND abs(a.amount - b.amount) <= 25")
def bucketed_range_join(spark, d):
    rows = books(spark, d).select("id", "section", "fy", "amount")
    return matching.range_join(rows, rows, ["section", "fy"], "amount", 25).filter("id < r_id").select("id", "r_id")


@query(_with(BOOKS_SQL, STATEMENTS_SQL) + """
SELECT book_id, statement_id, difference FROM (SELECT b.id AS book_id, s.id AS statement_id, abs(b.amount - s.amount)::DECIMAL(18,2) AS difference,
  row_number() OVER (PARTITION BY b.id ORDER BY abs(b.amount - s.amount), s.id) AS r FROM books b JOIN stmts s ON b.customer = s.customer AND b.fy = s.fy) WHERE r = 1""", decimals="difference")
def nearest_amount(spark, d):
    return matching.nearest(books(spark, d), statements(spark, d))


@query(_with(BOOKS_SQL, STATEMENTS_SQL) + """,
b AS (SELECT customer, fy, sum(amount)::DECIMAL(18,2) AS book_total, count(*)::BIGINT AS book_rows FROM books GROUP BY 1, 2),
s AS (SELECT customer, fy, sum(amount)::DECIMAL(18,2) AS statement_total, count(*)::BIGINT AS statement_rows FROM stmts GROUP BY 1, 2)
SELECT b.customer, b.fy, book_total, book_rows, statement_total, statement_rows FROM b JOIN s ON b.customer = s.customer AND b.fy = s.fy
WHERE abs(book_total - statement_total) <= greatest(10::DECIMAL(18,2), abs(book_total) * 0.01::DECIMAL(3,2)) AND book_rows + statement_rows > 2""", decimals="book_total statement_total")
def scope_aggregate_match(spark, d):
    return matching.scope_totals(books(spark, d), statements(spark, d), ["customer", "fy"])


@query()
def greedy_match(spark, d):
    return greedy.match(books(spark, d), statements(spark, d))


@query(decimals="difference")
def full_reconciliation(spark, d):
    b = books(spark, d).join(load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("document")), "id")
    s = statements(spark, d).withColumn("deposited", F.when(F.col("section") == "A", F.col("amount") - 8).when(F.col("section") != "R", F.col("amount")))
    return reconcile.full_reconciliation(b, s)


@query(_with(STATEMENTS_SQL, RULES_SQL) + f""", v AS (SELECT s.id, s.tan, s.tax, s.amount, max_by(rule_id, version) AS rule_id, max_by(rate, version) AS rate FROM stmts s LEFT JOIN rules ON {_IN_FORCE} GROUP BY ALL),
e AS (SELECT *, round((amount * rate)::DECIMAL(30,4) * 0.01::DECIMAL(3,2), 2)::DECIMAL(18,2) AS expected FROM v)
SELECT id, tan, rule_id, expected, tax AS deducted, CASE WHEN expected IS NULL THEN 'NOT_DETERMINABLE' WHEN abs(expected - tax) <= 10 THEN 'CONSISTENT_WITH_CONFIGURED_RULE' ELSE 'TDS_DIFFERENCE' END AS status FROM e""", decimals="expected deducted")
def statement_only_analysis(spark, d):
    return reconcile.statement_only(statements(spark, d), rule_table(spark))


@query(_with(STATEMENTS_SQL) + """
SELECT customer, fy, CASE WHEN bool_or(status != 'F') THEN 'NOT_CLAIMABLE' WHEN bool_or(section = 'R') OR sum(CASE WHEN section = 'A' THEN tax - 8 ELSE tax END) + 10 < sum(tax) THEN 'NOT_CLAIMABLE' ELSE 'CLAIMABLE' END AS claimability
FROM stmts GROUP BY 1, 2""")
def claimability(spark, d):
    rows = statements(spark, d).withColumn("deposited", F.when(F.col("section") == "A", F.col("tax") - 8).when(F.col("section") != "R", F.col("tax")))
    return rows.groupBy("customer", "fy").agg(matching.claimability(F.col("status"), F.col("tax"), F.col("deposited")).alias("claimability"))


# -- relationships ------------------------------------------------------------------------------------------------


@query("""
WITH x AS (SELECT c_custkey AS id, c_nationkey * 100000 + (c_acctbal::BIGINT % 97) AS pan, c_mktsegment || (c_custkey % 200) AS name FROM customer),
y AS (SELECT s_suppkey AS id, s_nationkey * 100000 + (s_acctbal::BIGINT % 97) AS pan, (CASE s_suppkey % 2 WHEN 0 THEN 'BUILDING' ELSE 'MACHINERY' END) || (s_suppkey % 200) AS name FROM supplier),
p AS (SELECT x.id AS left_id, y.id AS right_id, 0 AS t, 'PAN' AS e FROM x JOIN y ON x.pan = y.pan UNION ALL SELECT x.id, y.id, 1, 'NAME' FROM x JOIN y ON x.name = y.name)
SELECT left_id, right_id, min_by(e, t) AS evidence FROM p GROUP BY 1, 2""")
def sales_tds_evidence(spark, d):
    c, s = load(spark, d, "customer"), load(spark, d, "supplier")
    whole = lambda v: F.rint(v).cast("long") % 97  # noqa: E731  # halves to even, as SQL casts a double
    x = c.select(F.col("c_custkey").alias("id"), (F.col("c_nationkey").cast("long") * 100000 + whole(F.col("c_acctbal"))).alias("pan"), F.concat("c_mktsegment", (F.col("c_custkey") % 200).cast("string")).alias("name"))
    y = s.select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey").cast("long") * 100000 + whole(F.col("s_acctbal"))).alias("pan"), F.concat(F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("MACHINERY"), (F.col("s_suppkey") % 200).cast("string")).alias("name"))
    return relationship.evidence(x, y, [("PAN", "pan", "pan"), ("NAME", "name", "name")])


@query(_with(BOOKS_SQL, STATEMENTS_SQL) + """, p AS (SELECT s.id AS statement_id, b.id AS sale_id, count(*) OVER (PARTITION BY s.id) AS n FROM stmts s JOIN books b ON b.customer = s.customer AND b.fy = s.fy)
SELECT statement_id, sale_id FROM p WHERE n = 1""")
def unique_assignment(spark, d):
    s, b = statements(spark, d).select(F.col("id").alias("statement_id"), "customer", "fy"), books(spark, d).select(F.col("id").alias("sale_id"), "customer", "fy")
    return relationship.unique_assignment(s.join(b, ["customer", "fy"]).select("statement_id", "sale_id"), "statement_id", "sale_id")


_NEAR = "abs(s.amount - b.amount) <= 10 OR abs(s.amount - b.amount) <= greatest(abs(s.amount), abs(b.amount), 1::DECIMAL(18,2)) * 0.01::DECIMAL(3,2)"


@query(_with(BOOKS_SQL, STATEMENTS_SQL) + f""", p AS (SELECT s.id AS sid, b.id AS bid, row_number() OVER (PARTITION BY s.id ORDER BY abs(s.amount - b.amount), abs(s.day - b.day), b.id) AS rank,
  count(*) OVER (PARTITION BY s.id) > 1 OR count(*) OVER (PARTITION BY b.id) > 1 AS ambiguous FROM stmts s JOIN books b ON b.customer = s.customer AND abs(s.day - b.day) <= 365 AND ({_NEAR}))
SELECT sid AS statement_id, bid AS sale_id, rank::INTEGER AS rank, ambiguous FROM p WHERE rank <= 50""")
def review_candidates_topk(spark, d):
    return relationship.review_candidates(statements(spark, d).select("id", "day", "amount", "customer"), books(spark, d).select("id", "day", "amount", "customer"), 365, ["customer"])


@query(_with(BOOKS_SQL, STATEMENTS_SQL) + f""", p AS (SELECT s.id AS sid, b.id AS bid, count(*) OVER (PARTITION BY s.id) AS n, count(*) OVER (PARTITION BY b.id) AS m
  FROM stmts s JOIN books b ON b.customer = s.customer AND abs(s.day - b.day) <= 60 AND ({_NEAR})) SELECT sid AS statement_id, bid AS sale_id FROM p WHERE n = 1 AND m = 1""")
def date_window_match(spark, d):
    return relationship.unique_window_matches(statements(spark, d).select("id", "day", "amount", "customer"), books(spark, d).select("id", "day", "amount", "customer"), 60, ["customer"])


@query(_with(BOOKS_SQL, STATEMENTS_SQL) + """, n AS (SELECT b.id AS oid, b.amount AS oamount, s.id, s.amount FROM books b JOIN stmts s ON b.customer = s.customer AND abs(s.day - b.day) <= 60),
p AS (SELECT x.oid, x.id AS i, y.id AS j FROM n x JOIN n y ON x.oid = y.oid AND x.id < y.id AND (abs(x.oamount - x.amount - y.amount) <= 10
  OR abs(x.oamount - x.amount - y.amount) <= greatest(abs(x.oamount), abs(x.amount + y.amount), 1::DECIMAL(18,2)) * 0.01::DECIMAL(3,2)))
SELECT oid AS statement_id, min(i) AS first_sale, min(j) AS second_sale FROM p GROUP BY oid HAVING count(*) = 1""")
def pair_sum_match(spark, d):
    return relationship.pair_sums(books(spark, d).select("id", "day", "amount", "customer"), statements(spark, d).select("id", "day", "amount", "customer"), 60, ["customer"])


@query()
def allocation(spark, d):
    return relationship.allocate(statements(spark, d), books(spark, d), "customer", 60)


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT c_custkey AS a, 1000000 + c_nationkey * 10 + c_custkey % 3 AS b FROM customer),
n AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, reached) AS (SELECT a, a FROM n UNION SELECT r.node, n.b FROM r JOIN n ON n.a = r.reached)
SELECT node, min(reached) AS component FROM r GROUP BY node""")
def connected_components(spark, d):
    from .plans.components import labelled

    c = load(spark, d, "customer")
    edges = c.select(F.col("c_custkey").alias("a"), (1000000 + F.col("c_nationkey").cast("long") * 10 + F.col("c_custkey") % 3).alias("b"))
    return labelled(edges)


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT c_custkey AS a, 1000000 + c_nationkey * 10 + c_custkey % 7 AS b FROM customer),
n AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, reached) AS (SELECT a, a FROM n UNION SELECT r.node, n.b FROM r JOIN n ON n.a = r.reached)
SELECT node, min(reached) AS component FROM r GROUP BY node""")
def connected_components_all(spark, d):
    from .plans.components import labelled

    c = load(spark, d, "customer")
    return labelled(c.select(F.col("c_custkey").alias("a"), (1000000 + F.col("c_nationkey").cast("long") * 10 + F.col("c_custkey") % 7).alias("b")))


@query(_with(BOOKS_SQL, STATEMENTS_SQL) + """,
b AS (SELECT customer, fy, sum(amount) AS amount FROM books GROUP BY 1, 2), s AS (SELECT customer, fy, sum(amount) AS amount, sum(tax) AS tax, count(DISTINCT tan) AS tans FROM stmts GROUP BY 1, 2),
j AS (SELECT s.customer, s.fy, CASE WHEN b.customer IS NULL THEN 'UNMAPPED' WHEN tans > 12 THEN 'CONFLICT' ELSE 'CONFIRMED' END AS identity,
  CASE WHEN b.amount IS NULL THEN 'REVIEW_REQUIRED' WHEN abs(b.amount - s.amount) <= 10 OR abs(b.amount - s.amount) <= greatest(abs(b.amount), abs(s.amount), 1) * 0.01::DECIMAL(3,2) THEN 'MATCHED' ELSE 'DIFFERENCE' END AS amount,
  CASE WHEN tax > 10000 THEN 'DIFFERENCE' ELSE 'MATCHED' END AS tax FROM s LEFT JOIN b ON b.customer = s.customer AND b.fy = s.fy)
SELECT customer, fy, CASE WHEN identity = 'CONFLICT' THEN 'IDENTITY_CONFLICT' WHEN identity != 'CONFIRMED' THEN 'IDENTITY_REVIEW_REQUIRED' WHEN amount = 'MATCHED' AND tax = 'MATCHED' THEN 'FULLY_RECONCILED'
  WHEN amount = 'DIFFERENCE' AND tax = 'DIFFERENCE' THEN 'COMBINED_EXCEPTION' WHEN amount = 'DIFFERENCE' THEN 'AMOUNT_EXCEPTION' WHEN tax = 'DIFFERENCE' THEN 'TDS_EXCEPTION' ELSE 'REVIEW_REQUIRED' END AS overall FROM j""")
def relationship_overall(spark, d):
    b = books(spark, d).groupBy("customer", "fy").agg(F.sum("amount").cast(MONEY).alias("booked"))
    s = statements(spark, d).groupBy("customer", "fy").agg(F.sum("amount").cast(MONEY).alias("stated"), F.sum("tax").alias("tax"), F.countDistinct("tan").alias("tans"))
    j = s.join(b, ["customer", "fy"], "left")
    who = F.when(F.col("booked").isNull(), "UNMAPPED").when(F.col("tans") > 12, "CONFLICT").otherwise("CONFIRMED")
    amount = F.when(F.col("booked").isNull(), "REVIEW_REQUIRED").when(amounts.within_mutual_tolerance(F.col("booked"), F.col("stated")), "MATCHED").otherwise("DIFFERENCE")
    return j.select("customer", "fy", relationship.overall_status(who, amount, F.when(F.col("tax") > 10000, "DIFFERENCE").otherwise("MATCHED")).alias("overall"))


# -- reports and search -------------------------------------------------------------------------------------------

_RESULTS_SQL = f"""results AS (SELECT b.id, b.customer, b.section, b.fy, b.quarter AS book_quarter, s.quarter AS statement_quarter, b.amount AS book_amount, s.amount AS statement_amount,
  CASE WHEN s.id IS NULL THEN 'MISSING_IN_26AS' WHEN {_TOL} THEN 'MATCHED_CLAIMABLE' ELSE 'AMOUNT_MISMATCH' END AS result,
  CASE WHEN s.id IS NULL THEN 'HIGH' WHEN b.amount = s.amount THEN 'NONE' WHEN abs(b.amount - s.amount) * 100 > abs(b.amount) * 10 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  (b.amount - coalesce(s.amount, 0))::DECIMAL(18,2) AS difference FROM books b LEFT JOIN stmts s ON s.id = b.id * 10 + 1)"""


def _results(spark: SparkSession, d: str) -> DataFrame:
    b = books(spark, d).select("id", "customer", "section", "fy", F.col("quarter").alias("book_quarter"), F.col("amount").alias("book_amount"))
    s = statements(spark, d).select(F.col("id").alias("_s"), F.col("quarter").alias("statement_quarter"), F.col("amount").alias("statement_amount"))
    j = b.join(s, F.col("_s") == F.col("id") * 10 + 1, "left")
    missing = F.col("_s").isNull()
    result = F.when(missing, "MISSING_IN_26AS").when(amounts.within_tolerance(F.col("book_amount"), F.col("statement_amount")), "MATCHED_CLAIMABLE").otherwise("AMOUNT_MISMATCH")
    severity = F.when(missing, "HIGH").otherwise(matching.severity(F.col("book_amount") - F.col("statement_amount"), F.col("book_amount")))
    gap = (F.col("book_amount") - F.coalesce("statement_amount", F.lit(0).cast(MONEY))).cast(MONEY)
    return j.withColumns({"result": result, "severity": severity, "difference": gap}).drop("_s")


@query(_with(BOOKS_SQL, STATEMENTS_SQL, _RESULTS_SQL) + "SELECT id, result, severity, difference FROM results", decimals="difference")
def result_classes(spark, d):
    return _results(spark, d).select("id", "result", "severity", "difference")


@query(_with(BOOKS_SQL, STATEMENTS_SQL, _RESULTS_SQL) + "SELECT coalesce(book_quarter, statement_quarter, '—') AS quarter, coalesce(sum(book_amount), 0)::DECIMAL(18,2) AS books, coalesce(sum(statement_amount), 0)::DECIMAL(18,2) AS statement, count(*)::BIGINT AS rows FROM results GROUP BY 1", decimals="books statement")
def by_quarter(spark, d):
    return reports.by_quarter(_results(spark, d))


@query(_with(BOOKS_SQL, STATEMENTS_SQL, _RESULTS_SQL) + """SELECT customer, count(*) FILTER (WHERE result = 'MATCHED_CLAIMABLE')::BIGINT AS matched_claimable, count(*) FILTER (WHERE result = 'AMOUNT_MISMATCH')::BIGINT AS amount_mismatch,
  count(*) FILTER (WHERE result = 'MISSING_IN_26AS')::BIGINT AS missing_in_26as FROM results GROUP BY 1""")
def customer_summary(spark, d):
    return reports.status_counts(_results(spark, d), "result", ["MATCHED_CLAIMABLE", "AMOUNT_MISMATCH", "MISSING_IN_26AS"], ["customer"])


@query(_with(STATEMENTS_SQL) + "SELECT fy, coalesce(sum(m), 0)::DECIMAL(18,2) AS total, count(*)::BIGINT AS groups FROM (SELECT fy, customer, max(amount) AS m FROM stmts GROUP BY 1, 2) GROUP BY fy", decimals="total")
def group_once_totals(spark, d):
    return reports.once_per_group(statements(spark, d), "customer", "amount", ["fy"])


@query(_with(STATEMENTS_SQL) + """, g AS (SELECT tan, status AS name, count(*)::BIGINT AS records, sum((amount * 0.04::DECIMAL(3,2))::DECIMAL(18,2))::DECIMAL(18,2) AS expected, sum(tax)::DECIMAL(18,2) AS deducted, count(DISTINCT section)::BIGINT AS sections FROM stmts GROUP BY 1, 2)
SELECT *, (deducted - expected)::DECIMAL(18,2) AS difference, CASE WHEN abs(deducted - expected) <= 10 THEN 'CONSISTENT_WITH_CONFIGURED_RULE' ELSE 'TDS_DIFFERENCE' END AS status FROM g""", decimals="expected deducted difference")
def deductor_overview(spark, d):
    rows = statements(spark, d).withColumns({"name": F.col("status"), "deducted": F.col("tax"), "expected": (F.col("amount") * F.lit("0.04").cast("decimal(3,2)")).cast(MONEY)})
    return reports.deductor_overview(rows)


@query(_with(BOOKS_SQL, STATEMENTS_SQL, _RESULTS_SQL) + "SELECT facet, value, count(*)::BIGINT AS rows FROM (SELECT 'result' AS facet, result AS value FROM results UNION ALL SELECT 'fy', fy FROM results UNION ALL SELECT 'statement_quarter', statement_quarter FROM results) WHERE value IS NOT NULL GROUP BY 1, 2")
def facets(spark, d):
    return reports.facets(_results(spark, d), ["result", "fy", "statement_quarter"])


@query(_with(BOOKS_SQL, STATEMENTS_SQL, _RESULTS_SQL) + """SELECT id, result, rank::INTEGER AS rank FROM (SELECT id, result, row_number() OVER (PARTITION BY result ORDER BY abs(difference) DESC, id) AS rank FROM results) WHERE rank <= 40""")
def context_slices(spark, d):
    return reports.top_per_category(_results(spark, d), "result", [F.desc(F.abs("difference")), F.col("id")], 40).select("id", "result", "rank")


@query(_with(BOOKS_SQL, STATEMENTS_SQL, _RESULTS_SQL) + "SELECT id, severity, difference FROM results ORDER BY CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 3 END, abs(difference) DESC, id LIMIT 8", decimals="difference")
def attention_topk(spark, d):
    return search.ranked_exceptions(_results(spark, d), "severity", "difference", 8).select("id", "severity", "difference")


@query(_with(BOOKS_SQL, STATEMENTS_SQL, _RESULTS_SQL) + """SELECT id, result, difference FROM results WHERE result IN ('AMOUNT_MISMATCH', 'MISSING_IN_26AS') AND (coalesce(book_quarter = 'Q2', FALSE) OR coalesce(statement_quarter = 'Q2', FALSE))
  AND section NOT IN ('1-URGENT') ORDER BY difference DESC, id LIMIT 50 OFFSET 50""", decimals="difference")
def results_filter_sort_page(spark, d):
    rows = search.matching(_results(spark, d), {"result": "AMOUNT_MISMATCH, MISSING_IN_26AS", "quarter": "Q2"}, {"section": "1-URGENT"}, {"quarter": ("book_quarter", "statement_quarter")})
    return search.page(rows, [F.desc("difference"), F.col("id")], 2, 50).select("id", "result", "difference")


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license.') OR contains(lower(source), 'license.')")
def search_contains(spark, d):
    return search.containing(load(spark, d, "documents"), "LICENSE.", ["text", "source"]).select("doc_id", "source")


@query(_with(BOOKS_SQL, STATEMENTS_SQL, _RESULTS_SQL) + "SELECT id, severity, CASE WHEN id % 4 = 0 THEN 'IN_REVIEW' WHEN id % 4 = 1 THEN 'RESOLVED' ELSE 'OPEN' END AS workflow_state FROM results WHERE severity = 'HIGH'")
def exception_states(spark, d):
    states = books(spark, d).filter("id % 4 < 2").select("id", F.when(F.col("id") % 4 == 0, "IN_REVIEW").otherwise("RESOLVED").alias("workflow_state"))
    return search.with_state(_results(spark, d).filter("severity = 'HIGH'").select("id", "severity"), states, "id")


@query(_with(BOOKS_SQL) + "SELECT customer, array_to_string(list_reverse_sort(list_distinct(list(fy))), ',') AS years, count(*)::BIGINT AS runs FROM books GROUP BY 1")
def client_catalogue(spark, d):
    return books(spark, d).groupBy("customer").agg(F.array_join(F.sort_array(F.collect_set("fy"), False), ",").alias("years"), F.count("*").alias("runs"))


@query(_with(BOOKS_SQL) + "SELECT sum(amount)::DECIMAL(18,2) AS selected_total, sum(amount) FILTER (WHERE id % 7 != 0)::DECIMAL(18,2) AS parts_total, sum(amount) = sum(amount) FILTER (WHERE id % 7 != 0) AS conserved FROM books", decimals="selected_total parts_total")
def dashboard_controls(spark, d):
    rows = books(spark, d).select("id", "amount")
    parts = rows.filter("id % 7 != 0")
    return reports.conservation(rows, parts.union(parts.filter("id % 2 = 0")), "id", "amount")


# -- sinks and streams --------------------------------------------------------------------------------------------


@query(f"WITH {RULES_SQL} SELECT rule_id, CASE WHEN rule_id = 1 THEN 'KEEP' WHEN rule_id = 2 THEN 'CONFLICT' WHEN rule_id = 3 THEN 'UPDATE_TRACEABILITY' ELSE 'SKIP' END AS action FROM rules UNION ALL SELECT 9, 'INSERT'")
def catalog_import(spark, d):
    now = rule_table(spark)
    new = now.filter("rule_id > 1").withColumn("rate", F.when(F.col("rule_id") == 2, F.col("rate") + 1).otherwise(F.col("rate")).cast(MONEY))
    new = new.withColumn("version", F.when(F.col("rule_id") == 3, F.col("version") + 1).otherwise(F.col("version")))
    new = new.unionByName(now.filter("rule_id = 1").withColumn("rule_id", F.lit(9)))
    return sinks.catalog_actions(now, new, ["rule_id"], ["rate", "priority"], ["version"])


@query(_with(BOOKS_SQL) + "SELECT id, CASE WHEN id % 5 = 0 THEN 'CHANGED' ELSE section END AS section FROM books")
def upserted_rows(spark, d):
    rows = books(spark, d).select("id", "section")
    return sinks.upserted(rows, rows.filter("id % 5 = 0").withColumn("section", F.lit("CHANGED")), ["id"])


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*)::BIGINT AS events, sum(value::DECIMAL(18,4))::DECIMAL(28,4) AS total FROM events GROUP BY 1, 2", decimals="total")
def event_windows(spark, d):
    return ingest.windowed_totals(load(spark, d, "events"))


@query("SELECT event_type, count(*)::BIGINT AS events, count(DISTINCT user_id)::BIGINT AS users, sum(regexp_extract(props, '(\\d+)', 1)::BIGINT)::BIGINT AS k FROM events GROUP BY 1")
def event_properties(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.sum(k).alias("k"))


@query(_with(STATEMENTS_SQL) + "SELECT customer, id, row_number() OVER (PARTITION BY customer ORDER BY day, id)::INTEGER AS seq, (tax - coalesce(lag(tax) OVER (PARTITION BY customer ORDER BY day, id), 0))::DECIMAL(19,2) AS step FROM stmts", decimals="step")
def sequence_and_gap(spark, d):
    w = Window.partitionBy("customer").orderBy("day", "id")
    return statements(spark, d).select("customer", "id", F.row_number().over(w).alias("seq"), (F.col("tax") - F.coalesce(F.lag("tax").over(w), F.lit(0).cast(MONEY))).cast("decimal(19,2)").alias("step"))


from . import queries_evidence, queries_governance, queries_ledger, queries_sources  # noqa: E402, F401  - register their queries
