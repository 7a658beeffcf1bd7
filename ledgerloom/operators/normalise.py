"""Raw exports as canonical rows.

Every input has the columns of its kind in ``sources.schema`` as text, and ``row_no``.  What a source does not say stays
null: no amount, status or year is filled in that no column or date supports.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.amounts import MONEY, parse_amount
from ..functions.dates import financial_year, is_ambiguous_date, normalize_fy, parse_date, quarter, strict_fy
from ..functions.text import blank_to_null, core_name, first_value, normalize_code, normalize_name, pan_status, split_list

# What marks a row as a balance or total, and as a total of a payment ledger.
BALANCES = ("OPENING BALANCE", "CLOSING BALANCE", "GRAND TOTAL", "SUB TOTAL", "SUBTOTAL")
YES = ("Y", "YES", "TRUE", "1")
LEDGER_DATES = ("transaction_date", "credit_date", "payment_date")
LEDGER_AMOUNTS = ("amount", "tds_deducted")
#: Row numbers that one task numbers together.
STRIDE = 1 << 16


def positions(rows: DataFrame, row_no: str = "row_no", out: str = "position", wanted: Column | None = None) -> DataFrame:
    """rows with their place from 1 in the order of ``row_no``, counted by ranges of row numbers, so no task orders all;
    rows without a number come last.  Of several files' rows, which share numbers, a range holds no more.

    wanted: which rows' places are asked for; where no row's is, none is counted.
    """
    seen = rows.agg(F.count("*").alias("n"), F.max(row_no).alias("top"), F.bool_or(F.lit(True) if wanted is None else wanted).alias("wanted")).first()
    if not seen["wanted"]:
        return rows.withColumn(out, F.lit(None).cast("long"))
    stride = max(1, min(STRIDE, STRIDE * (int(seen["top"] or 0) + 1) // seen["n"]))
    part = F.coalesce(F.floor(F.col(row_no) / stride), F.lit(1 << 62))
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    starts = counts.select("_part", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(row_no))
    return rows.withColumn("_part", part).join(starts, "_part").withColumn(out, F.col("_before") + own).drop("_part", "_before")


def provenance(given: Column, prefix: str, position: Column, digits: int = 0) -> tuple[Column, Column]:
    """(the source's reference, else one made of the position, and which of the two it is)."""
    number = F.lpad(position.cast("string"), F.greatest(F.length(position.cast("string")), F.lit(digits)), F.lit("0"))
    own = blank_to_null(given)
    return F.coalesce(own, F.concat(F.lit(f"SYS-{prefix}-"), F.coalesce(number, F.lit("UNKNOWN")))), F.when(own.isNotNull(), "SOURCE_PROVIDED").otherwise("SYSTEM_GENERATED")


def _dated(day: Column, given_year: Column) -> dict[str, Column]:
    explicit = blank_to_null(normalize_fy(given_year))
    return {
        "financial_year": F.coalesce(explicit, financial_year(day)),
        "financial_year_source": F.when(explicit.isNotNull(), "EXPLICIT").when(day.isNotNull(), "DERIVED_FROM_DATE"),
        "quarter": quarter(day),
    }


def _code(name: str) -> Column:
    return F.nullif(normalize_code(F.col(name)), F.lit(""))


def books(raw: DataFrame) -> DataFrame:
    given = first_value(F.col("transaction_id"), F.col("document_number"))
    rows = positions(raw, wanted=given.isNull()).withColumn("_day", parse_date(F.col("document_date")))
    reference, source = provenance(given, "BOOK", F.col("position"), 4)
    return rows.select(
        "row_no", reference.alias("transaction_id"), source.alias("transaction_id_source"), "customer_name", core_name(F.col("customer_name")).alias("customer_name_norm"),
        *(_code(c).alias(c) for c in ("customer_code", "party_pan", "party_gstin", "section")), "document_number", F.col("_day").alias("document_date"),
        *(parse_amount(F.col(c)).alias(c) for c in ("taxable_value", "gst_value", "tds_expected", "tds_base_amount", "debit_amount", "credit_amount")),
        F.coalesce(F.upper(F.trim("advance")).isin(*YES), F.lit(False)).alias("advance"), *(c.alias(n) for n, c in _dated(F.col("_day"), F.col("financial_year")).items()),
        "source_ledger", "voucher_type", "narration", "source_period",
    )


def accounting_semantics(rows: DataFrame) -> DataFrame:
    """Which book rows move a tax receivable: the ledger's own name must say so, and only its debits are amounts."""
    ledger = F.coalesce(normalize_name(F.col("source_ledger")), F.lit(""))
    context = F.concat_ws(" ", ledger, normalize_name(F.col("voucher_type")), normalize_name(F.col("narration")))
    balance = reduce(lambda x, y: x | y, (context.contains(b) for b in BALANCES))
    receivable = ledger.contains("TDS") & ledger.contains("RECEIVABLE") & ~balance
    debit, credit = F.coalesce(F.col("debit_amount") > 0, F.lit(False)), F.coalesce(F.col("credit_amount") > 0, F.lit(False))
    return rows.withColumns({
        "accounting_role": F.when(receivable, "TDS_RECEIVABLE").otherwise("NOT_DETERMINED"),
        "accounting_direction": F.when(receivable, F.when(debit, "DEBIT").when(credit, "CREDIT").otherwise("UNDETERMINED")),
        "tds_expected": F.when(receivable & debit, F.col("debit_amount")).otherwise(F.col("tds_expected")),
        "matching_eligible": receivable & debit,
        "validation_state": F.when(~receivable, "EXCLUDED_NON_TDS_ACCOUNTING_ROW").when(debit, "AVAILABLE").when(credit, "ACCOUNTING_ADJUSTMENT_REVIEW").otherwise("ACCOUNTING_ROLE_REVIEW_REQUIRED"),
    })


def semantics_summary(rows: DataFrame) -> DataFrame:
    state = F.col("validation_state")
    return rows.agg(
        F.count("*").alias("total_source_rows"), F.count_if(F.col("accounting_role") == "TDS_RECEIVABLE").alias("tds_receivable_rows"), F.count_if("matching_eligible").alias("tds_receivable_debit_rows"),
        F.count_if(state == "ACCOUNTING_ADJUSTMENT_REVIEW").alias("tds_receivable_credit_rows"), F.count_if(state == "EXCLUDED_NON_TDS_ACCOUNTING_ROW").alias("non_tds_rows_excluded"),
        F.count_if(state.isin("ACCOUNTING_ADJUSTMENT_REVIEW", "ACCOUNTING_ROLE_REVIEW_REQUIRED")).alias("accounting_role_review_rows"),
    )


def statement(raw: DataFrame) -> DataFrame:
    """A missing deposit stays missing and is flagged; a missing status counts as F."""
    rows = positions(raw, wanted=blank_to_null(F.col("statement_id")).isNull()).withColumn("_day", parse_date(F.col("transaction_date")))
    reference, source = provenance(F.col("statement_id"), "26AS", F.col("position"), 4)
    deposited = parse_amount(F.col("tds_deposited"))
    return rows.select(
        "row_no", reference.alias("statement_id"), source.alias("statement_id_source"), "deductor_name", core_name(F.col("deductor_name")).alias("deductor_name_norm"),
        *(_code(c).alias(c) for c in ("tan", "deductor_pan", "section")), F.col("_day").alias("transaction_date"), parse_amount(F.col("tax_deducted")).alias("tax_deducted"),
        deposited.alias("tds_deposited"), deposited.isNull().alias("deposited_not_reported"), F.coalesce(F.substring(blank_to_null(F.upper(F.col("status"))), 1, 1), F.lit("F")).alias("status"),
        parse_amount(F.col("amount_paid")).alias("amount_paid"), *(c.alias(n) for n, c in _dated(F.col("_day"), F.col("financial_year")).items()),
    )


def customers(raw: DataFrame) -> DataFrame:
    return raw.select(
        "row_no", *(_code(c).alias(c) for c in ("customer_code", "pan", "gstin")), "customer_name", core_name(F.col("customer_name")).alias("customer_name_norm"),
        F.transform(F.coalesce(split_list(F.col("tan")), F.array().cast("array<string>")), normalize_code).alias("tans"),
        F.coalesce(split_list(F.col("aliases")), F.array().cast("array<string>")).alias("aliases"), F.lit("customer_master").alias("source"),
    )


def receivable(raw: DataFrame) -> DataFrame:
    rows = positions(raw).withColumn("_day", parse_date(F.col("transaction_date")))
    reference, source = provenance(F.col("tds_transaction_id"), "TDS", F.col("position"), 4)
    return rows.select(
        "row_no", reference.alias("tds_transaction_id"), source.alias("tds_transaction_id_source"), "party_name", core_name(F.col("party_name")).alias("party_name_norm"),
        *(_code(c).alias(c) for c in ("party_pan", "party_gstin", "tan", "section")), F.col("_day").alias("transaction_date"), "reference",
        *(parse_amount(F.col(c)).alias(c) for c in ("tds_expected", "tds_base_amount")), *(c.alias(n) for n, c in _dated(F.col("_day"), F.col("financial_year")).items()),
    )


def sales(raw: DataFrame) -> DataFrame:
    """The year comes from its own column, a period that is a year, a period's date or the invoice's, in this order; of
    several amounts none is chosen."""
    period = F.col("period")
    rows = positions(raw).withColumn("_day", parse_date(F.col("invoice_date")))
    period_fy = F.when(F.trim(period).rlike(r"^(?i)(FY\s*)?\d{4}\s*[-/]\s*\d{2,4}$"), normalize_fy(period))
    period_day = F.when(period_fy.isNull(), parse_date(period))
    amount, value, taxable = (parse_amount(F.col(c)) for c in ("sales_amount", "invoice_value", "taxable_amount"))
    reference, source = provenance(F.col("sales_transaction_id"), "SALES", F.col("position"), 4)
    return rows.select(
        "row_no", reference.alias("sales_transaction_id"), source.alias("sales_transaction_id_source"), "customer_name", core_name(F.col("customer_name")).alias("customer_name_norm"),
        *(_code(c).alias(c) for c in ("customer_pan", "customer_gstin")), "invoice_number", F.col("_day").alias("invoice_date"), amount.alias("sales_amount"),
        F.when(amount.isNotNull(), "SOURCE_SPECIFIC_AMOUNT").when(value.isNotNull() | taxable.isNotNull(), "REVIEW_REQUIRED").otherwise("NOT_DETERMINABLE").alias("sales_amount_basis"),
        value.alias("invoice_value"), taxable.alias("taxable_amount"), blank_to_null(period).alias("period"), blank_to_null(F.col("state")).alias("state"), "reference",
        F.coalesce(blank_to_null(normalize_fy(F.col("financial_year"))), period_fy, financial_year(period_day), financial_year(F.col("_day"))).alias("financial_year"),
        F.when(period_fy.isNotNull(), "SOURCE_COLUMN").when(period_day.isNotNull(), "PERIOD_DERIVED_DATE").when(F.col("_day").isNotNull(), "INVOICE_DATE").alias("financial_year_source"),
        quarter(F.col("_day")).alias("quarter"),
    )


def assignment_year(rows: DataFrame, assignment: str | None, metadata: str | None) -> DataFrame:
    """The assignment's year, else the file's own, on all rows of a file none of whose rows has one."""
    if rows.filter("financial_year is not null").limit(1).count():
        return rows
    return rows.withColumn("financial_year", F.lit(assignment or metadata).cast("string"))


def payment_ledger(raw: DataFrame) -> DataFrame:
    """Payment rows with their issues and status: VALID, WARNING, REVIEW_REQUIRED or INVALID.

    Of debit and credit the one side that is not zero is the amount; both are never added.  Rows that repeat party,
    reference, day and amount, all of them given, are marked for review.
    """
    given = lambda c: blank_to_null(F.col(c))
    party = first_value(F.col("deductee_name"), F.col("source_payee_name"), F.col("source_counterparty_description"))
    debit, credit = parse_amount(F.col("source_debit_amount")), parse_amount(F.col("source_credit_amount"))
    one, other = F.nullif(debit, F.lit(0).cast(MONEY)), F.nullif(credit, F.lit(0).cast(MONEY))
    both = one.isNotNull() & other.isNotNull()
    side = F.when(both, F.lit(None)).otherwise(F.coalesce(one, other, F.when((debit == 0) & (credit == 0), debit)))
    day = {c: F.when(~is_ambiguous_date(F.col(c)), parse_date(F.col(c))) for c in LEDGER_DATES}
    first_day = F.coalesce(*day.values())
    supplied = strict_fy(F.col("financial_year"))
    reference, source = provenance(first_value(F.col("transaction_id"), F.col("invoice_number")), "TDS", F.col("row_no"))
    issue = lambda cond, text: F.when(F.coalesce(cond, F.lit(False)), F.lit(text))
    amount = F.coalesce(parse_amount(given("amount")), side)
    identity = party.isNotNull() | given("vendor_code").isNotNull() | given("deductee_pan").isNotNull()
    fy = F.coalesce(supplied, financial_year(first_day))
    issues = F.array_compact(F.array(
        *(issue(given(c).isNotNull() & parse_amount(given(c)).isNull(), f"{c} is not a usable amount") for c in LEDGER_AMOUNTS),
        issue(given("amount").isNull() & both, "debit and credit are both populated"),
        *(issue(given(c).isNotNull() & day[c].isNull(), F"{c} is ambiguous or unusable") for c in LEDGER_DATES),
        issue(given("financial_year").isNotNull() & supplied.isNull(), "financial year is invalid"),
        issue(fy.isNull(), "financial year cannot be determined"),
        issue(~identity, "party is not provided"),
        issue(amount.isNull(), "amount is not provided or unusable"),
    ))
    rows = raw.select(
        "row_no", reference.alias("transaction_id"), source.alias("transaction_id_source"), party.alias("deductee_name"), given("vendor_code").alias("vendor_code"),
        given("deductee_pan").alias("deductee_pan"), pan_status(F.col("deductee_pan")).alias("pan_status"), given("invoice_number").alias("invoice_number"),
        *(day[c].alias(c) for c in LEDGER_DATES), amount.cast(MONEY).alias("amount"), parse_amount(given("tds_deducted")).alias("tds_deducted"), fy.alias("financial_year"),
        quarter(first_day).alias("quarter"), identity.alias("_identity"), issues.alias("issues"), is_ignored(F.col("description")).alias("ignored"),
    )
    key = [F.upper(F.coalesce("deductee_name", "vendor_code")), F.upper(F.coalesce("invoice_number", "transaction_id")), F.coalesce(*LEDGER_DATES), F.coalesce("amount", "tds_deducted")]
    complete = reduce(lambda x, y: x & y, (k.isNotNull() for k in key))
    again = complete & (F.count(F.lit(1)).over(Window.partitionBy(*key)) > 1)
    doubtful = F.exists("issues", lambda i: i.contains("ambiguous") | i.contains("cannot be determined"))
    status = (
        F.when(~F.col("_identity") | F.col("amount").isNull(), "INVALID").when(doubtful | F.col("duplicate_review"), "REVIEW_REQUIRED")
        .when((F.col("pan_status") != "FORMAT_VALID_UNVERIFIED") | (F.size("issues") > 0), "WARNING").otherwise("VALID")
    )
    return rows.withColumn("duplicate_review", again).withColumn("validation_status", status).drop("_identity")


def is_ignored(description: Column) -> Column:
    """A balance or total, not a transaction."""
    return F.coalesce(description.rlike(r"(?i)\b(opening balance|closing balance|grand total|subtotal|total)\b"), F.lit(False))


def ledger_summary(rows: DataFrame) -> DataFrame:
    """Counts by status, what is missing how often, and whether the file can be taken: some rows, and none invalid."""
    state, missing = F.col("validation_status"), ("deductee_name", "vendor_code", "amount", "financial_year", *LEDGER_DATES)
    counts = rows.agg(
        F.count("*").alias("total_rows"), *(F.count_if(state == s).alias(f"{s.lower()}_rows") for s in ("VALID", "WARNING", "REVIEW_REQUIRED", "INVALID")),
        F.count_if("duplicate_review").alias("duplicate_rows"), *(F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in missing),
        *(F.count_if(F.col("pan_status") == s).alias(f"pan_{s.lower()}") for s in ("NOT_PROVIDED", "FORMAT_INVALID", "FORMAT_VALID_UNVERIFIED")),
    )
    return counts.withColumn("can_commit", (F.col("total_rows") > 0) & (F.col("invalid_rows") == 0))
