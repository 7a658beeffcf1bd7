"""Whole workflows: the books against a statement, a statement by itself, and payments through to interest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import MONEY, percent_of
from ..functions.dates import deposit_deadline, governing_law
from ..operators import compliance, duplicates, identity, matching, normalise, rules
from ..operators.matching import Terms
from . import greedy
from .components import kept


def _has(df: DataFrame, name: str, kind: str) -> DataFrame:
    """df with the column, null where the source has none."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def full_reconciliation(books: DataFrame, statements: DataFrame, terms: Terms = Terms()) -> DataFrame:
    """One row for each matched or left record, with the verdict of its whole match.

    books: (id, customer, fy, quarter, day, amount, section), and document and matchable where the source has them;
    statements: (id, tan, customer, fy, quarter, day, amount, section, status), and deposited and matchable.  Columns:
    result, claimability, method, book_id, statement_id, customer, difference, severity, category, group_id.

    A statement row without a customer is IDENTITY_UNMAPPED.  Rows that are not matchable take no part and give no result.
    A match is claimable if all its statement rows are final and what was deducted was reported as deposited.
    """
    b, s = _has(_has(books, "document", "string"), "matchable", "boolean"), _has(_has(statements, "deposited", MONEY), "matchable", "boolean")
    b, s = (df.filter(F.coalesce("matchable", F.lit(True))) for df in (b, s))
    document = F.coalesce(F.nullif(F.col("document").cast("string"), F.lit("")), F.col("id").cast("string"))
    b = kept(duplicates.flag_repeats(b, [F.col("customer"), document, F.col("day"), F.col("amount")], [F.col("id")], "id"))
    s = kept(duplicates.flag_repeats(s, [F.col(c) for c in ("tan", "day", "section", "amount", "deposited", "status")], [F.col("id")], "id"))
    first_b, first_s = b.filter("duplicate_of is null"), s.filter("duplicate_of is null")
    mapped = first_s.filter("customer is not null")
    key = F.coalesce("group_id", F.concat_ws("|", F.col("book_id").cast("string"), F.col("statement_id").cast("string")))
    matches = kept(greedy.match(first_b, mapped, terms).withColumn("_match", key))  # several parts of the result read it
    lines = matches.filter("statement_id is not null").select("_match", "statement_id").distinct()
    lines = lines.join(mapped.select(F.col("id").alias("statement_id"), "status", "amount", "deposited"), "statement_id")
    verdicts = lines.groupBy("_match").agg(
        matching.claimability(F.col("status"), F.col("amount"), F.col("deposited"), terms.absolute).alias("claimability"), F.coalesce(F.sum("amount"), F.lit(0)).cast(MONEY).alias("_total")
    )
    known = matches.join(verdicts, "_match")
    far, gap = F.col("method") == "AMOUNT_MISMATCH", F.col("difference").cast(MONEY)
    base = gap + F.col("_total")
    share = F.when(base != 0, F.abs(F.round((gap * 100).cast("decimal(28,6)") / base.cast("decimal(20,2)"), 2)))
    claimable = F.col("claimability") == "CLAIMABLE"
    result = F.when(far, "AMOUNT_MISMATCH").when(claimable, "MATCHED_CLAIMABLE").otherwise("MATCHED_NOT_CLAIMABLE")
    severity = F.when(far, F.when(share > 10, "HIGH").otherwise("MEDIUM")).when(claimable, "NONE").otherwise("MEDIUM")
    out = known.select(
        result.alias("result"), F.when(far, "NOT_APPLICABLE").otherwise(F.col("claimability")).alias("claimability"), F.when(far, "UNMATCHED").otherwise(F.col("method")).alias("method"),
        "book_id", "statement_id", "customer", gap.alias("difference"), severity.alias("severity"), "group_id",
    )

    def row(df: DataFrame, name: str, severity: str, own: bool) -> DataFrame:
        none = lambda other: F.lit(None).cast(other.schema["id"].dataType)
        difference = (F.col("amount") if own else -F.coalesce(F.col("amount"), F.lit(0))).cast(MONEY)
        return df.select(
            F.lit(name).alias("result"), F.lit("NOT_APPLICABLE").alias("claimability"), F.lit("UNMATCHED").alias("method"), (F.col("id") if own else none(books)).alias("book_id"),
            (none(statements) if own else F.col("id")).alias("statement_id"), "customer", difference.alias("difference"), F.lit(severity).alias("severity"), F.lit(None).cast("string").alias("group_id"),
        )

    parts = [
        row(matching.unmatched(first_b, matches, "book_id"), "MISSING_IN_26AS", "HIGH", True),
        row(matching.unmatched(mapped, matches, "statement_id"), "MISSING_IN_BOOKS", "MEDIUM", False),
        row(first_s.filter("customer is null"), "IDENTITY_UNMAPPED", "HIGH", False),
        row(b.filter("duplicate_of is not null"), "DUPLICATE_BOOK", "LOW", True),
        row(s.filter("duplicate_of is not null"), "DUPLICATE_26AS", "LOW", False),
    ]
    for part in parts:
        out = out.unionByName(part)
    r = F.col("result")
    category = F.when(r == "MATCHED_CLAIMABLE", F.lit(None)).when(r == "IDENTITY_UNMAPPED", "IDENTITY").when(r.startswith("DUPLICATE"), "DUPLICATES").when(r == "MATCHED_NOT_CLAIMABLE", "NOT_CLAIMABLE").otherwise(r)
    return out.withColumn("category", category)


def reconcile_exports(
    book_rows: DataFrame, statement_rows: DataFrame, master_rows: DataFrame, mappings: DataFrame | None = None, aliases: DataFrame | None = None, decisions: DataFrame | None = None,
    terms: Terms = Terms(), limit: int | None = None,
) -> DataFrame:
    """The whole way from raw exports to results: rows as ``tables.read_delimited(..., raw=True)`` gives them.

    Both sides are normalised, ledger rows that move no receivable are set aside, deductors are resolved to customers, and
    only those known for sure, or alone at the top by likeness, are matched; all others are IDENTITY_UNMAPPED.
    """
    b = normalise.books(book_rows)
    if book_rows.filter("source_ledger is not null").limit(1).count():
        b = normalise.accounting_semantics(b)
    else:
        b = b.withColumn("matching_eligible", F.lit(True))
    s, m = kept(normalise.statement(statement_rows)), normalise.customers(master_rows).withColumn("position", F.col("row_no"))
    masters = identity.merge_masters(m.filter("customer_code is not null").select(F.col("customer_code").alias("code"), F.col("customer_name").alias("name"), "pan", "gstin", "tans", "aliases", "position"))
    masters = kept(masters.join(m.groupBy(F.col("customer_code").alias("code")).agg(F.min("position").alias("position")), "code"))
    names = s.groupBy("tan", "deductor_name").agg(F.count("*").alias("n")).groupBy("tan").agg(F.min_by("deductor_name", F.struct(-F.col("n"), "deductor_name")).alias("name"))
    who = kept(identity.resolve(kept(names), masters, mappings, aliases, decisions, limit).filter("status in ('EXACT', 'HIGH_CONFIDENCE')").select("tan", F.col("code").alias("customer")))
    one = lambda c: F.coalesce("customer_code", "customer_name_norm").alias(c)
    dated = F.col("document_date").isNotNull() | F.col("financial_year").isNotNull()
    b = b.select(
        F.col("transaction_id").alias("id"), one("customer"), F.col("financial_year").alias("fy"), "quarter", F.col("document_date").alias("day"), F.col("tds_expected").alias("amount"), "section",
        F.col("document_number").alias("document"), (F.coalesce("matching_eligible", F.lit(False)) & dated & F.col("tds_expected").isNotNull()).alias("matchable"),
    )
    s = s.join(who, "tan", "left").select(
        F.col("statement_id").alias("id"), "tan", "customer", F.col("financial_year").alias("fy"), "quarter", F.col("transaction_date").alias("day"), F.col("tax_deducted").alias("amount"), "section",
        F.col("tds_deposited").alias("deposited"), "status", F.col("tax_deducted").isNotNull().alias("matchable"),
    )
    return full_reconciliation(b, s, terms)


#: The order in which results are numbered.
CLASSES = ("MATCHED_CLAIMABLE", "MATCHED_NOT_CLAIMABLE", "AMOUNT_MISMATCH", "MISSING_IN_26AS", "MISSING_IN_BOOKS", "IDENTITY_UNMAPPED", "DUPLICATE_BOOK", "DUPLICATE_26AS")


def sequenced(results: DataFrame, run: str) -> DataFrame:
    """Adds seq, from 1 in the order of class, customer, group and ids, and result_id: run:seq; no task orders all rows."""
    place = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("result"))
    rows = greedy.numbered(results, [], [place.asc(), *(F.col(c).asc() for c in ("customer", "group_id", "book_id", "statement_id"))])
    return rows.withColumn("seq", F.col("pos") + 1).drop("pos").withColumn("result_id", F.concat_ws(":", F.lit(run), F.col("seq").cast("string")))


def statement_only(statements: DataFrame, rule_table: DataFrame) -> DataFrame:
    """Expected tax of each statement row by the rule in force, and whether what was deducted agrees with it."""
    day, end = F.col("day"), F.col("effective_to")
    chosen = rules.select_best(statements, rule_table, "id", rules.in_force(day, F.col("effective_from"), end), F.col("version"), F.desc("version"))
    expected = percent_of(F.col("amount"), F.col("rate"))
    gap = F.abs(expected - F.col("tax"))
    status = F.when(expected.isNull(), "NOT_DETERMINABLE").when(gap <= 10, "CONSISTENT_WITH_CONFIGURED_RULE").otherwise("TDS_DIFFERENCE")
    return chosen.select("id", "tan", "rule_id", expected.alias("expected"), F.col("tax").alias("deducted"), status.alias("status"))


def ledger_calculation(payments: DataFrame, rule_table: DataFrame, law_changes: str = "1998-01-01") -> DataFrame:
    """Every payment's rule, prior total, taxable subject, expected tax and status."""
    chosen = rules.select_best(payments, rule_table, "id", rules.in_force(F.col("day"), F.col("effective_from"), F.col("effective_to")), F.col("priority"))
    found = F.col("rule_state") == "FOUND"
    prior = compliance.prior_total(F.when(found, F.col("amount")), [F.col(c) for c in ("deductee", "fy", "rule_id", "nature")], [F.col("day"), F.col("id")])
    rows = chosen.withColumn("prior", F.when(found, prior))
    subject = compliance.taxable_subject(F.col("amount"), F.col("prior"), F.col("per_transaction"), F.col("aggregate"), F.col("excess_only"))
    rows = rows.withColumn("subject", F.when(found, subject))
    law = governing_law(F.col("credited"), F.col("paid"), law_changes)
    status = compliance.calculation_status(law, F.col("nature"), F.lit(False), F.col("rule_state"), F.col("amount"), F.col("subject"), F.col("rate"))
    rows = rows.withColumn("law", law).withColumn("calculation_status", status)
    expected = F.when(F.col("calculation_status") == "CALCULATED", percent_of(F.col("subject"), F.col("rate")))
    rows = rows.withColumn("expected", expected)
    deduction = F.when(F.col("calculation_status") == "CALCULATED", compliance.deduction_status(F.col("actual"), F.col("expected"))).otherwise("NOT_DETERMINABLE")
    return rows.select("id", "deductee", "fy", "law", "rule_id", "rule_state", "prior", "subject", "expected", "actual", "calculation_status", deduction.alias("deduction_status"), "credited", "paid")


def deposit_and_interest(calculated: DataFrame, evidence: DataFrame, rate: str = "1.50") -> DataFrame:
    """What was deposited of each calculated amount, in time or not, and the interest on late deposits."""
    owed = calculated.filter("expected is not null").select("id", "expected", F.col("paid").alias("deducted_on"), deposit_deadline(F.col("paid"), "MONTH_END_PLUS_DAYS").alias("due_on"))
    out = compliance.deposits(owed, evidence)
    charge = compliance.interest(F.col("expected"), F.lit(rate).cast(MONEY), F.col("deducted_on"), F.col("deposited_on"), F.col("due_on"))
    status = F.when(F.col("deposited_on").isNull(), "DATE_NOT_DETERMINABLE").when(charge > 0, "INTEREST_DUE").otherwise("NO_INTEREST_INDICATED")
    return out.withColumn("interest", charge).withColumn("interest_status", status)
