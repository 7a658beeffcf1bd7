"""Account-group summaries and what sources are by their headers."""

from decimal import Decimal

import pytest

from ledgerloom.sources import profiles, summaries

GRID = [
    ["Firm", "", "", "", ""], ["TDS accounts", "", "", "", ""], ["1-Apr-24 to 31-Mar-25", "", "", "", ""],
    ["Particulars", "Opening", "Transactions", "", "Closing"], ["", "", "", "", ""], ["", "Balance", "Debit", "Credit", "Balance"],
    ["TDS Receivable from Acme", "5", "1,000.00", "", "1,005"], ["tds recievable", "", "20", "20", ""], ["TDS Receivable from Beta", "", "", "30", ""], ["TDS Payable 194C", "", "7", "", ""], ["Rent", "", "8", "", ""], ["", "", "9", "", ""],
    ["Grand Total", "", "1,021.00", "50", ""],
    ["Particulars", "Opening", "Transactions", "", "Closing"], ["", "", "", "", ""], ["", "", "Credit", "Debit", ""],
    ["TDS Receivable from Gamma", "", "4", "6", ""], ["Total", "", "4", "6", ""],
]


def test_a_group_summary(spark):
    rows = [("a", k, c) for k, c in enumerate(GRID, 1)] + [("b", k, c) for k, c in enumerate([["Ledgers"], *GRID[3:6], ["Sales", "", "1", "", ""]], 1)] + [("c", 1, ["Particulars"]), ("c", 2, ["TDS"])]
    grid = spark.createDataFrame(rows, "file string, row_no long, cells array<string>")
    got = summaries.group_summary(grid).orderBy("row_no").collect()
    assert {r["file"] for r in got} == {"a"} and {r["financial_year"] for r in got} == {"2024-25"}
    assert [(r["row_no"], r["segment"], r["party"], r["role"], r["direction"], r["tds_amount"], r["status"]) for r in got] == [
        (7, 1, "Acme", "TDS_RECEIVABLE", "DEBIT", Decimal(1000), "VALID"), (8, 1, "tds recievable", "TDS_RECEIVABLE", "DEBIT", Decimal(20), "VALID"),
        (9, 1, "Beta", "TDS_RECEIVABLE", "CREDIT", None, "REVIEW_REQUIRED"), (10, 1, None, "TDS_PAYABLE", None, None, "NOT_APPLICABLE"), (11, 1, None, "NON_TDS_ACCOUNT", None, None, "NOT_APPLICABLE"),
        (13, 1, None, "NON_TRANSACTION_ROW", None, None, "NOT_APPLICABLE"), (17, 2, "Gamma", "TDS_RECEIVABLE", "DEBIT", Decimal(6), "VALID"), (18, 2, None, "NON_TRANSACTION_ROW", None, None, "NOT_APPLICABLE"),
    ]
    assert [got[0][c] for c in ("opening", "closing")] == [Decimal(5), Decimal(1005)]
    totals = summaries.control_totals(summaries.group_summary(grid)).orderBy("segment").collect()
    assert [(r["debit_total"], r["debit_difference"], r["credit_difference"], r["debit_rows"], r["review_rows"]) for r in totals] == [(1020, -1, 0, 2, 1), (6, 0, 0, 1, 0)]
    assert summaries.group_summary(grid.limit(0)).collect() == []


@pytest.mark.parametrize(
    "headers, wanted",
    [
        (["TAN of Deductor", "Deductor", "TDS deducted"], profiles.STATEMENT), (["tan", "deductor", "Tax Deducted", "TDS Receivable"], profiles.STATEMENT), (["TDS Receivable A/c"], profiles.BOOKS_REPORT),
        (["Buyer / Supplier"], profiles.BOOKS_REPORT), (["GSTIN", "Invoice Value"], profiles.SALES_REPORT), (["GSTIN"], profiles.UNKNOWN), ([], profiles.UNKNOWN),
    ],
)
def test_source_types(spark, headers, wanted):
    df = spark.createDataFrame([("f", "books", headers)], "file string, kind string, headers array<string>")
    (r,) = profiles.files(df).collect()
    assert r["source_type"] == wanted and (r["problem"] is not None) == (wanted == profiles.STATEMENT)


def test_columns_and_warnings(spark):
    df = spark.createDataFrame([("f", "books", ["Party", "Customer Name", "Name", "Dr", "Foo", "", "TDS"]), ("g", "books", ["Credit"]), ("h", "books", [])], "file string, kind string, headers array<string>")
    got = {(r["file"], r["source_column"]): (r["canonical_field"], r["mapping_method"], r["semantic_field"], r["confidence"], r["status"]) for r in profiles.columns(df).collect()}
    assert got == {
        ("f", "Party"): (None, None, None, "NOT_DETERMINABLE", "IGNORED"), ("f", "Customer Name"): ("customer_name", "CANONICAL_HEADER", "CUSTOMER_NAME", "HIGH", "DETECTED"),
        ("f", "Name"): (None, None, None, "NOT_DETERMINABLE", "IGNORED"), ("f", "Dr"): ("debit_amount", "CANONICAL_ALIAS", "DEBIT_AMOUNT", "HIGH", "DETECTED"), ("f", "Foo"): (None, None, None, "NOT_DETERMINABLE", "IGNORED"),
        ("f", "TDS"): ("tds_expected", "CANONICAL_ALIAS", "TDS_EXPECTED", "HIGH", "DETECTED"), ("g", "Credit"): ("credit_amount", "CANONICAL_ALIAS", "CREDIT_AMOUNT", "HIGH", "DETECTED"),
    }
    assert {r["file"]: r["code"] for r in profiles.warnings(df).collect()} == {"f": "TDS_ROLE_REVIEW_REQUIRED", "g": "TDS_ROLE_NOT_DETERMINABLE", "h": None}
