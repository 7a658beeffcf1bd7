"""From files as accounting systems give them out to results."""

from decimal import Decimal

import pytest

from ledgerloom.plans.reconcile import reconcile_exports
from ledgerloom.sources import tables

BOOKS = '''Books of account;;;;;
Voucher No;Party Name;Party Code;Voucher Date;TDS Receivable;Section
V1;"Acme
Steel Ltd";C1;05-04-2024;1,000.00;194C
V2;Acme Steel Ltd;C1;06-04-2024;500.00;194C
V3;Beta Traders;C2;07-04-2024;300.00;194J
V4;Beta Traders;C2;07-04-2024;200.00;194J
V5;Gamma;C3;08-07-2024;900.00;194C
V6;Gamma;C3;;;194C
Grand Total;;;;2,900.00;
'''
STATEMENT = '''TAN,Name of Deductor,Transaction Date,Tax Deducted,TDS Deposited,Status of Booking,Section
T1,Anything,05-04-2024,1000,1000,F,194C
T1,Anything,05-05-2024,495,495,U,194C
T2,Beta Traders,09-04-2024,500,480,F,194J
T3,Old Gamma,08-10-2024,100,,F,194C
T4,Nobody known,08-10-2024,77,77,F,194C
T4,Nobody known,08-10-2024,77,77,F,194C
'''
MASTER = "Customer Code,Customer Name,TAN,Aliases\nC1,Acme Steel Limited,T1,\nC2,Beta Traders,,\nC3,Gamma,,Old Gamma\n"


@pytest.fixture
def files(spark, tmp_path):
    def read(name, text, kind):
        (tmp_path / name).write_text(text)
        return tables.read_delimited(spark, str(tmp_path / name), kind, raw=True)

    return read("b.csv", BOOKS, "books"), read("s.csv", STATEMENT, "form26as"), read("m.csv", MASTER, "customer_master")


def test_exports_are_reconciled(files):
    rows = reconcile_exports(*files).collect()
    s = {f"SYS-26AS-{k:04d}": f"S{k}" for k in range(1, 9)}
    got = {(r["result"], r["method"], r["book_id"], s.get(r["statement_id"]), r["customer"], r["difference"], r["severity"], r["category"]) for r in rows}
    assert got == {
        ("MATCHED_CLAIMABLE", "EXACT_1_TO_1_SAME_QUARTER", "V1", "S1", "C1", Decimal(0), "NONE", None),
        ("MATCHED_NOT_CLAIMABLE", "EXACT_1_TO_1_SAME_QUARTER", "V2", "S2", "C1", Decimal(5), "MEDIUM", "NOT_CLAIMABLE"),  # not final
        ("MATCHED_NOT_CLAIMABLE", "GROUP_SAME_QUARTER", "V3", "S3", "C2", Decimal(0), "MEDIUM", "NOT_CLAIMABLE"),  # 480 of 500 deposited
        ("MATCHED_NOT_CLAIMABLE", "GROUP_SAME_QUARTER", "V4", "S3", "C2", Decimal(0), "MEDIUM", "NOT_CLAIMABLE"),
        ("AMOUNT_MISMATCH", "UNMATCHED", "V5", "S4", "C3", Decimal(800), "HIGH", "AMOUNT_MISMATCH"),
        ("IDENTITY_UNMAPPED", "UNMATCHED", None, "S5", None, Decimal(-77), "HIGH", "IDENTITY"),
        ("DUPLICATE_26AS", "UNMATCHED", None, "S6", None, Decimal(-77), "LOW", "DUPLICATES"),
    }


def test_a_confirmed_mapping_lets_rows_match(spark, files):
    mappings = spark.createDataFrame([("T4", "C3")], "tan string, code string")
    rows = {r["result"]: r for r in reconcile_exports(*files, mappings=mappings).collect()}
    assert "IDENTITY_UNMAPPED" not in rows and rows["MISSING_IN_BOOKS"]["customer"] == "C3"


def test_a_customer_is_found_behind_many_others(spark, tmp_path):
    """The deductor's customer is the last of 400 that share a word with it."""
    names = [f"Firm {chr(65 + k % 26)}{k}" for k in range(400)]
    texts = {
        "b.csv": "Voucher No,Party Name,Party Code,Voucher Date,TDS Receivable,Section\nV1,Firm J399,C999,05-04-2024,100.00,194C\n",
        "s.csv": "TAN,Name of Deductor,Transaction Date,Tax Deducted,TDS Deposited,Status of Booking,Section\nT1,Firm J399 Branch,05-04-2024,100,100,F,194C\n",
        "m.csv": "Customer Code,Customer Name,TAN\n" + "".join(f"C{600 + k},{n},\n" for k, n in enumerate(names)),
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    read = lambda name, kind: tables.read_delimited(spark, str(tmp_path / name), kind, raw=True)
    (row,) = reconcile_exports(read("b.csv", "books"), read("s.csv", "form26as"), read("m.csv", "customer_master")).collect()
    assert (row["result"], row["customer"], row["book_id"]) == ("MATCHED_CLAIMABLE", "C999", "V1")
