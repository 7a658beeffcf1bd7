"""What a source is, by its headers: its type, what each column means and how sure that is, and whether it was misfiled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import header_key
from . import schema

# Types of sources, accounting columns, words of tax columns, messages.
STATEMENT, BOOKS_REPORT, SALES_REPORT, UNKNOWN = "Government 26AS / Form 16A", "ERP TDS Receivable / Books Report", "Sales Registry / GST Invoice Register", "Unclassified tabular report"
LEDGER_KEYS = ("particulars", "voucher_no", "voucher_type", "buyer_supplier")
INVOICE_KEYS = ("recipients_name", "recipient_name", "invoice_no", "invoice_number", "invoice_value", "taxable_value", "gstin")
INVOICE_OWN = ("invoice_no", "invoice_number", "invoice_value", "taxable_value")
ACCOUNTING = {"debit": "DEBIT_AMOUNT", "debit_amount": "DEBIT_AMOUNT", "dr": "DEBIT_AMOUNT", "credit": "CREDIT_AMOUNT", "credit_amount": "CREDIT_AMOUNT", "cr": "CREDIT_AMOUNT"}
TAX_WORDS = ("tds", "withholding", "tax_withheld", "tax_deducted", "tds_payable", "tds_receivable", "tds_liability")
MISFILED = {
    ("books", STATEMENT): "26AS / Form 16A file uploaded as Books",
    ("form26as", BOOKS_REPORT): "ERP Books report uploaded as 26AS / Form 16A",
}


def _any(keys: Column, *words: str | tuple[str, ...]) -> Column:
    """Some key holds all these words, of each tuple one."""

    def test(k: Column) -> Column:
        found = F.lit(True)
        for w in words:
            one = F.lit(False)
            for x in (w,) if isinstance(w, str) else w:
                one = one | k.contains(x)
            found = found & one
        return found

    return F.exists(keys, test)


def source_type(keys: Column) -> Column:
    """The first type that the header keys support."""
    among = lambda names: F.arrays_overlap(keys, F.array(*map(F.lit, names)))
    statement = _any(keys, "tan") & _any(keys, "deductor") & _any(keys, ("tds", "tax"), "deducted")
    return F.when(statement, STATEMENT).when(_any(keys, "tds", "receivable") | among(LEDGER_KEYS), BOOKS_REPORT).when(among(INVOICE_KEYS) & among(INVOICE_OWN), SALES_REPORT).otherwise(UNKNOWN)


def misfiled(kind: Column, found: Column) -> Column:
    """The problem where a source of one type stands in another's place, else null."""
    out = F.lit(None).cast("string")
    for (slot, kind_found), message in MISFILED.items():
        out = F.when((kind == slot) & (found == kind_found), message).otherwise(out)
    return out


def files(headers: DataFrame) -> DataFrame:
    """(file, kind, source_type, problem) of sources; headers: (file, kind, headers), kind being the place it was put in."""
    keys = F.filter(F.transform("headers", header_key), lambda k: k != "")
    found = headers.select("file", "kind", source_type(keys).alias("source_type"))
    return found.withColumn("problem", misfiled(F.col("kind"), F.col("source_type")))


def columns(headers: DataFrame) -> DataFrame:
    """(file, kind, place, source_column, canonical_field, mapping_method, semantic_field, confidence, status) of every column.

    A canonical name wins over an alias, then the leftmost; a debit or credit says a direction and is never taken for tax.
    """
    known = headers.sparkSession.createDataFrame([(k, key, column) for k in schema.KINDS for key, (column, _) in schema.aliases(k).items()], "kind string, key string, column string")
    each = headers.select("file", "kind", F.posexplode("headers").alias("place", "source_column")).withColumn("key", header_key(F.col("source_column"))).filter("key != ''")
    each = each.join(known, ["kind", "key"], "left")
    # a file's header is one row of cells
    first = each.filter("column is not null").groupBy("file", "kind", "column").agg(F.min(F.struct(F.col("key") != F.col("column"), "place"))["place"].alias("place"))
    each = each.join(first.withColumn("_won", F.lit(True)), ["file", "kind", "column", "place"], "left")
    canonical = F.when(F.col("_won"), F.col("column"))
    semantic = F.coalesce(*(F.when(F.col("key") == k, v) for k, v in ACCOUNTING.items()))
    sure = canonical.isNotNull() | semantic.isNotNull()
    return each.select(
        "file", "kind", "place", "source_column", canonical.alias("canonical_field"), F.when(canonical.isNotNull(), F.when(F.col("key") == F.col("column"), "CANONICAL_HEADER").otherwise("CANONICAL_ALIAS")).alias("mapping_method"),
        F.coalesce(semantic, F.upper(canonical)).alias("semantic_field"), F.when(sure, "HIGH").otherwise("NOT_DETERMINABLE").alias("confidence"), F.when(sure, "DETECTED").otherwise("IGNORED").alias("status"),
    )


def warnings(headers: DataFrame) -> DataFrame:
    """(file, kind, code, source_columns, accounting_context): what a user has to confirm before amounts are tax."""
    named = F.filter("headers", lambda h: _has_word(header_key(h)))
    amounts = F.exists("headers", lambda h: header_key(h).isin(*ACCOUNTING))
    code = F.when(F.size(named) > 0, "TDS_ROLE_REVIEW_REQUIRED").when(amounts, "TDS_ROLE_NOT_DETERMINABLE")
    return headers.select("file", "kind", code.alias("code"), named.alias("source_columns"), F.when(code.isNotNull(), "REVIEW_REQUIRED").otherwise("NOT_APPLICABLE").alias("accounting_context"))


def _has_word(key: Column) -> Column:
    found = F.lit(False)
    for w in TAX_WORDS:
        found = found | key.contains(w)
    return found
