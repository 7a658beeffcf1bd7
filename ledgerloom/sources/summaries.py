"""Account-group summaries: accounts with opening balance, debits, credits and closing balance below a header of three rows.

The header may stand in any row and anew for each segment of a file; which columns hold what is read from it.  Debits of
receivable accounts are amounts of tax; credits alone need a look, and totals are controls, never records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import MONEY, parse_amount
from ..functions.dates import report_period_fy
from ..functions.text import header_key

# Keys of the header's cells and of total rows, and the accounts that hold tax.
PARTICULARS, DEBIT, CREDIT, BALANCE = ("particulars", "particular"), ("debit", "dr"), ("credit", "cr"), ("balance",)
TOTALS = ("grand_total", "total", "subtotal")
RECEIVABLE, PAYABLE, FROM = r"(?i)^tds\s+rec(?:ei|ie)vable\b", r"(?i)^tds\s+payable\b", r"(?i)^tds\s+rec(?:ei|ie)vable\s+from\s+"


def _place(keys: Column, names: tuple[str, ...], test=lambda i: F.lit(True)) -> Column:
    """The first place with one of these keys that passes the test, null without one."""
    at = F.transform(keys, lambda k, i: F.when(k.isin(*names) & test(i), i))
    return F.array_min(at)


def segments(grid: DataFrame) -> DataFrame:
    """(file, heads): the headers of each file in order, as (row_no, label, debit, credit, opening, closing: their places)."""
    keyed = grid.select("file", "row_no", F.transform("cells", header_key).alias("keys"))
    top = keyed.filter(_place(F.col("keys"), PARTICULARS).isNotNull()).select("file", "row_no", _place(F.col("keys"), PARTICULARS).alias("label"))
    debit, credit = _place(F.col("keys"), DEBIT), _place(F.col("keys"), CREDIT)
    below = keyed.filter(debit.isNotNull() & credit.isNotNull()).withColumns({"debit": debit, "credit": credit})
    below = below.select(
        "file", (F.col("row_no") - 2).alias("row_no"), "debit", "credit", _place(F.col("keys"), BALANCE, lambda i: i < F.col("debit")).alias("opening"), _place(F.col("keys"), BALANCE, lambda i: i > F.col("credit")).alias("closing")
    )
    heads = F.array_sort(F.collect_list(F.struct("row_no", "label", "debit", "credit", "opening", "closing")))
    return top.join(below, ["file", "row_no"]).groupBy("file").agg(heads.alias("heads"))


def group_summary(grid: DataFrame) -> DataFrame:
    """The accounts and totals of summaries; grid: (file, row_no, cells).

    (file, segment, row_no, label, party, row_type, role, direction, debit, credit, opening, closing, tds_amount, status,
    financial_year).  Files whose heading does not speak of tax, or without a header, give nothing; the year is that of
    the period in the heading.
    """
    found = segments(grid)
    heading = grid.join(found.select("file", F.col("heads")[0]["row_no"].alias("_top")), "file").filter(F.col("row_no") < F.col("_top") + 3)
    said = F.array_join("cells", " ")
    periods = F.filter(F.transform("cells", report_period_fy), lambda y: y.isNotNull())
    above = F.when((F.col("row_no") < F.col("_top")) & (F.size(periods) > 0), F.struct("row_no", F.get(periods, F.lit(0)).alias("fy")))
    about = heading.groupBy("file").agg(F.bool_or(F.lower(said).contains("tds")).alias("_tax"), F.min(above)["fy"].alias("financial_year")).filter("_tax").drop("_tax")
    head = F.try_element_at(F.filter("heads", lambda h: h["row_no"] + 2 < F.col("row_no")), F.lit(-1))
    upper = F.exists("heads", lambda h: (F.col("row_no") >= h["row_no"]) & (F.col("row_no") <= h["row_no"] + 2))
    rows = grid.join(found, "file").join(about, "file").filter(F.col("row_no") > F.col("heads")[0]["row_no"] + 2).filter(~upper)
    rows = rows.withColumn("_h", head).withColumn("label", F.trim(F.get("cells", F.col("_h.label")))).filter("label != ''")
    amount = {c: parse_amount(F.get("cells", F.col(f"_h.{c}"))) for c in ("debit", "credit", "opening", "closing")}
    words = F.replace(header_key(F.col("label")), F.lit("_"), F.lit(" "))
    rows = rows.withColumns({**amount, "_words": words})
    total = header_key(F.col("label")).isin(*TOTALS)
    role = F.when(total, "NON_TRANSACTION_ROW").when(F.col("_words").rlike(RECEIVABLE), "TDS_RECEIVABLE").when(F.col("_words").rlike(PAYABLE), "TDS_PAYABLE").otherwise("NON_TDS_ACCOUNT")
    receivable = F.col("role") == "TDS_RECEIVABLE"
    rows = rows.withColumn("role", role).withColumn("direction", F.when(receivable, F.when(F.col("debit") > 0, "DEBIT").when(F.col("credit") > 0, "CREDIT")))
    eligible = receivable & F.coalesce(F.col("direction") == "DEBIT", F.lit(False))
    return rows.select(
        "file", F.size(F.filter("heads", lambda h: h["row_no"] < F.col("row_no"))).alias("segment"), "row_no", "label",
        F.when(receivable, F.nullif(F.trim(F.regexp_replace("label", FROM, "")), F.lit(""))).alias("party"), F.when(total, "GRAND_TOTAL").otherwise("ACCOUNT_GROUP").alias("row_type"), "role", "direction",
        "debit", "credit", "opening", "closing", F.when(eligible, F.col("debit")).cast(MONEY).alias("tds_amount"),
        F.when(total | ~receivable, "NOT_APPLICABLE").when(eligible, "VALID").otherwise("REVIEW_REQUIRED").alias("status"), "financial_year",
    )


def control_totals(summary: DataFrame) -> DataFrame:
    """Each segment's receivable debits and credits beside its last total row, and how far they are apart."""
    own = F.col("role") == "TDS_RECEIVABLE"
    sums = lambda c: F.coalesce(F.sum(F.when(own, F.col(c))), F.lit(0)).cast(MONEY)
    last = lambda c: F.max_by(c, F.when(F.col("row_type") == "GRAND_TOTAL", F.col("row_no")))
    out = summary.groupBy("file", "segment").agg(
        F.count_if(own).alias("account_rows"), F.count_if(F.col("status") == "VALID").alias("debit_rows"), F.count_if(F.col("status") == "REVIEW_REQUIRED").alias("review_rows"),
        sums("debit").alias("debit_total"), sums("credit").alias("credit_total"), last("debit").alias("control_debit"), last("credit").alias("control_credit"),
    )
    return out.withColumns({"debit_difference": (F.col("debit_total") - F.col("control_debit")).cast(MONEY), "credit_difference": (F.col("credit_total") - F.col("control_credit")).cast(MONEY)})
