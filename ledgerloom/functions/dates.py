"""Financial years, quarters, periods and dates, as column expressions.  A financial year begins in April."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null


def _year_label(start: Column) -> Column:
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def financial_year(day: Column) -> Column:
    return _year_label(F.year(day) - F.when(F.month(day) < 4, 1).otherwise(0))


def quarter(day: Column) -> Column:
    return F.concat(F.lit("Q"), (F.floor(((F.month(day) + 8) % 12) / 3) + 1).cast("int").cast("string"))


def quarter_number(q: Column) -> Column:
    return F.coalesce(F.substring(q, 2, 1).cast("int"), F.lit(0))


def normalize_fy(c: Column) -> Column:
    """Lenient: ``FY 2024/2025``, ``2024-25`` and ``2024`` give ``2024-25``; what is no year comes back in upper case,
    without FY and blanks."""
    text = F.replace(F.replace(F.upper(F.trim(c)), F.lit("FY"), F.lit("")), F.lit(" "), F.lit(""))
    start, end = (F.regexp_extract(text, r"^(\d{4})[-/](\d{2,4})$", k) for k in (1, 2))
    pair = F.concat(start, F.lit("-"), F.right(end, F.lit(2)))
    return F.when(start != "", pair).when(text.rlike(r"^\d{4}$"), _year_label(F.try_to_number(text, F.lit("9999")).cast("int"))).otherwise(text)


def strict_fy(c: Column) -> Column:
    """``YYYY-YY`` or ``YYYY-YYYY`` whose end follows its start, else null."""
    text = F.regexp_replace(F.upper(F.trim(c)), r"^FY\s*", "")
    found = F.regexp_extract(text, r"^(\d{4})-(\d{2}|\d{4})$", 1)
    end = F.regexp_extract(text, r"^(\d{4})-(\d{2}|\d{4})$", 2)
    first = F.nullif(found, F.lit("")).cast("int")
    return F.when((found != "") & (F.right(end, F.lit(2)) == F.lpad(((first + 1) % 100).cast("string"), 2, "0")) & ((F.length(end) == 2) | (end == (first + 1).cast("string"))), _year_label(first))


# Date formats in the order in which they are tried.
DATE_FORMATS = ("yyyy-M-d", "d-M-yyyy", "d/M/yyyy", "d-MMM-yyyy", "d-MMM-yy", "d.M.yyyy", "yyyy/M/d", "d MMM yyyy", "d MMMM yyyy", "M/d/yyyy")
SERIAL_EPOCH = "1899-12-30"


# What a format's fields may be at most, so that a text of another shape is never given to the parser.
FIELDS = {"yyyy": r"[+-]?\d{4,}", "yy": r"[+-]?\d+", "MMMM": r"\D+", "MMM": r"\D{3,4}", "M": r"[+-]?\d+", "d": r"[+-]?\d+"}


def _shape(format_: str) -> str:
    """What every text that the format reads looks like, with or without a time of the day."""
    fields = re.sub("[A-Za-z]+|[^A-Za-z]", lambda m: FIELDS.get(m[0]) or re.escape(m[0]), format_)
    return rf"\A{fields}(?: \d{{2}}:\d{{2}}:\d{{2}})?\z"


def parse_date(c: Column) -> Column:
    """A date from a spreadsheet serial of five digits or the first format that fits; else null.

    A format that does not fit costs an error inside the parser, so only those of the text's shape are tried.
    """
    given = F.trim(c)
    text = F.regexp_replace(given, r" \d{2}:\d{2}:\d{2}$", "")
    named = F.regexp_replace(F.initcap(text), r"(?<=\d)t", "t")
    days = F.nullif(F.regexp_extract(text, r"^(\d{5})(\.\d*)?$", 1), F.lit("")).cast("int")  # a fraction is a time of the day
    serial = F.when(given.rlike(r"\A\d{5}(?!\d)"), F.date_add(F.lit(SERIAL_EPOCH).cast("date"), days))
    return F.coalesce(serial, *(F.when(given.rlike(_shape(f)), F.try_to_date(named if "MMM" in f else text, f)) for f in DATE_FORMATS))


def parse_unambiguous_date(c: Column) -> Column:
    """Null where day and month of ``a/b/yyyy`` could be swapped, else parse_date."""
    return F.when(~is_ambiguous_date(c), parse_date(c))


def is_ambiguous_date(c: Column) -> Column:
    part = lambda k: F.nullif(F.regexp_extract(c, r"^\s*(\d{1,2})/(\d{1,2})/\d{4}\s*$", k), F.lit("")).cast("int")
    return F.coalesce((part(1) <= 12) & (part(2) <= 12), F.lit(False))


def report_period_fy(c: Column) -> Column:
    """The year of the first day of ``1-Apr-24 to 31-Mar-25``."""
    return financial_year(F.try_to_date(F.initcap(F.regexp_extract(c, r"(\d{1,2}-[A-Za-z]{3}-\d{2})\s+to\s+\d{1,2}-[A-Za-z]{3}-\d{2}", 1)), "d-MMM-yy"))


def governing_law(credit: Column, payment: Column, last_day_of_old: str = "2026-03-31") -> Column:
    event = F.least(credit, payment)
    return F.when(event.isNull(), "LAW_NOT_DETERMINABLE").when(event <= F.lit(last_day_of_old).cast("date"), "INCOME_TAX_ACT_1961").otherwise("INCOME_TAX_ACT_2025")


def interest_periods(start: Column, end: Column, method: str = "CALENDAR_MONTH_OR_PART", block_days: int = 30) -> Column:
    """Months or parts of months, or blocks of days, that a delay touches; 0 without a delay."""
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) + 1
    blocks = F.ceil((F.date_diff(end, start) + 1) / block_days).cast("int")
    return F.when(end > start, blocks if method == "FIXED_DAY_BLOCK" else months).when(end.isNotNull() & start.isNotNull(), 0)


def deposit_deadline(deduction: Column, method: str, days: int = 7, month: int = 4, day: int = 30) -> Column:
    """The last day of deposit: the deduction's own, some days after its month's end, or a fixed day that follows."""
    if method == "DEDUCTION_DATE":
        return deduction
    if method == "MONTH_END_PLUS_DAYS":
        return F.date_add(F.last_day(deduction), days)
    return F.make_date(F.year(deduction) + F.when(F.month(deduction) > month, 1).otherwise(0), F.lit(month), F.lit(day))


def known_fy(c: Column) -> Column:
    return F.coalesce(strict_fy(blank_to_null(c)), F.lit("UNKNOWN"))
