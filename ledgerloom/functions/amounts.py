"""Amounts, tolerances and comparisons that keep missing evidence apart from zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def money(c: Column) -> Column:
    return c.cast(MONEY)


# Fixed value: a number without marks.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)$"


def parse_amount(c: Column) -> Column:
    """``₹ 1,234.50``, ``(12)`` and ``12-`` as decimals; what is no number is null.  Only texts with a mark are taken apart."""
    text = F.translate(c, "₹, \t\n\x0b\f\r", "")
    value = lambda digits: F.when(digits.rlike(NUMBER), digits).try_cast("decimal(30,8)")
    bare = value(F.regexp_replace(text, r"^\(|\)$|-$", ""))
    marked = F.when(text.rlike(r"^\(.*\)$") | text.rlike(r".-$"), -bare).otherwise(bare)
    return F.round(F.when(text.rlike(NUMBER), text.try_cast("decimal(30,8)")).when(text.rlike(r"^\(|\)$|-$"), marked), 2).cast(MONEY)


def within_tolerance(target: Column, other: Column, absolute: str = "10.00", percent: str = "1.00") -> Column:
    """|target - other| is at most the larger of the absolute and the target's relative tolerance."""
    a, p = F.lit(absolute).cast(MONEY), F.lit(percent).cast(MONEY)
    return F.abs(target - other) <= F.greatest(a.cast("decimal(30,6)"), (F.abs(target) * p * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(30,6)"))


def within_mutual_tolerance(left: Column, right: Column, absolute: str = "10.00", percent: str = "1.00") -> Column:
    """Symmetric; a missing side never agrees."""
    a, p = F.lit(absolute).cast(MONEY), F.lit(percent).cast(MONEY)
    top = F.greatest(F.abs(left), F.abs(right), F.lit(1).cast(MONEY))
    d = F.abs(left - right)
    return F.coalesce((d <= a) | (d <= top * p * F.lit("0.01").cast("decimal(3,2)")), F.lit(False))


def strict_sum(c: Column, empty: Column | None = None) -> Column:
    """Null as soon as one value is; ``empty`` (else null) where there are no rows."""
    whole = F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))
    return whole if empty is None else F.when(F.count(F.lit(1)) == 0, empty).otherwise(whole)


def zero_sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0).cast(MONEY))


def compare(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), "REVIEW_REQUIRED").when(a == b, "MATCHED").otherwise("DIFFERENCE")


def percent_of(base: Column, rate: Column, places: int = 2) -> Column:
    """base * rate / 100, half up."""
    return F.round((base * rate * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(38,8)"), places).cast(MONEY)


def gross_up(net: Column, rate: Column) -> Column:
    """The gross amount that leaves ``net`` after tax at ``rate`` percent."""
    return F.round(net.cast("decimal(28,6)") / (1 - rate * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(10,6)"), 2).cast(MONEY)


def inr(c: Column) -> Column:
    """Indian digit groups with two decimals; a dash for null."""
    whole = F.split(F.abs(c).cast(MONEY).cast("string"), r"\.")
    tail = F.right(whole[0], F.lit(3))
    head = F.regexp_replace(F.left(whole[0], F.greatest(F.length(whole[0]) - 3, F.lit(0))), r"(?<=\d)(?=(\d\d)+$)", ",")
    shown = F.concat(F.when(c < 0, "-").otherwise(""), F.lit("₹"), F.when(head != "", F.concat(head, F.lit(","))).otherwise(""), tail, F.lit("."), whole[1])
    return F.coalesce(shown, F.lit("—"))
