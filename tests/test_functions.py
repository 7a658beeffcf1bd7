"""Column functions: what they read, and what they leave untried."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import amounts, dates


@pytest.mark.parametrize("text, format_", [("05.04.2024", "d.M.yyyy"), ("2024/4/5 10:11:12", "yyyy/M/d"), ("5 march 2024", "d MMMM yyyy"), ("5-APR-24", "d-MMM-yy")])
def test_formats_of_another_shape_are_never_tried(spark, monkeypatch, text, format_):
    """Each try that fails is an error inside the parser, which took most of the time of F16's query."""
    with monkeypatch.context() as m:
        m.setattr(dates.F, "try_to_date", lambda c, f: F.raise_error(F.lit(f"tried {f};")))
        with pytest.raises(Exception, match=f"tried {format_};"):
            spark.createDataFrame([(text,)], "v string").select(dates.parse_date(F.col("v"))).collect()
    got = spark.createDataFrame([(text,)], "v string").select(dates.parse_date(F.col("v"))).first()[0]
    assert (got.year, got.day) == (2024, 5)


def test_amounts_with_and_without_marks(spark):
    cases = {"₹ 1,234.50": "1234.50", "(12)": "-12", "12-": "-12", "-3.": "-3", ".5": "0.5", "(-5)": "5", "1e5": None, "": None, "n/a": None, "12.345": "12.35", "1\t2": "12", "()": None, "-": None}
    rows = spark.createDataFrame([(k,) for k in cases], "v string").select("v", amounts.parse_amount(F.col("v")).alias("a")).collect()
    assert {r["v"]: r["a"] for r in rows} == {k: v and Decimal(v) for k, v in cases.items()}
