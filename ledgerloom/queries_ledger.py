"""The statutory ledger and the calculator over the driver's payments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.amounts import MONEY
from .plans import ledger
from .plans.frames import PAYMENTS_SQL, payments
from .queries import query

#: rule_id, act, nature, rate, no_pan_rate, per_transaction, aggregate, threshold, threshold_type, precision; one act ends with 1997.
OLD, NEW = "INCOME_TAX_ACT_1961", "INCOME_TAX_ACT_2025"
RULES = [
    (1, OLD, "contractor", "194C", 1, 30000, 100000, None, "AGGREGATE", 2), (2, OLD, "rent", "194I", 2, None, None, 40000, "PER_TRANSACTION", 0), (3, OLD, "royalty", "194J", 10, None, None, 60000, "AGGREGATE_EXCESS", 2),
    (4, OLD, "commission", "194H", 5, None, None, 25000, "SOMETIMES", 2), (5, NEW, "contractor", "393(1)", 1, 30000, 100000, None, "AGGREGATE_EXCESS", 2), (6, NEW, "rent", "194I", 2, None, None, 40000, "PER_TRANSACTION", 0),
    (7, NEW, "royalty", "393(2)", 10, None, None, 60000, "BOTH", 1),
]
NATURES = {"ECONOMY": "contractor", "LARGE": "rent", "MEDIUM": "royalty", "PROMO": "commission", "SMALL": "brokerage"}


def _rules(spark: SparkSession) -> DataFrame:
    schema = "rule_id int, act string, nature string, section string, rate int, per_transaction int, aggregate int, threshold int, threshold_type string, rounding_precision int"
    rows = spark.createDataFrame(RULES, schema)
    return rows.withColumns({c: F.col(c).cast(MONEY) for c in ("rate", "per_transaction", "aggregate", "threshold")}).withColumn("lifecycle", F.lit("ACTIVE"))


def pan_of(key: Column) -> Column:
    """A PAN of its own for each key: the last four digits, and letters that count the ten thousands before them."""
    high = F.floor(key / 10000).cast("long")
    letter = lambda i: F.char(65 + F.floor(high / 26**i).cast("long") % 26)
    return F.concat(*map(letter, (5, 4, 3, 2, 1)), F.lpad((key % 10000).cast("string"), 4, "0"), letter(0))


def _payments(spark: SparkSession, d: str) -> DataFrame:
    last = F.element_at(F.split(F.upper("nature"), " "), -1)
    named = F.coalesce(*(F.when(last == word, n) for word, n in NATURES.items()), last)
    return payments(spark, d).select(
        F.col("id").alias("transaction_id"), F.col("id").alias("row_no"), F.col("credited").alias("credit_date"), F.col("paid").alias("payment_date"), F.col("fy").alias("financial_year"), named.alias("payment_nature"),
        "amount", pan_of(F.col("deductee")).alias("deductee_pan"), F.col("actual").alias("tds_deducted"),
    )


def _sql() -> str:
    value = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    table = ", ".join("(" + ", ".join(map(value, r)) + ")" for r in RULES)
    named = " ".join(f"WHEN '{w}' THEN '{n}'" for w, n in NATURES.items())
    return f"""WITH {PAYMENTS_SQL}, rules(rule_id, act, nature, section, rate, per_tx, agg, threshold, kind, places) AS (VALUES {table}),
p AS (SELECT *, CASE string_split(upper(nature), ' ')[-1] {named} END AS n, CASE WHEN least(credited, paid) <= DATE '1997-12-31' THEN '{OLD}' ELSE '{NEW}' END AS law FROM payments),
j AS (SELECT p.id, deductee, fy, credited, amount, actual, law, n, rules.* FROM p LEFT JOIN rules ON rules.act = law AND rules.nature = n),
s AS (SELECT *, n IS NOT NULL AND rule_id IS NOT NULL AND (law = '{OLD}' OR section LIKE '393%') AS through FROM j),
c AS (SELECT *, coalesce(sum(amount) OVER (PARTITION BY fy, deductee, rule_id, through ORDER BY credited, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DECIMAL(18,2) AS prior FROM s),
x AS (SELECT *, CASE WHEN NOT through THEN NULL WHEN per_tx IS NOT NULL THEN CASE WHEN prior + amount > agg AND kind = 'AGGREGATE_EXCESS' THEN prior + amount - greatest(prior, agg) WHEN amount > per_tx OR prior + amount > agg THEN amount ELSE 0 END
    WHEN kind = 'PER_TRANSACTION' THEN CASE WHEN amount >= threshold THEN amount ELSE 0 END
    WHEN kind = 'BOTH' THEN CASE WHEN prior + amount < threshold THEN 0 ELSE amount END
    WHEN kind = 'AGGREGATE_EXCESS' THEN CASE WHEN prior + amount <= threshold THEN 0 ELSE prior + amount - greatest(prior, threshold) END END::DECIMAL(18,2) AS subject FROM c),
y AS (SELECT *, CASE places WHEN 0 THEN round(subject * rate / 100.0::DECIMAL(4,1), 0) WHEN 1 THEN round((subject * rate)::DECIMAL(28,4) * 0.01::DECIMAL(3,2), 1) ELSE round((subject * rate)::DECIMAL(28,4) * 0.01::DECIMAL(3,2), 2) END::DECIMAL(22,4) AS tax FROM x)"""


@query(_sql() + """
SELECT id AS transaction_id, CASE WHEN n IS NOT NULL THEN rule_id END AS rule_id, CASE WHEN through THEN prior END AS prior, subject, tax AS expected,
  CASE WHEN n IS NULL THEN 'REVIEW_REQUIRED' WHEN rule_id IS NULL THEN 'RULE_NOT_FOUND' WHEN subject IS NULL THEN 'REVIEW_REQUIRED' ELSE 'CALCULATED' END AS calculation_status,
  CASE WHEN n IS NULL THEN 'PAYMENT_NATURE_NOT_DETERMINABLE' WHEN rule_id IS NULL THEN 'RULE_NOT_FOUND' WHEN NOT through THEN 'NEW_ACT_REFERENCE_REQUIRED' WHEN subject IS NULL THEN 'THRESHOLD_NOT_DETERMINABLE' END AS reason_code,
  CASE WHEN tax IS NULL THEN 'NOT_DETERMINABLE' WHEN actual = tax THEN 'COMPLIANT' WHEN actual < tax THEN 'SHORT_DEDUCTION' ELSE 'EXCESS_DEDUCTION' END AS deduction_status FROM y""", decimals="prior subject expected")
def statutory_ledger(spark, d):
    rows = ledger.calculate(_payments(spark, d), _rules(spark), "1997-12-31")
    return rows.select("transaction_id", "rule_id", "prior", "subject", "expected", "calculation_status", "reason_code", "deduction_status")


@query(f"""WITH {PAYMENTS_SQL}, q AS (SELECT id, amount, least(credited, paid) <= DATE '1997-12-31' AS old, string_split(upper(nature), ' ')[-1] = 'MEDIUM' AS royal, actual * 10 AS seed FROM payments),
s AS (SELECT *, CASE WHEN NOT royal THEN NULL WHEN old THEN CASE WHEN seed + amount <= 60000 THEN 0 ELSE seed + amount - greatest(seed, 60000) END ELSE CASE WHEN seed + amount < 60000 THEN 0 ELSE amount END END::DECIMAL(18,2) AS subject FROM q)
SELECT id AS transaction_id, seed::DECIMAL(18,2) AS threshold_consumed, subject, CASE WHEN seed + amount < 60000 THEN 'BELOW_THRESHOLD' WHEN seed + amount = 60000 THEN 'THRESHOLD_REACHED' ELSE 'ABOVE_THRESHOLD' END AS threshold_status,
  CASE WHEN old THEN round(subject * 0.1::DECIMAL(2,1), 2) ELSE round(subject * 0.1::DECIMAL(2,1), 1) END::DECIMAL(18,2) AS expected, (amount - CASE WHEN old THEN round(subject * 0.1::DECIMAL(2,1), 2) ELSE round(subject * 0.1::DECIMAL(2,1), 1) END)::DECIMAL(18,2) AS net FROM s WHERE royal""", decimals="threshold_consumed subject expected net")
def seeded_calculator(spark, d):
    """Each royalty by itself, after a total from outside that lies below, at or above the threshold."""
    rows = _payments(spark, d).filter("payment_nature = 'royalty'").withColumn("previous_aggregate", (F.col("tds_deducted") * 10).cast(MONEY))
    found = ledger.calculator(rows, _rules(spark), "1997-12-31")
    return found.select("transaction_id", "threshold_consumed", "subject", "threshold_status", F.col("expected").cast(MONEY).alias("expected"), F.col("net").cast(MONEY).alias("net"))
