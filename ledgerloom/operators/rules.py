"""Choosing effective-dated rules.

Rule tables are configuration, maintained by hand; still they are only broadcast while they are small (the optimizer
decides by their measured size), so every choice here is an ordinary join followed by one ranking per transaction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN_FROM, OPEN_TO = "0001-01-01", "9999-12-31"


def in_force(day: Column, start: Column, end: Column) -> Column:
    return day.between(F.coalesce(start, F.lit(OPEN_FROM).cast("date")), F.coalesce(end, F.lit(OPEN_TO).cast("date")))


def select_best(transactions: DataFrame, rules: DataFrame, key: str, condition: Column, priority: Column, tie: Column | None = None) -> DataFrame:
    """Every transaction with its rule of highest priority.

    ``rule_state`` is FOUND, NOT_FOUND or, where several rules share the highest priority and no ``tie`` order is
    given, AMBIGUOUS; the rule's columns are null unless it is FOUND.
    """
    names = rules.columns
    joined = transactions.join(rules, condition, "left")
    best = F.max(priority).over(Window.partitionBy(key))
    top = joined.withColumn("_p", priority).withColumn("_best", best).filter(F.col("_p").isNull() | (F.col("_p") == F.col("_best")))
    order = Window.partitionBy(key).orderBy(*([tie] if tie is not None else [F.col("_p")]))
    ranked = top.withColumn("_n", F.count("_p").over(Window.partitionBy(key))).withColumn("_r", F.row_number().over(order)).filter("_r = 1")
    state = F.when(F.col("_n") == 0, "NOT_FOUND").when((F.col("_n") > 1) & F.lit(tie is None), "AMBIGUOUS").otherwise("FOUND")
    found = ranked.withColumn("rule_state", state)
    own = [c for c in transactions.columns]
    return found.select(*own, *(F.when(F.col("rule_state") == "FOUND", F.col(c)).alias(c) for c in names), "rule_state")


def requirements_met(requirements: Column, facts: Column) -> Column:
    """Relational division: for every requirement some fact has its type and value, and is verified."""
    fits = lambda r: F.exists(facts, lambda f: (f["fact_type"] == r["fact_type"]) & (f["value_code"] == r["value_code"]) & (f["evidence_status"] == "VERIFIED"))
    return F.forall(requirements, fits)


def apply_mappings(rows: DataFrame, mappings: DataFrame, key: str, text: Column) -> DataFrame:
    """The nature that keyword mappings of the highest priority agree on; CONFLICT if they do not, NONE without any.

    mappings: (keyword, nature, priority).
    """
    hit = rows.join(mappings, F.lower(text).contains(F.lower(F.col("keyword"))), "left")
    top = F.max("priority").over(Window.partitionBy(key))
    best = hit.withColumn("_top", top).filter(F.col("priority").isNull() | (F.col("priority") == F.col("_top")))
    natures = best.groupBy(key).agg(F.countDistinct("nature").alias("_n"), F.min("nature").alias("_nature"))
    status = F.when(F.col("_n") == 0, "NONE").when(F.col("_n") == 1, "MAPPED").otherwise("CONFLICT")
    return natures.select(key, F.when(F.col("_n") == 1, F.col("_nature")).alias("nature"), status.alias("mapping_status"))


def overlapping(rules: DataFrame, id_col: str, scope: list[str]) -> DataFrame:
    """Pairs of rules of one scope that are in force on a common day."""
    a, b = rules.alias("a"), rules.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in scope]
    cond = F.col(f"a.{id_col}") < F.col(f"b.{id_col}")
    for c in same:
        cond = cond & c
    start = lambda t: F.coalesce(F.col(f"{t}.effective_from"), F.lit(OPEN_FROM).cast("date"))
    end = lambda t: F.coalesce(F.col(f"{t}.effective_to"), F.lit(OPEN_TO).cast("date"))
    both = a.join(b, cond & (start("a") <= end("b")) & (start("b") <= end("a")))
    return both.select(F.col(f"a.{id_col}").alias("rule_a"), F.col(f"b.{id_col}").alias("rule_b"), F.greatest(start("a"), start("b")).alias("both_from"), F.least(end("a"), end("b")).alias("both_to"))


def current_versions(events: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the highest version of each key, the others' state being SUPERSEDED."""
    last = F.max(version).over(Window.partitionBy(key))
    return events.withColumn("is_current", F.col(version) == last)


def eligibility(rule: str, checks: dict[str, Column]) -> Column:
    """All reasons for which a rule can't apply, as a sorted list; empty where it can."""
    return F.array_sort(F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(f"{rule}{name}")) for name, c in checks.items()))))


# What a configured rule may be based on, and its kinds of thresholds.
BASES = ("AMOUNT_PAID_CREDITED", "BOOKS_TDS_BASE", "CUSTOM_BASE")
THRESHOLD_KINDS = ("NO_THRESHOLD", "PER_TRANSACTION", "AGGREGATE", "ANNUAL")


def validated(rules: DataFrame, existing: DataFrame) -> DataFrame:
    """The configured rules with ``error``, the first thing that is wrong with each, null for valid ones.

    rules: text columns rule_id, section, financial_year, rate, threshold, threshold_type, calculation_base,
    effective_from, effective_to, version, source, source_reference, and is_active, which is true where null.  A valid
    active rule must not share a day with an active rule of ``existing`` (the same columns) of its section and year.
    """
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    number = lambda c: F.trim(c).try_cast("decimal(30,10)")
    day = lambda c: F.left(c, F.lit(10)).try_cast("date")
    section = F.upper(text("section"))
    threshold = text("threshold")
    start, end = day("effective_from"), day("effective_to")
    version = F.coalesce(F.nullif(text("version"), F.lit("")), F.lit("1")).try_cast("int")
    checks = {
        "SECTION_REQUIRED": section != "",
        "FINANCIAL_YEAR_FORMAT": text("financial_year").rlike(r"\A\d{4}-\d{2}\z"),
        "RATE_NOT_NUMERIC": number("rate").isNotNull(),
        "RATE_NEGATIVE": number("rate") >= 0,
        "THRESHOLD_NOT_NUMERIC": (threshold == "") | number("threshold").isNotNull(),
        "THRESHOLD_NEGATIVE": (threshold == "") | (number("threshold") >= 0),
        "THRESHOLD_TYPE_UNSUPPORTED": F.upper(F.coalesce(F.nullif("threshold_type", F.lit("")), F.lit("NO_THRESHOLD"))).isin(*THRESHOLD_KINDS),
        "CALCULATION_BASE_UNSUPPORTED": F.upper(F.coalesce("calculation_base", F.lit(""))).isin(*BASES),
        "EFFECTIVE_RANGE_INVALID": start <= end,
        "VERSION_INVALID": version >= 1,
        "SOURCE_REQUIRED": (text("source") != "") & (text("source_reference") != ""),
    }
    first = F.coalesce(*(F.when(~F.coalesce(good, F.lit(False)), name) for name, good in checks.items()))
    own = rules.withColumn("error", first)
    active = F.coalesce("is_active", F.lit(True))
    scope = [section.alias("s"), F.col("financial_year").alias("fy"), start.alias("lo"), end.alias("hi"), F.col("rule_id").alias("other")]
    others = existing.filter(active).select(*(c.alias(f"_{n}") for c, n in zip(scope, ("s", "fy", "lo", "hi", "id"))))
    checked = own.filter(F.col("error").isNull() & active).select("rule_id", *scope[:4])
    met = (F.col("s") == F.col("_s")) & (F.col("fy") == F.col("_fy")) & (F.col("lo") <= F.col("_hi")) & (F.col("_lo") <= F.col("hi")) & ~F.col("rule_id").eqNullSafe(F.col("_id"))
    clashing = checked.join(others, met, "left_semi").select("rule_id").distinct().withColumn("_clash", F.lit("OVERLAPPING_ACTIVE_RULE"))
    return own.join(clashing, "rule_id", "left").withColumn("error", F.coalesce("error", "_clash")).drop("_clash")
