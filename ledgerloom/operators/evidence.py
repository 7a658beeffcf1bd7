"""Evidence: what relates sales, the tax ledger and the statement, and what deposit and government records are worth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.amounts import MONEY, strict_sum, within_mutual_tolerance
from ..functions.dates import financial_year, quarter
from ..functions.text import NAME_STOPWORDS, blank_to_null, is_tan
from . import classes

# Words that are left out of acronyms, and of names that are aligned word by word.
ACRONYM_WORDS = ("A", "AN", "AND", "OF", "THE", "PRIVATE", "LIMITED", "PVT", "LTD")
ALIGNED_WORDS = (*ACRONYM_WORDS, "UNIT")


# -- relating parties ---------------------------------------------------------------------------------------------


def tds_statement_evidence(ledger: DataFrame, statements: DataFrame) -> DataFrame:
    """(left_id, right_id, evidence) of ledger and statement rows (id, tan, core, compact): an equal TAN, an equal name
    (a conflict where both name a TAN and differ), an equal name without blanks."""
    names = ("tan", "core", "compact")
    x, y = (df.select("id", F.struct(*(F.nullif(F.col(c), F.lit("")).alias(c) for c in names)).alias("class")).distinct() for df in (ledger, statements))
    of = lambda df, side, p: df.select(F.col("class").alias(side)).distinct().select(side, *(F.col(f"{side}.{c}").alias(f"{p}_{c}") for c in names))
    a, b = of(x, "left", "a"), of(y, "right", "b")
    same = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in names]
    # a pair comes from the first of the columns that are equal, so from one only
    found = [a.join(b, reduce(lambda m, e: m & ~F.coalesce(e, F.lit(False)), same[:i], s)) for i, s in enumerate(same)]
    pairs = reduce(DataFrame.unionByName, found)
    label = (
        F.when(F.col("a_tan") == F.col("b_tan"), "EXACT_TAN")
        .when(F.col("a_core") == F.col("b_core"), F.when(F.col("a_tan").isNotNull() & ~F.col("a_tan").eqNullSafe(F.col("b_tan")), "CONFLICTING_TAN").otherwise("EXACT_TDS_DEDUCTOR_NAME"))
        .otherwise("COMPACT_NORMALIZED_NAME")
    )
    return classes.spelt_out(pairs.select("left", "right", label.alias("evidence")), x, y)


# The evidence between a sale and a statement row, strongest first, with the columns that must be equal.
SALES_STATEMENT = [("26AS_EXPLICIT_PAN", "pan", "pan"), ("EXACT_SALES_DEDUCTOR_NAME", "core", "core"), ("COMPACT_NORMALIZED_SALES_NAME", "compact", "compact")]
# The evidence between a sale and a ledger row.
SALES_TDS = [("EXACT_PAN", "pan", "pan"), ("EXACT_GSTIN", "gstin", "gstin"), ("EXACT_REFERENCE", "reference", "reference"), ("EXACT_NORMALIZED_NAME", "core", "core")]


def tds_review(ledger: Column, statement: Column) -> Column:
    """Why two core names may be one party without proof: shared words, containment, an acronym."""
    a, b = F.array_distinct(F.split(ledger, " ")), F.split(statement, " ")
    initials = F.array_join(F.transform(F.filter(b, lambda w: ~w.isin(*ACRONYM_WORDS) & (F.length(w) > 1)), lambda w: F.substring(w, 1, 1)), "")
    lead = F.element_at(F.split(ledger, " "), 1)
    return (
        F.when(F.size(F.array_intersect(a, b)) >= 2, "PARTIAL_NORMALIZED_NAME").when((ledger != "") & (F.size(F.array_except(a, b)) == 0), "NAME_PREFIX_VARIANT")
        .when(F.length(lead).between(3, 8) & initials.startswith(lead), "ACRONYM_FAMILY_CANDIDATE")
    )


def aligned_words(statement: Column, sales: Column) -> Column:
    """How many of the statement's words stand in the sale's in the same order, up to the first that does not; a word also
    stands for one that begins with it, from five letters on."""
    a, b = (F.filter(F.split(c, " "), lambda w: ~w.isin(*ALIGNED_WORDS)) for c in (statement, sales))
    same = lambda x, y: (x == y) | ((F.least(F.length(x), F.length(y)) >= 5) & (x.startswith(y) | y.startswith(x)))

    def step(acc: Column, word: Column) -> Column:
        rest = F.slice(b, acc["at"] + 1, F.greatest(F.size(b), F.lit(1)))
        hit = F.array_position(F.transform(rest, lambda x: same(word, x)), True).cast("int")
        return F.when(acc["open"] & (hit > 0), F.struct((acc["at"] + hit).alias("at"), (acc["n"] + 1).alias("n"), F.lit(True).alias("open"))).otherwise(
            F.struct(acc["at"].alias("at"), acc["n"].alias("n"), F.lit(False).alias("open"))
        )

    return F.aggregate(a, F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(True).alias("open")), step, lambda acc: acc["n"])


def sales_review(sales: Column, statement: Column) -> Column:
    """Why a sale's customer and a deductor may be one party: aligned words with the same first one, or shared words."""
    inner = lambda c: F.filter(F.split(c, " "), lambda w: ~w.isin(*ALIGNED_WORDS))
    telling = lambda c: F.filter(F.split(c, " "), lambda w: ~w.isin(*NAME_STOPWORDS))
    shared = F.array_intersect(telling(sales), telling(statement))
    embedded = (aligned_words(statement, sales) >= 2) & (F.get(inner(statement), F.lit(0)) == F.get(inner(sales), F.lit(0)))
    return F.when(embedded, "EMBEDDED_DEDUCTOR_NAME_VARIANT").when((F.size(shared) >= 2) | F.exists(shared, lambda w: F.length(w) >= 6), "PARTIAL_NORMALIZED_SALES_NAME")


def anchor_links(proven: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(anchor_id, sale_id, link) from pairs (anchor_id, sale_id): LINKED by any evidence, else CANDIDATE; a sale may have
    several anchors."""
    link = proven.select("anchor_id", "sale_id").distinct()
    rest = reviewed.select("anchor_id", "sale_id").distinct().join(link, ["anchor_id", "sale_id"], "left_anti")
    return link.withColumn("link", F.lit("LINKED")).unionByName(rest.withColumn("link", F.lit("CANDIDATE")))


def relationship_identity(sales: Column, ledger: Column, statements: Column, evidence: Column, anchored: Column, by_name: Column) -> tuple[Column, Column]:
    """(status, method) of a relationship with so many rows on each side and this array of evidence."""
    has = lambda *names: F.arrays_overlap(evidence, F.array(*map(F.lit, names)))
    s, t, f = sales > 0, ledger > 0, statements > 0
    proven = has("EXACT_PAN", "EXACT_GSTIN", "EXACT_REFERENCE", "26AS_EXPLICIT_PAN") & has("EXACT_TAN", "EXACT_TDS_DEDUCTOR_NAME")
    joined = F.array_join(F.sort_array(F.array_distinct(evidence)), "__")
    ladder = [
        (has("CONFLICTING_TAN"), "CONFLICT", F.lit("CONFLICTING_TAN")),
        (anchored & f & (~s | ~t), "CONFIRMED", F.lit("26AS_SOURCE_TAN_NAME_FY")),
        (s & f & has("26AS_EXPLICIT_PAN"), "CONFIRMED", F.lit("26AS_EXPLICIT_PAN")),
        (s & f & ~t & has("EXACT_SALES_DEDUCTOR_NAME"), "REVIEW_REQUIRED", F.lit("EXACT_SALES_DEDUCTOR_NAME")),
        (~s | ~t | ~f, "UNMAPPED", F.lit("INCOMPLETE_RELATIONSHIP")),
        (proven & has("EXACT_PAN") & has("EXACT_TAN"), "CONFIRMED", F.lit("TDS_PAN_TO_TAN")),
        (proven, "CONFIRMED", joined),
        (by_name, "CONFIRMED", F.lit("EXACT_NAME_POLICY")),
        (F.lit(True), "REVIEW_REQUIRED", F.coalesce(F.nullif(joined, F.lit("")), F.lit("NONE"))),
    ]
    return F.coalesce(*(F.when(c, F.lit(x)) for c, x, _ in ladder)), F.coalesce(*(F.when(c, m) for c, _, m in ladder))


def tds_check(ledger_rows: Column, candidates: Column, statement_rows: Column, ledger: Column, stated: Column) -> tuple[Column, Column, Column]:
    """(comparison, reconciliation, identity) of a relationship's ledger and statement amounts."""
    t, c, f = ledger_rows > 0, candidates > 0, statement_rows > 0
    unknown = ledger.isNull() | stated.isNull()
    agrees = within_mutual_tolerance(ledger, stated)
    comparison = F.when(t & ~f, "MISSING_IN_26AS").when(t & unknown, "TDS_NOT_DETERMINABLE").when(t & agrees, "TDS_MATCHED").when(t, "TDS_DIFFERENCE").otherwise("MISSING_IN_TDS")
    reconciliation = (
        F.when(t & ~f, "MISSING_IN_26AS").when(t & unknown, "NOT_DETERMINABLE").when(t & agrees, "MATCHED").when(t, "DIFFERENCE").when(c, "REVIEW_REQUIRED").otherwise("MISSING_TDS_LEDGER_COUNTERPART")
    )
    return comparison, reconciliation, F.when(t, "CONFIRMED").when(c, "REVIEW_REQUIRED").otherwise("UNMAPPED")


def sales_coverage(sales: DataFrame, linked: DataFrame) -> DataFrame:
    """One row on how many of the sales' customers (id, customer, taxable) have a counterpart, and what the others amount to."""
    rows = sales.join(linked.select("id").distinct().withColumn("_linked", F.lit(True)), "id", "left").withColumn("_linked", F.coalesce("_linked", F.lit(False)))
    return rows.agg(
        F.countDistinct("customer").alias("customers_total"), F.countDistinct(F.when(F.col("_linked"), F.col("customer"))).alias("customers_linked"),
        F.countDistinct(F.when(~F.col("_linked"), F.col("customer"))).alias("customers_without_counterpart"), F.count_if(~F.col("_linked")).alias("rows_excluded"),
        F.sum(F.when(~F.col("_linked"), F.col("taxable"))).cast(MONEY).alias("taxable_excluded"),
    )


# -- deposits, government records, periods ------------------------------------------------------------------------


def deposit_issues(rows: DataFrame, assignment_fy: str | None = None, assignment_tan: str | None = None) -> DataFrame:
    """Deposit evidence with its issues and status; of rows with one reference and challan all but the first are marked.

    rows: (row_no, deposit_id, challan, tan, financial_year, tds_amount, interest_amount, fee_amount, total_amount).
    """
    parts = ("tds_amount", "interest_amount", "fee_amount")
    tan = F.upper(blank_to_null(F.col("tan")))
    key = blank_to_null(F.col("deposit_id")), blank_to_null(F.col("challan"))
    again = key[0].isNotNull() & key[1].isNotNull() & (F.row_number().over(Window.partitionBy(*key).orderBy("row_no")) > 1)
    complete = reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in (*parts, "total_amount")))
    gap = F.abs(F.col("total_amount") - F.col("tds_amount") - F.col("interest_amount") - F.col("fee_amount"))
    issue = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
    hard = F.array_compact(F.array(*(issue(F.col(c) < 0, f"{c} is negative") for c in (*parts, "total_amount")), issue(tan.isNotNull() & ~is_tan(tan), "TAN format is invalid")))
    soft = F.array_compact(F.array(
        issue(F.lit(assignment_fy).isNotNull() & (F.col("financial_year") != F.lit(assignment_fy)), "financial year is not the assignment's"),
        issue(F.lit(assignment_tan).isNotNull() & (tan != F.lit(assignment_tan)), "TAN is not the assignment's"),
        issue(complete & (gap > F.lit("0.01").cast(MONEY)), "total is not the sum of its parts"), issue(F.col("tds_amount").isNull(), "TDS amount is not provided"), issue(again, "duplicate deposit reference"),
    ))
    return rows.withColumns({"duplicate": again, "issues": F.concat(hard, soft), "validation_status": F.when(F.size(hard) > 0, "INVALID").when(F.size(soft) > 0, "REVIEW_REQUIRED").otherwise("VALID")})


def government_issues(rows: DataFrame) -> DataFrame:
    """Government summary rows (row_no, serial, name, tan, amount_paid, tax_deducted, tds_deposited as text): numbers and
    names that are unusable make a row INVALID, one that repeats in all its fields is kept with a WARNING."""
    fields = ("serial", "name", "tan", "amount_paid", "tax_deducted", "tds_deposited")
    given = {c: blank_to_null(F.col(c)) for c in fields}
    issue = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
    number = lambda c: F.regexp_replace(c, r"[₹,\s]", "").try_cast("decimal(18,2)")
    any_ = reduce(lambda x, y: x | y, (c.isNotNull() for c in given.values()))
    again = any_ & (F.count(F.lit(1)).over(Window.partitionBy(*(F.coalesce(c, F.lit("")) for c in given.values()))) > 1)
    hard = F.array_compact(F.array(
        issue(given["serial"].isNotNull() & ~given["serial"].rlike(r"^\d+(\.0+)?$"), "serial is invalid"), issue(given["name"].isNull(), "name is not provided"),
        issue(given["tan"].isNotNull() & ~is_tan(F.upper(given["tan"])), "TAN is invalid"), *(issue(given[c].isNotNull() & number(given[c]).isNull(), f"{c} is not numeric") for c in fields[3:]),
    ))
    return rows.withColumns({"issues": F.concat(hard, F.array_compact(F.array(issue(again, "duplicate row")))), "row_status": F.when(F.size(hard) > 0, "INVALID").when(again, "WARNING").otherwise("VALID")})


def in_period(row_fy: Column, row_quarter: Column, event: Column, fy: str | None, wanted_quarter: str | None) -> Column:
    """Whether a record may belong to the period: what it states and what its day says must not contradict it."""
    ok = F.lit(True)
    if fy:
        ok = ok & F.coalesce(row_fy == fy, F.lit(True)) & F.coalesce(financial_year(event) == fy, F.lit(True))
    if wanted_quarter:
        ok = ok & F.coalesce(row_quarter == wanted_quarter, F.lit(True)) & F.coalesce(quarter(event) == wanted_quarter, F.lit(True))
    return ok


def government_control(assignments: DataFrame, government: DataFrame, calculated: DataFrame) -> DataFrame:
    """Each assignment's identity, period and total against the government's rows, and all three together.

    assignments: (assignment, tan, fy); government: (assignment, tan, fy, tax); calculated: (assignment, fy, actual).
    """
    g = government.groupBy("assignment").agg(F.sort_array(F.collect_set(F.upper("tan"))).alias("tans"), F.max("fy").alias("government_fy"), F.sum("tax").cast(MONEY).alias("government_tax"))
    own = calculated.join(assignments.select("assignment", F.col("fy").alias("_fy")), "assignment").filter("fy is null or fy = _fy")
    c = own.groupBy("assignment").agg(strict_sum(F.col("actual")).cast(MONEY).alias("internal_tax"), F.lit(True).alias("_run"))
    t = assignments.join(g, "assignment", "left").join(c, "assignment", "left")
    tan = blank_to_null(F.upper(F.col("tan")))
    none = tan.isNull() | F.coalesce(F.size("tans") <= 0, F.lit(True))
    who = F.when(none, "IDENTITY_NOT_DETERMINABLE").when(F.col("tans") == F.array(tan), "IDENTITY_SUPPORTED").otherwise("IDENTITY_REVIEW_REQUIRED")
    when_ = F.when(F.col("government_fy").isNull(), "PERIOD_NOT_DETERMINABLE").when(F.col("government_fy").eqNullSafe(F.col("fy")), "PERIOD_SUPPORTED").otherwise("PERIOD_REVIEW_REQUIRED")
    total = (
        F.when(F.col("_run").isNull() | F.col("government_tax").isNull(), "NOT_DETERMINABLE").when(F.col("internal_tax").isNull(), "TDS_CONTROL_REVIEW")
        .when(F.col("internal_tax") == F.col("government_tax"), "TDS_CONTROL_MATCH").otherwise("TDS_CONTROL_DIFFERENCE")
    )
    t = t.withColumns({"identity_status": who, "period_status": when_, "control_status": total})
    i, p, x = F.col("identity_status"), F.col("period_status"), F.col("control_status")
    overall = (
        F.when(i == "IDENTITY_REVIEW_REQUIRED", i).when(p == "PERIOD_REVIEW_REQUIRED", p).when(x == "TDS_CONTROL_DIFFERENCE", x)
        .when((i == "IDENTITY_SUPPORTED") & (p == "PERIOD_SUPPORTED") & (x == "TDS_CONTROL_MATCH"), "SUPPORTED")
        .when((i == "IDENTITY_NOT_DETERMINABLE") & (p == "PERIOD_NOT_DETERMINABLE") & (x == "NOT_DETERMINABLE"), "NOT_DETERMINABLE").otherwise("PARTIALLY_SUPPORTED")
    )
    return t.select("assignment", "identity_status", "period_status", "control_status", overall.alias("overall"), "internal_tax", "government_tax")


def last_of_each(rows: DataFrame, key: list[str], position: str) -> DataFrame:
    """Of rows with one key the last, whole: what a lookup finds where a later row replaces an earlier one."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in key)), position).alias("_r")).select(*key, "_r.*")


def established_total(rows: DataFrame, by: list[str]) -> DataFrame:
    """Totals of evidence (evidence_id, position, relation, status, amount) that counts each piece once, its last mention,
    and only where its relation is established and it is not invalid."""
    once = last_of_each(rows, [*by, "evidence_id"], "position")
    good = once.filter("relation = 'ESTABLISHED' and status != 'INVALID'")
    return good.groupBy(*by).agg(F.sum("amount").cast(MONEY).alias("total"), F.count("*").alias("pieces"))


def challan_evidence(challans: DataFrame, evidence: DataFrame) -> DataFrame:
    """(challan_id, evidence_id, match): by serial or, without one, by batch; only what is the one fit of either side."""
    key = lambda df: F.coalesce(F.concat(F.lit("s:"), blank_to_null(F.col("serial"))), F.concat(F.lit("b:"), blank_to_null(F.col("batch"))))
    sides = (df.select(F.col("id").alias(name), key(df).alias("_k")).filter("_k is not null") for df, name in ((challans, "challan_id"), (evidence, "evidence_id")))
    a, b = (df.groupBy("_k").agg(F.min(df.columns[0]).alias(df.columns[0]), F.count("*").alias(f"_n{i}")) for i, df in enumerate(sides))
    both = a.join(b, "_k").filter("_n0 = 1 and _n1 = 1").select("challan_id", "evidence_id")
    return challans.select(F.col("id").alias("challan_id")).join(both, "challan_id", "left").withColumn("match", F.when(F.col("evidence_id").isNotNull(), "MATCHED").otherwise("REVIEW_REQUIRED"))


def tan_summary(results: DataFrame) -> DataFrame:
    """Per TAN of the results' statement entries: counts and totals, an entry counting for a statement's own row or the
    first book of its group; who it belongs to is what the last row says.

    results: (seq, source, transaction_id, customer, identity, result, books, entries: array of (tan, deductor, deducted, deposited)).
    """
    e = results.select("*", F.explode("entries").alias("e"))
    counts = (F.col("source") == "26AS") | F.coalesce(F.get("books", F.lit(0)) == F.col("transaction_id"), F.lit(False))
    total = lambda c: F.coalesce(F.sum(F.when(counts, F.col(c))), F.lit(0)).cast(MONEY)
    return e.groupBy(F.col("e.tan").alias("tan")).agg(
        *(F.max_by(c, "seq").alias(n) for c, n in (("e.deductor", "deductor"), ("customer", "customer"), ("identity", "identity"))), F.count_if(counts).alias("entries"),
        total("e.deducted").alias("deducted"), total("e.deposited").alias("deposited"), F.count_if(counts & F.col("result").isin("MATCHED_CLAIMABLE", "MATCHED_NOT_CLAIMABLE")).alias("matched"),
    )
