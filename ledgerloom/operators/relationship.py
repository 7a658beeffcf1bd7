"""Relating sales, the tax ledger and the statement to one another."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.amounts import MONEY, within_mutual_tolerance
from ..functions.text import compact_name, core_name, initialism
from ..sources.shared import by_whole_keys


def evidence(left: DataFrame, right: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(left_id, right_id, evidence): pairs with their first evidence in the order of the rules.

    Each rule (label, left column, right column) is an equi-join of its own, so no pair is looked at that nothing joins.
    """
    parts = []
    for i, (label, a, b) in enumerate(rules):
        x = left.select(F.col("id").alias("left_id"), F.col(a).alias("_k")).filter("_k is not null and cast(_k as string) != ''")
        y = right.select(F.col("id").alias("right_id"), F.col(b).alias("_k"))
        parts.append(x.join(y, "_k").select("left_id", "right_id", F.lit(i).alias("_tier"), F.lit(label).alias("evidence")))
    union = reduce(DataFrame.unionByName, parts)
    return union.groupBy("left_id", "right_id").agg(F.min_by("evidence", "_tier").alias("evidence"))


def with_names(rows: DataFrame, name: str = "name") -> DataFrame:
    """Adds the forms in which names are compared."""
    return rows.withColumns({"core": core_name(F.col(name)), "compact": compact_name(F.col(name)), "initials": initialism(F.col(name))})


def unique_assignment(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """The pairs whose left side has one candidate only."""
    return pairs.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(left))).filter("_n = 1").drop("_n")


def tiered_assignment(exact: DataFrame, review: DataFrame, left: str, right: str) -> DataFrame:
    """Unique exact assignments, and unique ones for review of what the exact ones left."""
    first = unique_assignment(exact, left, right).withColumn("tier", F.lit("EXACT"))
    rest = review.join(exact.select(left).distinct(), left, "left_anti")
    return first.unionByName(unique_assignment(rest, left, right).withColumn("tier", F.lit("REVIEW")))


def date_window(statements: DataFrame, sales: DataFrame, days: int, keys: list[str], spread: str = "sales") -> DataFrame:
    """Pairs of one key whose days are at most ``days`` apart, by buckets of days.

    statements, sales: (id, day, amount, *keys); back come s_ columns for sales.  spread: the side whose rows are put into
    every bucket that their window touches, two at most, better the smaller one; the other side's rows are in one each.
    """
    width = 4 * max(1, days)
    cell = lambda c, shift=0: F.floor((F.datediff(c, F.lit("1970-01-01").cast("date")) + shift) / width)
    every = lambda c: F.explode(F.array_distinct(F.array(cell(c, -days), cell(c, days))))
    of = lambda c, side: (every if spread == side else cell)(F.col(c))
    near = sales.select(*(F.col(c).alias(f"s_{c}") for c in ["id", "day", "amount", *keys]), of("day", "sales").alias("_there"))
    probe = statements.withColumn("_cell", of("day", "statements"))
    cond = F.col("_cell") == F.col("_there")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"s_{k}"))
    return probe.join(near, cond).filter(F.abs(F.datediff("day", "s_day")) <= days).drop("_cell", "_there")


def unique_window_matches(statements: DataFrame, sales: DataFrame, days: int, keys: list[str]) -> DataFrame:
    """(statement_id, sale_id): pairs in the window and tolerance that are the only one for both sides."""
    good = date_window(statements, sales, days, keys).filter(within_mutual_tolerance(F.col("amount"), F.col("s_amount")))
    n = lambda c: F.count(F.lit(1)).over(Window.partitionBy(c))
    single = good.withColumn("_a", n("id")).withColumn("_b", n("s_id")).filter("_a = 1 and _b = 1")
    return single.select(F.col("id").alias("statement_id"), F.col("s_id").alias("sale_id"))


def review_candidates(statements: DataFrame, sales: DataFrame, days: int, keys: list[str], keep: int = 50) -> DataFrame:
    """Up to ``keep`` candidates of each statement row, and whether either side has more than one."""
    good = date_window(statements, sales, days, keys).filter(within_mutual_tolerance(F.col("amount"), F.col("s_amount")))
    n = lambda c: F.count(F.lit(1)).over(Window.partitionBy(c))
    order = Window.partitionBy("id").orderBy(F.abs(F.col("amount") - F.col("s_amount")), F.abs(F.datediff("day", "s_day")), "s_id")
    ranked = good.withColumn("ambiguous", (n("id") > 1) | (n("s_id") > 1)).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= keep).select(F.col("id").alias("statement_id"), F.col("s_id").alias("sale_id"), "rank", "ambiguous")


def pair_sums(statements: DataFrame, sales: DataFrame, days: int, keys: list[str]) -> DataFrame:
    """(statement_id, first_sale, second_sale): the only pair of sales in the window that adds up to the statement row."""
    near = date_window(statements, sales, days, keys, "statements").select("id", "amount", "s_id", "s_amount")
    other = near.select(F.col("id").alias("_id"), F.col("s_id").alias("t_id"), F.col("s_amount").alias("t_amount"))
    pairs = near.join(other, (F.col("id") == F.col("_id")) & (F.col("s_id") < F.col("t_id")))
    fits = pairs.filter(within_mutual_tolerance(F.col("amount"), (F.col("s_amount") + F.col("t_amount")).cast(MONEY)))
    found = fits.groupBy("id").agg(F.count("*").alias("_n"), F.min("s_id").alias("first_sale"), F.min("t_id").alias("second_sale")).filter("_n = 1")
    return found.select(F.col("id").alias("statement_id"), "first_sale", "second_sale")


ALLOCATED = "key long, statement_id long, sale_id long, kind string"
#: Pairs of rows, or of pairs and a row, that a task weighs at once.
AT_ONCE = 1 << 20


def allocate(statements: DataFrame, sales: DataFrame, key: str, days: int = 7) -> DataFrame:
    """Consuming allocation for each key, each row in one allocation at most: one to one where unique, then one statement
    row to two sales, then two statement rows to one sale, then by day only.  Rows without an amount are in none.

    A task weighs the windows of many keys at once; only rows that something fits are then looked at one after another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in by_whole_keys(batches, ["key"]):
            left, right, kind = _allocated(table, cuts, days)
            at, other = pa.array(left, pa.int64()), pa.array(right, pa.int64())
            columns = [pc.take(table.column(c), i).combine_chunks() for c, i in (("key", at), ("id", at), ("id", other))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kind, pa.string())], names=["key", "statement_id", "sale_id", "kind"])

    def side(df: DataFrame, n: int) -> DataFrame:
        day, amount = F.datediff("day", F.lit("1970-01-01").cast("date")), F.col("amount").cast("double")
        rows = df.select(F.col(key).cast("long").alias("key"), F.lit(n).alias("side"), F.col("day").alias("at"), day.cast("long").alias("day"), F.col("id").cast("long").alias("id"), amount.alias("amount"))
        return rows.filter("day is not null and amount is not null and not isnan(amount)")

    rows = side(statements, 0).unionByName(side(sales, 1)).repartition("key").sortWithinPartitions("key", "side", "at", "id")
    return rows.drop("at").mapInArrow(run, ALLOCATED)


def _fits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.abs(x - y) <= np.maximum(10.0, np.maximum(np.maximum(np.abs(x), np.abs(y)), 1) / 100)


def _spread(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whose, place): the places lo to lo + n of each range, one after another."""
    whose = np.repeat(np.arange(len(n)), n)
    return whose, np.arange(len(whose)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _slices(weight: np.ndarray) -> Iterator[slice]:
    """Slices of rows in order whose weights sum to AT_ONCE at most, or that hold one row."""
    upto, lo = np.cumsum(weight), 0
    while lo < len(weight):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + AT_ONCE, "right")))
        yield slice(lo, hi)
        lo = hi


def _allocated(table: pa.Table, cuts: list[int], days: int) -> tuple[list[int], list[int], list[str]]:
    """Places of the statement rows and of the sales that are allocated, and the kinds; rows in the order of key, side, day and id."""
    side, day, amount = (table.column(c).to_numpy() for c in ("side", "day", "amount"))
    own, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    # days of different keys lie further apart than any window is wide
    group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    at = group * (int(day.max() - day.min()) + 2 * days + 2) + (day - day.min())
    amounts, days_ = (amount[own], amount[other]), (at[own], at[other])
    free = (np.ones(len(own), bool), np.ones(len(other), bool))
    windows = [(np.searchsorted(days_[1 - k], days_[k] - days), np.searchsorted(days_[1 - k], days_[k] + days, "right")) for k in (0, 1)]
    out: tuple[list[int], list[int], list[str]] = ([], [], [])

    def take(i: list[int], j: list[int], kind: str) -> None:
        free[0][i] = free[1][j] = False
        for x in i:
            for y in j:
                out[0].append(int(own[x]))
                out[1].append(int(other[y]))
                out[2].append(kind)

    def waiting(k: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rows of side k that are free and have at least so many free rows in their window, how many, the window's ends)."""
        upto = np.append(0, np.cumsum(free[1 - k]))
        n = upto[windows[k][1]] - upto[windows[k][0]]
        rows = np.flatnonzero(free[k] & (n >= least))
        return rows, n[rows], windows[k][0][rows], windows[k][1][rows]

    def only_pair(target: float, pool: np.ndarray, amounts: np.ndarray) -> list[int]:
        """The pair of the pool that adds up to the target, if there is just one."""
        found: list[int] = []
        for n, x in enumerate(pool[:-1]):
            hits = pool[n + 1 :][_fits(target, amounts[x] + amounts[pool[n + 1 :]])]
            if len(hits) + len(found) // 2 > 1:
                return []
            found += [p for y in hits for p in (x, y)]
        return found

    def in_turn(whose: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Each row and where its hits stand."""
        starts = np.flatnonzero(np.append(True, whose[1:] != whose[:-1])) if len(whose) else np.zeros(0, int)
        for lo, hi in zip(starts, np.append(starts[1:], len(whose))):
            yield whose[lo], slice(lo, hi)

    rows, _, lo, hi = waiting(0, 1)
    for part in _slices(hi - lo):
        mine, (whose, j) = rows[part], _spread(lo[part], (hi - lo)[part])
        good = free[1][j] & _fits(amounts[0][mine[whose]], amounts[1][j])
        whose, j = whose[good], j[good]
        for w, hits in in_turn(whose):
            left = j[hits][free[1][j[hits]]]
            if len(left) == 1:
                take([mine[w]], [left[0]], "ONE_TO_ONE")
    for k, kind in ((0, "ONE_TO_TWO"), (1, "TWO_TO_ONE")):
        rows, n, lo, hi = waiting(k, 2)
        pool, worth = free[1 - k], amounts[1 - k]
        put = lambda i, pair: take([i], pair, kind) if k == 0 else take(pair, [i], kind)  # noqa: B023, E731
        for part in _slices(np.maximum(n * (n - 1) // 2, hi - lo)):
            mine = rows[part]
            if len(mine) == 1 and n[part][0] ** 2 > 2 * AT_ONCE:
                near = lo[part][0] + np.flatnonzero(pool[lo[part][0] : hi[part][0]])
                if pair := only_pair(amounts[k][mine[0]], near, worth):
                    put(mine[0], pair)
                continue
            whose, j = _spread(lo[part], (hi - lo)[part])
            whose, j = whose[pool[j]], j[pool[j]]
            ends = np.searchsorted(whose, whose, "right")
            first, second = _spread(np.arange(1, len(j) + 1), ends - np.arange(1, len(j) + 1))
            good = _fits(amounts[k][mine[whose[first]]], worth[j[first]] + worth[j[second]])
            first, second = first[good], second[good]
            for w, hits in in_turn(whose[first]):
                x, y = j[first[hits]], j[second[hits]]
                still = np.flatnonzero(pool[x] & pool[y])
                if len(still) == 1:
                    put(mine[w], [x[still[0]], y[still[0]]])
    rows, _, lo, hi = waiting(0, 1)
    for i, a, b in zip(rows.tolist(), lo.tolist(), hi.tolist()):
        near = np.flatnonzero(free[1][a:b]) if b - a > 8 else [x for x in range(b - a) if free[1][a + x]]
        if len(near) == 1:
            take([i], [a + int(near[0])], "DATE_ONLY")
    return out


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that is reachable over the edges (a, b).

    Each round takes the smallest label around a node and then that label's own, so a chain's length falls by half; it
    goes on until no label changes.  Labels are written at every round to the session's checkpoint folder, so the plan
    doesn't grow.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        down = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("next"))
        own = labels.select(F.col("node").alias("next"), F.col("component").alias("further"))
        moved = down.join(own, "next", "left").select("node", "component", F.least("next", "further").alias("new")).checkpoint()
        labels = moved.select("node", F.col("new").alias("component"))
        if moved.filter("component != new").isEmpty():
            return labels


def overall_status(identity: Column, amount: Column, tax: Column) -> Column:
    return (
        F.when(identity == "CONFLICT", "IDENTITY_CONFLICT")
        .when(identity != "CONFIRMED", "IDENTITY_REVIEW_REQUIRED")
        .when((amount == "MATCHED") & (tax == "MATCHED"), "FULLY_RECONCILED")
        .when((amount == "DIFFERENCE") & (tax == "DIFFERENCE"), "COMBINED_EXCEPTION")
        .when(amount == "DIFFERENCE", "AMOUNT_EXCEPTION")
        .when(tax == "DIFFERENCE", "TDS_EXCEPTION")
        .otherwise("REVIEW_REQUIRED")
    )
