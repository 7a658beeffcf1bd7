"""Matching the books with a statement.

What doesn't depend on order is joins: candidates within a tolerance, the nearest amount, totals of a scope.  Consuming
matches one after another does: same quarter first, then other quarters, then one to many, many to one and totals, then
the nearest.  No match crosses a customer and financial year, so these run by themselves (``match_small``);
``plans.greedy`` matches those with more rows than one task should take in slabs of amounts, with the same steps.

A null amount counts as 0 and a null quarter as none; rows without a customer or year match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.amounts import MONEY, within_tolerance
from ..sources.shared import by_whole_keys, kept


def tolerance_candidates(books: DataFrame, statements: DataFrame, same_quarter: bool = True) -> DataFrame:
    """(book_id, statement_id, difference): pairs of one customer and year, and quarter, within the tolerance.

    books, statements: (id, customer, fy, quarter, amount).
    """
    b = books.select(*(F.col(c).alias(f"b_{c}") for c in ("id", "customer", "fy", "quarter", "amount")))
    s = statements.select(*(F.col(c).alias(f"s_{c}") for c in ("id", "customer", "fy", "quarter", "amount")))
    cond = (F.col("b_customer") == F.col("s_customer")) & (F.col("b_fy") == F.col("s_fy"))
    cond = cond & ((F.col("b_quarter") == F.col("s_quarter")) if same_quarter else (F.col("b_quarter") != F.col("s_quarter")))
    joined = b.join(s, cond & within_tolerance(F.col("b_amount"), F.col("s_amount")))
    return joined.select(F.col("b_id").alias("book_id"), F.col("s_id").alias("statement_id"), (F.col("b_amount") - F.col("s_amount")).cast(MONEY).alias("difference"))


def range_join(left: DataFrame, right: DataFrame, key: list[str], value: str, width: float) -> DataFrame:
    """Pairs of equal keys whose values lie at most ``width`` apart, by buckets: no key's rows meet all others.

    Both sides have key and value; the right side's columns come back with the prefix ``r_``.
    """
    cell = F.floor(F.col(value) / width)
    near = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns)).withColumn("_cell", F.floor(F.col(f"r_{value}") / width))
    probe = left.withColumn("_cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    cond = F.col("_cell") == F.col("_rcell")
    for k in key:
        cond = cond & (F.col(k) == F.col(f"r_{k}"))
    joined = probe.join(near.withColumnRenamed("_cell", "_rcell"), cond)
    return joined.filter(F.abs(F.col(value) - F.col(f"r_{value}")) <= width).drop("_cell", "_rcell")


def nearest(books: DataFrame, statements: DataFrame) -> DataFrame:
    """The statement row of the same customer and year nearest to each book's amount; ties to the smaller id.

    Both sides lie in one table sorted by amount over ranges, so a customer and year with many rows is spread over tasks;
    a book's nearest rows are the last one before and the first one after it, which may lie in another part.  No pair is
    ever made.  Rows without an amount take no part.
    """
    none = F.lit(None)
    s = statements.filter("amount is not null").groupBy(*KEY, "amount").agg(F.min("id").alias("statement_id"))
    s = s.select(*KEY, "amount", F.lit(0).alias("side"), none.cast(books.schema["id"].dataType).alias("book_id"), "statement_id")
    b = books.filter("amount is not null").select(*KEY, "amount", F.lit(1).alias("side"), F.col("id").alias("book_id"), none.cast(statements.schema["id"].dataType).alias("statement_id"))
    rows = s.unionByName(b).filter("customer is not null and fy is not null")
    # computed once: planned twice, the parts' numbers would differ between the rows and the list of parts
    placed = kept(rows.repartitionByRange(*KEY, "amount", "side").withColumn("_part", F.spark_partition_id()))
    own = F.when(F.col("side") == 0, F.struct(F.col("amount").alias("other"), "statement_id"))
    w = Window.partitionBy(*KEY, "_part").orderBy("amount", "side")
    near = placed.withColumn("_below", F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    near = near.withColumn("_above", F.first(own, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    # a row for each part that a customer and year lies in
    parts = placed.groupBy(*KEY, "_part").agg(F.min(own).alias("_least"), F.max(own).alias("_most"))
    w = Window.partitionBy(*KEY).orderBy("_part")
    parts = parts.withColumn("_before", F.last("_most", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    parts = parts.withColumn("_after", F.first("_least", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    found = near.filter("side = 1").join(parts.select(*KEY, "_part", "_before", "_after"), [*KEY, "_part"])
    gap = lambda c: F.when(c.isNotNull(), F.struct(F.abs(F.col("amount") - c["other"]).alias("gap"), c["statement_id"].alias("statement_id")))
    best = F.least(gap(F.coalesce("_below", "_before")), gap(F.coalesce("_above", "_after")))
    found = found.withColumn("_best", best).filter("_best is not null")
    return found.select("book_id", F.col("_best.statement_id").alias("statement_id"), F.col("_best.gap").cast(MONEY).alias("difference"))


def scope_totals(books: DataFrame, statements: DataFrame, scope: list[str]) -> DataFrame:
    """Scopes whose totals agree within the tolerance and that hold more than two rows on both sides together."""
    of = lambda df, p: df.groupBy(*scope).agg(F.sum("amount").cast(MONEY).alias(f"{p}_total"), F.count("*").alias(f"{p}_rows"))
    both = of(books, "book").join(of(statements, "statement"), scope)
    return both.filter(within_tolerance(F.col("book_total"), F.col("statement_total")) & (F.col("book_rows") + F.col("statement_rows") > 2))


@dataclass(frozen=True)
class Terms:
    """What a client configures: tolerances, how far the search for groups goes, and how many rows one task takes whole.

    scope: rows of both sides beyond which only totals are compared.  pool, group: rows that sums are tried over, and the
    most that one sum takes.  rows: rows of a customer and year beyond which they are matched in slabs.
    """

    absolute: float = 10.0
    percent: float = 1.0
    scope: int = 500
    pool: int = 14
    group: int = 6
    rows: int = 20_000

    def tolerance(self, cents: np.ndarray) -> np.ndarray:
        return np.maximum(self.absolute * 100, np.abs(cents) * self.percent / 100)


KEY = ["customer", "fy"]


@lru_cache(None)
def _choices(pool: int, group: int) -> np.ndarray:
    """All choices of 2 to ``group`` of ``pool`` places, smaller ones first, a row for each, filled up with the place ``pool``."""
    every = [c for size in range(2, min(pool, group) + 1) for c in combinations(range(pool), size)]
    out = np.full((len(every), group), pool)
    for row, c in zip(out, every):
        row[: len(c)] = c
    return out


def _subset(pool: np.ndarray, cents: np.ndarray, target: int, terms: Terms) -> np.ndarray | None:
    """The first choice of the rows of the pool nearest to the target whose sum agrees with it."""
    if len(pool) < 2:
        return None
    own, tol = cents[pool], terms.tolerance(target)
    if len(pool) > terms.pool:
        near = np.sort(np.argsort(np.abs(own - target), kind="stable")[: terms.pool])
        pool, own = pool[near], own[near]
    ordered = np.sort(own)
    if ordered[0] >= 0 and (ordered[-terms.group :].sum() < target - tol or ordered[:2].sum() > target + tol):
        return None  # even the largest rows sum to less, or the two smallest to more
    choices = _choices(len(pool), terms.group)
    fits = np.abs(target - np.append(own, 0)[choices].sum(1)) <= tol
    at = int(np.argmax(fits))
    return pool[choices[at][choices[at] < len(pool)]] if fits[at] else None


class Scope:
    """Books and statement rows that are matched with each other, each in the order of their ids; amounts in cents.

    Sections are numbers, those of blank ones negative: a blank section never agrees.  ``found`` holds (method, books,
    statement rows) by their places.
    """

    def __init__(self, books: tuple[np.ndarray, ...], statements: tuple[np.ndarray, ...], terms: Terms) -> None:
        self.bc, self.bq, self.bs = books
        self.sc, self.sq, self.ss = statements
        self.terms = terms
        self.free_b, self.free_s = np.ones(len(self.bc), bool), np.ones(len(self.sc), bool)
        self.turn = np.argsort(-self.bc, kind="stable")
        self.found: list[tuple[str, np.ndarray, np.ndarray]] = []

    def record(self, method: str, left: np.ndarray, right: np.ndarray) -> None:
        self.free_b[left] = False
        self.free_s[right] = False
        self.found.append((method, left, right))

    def exact(self, same: bool) -> None:
        """Larger books first, each takes the best row within its tolerance."""
        order = np.argsort(self.sc, kind="stable")  # for the window of amounts around a book's
        ordered, tol = self.sc[order], self.terms.tolerance(self.bc)
        lo, hi = np.searchsorted(ordered, self.bc - tol), np.searchsorted(ordered, self.bc + tol, "right")
        method = f"EXACT_1_TO_1_{'SAME' if same else 'OUTSIDE'}_QUARTER"
        for i in self.turn[(self.free_b & (lo < hi))[self.turn]]:
            near = order[lo[i] : hi[i]]
            near = near[self.free_s[near] & ((self.sq[near] == self.bq[i]) == same)]
            if not len(near):
                continue
            agrees = near[(self.ss[near] == self.bs[i]) & (self.bs[i] >= 0)]
            near = agrees if len(agrees) else near
            for distance in ([] if same else [np.abs(self.sq[near] - self.bq[i])]):
                near = near[distance == distance.min()]
            gap = np.abs(self.sc[near] - self.bc[i])
            self.record(method, np.array([i]), near[gap == gap.min()].min(keepdims=True))

    def groups(self, left: np.ndarray, right: np.ndarray, method: str) -> None:
        """One to many, many to one, then all that is left by its totals; left and right: places in order."""
        if len(left) + len(right) <= self.terms.scope:
            for i in left[np.argsort(-self.bc[left], kind="stable")]:
                if (sums := _subset(right[self.free_s[right]], self.sc, self.bc[i], self.terms)) is not None:
                    self.record(method, np.array([i]), sums)
            for j in right[np.argsort(-self.sc[right], kind="stable")]:
                if self.free_s[j] and (sums := _subset(left[self.free_b[left]], self.bc, self.sc[j], self.terms)) is not None:
                    self.record(method, sums, np.array([j]))
        left, right = left[self.free_b[left]], right[self.free_s[right]]
        total = self.bc[left].sum()
        if len(left) and len(right) and len(left) + len(right) > 2 and abs(total - self.sc[right].sum()) <= self.terms.tolerance(total):
            self.record(method, left, right)

    def closest(self, same: bool) -> None:
        """Larger books first, each takes the nearest row that is left, however far."""
        for i in self.turn[self.free_b[self.turn]]:
            at = np.flatnonzero(self.free_s & (self.sq == self.bq[i]) if same else self.free_s)
            if len(at):
                self.record("AMOUNT_MISMATCH", np.array([i]), at[[np.argmin(np.abs(self.sc[at] - self.bc[i]))]])

    def all_steps(self) -> None:
        for same in (True, False):
            self.exact(same)
        for q in (1, 2, 3, 4):
            left, right = np.flatnonzero(self.free_b & (self.bq == q)), np.flatnonzero(self.free_s & (self.sq == q))
            if len(left) and len(right):
                self.groups(left, right, "GROUP_SAME_QUARTER")
        self.groups(np.flatnonzero(self.free_b), np.flatnonzero(self.free_s), "GROUP_OUTSIDE_QUARTER")
        for same in (True, False):
            self.closest(same)


#: Rows of a scope up to which plain lists are quicker than arrays, and amounts in cents up to which both are exact.
FEW, EXACT_CENTS = 64, 1 << 52


def _sum_of_few(pool: list[int], cents: list[int], target: int, terms: Terms) -> list[int] | None:
    """``_subset`` over lists: sizes whose smallest and largest sums leave the target out are not tried."""
    if len(pool) < 2:
        return None
    tol = max(terms.absolute * 100, abs(target) * terms.percent / 100)
    if len(pool) > terms.pool:
        pool = sorted(sorted(pool, key=lambda k: abs(cents[k] - target))[: terms.pool])
    ordered = sorted(cents[k] for k in pool)
    if ordered[0] >= 0 and (sum(ordered[-terms.group :]) < target - tol or ordered[0] + ordered[1] > target + tol):
        return None
    sizes = [n for n in range(2, min(len(pool), terms.group) + 1) if sum(ordered[:n]) - target <= tol and target - sum(ordered[-n:]) <= tol]
    if sizes and len(pool) > 7:
        found = _subset(np.array(pool), np.array(cents), target, terms)
        return None if found is None else found.tolist()
    for n in sizes:
        for c in combinations(pool, n):
            if abs(target - sum([cents[k] for k in c])) <= tol:
                return list(c)
    return None


def match_few(books: tuple[list[int], ...], statements: tuple[list[int], ...], terms: Terms) -> list[tuple[str, list[int], list[int]]]:
    """What ``Scope.all_steps`` finds, over lists, for scopes of few rows."""
    (bc, bq, bs), (sc, sq, ss) = books, statements
    free_b, free_s, found = [True] * len(bc), [True] * len(sc), []
    turn = sorted(range(len(bc)), key=lambda i: -bc[i])

    def record(method: str, left: list[int], right: list[int]) -> None:
        for i in left:
            free_b[i] = False
        for j in right:
            free_s[j] = False
        found.append((method, left, right))

    def groups(left: list[int], right: list[int], method: str) -> None:
        if len(left) + len(right) <= terms.scope:
            for i in sorted(left, key=lambda i: -bc[i]) if len(right) > 1 else ():
                if (sums := _sum_of_few([j for j in right if free_s[j]], sc, bc[i], terms)) is not None:
                    record(method, [i], sums)
            for j in sorted(right, key=lambda j: -sc[j]) if len(left) > 1 else ():
                if free_s[j] and (sums := _sum_of_few([i for i in left if free_b[i]], bc, sc[j], terms)) is not None:
                    record(method, sums, [j])
        left, right = [i for i in left if free_b[i]], [j for j in right if free_s[j]]
        if left and right and len(left) + len(right) > 2:
            total = sum([bc[i] for i in left])
            if abs(total - sum([sc[j] for j in right])) <= max(terms.absolute * 100, abs(total) * terms.percent / 100):
                record(method, left, right)

    for same in (True, False):
        method = f"EXACT_1_TO_1_{'SAME' if same else 'OUTSIDE'}_QUARTER"
        for i in turn:
            if not free_b[i]:
                continue
            tol = max(terms.absolute * 100, abs(bc[i]) * terms.percent / 100)
            low, high = bc[i] - tol, bc[i] + tol
            near = [j for j, c in enumerate(sc) if low <= c <= high and free_s[j] and (sq[j] == bq[i]) == same]
            if near:
                agrees = [j for j in near if ss[j] == bs[i]] if bs[i] >= 0 else []
                record(method, [i], [min(agrees or near, key=lambda j: (0 if same else abs(sq[j] - bq[i]), abs(sc[j] - bc[i]), j))])  # noqa: B023
    for q in (1, 2, 3, 4):
        left, right = [i for i, x in enumerate(bq) if x == q and free_b[i]], [j for j, x in enumerate(sq) if x == q and free_s[j]]
        if left and right:
            groups(left, right, "GROUP_SAME_QUARTER")
    groups([i for i, x in enumerate(free_b) if x], [j for j, x in enumerate(free_s) if x], "GROUP_OUTSIDE_QUARTER")
    for same in (True, False):
        for i in turn:
            if free_b[i]:
                left = [j for j, x in enumerate(free_s) if x and (not same or sq[j] == bq[i])]
                if left:
                    record("AMOUNT_MISMATCH", [i], [min(left, key=lambda j: abs(sc[j] - bc[i]))])  # noqa: B023
    return found


def numbers(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(side, cents, quarter, section as a number) of rows."""
    codes = pc.dictionary_encode(table.column("section").combine_chunks())
    blank = np.array([not x for x in codes.dictionary.to_pylist()], bool)
    section = codes.indices.to_numpy(zero_copy_only=False)
    section = np.where(blank[section], -1, section) if len(section) else section
    return tuple(table.column(c).to_numpy() for c in ("side", "cents", "quarter")) + (section,)


def scope_of(table: pa.Table, terms: Terms) -> tuple[Scope, np.ndarray, np.ndarray]:
    """(the scope, places of its books in the table, places of its statement rows); rows come in the order of their ids."""
    side, *values = numbers(table)
    own, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return Scope(tuple(v[own] for v in values), tuple(v[other] for v in values), terms), own, other


def pairs_of(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Rows of a match: one side's only row with each of the other's; else each row by itself, -1 for the other side."""
    if min(len(left), len(right)) == 1:
        return [(i, j) for i in left for j in right]
    return [(i, -1) for i in left] + [(-1, j) for j in right]


def _placed(column: pa.ChunkedArray, at: np.ndarray) -> pa.Array:
    return pc.take(column, pa.array(np.maximum(at, 0), mask=at < 0)).combine_chunks()


def rows_of(books: DataFrame, statements: DataFrame) -> DataFrame:
    """Both sides as one table; ids and customers may be of any type that has an order."""

    def side(df: DataFrame, n: int, ids: list[Column]) -> DataFrame:
        cents = F.round(F.coalesce(F.col("amount"), F.lit(0)) * 100).cast("long")
        q = F.coalesce(F.substring("quarter", 2, 1).try_cast("int"), F.lit(0))
        rows = df.filter("customer is not null and fy is not null")
        return rows.select(*KEY, F.lit(n).alias("side"), *ids, cents.alias("cents"), q.alias("quarter"), F.coalesce("section", F.lit("")).alias("section"))

    none = lambda df, name: F.lit(None).cast(df.schema["id"].dataType).alias(name)
    return side(books, 0, [F.col("id").alias("b_id"), none(statements, "s_id")]).unionByName(side(statements, 1, [none(books, "b_id"), F.col("id").alias("s_id")]))


def matched_type(rows: DataFrame) -> str:
    of = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return f"book_id {of['b_id']}, statement_id {of['s_id']}, customer {of['customer']}, fy {of['fy']}, method string, group_id string, difference double"


def match_small(rows: DataFrame, terms: Terms) -> DataFrame:
    """The matches of customers and years that one task takes whole: groups are cut where the key changes, none has a call of its own."""

    def matches(table: pa.Table, cuts: list[int]) -> pa.RecordBatch | None:
        """The matches of the keys between these cuts; columns become arrays and lists once for all of them."""
        side, *values = numbers(table)
        lists, exact = [v.tolist() for v in values], bool(np.abs(values[0]).max() < EXACT_CENTS)
        firsts = np.append(0, np.cumsum(side == 0))[cuts]  # books come before statement rows
        found = []
        for lo, hi, n in zip(cuts, cuts[1:], np.diff(firsts).tolist()):
            mid = lo + n
            if mid == lo or mid == hi:
                continue
            if hi - lo <= FEW and exact:
                each = match_few(tuple(v[lo:mid] for v in lists), tuple(v[mid:hi] for v in lists), terms)
            else:
                scope = Scope(tuple(v[lo:mid] for v in values), tuple(v[mid:hi] for v in values), terms)
                scope.all_steps()
                each = [(method, b.tolist(), s.tolist()) for method, b, s in scope.found]
            cents = lists[0]
            for n, (method, b, s) in enumerate(each):
                gap = float(sum([cents[lo + i] for i in b]) - sum([cents[mid + j] for j in s])) / 100
                group = n if len(b) + len(s) > 2 else -1
                found += [(lo + i if i >= 0 else -1, mid + j if j >= 0 else -1, lo, method, group, gap) for i, j in pairs_of(b, s)]
        if not found:
            return None
        i, j, at, method, group, gap = (list(x) for x in zip(*found))
        key = [pc.take(table.column(c), pa.array(at)).combine_chunks() for c in KEY]
        grouped = [n >= 0 for n in group]
        named = [pc.filter(k, pa.array(grouped)).to_pylist() for k in key]
        each = iter(f"{c}-{y}-{n}" for c, y, n in zip(*named, (n for n in group if n >= 0)))
        names = [next(each) if n else None for n in grouped]
        ids = [_placed(table.column(c), np.array(x)) for c, x in (("b_id", i), ("s_id", j))]
        return pa.RecordBatch.from_arrays([*ids, *key, pa.array(method), pa.array(names, pa.string()), pa.array(gap, pa.float64())], names=["book_id", "statement_id", *KEY, "method", "group_id", "difference"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in by_whole_keys(batches, KEY):
            if (some := matches(table, cuts)) is not None:
                yield some

    ordered = rows.repartition(*KEY).sortWithinPartitions(*KEY, "side", "b_id", "s_id")
    return ordered.mapInArrow(task, matched_type(rows))


def unmatched(rows: DataFrame, matches: DataFrame, column: str) -> DataFrame:
    return rows.join(matches.filter(F.col(column).isNotNull()).select(F.col(column).alias("id")), "id", "left_anti")


def claimability(status: Column, deducted: Column, deposited: Column, absolute: float = Terms.absolute) -> Column:
    """As an aggregate over a match's statement rows; what was deducted counts as 0 where it is null."""
    missing = F.count(deposited) < F.count(F.lit(1))
    short = F.sum(deposited) + F.lit(absolute).cast(MONEY) < F.coalesce(F.sum(deducted), F.lit(0))
    return F.when(F.max((~status.eqNullSafe("F")).cast("int")) == 1, "NOT_CLAIMABLE").when(missing | short, "NOT_CLAIMABLE").otherwise("CLAIMABLE")


def severity(difference: Column, base: Column) -> Column:
    share = F.abs(difference) * 100 > F.abs(base) * 10
    return F.when(difference == 0, "NONE").when(share, "HIGH").otherwise("MEDIUM")

