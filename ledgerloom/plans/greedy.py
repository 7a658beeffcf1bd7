"""Consuming matches at any size of a customer and year.

Most keys are small and one task takes each whole.  A key with more rows than ``Terms.rows`` is matched by the same steps
in slabs of amounts:

* Within a tolerance, a book of one step of amounts (steps are as wide as a tolerance) can only take rows of that step or
  the two beside it.  Steps are put together to slabs of bounded rows.  All slabs are matched at once, as if those above
  had taken nothing from them; then a slab whose rows were taken by larger books, which come first, is matched again
  without these, until no slab's start changes.  What one slab does seldom reaches further than the next, so few rounds are needed.
* Groups are searched in scopes of at most ``Terms.scope`` rows; beyond, totals are aggregates.
* The nearest amount has no bound, so slabs follow each other from the largest amounts down: each takes its own rows and
  as many free ones above and below as it has books, which is all that it can use.

No task gets more rows than about three times ``Terms.rows`` and those of the steps beside a slab, of one amount and of one step.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import matching
from ..operators.matching import KEY, Terms
from .components import kept


def match(books: DataFrame, statements: DataFrame, terms: Terms = Terms()) -> DataFrame:
    """(book_id, statement_id, customer, fy, method, group_id, difference): each row in one match at most.

    books, statements: (id, customer, fy, quarter, amount, section); ids and customers of any type that has an order.
    """
    rows = matching.rows_of(books, statements)
    large = kept(rows.groupBy(*KEY).agg(F.count("*").alias("n")).filter(F.col("n") > terms.rows).select(*KEY))
    if large.isEmpty():
        return matching.match_small(rows, terms)
    # an outer join, which stays above the union of both sides: a semi or anti join would be pushed below it, and the
    # union's parts then are taken to lie together by key where they do not
    split = rows.join(large.withColumn("_large", F.lit(True)), KEY, "left")
    small = matching.match_small(split.filter("_large is null").drop("_large"), terms)
    return small.unionByName(match_large(split.filter("_large").drop("_large"), terms))


def match_large(rows: DataFrame, terms: Terms) -> DataFrame:
    rows = kept(rows.withColumn("row", F.monotonically_increasing_id()))
    key = rows.select(*KEY).schema
    start = rows.sparkSession.createDataFrame([], key.simpleString()[7:-1] + ", b_row long, s_row long, method string, grp string")
    free, found = rows, start

    def take(more: DataFrame) -> None:
        nonlocal free, found
        more = kept(more.select(*found.columns))
        used = more.select(F.explode(F.array("b_row", "s_row")).alias("row")).filter("row is not null")
        found, free = found.unionByName(more), kept(free.join(used, "row", "left_anti"))

    for same in (True, False):
        take(_exact(free, same, terms))
    for same in (True, False):
        take(_groups(free, same, terms))
    for same in (True, False):
        for more in _closest(lambda: free, same, terms):  # noqa: B023
            take(more)
    b = rows.select(F.col("row").alias("b_row"), "b_id", F.col("cents").alias("b_cents"))
    s = rows.select(F.col("row").alias("s_row"), "s_id", F.col("cents").alias("s_cents"))
    out = found.join(b, "b_row", "left").join(s, "s_row", "left")
    totals = found.filter("grp is not null").select("grp", F.explode(F.array("b_row", "s_row")).alias("row")).filter("row is not null").distinct()
    signed = F.when(F.col("side") == 0, F.col("cents")).otherwise(-F.col("cents"))
    totals = totals.join(rows, "row").groupBy("grp").agg(F.sum(signed).alias("total"))
    out = out.join(totals, "grp", "left")
    gap = F.coalesce(F.col("total"), F.col("b_cents") - F.col("s_cents")).cast("double") / 100
    return out.select(F.col("b_id").alias("book_id"), F.col("s_id").alias("statement_id"), *KEY, "method", F.col("grp").alias("group_id"), gap.alias("difference"))


def _scope(same: bool) -> list[str]:
    return [*KEY, "quarter"] if same else list(KEY)


def _name(same: bool) -> str:
    return "SAME_QUARTER" if same else "OUTSIDE_QUARTER"


def step_of(cents: Column, terms: Terms) -> Column:
    """Steps of amounts at least as wide as a tolerance: equal ones near zero, then in proportion to the amount."""
    share = terms.percent / 100
    width = max(terms.absolute * 100, 1.0) * 1.05
    x = F.abs(cents).cast("double")
    if share <= 0:
        place = x / width
    else:
        bend = width / 1.05 / share
        place = F.when(x <= bend, x / width).otherwise(bend / width + F.log(F.greatest(x, F.lit(bend)) / bend) / (-math.log(1 - min(share, 0.99)) * 1.05))
    return F.floor(F.when(cents < 0, -place).otherwise(place)).cast("long")


def _in_order(table: pa.Table) -> pa.Table:
    return table.take(pc.sort_indices(table, [(c, "ascending") for c in ("side", "b_id", "s_id")]))


def _each(rows: DataFrame, by: list[str], terms: Terms, steps: Callable[[matching.Scope], None], taken: bool = False) -> DataFrame:
    """The matches of each group by these steps: (by, b_row, s_row, method, n), n the match's number in its group."""
    schema = rows.select(*by).schema.simpleString()[7:-1] + ", b_row long, s_row long, method string, n int"

    def one(table: pa.Table) -> pa.Table:
        table = _in_order(table)
        scope, own, other = matching.scope_of(table, terms)
        if taken:
            scope.free_s[table.column("taken").to_numpy()[other]] = False
        steps(scope)
        at = [(i, j, m, n) for n, (m, b, s) in enumerate(scope.found) for i, j in matching.pairs_of(b, s)]
        i, j, method, n = (list(x) for x in zip(*at)) if at else ([], [], [], [])
        row = table.column("row").to_numpy()
        pick = lambda k, places: pa.array(row[places[np.maximum(k, 0)]] if len(k) else [], pa.int64(), mask=np.array(k) < 0 if len(k) else None)
        keys = [pc.take(table.column(c), pa.array(np.zeros(len(i), int))).combine_chunks() for c in by]
        return pa.Table.from_arrays([*keys, pick(np.array(i, int), own), pick(np.array(j, int), other), pa.array(method, pa.string()), pa.array(n, pa.int32())], names=[*by, "b_row", "s_row", "method", "n"])

    return rows.groupBy(*by).applyInArrow(one, schema)


def _exact(free: DataFrame, same: bool, terms: Terms) -> DataFrame:
    """One to one within the tolerance, in slabs; see above."""
    scope = _scope(same)
    by = [*scope, "slab"]
    rows = free.withColumn("step", step_of(F.col("cents"), terms))
    counts = rows.groupBy(*scope, "step").agg(F.count("*").alias("n"))
    # a row for each step of a scope: steps grow with the logarithm of the amounts, not with the rows
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*scope).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = kept(counts.select(*scope, "step", F.floor(before / terms.rows).alias("slab")))
    beside = cuts.withColumn("step", F.explode(F.expr("array(step - 1, step, step + 1)"))).groupBy(*scope, "step").agg(F.collect_set("slab").alias("slabs"))
    books = rows.filter("side = 0").join(cuts, [*scope, "step"])
    lines = rows.filter("side = 1").join(beside, [*scope, "step"]).withColumn("slab", F.explode("slabs")).drop("slabs")
    work = kept(books.unionByName(lines).drop("step"))
    slabs = kept(work.groupBy(*by).agg(F.max(F.when(F.col("side") == 0, 1)).alias("books")).filter("books = 1").drop("books"))
    work = work.join(slabs, by, "left_semi")
    steps = lambda s: s.exact(same)
    pairs = kept(_each(work.withColumn("taken", F.lit(False)), by, terms, steps, taken=True))
    seen = slabs.withColumn("mark", F.lit(0).cast("long"))
    while True:
        larger = pairs.select(*scope, F.col("slab").alias("_of"), F.col("s_row").alias("row"))
        gone = work.filter("side = 1").select(*by, "row").join(larger, [*scope, "row"]).filter(F.col("slab") > F.col("_of")).select(*by, "row")
        marks = gone.groupBy(*by).agg(F.bit_xor(F.xxhash64("row")).alias("mark"))
        marks = kept(slabs.join(marks, by, "left").withColumn("mark", F.coalesce("mark", F.lit(0).cast("long"))))
        changed = kept(marks.join(seen.withColumnRenamed("mark", "_seen"), by).filter("mark != _seen").select(*by))
        if changed.isEmpty():
            break
        again = work.join(changed, by, "left_semi").join(gone.withColumn("_gone", F.lit(True)), [*by, "row"], "left")
        new = _each(again.withColumn("taken", F.coalesce("_gone", F.lit(False))).drop("_gone"), by, terms, steps, taken=True)
        pairs = kept(pairs.join(changed, by, "left_anti").unionByName(new))
        seen = marks
    return pairs.withColumn("grp", F.lit(None).cast("string"))


def _groups(free: DataFrame, same: bool, terms: Terms) -> DataFrame:
    """Sums of several rows in scopes of bounded size; totals of all other scopes."""
    scope, method = _scope(same), "GROUP_" + _name(same)
    of = lambda n, c: F.when(F.col("side") == n, c)
    rows = free.filter("quarter between 1 and 4") if same else free
    sizes = rows.groupBy(*scope).agg(
        F.count(of(0, F.lit(1))).alias("nb"), F.count(of(1, F.lit(1))).alias("ns"), F.coalesce(F.sum(of(0, F.col("cents"))), F.lit(0)).alias("tb"), F.coalesce(F.sum(of(1, F.col("cents"))), F.lit(0)).alias("ts"),
        F.min(of(0, F.col("row"))).alias("only_b"), F.min(of(1, F.col("row"))).alias("only_s"),
    )
    sizes = kept(sizes.filter("nb > 0 and ns > 0"))
    few = rows.join(sizes.filter(F.col("nb") + F.col("ns") <= terms.scope).select(*scope), scope, "left_semi")

    def steps(s: matching.Scope) -> None:
        s.groups(np.arange(len(s.bc)), np.arange(len(s.sc)), method)

    small = _each(few, scope, terms, steps)
    name = lambda n: F.concat_ws("-", *(F.col(c).cast("string") for c in KEY), F.lit(_name(same)), *(F.col(c).cast("string") for c in scope[2:]), n)
    small = small.withColumn("grp", name(F.col("n").cast("string")))
    agree = F.abs(F.col("tb") - F.col("ts")) <= F.greatest(F.lit(terms.absolute * 100), F.abs(F.col("tb")) * (terms.percent / 100))
    whole = sizes.filter((F.col("nb") + F.col("ns") > max(terms.scope, 2)) & agree)
    many = rows.join(whole, scope).withColumn("one", F.least("nb", "ns") == 1)
    # the only row of a side stands beside each of the other's, and has no row of its own
    many = many.filter(~F.col("one") | ((F.col("nb") == 1) & (F.col("side") == 1)) | ((F.col("ns") == 1) & (F.col("nb") != 1) & (F.col("side") == 0)))
    b_row = F.when(F.col("side") == 0, F.col("row")).when(F.col("one"), F.col("only_b"))
    s_row = F.when(F.col("side") == 1, F.col("row")).when(F.col("one"), F.col("only_s"))
    large = many.select(*KEY, b_row.alias("b_row"), s_row.alias("s_row"), F.lit(method).alias("method"), name(F.lit("all")).alias("grp"))
    return small.select(*large.columns).unionByName(large)


def numbered(rows: DataFrame, scope: list[str], order: list[Column]) -> DataFrame:
    """Adds pos, a row's number in its scope by this order: a range sort over all rows and prefix sums over its parts."""
    keys = [*(F.col(c) for c in scope), *order]
    placed = kept(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()))
    parts = placed.groupBy(*scope, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*scope).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # a row for each part that a scope lies in
    parts = parts.select(*scope, "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(parts, [*scope, "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def running_total(rows: DataFrame, scope: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    """Adds out, the sum of value over the rows before this one in its scope; a range sort, sums in its parts and over them,
    so that no scope is summed in one task."""
    keys = [*(F.col(c) for c in scope), *order]
    placed = kept(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    same = [F.col(c) for c in scope]
    before = F.sum(value).over(Window.partitionBy(*same, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    # a row for each part that a scope lies in; scopes may hold nulls
    parts = placed.groupBy(*scope, "_part").agg(F.sum(value).alias("_sum"))
    carried = F.sum("_sum").over(Window.partitionBy(*same).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*(F.col(c).alias(f"_p_{c}") for c in scope), F.col("_part").alias("_p_part"), F.coalesce(carried, F.lit(0)).alias("_carried"))
    meet = F.col("_part") == F.col("_p_part")
    for c in scope:
        meet = meet & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    joined = placed.withColumn("_before", F.coalesce(before, F.lit(0))).join(parts, meet)
    return joined.withColumn(out, F.col("_before") + F.col("_carried")).drop("_part", "_before", "_carried", "_p_part", *(f"_p_{c}" for c in scope))


def _closest(free: Callable[[], DataFrame], same: bool, terms: Terms):
    """The nearest rows of what is left, slab after slab from the largest amounts down."""
    scope = _scope(same)
    sides = free().groupBy(*scope).agg(F.countDistinct("side").alias("sides")).filter("sides = 2").select(*scope)
    rows = numbered(free().join(sides, scope, "left_semi"), scope, [F.col("cents").desc()])
    # rows of one amount stay together, so that the smallest id of an amount is always at hand
    first = rows.groupBy(*scope, "cents").agg(F.floor(F.min("pos") / terms.rows).alias("slab"))
    places = kept(rows.join(first, [*scope, "cents"]).select(*scope, "row", "slab"))
    most = places.agg(F.max("slab")).first()[0]
    for k in range(-1 if most is None else int(most) + 1):
        now = free().join(places, [*scope, "row"])
        books = now.filter((F.col("side") == 0) & (F.col("slab") == k))
        wanted = books.groupBy(*scope).agg(F.count("*").alias("m"))
        there = now.filter("side = 1").groupBy(*scope, "slab").agg(F.count("*").alias("n")).join(wanted, scope)
        away = F.abs(F.col("slab") - k)
        nearer = Window.partitionBy(*scope, F.signum(F.col("slab") - k)).orderBy(away).rowsBetween(Window.unboundedPreceding, -1)
        use = there.withColumn("before", F.coalesce(F.sum("n").over(nearer), F.lit(0))).filter((F.col("slab") == k) | (F.col("before") < F.col("m"))).select(*scope, "slab")
        lines = now.filter("side = 1").join(use, [*scope, "slab"], "left_semi")
        found = _each(books.unionByName(lines).drop("slab"), scope, terms, lambda s: s.closest(same))
        yield found.withColumn("grp", F.lit(None).cast("string"))
