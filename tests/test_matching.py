"""Consuming matches against a plain brute force, and the edge cases of whole reconciliations."""

import itertools
import random
import time
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.matching import Scope, Terms, match_few, nearest
from ledgerloom.plans.frames import statements
from ledgerloom.plans.greedy import match, step_of
from ledgerloom.plans.reconcile import CLASSES, full_reconciliation, sequenced

SCHEMA = "id long, customer long, fy string, quarter string, amount decimal(18,2), section string"


def brute(books, statements, terms=Terms()):
    """The same rules by loops over dictionaries: (book ids, statement ids, method) of every match."""
    out = []
    cents = lambda r: round(float(r["amount"] or 0) * 100)
    q = lambda r: int(r["quarter"][1]) if r["quarter"] else 0
    tol = lambda c: max(terms.absolute * 100, abs(c) * terms.percent / 100)
    large = lambda rows: sorted(rows, key=lambda r: -cents(r))
    keys = {(r["customer"], r["fy"]) for r in books} & {(r["customer"], r["fy"]) for r in statements}
    for customer, fy in (k for k in keys if None not in k):
        own = lambda rows: sorted((r for r in rows if (r["customer"], r["fy"]) == (customer, fy)), key=lambda r: r["id"])  # noqa: B023, E731
        b, s = own(books), own(statements)

        def take(left, right, method):
            out.append((tuple(r["id"] for r in left), tuple(r["id"] for r in right), method))  # noqa: B023
            for r in left:
                b.remove(r)  # noqa: B023
            for r in right:
                s.remove(r)  # noqa: B023

        for same in (True, False):
            for x in large(b):
                fits = [y for y in s if (q(x) == q(y)) == same and abs(cents(x) - cents(y)) <= tol(cents(x))]
                if fits:
                    differs = lambda y: not y["section"] or y["section"] != x["section"]  # noqa: B023, E731
                    best = min(fits, key=lambda y: (differs(y), 0 if same else abs(q(y) - q(x)), abs(cents(y) - cents(x))))
                    take([x], [best], "EXACT_1_TO_1_" + ("SAME" if same else "OUTSIDE") + "_QUARTER")

        def subset(target, pool):
            near = sorted(pool, key=lambda y: abs(cents(y) - cents(target)))[: terms.pool]
            near = [y for y in pool if y in near]
            for size in range(2, min(len(near), terms.group) + 1):
                for c in itertools.combinations(near, size):
                    if abs(cents(target) - sum(map(cents, c))) <= tol(cents(target)):
                        return list(c)

        for scope in (1, 2, 3, 4, None):
            inside = lambda rows: [r for r in rows if scope is None or q(r) == scope]  # noqa: B023, E731
            name = "GROUP_" + ("OUTSIDE" if scope is None else "SAME") + "_QUARTER"
            if len(inside(b)) + len(inside(s)) <= terms.scope:
                for x in large(inside(b)):
                    if found := subset(x, inside(s)):
                        take([x], found, name)
                for y in large(inside(s)):
                    if found := subset(y, inside(b)):
                        take(found, [y], name)
            left, right = inside(b), inside(s)
            total = sum(map(cents, left))
            if left and right and len(left) + len(right) > 2 and abs(total - sum(map(cents, right))) <= tol(total):
                take(left, right, name)
        for same in (True, False):
            for x in large(b):
                fits = [y for y in s if not same or q(x) == q(y)]
                if fits:
                    take([x], [min(fits, key=lambda y: abs(cents(y) - cents(x)))], "AMOUNT_MISMATCH")
    return out


def pairs(found):
    out = Counter()
    for left, right, method in found:
        if min(len(left), len(right)) == 1:
            out.update((i, j, method) for i in left for j in right)
        else:
            out.update([(i, None, method) for i in left] + [(None, j, method) for j in right])
    return out


def rows(rng, n, first):
    return [
        {"id": first + i, "customer": rng.choice([1, 2, 3, None]), "fy": rng.choice(["2024-25", "2025-26", "2025-26", None]), "quarter": rng.choice(["Q1", "Q2", "Q3", "Q4", None]),
         "amount": rng.choice([None, *[rng.randrange(20, 500) for _ in range(8)]]), "section": rng.choice(["194C", "194J", "194I", "", None])}
        for i in range(n)
    ]


def frame(spark, data):
    return spark.createDataFrame([(r["id"], r["customer"], r["fy"], r["quarter"], None if r["amount"] is None else Decimal(r["amount"]), r["section"]) for r in data], SCHEMA)


def held_to_brute(spark, books, statements, terms):
    got = match(frame(spark, books), frame(spark, statements), terms).collect()
    assert Counter((r["book_id"], r["statement_id"], r["method"]) for r in got) == pairs(brute(books, statements, terms))
    cents = {r["id"]: round(float(r["amount"] or 0) * 100) for r in books + statements}
    for column in ("book_id", "statement_id"):  # no row is in two matches
        group = {}
        for r in got:
            if r[column] is not None:
                group.setdefault(r[column], set()).add(r["group_id"] or (r["book_id"], r["statement_id"]))
        assert all(len(g) == 1 for g in group.values())
    members = {}
    for r in got:
        members.setdefault(r["group_id"] or (r["book_id"], r["statement_id"]), []).append(r)
    for rs in members.values():
        left, right = ({r[c] for r in rs} - {None} for c in ("book_id", "statement_id"))
        assert {r["difference"] for r in rs} == {(sum(cents[i] for i in left) - sum(cents[i] for i in right)) / 100}
        assert (len(left) + len(right) > 2) == (rs[0]["group_id"] is not None)


@pytest.mark.parametrize("seed", range(4))
def test_consuming_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    held_to_brute(spark, rows(rng, 70, 0), rows(rng, 60, 1000), Terms())


@pytest.mark.parametrize("seed", range(3))
def test_slabs_match_brute_force(spark, seed):
    """The same rows where no more than eight of them go to a task whole."""
    rng = random.Random(100 + seed)
    held_to_brute(spark, rows(rng, 90, 0), rows(rng, 80, 1000), Terms(rows=8, scope=[500, 5, 12][seed]))


def test_slabs_of_dense_amounts_match_brute_force(spark):
    """One key, tolerances that overlap from end to end, many equal amounts, larger books that take rows of other slabs."""
    rng = random.Random(7)
    make = lambda n, first: [{"id": first + i, "customer": 1, "fy": "2024-25", "quarter": rng.choice(["Q1", "Q2"]), "amount": rng.choice([rng.randrange(900, 1400), 1000, 1010, rng.randrange(5000, 5100)]), "section": rng.choice(["a", "b"])} for i in range(n)]
    held_to_brute(spark, make(260, 0), make(170, 1000), Terms(rows=25))


def test_far_amounts_match_brute_force(spark):
    """Nothing within the tolerance: the nearest rows, slab by slab, with runs of equal amounts."""
    rng = random.Random(8)
    make = lambda n, first, base: [{"id": first + i, "customer": 1, "fy": "2024-25", "quarter": rng.choice(["Q1", "Q2", None]), "amount": base + 400 * rng.randrange(12), "section": "a"} for i in range(n)]
    held_to_brute(spark, make(40, 0, 100), make(35, 1000, 300), Terms(rows=6, scope=4, percent=0.1))


def test_steps_are_as_wide_as_a_tolerance(spark):
    rng = random.Random(3)
    for terms in (Terms(), Terms(absolute=0, percent=2), Terms(absolute=5, percent=0), Terms(absolute=100, percent=10)):
        values = []
        for _ in range(3000):
            a = round(rng.choice([1, -1]) * 10 ** rng.uniform(0, 9))
            values.append((a, round(a + rng.uniform(-1, 1) * float(terms.tolerance(a)))))
        df = spark.createDataFrame([v for v in values if abs(v[0] - v[1]) <= terms.tolerance(v[0])], "a long, b long")
        assert df.select(F.max(F.abs(step_of(F.col("a"), terms) - step_of(F.col("b"), terms)))).first()[0] <= 1


def test_text_ids_and_customers(spark):
    rng = random.Random(11)
    books, statements = rows(rng, 40, 100), rows(rng, 30, 500)
    named = lambda data: frame(spark, data).withColumn("id", F.concat(F.lit("r"), "id")).withColumn("customer", F.concat(F.lit("c"), "customer"))
    for terms in (Terms(), Terms(rows=5)):
        got = match(named(books), named(statements), terms).collect()
        unnamed = lambda x: None if x is None else int(x[1:])
        assert Counter((unnamed(r["book_id"]), unnamed(r["statement_id"]), r["method"]) for r in got) == pairs(brute(books, statements, terms))


def test_nothing_to_match(spark):
    none = frame(spark, []).limit(0)
    some = frame(spark, rows(random.Random(1), 20, 0))
    for a, b in ((none, none), (some, none), (none, some)):
        for terms in (Terms(), Terms(rows=2)):
            assert match(a, b, terms).collect() == []


def test_two_thousand_equal_rows_match_one_to_one(spark):
    side = lambda first: spark.range(first, first + 2000).selectExpr("id", "1L as customer", "'2024-25' as fy", "'Q1' as quarter", f"cast((id - {first}) * 100 + 5000 as decimal(18,2)) as amount", "'194C' as section")
    books, statements = side(0), side(10_000)
    match(books.limit(5), statements.limit(5)).count()
    start = time.time()
    assert match(books, statements).filter("method = 'EXACT_1_TO_1_SAME_QUARTER'").count() == 2000
    assert time.time() - start < 20


def results(books, statements):
    """Every record's result by loops: (result, claimability, method, book, statement row, severity)."""
    out = Counter()

    def first_of(data, key):
        seen, first, again = set(), [], []
        for r in sorted(data, key=lambda r: r["id"]):
            (again if key(r) in seen else first).append(r)
            seen.add(key(r))
        return first, again

    b, again_b = first_of(books, lambda r: (r["customer"], r["document"] or str(r["id"]), r["day"], r["amount"]))
    s, again_s = first_of(statements, lambda r: (r["tan"], r["day"], r["section"], r["amount"], r["deposited"], r["status"]))
    by = {r["id"]: r for r in b + s}
    mapped = [r for r in s if r["customer"] is not None]
    used = set()
    for left, right, method in brute(b, mapped):
        rows = [by[i] for i in right]
        used.update(left + right)
        total = sum(r["amount"] or 0 for r in rows)
        gap = sum(by[i]["amount"] or 0 for i in left) - total
        bad = any(r["status"] != "F" or r["deposited"] is None for r in rows) or sum(r["deposited"] or 0 for r in rows) + 10 < total
        if method == "AMOUNT_MISMATCH":
            high = gap + total and abs(round(gap / (gap + total) * 100, 2)) > 10
            what = ("AMOUNT_MISMATCH", "NOT_APPLICABLE", "UNMATCHED", "HIGH" if high else "MEDIUM")
        elif bad:
            what = ("MATCHED_NOT_CLAIMABLE", "NOT_CLAIMABLE", method, "MEDIUM")
        else:
            what = ("MATCHED_CLAIMABLE", "CLAIMABLE", method, "NONE")
        for i, j, _ in pairs([(left, right, method)]).elements():
            out[*what, i, j] += 1
    for data, name, severity in ((b, "MISSING_IN_26AS", "HIGH"), (mapped, "MISSING_IN_BOOKS", "MEDIUM")):
        out.update((name, "NOT_APPLICABLE", "UNMATCHED", severity, r["id"] if data is b else None, None if data is b else r["id"]) for r in data if r["id"] not in used)
    out.update(("IDENTITY_UNMAPPED", "NOT_APPLICABLE", "UNMATCHED", "HIGH", None, r["id"]) for r in s if r["customer"] is None)
    out.update(("DUPLICATE_BOOK", "NOT_APPLICABLE", "UNMATCHED", "LOW", r["id"], None) for r in again_b)
    out.update(("DUPLICATE_26AS", "NOT_APPLICABLE", "UNMATCHED", "LOW", None, r["id"]) for r in again_s)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_full_reconciliation_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    day = lambda: f"2024-05-{rng.randrange(1, 4):02}"
    books = [r | {"document": rng.choice(["d1", "d2", "", None]), "day": day()} for r in rows(rng, 120, 0)]
    statements = [r | {"tan": rng.choice("xy"), "day": day(), "status": rng.choice(["F", "F", "F", "U", "P", "O"]), "deposited": rng.choice([r["amount"]] * 4 + [None, (r["amount"] or 0) - 9, (r["amount"] or 0) - 30])} for r in rows(rng, 110, 1000)]
    b = spark.createDataFrame([(r["id"], r["document"], r["day"]) for r in books], "id long, document string, day string").join(frame(spark, books), "id")
    s = spark.createDataFrame([(r["id"], r["tan"], r["day"], r["status"], None if r["deposited"] is None else Decimal(r["deposited"])) for r in statements], "id long, tan string, day string, status string, deposited decimal(18,2)").join(frame(spark, statements), "id")
    got = full_reconciliation(b, s).collect()
    assert Counter((r["result"], r["claimability"], r["method"], r["severity"], r["book_id"], r["statement_id"]) for r in got) == results(books, statements)
    left_out = full_reconciliation(b.withColumn("matchable", F.col("id") % 2 == 0), s).collect()
    assert {r["book_id"] for r in left_out} - {None} == {r["id"] for r in books if r["id"] % 2 == 0}


def test_results_are_numbered(spark):
    rng = random.Random(5)
    b = frame(spark, rows(rng, 60, 0)).withColumn("day", F.lit("2024-05-01"))
    s = frame(spark, rows(rng, 60, 1000)).withColumns({"day": F.lit("2024-05-01"), "tan": F.lit("t"), "status": F.lit("F")})
    got = sequenced(full_reconciliation(b, s).repartition(7), "run1").collect()
    assert sorted(r["seq"] for r in got) == list(range(1, len(got) + 1)) and all(r["result_id"] == f"run1:{r['seq']}" for r in got)
    order = [CLASSES.index(r["result"]) for r in sorted(got, key=lambda r: r["seq"])]
    assert order == sorted(order)


def test_nearest_amounts(spark):
    rng = random.Random(4)
    b, s = rows(rng, 150, 0), rows(rng, 90, 1000)
    b += [r | {"id": 5000 + r["id"], "customer": 1, "fy": "2024-25"} for r in b]  # half of all rows on one key
    got = {r["book_id"]: (r["statement_id"], r["difference"]) for r in nearest(frame(spark, b), frame(spark, s)).collect()}
    want = {}
    for x in b:
        fits = [y for y in s if (x["customer"], x["fy"]) == (y["customer"], y["fy"]) and None not in (x["customer"], x["fy"], x["amount"], y["amount"])]
        if fits:
            best = min(fits, key=lambda y: (abs(x["amount"] - y["amount"]), y["id"]))
            want[x["id"]] = (best["id"], Decimal(abs(x["amount"] - best["amount"])))
    assert got == want


def test_nearest_amounts_of_many_parts(spark):
    """Rows and the list of their parts agree on the parts, however Spark joins small parts together."""
    rng = random.Random(6)
    of = lambda n, first: [{"id": first + i, "customer": i % 400, "fy": "2024-25", "quarter": "Q1", "amount": Decimal(rng.randrange(10**7)) / 100, "section": "s" * 40} for i in range(n)]
    b, s = of(3000, 0), of(2000, 10_000)
    sizes = {f"spark.sql.adaptive.{k}": "3000" for k in ("advisoryPartitionSizeInBytes", "coalescePartitions.minPartitionSize")}
    names = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", **sizes}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        got = {r["book_id"]: r["difference"] for r in nearest(frame(spark, b), frame(spark, s)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want = {x["id"]: min(abs(x["amount"] - y["amount"]) for y in s if y["customer"] == x["customer"]) for x in b}
    assert got == want


def test_scopes_of_few_rows_match_as_arrays_do(spark):
    """The steps over lists are those over arrays, whatever the terms."""
    rng, seen = random.Random(9), set()
    for _ in range(300):
        unit, low = rng.choice([1, 37, 500, 100000]), rng.choice([0, -20])
        some = lambda n: ([rng.randrange(low, 40) * unit + rng.randrange(3) for _ in range(n)], [rng.randrange(5) for _ in range(n)], [rng.randrange(-1, 3) for _ in range(n)])  # noqa: B023, E731
        b, s = some(rng.randrange(1, 14)), some(rng.randrange(1, 24))
        terms = Terms(pool=rng.choice([14, 5, 9]), group=rng.choice([6, 3]), scope=rng.choice([500, 10]), absolute=rng.choice([10.0, 0.5]), percent=rng.choice([1.0, 0.7]))
        whole = Scope(tuple(map(np.array, b)), tuple(map(np.array, s)), terms)
        whole.all_steps()
        assert match_few(b, s, terms) == [(m, i.tolist(), j.tolist()) for m, i, j in whole.found]
        seen |= {m for m, _, _ in whole.found}
    assert len(seen) == 5


def test_order_lines_move_once(spark, sf_dir):
    plan = statements(spark, sf_dir)._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("RepartitionByExpression [l_orderkey") == 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = statements(spark, sf_dir)
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # the lines' and the orders'
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
