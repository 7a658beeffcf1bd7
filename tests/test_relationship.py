"""Operators that loop, against plain loops."""

import datetime
import random
from itertools import combinations

import pyarrow as pa

from ledgerloom import queries as engine
from ledgerloom.operators import relationship
from ledgerloom.plans.components import labelled


def test_components_of_a_chain_of_any_length(spark):
    edges = [(i, i + 1) for i in range(150)] + [(i, i + 1) for i in range(999, 930, -1)] + [(2000, 2001)]
    found = {r["node"]: r["component"] for r in labelled(spark.createDataFrame(edges, "a long, b long").repartition(2)).collect()}
    assert found == {i: 0 for i in range(151)} | {i: 931 for i in range(931, 1001)} | {2000: 2000, 2001: 2000}


def test_every_part_is_looked_up_among_all_others(spark, sf_dir):
    ids = {r[0] for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey").collect()}
    found = engine.QUERIES["fuzzy_topk"](spark, sf_dir).select("left_id", "right_id").collect()
    assert {r["left_id"] for r in found} == ids and all(r["left_id"] != r["right_id"] for r in found)


def plain_allocation(statements, sales, days):
    fits = lambda x, y: abs(x - y) <= max(10.0, max(abs(x), abs(y), 1) / 100)
    gone, sold, out = set(), set(), []
    order = lambda rows: sorted((r for r in rows if r[2] is not None), key=lambda r: (r[1], r[0]))
    left, right = order(statements), order(sales)
    near = lambda r, rows, used: [o for o in rows if o[0] not in used and abs((o[1] - r[1]).days) <= days]

    def take(own, others, kind):
        gone.update(r[0] for r in own)
        sold.update(r[0] for r in others)
        out.extend((r[0], o[0], kind) for r in own for o in others)

    for r in left:
        good = [o for o in near(r, right, sold) if fits(r[2], o[2])]
        if len(good) == 1:
            take([r], good, "ONE_TO_ONE")
    for r in left:
        pairs = [] if r[0] in gone else [p for p in combinations(near(r, right, sold), 2) if fits(r[2], p[0][2] + p[1][2])]
        if len(pairs) == 1:
            take([r], pairs[0], "ONE_TO_TWO")
    for o in right:
        pairs = [] if o[0] in sold else [p for p in combinations(near(o, left, gone), 2) if fits(o[2], p[0][2] + p[1][2])]
        if len(pairs) == 1:
            take(pairs[0], [o], "TWO_TO_ONE")
    for r in left:
        good = [] if r[0] in gone else near(r, right, sold)
        if len(good) == 1:
            take([r], good, "DATE_ONLY")
    return out


def test_allocation_consumes_in_four_tiers(spark):
    rng = random.Random(3)
    day = lambda: datetime.date(2024, 4, 1) + datetime.timedelta(rng.randrange(90))
    amount = lambda: None if rng.random() < 0.05 else float(rng.choice([1000, 2000, 3000, 4000, 5000, 7000, 9000]) + rng.randrange(40))
    rows = lambda base: [(k, base + 100 * k + i, day(), amount()) for k in range(40) for i in range(rng.randrange(12))]
    left, right = rows(0), rows(100000)
    frame = lambda x: spark.createDataFrame(x, "key long, id long, day date, amount double")
    found = relationship.allocate(frame(left), frame(right), "key").collect()
    want = [(k, *x) for k in range(40) for x in plain_allocation([r[1:] for r in left if r[0] == k], [r[1:] for r in right if r[0] == k], 7)]
    assert sorted((r["key"], r["statement_id"], r["sale_id"], r["kind"]) for r in found) == sorted(want)
    assert {x[3] for x in want} == {"ONE_TO_ONE", "ONE_TO_TWO", "TWO_TO_ONE", "DATE_ONLY"}


def test_allocation_takes_keys_of_any_size_without_a_call_for_each(spark):
    rng = random.Random(4)
    day = lambda: datetime.date(2024, 4, 1) + datetime.timedelta(rng.randrange(20))
    sizes = [rng.randrange(6) for _ in range(60)] + [60]  # the last key's windows hold most of its rows
    rows = lambda base: [(k, base + 100 * k + i, day(), float(rng.randrange(1, 400) * 25)) for k, n in enumerate(sizes) for i in range(n)]
    left, right = rows(0), rows(100000)
    name = lambda x: [(None if r[0] == 7 else r[0], *r[1:]) for r in x]  # noqa: E731  # null is a key
    frame = lambda x: spark.createDataFrame(name(x), "key long, id long, day date, amount double")
    want = [(k, *x) for k in range(61) for x in plain_allocation([r[1:] for r in left if r[0] == k], [r[1:] for r in right if r[0] == k], 7)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        found = relationship.allocate(frame(left), frame(right), "key")
        assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
        assert sorted((7 if r["key"] is None else r["key"], r["statement_id"], r["sale_id"], r["kind"]) for r in found.collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_allocation_in_small_and_large_slices_is_the_same(monkeypatch):
    rng = random.Random(5)
    rows = sorted((k, side, rng.randrange(20), 1000 * side + 100 * k + i, float(rng.randrange(1, 400) * 25)) for k in range(9) for side in (0, 1) for i in range(rng.randrange(1, 25)))
    table = pa.table({c: [r[n] for r in rows] for n, c in enumerate(("key", "side", "day", "id", "amount"))})
    cuts = [0, *(i for i in range(1, len(rows)) if rows[i][0] != rows[i - 1][0]), len(rows)]
    found = []
    for at_once in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(relationship, "AT_ONCE", at_once)
        found.append(relationship._allocated(table, cuts, 3))
    assert found[0][2] and all(f == found[0] for f in found[1:])


def test_window_puts_the_spread_side_into_two_buckets_at_most(spark):
    """Every pair within the window once, either side spread, days before 1970 too."""
    day = lambda n: datetime.date(1969, 12, 1) + datetime.timedelta(n)
    rng = random.Random(8)
    some = lambda base: [(base + i, day(rng.randrange(200)), 1.0, rng.randrange(2)) for i in range(80)]
    left, right = some(0), some(1000)
    frame = lambda rows: spark.createDataFrame(rows, "id long, day date, amount double, k long")
    for days in (0, 1, 7, 60):
        want = sorted((x[0], y[0]) for x in left for y in right if x[3] == y[3] and abs((x[1] - y[1]).days) <= days)
        for spread in ("statements", "sales"):
            found = relationship.date_window(frame(left), frame(right), days, ["k"], spread)
            assert sorted((r["id"], r["s_id"]) for r in found.select("id", "s_id").collect()) == want
            assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
