import math

import numpy as np
import pytest

from ledgerloom.llm import ann


def brute(rows, k, every):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, x in good:
        if q is None or q % every:
            continue
        scored = sorted((-float((x * v).sum()), i) for i, v in good if i is not None and i != q and len(v) == len(x))
        out += [(q, r + 1, i) for r, (_, i) in enumerate(scored[:k])]
    return sorted(out)


def got(table, **kw):
    return sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(table, **kw).collect())


def test_matches_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    assert got(table) == brute(rows, 20, 20)
    assert got(table, shard_rows=40) == brute(rows, 20, 20)


def test_odd_vectors(spark):
    rows = [(i, [math.cos(i % 7), math.sin(i % 7)]) for i in range(300)]
    rows += [(1000, None), (1001, []), (1002, [0.0, 0.0]), (1003, [float("nan"), 1.0]), (1004, [None, 1.0]), (1020, [float("inf"), 1.0]), (1040, [1.0, 2.0, 3.0]), (1041, [3.0, 2.0, 1.0]), (1060, [1.0])]
    table = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, label int, id string, rank string")
    for size in (16, 10_000):
        assert got(table, shard_rows=size) == brute(rows, 20, 20)
    assert got(table.limit(0)) == []


def test_factor_trades_recall_for_work():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8))
    x = np.repeat(centres, 100, 0) + 0.05 * rng.normal(size=(4000, 8))
    tree = ann.VantageTree(x)
    q = x[::50]
    exact = np.argsort(((q[:, None] - x[None]) ** 2).sum(2), 1)[:, :10]
    recall = {}
    for factor in (1.0, 0.5):
        at, _ = tree.search(q, 10, factor)
        recall[factor] = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(at, exact)])
    assert recall[1.0] == 1.0 and recall[0.5] >= 0.9


@pytest.mark.parametrize("n", [1, 5, 300])
def test_tree_of_equal_points(n):
    at, d = ann.VantageTree(np.ones((n, 3))).search(np.ones((2, 3)), 4, 1.0)
    assert (np.sort(at)[:, -min(4, n) :] >= 0).all()
