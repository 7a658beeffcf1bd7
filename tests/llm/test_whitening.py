import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, id string, dim string, part string"


def table_of(spark, vectors, ids=None):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x", "x") for i, v in zip(ids or range(len(vectors)), vectors)], SCHEMA)


def as_floats(v):
    return [float(np.float32(c)) for c in v]


def expected(vectors):
    """By exact sums and numpy's solver: (n, S, eigenvalues, vectors, trace)."""
    fit = sorted({tuple(math.floor(256 * c) for c in v) for v in vectors})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(x) - s / n for x, s in zip(row, sums)] for row in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return n, sums, values[::-1], axes[:, ::-1]


@pytest.mark.parametrize("d", [1, 2, 3, 8, 33])
def test_eigen_solve(d):
    rng = np.random.default_rng(d)
    for make in (lambda: rng.normal(size=(d, d)), lambda: np.ones((d, d)), lambda: np.diag(rng.integers(0, 3, d) * 1.0), lambda: np.zeros((d, d)), lambda: rng.normal(size=(d, d)) * 10.0 ** rng.integers(-6, 6, d)):
        a = make()
        v = a @ a.T
        values, axes = whitening.eigen(v)
        assert np.allclose(axes.T @ axes, np.eye(d), atol=1e-12)
        assert np.allclose(axes * values @ axes.T, v, atol=1e-12 * max(1, np.abs(v).max()) * d)
        assert np.allclose(values, np.linalg.eigvalsh(v)[::-1], atol=1e-12 * max(1, np.abs(v).max()) * d)
        assert (np.diff(values) <= 0).all()


def test_merging_equals_one_pass():
    x = np.random.default_rng(0).normal(size=(200, 5)) * 1000 + 1e6
    whole, merged = whitening.Welford(5), whitening.Welford(5)
    for row in x:
        whole.take(row)
    for part in np.array_split(x, 7):
        w = whitening.Welford(5)
        for row in part:
            w.take(row)
        merged.merge(w.n, w.mean, w.products)
    assert np.allclose(whole.covariance(), np.cov(x.T, bias=True), rtol=1e-9)
    assert np.allclose(merged.covariance(), whole.covariance(), rtol=1e-9)


def test_states_of_many_tasks_meet(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MERGED", 3)
    x = np.random.default_rng(1).integers(-300, 300, (250, 4))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(11)
    (r,) = whitening.merged(whitening.states(df), 11).collect()
    assert (r["dim"], r["n"], r["sums"]) == (4, 250, x.sum(0).tolist())
    assert np.allclose(np.reshape(r["products"], (4, 4)) / 250, np.cov(x.T, bias=True))


def held_to(rows, vectors, ids):
    n, sums, values, axes = expected(vectors)
    trace = values.sum()
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(rows) == len(vectors) * min(4, len(sums))
    for k in range(min(4, len(sums))):
        sign = 0
        for i, v in zip(ids, vectors):
            r, x = got[i, k + 1], [math.floor(256 * c) for c in v]
            assert r["n"] == n and r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(x, sums))
            assert math.isclose(r["explained"], values[k] / trace, rel_tol=1e-9) and r["identity_error"] < 1e-9
            want = sum((a - b / n) * u for a, b, u in zip(x, sums, axes[:, k])) / math.sqrt(values[k])
            sign = sign or (1 if abs(r["whitened"] - want) < abs(r["whitened"] + want) else -1)
            assert abs(r["whitened"] * sign - want) < 1e-8


def test_against_exact_sums(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MERGED", 2)  # several rounds of merging
    rng = np.random.default_rng(5)
    vectors = [as_floats(v) for v in rng.normal(size=(300, 6)) @ np.diag([3, 2, 1.5, 1, 0.5, 0.2])]
    vectors += vectors[:40] + [vectors[0]] * 50  # repeated ones count once, and have rows of their own
    ids = list(range(len(vectors)))
    held_to(whitening.whiten(table_of(spark, vectors).repartition(9)).collect(), vectors, ids)


def test_the_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    vectors = [r["embedding"] for r in rows]
    held_to(whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).collect(), vectors, [r["vec_id"] for r in rows])


def test_odd_vectors(spark):
    good = [[1.0, 2.0], [2.0, -1.0], [0.5, 0.25], [-0.001, 0.0]]
    bad = [None, [None, 1.0], [float("nan"), 1.0], [float("inf"), 0.0], []]
    rows = whitening.whiten(table_of(spark, good + bad + good[:1], [1, 2, 3, None, 5, 6, 7, 8, 9, 1])).collect()
    assert len(rows) == 10 and {r["vec_id"] for r in rows} == {1, 2, 3, None} and {r["n"] for r in rows} == {4}
    assert {r["deviation"] for r in rows if r["vec_id"] is None} == {sum((4 * a - b) ** 2 for a, b in zip((-1, 0), (895, 320)))}
    # two lengths are fitted apart
    both = whitening.whiten(table_of(spark, [*good, [1.0, 2.0, 3.0], [0.0, 1.0, 0.0]])).collect()
    assert {(r["n"], r["vec_id"] < 4) for r in both} == {(4, True), (2, False)} and len(both) == 14
    assert [r["whitened"] is None for r in sorted(both, key=lambda r: (r["vec_id"], r["component"]))[8:]] == [False, True, True] * 2
    # no variance at all, huge entries, nothing
    same = whitening.whiten(table_of(spark, [[1.0, 1.0]] * 3)).collect()
    assert len(same) == 6 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 and r["identity_error"] is None for r in same)
    huge = whitening.whiten(table_of(spark, [[3e14, 1.0], [-3e14, 1.0], [1.0, 1.0]])).collect()
    assert any(r["deviation"] is None for r in huge) and all(r["whitened"] is not None for r in huge if r["component"] == 1)
    assert whitening.whiten(table_of(spark, good).limit(0)).collect() == []
    assert whitening.whiten(table_of(spark, bad)).collect() == []


def test_too_many_lengths(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MOST_LENGTHS", 2)
    with pytest.raises(ValueError, match="lengths"):
        whitening.whiten(table_of(spark, [[1.0] * k for k in range(1, 5)]))


def test_doubles_are_read_too(spark):
    df = spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.3, -0.1])], "vec_id long, embedding array<double>")
    assert sorted(r["deviation"] for r in whitening.whiten(df.filter(F.lit(True))).filter("component = 1").collect()) == [51**2 + 77**2] * 2
