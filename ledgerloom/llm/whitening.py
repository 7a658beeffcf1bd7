"""Whitening of embeddings: Welford states in partitions, merged in parallel, and a symmetric QR eigen-solve.

Vectors are quantised to whole numbers, x = floor(SCALE * c), and fitted on each different x once.  A task streams its
part of that list through Welford's update, one rank-one step a vector, and gives out one state: count, mean, sums of
centred products, and exact sums.  States of up to MERGED tasks meet in one, round after round, by the parallel form of
the update, so no task reads more than that many, however many tasks there were.  The solver makes the covariance
tridiagonal by Householder reflections and turns it by implicitly shifted QR steps (Wilkinson's shift).  What goes back to
the rows is at most COMPONENTS directions.  The whitened fit list goes through the same Welford states once more: their
covariance's distance from the identity is measured, not supposed.

Memory: a task holds one d x d matrix for vectors of length d.

Defined cases: vectors that are null, or hold null or non-finite entries, are left out, empty ones have no components;
vectors of different lengths are fitted apart, by MOST_LENGTHS different lengths at most (more raise ValueError);
repeated ids are rows of their own; entries beyond a 64-bit integer saturate; a direction without variance has null whitened and explained 0 (null where the trace
is 0), and takes no part in identity_error (null where no direction has variance); a deviation beyond a 64-bit integer is
null; an empty table returns nothing; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import slices, small_batches, stored

SCALE = 256
COMPONENTS = 4
MERGED = 32
MOST_LENGTHS = 64
_STATE = "dim int, part long, n long, sums array<long>, mean array<double>, products array<double>"
_STATE_ARROW = pa.schema([("dim", pa.int32()), ("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("mean", pa.list_(pa.float64())), ("products", pa.list_(pa.float64()))])


class Welford:
    """Count, mean and sums of centred products of the vectors seen so far."""

    def __init__(self, dim: int) -> None:
        self.n = 0
        self.mean = np.zeros(dim)
        self.products = np.zeros((dim, dim))
        self._step = np.empty((dim, dim))

    def take(self, x: np.ndarray) -> None:
        """One vector: a rank-one update by its distance from the mean before and after."""
        self.n += 1
        before = x - self.mean
        self.mean += before / self.n
        np.multiply(before[:, None], (x - self.mean)[None, :], out=self._step)
        self.products += self._step

    def merge(self, n: int, mean: np.ndarray, products: np.ndarray) -> None:
        """Another task's state: the products between the two means come in."""
        if not n:
            return
        apart, total = mean - self.mean, self.n + n
        self.products += products + np.outer(apart, apart) * (self.n * n / total)
        self.mean += apart * (n / total)
        self.n = total

    def covariance(self) -> np.ndarray:
        v = self.products / self.n
        return (v + v.T) / 2


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix, by Householder reflections and QR steps.

    Of either sign of a vector the one is given whose largest entry is positive.
    """
    a = np.array(v, np.float64)
    n = len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        size = np.linalg.norm(x)
        if size == 0 or np.linalg.norm(x[1:]) == 0:
            continue
        u = x / size
        u[0] += np.copysign(1.0, u[0])
        u /= np.linalg.norm(u)
        a[k + 1 :, k:] -= 2 * np.outer(u, u @ a[k + 1 :, k:])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ u, u)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ u, u)
    d, e = np.diag(a).copy(), np.diag(a, -1).copy()
    qt = np.ascontiguousarray(q.T)  # rows are turned, two at a time
    high, steps = n - 1, 0
    while high > 0:
        small = np.abs(e[:high]) <= np.finfo(float).eps * (np.abs(d[:high]) + np.abs(d[1 : high + 1]))
        e[:high][small] = 0
        if e[high - 1] == 0:
            high, steps = high - 1, 0
            continue
        low = int(np.flatnonzero(e[:high] == 0)[-1]) + 1 if (e[:high] == 0).any() else 0
        steps += 1
        if steps > 60:
            raise ArithmeticError("the QR steps do not converge")
        gap = (d[high - 1] - d[high]) / 2
        shift = d[high] - e[high - 1] ** 2 / (gap + np.copysign(np.hypot(gap, e[high - 1]), gap))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            one, two, off = d[k], d[k + 1], e[k]
            d[k] = c * c * one + 2 * c * s * off + s * s * two
            d[k + 1] = s * s * one - 2 * c * s * off + c * c * two
            e[k] = c * s * (two - one) + (c * c - s * s) * off
            x = e[k]
            if k < high - 1:
                z, e[k + 1] = s * e[k + 1], c * e[k + 1]
            qt[[k, k + 1]] = c * qt[k] + s * qt[k + 1], c * qt[k + 1] - s * qt[k]
    by = np.argsort(-d, kind="stable")
    vectors = qt[by].T
    if n:
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(n)] < 0, -1.0, 1.0)
    return d[by], vectors


def usable(c: Column) -> Column:
    return c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))


def quantised(c: Column, scale: int = SCALE) -> Column:
    return F.transform(c, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of the batch, their vectors as a matrix), for each length."""
    lists = batch.column(column)
    ends = lists.offsets.to_numpy()
    flat, ends = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], ends - ends[0]
    size = np.diff(ends)
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        yield rows, flat[ends[rows][:, None] + np.arange(dim)]


def _state(dim: int, part: int, sums: np.ndarray, w: Welford) -> pa.RecordBatch:
    row = {"dim": dim, "part": part, "n": w.n, "sums": sums, "mean": w.mean, "products": w.products.ravel()}
    return pa.RecordBatch.from_pylist([row], schema=_STATE_ARROW)


def states(fit: DataFrame, column: str = "x", models: dict | None = None) -> DataFrame:
    """One Welford state a task and length, of the vectors or, with models, of what these make of them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, Welford]] = {}
        for batch in slices(batches):
            for _, xs in _matrices(batch, column):
                dim = xs.shape[1]
                if not dim:
                    continue
                values = xs.astype(np.float64) if models is None else models[dim].project(xs)[:, models[dim].has_variance]
                sums, w = held.get(dim) or (np.zeros(dim, np.int64), Welford(values.shape[1]))
                sums += xs.sum(0)
                held[dim] = sums, w
                for x in values:
                    w.take(x)
        for dim, (sums, w) in held.items():
            yield _state(dim, TaskContext.get().partitionId(), sums, w)

    return fit.mapInArrow(task, _STATE)


def merged(parts: DataFrame, tasks: int) -> DataFrame:
    """One state for each length: MERGED tasks' states meet in one, as often as that number of tasks takes."""

    def meet(table: pa.Table) -> pa.Table:
        sums, w = None, None
        for row in table.to_batches(max_chunksize=1):
            mean, products, own = (row.column(c)[0].values.to_numpy() for c in ("mean", "products", "sums"))
            if w is None:
                w, sums = Welford(len(mean)), np.zeros(len(own), np.int64)
            w.merge(row.column("n")[0].as_py(), mean, products.reshape(len(mean), len(mean)))
            sums = sums + own
        return pa.Table.from_batches([_state(table.column("dim")[0].as_py(), table.column("part")[0].as_py() // MERGED, sums, w)])

    while True:
        parts = parts.withColumn("together", F.floor(F.col("part") / MERGED)).groupBy("dim", "together").applyInArrow(meet, _STATE)
        tasks = -(-tasks // MERGED)
        if tasks <= 1:
            return parts


class Model:
    """What the rows of one length need: count, sums, and the leading directions."""

    def __init__(self, n: int, sums: np.ndarray, covariance: np.ndarray, components: int) -> None:
        values, vectors = eigen(covariance)
        k = min(components, len(values))
        trace = float(np.trace(covariance))
        # what rounding leaves of a direction without variance is as small as this beside the largest
        self.has_variance = values[:k] > max(float(values.max(initial=0.0)), 0.0) * len(values) * 1e-14
        self.n, self.sums, self.vectors = n, sums, np.ascontiguousarray(vectors[:, :k])
        self.scale = np.where(self.has_variance, 1 / np.sqrt(np.where(self.has_variance, values[:k], 1.0)), np.nan)
        self.explained = None if trace <= 0 else [float(v) if ok else 0.0 for v, ok in zip(values[:k] / trace, self.has_variance)]
        self.identity_error: float | None = None

    def project(self, xs: np.ndarray) -> np.ndarray:
        # whole quotients first: x - S/n keeps its digits where both are large
        whole, part = np.divmod(self.sums, self.n)
        return ((xs - whole).astype(np.float64) - part / self.n) @ self.vectors * self.scale

    def deviation(self, xs: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)**2: by 64-bit arithmetic where that can't overflow, else by Python's integers."""
        rough = (xs.astype(np.float64) * self.n - self.sums) ** 2
        total = rough.sum(1)
        with np.errstate(over="ignore"):
            exact = ((xs * np.int64(self.n) - self.sums) ** 2).sum(1)  # modulo 2**64: right if the sum is below 2**63
        out: list[int | None] = exact.tolist()
        for i in np.flatnonzero(total > 9.2e18):
            whole = sum((self.n * int(x) - int(s)) ** 2 for x, s in zip(xs[i], self.sums))
            out[i] = whole if whole < 1 << 63 else None
        return out


def fit(vectors: DataFrame, column: str = "x", components: int = COMPONENTS) -> dict[int, Model]:
    """The models of a list of whole-numbered vectors, one for each length; each vector counts once."""
    once = stored(vectors.select(F.col(column).alias("x")).filter(F.size(column) > 0).distinct(), "whitening-fit")
    small_batches(once.sparkSession)
    tasks = once.rdd.getNumPartitions()
    lengths = once.select(F.size("x").alias("dim")).distinct().limit(MOST_LENGTHS + 1).count()
    if lengths > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} different lengths")
    # at most MOST_LENGTHS rows, d x d each
    models = {}
    for r in merged(states(once), tasks).toLocalIterator():
        w = Welford(r["dim"])
        w.merge(r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(r["dim"], r["dim"]))
        models[r["dim"]] = Model(r["n"], np.array(r["sums"], np.int64), w.covariance(), components)
    for r in merged(states(once, models=models), tasks).toLocalIterator() if models else ():
        k = len(r["mean"])
        error = np.array(r["products"]).reshape(k, k) / r["n"] - np.eye(k)
        models[r["dim"]].identity_error = float(np.abs(error).max()) if k else None
    return models


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and direction."""
    vector = F.col(vector_col)
    rows = df.filter(usable(vector)).select(F.col(id_col).cast("long").alias("id"), quantised(vector, scale).alias("x"))
    models = fit(rows, components=components)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for at, xs in _matrices(batch, "x"):
                if not xs.shape[1]:
                    continue
                m = models[xs.shape[1]]
                k, rows = m.vectors.shape[1], len(xs)
                white = m.project(xs).ravel()
                repeat = lambda a, t: pa.array(a, t).take(pa.array(np.repeat(np.arange(rows), k)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, m.n)),
                        repeat(m.deviation(xs), pa.int64()), pa.array(white, mask=np.isnan(white)), pa.array((m.explained or [None] * k) * rows, pa.float64()),
                        pa.array([m.identity_error] * (rows * k), pa.float64()),
                    ],
                    names=names,
                )

    return rows.mapInArrow(task, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
