"""Approximate nearest neighbours by inner product, with a vantage-point tree for each shard.

Inner products become distances by one more component: with M the largest norm, a vector x gets sqrt(M^2 - |x|^2) and a
query 0, and then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the nearest by distance are the largest by inner product.  The
vectors are dealt by a hash of their id into shards of about SHARD_ROWS; each shard is one tree, built and searched in
one task.  A node holds a vantage point and the median distance of its points to it; a branch is left out when the
triangle inequality shows that it holds nothing nearer than the worst of the k best so far.  The bound is taken ``factor``
times: one gives the exact result, less prunes more and may miss.  Queries go down the tree together, in arrays.

Equal vectors of a shard are stored once with their k + 1 smallest ids, which is all that a list of k can need.  The
queries are a stated share of the rows; each is sent to every shard, and every shard gives back k rows for it.

Defined cases: vectors that are null, empty or zero, or hold null, NaN or infinite components take no part; vectors of
another dimension than the query's are no candidates; ties go to the smaller id; repeated ids are candidates one by one;
an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import stored

K = 20
SHARD_ROWS = 8192
LEAF = 256
FACTOR = 1.0


class VantageTree:
    """Points in arrays, ordered so that every node's points lie together."""

    def __init__(self, points: np.ndarray, seed: int = 0):
        self.points = points
        self.order = np.arange(len(points))
        self.rng = np.random.default_rng(seed)
        self.root = self._build(0, len(points))

    def _build(self, lo: int, hi: int):
        if hi - lo <= LEAF:
            return lo, hi
        own = self.order[lo:hi]
        vantage = self.points[self.rng.choice(own)]
        d = np.sqrt(np.maximum(((self.points[own] - vantage) ** 2).sum(1), 0))
        mid = (hi - lo) // 2
        split = np.argpartition(d, mid)
        self.order[lo:hi] = own[split]
        radius = d[split[mid]]
        if d.max() == d.min():  # nothing to split by
            return lo, hi
        return vantage, radius, self._build(lo, lo + mid), self._build(lo + mid, hi)

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(places, squared distances) of about the k nearest of each query, in no order; -1 where there are fewer."""
        best = np.full((len(queries), k), np.inf)
        at = np.full((len(queries), k), -1)
        norms = (self.points**2).sum(1)
        q2 = (queries**2).sum(1)

        def leaf(lo: int, hi: int, rows: np.ndarray) -> None:
            own = self.order[lo:hi]
            d = q2[rows, None] + norms[own] - 2 * queries[rows] @ self.points[own].T
            every = np.hstack([best[rows], d])
            places = np.hstack([at[rows], np.broadcast_to(own, d.shape)])
            pick = np.argpartition(every, k - 1, axis=1)[:, :k]
            best[rows] = np.take_along_axis(every, pick, 1)
            at[rows] = np.take_along_axis(places, pick, 1)

        def visit(node, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if len(node) == 2:
                leaf(*node, rows)
                return
            vantage, radius, inner, outer = node
            d = np.sqrt(np.maximum(((queries[rows] - vantage) ** 2).sum(1), 0))
            inside = d < radius
            for here, near, far in ((inside, inner, outer), (~inside, outer, inner)):
                visit(near, rows[here])
                worst = np.sqrt(np.maximum(best[rows[here]].max(1), 0))
                # the far branch is at least |d - radius| away
                visit(far, rows[here][np.abs(d[here] - radius) <= factor * worst])

        visit(self.root, np.arange(len(queries)))
        return at, best


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, dim) of the vectors that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))
    return rows.withColumn("dim", F.size("v"))


def nearest(
    df: DataFrame, k: int = K, every: int = 20, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each row whose id is divisible by ``every``."""
    rows = stored(usable(df, id_col, vector_col), "vectors")
    n, norm = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    shards = max(1, -(-n // shard_rows))
    queries = rows.filter((F.col("id") % every == 0) & F.col("id").isNotNull())
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    sent = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    most = float(norm or 0.0)

    def search(_key, points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids = points["id"].to_numpy()
        x, which = np.unique(np.stack(points["v"].to_numpy()), axis=0, return_inverse=True)
        by = np.lexsort((ids, which))
        first = np.searchsorted(which[by], np.arange(len(x) + 1))
        rank = np.arange(len(by)) - first[which[by]]
        by = by[rank <= k]  # of equal vectors the k + 1 smallest ids
        first = np.searchsorted(which[by], np.arange(len(x) + 1))
        high = np.hstack([x, np.sqrt(np.maximum(most - (x**2).sum(1), 0))[:, None]])
        q = np.stack(asked["v"].to_numpy())
        want = min(len(x), k + 1 + 11)  # the query's own vector, and some more for near ties
        at, _ = VantageTree(high).search(np.hstack([q, np.zeros((len(q), 1))]), want, factor)
        rows_, cols = np.nonzero(at >= 0)
        place = at[rows_, cols]
        score = (q[rows_] * x[place]).sum(1)  # the same order of additions for every pair
        counts = first[place + 1] - first[place]
        rep = np.repeat(np.arange(len(place)), counts)
        member = by[first[place][rep] + np.arange(len(rep)) - np.repeat(np.cumsum(counts) - counts, counts)]
        out = pd.DataFrame({"query_id": asked["id"].to_numpy()[rows_[rep]], "vec_id": ids[member], "score": score[rep]})
        out = out[out["query_id"] != out["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return out.groupby("query_id").head(k)

    found = dealt.groupBy("dim", "shard").cogroup(sent.groupBy("dim", "shard")).applyInPandas(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
