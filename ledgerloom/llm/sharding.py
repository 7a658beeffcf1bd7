"""Sharding by extendible hashing, with DataFrame functions only.

A document's place is a 60-bit digest of its id and text.  The directory is indexed by the leading bits: a bucket whose
bytes exceed the limit is split on one more bit, and only such buckets are, so depths differ from bucket to bucket.
The bytes are first summed by the leading bits of a fine grid, about GRID cells for each shard, and every level of the
directory is summed from that grid, so the documents are shuffled once for the sums and their texts never.

Defined cases: a null text has 0 bytes; a document that is larger than the limit, and rows that are equal in id and text
and so share all bits, can't be split any further: they stay in a bucket of their own at MAX_DEPTH, marked
``oversized``; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import fresh, stored

BITS = 60
#: The deepest split; 2**MAX_DEPTH shards are more than any table has documents for.
MAX_DEPTH = 40
#: Levels that are summed from one grid of cells before the grid is refined for the buckets that are still too large.
LEVELS = 8
LIMIT = 1 << 20


def place(id_: Column, text: Column) -> Column:
    """The leading 60 bits of a digest of id and text."""
    mark = F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("null")), F.coalesce(F.md5(text.cast("binary")), F.lit("null")))
    return F.conv(F.substring(F.md5(mark), 1, 15), 16, 10).cast("long")


def directory(rows: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """((depth, prefix, shard_bytes) of every bucket, the largest depth) for rows (place, n_bytes)."""
    pending = rows.groupBy(F.shiftright("place", BITS - LEVELS).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"))
    found, depth, start = [], 0, 0
    open_buckets: DataFrame | None = None
    while True:
        # every bucket of the levels start .. depth of this grid, and the parent that had to be too large for it
        depth = min(start + LEVELS, MAX_DEPTH)
        cells = stored(pending, "shard-cells")
        levels = range(start, depth + 1)
        at = F.explode(F.array(*map(F.lit, levels))).alias("depth")
        sums = cells.select(at, "cell", "n_bytes")
        sums = sums.groupBy("depth", F.expr(f"shiftright(cell, {depth} - depth)").alias("prefix")).agg(F.sum("n_bytes").alias("shard_bytes"))
        sums = stored(sums, "shard-levels")
        large = sums.filter((F.col("shard_bytes") > limit) & (F.col("depth") < MAX_DEPTH))
        parents = large.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        fits = sums.filter((F.col("shard_bytes") <= limit) | (F.col("depth") == MAX_DEPTH))
        first = fits.filter(F.col("depth") == start)
        if open_buckets is not None:  # a bucket of the refined grid's first level is the large one that is open itself
            first = first.limit(0)
        inner = fits.withColumn("parent", F.shiftright("prefix", 1)).join(parents, ["depth", "parent"]).filter(F.col("depth") > start)
        found.append(first.select("depth", "prefix", "shard_bytes").unionByName(inner.select("depth", "prefix", "shard_bytes")))
        open_buckets = large.filter(F.col("depth") == depth).select(F.col("prefix").alias("open"))
        if depth == MAX_DEPTH or open_buckets.isEmpty():
            break
        start = depth
        finer = min(start + LEVELS, MAX_DEPTH)
        inside = rows.withColumn("open", F.shiftright("place", BITS - start)).join(open_buckets, "open")
        pending = inside.groupBy(F.shiftright("place", BITS - finer).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"))
    buckets = found[0]
    for more in found[1:]:
        buckets = buckets.unionByName(more)
    return stored(buckets, "shard-directory"), depth


def _placed(docs: DataFrame, limit: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_bytes, place, shard, depth, shard_bytes) of every row."""
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        place(F.col(id_col), text).alias("place"),
    )
    rows = stored(rows, "shard-places")  # ids and numbers only; the texts are read once
    buckets, _ = directory(rows, limit)
    depths = sorted(r[0] for r in buckets.select("depth").distinct().collect())  # MAX_DEPTH numbers at most
    if not depths:
        depths = [0]
    prefix = F.expr("shiftright(place, 60 - depth)")
    # a row looks its bucket up at the few depths that buckets have
    keyed = rows.withColumn("depth", F.explode(F.array(*map(F.lit, depths)))).withColumn("prefix", prefix)
    bits = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return keyed.join(buckets, ["depth", "prefix"]).select("doc_id", "n_bytes", "place", bits.alias("shard"), "depth", "shard_bytes")


def shard(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, shard, depth, shard_bytes, oversized) of every row; shard is the bucket's bits as a string."""
    return _placed(docs, limit, id_col, text_col).drop("place").withColumn("oversized", F.col("shard_bytes") > limit)


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> str:
    """docs as Parquet, a folder for each shard; the name of the folders' column, ``shard`` unless docs has one.

    Rows find their shard by their place, so those that share an id but not the text each get their own, once.
    """
    own, column = fresh("shard_place", docs), fresh("shard", docs)
    shards = _placed(docs, limit, id_col, text_col).select(F.col("place").alias(own), F.col("shard").alias(column)).distinct()
    placed = docs.withColumn(own, place(F.col(id_col), F.col(text_col).cast("string"))).join(shards, own).drop(own)
    placed.repartition(column).write.partitionBy(column).parquet(path)
    return column


def sql(limit: int = LIMIT) -> str:
    """The same rows by SQL."""
    return f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null')), 1, 15))::BIGINT AS place
  FROM documents),
levels(depth) AS (SELECT unnest(range(0, 25))::INTEGER),
sums AS (
  SELECT depth, place >> (60 - depth) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes
  FROM rows, levels GROUP BY ALL),
fits AS (
  SELECT doc_id, place, n_bytes, min(depth) AS depth
  FROM rows JOIN sums ON prefix = place >> (60 - depth) WHERE shard_bytes <= {limit} GROUP BY ALL)
SELECT doc_id, n_bytes,
  CASE WHEN depth = 0 THEN '' ELSE substr(lpad(bin(place), 60, '0'), 1, depth) END AS shard,
  depth, shard_bytes, shard_bytes > {limit} AS oversized
FROM fits JOIN sums USING (depth) WHERE prefix = place >> (60 - depth)
"""
