"""WARC: Merkle fixity audit of two replicas.

Records lie in archive files in the order of their ids, each at an offset range.  A record's leaf is the SHA-256 of its
header and payload; FANOUT neighbouring ranges make a node whose digest is that of its children's digests in order, and
so on up to one root for each file.  The audit compares roots, then goes down one level at a time into those branches
only whose digests differ, so of two replicas that agree only one row for each file is ever joined.

A record's slot in its file is its number in the manifest, which both replicas share, so a record that one of them lacks
disturbs its own branch alone.  Files hold RECORDS_IN_FILE slots, so no window or list is longer, whatever the skew.

Defined cases: a null payload or URL counts as empty; records without an id and those of repeated ids get slots of their
own; an empty replica makes every record of the other one missing; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import stored

FANOUT = 16
LEVELS = 3
RECORDS_IN_FILE = FANOUT**LEVELS
#: Different records of one id that are told apart by their number.
MAX_VERSIONS = 16


def record(url: Column, payload: Column) -> Column:
    """The bytes of a WARC response record."""
    text = F.coalesce(payload.cast("string"), F.lit(""))
    length = F.octet_length(text).cast("string")
    target = F.coalesce(url.cast("string"), F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), target, F.lit("\r\nContent-Length: "), length)
    return F.concat(head, F.lit("\r\n\r\n"), text, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(id, digest, n_bytes, copies): a row for each different record; equal ones are counted before any shuffle."""
    whole = record(F.col(url_col), F.col(payload_col))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.sha2(whole.cast("binary"), 256).alias("digest"), F.octet_length(whole).cast("long").alias("n_bytes"))
    return rows.groupBy("id", "digest", "n_bytes").agg(F.count("*").cast("int").alias("copies"))


def manifest(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both replicas' records side by side: (id, copy, mark, a, a_bytes, b, b_bytes).

    Records of one id meet by their number in the order of their digest.  Where an id is null or has more than
    MAX_VERSIONS different records, they meet by the digest itself (mark): no such group is ever sorted in one task.
    """
    both = a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))
    versions = both.groupBy("id", "side").agg(F.count("*").alias("n")).groupBy("id").agg(F.max("n").alias("versions")).filter("versions > 1 and id is not null")
    both = both.join(versions, "id", "left")
    by_digest = F.col("id").isNull() | (F.coalesce("versions", F.lit(1)) > MAX_VERSIONS)
    few = (F.coalesce("versions", F.lit(1)) > 1) & ~by_digest
    before = F.sum("copies").over(Window.partitionBy("id", "side").orderBy("digest").rowsBetween(Window.unboundedPreceding, -1))
    ranked = both.filter(few).withColumn("before", F.coalesce(before, F.lit(0)).cast("int"))
    rest = both.filter(~few).withColumn("before", F.lit(0))
    rows = ranked.unionByName(rest).withColumn("mark", F.when(by_digest, F.col("digest")).otherwise(""))
    rows = rows.withColumn("copy", F.explode(F.expr("sequence(before + 1, before + copies)")))
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    return rows.groupBy("id", "copy", "mark").agg(of("a", "digest").alias("a"), of("a", "n_bytes").alias("a_bytes"), of("b", "digest").alias("b"), of("b", "n_bytes").alias("b_bytes"))


def slots(both: DataFrame) -> DataFrame:
    """Adds file, slot and start: files are ranges of ids, further copies and marked records have files of their own."""
    span = F.when(F.col("id").isNull(), F.lit(-1)).otherwise(F.floor(F.col("id") / RECORDS_IN_FILE))
    split = F.when(F.col("mark") != "", F.conv(F.substring("mark", 1, 4), 16, 10).cast("long")).otherwise(F.lit(0))
    w = Window.partitionBy("span", "split", "part")
    rows = both.withColumn("span", span).withColumn("split", split).withColumn("part", F.col("copy") - 1)
    rows = rows.withColumn("slot", F.row_number().over(w.orderBy("id", "mark")) - 1)
    file = F.concat_ws("-", "span", "split", "part", F.floor(F.col("slot") / RECORDS_IN_FILE))
    rows = rows.withColumn("file", file).withColumn("slot", (F.col("slot") % RECORDS_IN_FILE).cast("int"))
    before = F.sum(F.coalesce("a_bytes", "b_bytes")).over(Window.partitionBy("file").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("start", F.coalesce(before, F.lit(0)))


def tree(rows: DataFrame, digest: str) -> list[DataFrame]:
    """Levels of nodes (file, node, digest, first, last), the root first; the leaves are not among them."""
    level = rows.filter(F.col(digest).isNotNull()).select(
        "file", F.col("slot").alias("node"), F.col(digest).alias("digest"), F.col("start").alias("first"),
        (F.col("start") + F.coalesce("a_bytes", "b_bytes")).alias("last"),
    )
    out = []
    for _ in range(LEVELS):
        # FANOUT children at most: the list is bounded
        children = F.array_sort(F.collect_list(F.struct("node", "digest")))
        joined = F.sha2(F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["node"].cast("string"), c["digest"])), ","), 256)
        level = level.groupBy("file", F.floor(F.col("node") / FANOUT).cast("int").alias("parent")).agg(joined.alias("digest"), F.min("first").alias("first"), F.max("last").alias("last"))
        level = level.withColumnRenamed("parent", "node")
        out.insert(0, level)
    return out


def audit(a: DataFrame, b: DataFrame, **columns: str) -> DataFrame:
    """(page_id, file, slot, start, n_bytes, status, digest_a, digest_b) of every record in which the replicas differ.

    status is corrupt, missing (only in a) or extra (only in b).
    """
    rows = stored(slots(manifest(leaves(a, **columns), leaves(b, **columns))), "warc-manifest")  # digests, no payloads
    bad: DataFrame | None = None
    for one, two in zip(tree(rows, "a"), tree(rows, "b"), strict=True):
        if bad is not None:  # only children of branches that differ
            one, two = (x.withColumn("parent", F.floor(F.col("node") / FANOUT).cast("int")).join(bad, ["file", "parent"]) for x in (one, two))
        two = two.select("file", "node", F.col("digest").alias("other"))
        differ = one.join(two, ["file", "node"], "full").filter(~F.col("digest").eqNullSafe(F.col("other")))
        bad = differ.select("file", F.col("node").alias("parent"))
    suspects = rows.withColumn("parent", F.floor(F.col("slot") / FANOUT).cast("int")).join(bad, ["file", "parent"])
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("corrupt")
    return suspects.filter(~F.col("a").eqNullSafe(F.col("b"))).select(
        F.col("id").alias("page_id"), "file", "slot", "start", F.coalesce("a_bytes", "b_bytes").alias("n_bytes"), status.alias("status"),
        F.col("a").alias("digest_a"), F.col("b").alias("digest_b"),
    )


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known damage, for the query and the tests: one page in 101 has a bit changed, one in 211 is lost."""
    html = F.when(F.col("page_id") % 101 == 7, F.concat(F.lit("\u007f"), F.expr("substr(html, 2)"))).otherwise(F.col("html"))
    return pages.filter("page_id % 211 != 3").select("page_id", "url", html.alias("html"))


#: The query's rows by SQL.
SQL = f"""
WITH a AS (SELECT page_id, url, html FROM pages),
b AS (SELECT page_id, url, CASE WHEN page_id % 101 = 7 THEN chr(127) || substr(html, 2) ELSE html END AS html
  FROM pages WHERE page_id % 211 != 3),
r AS (
  SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
    || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html
    || chr(13) || chr(10) || chr(13) || chr(10) AS body FROM a),
s AS (
  SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
    || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html
    || chr(13) || chr(10) || chr(13) || chr(10) AS body FROM b),
placed AS (
  SELECT page_id, (page_id // {RECORDS_IN_FILE}) || '-0-0-0' AS file, strlen(body)::BIGINT AS n_bytes, sha256(body) AS digest_a,
    (row_number() OVER w - 1)::INTEGER AS slot,
    coalesce(sum(strlen(body)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM r WINDOW w AS (PARTITION BY page_id // {RECORDS_IN_FILE} ORDER BY page_id))
SELECT page_id, file, slot, start, n_bytes, CASE WHEN body IS NULL THEN 'missing' ELSE 'corrupt' END AS status,
  digest_a, sha256(body) AS digest_b
FROM placed LEFT JOIN s USING (page_id) WHERE digest_a IS DISTINCT FROM sha256(body)
"""
