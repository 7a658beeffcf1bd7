"""Merkle manifest of a dataset: a tree over each source's documents, one over the sources, and a proof for every row.

Every row is a leaf, the SHA-256 of its fields.  Leaves are numbered within their source by a range sort and prefix sums
over its parts, so no source is ever sorted or counted in one task.  As a source's size gives the arity of each of its
nodes, a task can tell by itself when one is complete: partial parents take in children's digests by their index, and
one that has all of them becomes an event for its own parent (``Frontier``).  What a task leaves partial, a few nodes at
either end of its range, is dealt out anew by an ancestor, a few levels in each round, until no parent is partial.  The
sources' roots then are the leaves of one more such tree.  Proofs follow the links back from the root down: a node hands
each child its own path and the digests beside that child, and only the lowest nodes, FANOUT leaves each, meet the rows.

Defined cases: a null field is ``-``; rows without an id come first in their source; rows of one id lie in the order of
their leaves, and equal rows in any, which changes nothing; a null source is a source of its own, the first; a source of one row has that row's leaf for its root; an
empty table has no root and returns nothing; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from .runtime import small_batches, stored

FANOUT = 16
#: Levels that one round of the unresolved frontier goes up: a group holds FANOUT**UP partial parents at most.
UP = 3
#: Partial parents that a task holds before it gives them up to the next round, and rows of an Arrow batch.
HELD, ROWS = 4096, 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_NODES = "tree binary, n long, level int, node long, done boolean, kids array<string>"
_ARROW = pa.schema([("tree", pa.binary()), ("n", pa.int64()), ("level", pa.int32()), ("node", pa.int64()), ("done", pa.bool_()), ("kids", pa.list_(pa.string()))])


def field(c: Column) -> Column:
    """A value as it goes into a leaf: ``-`` if null, else its length in bytes, a colon and the bytes."""
    raw = c.cast("string").cast("binary")
    return F.coalesce(F.concat(F.octet_length(raw).cast("string").cast("binary"), F.lit(b":"), raw), F.lit(b"-"))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*(field(c) for c in fields)), 256)


def digest(kids: list[str]) -> str:
    return hashlib.sha256("".join(kids).encode()).hexdigest()


def depth(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


class Frontier:
    """Partial parents of one task.  ``take`` puts a child into its parent; complete parents are given out and taken on."""

    def __init__(self) -> None:
        self.open: dict[tuple[bytes, int, int], tuple[int, list[str | None], int]] = {}

    def arity(self, n: int, level: int, node: int) -> int:
        below = -(-n // FANOUT ** (level - 1))
        return min(FANOUT, below - FANOUT * node)

    def take(self, tree: bytes, n: int, level: int, node: int, kids: list[str | None]) -> Iterator[tuple]:
        """Children of a parent, None where they are not known here; yields every node that this completes."""
        while True:
            size = self.arity(n, level, node)
            _, known, missing = self.open.pop((tree, level, node), None) or (n, [None] * size, size)
            for i, kid in enumerate(kids):
                if kid is not None and known[i] is None:
                    known[i] = kid
                    missing -= 1
            if missing:
                self.open[tree, level, node] = (n, known, missing)
                return
            yield tree, n, level, node, True, known
            if len(known) == -(-n // FANOUT ** (level - 1)):  # it holds its whole level: the root
                return
            level, node, kids = level + 1, node // FANOUT, [None] * (node % FANOUT) + [digest(known)]

    def rest(self) -> Iterator[tuple]:
        for (tree, level, node), (n, kids, _) in self.open.items():
            yield tree, n, level, node, False, kids
        self.open.clear()


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    kept: list[tuple] = []
    for row in rows:
        kept.append(row)
        if len(kept) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*kept), _ARROW.types)], schema=_ARROW)
            kept = []
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*kept), _ARROW.types)], schema=_ARROW)


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names))


def _from_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def events() -> Iterator[tuple]:
        frontier = Frontier()
        for tree, n, pos, own in _rows(batches, "tree", "n", "pos", "leaf"):
            if n == 1:
                yield tree, n, 0, 0, True, [own]
                continue
            yield from frontier.take(tree, n, 1, pos // FANOUT, [None] * (pos % FANOUT) + [own])
            if len(frontier.open) > HELD:
                yield from frontier.rest()
        yield from frontier.rest()

    yield from _batches(events())


def _from_partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by their ancestor, lower levels first: what is still open when the ancestor changes stays partial."""

    def events() -> Iterator[tuple]:
        frontier, last = Frontier(), None
        for tree, n, level, node, kids, above in _rows(batches, "tree", "n", "level", "node", "kids", "above"):
            if (tree, above) != last:
                yield from frontier.rest()
                last = (tree, above)
            yield from frontier.take(tree, n, level, node, kids)
        yield from frontier.rest()

    yield from _batches(events())


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds pos, a row's number in its tree by this order, and n, the tree's size.

    A range sort over all rows; each part counts its own rows of a tree, and prefix sums over the parts do the rest.
    """
    names = rows.columns
    schema = StructType([*rows.schema.fields, StructField("part", IntegerType()), StructField("pos", LongType())])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            pos = []
            for tree in batch.column("tree").to_pylist():
                at = at + 1 if tree == last else 0
                last = tree
                pos.append(at)
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(pos), pa.int32()), pa.array(pos, pa.int64())], names=[*names, "part", "pos"])

    keys = [F.col("tree").asc(), *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(dealt.mapInArrow(places, schema), "manifest-places")
    here = placed.groupBy("tree", "part").agg(F.count("*").alias("here"))
    # as many rows as there are parts and trees: a tree's window holds one row for each part that it lies in
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = here.select("tree", "part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"), F.sum("here").over(Window.partitionBy("tree")).alias("n"))
    return placed.join(offsets, ["tree", "part"]).withColumn("pos", F.col("pos") + F.col("before")).drop("part", "before")


def grown(leaves: DataFrame) -> DataFrame:
    """All nodes (tree, n, level, node, kids) over leaves (tree, n, pos, leaf); a lone leaf is a node of level 0."""
    spark = leaves.sparkSession
    small_batches(spark)
    sorted_leaves = leaves.select("tree", "n", "pos", "leaf").sortWithinPartitions("tree", "pos")
    made = stored(sorted_leaves.mapInArrow(_from_leaves, _NODES), "manifest-nodes")
    nodes = made.filter("done")
    left = made.filter("not done")
    while not left.isEmpty():
        top = (F.floor((F.col("level") - 1) / UP) + 1) * UP  # the level of the ancestor that rows meet by
        above = F.concat_ws("-", top.cast("string"), F.floor(F.col("node") / F.pow(F.lit(float(FANOUT)), top - F.col("level"))).cast("long").cast("string"))
        dealt = left.withColumn("above", above).repartition("tree", "above").sortWithinPartitions("tree", "above", "level", "node")
        made = stored(dealt.mapInArrow(_from_partial, _NODES), "manifest-nodes")
        nodes = nodes.unionByName(made.filter("done"))
        left = made.filter("not done")
    return nodes.drop("done")


def hash_of(level: Column, kids: Column) -> Column:
    return F.when(level == 0, kids[0]).otherwise(F.sha2(F.array_join(kids, "").cast("binary"), 256))


def tops(nodes: DataFrame) -> DataFrame:
    """(tree, level, n, top): each tree's root."""
    span = F.pow(F.lit(float(FANOUT)), F.col("level"))
    root = (F.col("node") == 0) & (span >= F.col("n")) & ((F.col("level") == 0) | (span / FANOUT < F.col("n")))
    return nodes.filter(root).select("tree", "level", "n", hash_of(F.col("level"), F.col("kids")).alias("top"))


def beside(kids: Column, i: Column) -> Column:
    """What stands before and behind child i."""
    return F.struct(F.array_join(F.slice(kids, F.lit(1), i), "").alias("left"), F.array_join(F.slice(kids, i + 2, F.lit(FANOUT)), "").alias("right"))


def lowest(nodes: DataFrame, starts: DataFrame, levels: int) -> DataFrame:
    """(tree, node, lone, kids, path) of the nodes right above the leaves; path: what stands beside them on each level up.

    starts: (tree, level, path) of the roots.  Links lead down one level at a time, from a node to its children.
    """
    starts = starts.select("tree", "level", F.lit(0).cast("long").alias("node"), "path")
    lone = starts.filter("level = 0").join(nodes.filter("level = 0").select("tree", "kids"), "tree").select("tree", "node", F.lit(True).alias("lone"), "kids", "path")
    now = None
    for level in range(levels, 0, -1):
        here = starts.filter(F.col("level") == level).drop("level")
        now = here if now is None else now.unionByName(here)
        now = now.join(nodes.filter(F.col("level") == level).select("tree", "node", "kids"), ["tree", "node"])
        if level > 1:
            now = now.select("tree", "node", "kids", "path", F.posexplode("kids").alias("i", "kid")).select(
                "tree", (F.col("node") * FANOUT + F.col("i")).alias("node"), F.concat(F.array(beside(F.col("kids"), F.col("i"))), "path").alias("path")
            )
    if now is None:
        return lone
    return now.select("tree", "node", F.lit(False).alias("lone"), "kids", "path").unionByName(lone)


def proofs(leaves: DataFrame, nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """The leaves with their steps: (left, right) beside the node on each level, from the leaf's own run up."""
    most = nodes.agg(F.max("level")).first()[0] or 0
    above = lowest(nodes, starts, most).withColumnRenamed("path", "_path").withColumnRenamed("node", "_node")
    joined = leaves.withColumn("_node", F.floor(F.col("pos") / FANOUT)).join(above, ["tree", "_node"])
    own = F.array(beside(F.col("kids"), (F.col("pos") % FANOUT).cast("int")))
    return joined.withColumn("steps", F.when(F.col("lone"), F.col("_path")).otherwise(F.concat(own, "_path"))).drop("_node", "_path", "kids", "lone")


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf and what stands beside its ancestors give."""
    return F.aggregate(steps, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]).cast("binary"), 256))


def manifest(
    docs: DataFrame, changed: Column | None = None, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text"
) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, proof, folded_root, verified): every row's place in the manifest.

    proof is an array of (left, right), from the leaf up.  ``changed`` is the text as it is now, if it is to be held to
    the manifest of docs: folded_root is what the row gives today, and verified says whether that still is the root.
    """
    now = F.col(text_col) if changed is None else changed
    source = F.col(source_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), source.alias("source"),
        # a key that is never null and sorts like the bytes of the source, null first
        F.when(source.isNull(), F.lit(b"")).otherwise(F.concat(F.lit(b"\x01"), source.cast("binary"))).alias("tree"),
        leaf(*(F.col(c) for c in fields)).alias("leaf"), leaf(*(now if c == text_col else F.col(c) for c in fields)).alias("now"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = stored(rows, "manifest-leaves")  # digests, no texts: what follows never reads the documents again
    leaves = numbered(rows, [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc(), F.col("row").asc()])
    nodes = grown(leaves)
    subroots = tops(nodes)
    sources = numbered(subroots.select(F.lit(b"").alias("tree"), F.col("tree").alias("source_tree"), F.col("top").alias("leaf"), "level"), [F.col("source_tree").asc()])
    upper = grown(sources)
    root = tops(upper).select("tree", F.col("top").alias("root"), "level", F.expr("cast(array() as array<struct<left: string, right: string>>)").alias("path"))
    up = proofs(sources, upper, root.drop("root")).join(root.select("tree", "root"), "tree")
    starts = up.select(F.col("source_tree").alias("tree"), "level", F.col("steps").alias("path"))
    out = proofs(leaves, nodes, starts).join(up.select(F.col("source_tree").alias("tree"), F.col("leaf").alias("subroot"), "root"), "tree")
    again = folded(F.col("now"), F.col("steps"))
    return out.select("doc_id", "source", "leaf", "subroot", "root", F.col("steps").alias("proof"), again.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_digest(proof: Column) -> Column:
    """One digest of all that a proof holds."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def audit(docs: DataFrame) -> DataFrame:
    """The contract's rows: documents whose id's CRC-32 is divisible by 5 are held to the manifest with A-Z lower-cased."""
    altered = F.when(F.crc32(F.col("doc_id").cast("long").cast("string")) % 5 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    rows = manifest(docs, altered)
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def sql(levels: int = 5, top_levels: int = 3) -> str:
    """The same by DuckDB, for sources of up to FANOUT**levels rows and FANOUT**top_levels sources."""
    one = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf_of = lambda text: f"sha256(concat({one('doc_id')}, {one('source')}, {one('lang')}, {one('n_chars')}, {one(text)}))"
    parts = [
        # CRC-32 (reflected, 0xEDB88320) of the id's decimal digits, eight shifts a byte
        """WITH RECURSIVE crc(doc_id, digits, i, c) AS (
  SELECT doc_id, doc_id::VARCHAR, 1, 4294967295::BIGINT FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, digits, i + 1, list_reduce(list_prepend(xor(c, ascii(substr(digits, i, 1))::BIGINT), range(8)),
    lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)
  FROM crc WHERE i <= length(digits)),
tampered AS (SELECT doc_id FROM crc WHERE i = length(digits) + 1 AND xor(c, 4294967295::BIGINT) % 5 = 0)""",
        f"""altered AS (SELECT d.*, CASE WHEN doc_id IN (FROM tampered) THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS new_text FROM documents d),
r AS (SELECT doc_id, coalesce('+' || source, '') AS tree, {leaf_of('text')} AS leaf, {leaf_of('new_text')} AS now FROM altered),
s0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, leaf AS h, now AS f, '' AS proof FROM r)""",
    ]

    def climb(before: str, after: str) -> None:
        """One level: rows carry their node's number p and digest h, the digest f of the changed leaf's path, and the proof so far."""
        parts.append(f"""n_{after} AS (SELECT DISTINCT tree, p, h FROM {before}),
g_{after} AS (SELECT tree, p // {FANOUT} AS q, list(h ORDER BY p) AS kids FROM n_{after} GROUP BY ALL),
c_{after} AS (SELECT tree, count(*) AS nodes FROM n_{after} GROUP BY tree),
{after} AS (SELECT s.* EXCLUDE (p, h, f, proof), CASE WHEN nodes > 1 THEN q ELSE p END AS p,
  CASE WHEN nodes > 1 THEN sha256(array_to_string(kids, '')) ELSE h END AS h,
  CASE WHEN nodes > 1 THEN sha256(concat(array_to_string(kids[1:p % {FANOUT}], ''), f, array_to_string(kids[p % {FANOUT} + 2:], ''))) ELSE f END AS f,
  CASE WHEN nodes > 1 THEN concat(proof, array_to_string(kids[1:p % {FANOUT}], ''), array_to_string(kids[p % {FANOUT} + 2:], '')) ELSE proof END AS proof
  FROM {before} s JOIN g_{after} g ON g.tree = s.tree AND g.q = s.p // {FANOUT} JOIN c_{after} c ON c.tree = s.tree)""")

    for k in range(levels):
        climb(f"s{k}", f"s{k + 1}")
    parts.append(f"t0 AS (SELECT * REPLACE ('' AS tree, dense_rank() OVER (ORDER BY tree) - 1 AS p), h AS subroot FROM s{levels})")
    for k in range(top_levels):
        climb(f"t{k}", f"t{k + 1}")
    return ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM t{top_levels}\n"
