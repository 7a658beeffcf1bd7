"""What every operator here needs: the shared folder, tables written to it, and batches of texts.

A table written with ``stored`` cuts the lineage: executors that are lost later cost no recomputation of what lies
before it.  It goes to the folder that the session names in ``spark.checkpoint.dir``, which all executors share.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the vectorised steps take at once; a single longer text is taken alone.
CHUNK_BYTES = 4 << 20
#: Bytes of an Arrow batch, about; a single longer row is a batch of its own.
BATCH_BYTES = 4 << 20
_BATCH, _NO_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1)

_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where it is unset, one of our own (the warehouse on a cluster)."""
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stored"
    if _local_dir is None:
        holder = tempfile.TemporaryDirectory(prefix="ledgerloom-")
        atexit.register(holder.cleanup)
        _local_dir = holder.name
    return _local_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, unless the user has: Spark bounds them by rows alone, and ten
    thousand long texts at once, held in the JVM and again in Python, can outgrow an executor."""
    if spark.conf.get(_BATCH, None) in (None, _NO_BOUND):
        spark.conf.set(_BATCH, BATCH_BYTES)


def fresh(name: str, *frames: DataFrame) -> str:
    """The name, with as many underscores as it takes to be no column of these tables."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed_texts(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(id, text as bytes, more): only these columns reach the scan, whatever else the table holds."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), *more)


def byte_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8; null counts as empty."""
    return [x or b"" for x in batch.column(column).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a bounded number of rows, so that what is made of one part is small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def lean(task: Callable) -> Callable:
    """The task, which gives what it has freed back to the system when it ends: Python workers outlive their tasks, and
    the C library would keep that memory beside what the next task takes."""

    @wraps(task)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
            if trim:
                trim(0)

    return run


def chunks(texts: list[bytes], most: int = CHUNK_BYTES):
    """(first, last + 1) of runs of texts that hold about ``most`` bytes together."""
    first, total = 0, 0
    for i, x in enumerate(texts):
        if total and total + len(x) > most:
            yield first, i
            first, total = i, 0
        total += len(x) + 2
    if first < len(texts):
        yield first, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def counted(parts: Iterator[np.ndarray], held: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(different keys, how often each occurs) of the parts together, given out in pieces of about ``held`` keys."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*kept))
        by = np.argsort(keys)
        keys, n = keys[by], n[by]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(n, first)

    for part in parts:
        if not len(part):
            continue
        kept.append(np.unique(part, return_counts=True))
        size += len(kept[-1][0])
        if size > held:
            kept[:] = [merged()]
            size = len(kept[0][0])
            if 2 * size > held:
                yield kept.pop()
                size = 0
    if kept:
        yield merged()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: Bytes that are hashed at once, the powers of a polynomial's base and of its inverse, a number for each byte.
_AT_ONCE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_UP, _DOWN = _powers(_BASE, _AT_ONCE), _powers(_INVERSE, _AT_ONCE)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_INK = np.array([b not in b" \t\n\v\f\r" for b in range(256)])


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place of the first byte, place after the last) of every word; A-Z count as a-z.

    A word's hash is a polynomial of its bytes' numbers, taken from prefix sums over the whole text.
    """
    a = np.frombuffer(text.lower(), np.uint8)
    ink = np.zeros(len(a) + 2, bool)
    ink[1:-1] = _INK[a]
    edges = np.flatnonzero(ink[1:] != ink[:-1])  # a word's first byte and the one after its last, in turn
    sums, down = np.zeros(len(edges), np.uint64), np.zeros(len(edges), np.uint64)
    total = 0
    for lo in range(0, len(a), _AT_ONCE):
        part = _BYTE[a[lo : lo + _AT_ONCE]]
        part *= _UP[: len(part)]
        upto = np.cumsum(np.concatenate([np.zeros(1, np.uint64), part]))
        i, j = np.searchsorted(edges, [lo, lo + len(part) + (lo + len(part) == len(a))])
        at = edges[i:j] - lo
        sums[i:j] = upto[at] * np.uint64(pow(_BASE, lo, 1 << 64)) + np.uint64(total)
        down[i:j] = _DOWN[np.minimum(at, _AT_ONCE - 1)] * np.uint64(pow(_INVERSE, lo, 1 << 64))
        total = (total + int(upto[-1]) * pow(_BASE, lo, 1 << 64)) % (1 << 64)
    first, last = edges[::2], edges[1::2]
    return mix64((sums[1::2] - sums[::2]) * down[::2] + (last - first).astype(np.uint64)), first, last
