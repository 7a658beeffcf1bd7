"""What is computed once: results in the session's checkpoint folder, or one of our own where none is named."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def with_folder(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.startswith("local") and not context.master.startswith("local-cluster"):
            named = tempfile.mkdtemp(prefix="ledgerloom-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named or df.sparkSession.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return df


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    with_folder(spark.range(0))
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and read from the shared folder by whatever uses it."""
    return with_folder(df).checkpoint()


def by_whole_keys(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """(rows, where its keys begin and the last one ends): a task's rows, sorted by key, in tables that hold whole keys; null is a key."""
    pending: list[pa.RecordBatch] = []
    cuts = [0]
    for batch in batches:
        if not batch.num_rows:
            continue
        n = sum(b.num_rows for b in pending)
        seen = pa.Table.from_batches([*(b.slice(b.num_rows - 1) for b in pending[-1:]), batch])  # with the last row before it
        new = np.zeros(seen.num_rows - 1, bool)
        for c in key:
            one, two = seen.column(c).slice(0, seen.num_rows - 1), seen.column(c).slice(1)
            new |= pc.fill_null(pc.not_equal(one, two), False).to_numpy() | pc.xor(pc.is_null(one), pc.is_null(two)).to_numpy()
        cuts += (np.flatnonzero(new) + (n if pending else 1)).tolist()
        pending.append(batch)
        if len(cuts) > 1:  # the last key may go on in the next batch
            table = pa.Table.from_batches(pending)
            yield table.slice(0, cuts[-1]), cuts
            pending, cuts = table.slice(cuts[-1]).to_batches(), [0]
    if pending:
        table = pa.Table.from_batches(pending)
        yield table, [*cuts, table.num_rows]
