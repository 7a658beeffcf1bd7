"""Where results go: Parquet tables that runs replace, versions that only grow, rows that are replaced by key."""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_run(results: DataFrame, path: str, run_id: str) -> None:
    """The run's rows and no others are replaced."""
    out = results.withColumn("run_id", F.lit(run_id))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def claim(spark: SparkSession, path: str, text: str = "") -> bool:
    """Creates the file with this text if there is none; of several writers at once one alone gets True."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(where.getParent())
    if store.getScheme() == "file":  # whose create() looks first and writes then
        try:
            handle = os.open(where.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            return False
        with os.fdopen(handle, "w") as f:
            f.write(text)
        return True
    try:
        out = store.create(where, False)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception.getClass()) or store.exists(where):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _claimed(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in a folder of claims, a row for each version, batch or source; none where there is no folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in store.listStatus(where) if not f.getPath().getName().startswith(".")) if store.exists(where) else []


def append_version(rows: DataFrame, path: str, spark: SparkSession) -> int:
    """Adds the rows as the next version; earlier ones are never touched, and no two writers get one number.

    A number belongs to the writer that creates its claim; others go on to the next one.  A version is seen when its
    rows are all there.
    """
    version = int(max(_claimed(spark, f"{path}/_versions"), default="0")) + 1
    while not claim(spark, f"{path}/_versions/{version:012}"):
        version += 1
    rows.write.parquet(f"{path}/version={version}")
    return version


def content_digest(rows: DataFrame, by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """(by, digest, rows): a SHA-256 over all rows, whatever their order and layout; null, text and numbers are told apart.

    Rows' digests meet by their first letters, two fewer in each step, so no list is longer than what 256 hands on.
    parts: of the shuffles of all rows, where adaptive execution, which would choose them, is off.
    """
    by = by or []
    columns = [c for c in sorted(rows.columns) if c not in by]
    row = F.sha2(F.to_json(F.struct(*(F.col(c).alias(c) for c in columns)), {"ignoreNullFields": "false"}), 256)
    level = rows.select(*by, row.alias("d"))
    level = (level.repartition(parts, *by, "d") if parts else level).groupBy(*by, "d").agg(F.count("*").alias("n"))
    level = level.select(*by, F.sha2(F.concat_ws(":", "d", F.col("n").cast("string")), 256).alias("d"), "n")
    most = level.groupBy(*by).agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] or 0
    letters = 0
    while 256 ** (letters // 2) * 64 < most:
        letters += 2
    while True:
        joined = F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ","), 256)
        level = level.withColumn("_at", F.left("d", F.lit(letters)) if letters else F.lit(""))
        level = level.repartition(parts, *by, "_at") if parts else level
        level, parts = level.groupBy(*by, "_at").agg(joined.alias("d"), F.sum("n").alias("n")), None  # later levels are a part of this one
        level = level.select(*by, F.concat("_at", "d").alias("d"), "n")
        if not letters:
            return level.select(*by, F.col("d").alias("digest"), F.col("n").alias("rows"))
        letters -= 2


class AuditLog:
    """Events that are only ever added, in batches; each batch holds the digest of the one before it.

    A batch's rows are written first.  It is part of the log once its link is claimed, by which writers at once get one
    place each: who comes second reads the new last link and links to that.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def links(self) -> list[dict]:
        """The links in order: batch, folder, rows, content, previous, digest; one for each batch."""
        names = _claimed(self.spark, f"{self.path}/_links")
        if not names:
            return []
        found = self.spark.read.option("wholetext", True).text([f"{self.path}/_links/{n}" for n in names]).collect()
        return sorted((json.loads(r["value"]) for r in found), key=lambda x: x["batch"])

    def append(self, events: DataFrame) -> int:
        """Adds a batch and gives its number."""
        folder = f"batch-{uuid.uuid4().hex}"
        events.write.parquet(f"{self.path}/{folder}")
        content = self._content(folder)
        while True:
            last = self.links()[-1:] or [{"batch": 0, "digest": ""}]
            link = {"batch": last[0]["batch"] + 1, "folder": folder, **content, "previous": last[0]["digest"]}
            if claim(self.spark, f"{self.path}/_links/{link['batch']:012}", json.dumps({**link, "digest": _link_digest(link)})):
                return link["batch"]

    def _content(self, folder: str) -> dict:
        r = content_digest(self.spark.read.parquet(f"{self.path}/{folder}")).first()
        return {"content": r["digest"] if r else "", "rows": r["rows"] if r else 0}

    def events(self) -> DataFrame | None:
        """All events with their batch; None where there are none yet."""
        links = self.links()
        if not links:
            return None
        batches = self.spark.createDataFrame([(x["folder"], x["batch"]) for x in links], "_folder string, batch long")
        rows = self.spark.read.parquet(*(f"{self.path}/{x['folder']}" for x in links))
        return rows.withColumn("_folder", F.regexp_extract(F.col("_metadata.file_path"), "(batch-[0-9a-f]{32})", 1)).join(batches, "_folder").drop("_folder")

    def verify(self) -> list[dict]:
        """Each batch with whether its rows are those that were added and its link is that of the one before it."""
        out, before = [], {"batch": 0, "digest": ""}
        for x in self.links():
            same = self._content(x["folder"]) == {"content": x["content"], "rows": x["rows"]}
            linked = x["previous"] == before["digest"] and x["batch"] == before["batch"] + 1 and x["digest"] == _link_digest(x)
            out.append({"batch": x["batch"], "rows": x["rows"], "intact": same and linked})
            before = x
        return out


def _link_digest(link: dict) -> str:
    return hashlib.sha256("|".join(str(link[k]) for k in ("batch", "folder", "content", "rows", "previous")).encode()).hexdigest()


def upserted(current: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """current with the changes' rows in place of those with the same key."""
    return current.join(changes.select(*key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def catalog_actions(current: DataFrame, incoming: DataFrame, key: list[str], compared: list[str], traced: list[str]) -> DataFrame:
    """What an idempotent import does with each rule: INSERT, SKIP, UPDATE_TRACEABILITY, CONFLICT or KEEP."""
    a = current.select(*key, *(F.col(c).alias(f"a_{c}") for c in compared + traced), F.lit(True).alias("_a"))
    b = incoming.select(*key, *(F.col(c).alias(f"b_{c}") for c in compared + traced), F.lit(True).alias("_b"))
    same = lambda cols: F.forall(F.array(*(F.col(f"a_{c}").cast("string").eqNullSafe(F.col(f"b_{c}").cast("string")) for c in cols)), lambda x: x)
    action = F.when(F.col("_a").isNull(), "INSERT").when(F.col("_b").isNull(), "KEEP").when(~same(compared), "CONFLICT").when(~same(traced), "UPDATE_TRACEABILITY").otherwise("SKIP")
    return a.join(b, key, "full").select(*key, action.alias("action"))


def export_csv(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("header", True).csv(path)
