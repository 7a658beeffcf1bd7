"""Events as a stream: files are taken as they come, late ones within the watermark, and windows are given out once."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import AtomicType

from ..sources import sinks

#: Rows of a stream's batch that one task holds, about.
TASK_ROWS = 200_000


def event_stream(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def windowed_totals(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    grouped = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


def ingest_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Takes what is there and stops; a next call goes on where this one ended, so nothing is taken twice."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


class Register:
    """Which sources were taken: a job's id and the digest of what it brought.

    Rows lie in a folder named by their digest, which a second try writes over; a source counts once it is registered,
    and only registered folders are read.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def entries(self) -> dict[str, str]:
        """job -> digest."""
        names = sinks._claimed(self.spark, f"{self.path}/_jobs")
        if not names:
            return {}
        found = self.spark.read.option("wholetext", True).text([f"{self.path}/_jobs/{n}" for n in names]).collect()
        return {x["job"]: x["digest"] for x in (json.loads(r["value"]) for r in found)}

    def take(self, rows: DataFrame, job_col: str) -> int:
        """Takes the jobs' rows that are new and gives their number of jobs.

        A job that was taken with the same rows is passed over, and so is one that brings another job's very rows; a known
        job with other rows is refused, with all that came along.
        """
        known = self.entries()
        # a batch of a stream runs without adaptive execution, so the number of a shuffle's parts must be given
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))
        # a row for each job of one call
        found = {r[job_col]: r["digest"] for r in sinks.content_digest(rows, [job_col], parts).collect()}
        changed = sorted(j for j, d in found.items() if known.get(j, d) != d)
        if changed:
            raise ValueError(f"taken before with other rows: {', '.join(changed)}")
        taken, new = set(known.values()), {}
        for job, digest in sorted(found.items()):
            if job not in known and digest not in taken:
                new[job] = digest
                taken.add(digest)
        if new:
            digests = self.spark.createDataFrame(list(new.items()), "job string, source string")
            brought = rows.join(F.broadcast(digests), rows[job_col] == digests["job"]).drop("job", job_col)
            # a task sorts its rows by source: dealt by what they hold, so that no file makes a task large
            brought = brought.repartition(parts, "source", *(f.name for f in brought.schema if isinstance(f.dataType, AtomicType)))
            brought.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(f"{self.path}/rows")
            for job, digest in new.items():
                name = hashlib.sha256(job.encode()).hexdigest()
                if not sinks.claim(self.spark, f"{self.path}/_jobs/{name}", json.dumps({"job": job, "digest": digest})) and self.entries()[job] != digest:
                    raise ValueError(f"taken before with other rows: {job}")
        return len(new)

    def rows(self) -> DataFrame:
        """What registered jobs brought, each row once."""
        digests = self.spark.createDataFrame([(d,) for d in sorted(set(self.entries().values()))], "source string")
        return self.spark.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows").join(F.broadcast(digests), "source", "left_semi")  # a source's rows stay where they are


def ingest_once(stream: DataFrame, register: Register, checkpoint: str) -> StreamingQuery:
    """Takes the files that are there and stops.  Each file is a job: a stream that has lost its checkpoint sees all files
    again and takes none twice."""
    named = stream.withColumn("_job", F.col("_metadata.file_path"))
    return named.writeStream.foreachBatch(lambda rows, _: register.take(rows, "_job")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
