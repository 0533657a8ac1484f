"""Streams over logs and events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.files import Files
from ..sources.oplog import latest


def windowed(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """start, event_type, n, total per tumbling window of event time; `late` sets a watermark for streams."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """user_id, start, end, n per session of events at most `gap` apart."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class LatestSink:
    """A foreachBatch sink that keeps the last operation of each record in Parquet, one version a batch.

    A version is named by its batch, so a batch that runs again after a failure writes the same one.
    """

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = latest(batch)
        if number > 0:
            rows = latest(spark.read.parquet(f"{self.path}/v{number - 1}").unionByName(rows))
        rows.write.mode("overwrite").parquet(f"{self.path}/v{number}")
        if number > 1:  # the version before may still be read, and be needed if this batch runs again
            Files(spark).delete(f"{self.path}/v{number - 2}")

    def read(self, spark: SparkSession) -> DataFrame:
        versions = [int(n[1:]) for n in Files(spark).names(self.path) if n.startswith("v")]
        return spark.read.parquet(f"{self.path}/v{max(versions)}")


def ingest(log: DataFrame, sink: LatestSink, checkpoint: str):
    """Start the stream of log rows into a sink; ends when all that is there has been read."""
    return log.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    return "file://" + tempfile.mkdtemp(prefix="streams-")


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live records after streaming the events table as an operation log (errors are deletes)."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    path = f"{sf_dir}/events.parquet"
    shape = spark.read.parquet(path).schema
    # A file stream reads folders: the file's own folder, and this file of it.
    events = spark.readStream.schema(shape).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)
    log = events.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("insert").alias("op"), F.col("user_id").alias("record_id"), "value")
    sink = LatestSink(f"{root}/latest")
    ingest(log, sink, f"{root}/checkpoint").awaitTermination()
    return sink.read(spark).where("op = 'insert'")
