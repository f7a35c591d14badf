"""Structured Streaming: the same column pipelines over files as they arrive."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; without that setting below a temporary folder within one machine, as in tests, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and every executor see")
        base = f"file://{tempfile.mkdtemp(prefix='lodestep-stream-')}"
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system, so any store works."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def run_once(source: DataFrame, path: str, folder: str, keys: list[str] | None = None, time_column: str | None = None, late: str = "1 hour") -> None:
    """Appends what a streaming source holds to Parquet at ``path`` and ends; a later run with the same ``folder`` goes on from there.

    With ``keys`` and ``time_column`` rows that repeat the keys within ``late`` are written once.
    """
    if keys and time_column:
        source = source.withWatermark(time_column, late).dropDuplicatesWithinWatermark(keys)
    sink = source.writeStream.format("parquet").option("path", path).option("checkpointLocation", folder).outputMode("append")
    sink.trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, time_column: str, key: str, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by key in tumbling windows of event time."""
    seen = events.withWatermark(time_column, late) if events.isStreaming else events
    return seen.groupBy(F.window(time_column, length), key).agg(F.count("*").alias("n"))


def drain_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by event type of the events table read as a stream of files, drained into a Parquet table."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(f"{sf_dir}/")
    folder = shared_folder(spark)
    run_once(stream.select("event_id", "event_type", "value"), f"{folder}/out", f"{folder}/checkpoint")
    out = spark.read.parquet(f"{folder}/out")
    totals = out.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    totals.coalesce(1).write.parquet(f"{folder}-totals")  # one row for each type; what was drained goes
    remove(spark, folder)
    return spark.read.schema(totals.schema).parquet(f"{folder}-totals")
