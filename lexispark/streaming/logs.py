"""Logs as a stream: batches are parsed each for itself, or traces are kept open across batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexispark.sources import logs

BATCH = 1000


def read_lines(spark: SparkSession, path: str, max_files: int = 10) -> DataFrame:
    """(path, line_number, line): a stream of the numbered lines of files that appear under ``path``.

    A file is read whole, by one task, since only its beginning tells the number of a line; its lines are rows from
    there on. Files beyond what a task can hold are to be rotated, as logs are.
    """
    files = spark.readStream.option("maxFilesPerTrigger", max_files).text(path, wholetext=True)
    lines = F.posexplode(F.split(F.regexp_replace("value", "\\r?\\n\\z", ""), "\\r?\\n", -1)).alias("_n", "line")
    return files.select(F.col("_metadata.file_path").alias("path"), lines).select("path", (F.col("_n") + 1).cast("long").alias("line_number"), "line")


def batched(df: DataFrame, size: int = BATCH) -> DataFrame:
    """Lines with ``line_number`` as chunks of traces, each ``size`` lines of a file by themselves: a trace across a border becomes two."""
    entries = logs.line_entries(df)
    entries = entries.withColumn("path", F.concat_ws("#", "path", F.floor((F.col("line_number") - 1) / size).cast("string")))
    out = logs.traces(entries)
    return out.withColumn("batch", F.substring_index("path", "#", -1).cast("long")).withColumn("path", F.substring_index("path", "#", 1))


def write_chunks(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Each micro-batch of (path, line_number, line) as chunks, given to ``sink`` with its number; a repeated batch has the same number."""

    def one(df: DataFrame, number: int) -> None:
        sink(batched(df), number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def sessions(stream: DataFrame, gap: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Traces by event time: (trace_id, start, end, entry_count, has_error). Entries need a timestamp; those later than ``late`` are dropped by the watermark."""
    entry = logs.text_entry(F.trim("line"))
    rows = stream.select(entry.alias("e")).select("e.*").withColumn("at", F.try_to_timestamp("timestamp")).where("at IS NOT NULL")
    rows = rows.withColumn("id", F.coalesce("trace_id", "transaction_id", "request_id")).where("id IS NOT NULL").withWatermark("at", late)
    out = rows.groupBy("id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("entry_count"), F.max("is_error").alias("has_error"))
    return out.select(F.col("id").alias("trace_id"), F.col("w.start").alias("start"), F.col("w.end").alias("end"), "entry_count", "has_error")
