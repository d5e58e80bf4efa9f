"""Hourly and session roll-ups of a growing log as Structured Streaming jobs over Parquet files.

Files are read as they arrive; ``availableNow`` works off what is there and stops, so the same call is a backfill
and, from its checkpoint, the next increment. State holds open hours and sessions only: the watermark closes
them ``lateness`` behind the newest event. Events behind the watermark are left out, and ``late_events`` tells them.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructField, StructType

from logtide.functions.columns import LOC
from logtide.operators.rollups import SESSION_GAP
from logtide.sources.log import valid_events

#: Location of the marker that closes all sessions; no log has it, since locations are coordinates.
END = "end of log"
#: Windows that touch are merged, so a break is a gap of more than ``SESSION_GAP`` seconds.
GAP = f"{SESSION_GAP} seconds"


def log_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Canonical log files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def hourly_rollup(events: DataFrame, lateness: str) -> DataFrame:
    """(location, hour) counts of a stream or table of events."""
    return valid_events(events).withWatermark("ts", lateness) \
        .groupBy(LOC, F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")) \
        .select(LOC, F.col("w.start").alias("hour_ts"), "n")


def stream_hours(events: DataFrame, target: str, checkpoint: str, lateness: str = "2 hours") -> StreamingQuery:
    """Start the hourly roll-up; every batch writes the hours it changed to a folder of its own.

    A batch that is repeated after a failure overwrites its folder, so nothing is counted twice.
    """
    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{target}/batch={batch}")
    return hourly_rollup(events, lateness).writeStream.outputMode("update").foreachBatch(write) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hours(spark: SparkSession, target: str) -> DataFrame:
    """The hourly table as of the last batch: counts only grow, so the largest is the newest."""
    return spark.read.schema(f"{LOC} string, hour_ts timestamp, n long").parquet(f"{target}/batch=*") \
        .groupBy(LOC, "hour_ts").agg(F.max("n").alias("n"))


def late_events(log: DataFrame, table: DataFrame) -> DataFrame:
    """(location, hour, late): events of a log that the hourly table left out because they came behind the watermark."""
    seen = table.select(LOC, "hour_ts", (-F.col("n")).alias("n"))
    every = valid_events(log).groupBy(LOC, F.date_trunc("hour", "ts").alias("hour_ts")).agg(F.count(F.lit(1)).alias("n"))
    return every.unionByName(seen).groupBy(LOC, "hour_ts").agg(F.sum("n").alias("late")).where("late > 0")


def session_rollup(events: DataFrame, lateness: str) -> DataFrame:
    """Sessions of a stream or table of events: location, first and last event, number of events."""
    return valid_events(events).withWatermark("ts", lateness) \
        .groupBy(LOC, F.session_window("ts", GAP).alias("w")) \
        .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n")) \
        .select(LOC, "first_ts", "last_ts", "n")


def stream_sessions(events: DataFrame, target: str, checkpoint: str, lateness: str = "2 hours") -> StreamingQuery:
    """Start the session roll-up; a session is written once, when the watermark has passed its end and gap.

    Sessions are merged before the shuffle, so a location with a third of the log sends few rows a task.
    """
    events.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return session_rollup(events, lateness).writeStream.outputMode("append").format("parquet") \
        .option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def close_log(spark: SparkSession, folder: str, schema: StructType) -> None:
    """Add the marker file behind which all sessions are closed; later events are late."""
    row = {LOC: END, "ts": datetime(9999, 1, 1)}
    nullable = StructType([StructField(f.name, f.dataType) for f in schema])
    spark.createDataFrame([tuple(row.get(f.name) for f in schema)], nullable).coalesce(1).write.mode("append").parquet(folder)


def sessions(spark: SparkSession, target: str) -> DataFrame:
    """Sessions written so far."""
    return spark.read.schema(f"{LOC} string, first_ts timestamp, last_ts timestamp, n long").parquet(target) \
        .where(F.col(LOC) != END)
