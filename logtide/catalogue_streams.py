"""Registered queries of the streaming roll-ups, each a replay of the event log from files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logtide.functions.columns import LOC
from logtide.session import shared_path
from logtide.sources.fixtures import events_log
from logtide.streaming import rollups

#: The replay's files hold days in no order, so nothing may be late before all thirty are read.
REPLAY_LATENESS = "40 days"


def _replay(spark: SparkSession, sf_dir: str) -> tuple[str, StructType]:
    folder = shared_path(spark, "stream-log")
    log = events_log(spark, sf_dir)
    log.write.parquet(folder)
    return folder, log.schema


def _str01(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, schema = _replay(spark, sf_dir)
    target = shared_path(spark, "stream-hours")
    rollups.stream_hours(rollups.log_stream(spark, folder, schema, 4), target,
                         shared_path(spark, "stream-state"), REPLAY_LATENESS).awaitTermination()
    return rollups.hours(spark, target).select(LOC, F.unix_micros("hour_ts").alias("hour_us"), "n")


def _str02(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, schema = _replay(spark, sf_dir)
    target, state = shared_path(spark, "stream-sessions"), shared_path(spark, "stream-state")

    def work_off() -> None:
        rollups.stream_sessions(rollups.log_stream(spark, folder, schema, 4), target, state,
                                REPLAY_LATENESS).awaitTermination()
    work_off()
    rollups.close_log(spark, folder, schema)
    work_off()  # goes on from the state of the first run
    return rollups.sessions(spark, target).select(
        LOC, F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "n")


def stream_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"str01_hourly_stream": _str01, "str02_session_stream": _str02}
