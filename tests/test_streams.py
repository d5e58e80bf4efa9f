"""Streaming roll-ups against the batch ones: split and unordered batches, restarts, late events, exact gaps."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logtide.functions.columns import LOC
from logtide.operators import timing
from logtide.streaming import rollups

START = datetime(2024, 3, 1, 8)


def events(spark, make_log, *seconds, place="1.0,2.0"):
    return make_log([{"ts": None if s is None else START + timedelta(seconds=s), "geo_location": place}
                     for s in seconds]).log.coalesce(1)


@pytest.fixture
def paths(tmp_path):
    return [str(tmp_path / x) for x in ("log", "out", "state")]


def hour_counts(df):
    return {(r[LOC], r["hour_ts"]): r["n"] for r in df.collect()}


def test_hours_grow_over_restarts_and_late_events_are_told(spark, make_log, paths):
    folder, target, state = paths
    batches = [(0, 10, 4000), (3500, None, 20000), (5, 19000)]
    for seconds in batches:
        part = events(spark, make_log, *seconds)
        part.write.mode("append").parquet(folder)
        rollups.stream_hours(rollups.log_stream(spark, folder, part.schema), target, state, "1 hour").awaitTermination()
    table = rollups.hours(spark, target)
    # The newest event stands at 20000 s, so an event at 5 s is behind the watermark and one at 19000 s is not.
    assert sorted(hour_counts(table).values()) == [1, 2, 3]
    late = rollups.late_events(spark.read.parquet(folder), table).collect()
    assert [(r["hour_ts"], r["late"]) for r in late] == [(START, 1)]


def test_a_repeated_batch_is_not_counted_twice(spark, make_log, paths):
    folder, target, state = paths
    part = events(spark, make_log, 0, 10)
    part.write.parquet(folder)
    for _ in range(2):
        rollups.stream_hours(rollups.log_stream(spark, folder, part.schema), target, state).awaitTermination()
    assert list(hour_counts(rollups.hours(spark, target)).values()) == [2]


def test_sessions_break_above_the_gap_only(spark, make_log, paths):
    folder, target, state = paths
    parts = [(0, 1800, 3600.000001), (5400.000002, 9000), (100, 7300), (None,)]
    for seconds in parts:
        part = events(spark, make_log, *seconds)
        part.write.mode("append").parquet(folder)
        rollups.stream_sessions(rollups.log_stream(spark, folder, part.schema, 1), target, state,
                                "1 day").awaitTermination()
    assert rollups.sessions(spark, target).count() == 0  # all are open yet
    log = spark.read.parquet(folder)
    rollups.close_log(spark, folder, log.schema)
    rollups.stream_sessions(rollups.log_stream(spark, folder, log.schema, 1), target, state, "1 day").awaitTermination()
    got = sorted((r["first_ts"], r["last_ts"], r["n"]) for r in rollups.sessions(spark, target).collect())
    at = [START + timedelta(seconds=s) for s in (0, 1800, 3600.000001, 5400.000002, 7300, 9000)]
    assert got == [(at[0], at[1], 3), (at[2], at[2], 1), (at[3], at[3], 1), (at[4], at[5], 2)]


def test_sessions_equal_the_batch_job(spark, make_log, paths):
    import random
    folder, target, state = paths
    rng = random.Random(6)
    rows = [{"ts": START + timedelta(seconds=rng.randrange(200000)), "geo_location": f"{rng.randrange(4)}.0,1.0"}
            for _ in range(500)]
    views = make_log(rows)
    views.log.repartition(5).write.parquet(folder)
    schema = views.log.schema
    rollups.close_log(spark, folder, schema)
    rollups.stream_sessions(rollups.log_stream(spark, folder, schema), target, state).awaitTermination()
    got = sorted((r[LOC], r["n"]) for r in rollups.sessions(spark, target).collect())
    want = sorted((r[LOC], r["downloads"]) for r in timing.sessions(views).collect())
    assert got == want and sum(n for _, n in got) == 500
    assert rollups.sessions(spark, target).where(F.col("last_ts") < F.col("first_ts")).count() == 0
