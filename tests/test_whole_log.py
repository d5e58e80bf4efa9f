"""Queries over all events of a location, on literal tables that a sample of 50 events tells otherwise."""

import random
import statistics
from datetime import datetime, timedelta
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from logtide.catalogue_labels import LABEL_COLUMNS
from logtide.operators import learned, timing
from logtide.operators.rollups import LogViews
from logtide.schema import get_schema

DAY0 = datetime(1996, 1, 1)
DAYS = 1000


def moments(times):
    """Mean and deviation of the positive gaps, in seconds, from exact fractions."""
    order = sorted(set(times))
    gaps = [b - a for a, b in zip(order, order[1:])]
    mean = Fraction(sum(gaps), len(gaps))
    squares = sum((g - mean) ** 2 for g in gaps)
    sd = float(squares / (len(gaps) - 1)) ** 0.5 / 1e6 if len(gaps) > 1 else None
    return float(mean) / 1e6, sd


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_regularity_of_all_events(spark, partitions):
    """Equal times, years before 1970, half hours with many events and gaps of one microsecond or of centuries."""
    rng = random.Random(4)
    times, at = [], -10 ** 15
    for _ in range(2000):
        at += int(rng.expovariate(1 / 6e8))
        times += [at] * rng.choice([1, 1, 2])
    logs = {"random": times, "hot": [rng.randrange(900_000_000) for _ in range(3000)],
            "equal": [i * 1_800_000_001 - 10 ** 12 for i in range(500)],
            "nearly": [i * 60_000_000 + (i == 250) for i in range(500)], "two": [5, 9, 9],
            "far": [-62_135_596_800_000_000, 0, 1, 253_402_300_799_999_999]}
    rows = [(k, t) for k, v in logs.items() for t in v]
    rows += [("once", 5), ("same", 5), ("same", 5), (None, 5), ("none", None), ("two", None)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "geo_location string, us long")
    log = frame.select("geo_location", F.timestamp_micros("us").alias("ts"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = {r[0]: tuple(r)[1:] for r in
                 timing.interval_regularity(LogViews(log, get_schema("canonical")), k=None).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert set(found) == set(logs)
    for name, times in logs.items():
        mean, sd = moments(times)
        cv, score = (1.0, 0.0) if sd is None else (sd / mean, mean / (sd + 1) if sd > 0 else 0.0)
        assert found[name][0] == pytest.approx(mean, rel=1e-12)
        assert found[name][1] == (sd if not sd else pytest.approx(sd, rel=1e-12))
        assert found[name][2:] == pytest.approx((cv, score), rel=1e-12)
    assert found["equal"][1:] == (0.0, 0.0, 0.0)


# Seconds of the day 34167 and 42086 by the fixture's formula: events in working hours.
CLOCK = {0: (2, 34_167), 1: (3, 42_086)}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two suppliers: one event a day at almost the same time, and ten days with a hundred events each.

    Fifty of the daily events lie apart like random ones (deviation about the mean).
    """
    folder = str(tmp_path_factory.mktemp("tables"))
    daily = [(86_400 * i + CLOCK[i % 2][0], 1, DAY0 + timedelta(days=i)) for i in range(DAYS)]
    bursts = [(86_400 * (DAYS + i) + 1 + i % 100, 2, DAY0 + timedelta(days=100 * (i // 100))) for i in range(DAYS)]
    items = [(k, 1, k % 97, s, t) for k, s, t in daily + bursts]

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    write("lineitem", items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, "
                             "l_shipdate timestamp_ntz")
    write("orders", [(k, i) for i, (k, *_) in enumerate(items)], "o_orderkey long, o_custkey long")
    write("supplier", [(1, 0), (2, 1)], "s_suppkey long, s_nationkey long")
    write("nation", [(0, "A", 0), (1, "B", 0)], "n_nationkey long, n_name string, n_regionkey long")
    write("region", [(0, "R")], "r_regionkey long, r_name string")
    return folder


DAILY, BURSTS = "-60.04,-120.50", "-55.08,-110.50"


def by_location(tables, spark, name):
    rows = entry_points.queries()[name](spark, tables).collect()
    return {r["geo_location"]: r.asDict() for r in rows}


def daily_score():
    """Regularity of gaps of a day and by turns 7919 seconds more or less."""
    gaps = [86_400 + (7_919 if i % 2 == 0 else -7_919) for i in range(DAYS - 1)]
    return statistics.fmean(gaps) / (statistics.stdev(gaps) + 1)


def test_daily_events_are_regular(tables, spark):
    """cls01: a sample sees random gaps."""
    assert daily_score() > 10
    found = by_location(tables, spark, "cls01_matched_patterns")
    assert set(found) == {DAILY, BURSTS}
    assert found[DAILY]["behavior_type__automated__high_regularity"]
    assert not found[DAILY]["behavior_type__organic__working_hours_human"]
    assert not found[BURSTS]["behavior_type__automated__high_regularity"]
    assert found[BURSTS]["behavior_type__organic__irregular_intervals"]


def test_daily_events_are_classified_as_automated(tables, spark):
    """cls06: regular events of many users are a bot, not people in working hours."""
    found = by_location(tables, spark, "cls06_rule_classifier")[DAILY]
    assert (found["behavior_type"], found["automation_category"], found["is_bot"], found["is_organic"]) == (
        "automated", "bot", True, False)


def test_the_matrix_holds_the_regularity_of_all_events(tables, spark):
    """cls12"""
    found = by_location(tables, spark, "cls12_feature_matrix")
    assert found[DAILY]["regularity_score"] == pytest.approx(daily_score(), abs=1e-6)
    assert found[BURSTS]["regularity_score"] < 0.5


def test_labels_after_demotion_rest_on_all_events(tables, spark):
    """cls15"""
    found = by_location(tables, spark, "cls15_hub_demotion")[DAILY]
    assert (found["behavior_type"], found["automation_category"], found["is_protected_hub"]) == (
        "automated", "bot", False)


def test_labels_are_learned_from_the_regularity_of_all_events(tables, spark, monkeypatch):
    """cls20: the table that is trained on and predicted, with the boosting of a run."""
    seen = []

    def fitted(locations, *, params=learned.BoostingParams(), **_):
        seen.append(locations)
        assert params == learned.BoostingParams() and (params.rounds, params.depth, params.folds) == (200, 5, 5)
        names = [*LABEL_COLUMNS, "needs_review", "is_protected_hub"]
        return locations.withColumns({c: F.lit(None).cast("string") for c in names}), None
    monkeypatch.setattr(learned, "classify_learned", fitted)
    assert len(by_location(tables, spark, "cls20_learned_labels")) == 2
    scores = {r["geo_location"]: r["regularity_score"] for r in seen[0].collect()}
    assert scores[DAILY] == pytest.approx(daily_score(), rel=1e-9) and scores[BURSTS] < 0.5


def test_fits_side_by_side_equal_those_in_turn(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f"l{i}", ("bot", "hub", "organic")[i % 3], 1.0 + i % 2, rng.gauss(i % 3, 1), rng.random())
            for i in range(60)]
    table = spark.createDataFrame(rows, "geo_location string, label string, weight double, unique_users double, "
                                        "hourly_entropy double")
    params = learned.BoostingParams(rounds=3, depth=2, min_leaf=2, folds=2)
    found = []
    for fits in (1, 4):
        monkeypatch.setattr(learned, "FITS", fits)
        model = learned.train_calibrated(table, params)
        assert [sorted(m) for _, m, _ in model.folds] == [["bot", "hub", "organic"]] * 2
        found.append([s for _, _, s in model.folds] + [tuple(r) for r in learned.predict(model, table)
                                                       .orderBy("geo_location").collect()])
    assert spark.sparkContext.getCheckpointDir() and found[0] == found[1]
