"""Sliced ranks, quantiles and samples against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from logtide.functions.ranks import quantiles, sliced_row_number, value_ranks
from logtide.sources.sampling import exact_sample, oversampled_limit


def test_sliced_row_number_matches_plain_sort(spark):
    rng = np.random.default_rng(1)
    # One key holds most rows.
    rows = [("hot" if rng.random() < 0.7 else f"k{i % 9}", f"n{i:05d}") for i in range(4000)]
    rows += [(None, f"x{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "k string, v string")
    got = sliced_row_number(df, ["k"], F.col("v"), "r", slices=16).toPandas()
    want = pd.DataFrame(rows, columns=["k", "v"]).sort_values("v")
    want["r"] = want.groupby("k", dropna=False).cumcount() + 1
    both = got.merge(want, on=["k", "v"], suffixes=("", "_want"))
    assert len(both) == len(rows)
    assert (both["r"] == both["r_want"]).all()


def test_sliced_row_number_without_keys_and_struct_order(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("g"))
    got = sliced_row_number(df, [], F.struct((-F.col("g")).alias("g"), "id"), "r", slices=8)
    rows = [(r.g, r.id) for r in got.orderBy("r").collect()]
    assert rows == sorted(rows, key=lambda t: (-t[0], t[1]))
    assert got.agg(F.max("r"), F.countDistinct("r")).first() == (1000, 1000)


@pytest.mark.parametrize("n", [1, 2, 7, 500, 60000])
def test_quantiles_match_numpy(spark, n):
    rng = np.random.default_rng(n)
    x = np.where(rng.random(n) < 0.35, 5.0, rng.gamma(2.0, 10.0, n))   # a third are equal
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    probs = {"a": 0.0, "b": 0.01, "c": 0.25, "d": 0.5, "e": 0.95, "f": 0.99, "g": 1.0}
    got = quantiles(df, "x", probs).first().asDict()
    want = dict(zip(probs, np.quantile(x, list(probs.values()))))
    assert got == pytest.approx(want)


def test_quantiles_per_key_ignore_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", 5.0), (None, 2.0)],
                               "k string, v double")
    got = {r.k: r.m for r in quantiles(df, "v", {"m": 0.5}, ["k"]).collect()}
    assert got == {"a": 2.0, "b": 5.0, None: 2.0}


def test_value_ranks_count_ties(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (5,), (5,), (5,)], "v int")
    got = {r.v: (r.cnt, r.below, r.total) for r in value_ranks(df, "v").collect()}
    assert got == {1: (2, 0, 6), 2: (1, 2, 6), 5: (3, 3, 6)}


def test_exact_sample_is_the_hash_prefix(make_log):
    from logtide.operators.timing import row_key
    from datetime import datetime, timedelta
    t0 = datetime(2024, 1, 1)
    rows = [{"ts": t0 + timedelta(seconds=i), "usr": f"u{i % 5}"} for i in range(300)]
    rows += [{"ts": t0, "usr": "same"}] * 200                      # copies of one event
    log = make_log(rows).log
    keys = sorted(r.k for r in log.select(row_key().alias("k")).collect())
    for n in (1, 137, 250, 420, 500, 900):
        got = exact_sample(log, n)
        assert got.columns == log.columns
        assert sorted(r.k for r in got.select(row_key().alias("k")).collect()) == keys[:n]


def test_oversampled_limit(make_log):
    from datetime import datetime
    log = make_log([{"ts": datetime(2024, 1, 1), "usr": f"u{i}"} for i in range(100)]).log
    assert oversampled_limit(log, 500).count() == 100
    assert oversampled_limit(log, 20).count() == 20
