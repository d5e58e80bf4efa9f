"""Hand-computed feature cases."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest

from logtide.operators import access, series, temporal, timing, users, volume
from logtide.operators.locations import FeatureGroup, location_features

T0 = datetime(2024, 1, 1, 10, 0, 0)          # a Monday


def at(*seconds, **fields):
    return [{"ts": T0 + timedelta(seconds=s), **fields} for s in seconds]


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_single_event(make_log):
    v = make_log(at(0))
    base = one(volume.base_stats(v))
    assert (base["unique_users"], base["total_downloads"], base["downloads_per_user"]) == (1, 1, 1)
    assert timing.interval_regularity(v).count() == 0
    assert temporal.burst_pattern(v).count() == 0
    assert one(timing.session_counts(v))["num_sessions"] == 1
    assert timing.session_behaviour(v).count() == 0
    assert one(series.trend(v))["trend_slope"] == 0


def test_constant_gaps(make_log):
    v = make_log(at(*range(0, 600, 60)))
    r = one(timing.interval_regularity(v))
    assert (r["interval_cv"], r["regularity_score"]) == (0, 0)
    p = one(timing.timing_precision(v))
    assert (p["interval_entropy"], p["request_interval_mode"], p["round_second_ratio"]) == (0, 60, 1)


@pytest.mark.parametrize("gap, sessions", [(1800, 1), (1801, 2)])
def test_session_gap(make_log, gap, sessions):
    v = make_log(at(0, 5, 5 + gap))
    r = one(timing.session_counts(v))
    assert r["num_sessions"] == sessions
    assert r["downloads_per_session"] == 3 / sessions
    assert timing.sessions(v).count() == sessions


def test_sessions_equal_row_level_sessions(make_log):
    rng = np.random.default_rng(3)
    secs = np.cumsum(rng.exponential(900, 400)).astype(int)
    got = sorted((r.start_us, r.duration, r.downloads)
                 for r in timing.sessions(make_log(at(*secs.tolist()))).collect())
    want, start = [], 0
    for i in range(1, len(secs) + 1):
        if i == len(secs) or secs[i] - secs[i - 1] > 1800:
            want.append((float(secs[i - 1] - secs[start]), i - start))
            start = i
    assert [(d, n) for _, d, n in got] == want


def test_night_wraps_midnight(make_log):
    v = make_log([{"ts": datetime(2024, 1, 1, 23, 59)}, {"ts": datetime(2024, 1, 2, 0, 0)},
                  {"ts": datetime(2024, 1, 2, 6, 0)}, {"ts": datetime(2024, 1, 2, 12, 0)}])
    r = one(temporal.time_of_day(v))
    assert (r["night_activity_ratio"], r["working_hours_ratio"]) == (0.5, 0.25)


def test_week_boundary(make_log):
    v = make_log([{"ts": datetime(2024, 1, 7, 12)}, {"ts": datetime(2024, 1, 8, 12)}])
    assert v.week.count() == 2
    assert one(volume.day_of_week(v)) == {
        "geo_location": "1.0,2.0", "weekend_ratio": 0.5, "unique_days_of_week": 2}


def test_equal_projects(make_log):
    rows = [r for p in ("A", "B", "C", "D", "E", "F") for r in at(1, accession=p)]
    r = one(volume.project_concentration(make_log(rows)))
    assert r["top_project_concentration"] == pytest.approx(1 / 6)
    assert r["top3_project_concentration"] == pytest.approx(0.5)
    assert r["project_hhi"] == pytest.approx(1 / 6)


def test_no_users(make_log):
    v = make_log(at(0, 1, 2, usr=None))
    assert one(volume.base_stats(v))["downloads_per_user"] is None
    assert users.user_distribution(v).count() == 0


def test_location_in_two_countries(make_log):
    v = make_log(at(0, 1, country="B") + at(2, 3, country="A") + at(4, country=None))
    assert one(volume.base_stats(v))["country"] == "A"


def test_user_distribution(make_log):
    rows = at(0, usr="a") + at(0, usr="b") + at(*range(8), usr="c")
    r = one(users.user_distribution(make_log(rows)))
    assert r["single_download_user_ratio"] == pytest.approx(2 / 3)
    assert r["power_user_ratio"] == pytest.approx(0.8)
    assert r["user_gini_coefficient"] == pytest.approx(2 * (1 + 2 + 24) / 30 - 4 / 3)


def weekly(counts):
    return [r for w, n in enumerate(counts) for r in at(*[w * 604800 + i for i in range(n)])]


def test_trend(make_log):
    r = one(series.trend(make_log(weekly([1, 2, 3, 4]))))
    assert r["trend_slope"] == pytest.approx(0.4)
    assert r["trend_strength"] == pytest.approx(1)
    assert (r["trend_acceleration"], r["trend_direction"]) == (0, 1)
    r = one(series.trend(make_log(weekly([1, 2, 3, 4, 5]))))
    assert r["trend_acceleration"] == pytest.approx(0, abs=1e-12)
    counts = [1, 2, 5, 10, 17]
    r = one(series.trend(make_log(weekly(counts))))
    assert r["trend_acceleration"] == pytest.approx(2 / np.mean(counts))
    r = one(series.trend(make_log(weekly([3, 3, 3, 3]))))
    assert (r["trend_slope"], r["trend_strength"]) == (0, 0)


def test_momentum(make_log):
    r = one(series.momentum(make_log(weekly([2, 4, 4, 4]))))
    assert r["momentum_score"] == pytest.approx(1)
    w = np.array([0.49, 0.7, 1.0])
    hist = (w * [1, 2, 3]).sum() / w.sum()
    assert one(series.momentum(make_log(weekly([1, 2, 3]))))["momentum_score"] == \
        pytest.approx((2 - hist) / hist)


def test_weekly_pulse(make_log):
    counts = ([3] + [1] * 6) * 2
    rows = [r for i, n in enumerate(counts) for r in at(*[i * 86400 + k for k in range(n)])]
    v = make_log(rows)
    z = (np.array(counts) - np.mean(counts)) / np.std(counts)
    assert one(series.weekly_autocorrelation(v))["weekly_autocorr"] == \
        pytest.approx((z[:7] * z[7:]).sum() / 7)
    assert one(series.dominant_period(v))["dominant_period_days"] == pytest.approx(7)
    short = make_log(rows[:5])
    assert one(series.dominant_period(short))["dominant_period_days"] == 0


def test_calendarized_shape(make_log):
    rows = [r for i in (0, 2, 4, 6, 8) for r in at(i * 86400)]
    v = make_log(rows)
    assert one(series.distribution_shape(v))["zero_day_ratio"] == 0
    assert one(series.distribution_shape(v, calendarize=True))["zero_day_ratio"] == \
        pytest.approx(4 / 9)


def test_file_order(make_log):
    files = ["a1", "a2", "a3", "a4"]
    up = make_log([{"ts": T0 + timedelta(hours=2 * i), "filename": f} for i, f in enumerate(files)])
    down = make_log([{"ts": T0 + timedelta(hours=2 * i), "filename": f}
                     for i, f in enumerate(reversed(files))])
    assert one(access.alphabetical_access(up))["alphabetical_access_score"] == pytest.approx(0.75)
    assert one(access.alphabetical_access(down))["alphabetical_access_score"] == \
        pytest.approx(-0.75)
    # Every pair crosses an hour here.
    assert one(access.sequential_access(up))["sequential_file_ratio"] == 1
    assert one(access.sequential_access(down))["sequential_file_ratio"] == 1
    same = make_log(at(0, 1, filename="x"))
    assert one(access.sequential_access(same))["sequential_file_ratio"] == 0


def test_file_entropy_modes(make_log):
    v = make_log(at(0, 1, filename="a") + at(2, 3, filename="b"))
    assert one(access.file_access(v))["file_entropy"] == pytest.approx(1)
    compat = one(access.file_access(v, "compat"))
    assert (compat["file_entropy"], compat["file_mirroring_score"]) == (0, 10)


def test_protocols(make_log):
    rows = at(0, method="HTTP") + at(1, method=None) + at(2, method="fasp-aspera") + \
        at(3, method="gridftp-globus")
    v = make_log(rows)
    r = one(volume.protocol_mix(v))
    assert (r["http_ratio"], r["aspera_ratio"], r["globus_ratio"]) == (0.25, 0.25, 0.25)
    assert r["protocol_diversity"] == 3
    v.schema = v.schema.with_options(method_field=None)
    assert one(volume.protocol_mix(v))["protocol_legitimacy_score"] == pytest.approx(0.1)


def test_yearly_new_location(make_log):
    rows = [{"ts": datetime(2022, 5, 1)}, {"ts": datetime(2023, 5, 1)},
            {"ts": datetime(2023, 6, 1), "geo_location": "3,4"}]
    got = {r.geo_location: r for r in temporal.yearly_pattern(make_log(rows)).collect()}
    assert got["3,4"].is_new_location == 1
    assert got["3,4"].spike_ratio == pytest.approx(0.001)
    p = np.array([1e-10, 1 + 1e-10]) / (1 + 2e-10)
    assert got["3,4"].yearly_entropy == pytest.approx(-(p * np.log(p)).sum(), abs=1e-12)
    assert got["1.0,2.0"].spike_ratio == pytest.approx(1)


def test_sequence_is_padded(make_log):
    rows = [{"ts": datetime(2024, m, 1)} for m in (1, 2, 4)] + [{"ts": datetime(2024, 4, 2)}]
    seq = one(series.sequence_features(make_log(rows)))["time_series_features"]
    assert len(seq) == 12 and all(len(w) == 12 for w in seq)
    assert seq[:9] == [[0.0] * 12] * 9
    assert [w[0] for w in seq[9:]] == [1, 1, 2]
    assert seq[11][10] == pytest.approx(0.5)               # slope over three windows
    assert seq[11][11] == pytest.approx(np.std([1, 1, 2]) / np.mean([1, 1, 2]))


def test_entropy_of_hour_profile(make_log):
    rows = [{"ts": datetime(2024, 1, 1, h)} for h in range(24)]
    r = one(temporal.hour_profile(make_log(rows)))
    assert r["request_timing_entropy"] == pytest.approx(1, abs=1e-6)
    assert r["autocorrelation_lag1"] == pytest.approx(0, abs=1e-6)


def test_location_table_and_custom_group(make_log):
    rows = [r for k in range(6) for r in at(*range(k, 40 + 7 * k, 3), geo_location=f"{k},{k}",
                                            usr=f"u{k % 4}", filename=f"f{k}")]
    v = make_log(rows)
    extra = FeatureGroup("twice", from_table=lambda t: t.select(
        "geo_location", (t["total_downloads"] * 2).alias("twice")))
    names = ["time_of_day", "yearly_pattern", "country_rollup", "signature",
             "geographic_stability", "peer_similarity", "global_rank"]
    out = location_features(v, names, [extra])
    got = out.toPandas()
    assert len(got) == 6 and (got["twice"] == 2 * got["total_downloads"]).all()
    assert (got["locations_per_country"] == 6).all()
    assert got["geographic_stability"].between(0, 1).all()
    assert math.isclose(got["global_rank_percentile"].max(), 1.0)


def test_same_result_with_other_partitioning(make_log, spark):
    rows = [r for k in range(3) for r in at(*range(0, 9000, 37 + k), geo_location=f"{k},0",
                                            filename=f"f{k}")]
    v = make_log(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(tuple, timing.timing_precision(v).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
