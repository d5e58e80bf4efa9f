"""Features of when downloads happen: years, hours of the day, bursts, persistence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.functions.columns import EPS, LOC, clip, d, positive, ratio, weekday
from logtide.operators.rollups import LogViews

YEARLY_DEFAULTS = {c: 0 for c in (
    "yearly_entropy", "peak_year_concentration", "years_span", "downloads_per_year",
    "year_over_year_cv", "fraction_latest_year", "is_new_location", "spike_ratio",
    "years_before_latest", "latest_year_downloads")}


def _smoothed_entropy(share: Column, observed: Column, bins: Column) -> Column:
    """Natural-log entropy of ``share`` over ``bins`` cells when only non-empty cells are rows.

    1e-10 is added to every cell and the shares renormalised; the empty cells are added in
    closed form, so no zero-filled grid is built.
    """
    norm = 1 + bins * F.lit(EPS)
    q, q0 = (share + F.lit(EPS)) / norm, F.lit(EPS) / norm
    return -(F.sum(q * F.log(q)) + (F.first(bins) - observed) * F.first(q0 * F.log(q0)))


def yearly_pattern(views: LogViews) -> DataFrame:
    """Yearly features; the latest year and the number of years are those of the whole log."""
    bounds = views.year.agg(F.struct(
        F.max("year").alias("latest"), F.countDistinct("year").alias("k"))).scalar()
    rows = views.year.withColumn("b", bounds).select(
        LOC, "year", "n", F.col("b.latest").alias("latest"), F.col("b.k").cast("double").alias("k"),
        F.sum("n").over(Window.partitionBy(LOC)).alias("total"))
    share, k = d("n") / F.col("total"), F.col("k")
    before = F.col("year") < F.col("latest")
    agg = rows.groupBy(LOC).agg(
        F.count(F.lit(1)).alias("m"), F.min("year").alias("first_year"),
        F.first("latest").alias("latest"), F.first("k").alias("k"),
        F.first("total").alias("total"),
        F.sum(F.when(~before, F.col("n")).otherwise(0)).alias("latest_year_downloads"),
        F.sum(F.when(before, F.col("n")).otherwise(0)).alias("prev_dl"),
        F.count_if(before).alias("years_before_latest"),
        F.max(share).alias("peak_year_concentration"),
        F.sum(share * share).alias("sq"),
        _smoothed_entropy(share, F.count(F.lit(1)), k).alias("yearly_entropy"),
    )
    m, latest_dl = F.col("m"), F.col("latest_year_downloads")
    avg_prev = F.col("prev_dl") / F.greatest("years_before_latest", F.lit(1))
    mean = 1 / F.col("k")
    var = F.greatest(F.col("sq") - F.col("k") * mean * mean, F.lit(0.0)) \
        / F.greatest(F.col("k") - 1, F.lit(1.0))
    return agg.select(
        LOC, "yearly_entropy", "peak_year_concentration",
        m.alias("years_span"),
        (F.col("total") / m).alias("downloads_per_year"),
        F.when(m > 1, F.sqrt(var) / (mean + EPS)).otherwise(0.0).alias("year_over_year_cv"),
        (latest_dl / F.col("total")).alias("fraction_latest_year"),
        F.when((F.col("first_year") == F.col("latest")) & (m == 1), 1).otherwise(0)
        .cast("bigint").alias("is_new_location"),
        F.when(avg_prev > 0, latest_dl / (avg_prev + EPS)).otherwise(latest_dl / 1000.0)
        .alias("spike_ratio"),
        "years_before_latest", "latest_year_downloads",
    )


TIME_OF_DAY_DEFAULTS = {c: 0.0 for c in (
    "hourly_download_std", "peak_hour_concentration", "working_hours_ratio", "hourly_entropy",
    "night_activity_ratio")}


def time_of_day(views: LogViews) -> DataFrame:
    """Shape of the 24-bin histogram; empty hours count through closed forms."""
    hod, n = F.col("hod"), F.col("n")
    rows = views.clock_year.withColumn("total", F.sum("n").over(Window.partitionBy(LOC)))
    agg = rows.groupBy(LOC).agg(
        F.sum("n").alias("s"), F.sum(n * n).alias("s2"), F.max("n").alias("top"),
        F.sum(F.when(views.schema.is_working_hour(hod), n).otherwise(0)).alias("work"),
        F.sum(F.when(views.schema.is_night_hour(hod), n).otherwise(0)).alias("night"),
        _smoothed_entropy(d("n") / F.col("total"), F.count(F.lit(1)), F.lit(24.0))
        .alias("hourly_entropy"))
    s = F.col("s")
    var = F.col("s2") / 24.0 - F.pow(s / 24.0, F.lit(2.0))
    return agg.select(
        LOC, F.sqrt(F.greatest(var, F.lit(0.0))).alias("hourly_download_std"),
        (F.col("top") / s).alias("peak_hour_concentration"),
        (F.col("work") / s).alias("working_hours_ratio"),
        "hourly_entropy",
        (F.col("night") / s).alias("night_activity_ratio"))


BURST_DEFAULTS = {"burst_pattern_score": 0.0, "hourly_cv_burst": 1.0, "spike_intensity": 1.0}


def burst_pattern(views: LogViews) -> DataFrame:
    stats = views.hour.groupBy(LOC).agg(
        F.avg("n").alias("mean"), F.stddev_samp("n").alias("sd"), F.max("n").alias("top"),
        F.count(F.lit(1)).alias("hours")).filter("hours > 1")
    mean, sd, top = F.col("mean"), F.col("sd"), F.col("top")
    return stats.select(
        LOC, positive(sd, (top - mean) / sd, 0).alias("burst_pattern_score"),
        positive(mean, sd / mean, 0).alias("hourly_cv_burst"),
        positive(mean, top / mean, 1).alias("spike_intensity"))


CIRCADIAN_DEFAULTS = {"circadian_rhythm_deviation": 0.5, "night_ratio_advanced": 0.1,
                      "work_ratio_advanced": 0.5, "evening_ratio": 0.25, "morning_ratio": 0.15}

# Fixed bands (first hour, last hour, expected share of human traffic).
CIRCADIAN_BANDS = {
    "night_ratio_advanced": (0, 5, 0.10),
    "work_ratio_advanced": (9, 17, 0.50),
    "evening_ratio": (18, 23, 0.25),
    "morning_ratio": (6, 8, 0.15),
}


def circadian(views: LogViews) -> DataFrame:
    hod, n = F.col("hod"), F.col("n")
    shares = views.clock.groupBy(LOC).agg(*[
        (F.sum(F.when(hod.between(a, b), n).otherwise(0)) / F.sum(n)).alias(name)
        for name, (a, b, _) in CIRCADIAN_BANDS.items()])
    deviation = sum((F.abs(F.col(name) - share) for name, (_, _, share)
                     in CIRCADIAN_BANDS.items()), F.lit(0.0))
    return shares.withColumn("circadian_rhythm_deviation", deviation)


COORDINATION_DEFAULTS = {"user_coordination_std": 0.0, "avg_concurrent_users": 0.0,
                         "max_concurrent_users": 0, "user_coordination_score": 0.0,
                         "user_peak_ratio": 1.0}


def user_coordination(views: LogViews) -> DataFrame:
    """Distinct users per hour: many users with little spread look coordinated."""
    stats = views.hour_users.filter("users > 0").groupBy(LOC).agg(
        F.stddev_samp("users").alias("sd"), F.avg("users").alias("mean"),
        F.max("users").alias("top"), F.count(F.lit(1)).alias("hours")).filter("hours > 1")
    mean, sd, top = F.col("mean"), F.col("sd"), F.col("top")
    return stats.select(
        LOC, sd.alias("user_coordination_std"), mean.alias("avg_concurrent_users"),
        top.alias("max_concurrent_users"),
        positive(sd, mean / sd, 0).alias("user_coordination_score"),
        positive(mean, top / mean, 1).alias("user_peak_ratio"))


SIGNATURE_DEFAULTS = {"autocorrelation_lag1": 0.0, "circadian_deviation": 0.5,
                      "request_timing_entropy": 0.5}

# Fixed human activity profile, hour 0 to hour 23 (normalised before use).
HUMAN_PROFILE = [
    0.01, 0.005, 0.003, 0.002, 0.005, 0.01,
    0.02, 0.04, 0.06, 0.07, 0.08, 0.08,
    0.07, 0.07, 0.08, 0.07, 0.06, 0.05,
    0.04, 0.04, 0.04, 0.03, 0.02, 0.015,
]


def _array_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def hour_profile(views: LogViews) -> DataFrame:
    """Distance of the 24-hour profile to a human one, its entropy and lag-1 correlation."""
    n = F.col("n")
    counts = views.clock.groupBy(LOC).agg(
        F.sum("n").alias("total"),
        F.array(*[F.sum(F.when(F.col("hod") == h, n).otherwise(0)) for h in range(24)])
        .alias("bins"))
    human_total = sum(HUMAN_PROFILE)
    smooth_total = 1 + 24 * EPS
    human = F.array(*[F.lit((h / human_total + EPS) / smooth_total) for h in HUMAN_PROFILE])
    prof = counts.select(
        LOC, F.transform("bins", lambda b: b / F.col("total")).alias("p")).select(
        LOC, "p", F.transform("p", lambda x: (x + EPS) / smooth_total).alias("ps"))

    def divergence(a: Column, b: Column) -> Column:
        return _array_sum(F.zip_with(a, b, lambda x, y: x * F.log(2 * x / (x + y))))
    js = (divergence(F.col("ps"), human) + divergence(human, F.col("ps"))) / 2
    entropy = -_array_sum(F.transform("p", lambda x: x * F.log(x + EPS))) / F.log(F.lit(24.0))
    head, tail = F.slice("p", 1, 23), F.slice("p", 2, 23)
    mh, mt = _array_sum(head) / 23, _array_sum(tail) / 23
    cov = _array_sum(F.zip_with(head, tail, lambda x, y: (x - mh) * (y - mt)))
    vh = _array_sum(F.transform(head, lambda x: (x - mh) * (x - mh)))
    vt = _array_sum(F.transform(tail, lambda x: (x - mt) * (x - mt)))
    return prof.select(
        # A flat profile has only rounding noise left as variance.
        LOC, F.when((vh > 1e-20) & (vt > 1e-20), cov / F.sqrt(vh * vt)).otherwise(0.0)
        .alias("autocorrelation_lag1"),
        F.sqrt(F.greatest(js, F.lit(0.0))).alias("circadian_deviation"),
        entropy.alias("request_timing_entropy"))


PERSISTENCE_DEFAULTS = {"lifespan_days": 1.0, "activity_density": 0.5, "persistence_score": 0}


def persistence(views: LogViews) -> DataFrame:
    """Lifespan and how densely it is filled. Days and weeks are counted on the day series."""
    span = views.half_hour.groupBy(LOC).agg(
        F.min("first_us").alias("a"), F.max("last_us").alias("b"))
    active = views.day.groupBy(LOC).agg(
        F.count(F.lit(1)).alias("active_days"),
        F.countDistinct(F.date_trunc("week", "day")).alias("active_weeks"))
    life = (F.col("b") - F.col("a")) / F.lit(86400.0 * 1e6)
    days, weeks = F.col("active_days"), F.col("active_weeks")
    return span.join(active, LOC).select(
        LOC, life.alias("lifespan_days"), days, weeks,
        positive(life, days / life, 1).alias("activity_density"),
        (weeks * days).alias("persistence_score"))


BENFORD_DEFAULTS = {"benford_deviation": 0.0}

# Fixed expected share of leading digits 1 to 9.
BENFORD = [0.301, 0.176, 0.125, 0.097, 0.079, 0.067, 0.058, 0.051, 0.046]


def benford(views: LogViews, least_days: int = 10) -> DataFrame:
    """Distance of the leading digits of the daily counts from Benford's shares."""
    digit = F.substring(F.col("n").cast("string"), 1, 1)
    rows = views.day.groupBy(LOC).agg(
        F.count(F.lit(1)).alias("days"),
        *[F.avg(F.when(digit == str(k), 1.0).otherwise(0.0)).alias(f"p{k}")
          for k in range(1, 10)])
    dev = sum((F.pow(F.col(f"p{k}") - e, F.lit(2.0)) / (e + 0.01)
               for k, e in enumerate(BENFORD, 1)), F.lit(0.0))
    return rows.select(LOC, F.when(F.col("days") < least_days, 0.0).otherwise(dev)
                       .alias("benford_deviation"))


UNIFORMITY_DEFAULTS = {"hourly_uniformity_score": 0.5}


def hourly_uniformity(views: LogViews) -> DataFrame:
    """1 - variance / mean^2 over the observed hours of the day; one hour only gives 0."""
    mean = F.avg("n")
    raw = 1.0 - F.var_samp("n") / (mean * mean + 0.01)
    return views.clock.groupBy(LOC).agg(
        clip(F.coalesce(raw, F.lit(0.0)), 0, 1).alias("hourly_uniformity_score"))


WEEKDAY_DEFAULTS = {"weekday_pattern_score": 0.0}


def weekday_pattern(views: LogViews) -> DataFrame:
    """Deviation of the Monday-to-Friday share from 0.714."""
    n = F.col("n")
    workday = F.sum(F.when(~weekday(F.col("day")).isin(0, 6), n).otherwise(0))
    share = ratio(workday, F.sum(n))
    return views.day.groupBy(LOC).agg(
        (F.abs(share - 0.714) / 0.714).alias("weekday_pattern_score"))
