"""Features of the daily, weekly and monthly series of a location.

A series has one row per active day, week or month, so its length is bounded by the calendar and
not by the number of downloads; windows over it stay small for any location.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from logtide.functions.columns import EPS, LOC, clip, d, ratio
from logtide.operators.rollups import LogViews


def by_loc() -> WindowSpec:
    return Window.partitionBy(LOC)


OUTBURST_DEFAULTS = {"outburst_count": 0, "outburst_intensity": 0.0, "max_outburst_zscore": 0.0,
                     "outburst_ratio": 0.0, "time_since_last_outburst": 1.0}


def _day_scores(views: LogViews) -> DataFrame:
    mean, sd = F.avg("n").over(by_loc()), F.stddev_samp("n").over(by_loc())
    return (views.day.withColumn("mean", mean).withColumn("sd", sd)
            .filter("sd > 0").withColumn("z", (F.col("n") - F.col("mean")) / F.col("sd")))


def outbursts(views: LogViews, threshold: float = 2.0) -> DataFrame:
    ranked = _day_scores(views).withColumn(
        "back", F.row_number().over(by_loc().orderBy(F.desc("day"))))
    z, n, high = F.col("z"), F.col("n"), F.col("z") > threshold
    return ranked.groupBy(LOC).agg(
        F.count_if(F.abs(z) > threshold).alias("outburst_count"),
        F.coalesce(F.avg(F.when(high, z)), F.lit(0.0)).alias("outburst_intensity"),
        F.max(z).alias("max_outburst_zscore"),
        ratio(F.sum(F.when(high, n).otherwise(0)), F.sum(n), 0).alias("outburst_ratio"),
        ratio(F.min(F.when(high, F.col("back"))), F.max("back"), 1)
        .alias("time_since_last_outburst"))


def outburst_streak(views: LogViews, threshold: float = 2.0) -> DataFrame:
    """Longest run of consecutive active days above the threshold."""
    calm = F.sum(F.when(F.col("z") > threshold, 0).otherwise(1)).over(by_loc().orderBy("day"))
    runs = (_day_scores(views).withColumn("island", calm)
            .filter(F.col("z") > threshold).groupBy(LOC, "island")
            .agg(F.count(F.lit(1)).alias("length")))
    return runs.groupBy(LOC).agg(F.max("length").alias("longest_outburst_streak"))


def weekly_autocorrelation(views: LogViews, least_days: int = 14) -> DataFrame:
    """Lag-7 autocorrelation of the standardised active-day series."""
    rows = (views.day
            .withColumn("mean", F.avg("n").over(by_loc()))
            .withColumn("sd", F.stddev_pop("n").over(by_loc()))
            .withColumn("len", F.count(F.lit(1)).over(by_loc())))
    z = F.when(F.col("sd") > 0, (F.col("n") - F.col("mean")) / F.col("sd"))
    rows = rows.withColumn("z", z).withColumn(
        "z7", F.lead("z", 7).over(by_loc().orderBy("day")))
    return rows.groupBy(LOC).agg(
        F.when((F.first("len") >= least_days) & (F.first("sd") > 0),
               F.sum(F.col("z") * F.col("z7")) / (F.first("len") - 7))
        .otherwise(0.0).alias("weekly_autocorr"))


_SPECTRUM = ("geo_location string, dominant_period_days double, "
             "periodicity_strength double, period_regularity double")


def _spectrum(pdf: pd.DataFrame) -> pd.DataFrame:
    """Strongest period of one location's day series."""
    y = pdf.sort_values("day")["n"].to_numpy(dtype=float)
    n, out = len(y), (0.0, 0.0, 0.0)
    sd = y.std()
    if n >= 14 and sd > 0:
        power = np.abs(np.fft.rfft((y - y.mean()) / sd)) ** 2
        power = power[2:]                       # neither the mean nor the fundamental
        best = int(np.argmax(power))
        strength = power[best] / (power.sum() + EPS)
        regular = 1.0
        if len(power) > 3:
            ordered = np.sort(power)[::-1]
            regular = ordered[0] / (ordered[1:4].mean() + EPS)
        out = (n / (best + 2.0), min(strength, 1.0), min(regular, 10.0))
    return pd.DataFrame([(pdf[LOC].iloc[0], *out)],
                        columns=[LOC, "dominant_period_days", "periodicity_strength",
                                 "period_regularity"])


PERIODICITY_DEFAULTS = {"weekly_autocorr": 0.0, "dominant_period_days": 0.0,
                        "periodicity_strength": 0.0, "period_regularity": 0.0}


def dominant_period(views: LogViews) -> DataFrame:
    """Fourier spectrum per location. A group is one day series, bounded by the calendar."""
    return views.day.select(LOC, "day", "n").groupBy(LOC).applyInPandas(_spectrum, _SPECTRUM)


def periodicity(views: LogViews) -> DataFrame:
    return weekly_autocorrelation(views).join(dominant_period(views), LOC)


TREND_DEFAULTS = {"trend_slope": 0.0, "trend_strength": 0.0, "trend_acceleration": 0.0,
                  "detrended_volatility": 0.0, "trend_direction": 0}


def trend(views: LogViews) -> DataFrame:
    """Linear and quadratic fit to the weekly counts, from moments of the series."""
    rows = views.week.withColumn(
        "x", (F.row_number().over(by_loc().orderBy("week")) - 1).cast("double"))
    x, y = F.col("x"), d("n")
    s = rows.groupBy(LOC).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(y).alias("mean"),
        F.var_pop(y).alias("var"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"),
        F.sum(x * x * y).alias("sxxy"))
    n, mean, var = F.col("n"), F.col("mean"), F.col("var")
    xbar, xvar = (n - 1) / 2, (n * n - 1) / 12
    cov = F.col("sxy") / n - xbar * mean
    slope = F.try_divide(cov, xvar)
    r2 = F.least(F.coalesce(F.try_divide(cov * cov, xvar * var), F.lit(0.0)), F.lit(1.0))
    # Second orthogonal polynomial on 0..n-1 gives the quadratic coefficient directly.
    centred = F.col("sxxy") - 2 * xbar * F.col("sxy") + xbar * xbar * F.col("sy")
    quad = F.try_divide(centred - xvar * F.col("sy"), n * (n * n - 1) * (n * n - 4) / 180)
    out = s.select(
        LOC, n, (slope / (mean + EPS)).alias("slope"), r2.alias("r2"),
        F.when(n >= 5, 2 * quad / (mean + EPS)).otherwise(0.0).alias("acc"),
        (F.sqrt(F.greatest(var * (1 - r2), F.lit(0.0))) / (mean + EPS)).alias("vol"))

    enough = F.col("n") >= 4

    def when_enough(c: Column) -> Column:
        return F.when(enough, c).otherwise(F.lit(0).cast("double"))
    k = F.col("slope")
    return out.select(
        LOC, when_enough(clip(k, -10, 10)).alias("trend_slope"),
        when_enough(F.col("r2")).alias("trend_strength"),
        when_enough(clip(F.col("acc"), -10, 10)).alias("trend_acceleration"),
        when_enough(F.least("vol", F.lit(10.0))).alias("detrended_volatility"),
        F.when(~enough | (F.abs(k) < 0.01), 0).when(k > 0, 1).otherwise(-1)
        .cast("bigint").alias("trend_direction"))


RECENCY_DEFAULTS = {"recent_activity_ratio": 1.0, "recent_volatility_ratio": 1.0,
                    "recency_concentration": 0.0}


def recency(views: LogViews, days: int = 30) -> DataFrame:
    rows = views.day.withColumn("last", F.max("day").over(by_loc()))
    recent = F.col("day") >= F.col("last") - F.expr(f"INTERVAL {int(days)} DAYS")
    rn = F.when(recent, F.col("n"))
    s = rows.groupBy(LOC).agg(
        F.avg("n").alias("hm"), F.stddev_samp("n").alias("hs"), F.sum("n").alias("t"),
        F.avg(rn).alias("rm"), F.stddev_samp(rn).alias("rs"), F.sum(rn).alias("rt"))
    hm, hs, rm, rs = (F.col(c) for c in ("hm", "hs", "rm", "rs"))
    volatility = F.when((hs > 0) & (hm > 0) & (rm > 0), (rs / rm) / (hs / hm)).otherwise(1.0)
    return s.select(
        LOC, F.when(hm > 0, rm / hm).otherwise(1.0).alias("recent_activity_ratio"),
        F.coalesce(volatility, F.lit(1.0)).alias("recent_volatility_ratio"),
        ratio(F.col("rt"), F.col("t"), 0).alias("recency_concentration"))


MOMENTUM_DEFAULTS = {"momentum_score": 0.0}


def momentum(views: LogViews, alpha: float = 0.3) -> DataFrame:
    """Last three weeks against the earlier ones (or, at three weeks, a weighted mean)."""
    rows = views.week.withColumn(
        "back", F.row_number().over(by_loc().orderBy(F.desc("week"))) - 1)
    n, back = d("n"), F.col("back")
    weight = F.pow(F.lit(1 - alpha), back.cast("double"))
    s = rows.groupBy(LOC).agg(
        F.count(F.lit(1)).alias("k"), F.avg(F.when(back < 3, n)).alias("recent"),
        F.avg(F.when(back >= 3, n)).alias("earlier"),
        (F.sum(weight * n) / F.sum(weight)).alias("weighted"))
    hist = F.coalesce("earlier", "weighted")
    return s.select(LOC, F.when(
        F.col("k") >= 3, clip((F.col("recent") - hist) / (hist + EPS), -5, 5))
        .otherwise(0.0).alias("momentum_score"))


SHAPE_DEFAULTS = {"download_skewness": 0.0, "download_kurtosis": 0.0,
                  "tail_heaviness_ratio": 1.0, "zero_day_ratio": 0.0}


def _calendar(day: DataFrame) -> DataFrame:
    """Fill the days without downloads between the first and last active day with 0."""
    span = day.groupBy(LOC).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = span.select(LOC, F.explode(F.expr("sequence(a, b, INTERVAL 1 DAY)")).alias("day"))
    return days.join(day, [LOC, "day"], "left").fillna(0, ["n"])


def distribution_shape(views: LogViews, calendarize: bool = False,
                       least_days: int = 5) -> DataFrame:
    """Skewness, kurtosis and tail of the daily counts.

    By default only active days count, so the share of zero days is 0; ``calendarize`` adds the
    days without downloads.
    """
    day = _calendar(views.day) if calendarize else views.day
    n = d("n")
    s = day.groupBy(LOC).agg(
        F.count(F.lit(1)).alias("k"), F.var_pop(n).alias("var"),
        F.skewness(n).alias("skew"), F.kurtosis(n).alias("kurt"),
        F.percentile(n, F.lit(0.5)).alias("median"), F.percentile(n, F.lit(0.99)).alias("p99"),
        (F.count_if(F.col("n") == 0) / F.count(F.lit(1))).alias("zero"))
    enough, spread = F.col("k") >= least_days, (F.col("k") >= least_days) & (F.col("var") > 0)
    return s.select(
        LOC,
        F.when(spread, clip(F.col("skew"), -10, 10)).otherwise(0.0).alias("download_skewness"),
        F.when(spread, clip(F.col("kurt"), -10, 50)).otherwise(0.0).alias("download_kurtosis"),
        F.when(enough, F.least(F.col("p99") / (F.col("median") + EPS), F.lit(100.0)))
        .otherwise(1.0).alias("tail_heaviness_ratio"),
        F.when(enough, F.col("zero")).otherwise(0.0).alias("zero_day_ratio"))


WINDOW_FEATURES = [
    "downloads", "users", "downloads_per_user", "downloads_change", "users_change",
    "downloads_per_user_change", "rolling_min", "rolling_max", "rolling_std", "rolling_median",
    "slope", "volatility",
]


def window_series(views: LogViews, period: str = "month", length: int = 12) -> DataFrame:
    """The last ``length`` month (or week) windows of each location with twelve features each."""
    if period not in ("week", "month"):
        raise ValueError("period must be 'week' or 'month'")
    counts = (views.valid_year.groupBy(LOC, F.date_trunc(period, "ts").alias("window_start"))
              .agg(F.count(F.lit(1)).alias("downloads"), F.countDistinct("usr").alias("users")))
    # The tail is taken first: changes and rolling statistics see only the kept windows.
    kept = (counts.withColumn("back", F.row_number().over(
        by_loc().orderBy(F.desc("window_start")))).filter(F.col("back") <= length)
        .withColumn("kept", F.count(F.lit(1)).over(by_loc()))
        .withColumn("downloads_per_user", ratio(F.col("downloads"), F.col("users"), 0)))
    w = by_loc().orderBy("window_start")
    three = w.rowsBetween(-2, 0)
    y = F.col("downloads")

    def change(name: str) -> Column:
        return F.coalesce(ratio(F.col(name), F.lag(name).over(w)) - 1, F.lit(0.0))
    pos = F.row_number().over(w)
    span = F.least(F.col("kept"), F.lit(3))
    full = pos >= span
    first, last = F.lag(y, 2).over(w), y
    slope = F.when(F.col("kept") >= 3, (last - first) / 2) \
        .when(F.col("kept") == 2, (last - F.lag(y, 1).over(w)).cast("double"))
    mean3 = F.avg(y).over(three)
    sd3 = F.stddev_pop(y).over(three)
    return kept.select(
        LOC, "window_start", "kept", pos.alias("pos"),
        d("downloads").alias("downloads"), d("users").alias("users"), "downloads_per_user",
        change("downloads").alias("downloads_change"), change("users").alias("users_change"),
        change("downloads_per_user").alias("downloads_per_user_change"),
        F.min(y).over(three).cast("double").alias("rolling_min"),
        F.max(y).over(three).cast("double").alias("rolling_max"),
        F.coalesce(F.stddev_samp(y).over(three), F.lit(0.0)).alias("rolling_std"),
        F.percentile(y, F.lit(0.5)).over(three).alias("rolling_median"),
        F.when(full, F.coalesce(slope, F.lit(0.0))).otherwise(0.0).alias("slope"),
        F.when(full & (mean3 > 0), sd3 / mean3).otherwise(0.0).alias("volatility"))


def sequence_features(views: LogViews, period: str = "month", length: int = 12) -> DataFrame:
    """``length`` x 12 nested array per location, padded with zero rows in front."""
    rows = window_series(views, period, length).groupBy(LOC).agg(
        F.array_sort(F.collect_list(F.struct("pos", *WINDOW_FEATURES))).alias("w"))
    zero = F.array(*[F.lit(0.0)] * 12)
    data = F.transform("w", lambda s: F.array(*[s[c] for c in WINDOW_FEATURES]))
    pad = F.array_repeat(zero, F.lit(length) - F.size("w"))
    return rows.select(LOC, F.concat(pad, data).alias("time_series_features"))
