"""Sampling per location, gaps between requests and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.functions.columns import LOC, positive, ratio
from logtide.operators.rollups import SESSION_GAP, LogViews


def row_key() -> Column:
    """Hash that orders events at random but repeatably."""
    return F.md5(F.concat_ws("|", F.unix_micros("ts").cast("string"), "accession",
                             "filename", "usr"))


def capped_sample(events: DataFrame, k: int) -> DataFrame:
    """At most ``k`` events per location.

    The rank filter is pushed below the shuffle as a group limit, so every map task sends no
    more than ``k`` events per location.
    """
    w = Window.partitionBy(LOC).orderBy("sample_key")
    return (events.withColumn("sample_key", row_key())
            .withColumn("sample_rank", F.row_number().over(w))
            .filter(F.col("sample_rank") <= k))


def _gaps(sample: DataFrame) -> DataFrame:
    """Seconds since the previous sampled event (samples are small, so one window will do)."""
    us = F.unix_micros("ts")
    before = F.lag(us).over(Window.partitionBy(LOC).orderBy("ts", "sample_key"))
    return sample.withColumn("gap", (us - before) / F.lit(1e6))


REGULARITY_DEFAULTS = {"interval_cv": 1.0, "regularity_score": 0.0}


def interval_regularity(views: LogViews, k: int | None = 50) -> DataFrame:
    """Mean and spread of the positive gaps between events, over a sample of ``k`` or all events (None)."""
    stats = _gap_moments(views) if k is None else _sampled_moments(views, k)
    mean, sd = F.col("mean_interval"), F.col("std_interval")
    return stats.select(
        LOC, mean, sd,
        F.coalesce(positive(mean, sd / mean, 1), F.lit(1.0)).alias("interval_cv"),
        positive(sd, mean / (sd + 1), 0).alias("regularity_score"))


def _sampled_moments(views: LogViews, k: int) -> DataFrame:
    gaps = _gaps(capped_sample(views.valid, k)).filter("gap > 0")
    return gaps.groupBy(LOC).agg(F.avg("gap").alias("mean_interval"),
                                 F.stddev_samp("gap").alias("std_interval"))


def _gap_moments(views: LogViews) -> DataFrame:
    """Mean and deviation of all positive gaps of a location.

    Events are ordered inside (location, half hour) only; the gap that leads to the next active bin
    comes from the first and last event of each, at most 48 rows per location and day. Counts, sums
    and squares are whole microseconds, so equal gaps deviate by exactly 0 however they are dealt out.
    """
    us, width = F.unix_micros("ts"), F.lit(SESSION_GAP * 1_000_000)
    w = Window.partitionBy(LOC, "bin").orderBy("us")
    # Squares inside a bin add up to less than its squared width, which a bigint holds.
    gap = F.col("gap")
    bins = (views.valid.select(LOC, us.alias("us"), (us - F.pmod(us, width)).alias("bin"))
            .withColumn("gap", F.col("us") - F.lag("us").over(w))
            .groupBy(LOC, "bin").agg(
                F.min("us").alias("first_us"), F.max("us").alias("last_us"),
                F.count_if(gap > 0).alias("n"), F.sum(gap * gap).alias("squares")))
    before = F.lag("last_us").over(Window.partitionBy(LOC).orderBy("bin"))
    between, wide, none = F.col("between"), "decimal(38,0)", F.lit(0)
    squared = between.cast("decimal(19,0)") * between.cast("decimal(19,0)")
    total = (bins.withColumn("between", F.col("first_us") - before).groupBy(LOC).agg(
        (F.sum("n") + F.count(between)).alias("n"),
        (F.max("last_us") - F.min("first_us")).alias("span"),
        F.sum(F.coalesce(F.col("squares"), none).cast(wide) + F.coalesce(squared, none).cast(wide)).alias("squares"))
        .filter("n > 0")
        .withColumns({"whole": F.expr("span div n"), "rest": F.expr("span % n")}))
    # With span = n * whole + rest, the squared distances from ``whole`` are an integer and those
    # from the mean are less by rest^2 / n; neither difference cancels digits.
    n, rest = F.col("n").cast("double"), F.col("rest").cast("double")
    around = F.expr("squares - CAST(whole AS DECIMAL(19,0)) * (span + rest)").cast("double")
    deviation = F.sqrt(F.try_divide(around - rest * rest / n, n - 1)) / F.lit(1e6)
    return total.select(LOC, (F.col("span") / n / F.lit(1e6)).alias("mean_interval"),
                        deviation.alias("std_interval"))


PRECISION_DEFAULTS = {"request_interval_mode": 0.0, "round_second_ratio": 0.25,
                      "millisecond_variance": 250000.0, "interval_entropy": 1.0}


def timing_precision(views: LogViews, k: int = 100, least_gaps: int = 5) -> DataFrame:
    gaps = _gaps(capped_sample(views.valid, k)).filter("gap > 0 AND gap < 86400")
    milli = F.floor(F.pmod(F.unix_micros("ts"), F.lit(60_000_000)) / 1000)
    stats = gaps.groupBy(LOC).agg(
        F.mode(F.round(F.col("gap") / 10) * 10, True).alias("request_interval_mode"),
        F.avg(F.when(F.second("ts").isin(0, 15, 30, 45), 1.0).otherwise(0.0))
        .alias("round_second_ratio"),
        F.var_samp(milli).alias("millisecond_variance"),
        F.avg("gap").alias("mean"), F.stddev_samp("gap").alias("sd"),
        F.count(F.lit(1)).alias("gaps")).filter(F.col("gaps") >= least_gaps)
    mean, sd = F.col("mean"), F.col("sd")
    return stats.select(
        LOC, "request_interval_mode", "round_second_ratio", "millisecond_variance",
        F.when((mean > 0) & sd.isNotNull(), F.log2(F.greatest(sd / mean + 1, F.lit(1.0))))
        .otherwise(1.0).alias("interval_entropy"))


def _marked_bins(views: LogViews) -> DataFrame:
    """Half-hour bins with the gap before them and a session-start mark.

    At most 48 bins per location and day, however many events they hold.
    """
    w = Window.partitionBy(LOC).orderBy("bin")
    before = F.lag("last_us").over(w)
    gap = (F.col("first_us") - before) / F.lit(1e6)
    return (views.half_hour.withColumn("gap", gap)
            .withColumn("starts", F.col("gap").isNull() | (F.col("gap") > SESSION_GAP)))


SESSION_COUNT_DEFAULTS = {"num_sessions": 1}


def session_counts(views: LogViews) -> DataFrame:
    out = _marked_bins(views).groupBy(LOC).agg(
        F.count_if("starts").alias("num_sessions"), F.sum("n").alias("t"))
    return out.select(LOC, "num_sessions",
                      ratio(F.col("t"), F.col("num_sessions")).alias("downloads_per_session"))


def sessions(views: LogViews) -> DataFrame:
    """One row per session: start, length in seconds, downloads, earliest hour of day."""
    w = Window.partitionBy(LOC).orderBy("bin")
    marked = _marked_bins(views).withColumn(
        "session_id", F.sum(F.col("starts").cast("bigint")).over(w))
    hour = F.floor(F.pmod(F.col("first_us"), F.lit(86_400_000_000)) / 3_600_000_000)
    return marked.groupBy(LOC, "session_id").agg(
        F.min("first_us").alias("start_us"),
        ((F.max("last_us") - F.min("first_us")) / F.lit(1e6)).alias("duration"),
        F.sum("n").alias("downloads"),
        F.min(hour).alias("start_hour"),
        F.max(F.when(F.col("starts"), F.col("gap"))).alias("gap_before"))


SESSION_DEFAULTS = {"session_duration_cv": 1.0, "inter_session_regularity": 0.0,
                    "downloads_per_session_cv": 1.0, "session_start_hour_entropy": 2.0}


def session_behaviour(views: LogViews) -> DataFrame:
    """Spread of session length, size, gaps and start hour; needs two sessions."""
    per_hour = sessions(views).groupBy(LOC, "start_hour").agg(
        F.count(F.lit(1)).alias("c"),
        *[f("duration").alias(f"dur_{k}") for k, f in _MOMENTS.items()],
        *[f("downloads").alias(f"siz_{k}") for k, f in _MOMENTS.items()],
        F.count("gap_before").alias("gap_n"),
        *[f("gap_before").alias(f"gap_{k}") for k, f in _MOMENTS.items()])
    total = F.sum("c").over(Window.partitionBy(LOC))
    p = F.col("c") / F.col("total")
    # Start hours give at most 24 rows per location, from which every moment adds up.
    agg = per_hour.withColumn("total", total).groupBy(LOC).agg(
        F.sum("c").alias("k"), F.sum("gap_n").alias("gk"),
        (-F.sum(p * F.log2(p + 1e-10))).alias("session_start_hour_entropy"),
        *[F.sum(f"{a}_{k}").alias(f"{a}_{k}") for a in ("dur", "siz", "gap") for k in _MOMENTS],
    ).filter("k >= 2")

    def mean_sd(prefix: str, n: Column) -> tuple[Column, Column]:
        s, q = F.col(f"{prefix}_s"), F.col(f"{prefix}_q")
        mean = F.try_divide(s, n.cast("double"))
        var = F.try_divide(q - s * mean, n.cast("double") - 1)
        return mean, F.sqrt(F.greatest(var, F.lit(0.0)))
    (dm, ds), (sm, ss) = mean_sd("dur", F.col("k")), mean_sd("siz", F.col("k"))
    gm, gs = mean_sd("gap", F.col("gk"))
    gs = F.when(F.col("gk") > 1, gs)
    return agg.select(
        LOC, positive(dm, ds / dm, 0).alias("session_duration_cv"),
        F.coalesce(positive(gs, gm / gs, 0), F.lit(0.0)).alias("inter_session_regularity"),
        positive(sm, ss / sm, 0).alias("downloads_per_session_cv"),
        "session_start_hour_entropy")


_MOMENTS = {
    "s": lambda c: F.sum(F.col(c).cast("double")),
    "q": lambda c: F.sum(F.col(c).cast("double") * F.col(c).cast("double")),
}
