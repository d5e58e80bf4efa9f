"""Registered queries: one callable (session, table folder) -> DataFrame per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.catalogue_labels import label_queries
from logtide.catalogue_providers import provider_queries
from logtide.catalogue_reports import report_queries
from logtide.catalogue_streams import stream_queries
from logtide.functions.columns import LOC, left_features, rounded
from logtide.operators import access, composite, series, temporal, timing, users, volume
from logtide.operators.rollups import LogViews
from logtide.schema import LogSchema, get_schema
from logtide.session import materialise
from logtide.sources.fixtures import events_log, orders_log

Query = Callable[[SparkSession, str], DataFrame]
MIN_YEAR = 1995
# Thresholds of the fixture preset where production values cannot fire on the test tables.
FARM = {"farm_users": 100, "farm_homogeneity": 1.5}


def schema() -> LogSchema:
    return get_schema("canonical").with_options(min_year=MIN_YEAR)


def orders_views(spark: SparkSession, sf_dir: str) -> LogViews:
    return LogViews(orders_log(spark, sf_dir), schema())


def events_views(spark: SparkSession, sf_dir: str) -> LogViews:
    return LogViews(events_log(spark, sf_dir), schema())


def _on(make_views, feature, **digits) -> Query:
    return lambda spark, sf_dir: rounded(feature(make_views(spark, sf_dir)), **digits)


def _exploded(period: str):
    def run(views: LogViews) -> DataFrame:
        seq = series.sequence_features(views, period)
        rows = seq.select(LOC, F.posexplode("time_series_features").alias("i", "f"))
        return rows.select(LOC, (F.col("i") + 1).cast("bigint").alias("pos"), *[
            F.col("f")[k].alias(name) for k, name in enumerate(series.WINDOW_FEATURES)])
    return run


def _base_with(views: LogViews, *groups) -> DataFrame:
    """Base statistics plus feature groups given as (function, defaults)."""
    if groups:
        views = views.stored()
    table = volume.base_stats(views)
    for feature, defaults in groups:
        table = left_features(table, feature(views), defaults)
    return materialise(table, "locations")


def _hourly_users(v: LogViews) -> DataFrame:
    v = volume.base_views(v)
    v.hour_users  # written first: the hours are read from it
    return volume.hourly_users(v, _base_with(v))


def _country_rollup(v: LogViews) -> DataFrame:
    return volume.country_rollup(
        _base_with(v, (temporal.yearly_pattern, temporal.YEARLY_DEFAULTS)))


def _behaviour_flags(v: LogViews) -> DataFrame:
    return composite.behaviour_flags(_base_with(
        v, (timing.interval_regularity, timing.REGULARITY_DEFAULTS), (volume.day_of_week, {}),
        (volume.file_diversity, {}), (timing.session_counts, {})))


def _advanced_flags(v: LogViews) -> DataFrame:
    return composite.advanced_flags(_base_with(
        v, (temporal.burst_pattern, temporal.BURST_DEFAULTS), (temporal.circadian, {}),
        (temporal.user_coordination, temporal.COORDINATION_DEFAULTS)))


def _timed(v: LogViews) -> DataFrame:
    return _base_with(v, (temporal.time_of_day, temporal.TIME_OF_DAY_DEFAULTS))


def _interaction(v: LogViews) -> DataFrame:
    # The working-hours share stands in for the model's anomaly score.
    return composite.interaction_features(
        _timed(v).withColumn("anomaly_score", F.col("working_hours_ratio") - 0.5))


def _stability(v: LogViews) -> DataFrame:
    return composite.geographic_stability(composite.signature_features(_timed(v)))


def _scaled_exploration(v: LogViews) -> DataFrame:
    files = materialise(access.file_access(v), "files")
    column = composite.scaled(files, ["file_exploration_score"])["file_exploration_score"]
    return files.select(LOC, column.alias("file_exploration_scaled"))


def _authenticity(v: LogViews) -> DataFrame:
    return users.user_authenticity(v, **FARM)


def _discriminative(v: LogViews) -> DataFrame:
    table = _base_with(
        v, (temporal.time_of_day, temporal.TIME_OF_DAY_DEFAULTS),
        (volume.protocol_mix, volume.PROTOCOL_DEFAULTS),
        (access.file_access, access.FILE_ACCESS_DEFAULTS),
        (_authenticity, users.AUTHENTICITY_DEFAULTS),
        (access.version_targeting, access.VERSION_DEFAULTS),
        (temporal.persistence, temporal.PERSISTENCE_DEFAULTS))
    table = table.join(composite.signature_features(table).select(LOC, "ip_concentration"), LOC)
    table = table.join(composite.geographic_stability(table), LOC)
    return composite.discriminative_scores(materialise(table, "locations"))


def _micros(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.unix_micros(c) for c in ("first_seen", "last_seen")})


def _yearly_table(v: LogViews) -> DataFrame:
    return _base_with(v, (temporal.yearly_pattern, temporal.YEARLY_DEFAULTS))


def feature_queries() -> dict[str, Query]:
    o, e = orders_views, events_views
    return {
        "fe01_base_location_stats": _on(o, volume.base_stats),
        "fe02_hourly_user_density": _on(o, _hourly_users),
        "fe03_project_concentration": _on(o, volume.project_concentration),
        "fe04_yearly_pattern": _on(o, temporal.yearly_pattern),
        "fe05_time_of_day": _on(e, temporal.time_of_day),
        "fe06_country_rollup": _on(o, _country_rollup),
        "fe07_protocol_mix": _on(o, volume.protocol_mix),
        "fe08_monthly_sequence": _on(o, _exploded("month")),
        "fe08_weekly_sequence": _on(e, _exploded("week")),
        "fe09_interval_regularity": _on(e, timing.interval_regularity,
                                        mean_interval=3, std_interval=3),
        "fe10_day_of_week": _on(o, volume.day_of_week),
        "fe11_file_diversity": _on(o, volume.file_diversity),
        "fe12_session_counts": _on(e, timing.session_counts),
        "fe13_behaviour_flags": _on(e, _behaviour_flags),
        "fe14_burst_pattern": _on(e, temporal.burst_pattern),
        "fe15_circadian_deviation": _on(e, temporal.circadian),
        "fe16_user_coordination": _on(e, temporal.user_coordination),
        "fe17_advanced_flags": _on(e, _advanced_flags),
        "fe18_interaction_features": _on(e, _interaction),
        "fe19_timing_precision": _on(e, timing.timing_precision, millisecond_variance=1),
        "fe20_user_distribution": _on(o, users.user_distribution),
        "fe21_session_behaviour": _on(e, timing.session_behaviour),
        "fe22_signature_features": _on(o, lambda v: composite.signature_features(_timed(v))),
        "fe23_outbursts": _on(o, series.outbursts),
        "fe24_outburst_streak": _on(o, series.outburst_streak),
        "fe25_weekly_autocorrelation": _on(o, series.weekly_autocorrelation),
        "fe25_dominant_period": _on(e, series.dominant_period),
        "fe26_trend": _on(o, series.trend),
        "fe27_recency": _on(o, series.recency),
        "fe28_momentum": _on(o, series.momentum),
        "fe29_distribution_shape": _on(o, series.distribution_shape),
        "fe29_distribution_shape_calendar": _on(
            o, lambda v: series.distribution_shape(v, calendarize=True)),
        "fe30_hour_profile": _on(o, temporal.hour_profile),
        "fe31_file_access": _on(o, access.file_access),
        "fe31_file_access_compat": _on(o, lambda v: access.file_access(v, "compat")),
        "fe32_user_authenticity": _on(o, _authenticity),
        "fe33_geographic_stability": _on(o, _stability),
        "fe34_version_targeting": _on(o, access.version_targeting),
        "fe35_persistence": _on(o, temporal.persistence),
        "fe36_robust_scaling": _on(o, _scaled_exploration),
        "fe37_discriminative_scores": _on(o, _discriminative),
        "fe38_repeat_access": _on(o, access.repeat_access),
        "fe39_sequential_access": _on(o, access.sequential_access),
        "fe40_alphabetical_access": _on(o, access.alphabetical_access),
        "fe41_benford": _on(e, temporal.benford),
        "fe42_hourly_uniformity": _on(e, temporal.hourly_uniformity),
        "fe43_weekday_pattern": _on(o, temporal.weekday_pattern),
        "fe44_country_zscore": _on(o, lambda v: composite.country_zscore(_base_with(v))),
        "fe45_trend_anomaly": _on(o, lambda v: composite.trend_anomaly(_yearly_table(v))),
        "fe46_peer_similarity": _on(
            o, lambda v: composite.peer_similarity(_base_with(v))),
        "fe47_global_rank": _on(o, lambda v: composite.global_rank(_base_with(v))),
        "fe48_flat_profile": _on(o, lambda v: _micros(volume.flat_profile(v))),
        "fe49_ground_truth_profile": _on(e, lambda v: _micros(volume.ground_truth_profile(v))),
        "jn01_feature_join_defaults": _on(
            o, lambda v: left_features(
                volume.base_stats(v).select(LOC, "total_downloads"),
                timing.timing_precision(v), timing.PRECISION_DEFAULTS),
            millisecond_variance=1),
    }


def all_queries() -> dict[str, Query]:
    return {**feature_queries(), **label_queries(), **report_queries(), **stream_queries(),
            **provider_queries()}
