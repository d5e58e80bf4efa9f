"""Registered queries of the provider registry: a provider's taxonomy and its own extractors on the order log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.functions.columns import LOC, left_features
from logtide.operators import rules, temporal, volume
from logtide.operators.locations import FeatureGroup, location_features
from logtide.operators.rollups import LogViews
from logtide.providers import Provider, get_provider, register_provider
from logtide.sources.fixtures import orders_log


def month_spread(views: LogViews) -> DataFrame:
    """Active months of a location and the share of its busiest one."""
    months = views.hour.groupBy(LOC, F.date_trunc("month", "hour_ts").alias("month")).agg(F.sum("n").alias("n"))
    return months.groupBy(LOC).agg(F.count(F.lit(1)).alias("active_months"),
                                   F.round(F.max("n") / F.sum("n"), 6).alias("peak_month_share"))


def users_per_project(table: DataFrame) -> DataFrame:
    return table.select(LOC, (F.col("unique_users") / F.col("unique_projects")).alias("users_per_project"))


#: The order log as a provider; its thresholds fit the test tables.
register_provider(Provider("order_log", {
    "schema": {"preset": "canonical", "min_year": 1995},
    "behavior_type": {
        "organic": [{"id": "working_hours_human", "working_hours_ratio": {"min": 0.335}}],
        "automated": [{"id": "very_high_volume", "downloads_per_user": {"min": 1.06}, "unique_users": {"max": 480}}],
    },
    "rule_based": {"organic_max_users": 500},
}, extractors=(FeatureGroup("month_spread", from_log=month_spread),
               FeatureGroup("users_per_project", from_table=users_per_project))))


def _views(spark: SparkSession, sf_dir: str) -> LogViews:
    schema = get_provider("order_log").schema
    return LogViews(schema.canonical(orders_log(spark, sf_dir)), schema)


def _udx01(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = get_provider("order_log").run_config(("month_spread",))
    table = location_features(_views(spark, sf_dir), groups=(), custom=config.custom_groups)
    return table.select(LOC, "active_months", "peak_month_share")


def _udx04(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = _views(spark, sf_dir)
    table = left_features(volume.base_stats(views), temporal.time_of_day(views), temporal.TIME_OF_DAY_DEFAULTS)
    return rules.behavior_type(table, get_provider("order_log").rules).select(LOC, "behavior_type")


def provider_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"udx01_custom_extractor": _udx01, "udx04_provider_taxonomy": _udx04}
