"""Joining labels to the log and filtering the log by label."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logtide.functions.columns import LOC

FLAGS = ("is_bot", "is_hub", "is_organic")


def one_label_per_location(labels: DataFrame) -> DataFrame:
    """Labels with one row per location, so that annotating cannot multiply log rows."""
    w = Window.partitionBy(LOC).orderBy(F.desc("is_bot"), F.desc("is_hub"))
    return (labels.select(LOC, *FLAGS).withColumn("r", F.row_number().over(w))
            .filter("r = 1").drop("r"))


def annotate(log: DataFrame, labels: DataFrame) -> DataFrame:
    """Log plus the three flags; unlabelled locations count as organic.

    No broadcast is forced: the planner broadcasts the labels when their measured size allows,
    and otherwise splits skewed locations in the sort-merge join.
    """
    joined = log.join(one_label_per_location(labels), LOC, "left")
    return joined.withColumns({
        "is_bot": F.coalesce("is_bot", F.lit(False)),
        "is_hub": F.coalesce("is_hub", F.lit(False)),
        "is_organic": F.coalesce("is_organic", F.lit(True))})


def annotate_from_keys(log: DataFrame, bots: DataFrame, hubs: DataFrame) -> DataFrame:
    """Older form: bot and hub key tables, organic is neither."""
    b = bots.select(LOC).distinct().withColumn("b", F.lit(True))
    h = hubs.select(LOC).distinct().withColumn("h", F.lit(True))
    joined = log.join(b, LOC, "left").join(h, LOC, "left")
    bot, hub = F.col("b").isNotNull(), F.col("h").isNotNull()
    return joined.withColumns({"is_bot": bot, "is_hub": hub, "is_organic": ~bot & ~hub}) \
        .drop("b", "h")


def keys_of(labels: DataFrame, kind: str) -> DataFrame:
    """Distinct locations of one kind: ``user`` (neither bot nor hub), ``hub`` or ``bot``."""
    conditions = {"user": ~F.col("is_bot") & ~F.col("is_hub"), "hub": F.col("is_hub"),
                  "bot": F.col("is_bot")}
    return labels.filter(conditions[kind]).select(LOC).distinct()


def only(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Events of the given locations (IN)."""
    return log.join(keys, LOC, "left_semi")


def without(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Events of all other locations (NOT IN: events without a location are dropped too)."""
    return log.filter(F.col(LOC).isNotNull()).join(keys, LOC, "left_anti")


def filter_log(log: DataFrame, labels: DataFrame, mode: str) -> DataFrame:
    """``user_only``, ``hub_only``, ``bot_only`` or ``no_bots``."""
    if mode == "no_bots":
        return without(log, keys_of(labels, "bot"))
    if mode not in ("user_only", "hub_only", "bot_only"):
        raise ValueError(f"unknown filter mode {mode!r}")
    return only(log, keys_of(labels, mode.split("_")[0]))
