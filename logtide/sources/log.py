"""Reading download logs and the two base views every feature group starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.schema import LogSchema


def read_log(spark: SparkSession, path: str, schema: LogSchema) -> DataFrame:
    """Parquet log projected to the canonical columns."""
    return schema.canonical(spark.read.parquet(path))


def valid_events(log: DataFrame) -> DataFrame:
    """Events with a location and a time."""
    return log.filter(F.col("geo_location").isNotNull() & F.col("ts").isNotNull())


def valid_year_events(log: DataFrame, min_year: int) -> DataFrame:
    """Valid events from ``min_year`` on."""
    return valid_events(log).filter(F.col("year") >= min_year)


def well_formed_country(country="country", report: bool = False):
    """Country present and free of template leftovers; reports also drop placeholder names."""
    c = F.col(country) if isinstance(country, str) else country
    ok = c.isNotNull() & (c != "")
    if report:
        return ok & ~c.contains("%{") & ~c.isin("N/A", "Unknown")
    return ok & ~c.contains("{")
