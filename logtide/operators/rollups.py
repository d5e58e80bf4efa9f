"""Base views and shared roll-ups of one log.

The log is scanned by a handful of roll-ups; most features read those and never touch raw events.
Each roll-up groups by (location, something), so a location that holds a third of the log is
spread over many tasks and pre-aggregated before the shuffle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.functions.columns import LOC
from logtide.schema import LogSchema
from logtide.session import materialise
from logtide.sources.log import valid_events, valid_year_events

SESSION_GAP = 1800


class LogViews:
    """Lazy views over a canonical log.

    ``durable=True`` writes each roll-up once to the shared folder, for runs that build all
    feature groups from them; with ``kept`` only those named there.
    """

    SHARED = ("hour_users", "user", "user_days", "user_files", "project", "file", "half_hour")

    def __init__(self, log: DataFrame, schema: LogSchema, durable: bool = False,
                 kept: tuple[str, ...] | None = None):
        self.log = log
        self.schema = schema
        self.durable = durable
        self.kept = kept

    def stored(self, *columns: str, kept: tuple[str, ...] | None = None) -> LogViews:
        """Durable views over a log written once (only ``columns``, if given), for several scans.

        Times are written as microseconds, since Parquet files of Spark hold a timestamp in twelve bytes
        that every scan has to convert.
        """
        if self.durable:
            return self
        log = self.log.select(*columns) if columns else self.log
        times = [c for c, kind in log.dtypes if kind == "timestamp"]
        written = materialise(log.withColumns({c: F.unix_micros(c) for c in times}), "log")
        return LogViews(written.withColumns({c: F.timestamp_micros(c) for c in times}), self.schema,
                        durable=True, kept=kept)

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        wanted = self.durable and (self.kept is None or name in self.kept)
        return materialise(df, name) if wanted else df

    @cached_property
    def located(self) -> DataFrame:
        return self.log.filter(F.col(LOC).isNotNull())

    @cached_property
    def valid(self) -> DataFrame:
        return valid_events(self.log)

    @cached_property
    def valid_year(self) -> DataFrame:
        return valid_year_events(self.log, self.schema.min_year)

    @cached_property
    def hour(self) -> DataFrame:
        """(location, hour, year) counts; day, week, year and hour-of-day series derive from it.

        They are read from ``hour_users`` where that is already written.
        """
        if self.durable and "hour_users" in self.__dict__:
            return self.hour_users.drop("users")
        return self._keep(
            self.valid.groupBy(LOC, F.date_trunc("hour", "ts").alias("hour_ts"), "year")
            .agg(F.count(F.lit(1)).alias("n")), "hour")

    @cached_property
    def hour_year(self) -> DataFrame:
        return self.hour.filter(F.col("year") >= self.schema.min_year)

    @cached_property
    def hour_users(self) -> DataFrame:
        """(location, hour, year) counts and distinct non-null users; 0 users for hours with none."""
        return self._keep(
            self.valid.groupBy(LOC, F.date_trunc("hour", "ts").alias("hour_ts"), "year")
            .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("usr").alias("users")), "hour_users")

    @cached_property
    def day(self) -> DataFrame:
        return (self.hour.groupBy(LOC, F.date_trunc("day", "hour_ts").alias("day"))
                .agg(F.sum("n").alias("n")))

    @cached_property
    def week(self) -> DataFrame:
        return (self.hour.groupBy(LOC, F.date_trunc("week", "hour_ts").alias("week"))
                .agg(F.sum("n").alias("n")))

    @cached_property
    def year(self) -> DataFrame:
        return self.hour_year.groupBy(LOC, "year").agg(F.sum("n").alias("n"))

    @cached_property
    def clock(self) -> DataFrame:
        """(location, hour of day) counts over all valid events."""
        return (self.hour.groupBy(LOC, F.hour("hour_ts").cast("bigint").alias("hod"))
                .agg(F.sum("n").alias("n")))

    @cached_property
    def clock_year(self) -> DataFrame:
        return (self.hour_year.groupBy(LOC, F.hour("hour_ts").cast("bigint").alias("hod"))
                .agg(F.sum("n").alias("n")))

    @cached_property
    def user(self) -> DataFrame:
        """(location, user) counts: all events, those with a file and valid ones from ``min_year`` on."""
        in_years = F.col("ts").isNotNull() & (F.col("year") >= self.schema.min_year)
        return self._keep(self.located.filter(F.col("usr").isNotNull()).groupBy(LOC, "usr").agg(
            F.count(F.lit(1)).alias("n"), F.count("filename").alias("n_file"),
            F.count_if(in_years).alias("n_year")), "user")

    @cached_property
    def user_days(self) -> DataFrame:
        """Distinct (user, day) pairs per location, over events with a file and a time."""
        return self._keep(
            self._user_events.filter(F.col("ts").isNotNull())
            .select(LOC, "usr", F.date_trunc("day", "ts").alias("day")).distinct()
            .groupBy(LOC).agg(F.count(F.lit(1)).alias("days")), "user_days")

    @cached_property
    def user_files(self) -> DataFrame:
        """Distinct (user, file) pairs per location."""
        return self._keep(
            self._user_events.select(LOC, "usr", "filename").distinct()
            .groupBy(LOC).agg(F.count(F.lit(1)).alias("files")), "user_files")

    @cached_property
    def _user_events(self) -> DataFrame:
        return self.located.filter(F.col("usr").isNotNull() & F.col("filename").isNotNull())

    @cached_property
    def project(self) -> DataFrame:
        return self._keep(
            self.valid_year.filter(F.col("accession").isNotNull())
            .groupBy(LOC, "accession").agg(F.count(F.lit(1)).alias("n")), "project")

    @cached_property
    def file(self) -> DataFrame:
        """(location, file) counts with distinct users."""
        return self._keep(
            self.located.filter(F.col("filename").isNotNull())
            .groupBy(LOC, "filename")
            .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("usr").alias("users")), "file")

    @cached_property
    def half_hour(self) -> DataFrame:
        """(location, half hour) with first and last event time.

        A session break is a gap of more than 1800 s, so none can fall inside one of these
        bins: sessions follow exactly from the bins, without ordering single events.
        """
        micros = F.unix_micros("ts")
        width = SESSION_GAP * 1_000_000
        return self._keep(
            self.valid.select(LOC, micros.alias("us"),
                              F.floor(micros / F.lit(width)).alias("bin"))
            .groupBy(LOC, "bin")
            .agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"),
                 F.count(F.lit(1)).alias("n")), "half_hour")
