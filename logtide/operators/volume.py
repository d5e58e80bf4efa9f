"""Volume, concentration, protocol and country features (one row per location)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logtide.functions.columns import EPS, LOC, hour_of, ratio, weekday
from logtide.operators.rollups import LogViews


def main_place(log: DataFrame) -> DataFrame:
    """Most frequent country (ties: smallest name) and largest city name of each location.

    Text extremes and ``mode`` beside distinct counts would turn that aggregation into a sort of
    all events; here they see one row per distinct place.
    """
    places = log.groupBy(LOC, "country", "city").agg(F.count(F.lit(1)).alias("n"))
    countries = places.groupBy(LOC, "country").agg(F.sum("n").alias("n"), F.max("city").alias("c"))
    named = F.col("country").isNotNull()
    best = F.min(F.when(named, F.struct((-F.col("n")).alias("n"), "country")))
    return countries.groupBy(LOC).agg(best.alias("b"), F.max("c").alias("city")) \
        .select(LOC, F.col("b.country"), "city")


BASE_COLUMNS = [LOC, "country", "city", "usr", "accession", "filename", "ts", "year"]


def base_views(views: LogViews) -> LogViews:
    """Views over the log's base columns, written once; of the roll-ups only the hours, read several times."""
    return views.stored(*BASE_COLUMNS, kept=("hour", "hour_users"))


def base_stats(views: LogViews) -> DataFrame:
    """Location totals. A location seen with several countries keeps its most frequent one.

    Each distinct count is read from its own narrow roll-up. Several of them in one aggregation
    would repeat every event once for each, with all their columns as keys.
    """
    views = base_views(views)
    hours = views.hour_year.groupBy(LOC).agg(
        F.sum("n").alias("total_downloads"), F.countDistinct("hour_ts").alias("active_hours"))
    years = views.year.groupBy(LOC).agg(
        F.count(F.lit(1)).alias("years_active"), F.min("year").alias("first_year"),
        F.max("year").alias("last_year"))
    users = views.user.filter("n_year > 0").groupBy(LOC).agg(F.count(F.lit(1)).alias("unique_users"))
    projects = views.project.groupBy(LOC).agg(F.count(F.lit(1)).alias("unique_projects"))
    out = hours.join(years, LOC).join(users, LOC, "left").join(projects, LOC, "left").select(
        LOC, F.coalesce("unique_users", F.lit(0)).alias("unique_users"), "total_downloads",
        F.coalesce("unique_projects", F.lit(0)).alias("unique_projects"), "active_hours",
        "years_active", "first_year", "last_year",
    ).withColumn("downloads_per_user", ratio(F.col("total_downloads"), F.col("unique_users")))
    kept = minimum_volume(out, views.schema.min_location_downloads)
    return kept.join(main_place(views.valid_year), LOC, "left")


def minimum_volume(locations: DataFrame, least: int) -> DataFrame:
    return locations.filter(F.col("total_downloads") >= least)


def hourly_users(views: LogViews, base: DataFrame) -> DataFrame:
    """User density per hour, relative to the mean over all locations."""
    per_loc = (views.hour_users.filter(F.col("year") >= views.schema.min_year)
               .groupBy(LOC).agg(F.avg("users").alias("avg_users_per_hour"),
                                 F.max("users").alias("max_users_per_hour")))
    joined = base.select(LOC, "unique_users", "active_hours", "unique_projects") \
        .join(per_loc, LOC, "left")
    mean = joined.agg(F.avg("avg_users_per_hour")).scalar()
    return joined.select(
        LOC, "avg_users_per_hour", "max_users_per_hour",
        (F.coalesce("avg_users_per_hour", F.lit(0.0)) / (mean + F.lit(EPS))).alias("user_cv"),
        (F.col("unique_users") / F.greatest("active_hours", F.lit(1)))
        .alias("users_per_active_hour"),
        (F.col("unique_projects") / F.greatest("unique_users", F.lit(1)))
        .alias("projects_per_user"),
    )


PROJECT_DEFAULTS = {"top_project_concentration": 0.0, "top3_project_concentration": 0.0,
                    "project_hhi": 0.0}


def project_concentration(views: LogViews) -> DataFrame:
    """Shares of the largest and the three largest projects, and the sum of squared shares."""
    # Projects with the same count are one row, so no project is ranked by itself.
    counts = views.project.groupBy(LOC, "n").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(LOC).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    room = F.lit(3) - (F.sum("c").over(w) - F.col("c"))
    totals = counts.withColumn("first", F.greatest(F.least(room, F.col("c")), F.lit(0))).groupBy(LOC).agg(
        F.sum(F.col("n") * F.col("c")).alias("t"), F.max("n").alias("top1"),
        F.sum(F.col("n").cast("double") * F.col("n") * F.col("c")).alias("sq"),
        F.sum(F.col("n") * F.col("first")).alias("top3"))
    return totals.select(
        LOC,
        ratio(F.col("top1"), F.col("t")).alias("top_project_concentration"),
        ratio(F.col("top3"), F.col("t")).alias("top3_project_concentration"),
        (F.col("sq") / F.pow(F.col("t").cast("double"), F.lit(2.0))).alias("project_hhi"),
    )


PROTOCOL_DEFAULTS = {"http_ratio": 1.0, "ftp_ratio": 0.0, "aspera_ratio": 0.0,
                     "globus_ratio": 0.0, "protocol_diversity": 1,
                     "protocol_legitimacy_score": 0.1}

# Fixed weights of the protocols in the legitimacy score.
PROTOCOL_WEIGHTS = {"aspera": 0.9, "globus": 0.95, "ftp": 0.6, "http": 0.1}


def protocol_mix(views: LogViews) -> DataFrame:
    """Shares of the transfer protocols; a log without a method field counts as http only."""
    if views.schema.method_field is None:
        return views.valid_year.select(LOC).distinct().select(
            LOC, *[F.lit(v).alias(k) for k, v in PROTOCOL_DEFAULTS.items()])
    m, n = F.lower("method"), F.col("n")
    uses = {"http": m == "http", "ftp": m == "ftp", "aspera": m.contains("aspera"),
            "globus": m.contains("globus")}
    # A few methods per location, so the texts are compared once for each and not for each event.
    methods = views.valid_year.groupBy(LOC, "method").agg(F.count(F.lit(1)).alias("n"))
    out = methods.groupBy(LOC).agg(
        *[(F.sum(F.when(c, n).otherwise(0)) / F.sum(n)).alias(f"{k}_ratio") for k, c in uses.items()],
        F.count("method").alias("protocol_diversity"))
    score = sum((F.col(f"{k}_ratio") * w for k, w in PROTOCOL_WEIGHTS.items()), F.lit(0.0))
    return out.withColumn("protocol_legitimacy_score", score)


DAY_OF_WEEK_DEFAULTS = {"weekend_ratio": 0.3, "unique_days_of_week": 5}


def day_of_week(views: LogViews) -> DataFrame:
    day = weekday(F.col("hour_ts"))
    return views.hour.groupBy(LOC).agg(
        (F.sum(F.when(day.isin(0, 6), F.col("n")).otherwise(0)) / F.sum("n"))
        .alias("weekend_ratio"),
        F.countDistinct(day).alias("unique_days_of_week"))


FILE_DIVERSITY_DEFAULTS = {"file_concentration": 1.0, "file_diversity_ratio": 1.0}


def file_diversity(views: LogViews) -> DataFrame:
    """Distinct files against all downloads (events without a file count as downloads)."""
    out = views.located.groupBy(LOC).agg(
        F.countDistinct("filename").alias("unique_files"), F.count(F.lit(1)).alias("t"))
    return out.select(
        LOC, "unique_files",
        ratio(F.lit(1.0), F.col("unique_files")).alias("file_concentration"),
        ratio(F.col("unique_files"), F.col("t")).alias("file_diversity_ratio"))


COUNTRY_COLUMNS = [
    "locations_per_country", "country_latest_year_dl", "country_total_dl",
    "country_avg_fraction_latest", "country_new_locations", "country_high_spike_locations",
    "country_low_dl_user_locations", "country_total_users", "country_fraction_latest",
    "country_new_location_ratio", "country_suspicious_location_ratio",
]


def country_stats(locations: DataFrame) -> DataFrame:
    """One row per non-null country."""
    n = F.col("locations_per_country")
    return (locations.filter(F.col("country").isNotNull()).groupBy("country").agg(
        F.count(F.lit(1)).alias("locations_per_country"),
        F.sum("latest_year_downloads").alias("country_latest_year_dl"),
        F.sum("total_downloads").alias("country_total_dl"),
        F.avg("fraction_latest_year").alias("country_avg_fraction_latest"),
        F.sum("is_new_location").alias("country_new_locations"),
        F.count_if(F.col("spike_ratio") > 1.5).alias("country_high_spike_locations"),
        F.count_if(F.col("downloads_per_user") < 30).alias("country_low_dl_user_locations"),
        F.sum("unique_users").alias("country_total_users"))
        .withColumns({
            "country_fraction_latest":
                ratio(F.col("country_latest_year_dl"), F.col("country_total_dl"), 0.0),
            "country_new_location_ratio": ratio(F.col("country_new_locations"), n, 0.0),
            "country_suspicious_location_ratio": ratio(
                F.col("country_high_spike_locations") + F.col("country_low_dl_user_locations"),
                n * 2, 0.0),
        }))


def country_rollup(locations: DataFrame) -> DataFrame:
    """Country statistics given back to each location; 0 where the country is unknown."""
    joined = locations.select(LOC, "country").join(country_stats(locations), "country", "left")
    return joined.select(LOC, *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTRY_COLUMNS])


def flat_profile(views: LogViews, least: int = 10) -> DataFrame:
    """Single-pass location profile (working hours 9..17 inclusive, night before 6 or from 22)."""
    hour, m = hour_of(F.col("ts")), F.col("method")
    out = views.located.groupBy(LOC).agg(
        F.count(F.lit(1)).alias("total_downloads"),
        F.countDistinct("usr").alias("unique_users"),
        F.countDistinct("accession").alias("unique_projects"),
        F.countDistinct("filename").alias("unique_files"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.countDistinct(hour).alias("distinct_hours"),
        F.countDistinct("year").alias("years_active"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.count_if(hour.between(9, 17)).alias("working"),
        F.count_if((hour < 6) | (hour >= 22)).alias("night"),
        F.count_if(weekday(F.col("ts")).isin(0, 6)).alias("weekend"),
        F.count_if(m == "http").alias("http_downloads"),
        F.count_if(m == "ftp").alias("ftp_downloads"),
        F.count_if(m == "fasp-aspera").alias("aspera_downloads"),
        F.count_if(m == "gridftp-globus").alias("globus_downloads"),
    ).filter(F.col("total_downloads") >= least)
    out = out.join(main_place(views.located).drop("city"), LOC, "left")
    n = F.col("total_downloads")
    return out.withColumns({
        "downloads_per_user": ratio(n, F.col("unique_users")),
        "working_hours_ratio": ratio(F.col("working"), n),
        "night_activity_ratio": ratio(F.col("night"), n),
        "weekend_ratio": ratio(F.col("weekend"), n),
        "file_diversity_ratio": ratio(F.col("unique_files"), n),
        "users_per_project": ratio(F.col("unique_users"), F.col("unique_projects")),
        "projects_per_user": ratio(F.col("unique_projects"), F.col("unique_users")),
        "downloads_per_year": n / F.greatest("years_active", F.lit(1)),
        "years_span": F.col("last_year") - F.col("first_year") + 1,
        "hourly_entropy": F.log(F.greatest("distinct_hours", F.lit(1))) / F.log(F.lit(24.0)),
        "http_ratio": ratio(F.col("http_downloads"), n),
        "ftp_ratio": ratio(F.col("ftp_downloads"), n),
        "aspera_ratio": ratio(F.col("aspera_downloads"), n),
        "globus_ratio": ratio(F.col("globus_downloads"), n),
    }).drop("working", "night", "weekend")


GROUND_TRUTH_PROFILE = [
    LOC, "country", "total_downloads", "unique_users", "unique_projects", "first_seen",
    "last_seen", "downloads_per_user", "working_hours_ratio", "night_activity_ratio",
    "weekend_ratio", "distinct_hours", "unique_files", "file_diversity_ratio",
]


def ground_truth_profile(views: LogViews, least: int = 10) -> DataFrame:
    """The columns of the flat profile that the heuristic ground truth reads."""
    return flat_profile(views, least).select(*GROUND_TRUTH_PROFILE)
