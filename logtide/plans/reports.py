"""Report tables over the labelled location table, in tidy form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.functions.columns import LOC, ratio
from logtide.functions.ranks import quantiles
from logtide.operators.proximity import proximity_groups
from logtide.sources.log import well_formed_country


def _n() -> Column:
    return F.count(F.lit(1))


def _total(df: DataFrame, column: str | None = None) -> Column:
    return df.agg(F.sum(column) if column else _n()).scalar()


def _part(cond: Column) -> Column:
    return F.sum(F.when(cond, F.col("total_downloads")).otherwise(0)).cast("bigint")


def run_totals(labelled: DataFrame) -> DataFrame:
    """Downloads of bots, hubs and the rest; user categories where there are any."""
    bot, hub = F.col("is_bot"), F.col("is_hub")
    aggs = [F.sum("total_downloads").alias("total"), _part(bot).alias("bots"),
            _part(hub).alias("hubs")]
    if "user_category" not in labelled.columns:
        return labelled.agg(*aggs).withColumn(
            "normal", F.col("total") - F.col("bots") - F.col("hubs"))
    kind = F.col("user_category")
    return labelled.agg(*aggs, _part(kind == "independent_user").alias("independent_users"),
                        _part(kind == "other").alias("other_downloads"),
                        _part(kind == "normal").alias("normal"))


def classification_counts(labelled: DataFrame) -> DataFrame:
    """Locations and downloads per final label with their percentages."""
    n, d = _total(labelled), _total(labelled, "total_downloads")
    return labelled.groupBy("final_label").agg(
        _n().alias("locations"), F.sum("total_downloads").alias("downloads")).withColumns({
            "locations_pct": F.round(F.col("locations") / n * 100, 2),
            "downloads_pct": F.round(ratio(F.col("downloads") * 100, d, 0), 2)})


def hierarchy_counts(labelled: DataFrame) -> DataFrame:
    """Behaviour types and, within automated locations, automation categories."""
    total = _total(labelled)

    def level(df: DataFrame, column: str, of: Column) -> DataFrame:
        return df.groupBy(F.lit(column).alias("level"), F.col(column).alias("value")).agg(
            _n().alias("locations"), F.sum("total_downloads").alias("downloads")).withColumns({
                "pct": F.round(F.col("locations") / of * 100, 2),
                "pct_of_total": F.round(F.col("locations") / total * 100, 2)})
    automated = labelled.filter(F.col("behavior_type") == "automated")
    inner = automated.filter(F.col("automation_category").isNotNull())
    return level(labelled, "behavior_type", total).unionByName(
        level(inner, "automation_category", _total(automated)))


PROFILED = ["unique_users", "downloads_per_user", "total_downloads", "working_hours_ratio",
            "night_activity_ratio", "hourly_entropy", "regularity_score", "anomaly_score",
            "user_coordination_score", "interval_cv", "file_diversity_ratio",
            "burst_pattern_score"]
IMPORTANCE = ["unique_users", "downloads_per_user", "working_hours_ratio",
              "night_activity_ratio", "hourly_entropy", "regularity_score", "anomaly_score",
              "user_coordination_score", "fraction_latest_year", "spike_ratio", "interval_cv",
              "burst_pattern_score"]


def long_features(df: DataFrame, features: list[str], *keep: str) -> DataFrame:
    """(feature, value) rows of the present features, NULLs left out."""
    present = [c for c in features if c in df.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                      for c in present])
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.feature", "p.value") \
        .filter(F.col("value").isNotNull())


def feature_profile(labelled: DataFrame, features: list[str] = PROFILED) -> DataFrame:
    """Moments and quantiles per feature, also apart for bots and the rest."""
    rows = long_features(labelled, features, "is_bot")
    v, bot = F.col("value"), F.col("is_bot")
    moments = rows.groupBy("feature").agg(
        _n().alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
        F.avg(F.when(bot, v)).alias("bot_mean"), F.stddev_samp(F.when(bot, v)).alias("bot_std"),
        F.avg(F.when(~bot, v)).alias("normal_mean"),
        F.stddev_samp(F.when(~bot, v)).alias("normal_std"))
    marks = quantiles(rows.select("feature", "value"), "value",
                      {"q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}, ["feature"])
    return moments.join(marks, "feature")


def _median(df: DataFrame, column: str) -> Column:
    return quantiles(df.select(column), column, {"m": 0.5}).select("m").scalar()


def temporal_metrics(labelled: DataFrame) -> DataFrame:
    y, latest, whr = F.col("years_span"), F.col("fraction_latest_year"), \
        F.col("working_hours_ratio")
    out = labelled.agg(
        F.avg(y).alias("years_span_mean"), F.max(y).alias("years_span_max"),
        F.count_if(y == 1).alias("single_year_locations"),
        F.count_if(y > 1).alias("multi_year_locations"),
        F.avg(latest).alias("latest_fraction_mean"),
        F.count_if(latest > 0.8).alias("high_concentration"),
        F.count_if(latest > 0.95).alias("very_high_concentration"),
        F.sum("is_new_location").alias("new_locations"),
        (F.avg("is_new_location") * 100).alias("new_locations_pct"),
        F.avg(whr).alias("working_hours_mean"), F.count_if(whr > 0.6).alias("daytime_dominant"),
        F.count_if(whr < 0.3).alias("nighttime_dominant"))
    return out.withColumns({
        "years_span_median": _median(labelled, "years_span"),
        "latest_fraction_median": _median(labelled, "fraction_latest_year"),
        "working_hours_median": _median(labelled, "working_hours_ratio")})


def geographic_metrics(labelled: DataFrame, k: int = 10, least: int = 10) -> DataFrame:
    """Ranked countries: by locations, downloads, bot locations and bot share."""
    per = labelled.filter(F.col("country").isNotNull()).groupBy("country").agg(
        _n().cast("double").alias("locations"),
        F.sum("total_downloads").cast("double").alias("downloads"),
        F.count_if("is_bot").cast("double").alias("bots"))
    per = per.withColumn("bot_pct", F.col("bots") / F.col("locations") * 100)

    def top(df: DataFrame, column: str) -> DataFrame:
        return df.orderBy(F.desc(column), "country").limit(k).select(
            F.lit(column).alias("metric"), "country", F.col(column).alias("value"))
    return top(per, "locations").unionByName(top(per, "downloads")) \
        .unionByName(top(per.filter("bots > 0"), "bots")) \
        .unionByName(top(per.filter(F.col("locations") >= least), "bot_pct"))


def top_bot_share(labelled: DataFrame, k: int = 10, least: int = 10) -> DataFrame:
    return geographic_metrics(labelled, k, least).filter(F.col("metric") == "bot_pct") \
        .select("country", F.round("value", 2).alias("bot_pct"))


def download_metrics(labelled: DataFrame) -> DataFrame:
    dpu, users = F.col("downloads_per_user"), F.col("unique_users")
    out = labelled.agg(
        F.sum("total_downloads").alias("total_downloads"), F.avg(dpu).alias("dpu_mean"),
        F.max(dpu).alias("dpu_max"), F.count_if(dpu > 500).alias("dpu_very_high"),
        F.count_if(dpu < 10).alias("dpu_very_low"), F.sum(users).alias("users_total"),
        F.avg(users).alias("users_mean"), F.max(users).alias("users_max"),
        F.count_if(users == 1).alias("single_user_locations"),
        F.count_if(users > 1000).alias("high_user_locations"))
    return out.withColumns({"dpu_median": _median(labelled, "downloads_per_user"),
                            "users_median": _median(labelled, "unique_users")})


def _guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation, NULL for a constant series (a plain corr would divide by zero)."""
    den = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(den > 0, F.covar_pop(x, y) / den)


def bot_correlation(labelled: DataFrame, features: list[str] = IMPORTANCE,
                    least: int = 10) -> DataFrame:
    rows = long_features(labelled, features, "is_bot")
    y = F.col("is_bot").cast("double")
    return rows.groupBy("feature").agg(_n().alias("n"), _guarded_corr(F.col("value"), y)
                                       .alias("corr")) \
        .filter((F.col("n") >= least) & F.col("corr").isNotNull()) \
        .select("feature", F.round("corr", 4).alias("corr"))


def correlation_matrix(labelled: DataFrame, features: list[str]) -> DataFrame:
    """All pairs of a fixed feature list in one aggregation over the table."""
    pairs = [(a, b) for a in features for b in features]
    row = labelled.agg(*[_guarded_corr(F.col(a).cast("double"), F.col(b).cast("double"))
                         .alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                               F.col(f"{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(cells).alias("c")).select("c.*")


def city_rollup(labelled: DataFrame, above: int = 100_000, k: int = 50) -> DataFrame:
    out = labelled.filter(well_formed_country(report=True)).groupBy("country", "city").agg(
        F.sum("unique_users").alias("total_users"),
        F.sum("total_downloads").alias("total_downloads"), _n().alias("num_locations"))
    return (out.filter(F.col("total_downloads") > above)
            .withColumn("downloads_per_user",
                        ratio(F.col("total_downloads"), F.col("total_users")))
            .orderBy(F.desc("downloads_per_user"), "country", "city").limit(k))


def consolidated_hubs(labelled: DataFrame, km: float = 10.0) -> DataFrame:
    """Hubs merged with their neighbours; up to three city names per group.

    Hubs are taken in order of downloads (largest first, ties by location).
    """
    from logtide.functions.ranks import sliced_row_number
    hubs = labelled.filter("is_hub").filter(well_formed_country(report=True)).select(
        LOC, "country", "city", "unique_users", "total_downloads")
    order = F.struct((-F.col("total_downloads")).alias("d"), F.col(LOC))
    ranked = sliced_row_number(hubs, [], order, "rank")
    groups = proximity_groups(ranked, km).select(LOC, "leader_location")
    joined = ranked.join(groups, LOC)
    # Three cities per group are picked by rank, not by gathering all of them.
    names = (joined.filter(F.col("city").isNotNull())
             .groupBy("country", "leader_location", "city").agg(F.min("rank").alias("r"))
             .withColumn("i", F.row_number().over(
                 Window.partitionBy("country", "leader_location").orderBy("city")))
             .filter("i <= 3").groupBy("country", "leader_location")
             .agg(F.array_join(F.array_sort(F.collect_list("city")), ", ").alias("cities")))
    out = joined.groupBy("country", "leader_location").agg(
        _n().alias("num_locations"), F.sum("unique_users").alias("total_users"),
        F.sum("total_downloads").alias("total_downloads"))
    return out.join(names, ["country", "leader_location"], "left").withColumn(
        "downloads_per_user", ratio(F.col("total_downloads"), F.col("total_users")))


def listing(labelled: DataFrame, kind: str, by: str) -> DataFrame:
    """All well-formed locations of one label, for a sorted listing."""
    return labelled.filter((F.col("final_label") == kind) & well_formed_country(report=True)) \
        .select("country", "city", LOC, "unique_users", "downloads_per_user") \
        .orderBy(F.desc(by), LOC)


def top_locations(labelled: DataFrame, condition: Column, by: str, k: int) -> DataFrame:
    return labelled.filter(condition).orderBy(F.desc(by), LOC).limit(k).select(
        LOC, "country", "unique_users", "total_downloads", "downloads_per_user")


def class_histogram(labelled: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between each label's smallest and largest value."""
    span = labelled.groupBy("final_label").agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    rows = labelled.select("final_label", F.col(column).alias("v")) \
        .filter(F.col("v").isNotNull()).join(span, "final_label")
    width = (F.col("hi") - F.col("lo")) / bins
    pos = F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("lo"), width)), F.lit(0))
    return rows.groupBy("final_label", F.least(pos, F.lit(bins - 1)).cast("bigint").alias("bin")) \
        .agg(_n().alias("locations"))


def class_quartiles(labelled: DataFrame, column: str) -> DataFrame:
    return quantiles(labelled.select("final_label", column), column,
                     {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["final_label"])


def class_downloads_by_country(labelled: DataFrame, k: int = 30) -> DataFrame:
    """Top countries of each label by downloads."""
    per = labelled.filter(F.col("country").isNotNull()).groupBy("final_label", "country").agg(
        F.sum("total_downloads").alias("downloads"))
    w = Window.partitionBy("final_label").orderBy(F.desc("downloads"), "country")
    return per.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k) \
        .withColumn("rank", F.col("rank").cast("bigint"))


def prediction_summary(labelled: DataFrame) -> DataFrame:
    total = _total(labelled)
    low = labelled.agg(F.avg(F.when(F.col("classification_confidence") < 0.5, 1.0)
                             .otherwise(0.0)) * 100).scalar()
    return labelled.groupBy("final_label").agg(
        _n().alias("locations"), F.avg("classification_confidence").alias("mean_confidence")) \
        .withColumns({"pct": F.col("locations") / total * 100, "low_confidence_pct": low})


def run_summary(labelled: DataFrame, method: str, seconds: float | None = None) -> DataFrame:
    """One row per run: locations and downloads per class with percentages."""
    n, d = F.col("locations"), F.col("total_downloads")
    out = labelled.agg(
        _n().alias("locations"), F.sum("total_downloads").alias("total_downloads"),
        F.countDistinct("country").alias("countries"),
        *[F.count_if(F.col("final_label") == c).alias(f"{c}_locations")
          for c in ("bot", "hub", "user")],
        *[_part(F.col("final_label") == c).alias(f"{c}_downloads")
          for c in ("bot", "hub", "user")])
    extra = {f"{c}_pct": ratio(F.col(f"{c}_locations") * 100, n, 0)
             for c in ("bot", "hub", "user")}
    extra |= {f"{c}_dl_pct": ratio(F.col(f"{c}_downloads") * 100, d, 0)
              for c in ("bot", "hub", "user")}
    out = out.withColumns(extra).withColumn("method", F.lit(method))
    return out if seconds is None else out.withColumn("seconds", F.lit(float(seconds)))


def nested_summary(labelled: DataFrame, method: str) -> DataFrame:
    """The run summary as one row of nested structs, ready for a JSON sink."""
    s = run_summary(labelled, method)
    kinds = {c: F.struct(F.col(f"{c}_locations").alias("locations"),
                         F.col(f"{c}_pct").alias("locations_pct"),
                         F.col(f"{c}_downloads").alias("downloads"),
                         F.col(f"{c}_dl_pct").alias("downloads_pct")).alias(c)
             for c in ("bot", "hub", "user")}
    return s.select("method", F.col("locations").alias("total_locations"), "total_downloads",
                    "countries", F.struct(*kinds.values()).alias("classification"))
