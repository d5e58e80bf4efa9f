"""Registered queries on usage analytics, reports and the primitives they are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logtide.catalogue_labels import _light, _log, light_labels, stored_views, views_of
from logtide.functions import categories as cat
from logtide.functions.columns import LOC, clip, coordinates, haversine_km, rounded, weekday
from logtide.functions.ranks import average_rank, quantiles, sliced_row_number, value_ranks
from logtide.operators import annotate as ann
from logtide.operators import series, volume
from logtide.operators.rollups import LogViews
from logtide.plans import analytics as an
from logtide.plans import reports as rp
from logtide.session import materialise
from logtide.sources.fixtures import events_log, orders_log, table

FIRST, LAST = 1995, 2001
# Real country names for the nations of the test tables, in order of their number.
COUNTRIES = ["China", "Japan", "United States", "Germany", "Brazil", "Australia", "Kenya",
             "Iran", "Canada", "France", "India", "Taiwan", "Egypt", "Spain", "Mexico",
             "Saudi Arabia", "Poland", "Singapore", "Iceland", "Peru", "Italy", "Turkey",
             "South Korea", "Norway", "Atlantis"]


def _n():
    return F.count(F.lit(1))


def named_countries(df: DataFrame) -> DataFrame:
    k = F.regexp_extract("country", "([0-9]+)", 1).cast("int")
    names = F.array(*[F.lit(c) for c in COUNTRIES])
    return df.withColumn("country", F.element_at(names, k + 1))


def _on(run, source=orders_log, digits: int = 6):
    return lambda spark, sf_dir: rounded(run(views_of(spark, sf_dir, source)), digits)


def _users(run):
    """Query over the user-only log."""
    def query(spark, sf_dir):
        v = stored_views(spark, sf_dir)
        return rounded(run(ann.filter_log(v.log, light_labels(v), "user_only")))
    return query


def _labelled(run):
    def query(spark, sf_dir):
        v = stored_views(spark, sf_dir)
        return rounded(run(v.log, light_labels(v)))
    return query


def _citations(spark, sf_dir) -> DataFrame:
    """Datasets with a citation count taken from the part table."""
    datasets = materialise(an.dataset_table(orders_log(spark, sf_dir)), "datasets")
    part = table(spark, sf_dir, "part").select(
        F.expr("concat('PXD', lpad(CAST(p_partkey AS STRING), 6, '0'))").alias("accession"),
        F.pow(F.col("p_size") % 8, F.lit(2.0)).cast("bigint").alias("citation_count"))
    return rounded(an.citation_statistics(datasets.join(part, "accession").select(
        "accession", "total_downloads", "citation_count",
        (F.col("last_download_year") - F.col("first_download_year") + 1 - F.col(
            "unique_countries") % 4).alias("years_active"))))


def _platform(spark, sf_dir):
    log = orders_log(spark, sf_dir)
    part = table(spark, sf_dir, "part").select("p_partkey")
    files = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber")
    return rounded(an.platform_overview(log, FIRST, 100, part, files))


def _growth(log, labels):
    return an.growth(an.yearly_by_category(log, labels, FIRST, LAST))


# ------------------------------------------------------------------ primitives

def _agp01(log):
    return log.groupBy("country").agg(_n().alias("n"), F.countDistinct("usr").alias("users"),
                                      F.countDistinct("accession").alias("projects"),
                                      F.countDistinct(LOC).alias("locations"))


def _agp02(log):
    ftp = F.col("method") == "ftp"
    return log.groupBy("country").agg(
        F.count_if(ftp).alias("ftp"), F.sum(F.when(ftp, F.hour("ts")).otherwise(0)).alias("s"),
        F.avg(F.when(ftp, F.hour("ts"))).alias("mean_hour"))


def _agp03(v: LogViews):
    return v.week.groupBy(LOC, F.year("week").cast("bigint").alias("y")).agg(
        _n().alias("weeks"), F.stddev_samp("n").alias("sd"), F.var_samp("n").alias("var"))


def _agp04(v: LogViews):
    return v.week.groupBy(LOC).agg(F.stddev_pop("n").alias("sd"), F.var_pop("n").alias("var"))


def _agp05(log):
    return log.groupBy(LOC).agg(F.mode("method", True).alias("method"),
                                F.mode(F.hour("ts").cast("bigint"), True).alias("hour"))


def _agp06(v: LogViews):
    """Sorted downloads per user in run-length form: counts in order with their multiplicity.

    A full array would hold every user of a location; the distinct counts are few.
    """
    runs = v.user.groupBy(LOC, "n").agg(_n().alias("c"))
    text = F.transform(F.array_sort(F.collect_list(F.struct("n", "c"))),
                       lambda s: F.concat(s.n.cast("string"), F.lit("x"), s.c.cast("string")))
    return runs.groupBy(LOC).agg(F.array_join(text, ",").alias("sorted_counts"))


def _agp07(v: LogViews):
    q = {"p01": 0.01, "p25": 0.25, "median": 0.5, "p95": 0.95, "p99": 0.99}
    return quantiles(v.day.select(LOC, "n"), "n", q, [LOC])


def _agp08(v: LogViews):
    return v.day.groupBy(LOC).agg(F.skewness("n").alias("skew"), F.kurtosis("n").alias("kurt"))


def _agp09(v: LogViews):
    w = Window.partitionBy(LOC).orderBy("week")
    rows = v.week.withColumn("x", F.row_number().over(w).cast("double"))
    y, x = F.col("n").cast("double"), F.col("x")
    return rows.groupBy(LOC).agg(
        rp._guarded_corr(x, y).alias("corr"), F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"))


def _agp10(log):
    fine = log.groupBy("country", "accession").agg(_n().alias("n"))
    return fine.groupBy("country").agg(F.avg("n").alias("mean"), F.max("n").alias("top"),
                                       _n().alias("projects"))


def _agp12(v: LogViews):
    base = volume.base_stats(v)
    return base.groupBy("country").agg(
        _n().alias("locations"), F.sum("total_downloads").alias("downloads"),
        F.avg("downloads_per_user").alias("dpu"),
        F.count_if(F.col("total_downloads") > 600).alias("large"))


def _agp13(log):
    hours = log.groupBy(LOC, F.hour("ts").cast("bigint").alias("hour")).agg(_n().alias("n"))
    return hours.withColumn("total", F.sum("n").over(Window.partitionBy(LOC)))


def _agp15(log):
    """First three city names of each country in order; only three per country are gathered."""
    w = Window.partitionBy("country").orderBy("city")
    three = log.select("country", "city").filter("city IS NOT NULL").distinct() \
        .withColumn("i", F.row_number().over(w)).filter("i <= 3")
    return three.groupBy("country").agg(
        F.array_join(F.array_sort(F.collect_list("city")), ", ").alias("cities"))


def _us(c: str):
    return F.unix_micros(c)


def _win01(v: LogViews):
    w = Window.partitionBy(LOC)
    return v.day.select(
        LOC, _us("day").alias("day_us"), "n",
        F.row_number().over(w.orderBy("day")).alias("by_day"),
        F.row_number().over(w.orderBy(F.desc("day"))).alias("by_day_desc"),
        F.row_number().over(w.orderBy(F.desc("n"), "day")).alias("by_count"))


def _win02(v: LogViews):
    w = Window.partitionBy(LOC).orderBy("bin")
    gap = (F.col("first_us") - F.lag("last_us").over(w)) / F.lit(1e6)
    return v.half_hour.select(LOC, "bin", "n", gap.alias("gap_seconds"))


def _win03(v: LogViews):
    files = v.file.select(LOC, "filename")
    return sliced_row_number(files, [LOC], F.col("filename"), "alpha_rank")


def _win04(v: LogViews):
    """Running count by weekday: equal weekdays share the value of the last of them."""
    w = Window.partitionBy(LOC).orderBy("wd")
    rows = v.day.withColumn("wd", weekday(F.col("day")))
    return rows.select(LOC, _us("day").alias("day_us"), "wd", F.sum("n").over(w).alias("running"))


def _win05(v: LogViews):
    """Share of each project; the totals are joined, since a location may have any number."""
    totals = v.project.groupBy(LOC).agg(F.sum("n").alias("total"))
    return v.project.join(totals, LOC).select(
        LOC, "accession", (F.col("n") / F.col("total")).alias("share"))


def _win_series(*columns):
    def run(v: LogViews):
        return series.window_series(v).select(LOC, _us("window_start").alias("start_us"),
                                              *columns)
    return run


def _win08(v: LogViews):
    w = Window.partitionBy(LOC).orderBy(F.desc("week"))
    return v.week.withColumn("back", F.row_number().over(w)).filter("back <= 12").select(
        LOC, _us("week").alias("week_us"), "n", F.col("back").cast("bigint").alias("back"))


def _win10(log):
    counts = an.dataset_counts(log)
    t = value_ranks(counts, "downloads")
    return counts.join(t.select("downloads", (average_rank() / F.col("total")).alias("pct_rank")),
                       "downloads").select("accession", "pct_rank")


def _win11(v: LogViews):
    """Runs of consecutive active days above the location's mean."""
    w = Window.partitionBy(LOC)
    high = F.col("n") > F.col("mean")
    rows = v.day.withColumn("mean", F.avg("n").over(w))
    island = F.sum(F.when(high, 0).otherwise(1)).over(w.orderBy("day"))
    runs = rows.withColumn("island", island).filter(high).groupBy(LOC, "island").agg(
        _n().alias("len"))
    return runs.groupBy(LOC, "len").agg(_n().alias("runs"))


def _scf01(log):
    t = F.col("ts")
    return log.select(
        "usr", "filename", _us("ts").alias("us"), F.year(t).alias("y"), F.month(t).alias("mo"),
        F.hour(t).alias("h"), F.second(t).alias("s"),
        F.floor(F.pmod(_us("ts"), F.lit(60_000_000)) / 1000).cast("bigint").alias("ms"),
        weekday(t).alias("wd"), F.unix_micros(F.date_trunc("hour", t)).alias("hour_us"),
        F.unix_micros(F.date_trunc("week", t)).alias("week_us"),
        F.unix_micros(F.date_trunc("month", t)).alias("month_us"),
        F.unix_micros(t - F.expr("INTERVAL 30 DAYS")).alias("before_us"))


def _scf02(log):
    f = F.col("filename")
    lat, lon = coordinates(F.col(LOC))
    return log.select("filename", LOC).distinct().select(
        "filename", LOC, F.lower(f).alias("low"), F.substring(f, 2, 3).alias("part"),
        F.regexp_extract(f, "([0-9]+)", 1).alias("digits"), f.like("%.raw").alias("is_raw"),
        F.endswith(f, F.lit(".gz")).alias("is_gz"), lat.alias("lat"), lon.alias("lon"))


def _scf03(log):
    digits = F.regexp_extract("filename", "([0-9]+)", 1)
    k = digits.try_cast("int")
    return log.select("filename").distinct().select(
        "filename", k.cast("bigint").alias("k"), F.col("filename").try_cast("double").alias("none"), F.coalesce(F.nullif(k % 5, F.lit(0)), F.lit(-1)).cast("bigint")
        .alias("m"), F.greatest(k, F.lit(100)).cast("bigint").alias("g"),
        F.try_divide(k.cast("double"), (k % 3).cast("double")).alias("q"))


def _scf04(v: LogViews):
    x = F.col("total_downloads").cast("double")
    return volume.base_stats(v).select(
        LOC, F.log2(x).alias("log2"), F.log(x).alias("ln"), F.log1p(x).alias("log1p"),
        F.exp(-x / 1000).alias("e"), F.pow(x, F.lit(0.5)).alias("p"), F.sqrt(x).alias("r"),
        F.abs(600 - x).alias("a"), F.round(x / 7, 2).alias("rd"),
        clip(x / 1000, 0.5, 0.7).alias("c"), F.sin(F.radians(x)).alias("s"),
        F.asin(F.lit(1.0) / x).alias("as"))


def _scf05(v: LogViews):
    """Last four weekly counts, padded in front with zeros to six, and their sum."""
    w = Window.partitionBy(LOC).orderBy(F.desc("week"))
    last = v.week.withColumn("b", F.row_number().over(w)).filter("b <= 4").groupBy(LOC).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("b")).alias("b"), "n"))).alias("l"))
    values = F.transform("l", lambda s: s.n)
    padded = F.concat(F.array_repeat(F.lit(0).cast("bigint"), F.lit(6) - F.size("l")), values)
    return last.select(
        LOC, F.array_join(F.transform(padded, lambda x: x.cast("string")), ",").alias("padded"),
        F.aggregate(values, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("s"))


def _scf06(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    back = F.from_json(F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("t"))),
                       "k bigint, t string")
    return ev.select("event_id", back.alias("j")).select("event_id", F.col("j.k").alias("k"),
                                                         F.col("j.t").alias("t"))


def _scf07(v: LogViews):
    lat, lon = coordinates(F.col(LOC))
    base = volume.base_stats(v).select(LOC, lat.alias("lat"), lon.alias("lon"))
    return base.withColumn("km_to_origin", haversine_km(
        F.col("lat"), F.col("lon"), F.lit(0.0), F.lit(0.0)))


def _scf08(log):
    named = named_countries(log)
    c, kind = F.col("country"), cat.file_type(F.col("filename"))
    return named.groupBy(
        c, cat.world_region(c).alias("world_region"), cat.reuse_region(c).alias("reuse_region"),
        kind.alias("kind"), cat.reuse_class(kind).alias("reuse")).agg(_n().alias("n"))


def _top01(labelled):
    parts = (("bots", F.col("is_bot"), "unique_users"),
             ("hubs", F.col("is_hub"), "downloads_per_user"),
             ("users", F.col("final_label") == "user", "total_downloads"))
    out = None
    for name, cond, by in parts:
        part = rp.top_locations(labelled, cond, by, 10).withColumn("list", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def _rpt13_box(t):
    return rp.class_quartiles(t, "downloads_per_user")


def _with_regularity(run):
    """Labelled table with the extra features the profile lists."""
    def query(spark, sf_dir):
        from logtide.functions.columns import left_features
        from logtide.operators import temporal
        v = views_of(spark, sf_dir)
        t = left_features(light_labels(v), temporal.yearly_pattern(v), temporal.YEARLY_DEFAULTS)
        t = left_features(t, temporal.burst_pattern(v), temporal.BURST_DEFAULTS)
        return rounded(run(materialise(t, "profile")))
    return query


KEY = ["unique_users", "downloads_per_user", "total_downloads", "working_hours_ratio",
       "night_activity_ratio", "hourly_entropy", "years_active"]


def report_queries():
    n = an.dataset_counts
    return {
        "agp01_counts_and_distincts": _log(_agp01), "agp02_conditional": _log(_agp02),
        "agp03_sample_deviation": _on(_agp03), "agp04_population_deviation": _on(_agp04),
        "agp05_mode": _log(_agp05), "agp06_sorted_counts": _on(_agp06),
        "agp07_percentiles": _on(_agp07), "agp08_skew_kurtosis": _on(_agp08),
        "agp09_correlation_regression": _on(_agp09), "agp10_two_level": _log(_agp10),
        "agp11_pivot": _log(lambda log: an.protocol_year_pivot(log, FIRST, LAST)),
        "agp12_multi_aggregate": _on(_agp12), "agp13_window_over_aggregate": _log(_agp13),
        "agp15_city_names": _log(_agp15),
        "win01_row_numbers": _on(_win01), "win02_gaps": _on(_win02, events_log),
        "win03_dense_rank": _on(_win03), "win04_running_sum": _on(_win04),
        "win05_share_of_total": _on(_win05),
        "win06_rolling": _on(_win_series("rolling_min", "rolling_max", "rolling_std",
                                         "rolling_median")),
        "win07_pct_change": _on(_win_series("downloads_change", "users_change",
                                            "downloads_per_user_change")),
        "win08_last_n": _on(_win08), "win09_cumulative": _log(
            lambda log: an.cumulative_by_rank(n(log))),
        "win10_percent_rank": _log(_win10), "win11_islands": _on(_win11),
        "top01_location_lists": _light(_top01),
        "top02_class_tables": _light(lambda t: rp.top_locations(
            t, F.col("is_bot"), "total_downloads", 100).withColumn("list", F.lit("bot"))
            .unionByName(rp.top_locations(t, F.col("is_hub"), "total_downloads", 100)
                         .withColumn("list", F.lit("hub")))),
        "top03_datasets": _log(lambda log: an.top_datasets(log, 25)),
        "top04_dataset_years": _log(an.top_detail),
        "top05_bot_share": _light(lambda t: rp.top_bot_share(t, 10, 3)),
        "set01_tagged_union": _labelled(lambda log, lab: an.yearly_union(log, lab, FIRST, LAST)),
        "set02_distinct_keys": _labelled(lambda log, lab: ann.keys_of(lab, "user").unionByName(
            ann.keys_of(lab, "hub")).unionByName(ann.keys_of(lab, "bot")).distinct()),
        "scf01_date_time": _log(_scf01, events_log), "scf02_strings": _log(_scf02),
        "scf03_conversions": _log(_scf03), "scf04_math": _on(_scf04),
        "scf05_arrays": _on(_scf05), "scf06_json": _scf06, "scf07_geo": _on(_scf07),
        "scf08_categories": _log(_scf08),
        "anl01_by_country": _users(an.by_country),
        "anl02_by_world_region": _log(lambda log: an.by_world_region(
            an.by_country(named_countries(log)))),
        "anl03_yearly": _users(lambda log: an.yearly(log, 1996, 2000)),
        "anl04_monthly": _users(lambda log: an.monthly(log, 1996, 2000)),
        "anl05_yearly_by_category": _labelled(
            lambda log, lab: an.yearly_by_category(log, lab, FIRST, LAST)),
        "anl06_growth": _labelled(_growth),
        "anl07_protocol_by_year": _labelled(lambda log, lab: an.protocol_by_year(
            ann.filter_log(log, lab, "no_bots"), 1996)),
        "anl07_protocol_by_month": _labelled(lambda log, lab: an.protocol_by_month(
            ann.filter_log(log, lab, "no_bots"), 2000)),
        "anl07_protocol_overall": _users(lambda log: an.protocol_overall(log, 1996)),
        "anl08_top_datasets": _users(an.top_datasets),
        "anl09_top_datasets_hub": _labelled(lambda log, lab: an.top_datasets(
            ann.filter_log(log, lab, "hub_only"))),
        "anl10_gini": _users(lambda log: an.concentration(n(log)).select("gini_coefficient")),
        "anl11_lorenz": _users(lambda log: an.lorenz(n(log))),
        "anl12_concentration": _users(lambda log: an.concentration(n(log)).drop(
            "gini_coefficient")),
        "anl13_rank_frequency": _users(lambda log: an.rank_frequency(n(log))),
        "anl14_heatmap": _users(lambda log: an.heatmap(log, 1996)),
        "anl15_country_bubble": _users(an.country_bubble),
        "anl15_country_bubble_hub": _labelled(lambda log, lab: an.country_bubble(
            ann.filter_log(log, lab, "hub_only"))),
        "anl15_country_bubble_top": _users(lambda log: an.country_bubble_top(log, 500, 50)),
        "anl16_filetype_by_region": _log(lambda log: an.filetype_by_region(
            named_countries(log))),
        "anl17_reuse_share": _log(lambda log: an.reuse_share(an.filetype_by_region(
            named_countries(log)))),
        "anl18_dataset_overview": _log(an.dataset_overview),
        "anl18_protocol_histogram": _log(an.protocol_histogram),
        "anl19_platform_overview": _platform,
        "anl20_consistency": _users(lambda log: an.consistency(log, FIRST, 7)),
        "anl21_consistency_heatmap": _users(
            lambda log: an.consistency_heatmap(log, FIRST, LAST)),
        "anl22_downloads_per_file": _users(an.downloads_per_file),
        "anl23_country_trend": _users(lambda log: an.country_trend(
            log, ["NATION_1", "NATION_3", "NATION_5", "NATION_8"], 1996)),
        "anl24_before_after": _labelled(lambda log, lab: an.before_after(log, lab).select(
            "country", *[F.col(c).cast("double").alias(c)
                         for c in ("raw_downloads", "clean_downloads")])),
        "anl25_hub_points": _light(an.hub_points),
        "anl25_hub_countries": _light(an.hub_countries),
        "anl26_classes_by_country": _light(lambda t: an.classes_by_country(t, 5)),
        "anl27_citations": _citations,
        "rpt01_run_totals": _light(rp.run_totals),
        "rpt02_classification_counts": _light(rp.classification_counts),
        "rpt03_hierarchy_counts": _light(rp.hierarchy_counts),
        "rpt04_feature_profile": _with_regularity(rp.feature_profile),
        "rpt05_temporal_metrics": _with_regularity(rp.temporal_metrics),
        "rpt06_geographic_metrics": _light(lambda t: rp.geographic_metrics(t, 10, 3)),
        "rpt07_download_metrics": _light(rp.download_metrics),
        "rpt08_bot_correlation": _with_regularity(rp.bot_correlation),
        "rpt09_correlation_matrix": _light(lambda t: rp.correlation_matrix(t, KEY)),
        "rpt10_city_rollup": _light(lambda t: rp.city_rollup(t, 600)),
        "rpt11_consolidated_hubs": _light(rp.consolidated_hubs),
        "rpt12_listings": _light(lambda t: rp.listing(t, "bot", "unique_users").withColumn(
            "list", F.lit("bot")).unionByName(rp.listing(t, "hub", "downloads_per_user")
                                              .withColumn("list", F.lit("hub")))),
        "rpt13_histogram": _light(lambda t: rp.class_histogram(t, "downloads_per_user")),
        "rpt13_quartiles": _light(_rpt13_box),
        "rpt14_class_countries": _light(lambda t: rp.class_downloads_by_country(t, 30)),
        "rpt15_prediction_summary": _light(rp.prediction_summary),
    }
