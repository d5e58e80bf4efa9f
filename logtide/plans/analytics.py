"""Usage analytics over a (possibly label-filtered) log. Each function gives one report table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.functions.categories import file_type, reuse_class, reuse_region, world_region
from logtide.functions.columns import LOC, coordinates, hour_of, ratio, weekday
from logtide.functions.ranks import average_rank, sliced_row_number, value_ranks
from logtide.operators.annotate import filter_log
from logtide.sources.log import well_formed_country

def _n() -> Column:
    return F.count(F.lit(1))


def years_between(log: DataFrame, first: int | None, last: int | None) -> DataFrame:
    if first is not None:
        log = log.filter(F.col("year") >= first)
    return log if last is None else log.filter(F.col("year") <= last)


def by_country(log: DataFrame) -> DataFrame:
    return log.filter(well_formed_country()).groupBy("country").agg(
        _n().alias("total_downloads"), F.countDistinct("accession").alias("unique_datasets"),
        F.countDistinct(LOC).alias("unique_locations"), F.min("year").alias("first_year"),
        F.max("year").alias("last_year"))


def by_world_region(countries: DataFrame, region: Column | None = None) -> DataFrame:
    """Sums of country rows; a dataset used in two countries counts twice."""
    region = world_region(F.col("country")) if region is None else region
    return countries.groupBy(region.alias("world_region")).agg(
        F.sum("total_downloads").alias("total_downloads"),
        F.sum("unique_datasets").alias("unique_datasets"),
        F.sum("unique_locations").alias("unique_locations"), _n().alias("num_countries"))


def yearly(log: DataFrame, first: int = 2021, last: int = 2025) -> DataFrame:
    return years_between(log, first, last).groupBy("year").agg(
        _n().alias("total_downloads"), F.countDistinct("accession").alias("unique_datasets"),
        F.countDistinct(LOC).alias("unique_locations"))


def monthly(log: DataFrame, first: int = 2021, last: int = 2025) -> DataFrame:
    return years_between(log, first, last).groupBy(
        "year", F.month("ts").cast("bigint").alias("month")).agg(_n().alias("total_downloads"))


def yearly_by_category(log: DataFrame, labels: DataFrame, first: int = 2021,
                       last: int = 2025) -> DataFrame:
    """One pass: the category comes from the label join, not from three filtered scans."""
    category = F.when(F.col("is_bot"), "bot").when(F.col("is_hub"), "hub").otherwise("user")
    tagged = labels.select(LOC, category.alias("category")).distinct()
    counts = years_between(log, first, last).groupBy(LOC, "year").agg(_n().alias("n"))
    return counts.join(tagged, LOC).groupBy("year", "category").agg(
        F.sum("n").alias("total_downloads"))


def yearly_union(log: DataFrame, labels: DataFrame, first: int, last: int) -> DataFrame:
    """The same table as a union of per-category counts."""
    parts = [yearly(filter_log(log, labels, f"{kind}_only"), first, last)
             .select("year", F.lit(kind).alias("category"), "total_downloads")
             for kind in ("user", "hub", "bot")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def growth(by_category: DataFrame, category: str = "user") -> DataFrame:
    """Percent change to the previous year of one category (a handful of yearly rows)."""
    w = Window.partitionBy("category").orderBy("year")
    before = F.lag("total_downloads").over(w)
    return by_category.filter(F.col("category") == category).select(
        "year", F.when(before > 0, (F.col("total_downloads") - before) / before * 100)
        .alias("growth_pct"))


def protocol_by_year(log: DataFrame, first: int = 2021) -> DataFrame:
    return years_between(log, first, None).groupBy(
        F.col("method").alias("protocol"), "year").agg(_n().alias("downloads"))


def protocol_by_month(log: DataFrame, year: int) -> DataFrame:
    return log.filter(F.col("year") == year).groupBy(
        F.col("method").alias("protocol"), F.month("ts").cast("bigint").alias("month")) \
        .agg(_n().alias("downloads"))


def protocol_overall(log: DataFrame, first: int = 2021) -> DataFrame:
    """Few protocol rows, so the total over them is one small window."""
    out = years_between(log, first, None).groupBy(F.col("method").alias("protocol")) \
        .agg(_n().alias("downloads"))
    total = out.agg(F.sum("downloads")).scalar()
    return out.withColumn("pct", F.col("downloads") / total * 100)


def protocol_year_pivot(log: DataFrame, first: int, last: int) -> DataFrame:
    """Years as columns, missing combinations 0; the year list is given, not collected."""
    years = list(range(first, last + 1))
    wide = years_between(log, first, last).groupBy(F.col("method").alias("protocol")) \
        .pivot("year", years).count()
    return wide.select("protocol", *[
        F.coalesce(F.col(str(y)), F.lit(0)).alias(f"y{y}") for y in years])


def dataset_table(log: DataFrame) -> DataFrame:
    """Downloads, places and years of every dataset, without order or limit."""
    return log.filter(F.col("accession").isNotNull()).groupBy("accession").agg(
        _n().alias("total_downloads"), F.countDistinct(LOC).alias("unique_locations"),
        F.countDistinct("country").alias("unique_countries"),
        F.min("year").alias("first_download_year"), F.max("year").alias("last_download_year"))


def top_datasets(log: DataFrame, k: int = 100) -> DataFrame:
    """The k most downloaded datasets; places are only counted for those."""
    top = dataset_counts(log).orderBy(F.desc("downloads"), "accession").limit(k)
    rows = log.join(top.select("accession"), "accession", "left_semi")
    return dataset_table(rows).orderBy(F.desc("total_downloads"), "accession")


def dataset_counts(log: DataFrame) -> DataFrame:
    return log.filter(F.col("accession").isNotNull()).groupBy("accession") \
        .agg(_n().alias("downloads"))


def top_detail(log: DataFrame, k: int = 25) -> DataFrame:
    """Yearly counts of the k most downloaded datasets."""
    top = dataset_counts(log).orderBy(F.desc("downloads"), "accession").limit(k)
    return log.join(top.select("accession"), "accession", "left_semi") \
        .groupBy("accession", "year").agg(_n().alias("downloads"))


def concentration(counts: DataFrame) -> DataFrame:
    """Gini, top shares, mean, median and maximum of downloads per dataset.

    All of it follows from the table of distinct counts; datasets are never ranked one by one.
    """
    t = value_ranks(counts, "downloads")
    x, m, below = (F.col(c).cast("double") for c in ("downloads", "cnt", "below"))
    total = F.col("total")
    above = total - F.col("below") - F.col("cnt")
    n = F.first("total").cast("double")
    s = F.sum(x * m)

    def top(k: Column) -> Column:
        taken = F.least(F.greatest(k - above, F.lit(0)), F.col("cnt"))
        return F.sum(x * taken) / s * 100

    def at(pos: Column) -> Column:
        return F.max(F.when((F.col("below") <= pos) & (pos < F.col("below") + F.col("cnt")), x))
    one = F.lit(1)
    mid = (at(F.floor((total - 1) / 2)) + at(F.ceil((total - 1) / 2))) / 2
    return t.agg(
        F.first("total").cast("bigint").alias("total_datasets"),
        F.sum(F.col("downloads") * F.col("cnt")).cast("bigint").alias("total_downloads"),
        (2 * F.sum(x * (m * below + m * (m + 1) / 2)) / (n * s) - (n + 1) / n)
        .alias("gini_coefficient"),
        top(F.greatest(F.floor(total / 100), one)).alias("top_1pct_downloads_pct"),
        top(F.greatest(F.floor(total / 10), one)).alias("top_10pct_downloads_pct"),
        top(F.floor(total / 2)).alias("top_50pct_downloads_pct"),
        F.floor(mid).cast("bigint").alias("median_downloads"),
        (s / n).alias("mean_downloads"), F.max("downloads").alias("max_downloads"))


def lorenz(counts: DataFrame, points: int = 101) -> DataFrame:
    """Lorenz curve at evenly spaced population shares, linearly interpolated.

    The curve is linear inside a block of equal counts, so each point needs only the block it
    falls in: points are joined to blocks by the ranks a block covers.
    """
    t = value_ranks(counts, "downloads")
    w = Window.partitionBy(F.lit(0)).orderBy("downloads")
    x, m = F.col("downloads"), F.col("cnt")
    cum = F.sum(x * m).over(w) - x * m
    blocks = t.withColumns({"before": cum,
                            "s": F.sum(x * m).over(Window.partitionBy(F.lit(0)))})
    steps = points - 1
    # The points whose position i * n / steps lies in (below, below + cnt].
    low = F.floor(F.col("below") * steps / F.col("total")) + 1
    high = F.floor((F.col("below") + m) * steps / F.col("total"))
    inner = blocks.withColumn("i", F.explode(F.when(high >= low, F.sequence(low, high))))
    pos = F.col("i") * F.col("total") / F.lit(float(steps))
    share = (F.col("before") + x * (pos - F.col("below"))) / F.col("s")
    rows = inner.select((F.col("i") / F.lit(float(steps))).alias("population_fraction"),
                        share.alias("download_fraction"))
    start = counts.agg(_n()).select(F.lit(0.0).alias("population_fraction"),
                                    F.lit(0.0).alias("download_fraction"))
    return start.unionByName(rows)


def rank_frequency(counts: DataFrame) -> DataFrame:
    """Datasets numbered by descending downloads (ties by accession)."""
    key = F.struct((-F.col("downloads")).alias("d"), F.col("accession"))
    return sliced_row_number(counts, [], key, "rank")


def cumulative_by_rank(counts: DataFrame) -> DataFrame:
    """Ascending table of distinct counts with datasets and downloads up to and including it."""
    t = value_ranks(counts, "downloads")
    upto = F.sum(F.col("downloads") * F.col("cnt")).over(
        Window.partitionBy(F.lit(0)).orderBy("downloads"))
    return t.select("downloads", F.col("cnt").alias("datasets"),
                    (F.col("below") + F.col("cnt")).alias("datasets_upto"),
                    upto.cast("bigint").alias("downloads_upto"))


def heatmap(log: DataFrame, first: int = 2021) -> DataFrame:
    """Downloads per hour and weekday (0 = Sunday); an unknown time counts as hour 12."""
    hour = F.coalesce(hour_of(F.col("ts")), F.lit(12).cast("bigint"))
    out = years_between(log, first, None).groupBy(
        hour.alias("hour"), weekday(F.col("ts")).alias("day_of_week")) \
        .agg(_n().alias("downloads"))
    most = out.agg(F.max("downloads")).scalar()
    return out.withColumn("norm", F.col("downloads") / most)


def country_bubble(log: DataFrame, least: int = 100) -> DataFrame:
    return log.filter(well_formed_country()).groupBy("country").agg(
        _n().alias("total_downloads"), F.countDistinct("usr").alias("unique_users")) \
        .filter(F.col("total_downloads") >= least) \
        .withColumn("dl_per_user", ratio(F.col("total_downloads"), F.col("unique_users")))


def country_bubble_top(log: DataFrame, above: int = 10000, k: int = 50) -> DataFrame:
    out = log.filter(well_formed_country()).groupBy("country").agg(
        _n().alias("total_downloads"), F.countDistinct("usr").alias("unique_users"),
        F.countDistinct("accession").alias("unique_datasets"))
    return (out.filter(F.col("total_downloads") > above)
            .withColumn("dl_per_user", F.col("total_downloads")
                        / F.greatest("unique_users", F.lit(1)))
            .orderBy(F.desc("total_downloads"), "country").limit(k))


def filetype_by_region(log: DataFrame, region: Column | None = None) -> DataFrame:
    region = reuse_region(F.col("country")) if region is None else region
    return log.filter(well_formed_country() & F.col("filename").isNotNull()).groupBy(
        region.alias("reuse_region"), file_type(F.col("filename")).alias("file_category")) \
        .agg(_n().alias("downloads"))


def reuse_share(filetypes: DataFrame) -> DataFrame:
    agg = filetypes.groupBy("reuse_region", reuse_class(F.col("file_category")).alias("agg_type")) \
        .agg(F.sum("downloads").alias("downloads"))
    total = F.sum("downloads").over(Window.partitionBy("reuse_region"))
    return agg.withColumn("pct", F.col("downloads") / total * 100)


def dataset_overview(log: DataFrame) -> DataFrame:
    """Counts, time range and distincts in one row."""
    return log.agg(
        _n().alias("total_records"), F.unix_micros(F.min("ts")).alias("start_us"),
        F.unix_micros(F.max("ts")).alias("end_us"),
        F.countDistinct("country").alias("n_countries"),
        F.countDistinct(LOC).alias("n_unique_locations"),
        F.countDistinct("accession").alias("n_projects"))


def protocol_histogram(log: DataFrame) -> DataFrame:
    return log.filter(F.col("method").isNotNull()).groupBy("method").agg(_n().alias("downloads"))


def platform_overview(log: DataFrame, first: int = 2021, least_country: int = 100,
                      projects: DataFrame | None = None,
                      files: DataFrame | None = None) -> DataFrame:
    """Totals, reuse intensity and, given metadata tables, coverage in percent."""
    recent = years_between(log, first, None)
    n = F.col("total_downloads")
    countries = recent.filter(well_formed_country()).groupBy("country").count() \
        .filter(F.col("count") > least_country).agg(_n()).scalar()
    out = recent.agg(
        _n().alias("total_downloads"), F.countDistinct("accession").alias("unique_projects"),
        F.countDistinct("filename").alias("unique_files"),
        F.countDistinct("usr").alias("unique_users"),
        F.min("year").alias("min_year"), F.max("year").alias("max_year")).withColumns({
            "dl_per_project": n / F.greatest("unique_projects", F.lit(1)),
            "dl_per_file": n / F.greatest("unique_files", F.lit(1)),
            "dl_per_user": n / F.greatest("unique_users", F.lit(1)),
            "n_countries": countries})
    for name, table, column in (("project_coverage", projects, "unique_projects"),
                                ("file_coverage", files, "unique_files")):
        if table is not None:
            total = table.distinct().agg(_n()).scalar()
            out = out.withColumn(name, ratio(F.col(column) * 100, total, 0))
    return out


def consistency(log: DataFrame, first: int = 2021, years: int = 5, least_years: int = 3,
                k: int | None = 20) -> DataFrame:
    """(1 - min(cv, 1)) x active years / years per dataset."""
    per_year = years_between(log, first, None).filter(F.col("accession").isNotNull()) \
        .groupBy("accession", "year").agg(_n().alias("n"))
    s = per_year.groupBy("accession").agg(
        _n().alias("m"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"),
        F.sum("n").alias("total")).filter(F.col("m") >= least_years)
    cv = F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")).otherwise(1.0)
    out = s.select("accession", ((1 - F.least(cv, F.lit(1.0))) * F.col("m") / float(years))
                   .alias("consistency"), "total")
    # Rounded so that the order does not hang on the last bit.
    out = out.withColumn("consistency", F.round("consistency", 9))
    return out if k is None else out.orderBy(F.desc("consistency"), F.desc("total"),
                                             "accession").limit(k)


def consistency_heatmap(log: DataFrame, first: int, last: int, k: int = 25) -> DataFrame:
    """log10(n + 1) per year of the top datasets and their number of active years."""
    years = list(range(first, last + 1))
    wide = top_detail(log, k).groupBy("accession").pivot("year", years).sum("downloads")
    value = {y: F.coalesce(F.col(str(y)), F.lit(0)) for y in years}
    active = sum((F.when(v > 0, 1).otherwise(0) for v in value.values()), F.lit(0))
    return wide.select("accession", *[F.log10(v + 1).alias(f"y{y}") for y, v in value.items()],
                       active.cast("bigint").alias("active_years"))


def downloads_per_file(log: DataFrame, bins: int = 100) -> DataFrame:
    """Histogram over log-spaced bins between 1 and the largest count (last edge included)."""
    counts = log.filter(F.col("filename").isNotNull()).groupBy("filename") \
        .agg(_n().alias("n")).groupBy("n").agg(_n().alias("files"))
    top = counts.agg(F.max("n")).scalar()
    edges = bins - 1
    pos = F.when(top > 1, F.floor(F.log10("n") / F.log10(top) * edges + 1e-9)).otherwise(0)
    return counts.groupBy(F.least(pos, F.lit(edges - 1)).cast("bigint").alias("bin")) \
        .agg(F.sum("files").alias("files"))


def country_trend(log: DataFrame, countries: list[str], first: int = 2021) -> DataFrame:
    """Yearly downloads of listed countries and their share within the year."""
    out = years_between(log, first, None).filter(F.col("country").isin(*countries)) \
        .groupBy("country", "year").agg(_n().alias("downloads"))
    total = F.sum("downloads").over(Window.partitionBy("year"))
    return out.withColumn("pct", F.col("downloads") / total * 100)


def before_after(log: DataFrame, labels: DataFrame, k: int = 15) -> DataFrame:
    """Top countries of the raw and of the user-only log, side by side."""
    def top(events: DataFrame, name: str) -> DataFrame:
        return events.filter(well_formed_country()).groupBy("country").agg(_n().alias(name)) \
            .orderBy(F.desc(name), "country").limit(k)
    return top(log, "raw_downloads").join(
        top(filter_log(log, labels, "user_only"), "clean_downloads"), "country", "full")


def hub_points(labelled: DataFrame) -> DataFrame:
    lat, lon = coordinates(F.col(LOC))
    return labelled.filter("is_hub").select(LOC, lat.alias("lat"), lon.alias("lon"),
                                            "total_downloads")


def hub_countries(labelled: DataFrame, k: int = 15) -> DataFrame:
    return labelled.filter("is_hub").groupBy("country").agg(
        _n().alias("hubs"), F.sum("total_downloads").alias("downloads")) \
        .orderBy(F.desc("hubs"), "country").limit(k)


def classes_by_country(labelled: DataFrame, k: int | None = None) -> DataFrame:
    """Locations and downloads per class of each country."""
    label, n = F.col("final_label"), F.col("total_downloads")
    aggs = [_n().alias("locations"), F.sum(n).alias("total_downloads")]
    for c in ("bot", "hub", "user"):
        aggs += [F.count_if(label == c).alias(f"{c}_locations"),
                 F.sum(F.when(label == c, n).otherwise(0)).alias(f"{c}_downloads")]
    out = labelled.filter(F.col("country").isNotNull()).groupBy("country").agg(*aggs)
    return out if k is None else out.orderBy(F.desc("total_downloads"), "country").limit(k)


def _ranked(df: DataFrame, column: str, out: str) -> DataFrame:
    table = value_ranks(df.select(column), column).select(column, average_rank().alias(out))
    return df.join(table, column)


# Fixed edges of the citation bins (left closed).
CITATION_BINS = (("0", 0, 1), ("1-4", 1, 5), ("5-19", 5, 20), ("20-49", 20, 50),
                 ("50+", 50, 1000))


def citation_statistics(datasets: DataFrame, max_years: int = 5) -> DataFrame:
    """Citations against downloads, one row: Spearman, log-log slope, Kruskal-Wallis H.

    ``datasets``: accession, total_downloads, years_active, citation_count (raw mentions).
    """
    base = datasets.select(
        "accession", "total_downloads",
        F.greatest(F.col("citation_count") - 1, F.lit(0)).alias("c"),
        (F.least("years_active", F.lit(max_years)) / float(max_years)).alias("consistency"))
    cited = base.filter("c > 0")
    r = _ranked(_ranked(cited, "c", "rc"), "total_downloads", "rd")
    lx, ly = F.log10("c"), F.log10("total_downloads")

    def guarded(num: Column, den: Column) -> Column:
        return F.when(den > 0, num / den)
    rho = guarded(F.covar_pop("rc", "rd"), F.stddev_pop("rc") * F.stddev_pop("rd"))
    left = r.agg(_n().alias("n_cited"), rho.alias("spearman"),
                 guarded(F.covar_pop(lx, ly), F.var_pop(lx)).alias("log_slope"))
    label = None
    for name, low, high in CITATION_BINS:
        cond = (F.col("c") >= low) & (F.col("c") < high)
        label = F.when(cond, name) if label is None else label.when(cond, name)
    binned = base.withColumn("bin", label).filter("bin IS NOT NULL")
    # The test leaves out bins with a single dataset.
    big = binned.groupBy("bin").agg(_n().alias("k")).filter("k > 1")
    used = binned.join(big.select("bin"), "bin", "left_semi").withColumn(
        "cs", F.round(F.col("consistency") * max_years, 6))
    groups = _ranked(used, "cs", "rk").groupBy("bin").agg(
        F.sum("rk").alias("s"), _n().alias("k"))
    ties = used.groupBy("cs").agg(_n().cast("double").alias("t")).agg(
        F.sum(F.pow("t", F.lit(3.0)) - F.col("t"))).scalar()
    n = F.sum("k").cast("double")
    h = 12 / (n * (n + 1)) * F.sum(F.col("s") * F.col("s") / F.col("k")) - 3 * (n + 1)
    right = groups.agg(h.alias("h"), n.alias("n")).select(
        F.struct("h", "n").alias("kw")).scalar()
    kw = F.col("kw")
    correction = 1 - F.try_divide(ties, F.pow(kw["n"], F.lit(3.0)) - kw["n"])
    return left.withColumn("kw", right).select(
        "n_cited", "spearman", "log_slope",
        F.when(correction > 0, kw["h"] / correction).alias("kruskal_h"))
