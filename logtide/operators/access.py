"""Which files a location fetches and in which order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logtide.functions.columns import LOC, d, positive, ratio
from logtide.functions.ranks import sliced_row_number
from logtide.operators.rollups import LogViews

FILE_ACCESS_DEFAULTS = {"file_entropy": 0.0, "file_exploration_score": 0.0,
                        "file_mirroring_score": 1.0}


def file_access(views: LogViews, entropy: str = "shannon") -> DataFrame:
    """Diversity of accessed files.

    ``compat`` keeps log2(rows / files) over a table that already has one row per file, which
    is 0 everywhere; ``shannon`` is the entropy of the download shares.
    """
    if entropy not in ("shannon", "compat"):
        raise ValueError("entropy must be 'shannon' or 'compat'")
    n = d("n")
    s = views.file.groupBy(LOC).agg(
        F.count(F.lit(1)).alias("unique_files"), F.avg("users").alias("avg_users_per_file"),
        F.sum(n).alias("t"), F.sum(n * F.log2(n)).alias("nlogn"))
    # -sum(p log p) = log(t) - sum(n log n) / t
    shannon = F.greatest(F.log2("t") - F.col("nlogn") / F.col("t"), F.lit(0.0))
    h = F.col("file_entropy")
    files = F.col("unique_files")
    return s.withColumn("file_entropy", shannon if entropy == "shannon" else F.lit(0.0)).select(
        LOC, files, h, "avg_users_per_file",
        F.when(files > 10, h * F.log(files + 1)).otherwise(0.0).alias("file_exploration_score"),
        positive(h, 1 / (h + 0.1), 10).alias("file_mirroring_score"))


VERSION_DEFAULTS = {"unique_versions": 0, "version_concentration": 0.5, "targets_latest_only": 0}


def version_targeting(views: LogViews) -> DataFrame:
    version = F.regexp_extract("filename", r"[0-9]+\.[0-9]+\.[0-9]+", 0)
    s = (views.file.select(LOC, version.alias("version")).filter("version <> ''")
         .groupBy(LOC).agg(F.countDistinct("version").alias("unique_versions")))
    concentration = 1.0 / F.col("unique_versions")
    return s.select(LOC, "unique_versions", concentration.alias("version_concentration"),
                    F.when(concentration > 0.5, 1).otherwise(0).cast("bigint")
                    .alias("targets_latest_only"))


REPEAT_DEFAULTS = {"retry_ratio": 0.0, "unique_file_ratio": 1.0}


def _with_file(views: LogViews) -> DataFrame:
    return views.valid.filter(F.col("filename").isNotNull())


def repeat_access(views: LogViews) -> DataFrame:
    files = _with_file(views).groupBy(LOC, "filename").agg(F.count(F.lit(1)).alias("n"))
    return files.groupBy(LOC).agg(
        ratio(F.count_if(F.col("n") > 1), F.count(F.lit(1))).alias("retry_ratio"),
        ratio(F.count(F.lit(1)), F.sum("n")).alias("unique_file_ratio"))


_ORDER = ("ts", "accession", "filename", "usr")


def _sliced_access(views: LogViews) -> DataFrame:
    """Events with a file, ordered inside (location, hour).

    The hour keeps the access order and cuts a hot location into thousands of windows.
    """
    w = Window.partitionBy(LOC, "hour").orderBy(*_ORDER)
    number = F.regexp_extract("filename", "([0-9]+)", 1)
    return (_with_file(views)
            .select(LOC, F.date_trunc("hour", "ts").alias("hour"), *_ORDER,
                    (number != "").alias("numbered"), number.try_cast("int").alias("num"))
            .withColumn("r", F.row_number().over(w))
            .withColumn("next_num", F.lead("num").over(w))
            .withColumn("has_next", F.lead(F.lit(True)).over(w)))


SEQUENTIAL_DEFAULTS = {"sequential_file_ratio": 0.0}


def sequential_access(views: LogViews) -> DataFrame:
    """Share of numbered events whose successor's file number differs by one.

    Pairs inside an hour are counted there; the one pair that crosses to the next active hour
    comes from the first and last event of each hour.
    """
    ev = _sliced_access(views)
    edge = F.struct(*_ORDER, "numbered", "num")
    pair = F.col("numbered") & F.col("has_next").isNotNull()
    step = F.abs(F.col("num") - F.col("next_num")) == 1
    hours = ev.groupBy(LOC, "hour").agg(
        F.count_if(pair).alias("pairs"), F.count_if(pair & step).alias("steps"),
        F.min(edge).alias("first"), F.max(edge).alias("last"))
    following = F.lead("first").over(Window.partitionBy(LOC).orderBy("hour"))
    crossing = F.col("last.numbered") & F.col("next").isNotNull()
    cross_step = F.abs(F.col("last.num") - F.col("next.num")) == 1
    return hours.withColumn("next", following).groupBy(LOC).agg(
        ratio(F.sum("steps") + F.count_if(crossing & cross_step),
              F.sum("pairs") + F.count_if(crossing), 0).alias("sequential_file_ratio"))


ALPHABETICAL_DEFAULTS = {"alphabetical_access_score": 0.0, "directory_traversal_score": 0.0}


def alphabetical_access(views: LogViews) -> DataFrame:
    """Correlation of access order with alphabetical file rank (times (n-1)/n), and its product
    with the share of distinct files.

    Access positions are summed per (location, hour, file) before the hour offsets are added, and
    per (location, file) before the alphabetical rank is attached, so neither rank ever orders a
    whole location in one task.
    """
    per_hour = _sliced_access(views).groupBy(LOC, "hour", "filename").agg(
        F.sum("r").alias("pos"), F.count(F.lit(1)).alias("c"))
    sizes = _with_file(views).groupBy(LOC, F.date_trunc("hour", "ts").alias("hour")) \
        .agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy(LOC).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(LOC, "hour", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("off"))
    files = per_hour.join(offsets, [LOC, "hour"]).groupBy(LOC, "filename").agg(
        F.sum(d("pos") + d("c") * F.col("off")).alias("pos"), F.sum("c").alias("c"))
    ranked = sliced_row_number(files, [LOC], F.col("filename"), "rank")
    c, b = d("c"), d("rank")
    s = ranked.groupBy(LOC).agg(
        F.sum(c).alias("n"), F.count(F.lit(1)).alias("files"),
        F.sum(d("pos") * b).alias("ab"), F.sum(c * b).alias("sb"), F.sum(c * b * b).alias("sbb"))
    n = F.col("n")
    mean_b = F.col("sb") / n
    sd_a = F.sqrt(n * (n + 1) / 12)
    sd_b = F.sqrt(F.greatest(F.try_divide(F.col("sbb") - n * mean_b * mean_b, n - 1), F.lit(0.0)))
    score = F.when((n > 1) & (sd_b > 0),
                   (F.col("ab") / n - (n + 1) / 2 * mean_b) / (sd_a * sd_b)).otherwise(0.0)
    return s.select(LOC, score.alias("alphabetical_access_score"),
                    (score * F.col("files") / n).alias("directory_traversal_score"))
