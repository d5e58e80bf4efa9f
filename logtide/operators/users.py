"""How downloads spread over the users of a location."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.functions.columns import LOC, d, positive
from logtide.functions.ranks import value_ranks
from logtide.operators.rollups import LogViews

USER_DISTRIBUTION_DEFAULTS = {"user_entropy": 0.0, "user_gini_coefficient": 0.5,
                              "single_download_user_ratio": 0.5, "power_user_ratio": 0.5}


def user_distribution(views: LogViews) -> DataFrame:
    """Entropy, Gini, share of one-time users and of the top tenth of users.

    Users with the same count are handled as one block, so nothing is ranked user by user: the
    table of distinct counts per location is all that is ordered.
    """
    blocks = value_ranks(views.user, "n", [LOC])
    sums = blocks.groupBy(LOC).agg(F.sum(F.col("cnt") * F.col("n")).alias("s"))
    x, m, below = d("n"), d("cnt"), d("below")
    users, s = d("total"), d("s")
    above = users - below - m
    top = F.greatest(F.floor(users / 10), F.lit(1)).cast("double")
    taken = F.least(F.greatest(top - above, F.lit(0.0)), m)
    p = x / s
    return blocks.join(sums, LOC).groupBy(LOC).agg(
        (-F.sum(m * p * F.log2(p + 1e-10))).alias("user_entropy"),
        F.when(F.first(users) < 2, 0.5).otherwise(
            2 * F.sum(x * (m * below + m * (m + 1) / 2)) / (F.first(users) * F.first(s))
            - (F.first(users) + 1) / F.first(users)).alias("user_gini_coefficient"),
        (F.sum(F.when(x == 1, m).otherwise(0.0)) / F.first(users))
        .alias("single_download_user_ratio"),
        (F.sum(x * taken) / F.first(s)).alias("power_user_ratio"))


AUTHENTICITY_DEFAULTS = {"user_homogeneity_score": 0.0, "bot_farm_score": 0.0,
                         "user_authenticity_score": 1.0}


def user_authenticity(views: LogViews, farm_users: int = 100,
                      farm_homogeneity: float = 2.0) -> DataFrame:
    """Evenness of the users' counts and their mean days and files, over events with a file.

    Means over users need only the number of distinct (user, day) and (user, file) pairs, each
    counted by itself: no aggregation carries several distinct counts.
    """
    views = views.stored(LOC, "usr", "filename", "ts", "year")
    users = views.user.filter("n_file > 0").groupBy(LOC).agg(
        F.count(F.lit(1)).alias("users"), F.avg("n_file").alias("mean"),
        F.stddev_samp("n_file").alias("sd"))
    stats = users.join(views.user_days, LOC, "left").join(views.user_files, LOC, "left").withColumns({
        "avg_active_days_per_user": F.coalesce("days", F.lit(0)) / F.col("users"),
        "avg_files_per_user": F.col("files") / F.col("users")})
    homogeneity = positive(F.col("sd"), F.col("mean") / F.col("sd"), 0)
    users, h = F.col("users"), F.col("user_homogeneity_score")
    return stats.withColumn("user_homogeneity_score", homogeneity).select(
        LOC, "user_homogeneity_score", "avg_active_days_per_user", "avg_files_per_user",
        F.when((users > farm_users) & (h > farm_homogeneity), h * F.log(users + 1))
        .otherwise(0.0).alias("bot_farm_score"),
        (F.col("avg_active_days_per_user") * F.col("avg_files_per_user"))
        .alias("user_authenticity_score"))
