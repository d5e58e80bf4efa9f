"""Scores that compare a location with all others or combine other features.

All of these work on the location table. Global statistics enter as scalar subqueries; exact
quantiles come from bracketed counts, so no task gathers the whole table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.functions.columns import EPS, LOC, clip, d, flag
from logtide.functions.ranks import average_rank, quantiles, value_ranks


def global_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> dict[str, Column]:
    """Scalar subquery Columns for {alias: (column, p)}.

    All columns go through one pass in long form, keyed by column name.
    """
    columns = sorted({c for c, _ in wanted.values()})
    probs = sorted({p for _, p in wanted.values()})
    named = {f"p{i}": p for i, p in enumerate(probs)}
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value"))
        for c in columns])).alias("x")).select("x.name", "x.value")
    rows = quantiles(long, "value", named, ["name"])
    table = rows.agg(F.map_from_entries(F.collect_list(
        F.struct("name", F.struct(*named))))).scalar()
    key = {p: k for k, p in named.items()}
    return {alias: F.element_at(table, F.lit(c)).getField(key[p])
            for alias, (c, p) in wanted.items()}


def behaviour_flags(locations: DataFrame) -> DataFrame:
    q = global_quantiles(locations, {"q_reg": ("regularity_score", 0.75),
                                     "q_dps": ("downloads_per_session", 0.75)})
    return locations.select(
        LOC,
        flag(F.col("regularity_score") > q["q_reg"]).alias("is_mechanical"),
        flag(F.col("weekend_ratio") < 0.15).alias("is_weekday_biased"),
        flag(F.col("file_diversity_ratio") < 0.1).alias("is_single_file"),
        flag(F.col("downloads_per_session") > q["q_dps"]).alias("is_bursty"))


def advanced_flags(locations: DataFrame) -> DataFrame:
    q = global_quantiles(locations, {"q_burst": ("burst_pattern_score", 0.75),
                                     "q_coord": ("user_coordination_score", 0.75)})
    return locations.select(
        LOC,
        flag(F.col("burst_pattern_score") > q["q_burst"]).alias("is_bursty_advanced"),
        flag(F.col("night_ratio_advanced") > 0.25).alias("is_nocturnal"),
        flag(F.col("user_coordination_score") > q["q_coord"]).alias("is_coordinated"))


# Fixed weights of the composite bot score.
COMPOSITE_WEIGHTS = {"dl_user_per_log_users": 0.3, "user_scarcity_score": 0.25,
                     "download_concentration": 0.25, "anomaly_score": 0.2}


def interaction_features(locations: DataFrame, moderate_dpu: float = 20.0,
                         few_users: float = 100.0, anomaly_offset: float = 0.5) -> DataFrame:
    """Products of volume, users and regularity. The anomaly terms need ``anomaly_score``."""
    has_anomaly = "anomaly_score" in locations.columns
    dpu, users = F.col("downloads_per_user"), F.col("unique_users")
    out = locations.withColumns({
        "dl_user_per_log_users": dpu / F.log(users + 2.0),
        "user_scarcity_score": F.when(dpu > moderate_dpu, F.exp(-users / few_users))
        .otherwise(0.0),
        "download_concentration": dpu / (users + 1),
        "temporal_irregularity": 1 / (F.col("hourly_entropy") + 0.1) * F.log(dpu + 1),
    })
    names = ["dl_user_per_log_users", "user_scarcity_score", "download_concentration",
             "temporal_irregularity"]
    if has_anomaly:
        weight = clip(F.col("anomaly_score") + anomaly_offset, 0, 1)
        out = out.withColumn("anomaly_dl_interaction", weight * dpu)
        names.append("anomaly_dl_interaction")
    q = global_quantiles(out, {"q_a": ("dl_user_per_log_users", 0.95),
                               "q_c": ("download_concentration", 0.95)})
    w = COMPOSITE_WEIGHTS
    # (use the term, weight, term); a term whose scale is about zero is left out altogether.
    terms = [
        (q["q_a"] > EPS, w["dl_user_per_log_users"],
         clip(F.try_divide(F.col("dl_user_per_log_users"), q["q_a"]), 0, 1)),
        (F.lit(True), w["user_scarcity_score"], F.col("user_scarcity_score")),
        (q["q_c"] > EPS, w["download_concentration"],
         clip(F.try_divide(F.col("download_concentration"), q["q_c"]), 0, 1)),
    ]
    if has_anomaly:
        terms.append((F.lit(True), w["anomaly_score"],
                      clip(F.col("anomaly_score") + anomaly_offset, 0, 1)))
    total = reduce(lambda a, b: a + b,
                   [F.when(use, x * t).otherwise(0.0) for use, x, t in terms])
    weights = reduce(lambda a, b: a + b,
                     [F.when(use, F.lit(x)).otherwise(0.0) for use, x, _ in terms])
    return out.withColumn("bot_composite_score", total / weights).select(
        LOC, *names, "bot_composite_score")


def signature_features(locations: DataFrame) -> DataFrame:
    users, total = d("unique_users"), d("total_downloads")
    dpu, whr = F.col("downloads_per_user"), F.col("working_hours_ratio")
    most = locations.agg(F.max("unique_users").cast("double")).scalar()
    median = global_quantiles(locations, {"m": ("downloads_per_user", 0.5)})["m"]
    return locations.select(
        LOC,
        (1 / (F.col("hourly_entropy") + 0.1)).alias("access_regularity"),
        (1 / (users / (total + 1) + 0.01)).alias("ua_per_user"),
        (total / (whr * 168 + 1)).alias("request_velocity"),
        (1 - F.log1p(users) / F.log1p(most + 1)).alias("ip_concentration"),
        (F.abs(dpu - median) / (median + 1)).alias("session_anomaly"),
        (1 / (dpu / (F.log1p(users) + 1) + 0.1)).alias("request_pattern_anomaly"),
        F.abs(whr - 0.5).alias("weekend_weekday_imbalance"))


def geographic_stability(locations: DataFrame) -> DataFrame:
    """0.5 for every location when ``ip_concentration`` is not there."""
    if "ip_concentration" not in locations.columns:
        return locations.select(LOC, F.lit(0.5).alias("geographic_stability"))
    return locations.select(LOC, clip(F.try_divide(
        F.lit(1.0), F.col("ip_concentration") + 0.1), 0, 1).alias("geographic_stability"))


def robust_scale(column: str, low: Column, high: Column) -> Column:
    """Position between two quantiles, bounded to 0..1; 0 where they coincide."""
    return F.when(high - low < EPS, 0.0).otherwise(
        clip(F.try_divide(F.col(column).cast("double") - low, high - low), 0, 1))


def scaled(locations: DataFrame, columns: list[str]) -> dict[str, Column]:
    """Robust 1 %..99 % scaling of several columns."""
    q = global_quantiles(locations, {f"{c}__{s}": (c, p) for c in columns
                                     for s, p in (("lo", 0.01), ("hi", 0.99))})
    return {c: robust_scale(c, q[f"{c}__lo"], q[f"{c}__hi"]) for c in columns}


def discriminative_scores(locations: DataFrame) -> DataFrame:
    """Malicious and legitimate automation scores and their difference."""
    s = scaled(locations, ["file_exploration_score", "bot_farm_score", "file_mirroring_score",
                           "user_authenticity_score", "persistence_score"])
    stable = clip(F.col("geographic_stability"), 0, 1)
    malicious = clip(
        s["file_exploration_score"] * 0.25 + s["bot_farm_score"] * 0.30 + (1 - stable) * 0.20
        + F.col("targets_latest_only") * 0.15
        + (1 - clip(F.col("activity_density"), 0, 1)) * 0.10, 0, 1)
    legitimate = (s["file_mirroring_score"] * 0.30 + s["user_authenticity_score"] * 0.25
                  + stable * 0.20 + s["persistence_score"] * 0.25)
    if "protocol_legitimacy_score" in locations.columns:
        legitimate = legitimate + clip(F.col("protocol_legitimacy_score"), 0, 1) * 0.15
    out = locations.select(LOC, malicious.alias("malicious_bot_score"),
                           clip(legitimate, 0, 1).alias("legitimate_automation_score"))
    diff = F.col("malicious_bot_score") - F.col("legitimate_automation_score")
    return out.withColumns({
        "bot_vs_legitimate_score": diff,
        "is_likely_malicious": flag(diff > 0.3),
        "is_likely_legitimate_automation": flag(diff < -0.3)})


def country_zscore(locations: DataFrame) -> DataFrame:
    """Downloads per user against the locations of the same country."""
    stats = locations.filter(F.col("country").isNotNull()).groupBy("country").agg(
        F.avg("downloads_per_user").alias("m"), F.stddev_samp("downloads_per_user").alias("s"))
    joined = locations.select(LOC, "country", "downloads_per_user").join(stats, "country", "left")
    z = F.when(F.col("s") > 0, (F.col("downloads_per_user") - F.col("m")) / F.col("s"))
    return joined.select(LOC, F.coalesce(z, F.lit(0.0)).alias("country_zscore"))


def trend_anomaly(locations: DataFrame) -> DataFrame:
    before = d("years_before_latest")
    return locations.select(LOC, F.coalesce(F.when(
        before > 0, F.log1p("spike_ratio") / F.log1p(before + 1)), F.lit(0.0))
        .alias("temporal_trend_anomaly"))


def peer_similarity(locations: DataFrame, bins: int = 10) -> DataFrame:
    """Distance of downloads per user to the median of locations of similar size.

    Size classes are quantile bins of the user count; equal edges are merged, bins are closed on
    the right and the lowest value belongs to the first one.
    """
    probs = {f"e{i:02d}": i / bins for i in range(bins + 1)}
    edges = quantiles(locations.select("unique_users"), "unique_users", probs).select(
        F.array_sort(F.array_distinct(F.array(*probs)))).scalar()
    # A bin may hold most locations, so its median is bracketed like the global quantiles.
    users = d("unique_users")
    binned = locations.select(LOC, "downloads_per_user", users.alias("u"),
                              edges.alias("e")).select(
        LOC, "downloads_per_user",
        F.when(F.size("e") > 1, F.size(F.filter(
            F.slice("e", 2, bins), lambda x: x < F.col("u")))).alias("bin"))
    medians = quantiles(binned.select("bin", "downloads_per_user"), "downloads_per_user",
                        {"median": 0.5}, ["bin"])
    dev = F.abs(F.col("downloads_per_user") - F.col("median")) / (F.col("median") + 1)
    return binned.join(medians, "bin", "left").select(
        LOC, F.coalesce(1 / (1 + dev), F.lit(0.5)).alias("peer_similarity"))


def global_rank(locations: DataFrame) -> DataFrame:
    """Percentile of total downloads, ties averaged, from the table of distinct totals."""
    ranked = value_ranks(locations.select("total_downloads"), "total_downloads").select(
        "total_downloads", (average_rank() / F.col("total")).alias("global_rank_percentile"))
    return locations.select(LOC, "total_downloads").join(ranked, "total_downloads", "left") \
        .select(LOC, F.coalesce("global_rank_percentile", F.lit(0.5))
                .alias("global_rank_percentile"))
