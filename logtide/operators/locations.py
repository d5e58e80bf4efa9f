"""Assembly of the location table from feature groups."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from logtide.functions.columns import LOC, left_features
from logtide.operators import access, composite, series, temporal, timing, users, volume
from logtide.operators.rollups import LogViews
from logtide.session import materialise

LogGroup = Callable[[LogViews], DataFrame]
TableGroup = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class FeatureGroup:
    """A named set of features keyed by location.

    ``from_log`` groups read the log views and are independent of each other; ``from_table``
    groups read the assembled table with the columns of all earlier stages. ``defaults`` fill
    locations without a row.
    """

    name: str
    from_log: LogGroup | None = None
    from_table: TableGroup | None = None
    defaults: dict = field(default_factory=dict)
    stage: int = 1


LOG_GROUPS = [
    FeatureGroup("project_concentration", volume.project_concentration,
                 defaults=volume.PROJECT_DEFAULTS),
    FeatureGroup("yearly_pattern", temporal.yearly_pattern, defaults=temporal.YEARLY_DEFAULTS),
    FeatureGroup("time_of_day", temporal.time_of_day, defaults=temporal.TIME_OF_DAY_DEFAULTS),
    FeatureGroup("protocol_mix", volume.protocol_mix, defaults=volume.PROTOCOL_DEFAULTS),
    FeatureGroup("interval_regularity", timing.interval_regularity,
                 defaults=timing.REGULARITY_DEFAULTS),
    FeatureGroup("day_of_week", volume.day_of_week, defaults=volume.DAY_OF_WEEK_DEFAULTS),
    FeatureGroup("file_diversity", lambda v: volume.file_diversity(v).drop("unique_files"),
                 defaults=volume.FILE_DIVERSITY_DEFAULTS),
    FeatureGroup("session_counts", timing.session_counts,
                 defaults=timing.SESSION_COUNT_DEFAULTS),
    FeatureGroup("burst_pattern", temporal.burst_pattern, defaults=temporal.BURST_DEFAULTS),
    FeatureGroup("circadian", temporal.circadian, defaults=temporal.CIRCADIAN_DEFAULTS),
    FeatureGroup("user_coordination", temporal.user_coordination,
                 defaults=temporal.COORDINATION_DEFAULTS),
    FeatureGroup("timing_precision", timing.timing_precision,
                 defaults=timing.PRECISION_DEFAULTS),
    FeatureGroup("user_distribution", users.user_distribution,
                 defaults=users.USER_DISTRIBUTION_DEFAULTS),
    FeatureGroup("session_behaviour", timing.session_behaviour,
                 defaults=timing.SESSION_DEFAULTS),
    FeatureGroup("repeat_access", access.repeat_access, defaults=access.REPEAT_DEFAULTS),
    FeatureGroup("sequential_access", access.sequential_access,
                 defaults=access.SEQUENTIAL_DEFAULTS),
    FeatureGroup("alphabetical_access", access.alphabetical_access,
                 defaults=access.ALPHABETICAL_DEFAULTS),
    FeatureGroup("benford", temporal.benford, defaults=temporal.BENFORD_DEFAULTS),
    FeatureGroup("hourly_uniformity", temporal.hourly_uniformity,
                 defaults=temporal.UNIFORMITY_DEFAULTS),
    FeatureGroup("weekday_pattern", temporal.weekday_pattern,
                 defaults=temporal.WEEKDAY_DEFAULTS),
    FeatureGroup("outbursts", series.outbursts, defaults=series.OUTBURST_DEFAULTS),
    FeatureGroup("outburst_streak", series.outburst_streak,
                 defaults={"longest_outburst_streak": 0}),
    FeatureGroup("periodicity", series.periodicity, defaults=series.PERIODICITY_DEFAULTS),
    FeatureGroup("trend", series.trend, defaults=series.TREND_DEFAULTS),
    FeatureGroup("recency", series.recency, defaults=series.RECENCY_DEFAULTS),
    FeatureGroup("momentum", series.momentum, defaults=series.MOMENTUM_DEFAULTS),
    FeatureGroup("distribution_shape", series.distribution_shape,
                 defaults=series.SHAPE_DEFAULTS),
    FeatureGroup("hour_profile", temporal.hour_profile, defaults=temporal.SIGNATURE_DEFAULTS),
    FeatureGroup("file_access", access.file_access, defaults=access.FILE_ACCESS_DEFAULTS),
    FeatureGroup("user_authenticity", users.user_authenticity,
                 defaults=users.AUTHENTICITY_DEFAULTS),
    FeatureGroup("version_targeting", access.version_targeting,
                 defaults=access.VERSION_DEFAULTS),
    FeatureGroup("persistence", temporal.persistence, defaults=temporal.PERSISTENCE_DEFAULTS),
    FeatureGroup("sequence", series.sequence_features),
]

# Stage 1 reads log features only (so the yearly ones come before the country ones), stage 2 the
# signature features, stage 3 the stability. Custom table groups default to the last stage.
TABLE_GROUPS = [
    FeatureGroup("country_rollup", from_table=volume.country_rollup),
    FeatureGroup("country_zscore", from_table=composite.country_zscore),
    FeatureGroup("trend_anomaly", from_table=composite.trend_anomaly),
    FeatureGroup("peer_similarity", from_table=composite.peer_similarity),
    FeatureGroup("global_rank", from_table=composite.global_rank),
    FeatureGroup("behaviour_flags", from_table=composite.behaviour_flags),
    FeatureGroup("advanced_flags", from_table=composite.advanced_flags),
    FeatureGroup("signature", from_table=composite.signature_features),
    FeatureGroup("interaction", from_table=composite.interaction_features),
    FeatureGroup("geographic_stability", from_table=composite.geographic_stability,
                 stage=2),
    FeatureGroup("discriminative_scores", from_table=composite.discriminative_scores,
                 stage=3),
]


GROUPS_PER_JOB = 6
JOBS = 4


def _in_parallel(tasks: Sequence[Callable[[], DataFrame]]) -> list[DataFrame]:
    """Submit independent jobs side by side; each small one leaves executors idle otherwise."""
    with ThreadPoolExecutor(JOBS) as pool:
        return [f.result() for f in [pool.submit(t) for t in tasks]]


def _attach(keys: DataFrame, parts: Sequence[tuple[FeatureGroup, DataFrame]]) -> DataFrame:
    for group, part in parts:
        keys = left_features(keys, part, group.defaults)
    return keys


def location_features(views: LogViews, groups: Sequence[str] | None = None,
                      custom: Sequence[FeatureGroup] = (), durable: bool = False) -> DataFrame:
    """Location table with the chosen feature groups (all by default) plus custom ones.

    With ``durable`` the roll-ups, the log features (in a few jobs) and the table of each stage
    are written to the shared folder: later steps read small tables, not the log again, and no
    plan grows with the number of groups.
    """
    def wanted(g: FeatureGroup) -> bool:
        return groups is None or g.name in groups

    def keep(df: DataFrame, name: str) -> DataFrame:
        return materialise(df, name) if durable else df
    if durable:
        _in_parallel([lambda n=n: getattr(views, n) for n in views.SHARED])
    base = keep(volume.base_stats(views), "base")
    base = keep(base.join(volume.hourly_users(views, base), LOC, "left"), "base")
    chosen = [g for g in LOG_GROUPS if wanted(g)] + [g for g in custom if g.from_log]
    keys = base.select(LOC)

    def job(part: list[FeatureGroup]) -> DataFrame:
        return keep(_attach(keys, [(g, g.from_log(views)) for g in part]), "features")
    chunks = [chosen[i:i + GROUPS_PER_JOB] for i in range(0, len(chosen), GROUPS_PER_JOB)]
    table = base
    for part in _in_parallel([lambda c=c: job(c) for c in chunks]):
        table = table.join(part, LOC)
    table = keep(table, "locations")
    later = [g for g in TABLE_GROUPS if wanted(g)]
    later += [replace(g, stage=max(g.stage, 4)) for g in custom if g.from_table]
    for stage in sorted({g.stage for g in later}):
        now = [g for g in later if g.stage == stage]
        before, done = set(table.columns), table
        parts = _in_parallel([
            lambda g=g: keep(g.from_table(done), g.name) for g in now])
        table = keep(_attach(table, list(zip(now, parts))), "locations")
        missing = before - set(table.columns)
        if missing:
            raise ValueError(f"stage {stage} dropped columns {sorted(missing)}")
    return table
