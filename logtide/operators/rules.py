"""Rule-based labels: configurable range patterns, hub protection, heuristic ground truth."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.functions.columns import all_of, any_of, clip, true_only

# Fixed default taxonomy: ranges are inclusive, every field of a pattern must hold.
BASE_TAXONOMY: dict[str, Any] = {
    "behavior_type": {
        "organic": [
            {"id": "working_hours_human", "working_hours_ratio": {"min": 0.4},
             "regularity_score": {"max": 0.6}},
            {"id": "irregular_intervals", "interval_cv": {"min": 0.7}},
            {"id": "low_user_count_organic", "unique_users": {"max": 50},
             "downloads_per_user": {"min": 1, "max": 200}},
        ],
        "automated": [
            {"id": "high_regularity", "regularity_score": {"min": 0.7}},
            {"id": "non_working_hours", "working_hours_ratio": {"max": 0.25},
             "night_activity_ratio": {"min": 0.35}},
            {"id": "high_coordination", "user_coordination_score": {"min": 0.6},
             "unique_users": {"min": 100}},
            {"id": "very_high_volume", "downloads_per_user": {"min": 500}},
            {"id": "many_users_pattern", "unique_users": {"min": 1000},
             "downloads_per_user": {"max": 50}},
        ],
    },
    "automation_category": {
        "bot": [
            {"id": "many_users_low_dl", "unique_users": {"min": 1000},
             "downloads_per_user": {"max": 50}},
            {"id": "coordinated_activity", "user_coordination_score": {"min": 0.7},
             "user_authenticity_score": {"max": 0.4}},
            {"id": "ground_truth_bot", "unique_users": {"min": 10000},
             "downloads_per_user": {"max": 10}},
            {"id": "suspicious_timing", "night_activity_ratio": {"min": 0.5},
             "unique_users": {"min": 500}, "working_hours_ratio": {"max": 0.2}},
        ],
        "legitimate_automation": [
            {"id": "mirror_pattern", "downloads_per_user": {"min": 500},
             "unique_users": {"max": 100}},
            {"id": "high_volume_institution", "total_downloads": {"min": 100000},
             "downloads_per_user": {"min": 50, "max": 500},
             "working_hours_ratio": {"min": 0.25}},
            {"id": "ci_cd_pattern", "unique_users": {"max": 10},
             "regularity_score": {"min": 0.7}, "downloads_per_user": {"min": 20, "max": 500}},
            {"id": "automated_sync_pattern", "unique_users": {"max": 5},
             "regularity_score": {"min": 0.6}, "downloads_per_user": {"min": 50}},
        ],
    },
}


def merge_taxonomy(base: dict, override: dict) -> dict:
    """Deep merge: dictionaries merge key by key, everything else (lists too) is replaced."""
    out = dict(base)
    for key, value in override.items():
        both = isinstance(value, dict) and isinstance(out.get(key), dict)
        out[key] = merge_taxonomy(out[key], value) if both else value
    return out


@dataclass(frozen=True)
class RuleSet:
    """Patterns and thresholds of the rule classifier; the defaults are production values."""

    taxonomy: dict = field(default_factory=lambda: BASE_TAXONOMY)
    organic_max_users: float = 100
    bot_min_users: float = 500
    bot_max_dl_per_user: float = 100
    hub_min_dl_per_user: float = 100
    hub_aspera: float = 0.3
    hub_globus: float = 0.1
    hub_dl_per_user: float = 500
    hub_max_users: float = 200
    exclude_max_working: float = 0.1
    exclude_min_night: float = 0.7
    exclude_top_project: float = 0.8
    demote_top3: float = 0.5
    demote_volume: float = 100_000
    demote_volume_top3: float = 0.45
    demote_hhi: float = 0.05


_SKIP = ("id", "description", "parent")


def match_pattern(columns: list[str], pattern: dict) -> Column:
    """AND of the pattern's ranges. NULL compares false; an absent field never matches."""
    conds = []
    for name, spec in pattern.items():
        if name in _SKIP:
            continue
        if name not in columns:
            warnings.warn(f"pattern {pattern.get('id', '?')}: no column {name}; it cannot match",
                          stacklevel=2)
            return F.lit(False)
        if isinstance(spec, dict):
            if spec.get("min") is not None:
                conds.append(F.col(name) >= spec["min"])
            if spec.get("max") is not None:
                conds.append(F.col(name) <= spec["max"])
        else:
            conds.append(F.col(name) == spec)
    return true_only(all_of(conds))


def match_any(columns: list[str], patterns: list[dict]) -> Column:
    """OR of patterns; no pattern matches nothing."""
    return any_of(match_pattern(columns, p) for p in patterns)


def matched_patterns(df: DataFrame, taxonomy: dict) -> DataFrame:
    """One boolean column per pattern of the taxonomy, all in one projection."""
    flags = {}
    for level, kinds in taxonomy.items():
        for kind, patterns in kinds.items():
            for p in patterns:
                flags[f"{level}__{kind}__{p['id']}"] = match_pattern(df.columns, p)
    return df.select("geo_location", *[c.alias(k) for k, c in flags.items()])


def behavior_type(df: DataFrame, rules: RuleSet = RuleSet()) -> DataFrame:
    """organic or automated; automated wins when both match, user count decides when none does."""
    kinds = rules.taxonomy.get("behavior_type", {})
    automated = match_any(df.columns, kinds.get("automated", []))
    organic = match_any(df.columns, kinds.get("organic", []))
    return df.withColumn("behavior_type", F.when(automated, "automated").when(organic, "organic")
                         .when(F.col("unique_users") <= rules.organic_max_users, "organic")
                         .when(F.col("unique_users") > rules.organic_max_users, "automated")
                         .otherwise("unknown"))


def automation_category(df: DataFrame, rules: RuleSet = RuleSet()) -> DataFrame:
    """bot or legitimate_automation for automated locations; legitimate wins over bot.

    Where no pattern matches: many users with few downloads each are a bot, high downloads per
    user are legitimate (checked last, so it overrides), anything left is a bot.
    """
    kinds = rules.taxonomy.get("automation_category", {})
    legit = match_any(df.columns, kinds.get("legitimate_automation", []))
    bot = match_any(df.columns, kinds.get("bot", []))
    heavy = true_only(F.col("downloads_per_user") >= rules.hub_min_dl_per_user)
    kind = F.when(legit, "legitimate_automation").when(bot, "bot") \
        .when(heavy, "legitimate_automation").otherwise("bot")
    return df.withColumn("automation_category",
                         F.when(F.col("behavior_type") == "automated", kind))


def boolean_labels(df: DataFrame, organic_value: str = "organic") -> DataFrame:
    """is_bot / is_hub from the category, is_organic from the behaviour (never NULL)."""
    def equals(column: str, value: str) -> Column:
        if column not in df.columns:
            return F.lit(False)
        return true_only(F.col(column) == value)
    bot = equals("automation_category", "bot")
    hub = equals("automation_category", "legitimate_automation")
    organic = equals("behavior_type", organic_value) if "behavior_type" in df.columns \
        else ~bot & ~hub
    return df.withColumns({"is_bot": bot, "is_hub": hub, "is_organic": organic})


def rule_confidence(df: DataFrame) -> DataFrame:
    """Heuristic 0..1 confidence; an organic behaviour overrides the category's score."""
    users, dpu = F.col("unique_users"), F.col("downloads_per_user")
    bot = 0.4 + 0.3 * clip(F.log10(users + 1) / 5, 0, 1) + 0.3 * clip(1 - dpu / 200, 0, 1)
    hub = 0.4 + 0.6 * clip(F.log10(dpu + 1) / 4, 0, 1)
    signals = [clip(1 - F.log10(users + 1) / 4, 0, 1)]
    if "working_hours_ratio" in df.columns:
        signals.append(clip(F.col("working_hours_ratio"), 0, 1))
    organic = 0.3 + 0.7 * reduce(lambda a, b: a + b, signals) / len(signals)
    category = F.col("automation_category")
    value = F.when(F.col("behavior_type") == "organic", organic) \
        .when(category == "legitimate_automation", hub).when(category == "bot", bot) \
        .otherwise(0.5)
    return df.withColumn("classification_confidence", clip(value, 0, 1))


def _has(df: DataFrame, *columns: str) -> bool:
    return all(c in df.columns for c in columns)


def protect_hubs(df: DataFrame, rules: RuleSet = RuleSet()) -> DataFrame:
    """Locations with institutional protocols or mirror volume become protected hubs.

    Night-only traffic and traffic on one project are not protected.
    """
    mirror = (F.col("downloads_per_user") > rules.hub_dl_per_user) & \
        (F.col("unique_users") <= rules.hub_max_users)
    protocol = F.lit(False)
    if _has(df, "aspera_ratio", "globus_ratio"):
        protocol = (F.col("aspera_ratio") > rules.hub_aspera) | \
            (F.col("globus_ratio") > rules.hub_globus)
    nocturnal = F.lit(False)
    if _has(df, "working_hours_ratio", "night_activity_ratio"):
        nocturnal = (F.col("working_hours_ratio") < rules.exclude_max_working) & \
            (F.col("night_activity_ratio") > rules.exclude_min_night)
    single = F.col("top_project_concentration") > rules.exclude_top_project \
        if _has(df, "top_project_concentration") else F.lit(False)
    hub = (true_only(protocol) | true_only(mirror)) & ~true_only(nocturnal) & ~true_only(single)
    changes = {
        "is_protected_hub": hub,
        "behavior_type": F.when(hub, "hub").otherwise(F.col("behavior_type")),
        "automation_category": F.when(hub, "legitimate_automation")
        .otherwise(F.col("automation_category")),
    }
    if "user_category" in df.columns:
        changes["user_category"] = F.when(hub, "download_hub").otherwise(F.col("user_category"))
    return df.withColumns(changes)


def demote_suspicious_hubs(df: DataFrame, rules: RuleSet = RuleSet()) -> DataFrame:
    """Hubs whose traffic sits on a few projects become bots."""
    if not _has(df, "top3_project_concentration"):
        return df
    top3 = F.col("top3_project_concentration")
    if _has(df, "project_hhi"):
        concentrated = top3 > rules.demote_top3
        if _has(df, "total_downloads"):
            concentrated = concentrated | (
                (F.col("total_downloads") > rules.demote_volume)
                & (top3 > rules.demote_volume_top3))
        concentrated = concentrated & (F.col("project_hhi") > rules.demote_hhi)
    else:
        concentrated = top3 > rules.demote_top3
    demoted = true_only((F.col("behavior_type") == "hub") & concentrated)
    changes = {
        "is_protected_hub": F.col("is_protected_hub") & ~demoted,
        "behavior_type": F.when(demoted, "bot").otherwise(F.col("behavior_type")),
        "automation_category": F.when(demoted, "bot").otherwise(F.col("automation_category")),
    }
    if "user_category" in df.columns:
        changes["user_category"] = F.when(demoted, "bot").otherwise(F.col("user_category"))
    return df.withColumns(changes)


def classify_rules(locations: DataFrame, rules: RuleSet = RuleSet()) -> DataFrame:
    """The whole rule classifier: one projection over the location table, no shuffle."""
    df = locations
    if "total_downloads" not in df.columns:
        df = df.withColumn("total_downloads", F.col("unique_users") * F.col("downloads_per_user"))
    df = automation_category(behavior_type(df, rules), rules)
    df = demote_suspicious_hubs(protect_hubs(df, rules), rules)
    return rule_confidence(boolean_labels(df))


def final_label(df: DataFrame) -> DataFrame:
    """bot, hub or user (neither)."""
    return df.withColumn("final_label", F.when(F.col("is_bot"), "bot")
                         .when(F.col("is_hub"), "hub").otherwise("user"))


@dataclass(frozen=True)
class TruthRule:
    """One heuristic class: bounds on the profile, first match wins."""

    label: str
    confidence: float
    criteria: str
    bounds: tuple[tuple[str, str, float], ...]


# Fixed subtypes in order of precedence.
TRUTH_RULES = (
    TruthRule("bot", 0.99, "ground_truth_bot: users>=10000, dpu<=10", (
        ("unique_users", ">=", 10000), ("downloads_per_user", "<=", 10))),
    TruthRule("bot", 0.95, "large_scale_bot: users>=5000, dpu<=25", (
        ("unique_users", ">=", 5000), ("downloads_per_user", "<=", 25))),
    TruthRule("bot", 0.90, "bot_farm: users>=1000, dpu<=50, whr<=0.3", (
        ("unique_users", ">=", 1000), ("downloads_per_user", "<=", 50),
        ("working_hours_ratio", "<=", 0.3))),
    TruthRule("hub", 0.95, "mirror: users<=5, dpu>=1000", (
        ("unique_users", "<=", 5), ("downloads_per_user", ">=", 1000))),
    TruthRule("hub", 0.90, "hub: users<=20, dpu>=500", (
        ("unique_users", "<=", 20), ("downloads_per_user", ">=", 500))),
    TruthRule("hub", 0.85, "research_hub: 10<=users<=200, dpu>=200, total>=100K", (
        ("unique_users", ">=", 10), ("unique_users", "<=", 200),
        ("downloads_per_user", ">=", 200), ("total_downloads", ">=", 100000),
        ("working_hours_ratio", ">=", 0.2))),
    TruthRule("user", 0.95, "individual_user: users<=3, dpu<=20, whr>=0.4", (
        ("unique_users", "<=", 3), ("downloads_per_user", "<=", 20),
        ("working_hours_ratio", ">=", 0.4))),
    TruthRule("user", 0.90, "research_group: 3<=users<=30, 5<=dpu<=100, whr>=0.35", (
        ("unique_users", ">=", 3), ("unique_users", "<=", 30), ("downloads_per_user", ">=", 5),
        ("downloads_per_user", "<=", 100), ("working_hours_ratio", ">=", 0.35))),
    TruthRule("user", 0.85, "casual_user: users<=5, dpu<=50, night<=0.3", (
        ("unique_users", "<=", 5), ("downloads_per_user", "<=", 50),
        ("night_activity_ratio", "<=", 0.3))),
)


def heuristic_truth(profile: DataFrame, rules: tuple[TruthRule, ...] = TRUTH_RULES) -> DataFrame:
    """Label, confidence and criteria of the first matching subtype, else ``uncertain``."""
    def holds(rule: TruthRule) -> Column:
        return true_only(all_of(
            F.col(c) >= v if op == ">=" else F.col(c) <= v for c, op, v in rule.bounds))

    def chain(attribute: str, otherwise: Any) -> Column:
        out = None
        for rule in rules:
            value = F.lit(getattr(rule, attribute))
            out = F.when(holds(rule), value) if out is None else out.when(holds(rule), value)
        return out.otherwise(F.lit(otherwise))
    return profile.withColumns({
        "ground_truth_label": chain("label", "uncertain"),
        "ground_truth_confidence": chain("confidence", 0.0),
        "ground_truth_criteria": chain("criteria", ""),
    })
