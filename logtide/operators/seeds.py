"""Training seeds: high-confidence organic, bot and hub locations and their overlap rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.functions.columns import LOC, true_only


@dataclass(frozen=True)
class SeedRules:
    """Thresholds of the seed heuristics; the defaults are production values."""

    min_downloads: int = 20
    a_users: float = 10
    a_dpu: float = 5
    a_downloads: float = 200
    a_working: float = 0.3
    a_night: float = 0.5
    a_years: float = 2
    b_users: float = 50
    b_dpu: float = 10
    b_downloads: float = 1000
    b_working: float = 0.25
    b_entropy: float = 1.5
    b_burst: float = 0.5
    c_users: float = 200
    c_dpu: float = 20
    c_coordination: float = 0.3
    c_protocol: float = 0.3
    c_latest: float = 0.9
    c_latest_users: float = 50
    c_years: float = 2
    c_years_users: float = 30
    hub_like_dpu: float = 200
    hub_like_years: float = 3
    farm_users: float = 5000
    farm_dpu: float = 50
    spread_users: float = 500
    spread_dpu: float = 15
    spread_min_dpu: float = 2
    spread_working: float = 0.38
    spread_latest: float = 0.8
    night_share: float = 0.8
    night_working: float = 0.1
    massive_users: float = 10000
    massive_dpu: float = 20
    scraper_projects: float = 15000
    growth_spike: float = 50
    growth_users: float = 200
    growth_latest: float = 0.95
    mirror_dpu: float = 500
    mirror_users: float = 100
    institution_dpu: float = 200
    institution_users: float = 1000
    institution_years: float = 3
    hub_working: float = 0.1
    hub_night: float = 0.7
    hub_aspera: float = 0.3
    hub_globus: float = 0.1
    long_years: float = 4


class _Conditions:
    """Conditions over optional columns.

    A rule over an absent column is dropped from a tier (``keep``) or never fires (``need``).
    """

    def __init__(self, df: DataFrame):
        self.columns = set(df.columns)

    def keep(self, *tests: tuple[str, Column]) -> Column:
        out = F.lit(True)
        for names, cond in tests:
            if self.has(*names.split()):
                out = out & true_only(cond)
        return out

    def need(self, names: str, cond: Column) -> Column:
        return true_only(cond) if self.has(*names.split()) else F.lit(False)

    def has(self, *names: str) -> bool:
        return all(n in self.columns for n in names)




def organic_seeds(df: DataFrame, r: SeedRules = SeedRules()) -> DataFrame:
    """Tiers A (individuals, 1.0), B (active researchers, 0.7) and C (groups, 0.4)."""
    c = _Conditions(df)
    users, dpu, n = F.col("unique_users"), F.col("downloads_per_user"), F.col("total_downloads")
    whr, years = F.col("working_hours_ratio"), F.col("years_span")
    a = c.keep(("unique_users", users <= r.a_users), ("downloads_per_user", dpu <= r.a_dpu),
               ("total_downloads", n.between(r.min_downloads, r.a_downloads)),
               ("working_hours_ratio", whr > r.a_working),
               ("night_activity_ratio", F.col("night_activity_ratio") < r.a_night),
               ("years_span", years >= r.a_years))
    b = c.keep(("unique_users", users <= r.b_users), ("downloads_per_user", dpu <= r.b_dpu),
               ("total_downloads", n.between(r.min_downloads, r.b_downloads)),
               ("working_hours_ratio", whr > r.b_working),
               ("hourly_entropy", F.col("hourly_entropy") > r.b_entropy),
               ("burst_pattern_score", F.col("burst_pattern_score") < r.b_burst))
    late = (F.col("fraction_latest_year") > r.c_latest) & (users > r.c_latest_users)
    young = (years < r.c_years) & (users > r.c_years_users)
    g = c.keep(("unique_users", users <= r.c_users), ("downloads_per_user", dpu <= r.c_dpu),
               ("total_downloads", n >= r.min_downloads),
               ("user_coordination_score", F.col("user_coordination_score") < r.c_coordination),
               ("protocol_legitimacy_score", F.col("protocol_legitimacy_score") > r.c_protocol),
               ("fraction_latest_year unique_users", ~late),
               ("years_span unique_users", ~young))
    tier = F.when(a, 1.0).when(b, 0.7).when(g, 0.4)
    return df.withColumn("seed_confidence", tier).filter(F.col("seed_confidence").isNotNull())


def bot_seeds(df: DataFrame, r: SeedRules = SeedRules()) -> DataFrame:
    """Farms, distributed, nocturnal, coordinated, scraping and exploding locations."""
    c = _Conditions(df)
    users, dpu = F.col("unique_users"), F.col("downloads_per_user")
    whr, night = F.col("working_hours_ratio"), F.col("night_activity_ratio")
    latest = F.col("fraction_latest_year")
    both = "unique_users downloads_per_user"
    volume = c.keep(("total_downloads", F.col("total_downloads") >= r.min_downloads))
    hub_like = c.need("downloads_per_user years_span",
                      (dpu > r.hub_like_dpu) & (F.col("years_span") >= r.hub_like_years))
    farm = c.need(both, (users > r.farm_users) & (dpu < r.farm_dpu))
    spread = c.need(both, (users > r.spread_users) & (dpu < r.spread_dpu)
                    & (dpu > r.spread_min_dpu)) & c.keep(
        ("working_hours_ratio", whr < r.spread_working),
        ("fraction_latest_year", latest > r.spread_latest))
    nocturnal = c.need("night_activity_ratio working_hours_ratio",
                       (night > r.night_share) & (whr < r.night_working)) & volume
    massive = c.need(both, (users > r.massive_users) & (dpu < r.massive_dpu))
    scraper = c.need("unique_projects", F.col("unique_projects") > r.scraper_projects)
    growth = c.need("spike_ratio unique_users fraction_latest_year",
                    (F.col("spike_ratio") > r.growth_spike) & (users > r.growth_users)
                    & (latest > r.growth_latest))
    picked = (farm | spread | nocturnal | massive | scraper | growth) & volume & ~hub_like
    crowded = c.need("unique_users", users > r.massive_users)
    # Later assignments win, so they come first in the chain.
    confidence = F.when(spread & ~farm & ~nocturnal & ~massive & ~scraper, 0.6) \
        .when(farm & nocturnal, 0.95).when(crowded, 0.9).otherwise(0.7)
    return df.filter(picked).withColumn("seed_confidence", confidence)


def hub_seeds(df: DataFrame, r: SeedRules = SeedRules()) -> DataFrame:
    """Small mirrors and long-running institutions."""
    c = _Conditions(df)
    users, dpu, years = F.col("unique_users"), F.col("downloads_per_user"), F.col("years_span")
    mirror = c.need("downloads_per_user unique_users",
                    (dpu > r.mirror_dpu) & (users < r.mirror_users))
    institution = c.need("downloads_per_user unique_users years_span",
                         (dpu > r.institution_dpu) & (users <= r.institution_users)
                         & (years >= r.institution_years))
    nocturnal = c.need("working_hours_ratio night_activity_ratio",
                       (F.col("working_hours_ratio") < r.hub_working)
                       & (F.col("night_activity_ratio") > r.hub_night))
    volume = c.keep(("total_downloads", F.col("total_downloads") >= r.min_downloads))
    verified = c.need("aspera_ratio globus_ratio",
                      (F.col("aspera_ratio") > r.hub_aspera)
                      | (F.col("globus_ratio") > r.hub_globus))
    long_running = c.need("years_span", years >= r.long_years)
    confidence = F.when(verified, 0.95).when(long_running, 0.85).otherwise(0.8)
    return df.filter((mirror | institution) & ~nocturnal & volume) \
        .withColumn("seed_confidence", confidence)


def resolve_overlaps(organic: DataFrame, bot: DataFrame, hub: DataFrame) -> DataFrame:
    """Seeds as (location, label, confidence): hub beats bot, a remaining bot beats organic.

    A location that is both hub and organic keeps both rows.
    """
    bot = bot.join(hub.select(LOC), LOC, "left_anti")
    organic = organic.join(bot.select(LOC), LOC, "left_anti")

    def tagged(df: DataFrame, label: str) -> DataFrame:
        return df.select(LOC, F.lit(label).alias("label"), "seed_confidence")
    return tagged(organic, "organic").unionByName(tagged(bot, "bot")) \
        .unionByName(tagged(hub, "hub"))


LABELS = ("bot", "hub", "organic")


def inject_labels(seeds: DataFrame, locations: DataFrame, corrections: DataFrame,
                  weight: float = 0.95) -> DataFrame:
    """External labels replace any seed of the same location, or add it; the last one counts.

    ``corrections`` has (location, label, position); unknown labels and locations are left out.
    """
    last = Window.partitionBy(LOC).orderBy(F.desc("position"))
    clean = (corrections.filter(F.col("label").isin(*LABELS))
             .join(locations.select(LOC).distinct(), LOC, "left_semi")
             .withColumn("r", F.row_number().over(last)).filter("r = 1")
             .select(LOC, "label", F.lit(float(weight)).alias("seed_confidence")))
    return seeds.join(clean.select(LOC), LOC, "left_anti").unionByName(clean)
