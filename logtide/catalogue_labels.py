"""Registered queries on labels: sources, filters, joins, classification, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.functions.columns import LOC, left_features, rounded
from logtide.operators import learned, proximity, rules, seeds, temporal, timing, users
from logtide.operators import annotate as ann
from logtide.operators import volume
from logtide.operators.locations import location_features
from logtide.operators.rollups import LogViews
from logtide.operators.rules import RuleSet
from logtide.plans import annotation_text as texts
from logtide.plans import evaluation as ev
from logtide.plans import reports
from logtide.schema import get_schema
from logtide.session import materialise, shared_path
from logtide.sources import labels as label_source
from logtide.sources import sampling, sinks
from logtide.sources.fixtures import events_log, orders_log, table
from logtide.sources.log import valid_events, valid_year_events, well_formed_country

MIN_YEAR = 1995

# Thresholds at which every class occurs on the test tables.
LIGHT = RuleSet(
    taxonomy={
        "behavior_type": {
            "organic": [{"id": "day", "working_hours_ratio": {"min": 0.335}}],
            "automated": [
                {"id": "night", "working_hours_ratio": {"max": 0.32},
                 "night_activity_ratio": {"min": 0.33}},
                {"id": "volume", "downloads_per_user": {"min": 1.27}},
                {"id": "absent_field", "no_such_feature": {"min": 1}}],
        },
        "automation_category": {
            "bot": [{"id": "night", "night_activity_ratio": {"min": 0.34}}],
            "legitimate_automation": [{"id": "large", "total_downloads": {"min": 640}}],
        },
    },
    organic_max_users=490, bot_min_users=500, bot_max_dl_per_user=1.25, hub_min_dl_per_user=1.26,
    hub_dl_per_user=1.48, hub_max_users=830, exclude_max_working=0.3, exclude_min_night=0.36)

# Shares only, so that it works at any size of the tables.
FLAGSHIP = RuleSet(
    taxonomy={
        "behavior_type": {
            "organic": [{"id": "day", "working_hours_ratio": {"min": 0.335}}],
            "automated": [{"id": "night", "working_hours_ratio": {"max": 0.33},
                           "night_activity_ratio": {"min": 0.33}}]},
        "automation_category": {
            "bot": [{"id": "night", "night_activity_ratio": {"min": 0.34}}],
            "legitimate_automation": [{"id": "steady", "working_hours_ratio": {"min": 0.32}}]},
    },
    organic_max_users=1_000_000, hub_min_dl_per_user=100, hub_dl_per_user=500)

RICH = RuleSet(
    taxonomy=rules.merge_taxonomy(rules.BASE_TAXONOMY, {
        "behavior_type": {
            "organic": [
                {"id": "working_hours_human", "working_hours_ratio": {"min": 0.34},
                 "regularity_score": {"max": 1.1}},
                {"id": "irregular_intervals", "interval_cv": {"min": 1.1}},
                {"id": "low_user_count_organic", "unique_users": {"max": 480},
                 "downloads_per_user": {"min": 1, "max": 1.25}}],
            "automated": [
                {"id": "high_regularity", "regularity_score": {"min": 1.18}},
                {"id": "non_working_hours", "working_hours_ratio": {"max": 0.325},
                 "night_activity_ratio": {"min": 0.33}},
                {"id": "high_coordination", "user_coordination_score": {"min": 17},
                 "unique_users": {"min": 100}},
                {"id": "very_high_volume", "downloads_per_user": {"min": 1.45}}],
        },
        "automation_category": {
            "bot": [
                {"id": "many_users_low_dl", "unique_users": {"min": 700},
                 "downloads_per_user": {"max": 1.5}},
                {"id": "coordinated_activity", "user_coordination_score": {"min": 10},
                 "user_authenticity_score": {"max": 1.5}},
                {"id": "suspicious_timing", "night_activity_ratio": {"min": 0.345},
                 "unique_users": {"min": 450}, "working_hours_ratio": {"max": 0.33}}],
            "legitimate_automation": [
                {"id": "mirror_pattern", "downloads_per_user": {"min": 1.27},
                 "unique_users": {"max": 500}},
                {"id": "high_volume_institution", "total_downloads": {"min": 640},
                 "downloads_per_user": {"min": 1.2, "max": 1.5},
                 "working_hours_ratio": {"min": 0.33}}],
        },
    }),
    organic_max_users=490, bot_min_users=500, bot_max_dl_per_user=1.25, hub_min_dl_per_user=1.26,
    hub_aspera=0.11, hub_globus=0.11, hub_dl_per_user=1.4, hub_max_users=800,
    exclude_max_working=0.32, exclude_min_night=0.34, exclude_top_project=0.0065,
    demote_top3=0.0155, demote_volume=1100, demote_volume_top3=0.0115, demote_hhi=0.0012)

SEEDS = seeds.SeedRules(
    a_users=490, a_dpu=1.3, a_downloads=600, a_working=0.33, a_night=0.335, a_years=2,
    b_users=500, b_dpu=1.3, b_downloads=640, b_working=0.32, b_entropy=3.155, b_burst=14,
    c_users=850, c_dpu=1.6, c_coordination=16, c_protocol=0.41, c_latest=0.12,
    c_latest_users=700, c_years=8, c_years_users=760, hub_like_dpu=1.5, hub_like_years=3,
    farm_users=700, farm_dpu=1.48, spread_users=490, spread_dpu=1.26, spread_min_dpu=1.2,
    spread_working=0.33, spread_latest=0.11, night_share=0.34, night_working=0.325,
    massive_users=780, massive_dpu=1.5, scraper_projects=900, growth_spike=0.9,
    growth_users=450, growth_latest=0.13, mirror_dpu=1.27, mirror_users=490,
    institution_dpu=1.22, institution_users=480, institution_years=3, hub_working=0.32,
    hub_night=0.345, hub_aspera=0.105, hub_globus=0.105, long_years=4)


def views_of(spark: SparkSession, sf_dir: str, source=orders_log) -> LogViews:
    schema = get_schema("canonical").with_options(min_year=MIN_YEAR)
    return LogViews(source(spark, sf_dir), schema)


def stored_views(spark: SparkSession, sf_dir: str, source=orders_log) -> LogViews:
    """Views over the canonical log written once, for queries that scan it several times."""
    return views_of(spark, sf_dir, source).stored()


def light_table(views: LogViews) -> DataFrame:
    views = volume.base_views(views)
    return left_features(volume.base_stats(views), temporal.time_of_day(views),
                         temporal.TIME_OF_DAY_DEFAULTS)


def light_labels(views: LogViews, ruleset: RuleSet = LIGHT) -> DataFrame:
    """Location table with rule labels from volume and time of day."""
    labelled = rules.final_label(rules.classify_rules(light_table(views), ruleset))
    return materialise(labelled, "labels")


def whole_regularity(views: LogViews) -> DataFrame:
    """Interval regularity over all events of a location."""
    return timing.interval_regularity(views, k=None)


def rich_table(views: LogViews, regularity=timing.interval_regularity) -> DataFrame:
    """Location table of the rule and seed queries; the oracles of most take gaps from 50 events of a location."""
    views.hour_users  # written first: the hours are read from it
    out = light_table(views)
    for feature, defaults in (
            (volume.project_concentration, volume.PROJECT_DEFAULTS),
            (volume.protocol_mix, volume.PROTOCOL_DEFAULTS),
            (temporal.yearly_pattern, temporal.YEARLY_DEFAULTS),
            (temporal.burst_pattern, temporal.BURST_DEFAULTS),
            (temporal.user_coordination, temporal.COORDINATION_DEFAULTS),
            (regularity, timing.REGULARITY_DEFAULTS),
            (users.user_authenticity, users.AUTHENTICITY_DEFAULTS)):
        out = left_features(out, feature(views), defaults)
    return materialise(out, "locations")


def _rich(run):
    """Query over the rich location table."""
    return lambda spark, sf_dir: rounded(run(rich_table(stored_views(spark, sf_dir))))


def _whole(run):
    """Query over the rich location table with the gaps of all events."""
    return lambda spark, sf_dir: rounded(run(rich_table(stored_views(spark, sf_dir), whole_regularity)))


def _light(run):
    """Query over the labelled light table."""
    return lambda spark, sf_dir: rounded(run(light_labels(views_of(spark, sf_dir))))


def _log(run, source=orders_log):
    """Query over the canonical log."""
    return lambda spark, sf_dir: rounded(run(source(spark, sf_dir)))


# ------------------------------------------------------------------ sources and sinks

CANON = [LOC, "country", "city", "usr", "accession", "filename", "method", "ts", "year"]


def _src01(spark, sf_dir):
    log = orders_log(spark, sf_dir).select(*CANON)
    path = shared_path(spark, "log")
    log.write.parquet(path)
    read = get_schema("canonical").canonical(spark.read.parquet(path))
    return read.groupBy("country", "method", "year").agg(
        F.count(F.lit(1)).alias("n"), F.count("city").alias("cities"))


def _src02(spark, sf_dir):
    """A log without city and project, with its own year field."""
    schema = get_schema("default").with_options(
        location_field="country", country_field="country", city_field=None, user_field="usr",
        project_field=None, timestamp_field="ts", year_field="y", filename_field=None)
    log = orders_log(spark, sf_dir).withColumn("y", F.col("year") + 1)
    return schema.canonical(log).groupBy("geo_location", "year").agg(
        F.count(F.lit(1)).alias("n"), F.count("city").alias("cities"),
        F.countDistinct("accession").alias("projects"), F.count("method").alias("methods"))


def _src03(spark, sf_dir):
    log = orders_log(spark, sf_dir)
    top = log.groupBy("accession").agg(F.count(F.lit(1)).alias("downloads")) \
        .orderBy(F.desc("downloads"), "accession").limit(100)
    part = table(spark, sf_dir, "part")
    lines = part.select(F.to_json(F.struct(
        F.expr("concat('PXD', lpad(CAST(p_partkey AS STRING), 6, '0'))").alias("accession"),
        F.col("p_name").alias("title"), F.lit("2020-01-01").alias("submissionDate"),
        F.col("p_brand").alias("publicationDate"))).alias("json"))
    return label_source.with_metadata(top, label_source.parse_metadata(lines))


def gold_labels(locations: DataFrame) -> DataFrame:
    """Labels and split drawn from the hash of the location."""
    h = F.md5(LOC)
    low = F.substring(h, 1, 1)
    return locations.select(
        LOC, F.when(low < "6", "bot").when(low < "a", "hub").otherwise("organic").alias("label"),
        F.when(F.substring(h, 2, 1) < "b", "train").otherwise("test").alias("split"))


def _src04(spark, sf_dir):
    gold = gold_labels(orders_log(spark, sf_dir).select(LOC).distinct())
    path = shared_path(spark, "gold")
    gold.write.option("header", True).csv(path)
    return label_source.read_labels(spark, path)


def _src05(spark, sf_dir):
    """Exactly 1000 events of the log, summed per country."""
    log = events_log(spark, sf_dir).select(*CANON)
    sample = sampling.exact_sample(log, 1000)
    return sample.groupBy("country", "method").agg(F.count(F.lit(1)).alias("n"))


def _src06(spark, sf_dir):
    log = orders_log(spark, sf_dir).select(*CANON)
    return sampling.oversampled_limit(log, 500).groupBy("method").agg(
        F.count(F.lit(1)).alias("n"))


def _src07(spark, sf_dir):
    sample = timing.capped_sample(valid_events(events_log(spark, sf_dir)), 50)
    return sample.select(LOC, "usr", "accession", F.unix_micros("ts").alias("us"),
                         F.col("sample_rank").cast("bigint").alias("sample_rank"))


def _src08(spark, sf_dir):
    v = views_of(spark, sf_dir)
    annotated = ann.annotate(v.log, light_labels(v))
    source = shared_path(spark, "log") + ".parquet"
    written = sinks.write_annotated(annotated, source, "new_file")
    return spark.read.parquet(written).groupBy("is_bot", "is_hub", "is_organic").agg(
        F.count(F.lit(1)).alias("n"))


def _src09(spark, sf_dir):
    from logtide.operators.series import sequence_features
    v = views_of(spark, sf_dir, events_log)
    seq = sequence_features(v, "week")
    path = sinks.write_locations(seq, shared_path(spark, "locations"), "csv")
    back = spark.read.option("header", True).csv(path)
    nested = F.from_json("time_series_features", "array<array<double>>")
    return back.select(LOC, F.size(nested).cast("bigint").alias("windows"),
                       nested[11][0].cast("bigint").alias("last_downloads"))


def _src10(spark, sf_dir):
    summary = reports.nested_summary(light_labels(views_of(spark, sf_dir)), "rules")
    path = sinks.write_summary(summary, shared_path(spark, "summary"))
    back = spark.read.json(path)
    return rounded(back.select("method", "total_locations", "total_downloads", "countries", *[
        F.col(f"classification.{c}.{m}").alias(f"{c}_{m}")
        for c in ("bot", "hub", "user") for m in ("locations", "downloads", "downloads_pct")]))


# ------------------------------------------------------------------ filters and joins

def _flt01(log: DataFrame) -> DataFrame:
    return valid_year_events(log, 1998).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


def _flt02(v: LogViews) -> DataFrame:
    return volume.minimum_volume(volume.base_stats(v), 600).select(LOC, "total_downloads")


def _flt03(log: DataFrame) -> DataFrame:
    """Country names with template leftovers, blanks and placeholders mixed in by user."""
    k = F.regexp_extract("usr", "([0-9]+)", 1).cast("bigint") % 11
    broken = F.when(k == 0, "%{country}").when(k == 1, "").when(k == 2, F.lit(None)) \
        .when(k == 3, "N/A").when(k == 4, "a{b").otherwise(F.col("country"))
    rows = log.select(broken.alias("country"))
    return rows.groupBy(well_formed_country().alias("plain"),
                        well_formed_country(report=True).alias("report")).agg(
        F.count(F.lit(1)).alias("n"))


def _flt04(v: LogViews) -> DataFrame:
    labels = light_labels(v)
    out = None
    for mode in ("user_only", "hub_only", "bot_only", "no_bots"):
        part = ann.filter_log(v.log, labels, mode).groupBy(F.lit(mode).alias("mode"), "year").agg(
            F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def _flt05(v: LogViews) -> DataFrame:
    """Users are blanked in a third of the countries, whose ratio is then unknown."""
    k = F.length("country") % 3
    log = v.log.withColumn("usr", F.when(k > 0, F.col("usr")))
    table_ = light_table(LogViews(log, v.schema))
    return learned.complete_cases(table_, learned.MODEL_FEATURES).select(
        LOC, "country", "unique_users", "downloads_per_user")


PATTERN = {"id": "x", "description": "d", "working_hours_ratio": {"min": 0.33, "max": 0.36},
           "total_downloads": {"max": 640}}


def _flt06(v: LogViews) -> DataFrame:
    t = light_table(v)
    return t.select(LOC, rules.match_pattern(t.columns, PATTERN).alias("matched"),
                    rules.match_pattern(t.columns, {"id": "y", "absent": {"min": 0}})
                    .alias("absent"))


def _flt07(v: LogViews) -> DataFrame:
    t = light_table(v)
    patterns = [PATTERN, {"id": "z", "night_activity_ratio": {"min": 0.345}},
                {"id": "c", "years_active": 3}]
    return t.select(LOC, rules.match_any(t.columns, patterns).alias("matched"),
                    rules.match_any(t.columns, []).alias("none"))


def _flt08(labelled: DataFrame) -> DataFrame:
    return texts.blind(labelled).select(LOC, "unique_users", "total_downloads", "country")


def _keyed(run):
    """Log, bot keys and hub keys of the light labels."""
    def query(spark, sf_dir):
        v = stored_views(spark, sf_dir)
        labels = light_labels(v)
        return rounded(run(v.log, ann.keys_of(labels, "bot"), ann.keys_of(labels, "hub")))
    return query


def _jn04(v: LogViews) -> DataFrame:
    """Gap from each active hour to the next, as (location, hour, hours until the next)."""
    from pyspark.sql import Window
    nxt = F.lead("hour_ts").over(Window.partitionBy(LOC).orderBy("hour_ts"))
    hours = (F.unix_micros(nxt) - F.unix_micros("hour_ts")) / F.lit(3.6e9)
    return v.hour.select(LOC, "n", F.unix_micros("hour_ts").alias("hour_us"),
                         hours.alias("next_in_hours"))


def _jn05(v: LogViews) -> DataFrame:
    from pyspark.sql import Window
    w = Window.partitionBy(LOC)
    return v.day.select(LOC, F.unix_micros("day").alias("day_us"), "n",
                        (F.col("n") - F.avg("n").over(w)).alias("above_mean"))


def _jn06(v: LogViews) -> DataFrame:
    return volume.day_of_week(v).join(volume.file_diversity(v), LOC, "left") \
        .join(timing.session_counts(v), LOC, "left")


def _jn10(v: LogViews) -> DataFrame:
    base = volume.base_stats(v).select(LOC, "total_downloads")
    gold = gold_labels(base)
    # A second row for some locations, which must not count twice.
    doubled = gold.unionByName(gold.filter(F.col("label") == "bot")
                               .withColumn("label", F.lit("hub")))
    train = learned.gold_rows(base, doubled, "train").withColumn("split", F.lit("train"))
    return train.unionByName(
        learned.gold_rows(base, doubled, "test").withColumn("split", F.lit("test")))


def _proximity(spark, sf_dir):
    from logtide.functions.ranks import sliced_row_number
    base = materialise(volume.base_stats(views_of(spark, sf_dir)).select(
        LOC, "country", "total_downloads"), "base")
    order = F.struct((-F.col("total_downloads")).alias("d"), F.col(LOC))
    ranked = sliced_row_number(base, [], order, "rank")
    return proximity.proximity_groups(ranked)


def _jn12(v: LogViews) -> DataFrame:
    base = volume.base_stats(v)
    stats = base.groupBy("country").agg(F.count(F.lit(1)).alias("locations_per_country"),
                                        F.sum("total_downloads").alias("country_total_dl"))
    return base.select(LOC, "country", "total_downloads").join(stats, "country", "left")


# ------------------------------------------------------------------ classification

def corrections(locations: DataFrame) -> DataFrame:
    """External labels by location hash; some twice, some unknown."""
    h = F.md5(LOC)
    one, two = F.substring(h, 1, 1), F.substring(h, 2, 1)
    first = locations.filter(one < "5").select(
        LOC, F.when(two < "4", "bot").when(two < "8", "hub").when(two < "d", "organic")
        .otherwise("other").alias("label"), F.lit(1).alias("position"))
    again = locations.filter(one < "2").select(LOC, F.lit("organic").alias("label"),
                                               F.lit(2).alias("position"))
    unknown = locations.filter(one == "0").select(
        F.concat(F.lit("x"), LOC).alias(LOC), F.lit("bot").alias("label"),
        F.lit(1).alias("position"))
    return first.unionByName(again).unionByName(unknown)


def _all_seeds(t: DataFrame) -> DataFrame:
    return seeds.resolve_overlaps(seeds.organic_seeds(t, SEEDS), seeds.bot_seeds(t, SEEDS),
                                  seeds.hub_seeds(t, SEEDS))


def _behaviour(t: DataFrame) -> DataFrame:
    return rules.behavior_type(t, RICH)


def _categories(t: DataFrame) -> DataFrame:
    return rules.automation_category(_behaviour(t), RICH)


def _protected(t: DataFrame) -> DataFrame:
    return rules.protect_hubs(_categories(t), RICH)


LABEL_COLUMNS = ["behavior_type", "automation_category", "is_bot", "is_hub", "is_organic"]


def _cls18(t: DataFrame) -> DataFrame:
    """Given predictions: the class and its confidence come from working and night share."""
    p = t.withColumns({
        "predicted_label": F.when(F.col("night_activity_ratio") > 0.34, "bot")
        .when(F.col("working_hours_ratio") > 0.35, "hub").otherwise("organic"),
        "classification_confidence": F.col("working_hours_ratio") * 1.5})
    return learned.map_labels(p)


SMALL = learned.BoostingParams(rounds=3, depth=2, min_leaf=1, folds=2)
FEW = ["unique_users", "downloads_per_user", "working_hours_ratio", "night_activity_ratio",
       "hourly_entropy"]


def _trained(spark, sf_dir):
    t = materialise(light_table(views_of(spark, sf_dir)), "locations")
    labelled, model = learned.classify_learned(t, gold_labels(t), params=SMALL, rules=LIGHT)
    return t, labelled, model


def _cls13(spark, sf_dir):
    _, _, model = _trained(spark, sf_dir)
    rows = [(i, name, int(m.getNumTrees), float(sig[0] * 0 + 1))
            for i, (_, models, sigs) in enumerate(model.folds)
            for name, m in models.items() for sig in [sigs[name]]]
    return spark.createDataFrame(rows, "fold bigint, class string, trees bigint, fitted double")


def _cls17(spark, sf_dir):
    _, labelled, _ = _trained(spark, sf_dir)
    total = F.col("prob_bot") + F.col("prob_hub") + F.col("prob_organic")
    return rounded(labelled.select(LOC, "predicted_label", "classification_confidence",
                                   total.alias("prob_total")))


def _cls20(spark, sf_dir):
    t = rich_table(stored_views(spark, sf_dir), whole_regularity)
    labelled, _ = learned.classify_learned(t, corrections=corrections(t), rules=RICH, seed_rules=SEEDS)
    return rounded(labelled.select(LOC, *LABEL_COLUMNS, "needs_review", "is_protected_hub"))


def _cls16(spark, sf_dir):
    _, _, model = _trained(spark, sf_dir)
    rows = [(i, name, float(a), float(b)) for i, (_, _, sig) in enumerate(model.folds)
            for name, (a, b) in sig.items()]
    return spark.createDataFrame(rows, "fold bigint, class string, slope double, offset double")


def _cls21(spark, sf_dir):
    t = light_table(views_of(spark, sf_dir))
    return rounded(learned.isolation_scores(t, FEW, trees=50))


def _cls22(spark, sf_dir):
    t = light_labels(views_of(spark, sf_dir))
    return rounded(learned.surrogate_importances(t, FEW, F.col("is_bot"), trees=20, repeats=2,
                                                 depth=5))


def _cls23(spark, sf_dir):
    _, _, model = _trained(spark, sf_dir)
    return rounded(spark.createDataFrame(model.importances(),
                                         "feature string, importance double"))


def _cls24(spark, sf_dir):
    t = light_labels(views_of(spark, sf_dir))
    return rounded(learned.feature_usage(t, FEW, F.col("is_bot"), trees=20, depth=5))


TRUTH = tuple(rules.TruthRule(r.label, r.confidence, r.criteria, b) for r, b in zip(
    rules.TRUTH_RULES, [
        (("unique_users", ">=", 800), ("downloads_per_user", "<=", 1.5)),
        (("unique_users", ">=", 750), ("downloads_per_user", "<=", 1.52)),
        (("unique_users", ">=", 495), ("downloads_per_user", "<=", 1.3),
         ("working_hours_ratio", "<=", 0.36)),
        (("unique_users", "<=", 470), ("downloads_per_user", ">=", 1.25)),
        (("unique_users", "<=", 480), ("downloads_per_user", ">=", 1.24)),
        (("unique_users", ">=", 470), ("unique_users", "<=", 500),
         ("downloads_per_user", ">=", 1.24), ("total_downloads", ">=", 600),
         ("working_hours_ratio", ">=", 0.36)),
        (("unique_users", "<=", 485), ("downloads_per_user", "<=", 1.23),
         ("working_hours_ratio", ">=", 0.37)),
        (("unique_users", ">=", 470), ("unique_users", "<=", 495),
         ("downloads_per_user", ">=", 1.2), ("downloads_per_user", "<=", 1.3),
         ("working_hours_ratio", ">=", 0.355)),
        (("unique_users", "<=", 500), ("downloads_per_user", "<=", 1.3),
         ("night_activity_ratio", "<=", 0.33)),
    ]))


def _cls25(v: LogViews) -> DataFrame:
    truth = rules.heuristic_truth(volume.ground_truth_profile(v), TRUTH)
    return truth.select(LOC, "ground_truth_label", "ground_truth_confidence",
                        "ground_truth_criteria")


def _set03(t: DataFrame) -> DataFrame:
    return _all_seeds(t).groupBy("label", "seed_confidence").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ evaluation

def annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: labels of two annotators and a truth, from the labels table."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(
        d.cast("string").alias(LOC), d.alias("doc_id"),
        F.when(d % 17 == 0, None).when(F.col("quality") == 1, "organic")
        .when(d % 3 == 0, "hub").otherwise("bot").alias("a"),
        F.when(d % 19 == 0, None).when(F.col("toxic") == 1, "bot").when(d % 5 == 0, "hub")
        .when(d % 2 == 0, "organic").otherwise("bot").alias("b"),
        F.when(d % 7 < 3, "user").when(d % 7 == 3, "hub").otherwise("bot").alias("truth"))


def _user(column: str):
    return F.when(F.col(column) == "organic", "user").otherwise(F.col(column))


def eval_pairs(spark, sf_dir) -> DataFrame:
    rows = annotators(spark, sf_dir)
    preds = rows.filter("a IS NOT NULL").select(LOC, _user("a").alias("label"))
    return ev.align(preds, rows.select(LOC, F.col("truth").alias("label")))


def vote_table(spark, sf_dir) -> DataFrame:
    """Labels of three methods with confidence and downloads."""
    rows = annotators(spark, sf_dir)
    d = F.col("doc_id")
    out = None
    for i, (name, label) in enumerate((("a", _user("a")), ("b", _user("b")),
                                       ("c", F.col("truth")))):
        part = rows.select(
            LOC, F.lit(name).alias("method"), F.coalesce(label, F.lit("user")).alias("label"),
            ((d * (31 + i)) % 100 / 100.0).alias("confidence"),
            (d % 1000 + 1).alias("total_downloads"))
        out = part if out is None else out.unionByName(part)
    return out


def _pairs(spark, sf_dir) -> DataFrame:
    rows = annotators(spark, sf_dir)
    a = rows.select(LOC, F.col("a").alias("label"), F.lit("high").alias("confidence"))
    b = rows.select(LOC, F.col("b").alias("label"), F.lit("low").alias("confidence"))
    return ev.annotator_pairs(a, b)


def _ev(run, rows=eval_pairs, digits: int = 6):
    return lambda spark, sf_dir: rounded(run(rows(spark, sf_dir)), digits)


def _triples(spark, sf_dir) -> DataFrame:
    return annotators(spark, sf_dir).select(
        F.coalesce(_user("a"), F.lit("user")).alias("first"),
        F.coalesce(_user("b"), F.lit("user")).alias("second"), "truth")


def _evl08(spark, sf_dir):
    truth = annotators(spark, sf_dir).select(LOC, F.col("truth").alias("label"))
    return rounded(ev.method_comparison(vote_table(spark, sf_dir), truth))


def _evl16(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return ev.stratified_split(rows, "lang", "doc_id").select("doc_id", "lang", "split")


def _sides(spark, sf_dir):
    rows = annotators(spark, sf_dir)
    def as_label(c):
        return rows.filter(F.col(c).isNotNull()).select(LOC, _user(c).alias("label"))
    return as_label("a"), as_label("b"), as_label("truth")


def _evl17(spark, sf_dir):
    a, _, truth = _sides(spark, sf_dir)
    return rounded(ev.holdout_metrics(a, truth, ev.CLASSES))


def _evl18(spark, sf_dir):
    a, b, truth = _sides(spark, sf_dir)
    delta = ev.run_delta(ev.holdout_metrics(a, truth, ev.CLASSES),
                         ev.holdout_metrics(b, truth, ev.CLASSES))
    return rounded(delta.withColumn("changed", ev.reclassified(a, b).scalar()))


# ------------------------------------------------------------------ annotation texts

def _text_table(spark, sf_dir):
    v = views_of(spark, sf_dir)
    t = left_features(light_table(v), volume.protocol_mix(v), volume.PROTOCOL_DEFAULTS)
    return t


def paper_tables(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    k = F.regexp_extract("city", "_([0-9]+)_", 1).cast("bigint")
    places = t.select("city", "country").distinct()
    papers = places.filter(k % 4 != 3).select(
        "city", "country", (k * 7 - 7).alias("paper_count"))
    names = places.filter(k % 3 == 0).select("city", F.array(
        F.concat(F.lit("Institute "), k.cast("string")), F.lit("University")).alias("names"))
    return papers, names


def _ann05(spark, sf_dir):
    t = light_table(views_of(spark, sf_dir))
    return texts.enrichment(t, *paper_tables(t))


def _ann01(spark, sf_dir):
    t = materialise(_text_table(spark, sf_dir), "locations")
    context = texts.enrichment(t, *paper_tables(t)).filter("paper_count > 20")
    return texts.request_texts(t, context)


def _ann02(spark, sf_dir):
    t = light_table(views_of(spark, sf_dir)).select(LOC, F.col("city").alias("text"))
    m = texts.manifest(texts.batches(t))
    return m.select("batch", "n_locations", F.array_join("locations", "|").alias("locations"))


def responses(spark, sf_dir) -> DataFrame:
    """Answers in mixed case around the text of the conversations."""
    c = table(spark, sf_dir, "conversations")
    k = F.col("conv_id") % 6
    label = F.when(k == 0, "LABEL: bot").when(k == 1, "label:  Hub").when(k == 2, "Label: USER") \
        .when(k == 3, "LABEL: organic").otherwise("no verdict")
    conf = F.when(F.col("turn") % 3 == 0, "CONFIDENCE: High") \
        .when(F.col("turn") % 3 == 1, "confidence: low").otherwise("")
    why = F.concat(F.lit("REASONING: turn "), F.col("turn").cast("string"), F.lit("\nof "),
                   F.col("role"), F.when(k < 3, "\n\ntail").otherwise(""))
    return c.select("conv_id", "turn", F.concat_ws("\n", F.col("text"), label, conf, why)
                    .alias("text"))


def _ann03(spark, sf_dir):
    parsed = texts.parse_responses(responses(spark, sf_dir))
    return parsed.select("conv_id", "turn", "label", "confidence", "reasoning")


def _ann04(spark, sf_dir):
    base = volume.base_stats(views_of(spark, sf_dir)).select(LOC, "total_downloads")
    done = base.filter(F.substring(F.md5(LOC), 1, 1) < "8")
    return texts.unprocessed(base, done)


def _fe50(spark, sf_dir):
    v = stored_views(spark, sf_dir, events_log)
    out = location_features(v, durable=True)
    return rounded(out.withColumn("sequence_windows", F.size("time_series_features"))
                   .drop("time_series_features"))


def _flagship(spark, sf_dir):
    """Log -> location features -> rule labels -> annotated log -> clean downloads per country."""
    from logtide.plans.analytics import country_bubble
    v = stored_views(spark, sf_dir)
    annotated = ann.annotate(v.log, light_labels(v, FLAGSHIP))
    return rounded(country_bubble(annotated.filter(~F.col("is_bot") & ~F.col("is_hub"))))


def label_queries():
    v = views_of

    def on_views(run):
        return lambda spark, sf_dir: rounded(run(v(spark, sf_dir)))
    seed_columns = [LOC, "seed_confidence"]
    return {
        "src01_log_scan": _src01, "src02_schema_mapping": _src02,
        "src03_project_metadata": _src03, "src04_label_table": _src04,
        "src05_exact_sample": _src05, "src06_oversampled_limit": _src06,
        "src07_capped_sample": _src07, "src08_annotated_sink": _src08,
        "src09_location_sink": _src09, "src10_summary_sink": _src10,
        "flt01_valid_events": _log(_flt01), "flt02_minimum_volume": on_views(_flt02),
        "flt03_country_names": _log(_flt03), "flt04_category_filters": on_views(_flt04),
        "flt05_complete_cases": on_views(_flt05), "flt06_range_pattern": on_views(_flt06),
        "flt07_any_pattern": on_views(_flt07), "flt08_blind_columns": _light(_flt08),
        "jn02_semi_join": _keyed(lambda log, bots, hubs: ann.only(log, hubs).groupBy("year").agg(
            F.count(F.lit(1)).alias("n"))),
        "jn03_anti_join": _keyed(lambda log, bots, hubs: ann.without(log, bots).groupBy("year")
                                 .agg(F.count(F.lit(1)).alias("n"))),
        "jn04_successor": on_views(_jn04), "jn05_own_group_statistics": on_views(_jn05),
        "jn06_multi_way": on_views(_jn06),
        "jn07_annotate": lambda spark, sf_dir: (lambda w: ann.annotate(
            w.log, light_labels(w)).groupBy("country", *ann.FLAGS).agg(
                F.count(F.lit(1)).alias("n")))(stored_views(spark, sf_dir)),
        "jn08_annotate_from_keys": _keyed(lambda log, bots, hubs: ann.annotate_from_keys(
            log, bots, hubs).groupBy("country", *ann.FLAGS).agg(F.count(F.lit(1)).alias("n"))),
        "jn09_annotator_pairs": _ev(lambda p: p, _pairs),
        "jn10_gold_match": on_views(_jn10), "jn11_proximity_groups": _proximity,
        "jn12_country_statistics": on_views(_jn12),
        "cls01_matched_patterns": _whole(lambda t: rules.matched_patterns(t, RICH.taxonomy)),
        "cls02_behavior_type": _rich(lambda t: _behaviour(t).select(LOC, "behavior_type")),
        "cls03_automation_category": _rich(lambda t: _categories(t).select(
            LOC, "behavior_type", "automation_category")),
        "cls04_rule_confidence": _rich(lambda t: rules.rule_confidence(_categories(t)).select(
            LOC, "classification_confidence")),
        "cls05_boolean_labels": _rich(lambda t: rules.boolean_labels(_categories(t)).select(
            LOC, *LABEL_COLUMNS)),
        "cls06_rule_classifier": _whole(lambda t: rules.classify_rules(t, RICH).select(
            LOC, *LABEL_COLUMNS, "is_protected_hub", "classification_confidence")),
        "cls07_organic_seeds": _rich(lambda t: seeds.organic_seeds(t, SEEDS).select(
            *seed_columns)),
        "cls08_bot_seeds": _rich(lambda t: seeds.bot_seeds(t, SEEDS).select(*seed_columns)),
        "cls09_hub_seeds": _rich(lambda t: seeds.hub_seeds(t, SEEDS).select(*seed_columns)),
        "cls10_seed_overlap": _rich(_all_seeds),
        "cls11_label_injection": _rich(lambda t: seeds.inject_labels(
            _all_seeds(t), t, corrections(t))),
        "cls12_feature_matrix": _whole(learned.feature_matrix),
        "cls13_boosting": _cls13,
        "cls14_hub_protection": _rich(lambda t: _protected(t).select(
            LOC, "behavior_type", "automation_category", "is_protected_hub")),
        "cls15_hub_demotion": _whole(lambda t: rules.demote_suspicious_hubs(
            _protected(t), RICH).select(LOC, "behavior_type", "automation_category",
                                        "is_protected_hub")),
        "cls16_calibration": _cls16, "cls17_predict": _cls17,
        "cls18_label_mapping": on_views(lambda w: _cls18(light_table(w)).select(
            LOC, "user_category", "behavior_type", "automation_category", "needs_review")),
        "cls19_finalise": on_views(lambda w: learned.finalise(
            _cls18(light_table(w)), least=600).select(LOC, *LABEL_COLUMNS)),
        "cls20_learned_labels": _cls20, "cls21_isolation_scores": _cls21,
        "cls22_surrogate_importances": _cls22, "cls23_model_importances": _cls23,
        "cls24_feature_usage": _cls24, "cls25_heuristic_truth": on_views(_cls25),
        "cls26_final_label": _light(lambda t: t.select(LOC, "final_label")),
        "set03_seed_sets": _rich(_set03),
        "set04_vote_sets": _ev(ev.discovery, vote_table),
        "set05_label_override": _rich(lambda t: seeds.inject_labels(
            _all_seeds(t), t, corrections(t)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))),
        "evl01_unified_label": _rich(lambda t: ev.unified_label(rules.classify_rules(t, RICH))
                                     .select(LOC, "label")),
        "evl02_align": _ev(lambda p: p),
        "evl03_class_metrics": _ev(lambda p: ev.class_metrics(ev.confusion(p))),
        "evl03_macro_metrics": _ev(lambda p: ev.macro_metrics(ev.confusion(p))),
        "evl04_bootstrap": _ev(lambda p: ev.bootstrap_macro_f1(ev.confusion(p))),
        "evl05_agreement": _ev(lambda p: ev.agreement(ev.confusion(p))),
        "evl06_kappa": _ev(lambda p: ev.kappa(ev.confusion(p))),
        "evl07_mcnemar": _ev(ev.mcnemar, _triples),
        "evl07_mcnemar_p_value": _ev(lambda t: ev.with_p_value(ev.mcnemar(t)), _triples),
        "evl08_method_comparison": _evl08,
        "evl09_discovery": _ev(ev.discovery, vote_table),
        "evl10_majority_consistency": _ev(ev.majority_consistency, vote_table),
        "evl11_confidence": _ev(ev.confidence_statistics, vote_table),
        "evl12_download_impact": _ev(ev.download_impact, vote_table),
        "evl13_consensus": _ev(ev.consensus, _pairs),
        "evl14_annotator_agreement": _ev(lambda p: ev.annotator_agreement(p, seeds.LABELS),
                                         _pairs),
        "evl15_disagreements": _ev(ev.disagreement_patterns, _pairs),
        "evl16_stratified_split": _evl16, "evl17_holdout": _evl17, "evl18_run_delta": _evl18,
        "evl19_run_summary": _light(lambda t: reports.run_summary(t, "rules")),
        "agp14_crosstab": _ev(lambda p: ev.crosstab(p, seeds.LABELS), _pairs),
        "ann01_request_texts": _ann01, "ann02_batches": _ann02, "ann03_responses": _ann03,
        "ann04_unprocessed": _ann04, "ann05_enrichment": _ann05,
        "fe50_location_table": _fe50,
        "flagship_clean_country_downloads": _flagship,
    }
