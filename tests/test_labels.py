"""Rules, seeds, hub protection, ground truth and label sources on literal rows."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from logtide.operators import annotate as ann
from logtide.operators import rules, seeds
from logtide.operators.learned import finalise, map_labels
from logtide.sources import labels as src

BASE = {"geo_location": "x", "country": "C", "unique_users": 10, "downloads_per_user": 5.0,
        "total_downloads": 50, "unique_projects": 5, "working_hours_ratio": 0.3,
        "night_activity_ratio": 0.3, "hourly_entropy": 2.0, "regularity_score": 0.65,
        "interval_cv": 0.5, "user_coordination_score": 0.0, "user_authenticity_score": 1.0,
        "burst_pattern_score": 0.0, "spike_ratio": 1.0, "fraction_latest_year": 0.5,
        "years_span": 3, "aspera_ratio": 0.0, "globus_ratio": 0.0,
        "protocol_legitimacy_score": 0.1, "top_project_concentration": 0.2,
        "top3_project_concentration": 0.3, "project_hhi": 0.1}


@pytest.fixture
def locations(spark):
    def build(*changes):
        rows = [{**BASE, "geo_location": f"l{i}", **c} for i, c in enumerate(changes)]
        return spark.createDataFrame(pd.DataFrame(rows))
    return build


def column(df, name):
    return [r[name] for r in df.orderBy("geo_location").collect()]


def test_behavior_boundaries(locations):
    df = locations({"regularity_score": 0.7}, {"regularity_score": 0.699},
                   {"interval_cv": 0.7}, {"unique_users": 51, "downloads_per_user": 0.5},
                   {"unique_users": 101, "downloads_per_user": 0.5},
                   {"downloads_per_user": 500.0}, {"unique_users": 1000})
    assert column(rules.behavior_type(df), "behavior_type") == [
        "automated", "organic", "organic", "organic", "automated", "automated", "automated"]


def test_automation_order(locations):
    df = locations(
        {"regularity_score": 0.9, "unique_users": 1000},                    # bot pattern
        {"regularity_score": 0.9, "downloads_per_user": 20.0},              # ci_cd
        {"regularity_score": 0.9, "unique_users": 11, "downloads_per_user": 100.0},
        {"regularity_score": 0.9, "unique_users": 501, "downloads_per_user": 99.0},
        {"regularity_score": 0.9, "unique_users": 12, "downloads_per_user": 3.0},
        {})
    out = rules.automation_category(rules.behavior_type(df))
    assert column(out, "automation_category") == [
        "bot", "legitimate_automation", "legitimate_automation", "bot", "bot", None]


def test_null_and_missing_fields_do_not_match(locations):
    df = locations({}).withColumn("regularity_score", F.lit(None).cast("double"))
    pattern = {"id": "p", "regularity_score": {"min": 0}}
    assert df.select(rules.match_pattern(df.columns, pattern)).first()[0] is False
    with pytest.warns(UserWarning, match="no column absent"):
        assert df.select(rules.match_pattern(df.columns, {"absent": {"min": 0}})).first()[0] is False


def test_hub_protection_and_demotion(locations):
    df = locations({"aspera_ratio": 0.31}, {"aspera_ratio": 0.3}, {"globus_ratio": 0.11},
                   {"downloads_per_user": 501.0, "unique_users": 200},
                   {"downloads_per_user": 501.0, "unique_users": 201},
                   {"aspera_ratio": 0.5, "working_hours_ratio": 0.05, "night_activity_ratio": 0.8},
                   {"aspera_ratio": 0.5, "top_project_concentration": 0.81},
                   {"aspera_ratio": 0.5, "top3_project_concentration": 0.51},
                   {"aspera_ratio": 0.5, "top3_project_concentration": 0.46},
                   {"aspera_ratio": 0.5, "top3_project_concentration": 0.46,
                    "total_downloads": 100001},
                   {"aspera_ratio": 0.5, "top3_project_concentration": 0.9, "project_hhi": 0.05})
    out = rules.classify_rules(df)
    assert column(out.select("geo_location", "is_protected_hub"), "is_protected_hub")[:2] == [
        True, False]
    got = {r.geo_location: (r.is_bot, r.is_hub) for r in out.collect()}
    assert got["l2"] == (False, True) and got["l3"] == (False, True)
    assert got["l5"] != (False, True) and got["l6"] != (False, True)
    assert got["l7"] == (True, False) and got["l8"] == (False, True)
    assert got["l9"] == (True, False) and got["l10"] == (False, True)
    conf = [r.classification_confidence for r in out.collect()]
    assert all(0 <= c <= 1 for c in conf)


def test_merge_taxonomy():
    base = {"a": {"x": [1], "y": 2}, "b": 3}
    assert rules.merge_taxonomy(base, {"a": {"x": [9]}, "c": 4}) == {
        "a": {"x": [9], "y": 2}, "b": 3, "c": 4}
    assert base == {"a": {"x": [1], "y": 2}, "b": 3}


def test_seed_tiers(locations):
    df = locations({"working_hours_ratio": 0.4}, {"downloads_per_user": 6.0},
                   {"unique_users": 150, "protocol_legitimacy_score": 0.4},
                   {"unique_users": 150, "protocol_legitimacy_score": 0.4,
                    "fraction_latest_year": 0.95},
                   {"total_downloads": 19})
    got = {r.geo_location: r.seed_confidence for r in seeds.organic_seeds(df).collect()}
    assert got == {"l0": 1.0, "l1": 0.7, "l2": 0.4}
    missing = seeds.organic_seeds(df.select("geo_location", "unique_users"))
    assert missing.count() == 5


def test_bot_seed_confidence(locations):
    df = locations({"unique_users": 5001, "downloads_per_user": 10.0},
                   {"unique_users": 10001, "downloads_per_user": 10.0},
                   {"unique_users": 6000, "downloads_per_user": 10.0,
                    "night_activity_ratio": 0.9, "working_hours_ratio": 0.05},
                   {"unique_users": 600, "downloads_per_user": 10.0, "fraction_latest_year": 0.9},
                   {"unique_projects": 15001, "downloads_per_user": 300.0},
                   {"unique_projects": 15001})
    got = {r.geo_location: r.seed_confidence for r in seeds.bot_seeds(df).collect()}
    assert got == {"l0": 0.7, "l1": 0.9, "l2": 0.95, "l3": 0.6, "l5": 0.7}


def test_hub_seeds_and_overlaps(locations):
    df = locations({"downloads_per_user": 501.0, "unique_users": 99, "years_span": 1},
                   {"downloads_per_user": 201.0, "unique_users": 1000},
                   {"downloads_per_user": 501.0, "aspera_ratio": 0.4},
                   {"downloads_per_user": 501.0, "years_span": 4})
    got = {r.geo_location: r.seed_confidence for r in seeds.hub_seeds(df).collect()}
    assert got == {"l0": 0.8, "l1": 0.8, "l2": 0.95, "l3": 0.85}
    one = df.filter("geo_location = 'l0'").withColumn("seed_confidence", F.lit(0.5))
    out = seeds.resolve_overlaps(one, one, one).collect()
    assert sorted(r.label for r in out) == ["hub", "organic"]


def test_label_injection(spark, locations):
    df = locations({}, {}, {})
    start = df.filter("geo_location = 'l0'").select(
        "geo_location", F.lit("bot").alias("label"), F.lit(0.7).alias("seed_confidence"))
    corr = spark.createDataFrame(
        [("l0", "hub", 1), ("l0", "organic", 2), ("l1", "nonsense", 1), ("zz", "bot", 1)],
        "geo_location string, label string, position int")
    out = seeds.inject_labels(start, df, corr).collect()
    assert [(r.geo_location, r.label, r.seed_confidence) for r in out] == [("l0", "organic", 0.95)]


def test_heuristic_truth_precedence(locations):
    df = locations({"unique_users": 10000, "downloads_per_user": 10.0},
                   {"unique_users": 5000, "downloads_per_user": 25.0},
                   {"unique_users": 3, "downloads_per_user": 20.0, "working_hours_ratio": 0.4},
                   {"unique_users": 5, "downloads_per_user": 1000.0},
                   {"unique_users": 400})
    out = rules.heuristic_truth(df)
    assert column(out, "ground_truth_label") == ["bot", "bot", "user", "hub", "uncertain"]
    assert column(out, "ground_truth_confidence") == [0.99, 0.95, 0.95, 0.95, 0.0]


def test_mapping_and_finalise(spark):
    df = spark.createDataFrame(
        [("a", 5, 2.0, 50, "organic", 0.9), ("b", 50, 2.0, 50, "organic", 0.4),
         ("c", 5, 2.0, 2, "bot", 0.9), ("d", 5, 2.0, 3, "hub", 0.9)],
        "geo_location string, unique_users int, downloads_per_user double, total_downloads int, "
        "predicted_label string, classification_confidence double")
    out = {r.geo_location: r for r in finalise(map_labels(df)).collect()}
    assert (out["a"].user_category, out["b"].user_category) == ("independent_user", "normal")
    assert out["b"].needs_review and not out["a"].needs_review
    assert out["c"].behavior_type == "insufficient_evidence" and not out["c"].is_bot
    assert out["d"].is_hub and out["a"].is_organic


def test_annotation_keeps_rows(spark):
    log = spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("zz",)], "geo_location string")
    labels = spark.createDataFrame(
        [("a", True, False, False), ("a", False, False, True), ("b", False, True, False)],
        "geo_location string, is_bot boolean, is_hub boolean, is_organic boolean")
    out = ann.annotate(log, labels)
    assert out.count() == 5
    assert out.filter("is_organic").count() == 2 and out.filter("is_bot").count() == 2
    keys = ann.keys_of(labels, "bot")
    assert ann.without(log, keys).count() == 2          # NULL location is dropped
    assert ann.annotate_from_keys(log, keys, ann.keys_of(labels, "hub")).count() == 5
    with pytest.raises(ValueError):
        ann.filter_log(log, labels, "other")


def test_label_validation(spark, tmp_path):
    good = spark.createDataFrame([("a", "bot", "train")],
                                 "geo_location string, label string, split string")
    path = str(tmp_path / "gold")
    good.write.option("header", True).csv(path)
    assert src.read_labels(spark, path).collect() == good.collect()
    with pytest.raises(ValueError, match="lacks"):
        src.validate_labels(good.drop("split"))
    with pytest.raises(ValueError, match="unknown labels"):
        src.validate_labels(good.withColumn("label", F.lit("alien")))


def test_metadata_json(spark, tmp_path):
    file = tmp_path / "meta.json"
    file.write_text('[{"accession": "P1", "title": "T", "submissionDate": "2020"},\n'
                    '{"accession": "P9", "title": "U"}]')
    top = spark.createDataFrame([("P1", 5), ("P2", 3)], "accession string, downloads int")
    out = src.with_metadata(top, src.read_metadata(spark, str(file)))
    assert {r.accession: r.title for r in out.collect()} == {"P1": "T", "P2": None}
