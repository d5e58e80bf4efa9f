"""Models, grouping, sinks, evaluation and whole runs."""

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from logtide import catalogue
from logtide.operators import learned, proximity
from logtide.plans import annotation_text as texts
from logtide.plans import evaluation as ev
from logtide.plans import reports
from logtide.plans.run import RunConfig, run
from logtide.schema import LogSchema, get_schema, register_schema, schema_names
from logtide.sources import sinks


def classes(n_bot=60, n_hub=15, n_organic=25, seed=0):
    """Three separable classes over five features."""
    r = np.random.default_rng(seed)
    spec = {"bot": (n_bot, (50, 200), (1, 5), (.2, .4), (.3, .5), (2.5, 3.5)),
            "hub": (n_hub, (1, 20), (200, 1000), (.3, .6), (.1, .3), (1.5, 2.5)),
            "organic": (n_organic, (1, 10), (3, 30), (.3, .6), (.1, .4), (.5, 1.5))}
    names = ["unique_users", "downloads_per_user", "working_hours_ratio", "night_activity_ratio",
             "hourly_entropy"]
    frames = [pd.DataFrame({c: r.uniform(*b, n) for c, b in zip(names, bounds)} | {"label": k})
              for k, (n, *bounds) in spec.items()]
    out = pd.concat(frames, ignore_index=True)
    out.insert(0, "geo_location", [f"g{i}" for i in range(len(out))])
    out["weight"] = 1.0
    return out


def test_boosting_separates_classes(spark):
    df = spark.createDataFrame(classes())
    params = learned.BoostingParams(rounds=5, depth=2, min_leaf=2, folds=2)
    model = learned.train_calibrated(df, params)
    out = learned.predict(model, df).join(df.select("geo_location", "label"), "geo_location")
    got = out.toPandas()
    assert (got["predicted_label"] == got["label"]).mean() > 0.7
    total = got[["prob_bot", "prob_hub", "prob_organic"]].sum(axis=1)
    assert total.between(1 - 1e-9, 1 + 1e-9).all() and (got["classification_confidence"] > 0).all()
    hubs = got[got["label"] == "hub"]
    assert (hubs["predicted_label"] == "hub").mean() > 0.3
    assert sum(w for _, w in model.importances()) == pytest.approx(1, abs=0.05)


def test_fold_keeps_its_scaler_and_passes_errors_on(spark, monkeypatch):
    rows = [(f"l{i}", float(i), "bot" if i % 2 else "organic", 1.0, i % 4) for i in range(40)]
    df = learned.assembled(
        spark.createDataFrame(rows, "geo_location string, unique_users double, label string, "
                                    "weight double, part int"), ["unique_users"])
    df = df.join(spark.createDataFrame(rows, "geo_location string, unique_users double, label string, "
                                             "weight double, part int"), "geo_location")
    train, held_out = df.filter("part > 0"), df.filter("part = 0")
    params = learned.BoostingParams(rounds=1, depth=1, min_leaf=1, folds=2)
    held = spark.sparkContext._jsc.getPersistentRDDs
    before = len(held())
    scaler, models, sigmoids = learned._fit_fold(train, held_out, ["bot", "organic"], params)
    assert "features" in scaler.transform(held_out).columns
    assert sorted(models) == sorted(sigmoids) == ["bot", "organic"]

    def broken(*_):
        raise ArithmeticError("fit")
    monkeypatch.setattr(learned, "_fit_classes", broken)
    with pytest.raises(ArithmeticError):
        learned._fit_fold(train, held_out, ["bot"], params)
    assert len(held()) == before


def test_isolation_finds_the_outlier(spark):
    rng = np.random.default_rng(5)
    x = pd.DataFrame(rng.normal(0, 1, (400, 2)), columns=["unique_users", "hourly_entropy"])
    x.loc[0] = [30.0, -30.0]
    x.insert(0, "geo_location", [f"g{i}" for i in range(len(x))])
    df = spark.createDataFrame(x)
    got = learned.isolation_scores(df, ["unique_users", "hourly_entropy"], 0.05, trees=40).toPandas()
    assert got.sort_values("anomaly_score").iloc[-1]["geo_location"] == "g0"
    assert abs(got["is_anomaly"].mean() - 0.05) < 0.01


def brute_groups(points, km):
    leaders, out = [], {}
    for geo, country, rank in sorted(points, key=lambda p: p[2]):
        lat, lon = map(float, geo.split(","))
        for g, c, a, b in leaders:
            h = math.sin(math.radians(a - lat) / 2) ** 2 + math.cos(math.radians(a)) * \
                math.cos(math.radians(lat)) * math.sin(math.radians(b - lon) / 2) ** 2
            if c == country and 2 * 6371 * math.asin(math.sqrt(h)) <= km:
                out[geo] = g
                break
        else:
            leaders.append((geo, country, lat, lon))
            out[geo] = geo
    return out


def test_proximity_matches_sequential_greedy(spark):
    rng = np.random.default_rng(2)
    pts, seen = [], set()
    for lat0, lon0 in ((50, 8), (0.01, 179.99), (-0.02, -179.98), (89.95, 10)):
        for _ in range(60):
            geo = f"{lat0 + rng.normal(0, .1):.3f},{((lon0 + rng.normal(0, .15) + 180) % 360) - 180:.3f}"
            if geo not in seen:
                seen.add(geo)
                pts.append((geo, "A" if rng.random() < .6 else "B"))
    pts = [(g, c, int(r)) for (g, c), r in zip(pts, rng.permutation(len(pts)))]
    df = spark.createDataFrame(pts, "geo_location string, country string, rank bigint")
    got = {r.geo_location: r.leader_location for r in proximity.proximity_groups(df).collect()}
    assert got == brute_groups(pts, 10)


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "log.parquet")
    spark.range(5).write.parquet(path)
    log = spark.read.parquet(path).withColumn("is_bot", F.col("id") > 2)
    assert sinks.write_annotated(log, path, "reports_only") is None
    assert sinks.write_annotated(log, path, "new_file", sampled=True) is None
    assert sinks.write_annotated(log, path, "new_file") == str(tmp_path / "log_annotated.parquet")
    assert sinks.write_annotated(log, path, "overwrite") == path
    assert spark.read.parquet(path).filter("is_bot").count() == 2
    with pytest.raises(ValueError):
        sinks.write_annotated(log, path, "other")
    nested = spark.range(1).select(F.array(F.lit(1.0)).alias("a"))
    out = sinks.write_locations(nested, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(out).first()[0] == "[1.0]"


def pairs(spark, rows):
    return spark.createDataFrame(rows, "pred string, truth string")


def test_metrics_and_kappa(spark):
    p = pairs(spark, [("bot", "bot")] * 3 + [("user", "bot")] + [("user", "user")] * 4)
    cells = ev.confusion(p)
    m = {r["class"]: r for r in ev.class_metrics(cells).collect()}
    assert (m["bot"].tp, m["bot"].fn, m["bot"].fp) == (3, 1, 0)
    assert m["bot"].precision == 1 and m["bot"].recall == 0.75 and m["hub"].f1 == 0
    k = ev.kappa(cells).first()
    assert k.kappa == pytest.approx((7 / 8 - .5) / .5)
    same = ev.kappa(ev.confusion(pairs(spark, [("bot", "bot")] * 3))).first()
    assert same.kappa == 1


def test_bootstrap_brackets_the_estimate(spark):
    rng = np.random.default_rng(0)
    labels = np.array(["bot", "hub", "user"])
    truth = labels[rng.integers(0, 3, 600)]
    pred = np.where(rng.random(600) < .8, truth, labels[rng.integers(0, 3, 600)])
    cells = ev.confusion(pairs(spark, list(zip(pred.tolist(), truth.tolist()))))
    ci = ev.bootstrap_macro_f1(cells).first()
    f1 = ev.macro_metrics(cells).first().f1
    assert ci.lower < f1 < ci.upper and abs(ci.mean - f1) < 0.01 and ci.upper - ci.lower < 0.12


def test_mcnemar(spark):
    rows = [("bot", "user", "bot")] * 10 + [("user", "bot", "bot")] * 4 + [("bot", "bot", "bot")]
    t = spark.createDataFrame(rows, "first string, second string, truth string")
    r = ev.with_p_value(ev.mcnemar(t)).first()
    assert (r.first_only, r.second_only, r.both_correct) == (10, 4, 1)
    assert r.chi2 == pytest.approx(25 / 14)
    assert r.p_value == pytest.approx(math.erfc(math.sqrt(25 / 28)))


def test_split_shares(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 700, "hot").otherwise("cold")
                                    .alias("zone"))
    out = ev.stratified_split(rows, "zone", "id").groupBy("zone", "split").count().collect()
    got = {(r.zone, r.split): r["count"] for r in out}
    assert got[("hot", "test")] == 231 and got[("cold", "test")] == 99


def test_responses(spark):
    df = spark.createDataFrame([
        ("label: Bot\nConfidence: HIGH\nREASONING: many\nlines\n\nrest",), ("LABEL: user",),
        ("nothing",)], "text string")
    got = texts.parse_responses(df).select("label", "confidence", "reasoning").collect()
    assert [tuple(r) for r in got] == [("bot", "high", "many\nlines"), ("organic", None, None),
                                       (None, None, None)]


def test_blind_columns(spark):
    df = spark.range(1).select(F.lit("x").alias("geo_location"), F.lit(True).alias("is_bot"),
                               F.lit(.5).alias("prob_bot"))
    assert texts.blind(df).columns == ["geo_location"]


def test_consolidated_hubs(spark):
    rows = [("10.00,10.00", "A", "a", 1, 10), ("10.01,10.00", "A", "b", 2, 5),
            ("20.00,10.00", "A", "c", 1, 7), ("20.01,10.00", "%{x}", "d", 1, 7)]
    df = spark.createDataFrame(rows, "geo_location string, country string, city string, "
                                     "unique_users int, total_downloads int") \
        .withColumn("is_hub", F.lit(True))
    got = {r.leader_location: r for r in reports.consolidated_hubs(df).collect()}
    assert set(got) == {"10.00,10.00", "20.00,10.00"}
    assert got["10.00,10.00"].num_locations == 2 and got["10.00,10.00"].cities == "a, b"
    assert got["10.00,10.00"].downloads_per_user == 5


def test_schema_registry():
    custom = LogSchema(min_year=2000).with_options(user_field="who")
    register_schema("mine", custom)
    assert get_schema("mine") == custom and "mine" in schema_names()
    assert LogSchema.from_dict(custom.to_dict()) == custom
    # Changing one option keeps the protocol field.
    assert get_schema("archive").with_options(min_location_downloads=5).method_field == "method"
    with pytest.raises(ValueError):
        get_schema("nope")


def test_run_rules(spark, tmp_path):
    rng = np.random.default_rng(9)
    t0 = datetime(2023, 1, 1)
    rows = [(f"{k}.0,{k}.0", "Land", f"town{k}", f"u{rng.integers(0, 5 + k)}",
             f"P{rng.integers(0, 9)}", f"file{rng.integers(0, 20)}.raw",
             "fasp-aspera" if k == 2 else "http",
             t0 + timedelta(minutes=int(m)))
            for k in range(6) for m in rng.integers(0, 500_000, 80)]
    log = spark.createDataFrame(rows, "geo_location string, country string, "
                                "geoip_city_name string, user string, accession string, "
                                "filename string, method string, timestamp timestamp")
    path = str(tmp_path / "log.parquet")
    log.write.parquet(path)
    groups = ["time_of_day", "yearly_pattern", "protocol_mix", "project_concentration",
              "interval_regularity", "burst_pattern"]
    result = run(spark, path, RunConfig(groups=groups, anomaly=False), str(tmp_path / "out"))
    written = spark.read.parquet(result.output_path)
    assert written.count() == len(rows)
    assert set(log.columns) | {"is_bot", "is_hub", "is_organic"} == set(written.columns)
    assert result.locations.count() == 6
    hub = result.locations.filter("geo_location = '2.0,2.0'").first()
    assert hub.is_hub and hub.is_protected_hub
    total = result.reports["run_totals"].first()
    assert total.total == len(rows) and total.bots + total.hubs + total.normal == total.total
    sampled = run(spark, path, RunConfig(groups=["time_of_day"], anomaly=False, sample_size=100))
    assert sampled.output_path is None
    assert sampled.reports["run_totals"].first().total == 100


def test_every_query_has_a_known_name():
    import re
    names = list(catalogue.all_queries())
    assert len(names) > 180 and all(re.fullmatch(r"[a-z]+\d*_[a-z0-9_]+", n) for n in names)


def test_concentration_and_lorenz(spark):
    from logtide.plans import analytics as an
    rng = np.random.default_rng(4)
    x = np.sort(rng.geometric(0.2, 537))
    counts = spark.createDataFrame([(f"d{i}", int(v)) for i, v in enumerate(x)],
                                   "accession string, downloads bigint")
    c = an.concentration(counts).first()
    n, i = len(x), np.arange(1, len(x) + 1)
    assert c.gini_coefficient == pytest.approx(2 * (i * x).sum() / (n * x.sum()) - (n + 1) / n)
    down = x[::-1]
    assert c.top_1pct_downloads_pct == pytest.approx(down[:5].sum() / x.sum() * 100)
    assert c.top_50pct_downloads_pct == pytest.approx(down[:n // 2].sum() / x.sum() * 100)
    assert (c.median_downloads, c.max_downloads) == (int(np.median(x)), x.max())
    curve = an.lorenz(counts).orderBy("population_fraction").toPandas()
    share = np.concatenate([[0], np.cumsum(x) / x.sum()])
    want = np.interp(np.linspace(0, 1, 101), np.linspace(0, 1, n + 1), share)
    assert len(curve) == 101 and np.allclose(curve["download_fraction"], want)
