"""Learned labels: calibrated three-class boosting, isolation forest and importances (MLlib)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, LogisticRegression,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.functions.columns import LOC
from logtide.functions.ranks import quantiles, sliced_row_number
from logtide.operators.rules import (RuleSet, boolean_labels, demote_suspicious_hubs,
                                     protect_hubs)
from logtide.operators.seeds import (SeedRules, bot_seeds, hub_seeds, inject_labels,
                                     organic_seeds, resolve_overlaps)
from logtide.session import materialise, shared_path

# Fixed model inputs.
MODEL_FEATURES = [
    "unique_users", "downloads_per_user", "total_downloads", "working_hours_ratio",
    "night_activity_ratio", "hourly_entropy", "burst_pattern_score", "user_coordination_score",
    "spike_ratio", "fraction_latest_year", "year_over_year_cv", "years_span",
    "protocol_legitimacy_score", "aspera_ratio", "globus_ratio", "regularity_score",
    "file_diversity_ratio", "bot_composite_score", "user_scarcity_score",
    "download_concentration", "temporal_irregularity", "request_velocity", "access_regularity",
    "weekend_weekday_imbalance", "user_entropy", "user_gini_coefficient",
    "single_download_user_ratio", "power_user_ratio", "session_duration_cv",
    "inter_session_regularity", "momentum_score", "recent_activity_ratio", "unique_projects",
    "top_project_concentration", "top3_project_concentration", "project_hhi",
]
CLASSES = ("organic", "bot", "hub")
FITS = 4  # folds, and classes of a fold, that are fitted at the same time


@dataclass(frozen=True)
class BoostingParams:
    """Boosting and calibration settings; the defaults are production values."""

    rounds: int = 200
    depth: int = 5
    step: float = 0.1
    subsample: float = 0.8
    min_leaf: int = 10
    folds: int = 5
    seed: int = 42


def complete_cases(locations: DataFrame, columns: list[str]) -> DataFrame:
    """Rows where every present model feature is known."""
    return locations.dropna(subset=[c for c in columns if c in locations.columns])


def feature_matrix(locations: DataFrame, columns: list[str] = MODEL_FEATURES) -> DataFrame:
    """Present features as doubles; NULL, NaN and infinities become 0."""
    present = [c for c in columns if c in locations.columns]
    if not present:
        raise ValueError("none of the model features is in the location table")

    def clean(name: str) -> Column:
        x = F.col(name).cast("double")
        bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        return F.when(bad, 0.0).otherwise(x).alias(name)
    return locations.select(LOC, *[clean(c) for c in present])


def assembled(locations: DataFrame, columns: list[str] = MODEL_FEATURES) -> DataFrame:
    matrix = feature_matrix(locations, columns)
    names = [c for c in matrix.columns if c != LOC]
    return VectorAssembler(inputCols=names, outputCol="raw").transform(matrix).select(LOC, "raw")


def balanced_weights(labels: DataFrame) -> DataFrame:
    """Class weights n / (classes x class size)."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    total = sizes.agg(F.struct(F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    return sizes.withColumn("t", total).select(
        "label", (F.col("t.n") / (F.col("t.k") * F.col("c"))).alias("weight"))


@dataclass
class CalibratedModel:
    """One (scaler, boosted model per class, sigmoid per class) per fold."""

    folds: list[tuple[PipelineModel, dict[str, GBTClassificationModel], dict[str, tuple]]]
    features: list[str]

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """Class probabilities of a (location, raw vector) frame, averaged over the folds."""
        out = rows
        for i, (scaler, models, sigmoids) in enumerate(self.folds):
            out = scaler.transform(out)
            scores = {}
            for name, model in models.items():
                raw = f"margin_{name}"
                out = model.copy({model.rawPredictionCol: raw, model.probabilityCol: "",
                                  model.predictionCol: ""}).transform(out)
                a, b = sigmoids[name]
                margin = vector_to_array(raw)[1]
                scores[name] = 1 / (1 + F.exp(-(margin * a + b)))
            total = reduce(lambda x, y: x + y, scores.values())
            out = out.withColumn(f"fold{i}", F.array(*[
                scores[c] / total if c in scores else F.lit(0.0) for c in CLASSES]))
            out = out.drop("features", *[f"margin_{n}" for n in models])
        k = len(self.folds)
        mean = [reduce(lambda x, y: x + y, [F.col(f"fold{i}")[j] for i in range(k)]) / k
                for j in range(len(CLASSES))]
        return out.select(LOC, *[m.alias(f"prob_{c}") for m, c in zip(mean, CLASSES)])

    def importances(self) -> list[tuple[str, float]]:
        """Mean importance over folds and classes, highest first."""
        total = np.zeros(len(self.features))
        count = 0
        for _, models, _ in self.folds:
            for model in models.values():
                total += model.featureImportances.toArray()
                count += 1
        pairs = zip(self.features, (total / max(count, 1)).tolist())
        return sorted(pairs, key=lambda p: (-p[1], p[0]))


def _fit_fold(train: DataFrame, held_out: DataFrame, present: list[str], params: BoostingParams):
    scaler = PipelineModel([StandardScaler(inputCol="raw", outputCol="features", withMean=True)
                            .fit(train)])
    train, held_out = scaler.transform(train).cache(), scaler.transform(held_out)
    try:
        models, sigmoids = _fit_classes(train, held_out, present, params)
    finally:
        train.unpersist()
    return scaler, models, sigmoids


def _side_by_side(fit: Callable, keys: Iterable) -> list:
    """Results of independent fits; each is a chain of small jobs that leaves executors idle otherwise."""
    with ThreadPoolExecutor(FITS) as pool:
        return list(pool.map(fit, keys))


def _fit_classes(train: DataFrame, held_out: DataFrame, present: list[str], params: BoostingParams):
    def fit(name: str):
        target = (F.col("label") == name).cast("double")
        gbt = GBTClassifier(featuresCol="features", labelCol="y", weightCol="weight",
                            maxIter=params.rounds, maxDepth=params.depth, stepSize=params.step,
                            subsamplingRate=params.subsample,
                            minInstancesPerNode=params.min_leaf, seed=params.seed)
        model = gbt.fit(train.withColumn("y", target))
        margins = model.transform(held_out.withColumn("y", target)).select(
            "y", "weight", F.array(vector_to_array("rawPrediction")[1]).alias("m"))
        platt = LogisticRegression(featuresCol="v", labelCol="y", weightCol="weight").fit(
            margins.select("y", "weight", array_to_vector("m").alias("v")))
        return model, (float(platt.coefficients[0]), float(platt.intercept))
    fitted = dict(zip(present, _side_by_side(fit, present)))
    return {c: m for c, (m, _) in fitted.items()}, {c: s for c, (_, s) in fitted.items()}


def train_calibrated(labelled: DataFrame, params: BoostingParams = BoostingParams(),
                     features: list[str] = MODEL_FEATURES) -> CalibratedModel:
    """Boosting per class with sigmoid calibration over folds.

    ``labelled``: location table with ``label`` and ``weight``. The training rows are labelled
    locations only; weights reach both the trees and the calibration.
    """
    names = [c for c in features if c in labelled.columns]
    keep = labelled.select(LOC, "label", "weight")
    fold = F.pmod(F.xxhash64(LOC, F.lit(params.seed)), F.lit(params.folds))
    rows = materialise(assembled(labelled, names).join(keep, LOC).withColumn("fold", fold),
                       "training")
    present = [r["label"] for r in rows.select("label").distinct().orderBy("label").collect()]
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:  # boosting cuts its lineage there every few rounds
        context.setCheckpointDir(shared_path(rows.sparkSession, "boosting"))
    folds = _side_by_side(lambda i: _fit_fold(
        rows.filter(F.col("fold") != i), rows.filter(F.col("fold") == i), present, params), range(params.folds))
    return CalibratedModel(folds, names)


def predict(model: CalibratedModel, locations: DataFrame) -> DataFrame:
    """Most probable class, its probability and the three class probabilities per location."""
    probs = model.probabilities(assembled(locations, model.features))
    best = F.greatest(*[f"prob_{c}" for c in CLASSES])
    label = F.when(F.col("prob_organic") == best, "organic") \
        .when(F.col("prob_bot") == best, "bot").otherwise("hub")
    return probs.withColumns({"predicted_label": label, "classification_confidence": best})


def map_labels(df: DataFrame, review_below: float = 0.5) -> DataFrame:
    """Predicted classes to user category, behaviour, automation category and review flag."""
    label = F.col("predicted_label")
    small = (F.col("unique_users") <= 10) & (F.col("downloads_per_user") <= 5)
    return df.withColumns({
        "user_category": F.when(label == "bot", "bot").when(label == "hub", "download_hub")
        .when(small, "independent_user").otherwise("normal"),
        "behavior_type": F.when(label == "organic", "user").otherwise(label),
        "automation_category": F.when(label == "bot", "bot")
        .when(label == "hub", "legitimate_automation"),
        "needs_review": F.col("classification_confidence") < review_below,
    })


def finalise(df: DataFrame, least: int = 3) -> DataFrame:
    """Locations with hardly any downloads carry no evidence; then the boolean labels."""
    thin = F.coalesce(F.col("total_downloads") < least, F.lit(False))
    return boolean_labels(df.withColumns({
        "behavior_type": F.when(thin, "insufficient_evidence").otherwise(F.col("behavior_type")),
        "automation_category": F.when(~thin, F.col("automation_category")),
    }), organic_value="user")


def gold_rows(locations: DataFrame, gold: DataFrame, split: str) -> DataFrame:
    """Locations of one gold split; a location listed more than once counts once."""
    first = Window.partitionBy(LOC).orderBy("label")
    wanted = (gold.filter(F.col("split") == split)
              .withColumn("r", F.row_number().over(first)).filter("r = 1")
              .select(LOC, "label"))
    return locations.join(wanted, LOC)


def classify_learned(locations: DataFrame, gold: DataFrame | None = None,
                     corrections: DataFrame | None = None,
                     params: BoostingParams = BoostingParams(), rules: RuleSet = RuleSet(),
                     seed_rules: SeedRules = SeedRules()) -> tuple[DataFrame, CalibratedModel]:
    """Label every location with a trained model.

    With ``gold`` labels the training split is used with balanced class weights; otherwise the
    heuristic seeds (plus ``corrections``) with their confidences.
    """
    table = materialise(locations, "locations")
    if gold is not None:
        train = gold_rows(table, gold, "train")
        train = train.join(balanced_weights(train), "label")
    else:
        seeds = resolve_overlaps(organic_seeds(table, seed_rules), bot_seeds(table, seed_rules),
                                 hub_seeds(table, seed_rules))
        if corrections is not None:
            seeds = inject_labels(seeds, table, corrections)
        train = table.join(seeds.withColumnRenamed("seed_confidence", "weight"), LOC)
    model = train_calibrated(train, params)
    labelled = map_labels(table.join(predict(model, table), LOC))
    labelled = demote_suspicious_hubs(protect_hubs(labelled, rules), rules)
    return finalise(labelled), model


# ------------------------------------------------------------------ isolation forest

_EULER = 0.5772156649015329
_NODES = "tree int, node int, feature int, threshold double, left int, right int, size double"


def _path_norm(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (np.log(n - 1.0) + _EULER) - 2.0 * (n - 1.0) / n


def _grow(pdf: pd.DataFrame) -> pd.DataFrame:
    """One random tree over its sample (at most the subsample size) as a node table."""
    tree = int(pdf["tree"].iloc[0])
    x = np.array(pdf.sort_values("h")["f"].tolist(), dtype=float)
    rng = np.random.default_rng(tree)
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes, stack = [], [(0, np.arange(len(x)), 0)]
    used = 1
    while stack:
        node, rows, depth = stack.pop()
        part = x[rows]
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) else []
        if depth >= limit or len(rows) <= 1 or len(spread) == 0:
            nodes.append((tree, node, -1, 0.0, -1, -1, float(len(rows))))
            continue
        j = int(rng.choice(spread))
        cut = float(rng.uniform(part[:, j].min(), part[:, j].max()))
        left, right = used, used + 1
        used += 2
        nodes.append((tree, node, j, cut, left, right, float(len(rows))))
        stack.append((left, rows[part[:, j] <= cut], depth + 1))
        stack.append((right, rows[part[:, j] > cut], depth + 1))
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right",
                                        "size"])


def isolation_scores(locations: DataFrame, columns: list[str], contamination: float = 0.15,
                     trees: int = 200, subsample: int = 256) -> DataFrame:
    """Anomaly score (higher is stranger) and flag per location.

    Each tree sees its own sample of at most ``subsample`` locations; the forest is at most
    trees x (2 x subsample - 1) nodes, which bounds what is broadcast. Splits are drawn
    between a feature's extremes, so scaling the features would change nothing.
    """
    matrix = feature_matrix(locations, columns)
    names = [c for c in matrix.columns if c != LOC]
    rows = materialise(matrix.select(LOC, F.array(*names).alias("f")), "isolation")
    n = rows.count()
    # Bernoulli draw with a margin, then an exact cut; far fewer than rows x trees pairs arise.
    rate = min(1.0, (subsample + 6 * subsample ** 0.5) / max(n, 1))
    span = 1 << 30
    hit = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(
        F.xxhash64(F.col(LOC), t), F.lit(span)) < int(rate * span))
    drawn = rows.select(F.explode(hit).alias("tree"), LOC, "f") \
        .withColumn("h", F.xxhash64(F.lit(7), LOC, "tree"))
    sample = (drawn.withColumn("r", F.row_number().over(
        Window.partitionBy("tree").orderBy("h"))).filter(F.col("r") <= subsample))
    forest = sample.select("tree", "h", "f").groupBy("tree").applyInPandas(_grow, _NODES)
    table = forest.toPandas()
    spark = locations.sparkSession
    packed = [g.sort_values("node")[["feature", "threshold", "left", "right", "size"]].to_numpy()
              for _, g in table.groupby("tree")]
    shared = spark.sparkContext.broadcast(packed)
    norm = _path_norm(min(subsample, n))

    def score(batches):
        leaf_extra = [np.array([_path_norm(s) for s in t[:, 4]]) for t in shared.value]
        for pdf in batches:
            x = np.array(pdf["f"].tolist(), dtype=float).reshape(len(pdf), -1)
            depth = np.zeros(len(x))
            for t, extra in zip(shared.value, leaf_extra):
                at = np.zeros(len(x), dtype=int)
                steps = np.zeros(len(x))
                active = t[at, 0] >= 0
                while active.any():
                    idx = np.flatnonzero(active)
                    node = t[at[idx]]
                    go_left = x[idx, node[:, 0].astype(int)] <= node[:, 1]
                    at[idx] = np.where(go_left, node[:, 2], node[:, 3]).astype(int)
                    steps[idx] += 1
                    active[idx] = t[at[idx], 0] >= 0
                depth += steps + extra[at]
            yield pd.DataFrame({LOC: pdf[LOC], "strangeness": 2.0 ** (
                -depth / len(shared.value) / max(norm, 1e-12))})

    scored = materialise(rows.mapInPandas(score, f"{LOC} string, strangeness double"), "scores")
    cut = quantiles(scored, "strangeness", {"cut": 1 - contamination}).select("cut").scalar()
    diff = F.col("strangeness") - cut
    return scored.select(LOC, diff.alias("anomaly_score"), (diff > 0).alias("is_anomaly"))


# ------------------------------------------------------------------ importances

def _forest(rows: DataFrame, trees: int, depth: int, leaf: int,
            seed: int) -> RandomForestClassificationModel:
    return RandomForestClassifier(featuresCol="raw", labelCol="y", weightCol="weight",
                                  numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf,
                                  seed=seed).fit(rows)


def _surrogate_rows(locations: DataFrame, columns: list[str], label: Column) -> DataFrame:
    target = locations.select(LOC, label.cast("double").alias("y"))
    rows = assembled(locations, columns).join(target, LOC)
    share = rows.agg(F.avg("y")).scalar()
    balanced = F.when(F.col("y") == 1, F.try_divide(F.lit(0.5), share)) \
        .otherwise(F.try_divide(F.lit(0.5), 1 - share))
    return materialise(rows.withColumn("weight", F.coalesce(balanced, F.lit(1.0))), "surrogate")


def surrogate_importances(locations: DataFrame, columns: list[str], label: Column,
                          trees: int = 300, repeats: int = 5, depth: int = 20,
                          seed: int = 42) -> DataFrame:
    """Impurity importance and mean AUC drop when one feature is permuted.

    A permutation pairs every location with another one by joining two random ranks; all
    features of one repeat share it. Where all labels are equal there is nothing to tell apart:
    no split is made, no permutation changes a prediction, and both measures are 0.
    """
    spark = locations.sparkSession
    names = [c for c in columns if c in locations.columns]
    rows = _surrogate_rows(locations, names, label)
    if rows.select("y").distinct().count() < 2:
        return spark.createDataFrame([(c, 0.0, 0.0) for c in names],
                                     "feature string, gini double, permutation double")
    model = _forest(rows, trees, depth, 1, seed)
    auc = BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="rawPrediction")
    full = auc.evaluate(model.transform(rows))
    drops = {c: 0.0 for c in names}
    for r in range(repeats):
        own = sliced_row_number(rows.withColumn("a", F.xxhash64(LOC, F.lit(2 * r))), [],
                                F.struct("a", LOC), "k")
        other = sliced_row_number(
            rows.select(LOC, F.col("raw").alias("other"),
                        F.xxhash64(LOC, F.lit(2 * r + 1)).alias("a")), [],
            F.struct("a", LOC), "k").select("k", "other")
        paired = materialise(own.join(other, "k").select("raw", "other", "y"), "permuted")
        for j, c in enumerate(names):
            mine, theirs = vector_to_array("raw"), vector_to_array("other")
            mixed = F.transform(mine, lambda x, i: F.when(i == j, theirs[j]).otherwise(x))
            permuted = paired.select(array_to_vector(mixed).alias("raw"), "y")
            drops[c] += (full - auc.evaluate(model.transform(permuted))) / repeats
    gini = model.featureImportances.toArray()
    return spark.createDataFrame(
        [(c, float(g), float(drops[c])) for c, g in zip(names, gini)],
        "feature string, gini double, permutation double")


# Fixed grouping of features for the usage check.
BEHAVIOURAL = [
    "hourly_entropy", "working_hours_ratio", "request_velocity", "burst_pattern_score",
    "circadian_rhythm_deviation", "user_coordination_score", "regularity_score",
    "file_diversity_ratio", "access_regularity", "spike_intensity", "user_peak_ratio",
    "night_ratio", "work_ratio", "hourly_cv", "hourly_cv_burst", "night_ratio_advanced",
    "work_ratio_advanced", "evening_ratio", "morning_ratio", "temporal_irregularity",
    "weekend_weekday_imbalance", "users_per_active_hour", "year_over_year_cv", "years_span",
    "years_before_latest", "yearly_entropy", "peak_hour_concentration",
    "peak_year_concentration", "spike_ratio", "is_mechanical", "is_weekday_biased", "is_bursty",
    "is_bursty_advanced", "is_nocturnal", "is_coordinated",
]
VOLUME_RULE = ["unique_users", "downloads_per_user", "total_downloads", "max_users_per_hour",
               "downloads_per_year", "projects_per_user"]


def feature_usage(locations: DataFrame, columns: list[str], label: Column,
                  trees: int = 100, depth: int = 10, target: float = 0.7) -> DataFrame:
    """Share of a forest's importance on behavioural and on volume features."""
    names = [c for c in columns if c in locations.columns]
    model = _forest(_surrogate_rows(locations, names, label), trees, depth, 5, 42)
    weights = dict(zip(names, model.featureImportances.toArray().tolist()))
    behavioural = sum(w for c, w in weights.items() if c in BEHAVIOURAL)
    volume = sum(w for c, w in weights.items() if c in VOLUME_RULE)
    total = behavioural + volume
    share = behavioural / total if total > 0 else 0.0
    return locations.sparkSession.createDataFrame(
        [(behavioural, volume, share, share >= target)],
        "behavioural double, volume double, behavioural_share double, passes boolean")
