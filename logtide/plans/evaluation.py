"""Evaluation of labels. Everything reduces to small count tables before any statistic."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.functions.columns import LOC, ratio, true_only
from logtide.functions.ranks import quantiles

CLASSES = ("bot", "hub", "user")


def _n() -> Column:
    return F.count(F.lit(1))


def unified_label(df: DataFrame) -> DataFrame:
    """bot, hub or user from whichever label columns exist; more specific ones win."""
    def is_(column: str, value: str | None = None) -> Column:
        if column not in df.columns:
            return F.lit(False)
        return true_only(F.col(column) if value is None else F.col(column) == value)
    # In the order of assignment: behaviour, then category, then flags.
    category = F.when(is_("automation_category", "bot"), "bot") \
        .when(is_("automation_category", "legitimate_automation"), "hub")
    behaviour = F.when(is_("behavior_type", "bot"), "bot").when(is_("behavior_type", "hub"), "hub")
    before = F.coalesce(category, behaviour)
    label = F.when(is_("is_bot"), "bot") \
        .when(is_("is_download_hub") & ~true_only(before == "bot"), "hub") \
        .otherwise(F.coalesce(before, F.lit("user")))
    return df.withColumn("label", label)


def align(predictions: DataFrame, truth: DataFrame, default: str = "user") -> DataFrame:
    """(location, pred, truth) for every location of the truth; unpredicted ones get a default."""
    p = predictions.select(LOC, F.col("label").alias("pred"))
    t = truth.select(LOC, F.col("label").alias("truth"))
    return t.join(p, LOC, "left").withColumn("pred", F.coalesce("pred", F.lit(default)))


def confusion(pairs: DataFrame, *keys: str) -> DataFrame:
    return pairs.groupBy(*keys, "pred", "truth").agg(_n().alias("n"))


def class_metrics(cells: DataFrame, classes: tuple[str, ...] = CLASSES,
                  *keys: str) -> DataFrame:
    """Per class tp, fp, fn, tn, precision, recall, F1 and accuracy from confusion counts."""
    rows = cells.withColumn("class", F.explode(F.array(*[F.lit(c) for c in classes])))
    p, t, n = F.col("pred") == F.col("class"), F.col("truth") == F.col("class"), F.col("n")

    def count(cond: Column) -> Column:
        return F.sum(F.when(cond, n).otherwise(0))
    agg = rows.groupBy(*keys, "class").agg(
        count(p & t).alias("tp"), count(p & ~t).alias("fp"), count(~p & t).alias("fn"),
        count(~p & ~t).alias("tn"), F.sum("n").alias("total"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision, recall = ratio(tp, tp + fp, 0), ratio(tp, tp + fn, 0)
    out = agg.withColumns({"precision": precision, "recall": recall,
                           "accuracy": ratio(tp + F.col("tn"), F.col("total"), 0)})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0)
    return out.withColumn("f1", f1)


def macro_metrics(cells: DataFrame, classes: tuple[str, ...] = CLASSES,
                  *keys: str) -> DataFrame:
    macro = class_metrics(cells, classes, *keys).groupBy(*keys).agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"))
    right = F.sum(F.when(F.col("pred") == F.col("truth"), F.col("n")).otherwise(0))
    accuracy = cells.groupBy(*keys).agg(ratio(right, F.sum("n"), 0).alias("accuracy"))
    if keys:
        return macro.join(accuracy, list(keys))
    return macro.withColumn("accuracy", accuracy.select("accuracy").scalar())


def bootstrap_macro_f1(cells: DataFrame, classes: tuple[str, ...] = CLASSES,
                       resamples: int = 1000, seed: int = 42) -> DataFrame:
    """Percentile interval of macro F1.

    Drawing n pairs with replacement is a multinomial draw over the confusion cells, so the
    resampling needs the cell counts alone (one short array), not the pairs.
    """
    k = len(classes)
    cell_of = {(a, b): i for i, (a, b) in enumerate((a, b) for a in classes for b in classes)}
    n = F.col("n")
    counts = cells.agg(F.array(*[
        F.coalesce(F.sum(F.when((F.col("pred") == a) & (F.col("truth") == b), n)), F.lit(0))
        for a, b in cell_of]).alias("cells"))

    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf["cells"]:
                c = np.asarray(row, dtype=float)
                total = int(c.sum())
                rng = np.random.default_rng(seed)
                draw = rng.multinomial(total, c / max(total, 1), resamples).reshape(-1, k, k)
                tp = np.einsum("rii->ri", draw).astype(float)
                both = draw.sum(axis=2) + draw.sum(axis=1)
                f1 = np.divide(2 * tp, both, out=np.zeros_like(tp), where=both > 0).mean(axis=1)
                yield pd.DataFrame({"lower": [np.percentile(f1, 2.5)],
                                    "upper": [np.percentile(f1, 97.5)],
                                    "mean": [f1.mean()], "std": [f1.std()]})
    return counts.mapInPandas(resample, "lower double, upper double, mean double, std double")


def agreement(cells: DataFrame, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """Overall agreement and, per class, shared over either (1 when neither uses it)."""
    rows = cells.withColumn("class", F.explode(F.array(*[F.lit(c) for c in classes])))
    a, b, n = F.col("pred") == F.col("class"), F.col("truth") == F.col("class"), F.col("n")
    both = F.sum(F.when(a & b, n).otherwise(0))
    either = F.sum(F.when(a | b, n).otherwise(0))
    same = F.sum(F.when(F.col("pred") == F.col("truth"), n).otherwise(0))
    return rows.groupBy("class").agg(ratio(both, either, 1).alias("jaccard"),
                                     ratio(same, F.sum("n")).alias("overall"))


def kappa(cells: DataFrame) -> DataFrame:
    """Cohen's kappa from the marginals; 1 when chance agreement is already 1."""
    n = F.col("n")
    sides = cells.select(F.explode(F.array(
        F.struct(F.col("pred").alias("c"), n.alias("p"), F.lit(0).cast("bigint").alias("t")),
        F.struct(F.col("truth").alias("c"), F.lit(0).cast("bigint").alias("p"), n.alias("t")),
    )).alias("m")).select("m.*")
    marginal = sides.groupBy("c").agg(F.sum("p").alias("p"), F.sum("t").alias("t"))
    expected = marginal.agg(F.sum(F.col("p").cast("double") * F.col("t"))
                            / (F.sum("p").cast("double") * F.sum("t"))).scalar()
    right = F.sum(F.when(F.col("pred") == F.col("truth"), n).otherwise(0))
    return cells.agg(F.sum("n").alias("n"), ratio(right, F.sum("n")).alias("observed")) \
        .withColumn("expected", expected) \
        .withColumn("kappa", F.when(F.col("expected") >= 1, 1.0).otherwise(F.try_divide(
            F.col("observed") - F.col("expected"), 1 - F.col("expected"))))


def mcnemar(triples: DataFrame) -> DataFrame:
    """Continuity-corrected test of two methods; ``triples`` has first, second and truth."""
    a, b = F.col("first") == F.col("truth"), F.col("second") == F.col("truth")
    counts = triples.agg(
        F.count_if(a & ~b).alias("first_only"), F.count_if(~a & b).alias("second_only"),
        F.count_if(a & b).alias("both_correct"), F.count_if(~a & ~b).alias("both_wrong"))
    off = F.col("first_only") + F.col("second_only")
    diff = F.abs(F.col("first_only") - F.col("second_only")) - 1
    return counts.withColumn("chi2", ratio(diff * diff, off, 0))


def with_p_value(tests: DataFrame) -> DataFrame:
    """p = erfc(sqrt(chi2 / 2)) on the few result rows."""
    @F.pandas_udf("double")
    def erfc(x: pd.Series) -> pd.Series:
        return x.map(lambda c: math.erfc(math.sqrt(c / 2)))
    return tests.withColumn("p_value", erfc("chi2")) \
        .withColumn("significant", F.col("p_value") < 0.05)


def method_comparison(votes: DataFrame, truth: DataFrame) -> DataFrame:
    """Per method: label shares and quality. ``votes``: location, method, label, downloads."""
    total = _n()
    shares = votes.groupBy("method").agg(total.alias("locations"), *[
        F.count_if(F.col("label") == c).alias(f"{c}_locations") for c in CLASSES], *[
        ratio(F.sum(F.when(F.col("label") == c, F.col("total_downloads")).otherwise(0)) * 100,
              F.sum("total_downloads"), 0).alias(f"{c}_dl_pct") for c in CLASSES])
    pairs = truth.select(LOC, F.col("label").alias("truth")).join(
        votes.select(LOC, "method", F.col("label").alias("pred")), LOC)
    cells = confusion(pairs, "method")
    quality = class_metrics(cells, CLASSES, "method").groupBy("method").agg(
        *[F.max(F.when(F.col("class") == c, F.col(m))).alias(f"{c}_{m}")
          for c in CLASSES for m in ("precision", "recall", "f1")],
        F.avg("f1").alias("macro_f1"))
    return shares.join(quality, "method")


def discovery(votes: DataFrame, kinds: tuple[str, ...] = ("bot", "hub")) -> DataFrame:
    """Per class: what all methods, most methods or one method alone found."""
    methods = votes.agg(F.countDistinct("method")).scalar()
    found = votes.filter(F.col("label").isin(*kinds)).groupBy(LOC, "label").agg(
        F.countDistinct("method").alias("k"), F.min("method").alias("m")) \
        .withColumn("methods", methods)
    total = found.groupBy("label").agg(
        F.count_if(F.col("k") == F.col("methods")).alias("consensus"),
        F.count_if(F.col("k") * 2 > F.col("methods")).alias("majority"))
    alone = found.filter(F.col("k") == 1).groupBy("label", F.col("m").alias("method")) \
        .agg(_n().alias("unique_to_method"))
    per = votes.filter(F.col("label").isin(*kinds)).groupBy("label", "method").agg(
        F.countDistinct(LOC).alias("found"))
    return per.join(alone, ["label", "method"], "left").fillna(0, ["unique_to_method"]) \
        .join(total, "label")


def majority_consistency(votes: DataFrame) -> DataFrame:
    """Share of locations where a method agrees with the most common label (ties: smallest)."""
    counts = votes.groupBy(LOC, "label").agg(_n().alias("k"))
    top = counts.groupBy(LOC).agg(F.min(F.struct((-F.col("k")).alias("k"), "label")).alias("t"))
    return votes.join(top.select(LOC, F.col("t.label").alias("majority")), LOC) \
        .groupBy("method").agg(F.avg((F.col("label") == F.col("majority")).cast("double"))
                               .alias("consistency"))


def confidence_statistics(votes: DataFrame) -> DataFrame:
    c = F.col("confidence")
    stats = votes.groupBy("method").agg(
        F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"),
        F.max(c).alias("max"))
    return stats.join(quantiles(votes.select("method", "confidence"), "confidence",
                                {"q25": 0.25, "median": 0.5, "q75": 0.75}, ["method"]), "method")


def download_impact(votes: DataFrame) -> DataFrame:
    """Locations and downloads per method and class with their shares within the method."""
    per = votes.groupBy("method", "label").agg(
        _n().alias("locations"), F.sum("total_downloads").alias("downloads"))
    w = Window.partitionBy("method")
    return per.withColumns({
        "locations_pct": F.col("locations") / F.sum("locations").over(w) * 100,
        "downloads_pct": F.col("downloads") / F.sum("downloads").over(w) * 100})


def annotator_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Labels of two annotators side by side; a location either failed on is left out."""
    a = first.select(LOC, F.col("label").alias("label_a"), F.col("confidence").alias("conf_a"))
    b = second.select(LOC, F.col("label").alias("label_b"), F.col("confidence").alias("conf_b"))
    return a.join(b, LOC).filter(F.col("label_a").isNotNull() & F.col("label_b").isNotNull())


def consensus(pairs: DataFrame) -> DataFrame:
    same = F.col("label_a") == F.col("label_b")
    return pairs.withColumns({
        "consensus_label": F.when(same, F.col("label_a")),
        "agreement": F.when(same, "agree").otherwise("disagree")})


def annotator_agreement(pairs: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """Per class: agreement where either annotator used it, and how often each did."""
    counts = pairs.groupBy("label_a", "label_b").agg(_n().alias("n"))
    rows = counts.withColumn("class", F.explode(F.array(*[F.lit(c) for c in classes])))
    a, b, n = F.col("label_a") == F.col("class"), F.col("label_b") == F.col("class"), F.col("n")

    def count(cond: Column) -> Column:
        return F.sum(F.when(cond, n).otherwise(0))
    return rows.groupBy("class").agg(
        ratio(count(a & b), count(a | b), 0).alias("agreement_rate"),
        count(a).alias("count_a"), count(b).alias("count_b"))


def crosstab(pairs: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    wide = pairs.groupBy("label_a").pivot("label_b", list(classes)).count()
    return wide.select("label_a", *[F.coalesce(F.col(c), F.lit(0)).alias(f"b_{c}")
                                    for c in classes])


def disagreement_patterns(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("label_a") != F.col("label_b")).groupBy(
        F.concat_ws("->", "label_a", "label_b").alias("pattern")).agg(_n().alias("n"))


def stratified_split(rows: DataFrame, zone: str, key: str, test_share: float = 0.33) -> DataFrame:
    """Mark ceil(share x size) rows of every stratum as test, in the order of a key hash.

    Rows are counted per hash prefix and ordered inside a prefix only, so a stratum of any size is
    never sorted as a whole.
    """
    keyed = rows.withColumn("__h", F.md5(F.col(key).cast("string"))) \
        .withColumn("__b", F.substring("__h", 1, 3))
    sizes = keyed.groupBy(zone, "__b").agg(_n().alias("__c"))
    w = Window.partitionBy(zone)
    before = w.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    cuts = sizes.select(zone, "__b", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"),
                        F.ceil(F.sum("__c").over(w) * F.lit(test_share)).alias("__t"))
    inner = Window.partitionBy(zone, "__b").orderBy("__h", key)
    numbered = keyed.withColumn("__r", F.row_number().over(inner)).join(cuts, [zone, "__b"])
    split = F.when(F.col("__r") + F.col("__o") <= F.col("__t"), "test").otherwise("train")
    return numbered.withColumn("split", split).drop("__h", "__b", "__o", "__t", "__r")


def holdout_metrics(predictions: DataFrame, truth: DataFrame,
                    classes: tuple[str, ...]) -> DataFrame:
    """Class metrics on the locations both sides know."""
    pairs = truth.select(LOC, F.col("label").alias("truth")).join(
        predictions.select(LOC, F.col("label").alias("pred")), LOC)
    return class_metrics(confusion(pairs), classes)


def run_delta(baseline: DataFrame, retrained: DataFrame) -> DataFrame:
    """Metric differences per class of two metric tables."""
    names = ("precision", "recall", "f1")
    b = baseline.select("class", *[F.col(m).alias(f"base_{m}") for m in names])
    r = retrained.select("class", *[F.col(m).alias(f"new_{m}") for m in names])
    return b.join(r, "class").withColumns(
        {f"delta_{m}": F.col(f"new_{m}") - F.col(f"base_{m}") for m in names})


def reclassified(baseline: DataFrame, retrained: DataFrame) -> DataFrame:
    a = baseline.select(LOC, F.col("label").alias("a"))
    b = retrained.select(LOC, F.col("label").alias("b"))
    return a.join(b, LOC).agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))
