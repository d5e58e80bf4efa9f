"""A whole run: log -> location features -> labels -> annotated log and report tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.functions.columns import LOC
from logtide.operators import learned, rules
from logtide.operators.annotate import annotate
from logtide.operators.locations import FeatureGroup, location_features
from logtide.operators.rollups import LogViews
from logtide.operators.seeds import SeedRules
from logtide.plans import reports
from logtide.schema import LogSchema, get_schema
from logtide.session import materialise, release_intermediates
from logtide.sources.log import read_log
from logtide.sources.sampling import exact_sample
from logtide.sources.sinks import write_annotated, write_locations, write_summary


@dataclass(frozen=True)
class RunConfig:
    """Options of one run."""

    method: str = "rules"
    contamination: float = 0.15
    sample_size: int | None = None
    min_location_downloads: int | None = None
    annotate: bool = True
    output_strategy: str = "new_file"
    schema: LogSchema = field(default_factory=lambda: get_schema("archive"))
    custom_groups: Sequence[FeatureGroup] = ()
    groups: Sequence[str] | None = None
    anomaly: bool = True
    rules: rules.RuleSet = field(default_factory=rules.RuleSet)
    seed_rules: SeedRules = field(default_factory=SeedRules)
    boosting: learned.BoostingParams = field(default_factory=learned.BoostingParams)


@dataclass
class RunResult:
    """Labelled locations, lazily annotated log, report tables and where the log was written."""

    locations: DataFrame
    annotated: DataFrame
    reports: dict[str, DataFrame]
    output_path: str | None = None
    model: learned.CalibratedModel | None = None

    def release(self) -> None:
        """Delete the stored intermediate tables; the frames of this result cannot be read afterwards."""
        release_intermediates(self.locations.sparkSession)


def label_log(log: DataFrame, config: RunConfig, gold: DataFrame | None = None,
              corrections: DataFrame | None = None) -> RunResult:
    """Label a canonical log. Nothing is written apart from shared intermediate tables."""
    if config.method not in ("rules", "deep"):
        raise ValueError("method must be 'rules' or 'deep'")
    schema = config.schema
    if config.min_location_downloads is not None:
        schema = schema.with_options(min_location_downloads=config.min_location_downloads)
    table = location_features(LogViews(log, schema, durable=True), config.groups,
                              config.custom_groups, durable=True)
    table = learned.complete_cases(table, learned.MODEL_FEATURES)
    if config.anomaly:
        scores = learned.isolation_scores(table, learned.MODEL_FEATURES, config.contamination)
        table = table.join(scores, LOC, "left")
    model = None
    if config.method == "rules":
        labelled = rules.classify_rules(table, config.rules)
    else:
        labelled, model = learned.classify_learned(
            table, gold, corrections, config.boosting, config.rules, config.seed_rules)
    labelled = materialise(rules.final_label(labelled), "labelled")
    tables = {
        "run_totals": reports.run_totals(labelled),
        "classification": reports.classification_counts(labelled),
        "hierarchy": reports.hierarchy_counts(labelled),
        "downloads": reports.download_metrics(labelled),
        "geography": reports.geographic_metrics(labelled),
        "summary": reports.run_summary(labelled, config.method),
        "feature_profile": reports.feature_profile(labelled, [
            c for c in reports.PROFILED if c in labelled.columns]),
        "city_rollup": reports.city_rollup(labelled),
        "hubs": reports.listing(labelled, "hub", "downloads_per_user"),
        "bots": reports.listing(labelled, "bot", "unique_users"),
        "prediction": reports.prediction_summary(labelled),
        "top_bots": reports.top_locations(labelled, F.col("is_bot"), "unique_users", 10),
        "top_hubs": reports.top_locations(labelled, F.col("is_hub"), "downloads_per_user", 10),
    }
    return RunResult(labelled, annotate(log, labelled), tables, model=model)


def run(spark: SparkSession, path: str, config: RunConfig = RunConfig(),
        output_dir: str | None = None, gold: DataFrame | None = None,
        corrections: DataFrame | None = None) -> RunResult:
    """Read a Parquet log, label it and write what the strategy asks for."""
    log = read_log(spark, path, config.schema)
    sampled = config.sample_size is not None
    if sampled:
        log = materialise(exact_sample(log, config.sample_size), "sample")
    # The canonical log names its own columns from here on.
    canonical = config.schema.with_options(
        location_field="geo_location", country_field="country", city_field="city",
        user_field="usr", timestamp_field="ts", year_field="year", project_field="accession")
    result = label_log(log, replace(config, schema=canonical), gold, corrections)
    strategy = config.output_strategy if config.annotate else "reports_only"
    if strategy != "reports_only" and not sampled:
        # The annotated log keeps every original column.
        full = spark.read.parquet(path)
        named = full.withColumnRenamed(config.schema.location_field, LOC)
        result.output_path = write_annotated(annotate(named, result.locations), path, strategy)
    if output_dir:
        write_locations(result.locations, f"{output_dir}/locations")
        write_summary(reports.nested_summary(result.locations, config.method),
                      f"{output_dir}/summary")
        for name, report in result.reports.items():
            report.write.mode("overwrite").parquet(f"{output_dir}/reports/{name}")
    return result

