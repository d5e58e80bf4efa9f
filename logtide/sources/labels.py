"""Label tables (CSV) and project metadata (JSON)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.operators.seeds import LABELS

LABEL_COLUMNS = ("geo_location", "label", "split")
METADATA_SCHEMA = ("accession string, title string, submissionDate string, "
                   "publicationDate string")


def validate_labels(labels: DataFrame, columns: tuple[str, ...] = LABEL_COLUMNS,
                    allowed: tuple[str, ...] = LABELS) -> DataFrame:
    """The label table itself, or an error naming missing columns or unknown labels."""
    missing = [c for c in columns if c not in labels.columns]
    if missing:
        raise ValueError(f"label table lacks {missing}; it has {labels.columns}")
    unknown = labels.filter(F.col("label").isNull() | ~F.col("label").isin(*allowed))
    bad = [r["label"] for r in unknown.select("label").distinct().take(10)]
    if bad:
        raise ValueError(f"unknown labels {bad}; allowed are {list(allowed)}")
    return labels


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Gold labels with all columns read as text."""
    return validate_labels(spark.read.option("header", True).csv(path))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Project metadata from a JSON array or from JSON lines."""
    return spark.read.schema(METADATA_SCHEMA).option("multiLine", True).json(path)


def parse_metadata(lines: DataFrame, column: str = "json") -> DataFrame:
    """Project metadata from a column of JSON texts."""
    return lines.select(F.from_json(column, METADATA_SCHEMA).alias("m")).select("m.*")


def with_metadata(datasets: DataFrame, metadata: DataFrame) -> DataFrame:
    """Title and dates for the given datasets only; datasets without metadata stay."""
    wanted = metadata.join(datasets.select("accession"), "accession", "left_semi")
    return datasets.join(wanted, "accession", "left")
