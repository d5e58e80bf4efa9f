"""Writing annotated logs, location tables and run summaries."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STRATEGIES = ("new_file", "overwrite", "reports_only")


def annotated_path(path: str) -> str:
    root, ext = os.path.splitext(path.rstrip("/"))
    return f"{root}_annotated{ext}"


def write_annotated(annotated: DataFrame, source_path: str, strategy: str = "new_file",
                    sampled: bool = False, output_path: str | None = None) -> str | None:
    """Write the annotated log; the path written, or None where nothing is written.

    A sampled run never writes. Overwriting goes to a folder beside the source first, since Spark
    cannot overwrite what it is reading, and then swaps the two.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    if sampled or strategy == "reports_only":
        return None
    writer = annotated.write.mode("overwrite").option("compression", "snappy")
    if strategy == "new_file":
        target = output_path or annotated_path(source_path)
        writer.parquet(target)
        return target
    fresh = source_path.rstrip("/") + ".rewriting"
    writer.parquet(fresh)
    _swap(annotated.sparkSession, fresh, source_path)
    return source_path


def _swap(spark: SparkSession, fresh: str, target: str) -> None:
    """Put ``fresh`` in the place of ``target`` with the file system's own renames."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(conf)
    old = path(target.rstrip("/") + ".replaced")
    fs.rename(path(target), old)
    if not fs.rename(path(fresh), path(target)):
        fs.rename(old, path(target))
        raise OSError(f"could not replace {target}")
    fs.delete(old, True)


def write_locations(locations: DataFrame, path: str, kind: str = "parquet") -> str:
    """Location table as Parquet, or as CSV with nested columns written as JSON text."""
    if kind == "parquet":
        locations.write.mode("overwrite").parquet(path)
        return path
    if kind != "csv":
        raise ValueError("kind must be 'parquet' or 'csv'")
    flat = locations.select(*[
        F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c)
        for c, t in locations.dtypes])
    flat.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_summary(summary: DataFrame, path: str) -> str:
    """One nested row as a JSON file."""
    summary.coalesce(1).write.mode("overwrite").json(path)
    return path
