"""Session settings and the shared folder used for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "logtide", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs rely on (UTC, adaptive execution, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``; only a session without that setting
    (local tests) falls back to a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    fallback = tempfile.mkdtemp(prefix="logtide-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def session_folder(spark: SparkSession) -> str:
    return os.path.join(shared_dir(spark), "logtide", spark.sparkContext.applicationId)


def shared_path(spark: SparkSession, name: str) -> str:
    return os.path.join(session_folder(spark), f"{name}-{uuid.uuid4().hex}")


_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def noted_tables() -> Iterator[list[str]]:
    """The paths of all tables that ``materialise`` writes inside the block, also those of blocks within it."""
    outer, paths = _written.get(), []
    token = _written.set(paths)
    try:
        yield paths
    finally:
        _written.reset(token)
        if outer is not None:
            outer.extend(paths)


def _delete(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables noted by ``noted_tables``; what was made from them must be written by then."""
    for path in paths:
        _delete(spark, path)


def release_intermediates(spark: SparkSession) -> None:
    """Delete the intermediate tables of this session; call it once their results are written."""
    _delete(spark, session_folder(spark))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    if (noted := _written.get()) is not None:
        noted.append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
