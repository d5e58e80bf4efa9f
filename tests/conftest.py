"""One Spark session for all tests and helpers to build small logs."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from logtide.operators.rollups import LogViews  # noqa: E402
from logtide.schema import get_schema  # noqa: E402
from logtide.session import build_session  # noqa: E402

LOG_SCHEMA = ("geo_location string, country string, city string, usr string, accession string, "
              "filename string, method string, ts timestamp_ntz")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_log(spark):
    """Rows given as dictionaries; missing fields get a default."""
    from pyspark.sql import functions as F

    def build(rows, min_year=1990):
        base = {"geo_location": "1.0,2.0", "country": "X", "city": "C", "usr": "u1",
                "accession": "P1", "filename": "f1.raw", "method": "http", "ts": None}
        full = [{**base, **r} for r in rows]
        names = [c.split()[0] for c in LOG_SCHEMA.split(", ")]
        df = spark.createDataFrame([tuple(r[n] for n in names) for r in full], LOG_SCHEMA)
        log = df.withColumn("ts", F.col("ts").cast("timestamp")) \
            .withColumn("year", F.year("ts").cast("bigint"))
        return LogViews(log, get_schema("canonical").with_options(min_year=min_year))
    return build
