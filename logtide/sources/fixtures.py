"""Canonical download logs derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table; its times are UTC, whatever the session was started with."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """Deal the rows out evenly: the test tables are single row groups, read by one task."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def _finish(df: DataFrame) -> DataFrame:
    return (df.withColumn("ts", F.col("ts").cast("timestamp"))
            .withColumn("year", F.year("ts").cast("bigint")))


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven years of downloads: one per line item, located at its supplier."""
    li, od, su, na, re = (table(spark, sf_dir, t)
                          for t in ("lineitem", "orders", "supplier", "nation", "region"))
    places = su.join(na, F.col("s_nationkey") == F.col("n_nationkey")) \
        .join(re, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "s_suppkey",
        F.expr("concat(CAST(s_nationkey*5-60 AS STRING), '.', "
               "lpad(CAST((s_suppkey%10)*4 AS STRING),2,'0'), ',', "
               "CAST(s_nationkey*10-120 AS STRING), '.50')").alias("geo_location"),
        F.col("n_name").alias("country"),
        F.col("r_name").alias("region"),
        F.expr("concat('City_', CAST(s_nationkey AS STRING), '_', "
               "CAST(s_suppkey%10 AS STRING))").alias("city"))
    # Dealt out by the key of the join that follows, which then moves them no second time.
    items = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate") \
        .repartition("l_orderkey")
    rows = items.join(od, F.col("l_orderkey") == F.col("o_orderkey")) \
        .join(places, F.col("l_suppkey") == F.col("s_suppkey"))
    return _finish(rows.select(
        "geo_location", "country", "region", "city",
        F.expr("concat('u', CAST(o_custkey AS STRING))").alias("usr"),
        F.expr("concat('PXD', lpad(CAST(l_partkey AS STRING),6,'0'))").alias("accession"),
        F.expr("concat('f', CAST(l_partkey%500 AS STRING), '_v1.', "
               "CAST(l_linenumber%3 AS STRING), '.0', CASE l_partkey%8 WHEN 0 THEN '.raw' "
               "WHEN 1 THEN '.mzML' WHEN 2 THEN '.mzid.gz' WHEN 3 THEN '.csv' "
               "WHEN 4 THEN '.fasta' WHEN 5 THEN '.sdrf.tsv' WHEN 6 THEN '.zip' "
               "ELSE '.dat' END)").alias("filename"),
        F.expr("CASE WHEN l_orderkey%10=0 THEN 'fasp-aspera' "
               "WHEN l_orderkey%10=1 THEN 'gridftp-globus' "
               "WHEN l_orderkey%10<5 THEN 'ftp' ELSE 'http' END").alias("method"),
        F.expr("timestamp_micros(unix_micros(CAST(l_shipdate AS TIMESTAMP)) + 1000000L * "
               "((l_orderkey*7919+l_linenumber*104729)%86400))").alias("ts"),
    ))


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty days of downloads with microsecond times, from the event stream table."""
    ev, na, re = (table(spark, sf_dir, t) for t in ("events", "nation", "region"))
    places = na.join(re, F.col("n_regionkey") == F.col("r_regionkey"))
    stream = _spread(ev.select("event_id", "ts", "user_id", "event_type", "props"))
    rows = stream.join(places, F.expr("user_id % 25") == F.col("n_nationkey"))
    return _finish(rows.select(
        F.expr("concat(CAST((user_id%25)*5-60 AS STRING), '.00,', "
               "CAST((user_id%25)*10-120 AS STRING), '.50')").alias("geo_location"),
        F.col("n_name").alias("country"),
        F.col("r_name").alias("region"),
        F.expr("concat('City_', CAST(user_id%25 AS STRING), '_0')").alias("city"),
        F.expr("concat('u', CAST(user_id AS STRING))").alias("usr"),
        F.expr("concat('PXD', lpad(get_json_object(props,'$.k'),6,'0'))").alias("accession"),
        F.expr("concat('f', get_json_object(props,'$.k'), '_v1.', "
               "CAST(event_id%3 AS STRING), '.0.raw')").alias("filename"),
        F.expr("CASE event_type WHEN 'purchase' THEN 'ftp' WHEN 'signup' THEN 'fasp-aspera' "
               "WHEN 'error' THEN 'gridftp-globus' ELSE 'http' END").alias("method"),
        F.col("ts"),
    ))
