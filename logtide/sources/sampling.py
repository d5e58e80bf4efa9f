"""Samples of a log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logtide.operators.timing import row_key


def percent_sample(log: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    return log.sample(fraction=fraction, seed=seed)


def exact_sample(log: DataFrame, n: int, digits: int = 6) -> DataFrame:
    """Exactly ``n`` rows in the order of a hash of the row (all rows when there are fewer).

    A sort with a limit would pull the sample through one task. Instead rows are counted per hash
    prefix, whole prefixes are taken up to the one where ``n`` falls, and only that prefix is
    ordered, equal rows collapsed to one with a count.
    """
    columns = log.columns
    keyed = log.withColumn("sample_key", row_key())
    short = F.substring("sample_key", 1, digits // 2)
    prefix = F.substring("sample_key", 1, digits)

    def cut(rows: DataFrame, key, need):
        """Prefix in which the ``need``-th row lies, and how many rows come before it."""
        sizes = rows.groupBy(key.alias("p")).agg(F.count(F.lit(1)).alias("c"))
        run = Window.partitionBy(F.lit(0)).orderBy("p")
        cum = sizes.withColumn("upto", F.sum("c").over(run))
        return cum.filter(F.col("upto") >= need).agg(
            F.min(F.struct("p", (F.col("upto") - F.col("c")).alias("before"))).alias("m")).scalar()

    first = cut(keyed, short, F.lit(n))
    inside = keyed.withColumn("m1", first).filter(short == F.col("m1.p")).drop("m1")
    rest = F.lit(n) - first.getField("before")
    second = cut(inside, prefix, rest)
    marked = keyed.withColumns({"m1": first, "m2": second})
    # Short log: no prefix reaches n, every row is taken.
    whole = marked.filter(F.col("m1").isNull() | (prefix < F.col("m2.p"))).select(*columns)
    copies = (marked.filter(prefix == F.col("m2.p"))
              .groupBy("sample_key", *columns)
              .agg(F.count(F.lit(1)).alias("c"), F.first("m1").alias("m1"),
                   F.first("m2").alias("m2")))
    # One prefix of the full depth: about total / 16^digits distinct rows.
    run = Window.partitionBy(F.lit(0)).orderBy("sample_key", *columns)
    left = F.lit(n) - F.col("m1.before") - F.col("m2.before")
    take = F.least(F.col("c"), left - (F.sum("c").over(run) - F.col("c")))
    edge = (copies.withColumn("take", take).filter("take > 0")
            .select(*columns, F.explode(F.sequence(F.lit(1).cast("bigint"), "take")).alias("i"))
            .select(*columns))
    return reduce(DataFrame.unionByName, [whole, edge])


def oversampled_limit(log: DataFrame, n: int) -> DataFrame:
    """``n`` random rows, or the whole log when it is smaller.

    A draw of somewhat more than ``n`` rows and a limit may return too few, and the limit runs in one
    task; the cut by hash prefixes gives the exact number in parallel.
    """
    return exact_sample(log, n)
