"""Connected components of an edge table by repeated joins, each round cut by a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) for every node of an edge table (``a``, ``b``).

    Every round hangs each node on the smallest label among its neighbours and then halves the paths to
    the roots, so the rounds grow with the logarithm of the longest chain. Labels stay in Spark; only the
    number of changed rows reaches the driver.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    label = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_m"))
                        .select("node", F.least("node", "_m").alias("root")), "labels")
    while True:
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("root").alias("_near"))
        offered = label.join(near, label.node == near.a, "left") \
            .select("node", "root", F.least("root", "_near").alias("low"))
        hooked = offered.groupBy("root").agg(F.min("low").alias("hook"))
        lower = offered.join(hooked, "root").select("node", "root", F.least("low", "hook").alias("low"))
        up = lower.select(F.col("node").alias("low"), F.col("low").alias("_up"))
        jumped = lower.join(up, "low", "left").select(
            "node", F.least("low", F.coalesce("_up", "low")).alias("root"), F.col("root").alias("was"))
        after = materialise(jumped, "labels")
        label = after.select("node", "root")
        if not after.where("root <> was").limit(1).count():
            return label
