"""Grouping of nearby locations of one country (greedy leaders in rank order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.functions.columns import LOC, coordinates, haversine_km
from logtide.session import materialise

RADIUS_KM = 6371.0
CELL = ("cx", "cy", "cz")


def _with_cells(points: DataFrame, km: float) -> DataFrame:
    """Parse coordinates and put each point into a cube of side ``km``.

    Cubes in space have neither date line nor poles. Points within ``km`` along the surface are
    within ``km`` in a straight line too, so they lie in the same or in touching cubes.
    """
    lat, lon = coordinates(F.col(LOC))
    out = points.withColumns({"lat": lat, "lon": lon}).filter("lat IS NOT NULL AND lon IS NOT NULL")
    la, lo = F.radians("lat"), F.radians("lon")
    side = F.lit(float(km))
    xyz = (F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la))
    return out.withColumns({c: F.floor(v * RADIUS_KM / side).cast("int")
                            for c, v in zip(CELL, xyz)})


def _around(df: DataFrame) -> DataFrame:
    """Repeat each row for its own and the 26 touching cubes."""
    out = df
    for c in CELL:
        out = out.withColumn(c, F.explode(F.array(*[F.col(c) + i for i in (-1, 0, 1)])))
    return out


def _close(a: str, b: str, km: float) -> Column:
    return haversine_km(F.col(f"{a}.lat"), F.col(f"{a}.lon"),
                        F.col(f"{b}.lat"), F.col(f"{b}.lon")) <= km


def _reached(points: DataFrame, leaders: DataFrame, km: float) -> DataFrame:
    """Points with a leader of lower or equal rank within reach, and the lowest such rank."""
    p, q = points.alias("p"), _around(leaders).alias("q")
    on = [F.col(f"p.{c}") == F.col(f"q.{c}") for c in ("country", *CELL)]
    return (p.join(q, on).filter((F.col("q.rank") <= F.col("p.rank")) & _close("p", "q", km))
            .groupBy(F.col("p.rank").alias("rank")).agg(F.min("q.rank").alias("leader")))


def proximity_groups(points: DataFrame, km: float = 10.0) -> DataFrame:
    """Assign every point to its leader.

    ``points`` has location, country and a unique ``rank``. Going by rank, a point not within
    ``km`` of an earlier leader of its country becomes a leader; every other point belongs to the
    earliest leader in reach. Rounds decide all points that are first among the undecided of
    their neighbourhood at once. Leaders are more than ``km`` apart, so a cube holds only a few
    and no list of all point pairs arises, however dense a country is.
    """
    located = materialise(
        _with_cells(points.select(LOC, "country", "rank"), km)
        .filter(F.col("country").isNotNull()), "proximity")
    undecided = located
    leaders = located.filter(F.lit(False))
    while not undecided.isEmpty():
        firsts = undecided.groupBy("country", *CELL).agg(
            F.min_by(F.struct(LOC, "lat", "lon"), "rank").alias("s"), F.min("rank").alias("rank"))
        blocked = _around(firsts.select("country", *CELL, F.col("rank").alias("other")))
        lowest = firsts.join(blocked, ["country", *CELL]).groupBy("rank").agg(
            F.min("other").alias("low")).filter(F.col("low") == F.col("rank")).select("rank")
        new = materialise(undecided.join(lowest, "rank", "left_semi"), "leaders")
        leaders = leaders.unionByName(new)
        decided = _reached(undecided, new, km).select("rank")
        undecided = materialise(undecided.join(decided, "rank", "left_anti"), "undecided")
    assigned = _reached(located, leaders, km)
    names = leaders.select(F.col("rank").alias("leader"), F.col(LOC).alias("leader_location"))
    return (located.select(LOC, "country", "rank").join(assigned, "rank")
            .join(names, "leader").select(LOC, "country", "leader_location"))


