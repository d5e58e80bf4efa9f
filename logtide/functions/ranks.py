"""Exact ranks and running counts that never put a whole group into one task.

A plain ``row_number()`` over a key sorts all rows of that key in one task. A key may hold a
third of the log, so each group is first cut into ordered slices; ranks inside a slice use a
window on (key, slice), and the slice table (under a thousand rows per key) carries the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.session import materialise

SLICES = 900          # below the planner's group-limit threshold of 1000
STRIDE = 30
SKETCH_ACCURACY = 10000


def _key_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys that may be NULL."""
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = c if cond is None else cond & c
    return left.join(r, cond, "left").drop(*[f"__r_{k}" for k in keys])


def with_slices(df: DataFrame, keys: Sequence[str], order: Column,
                slices: int = SLICES) -> DataFrame:
    """Add ``__slice``: an order-preserving slice number inside each key group.

    Boundaries are ``slices`` sampled order values per key, chosen by hash so that a re-run of a
    lost task chooses the same ones. The sample only balances the work: any boundaries give
    exact ranks. At most ``slices`` values per key are gathered, whatever the group size.
    """
    keyed = df.withColumn("__ord", order)
    pick = Window.partitionBy(*keys).orderBy("__h", "__ord")
    distinct = keyed.select(*keys, "__ord", F.xxhash64("__ord").alias("__h"))
    # The rank filter becomes a group limit below the shuffle: each map task sends
    # at most ``slices`` rows per key.
    bounds = (distinct.withColumn("__p", F.row_number().over(pick))
              .filter(F.col("__p") <= slices)
              .groupBy(*keys)
              .agg(F.array_sort(F.collect_set("__ord")).alias("__bounds"))
              .withColumn("__coarse", F.filter("__bounds", lambda b, i: i % STRIDE == 0)))
    if keys:
        joined = _key_join(keyed, bounds, keys)
    else:
        one = bounds.select(F.struct("__bounds", "__coarse")).scalar()
        joined = keyed.withColumn("__b", one).select(
            *keyed.columns, F.col("__b.__bounds").alias("__bounds"),
            F.col("__b.__coarse").alias("__coarse"))

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b < F.col("__ord")))
    # Two steps: the block by its first boundary, then the boundary inside the block.
    block = (F.greatest(below(F.col("__coarse")), F.lit(1)) - 1) * STRIDE
    inside = F.slice("__bounds", block + 1, F.lit(STRIDE))
    return joined.withColumn("__slice", block + below(inside)).drop("__bounds", "__coarse")


def sliced_row_number(df: DataFrame, keys: Sequence[str], order: Column, out: str = "rn",
                      slices: int = SLICES) -> DataFrame:
    """``row_number`` of ``order`` inside ``keys``; ``order`` must be unique per key.

    For several sort columns pass a struct; structs compare field by field. The input is written
    once to the shared folder, since boundaries, sizes and ranks all read it.
    """
    cut = with_slices(materialise(df, "ranked"), keys, order, slices)
    inner = cut.withColumn("__rn", F.row_number().over(
        Window.partitionBy(*keys, "__slice").orderBy("__ord")))
    # Offsets come from a slice table of at most ``slices`` + 1 rows per key.
    sizes = cut.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))) \
        .orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "__slice",
                           F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return (_key_join(inner, offsets, [*keys, "__slice"])
            .withColumn(out, (F.col("__rn") + F.col("__off")).cast("bigint"))
            .drop("__ord", "__slice", "__rn", "__off"))


def value_ranks(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per distinct count: how often it occurs (``cnt``) and how many rows lie below it.

    Ranks with ties, Gini, Lorenz and top-share sums only need this table. ``value`` must be a
    download count: distinct positive counts that add up to the log have at most
    sqrt(2 x downloads) members, so one window over them stays small even when the ranked table
    does not.
    """
    table = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))
    base = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    lower = base.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (table
            .withColumn("below", F.coalesce(F.sum("cnt").over(lower), F.lit(0)).cast("bigint"))
            .withColumn("total", F.sum("cnt").over(base)))


def average_rank() -> Column:
    """Rank of a value with ties averaged, on a ``value_ranks`` row."""
    return F.col("below") + (F.col("cnt") + 1) / 2.0


def quantiles(df: DataFrame, value: str, probs: dict[str, float],
              keys: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per key (one row without keys).

    ``percentile`` would hold every distinct value of a group in one buffer. Here a mergeable
    sketch first brackets each quantile (its rank error is at most 1/accuracy of the rows); then
    values below the bracket are only counted and the few inside it are gathered, equal values as
    one entry, to pick the exact ones. NULLs are left out.
    """
    margin = 2.0 / SKETCH_ACCURACY
    names, ps = list(probs), list(probs.values())
    cuts = [max(p - margin, 0.0) for p in ps] + [min(p + margin, 1.0) for p in ps]
    data = df.select(*keys, F.col(value).cast("double").alias("__v")) \
        .filter(F.col("__v").isNotNull())
    stats = [F.percentile_approx("__v", cuts, SKETCH_ACCURACY).alias("__cut"),
             F.count(F.lit(1)).alias("__n")]
    counts = data.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
    if keys:
        joined = _key_join(counts, data.groupBy(*keys).agg(*stats), keys)
    else:
        one = data.agg(F.struct(*stats)).scalar()
        joined = counts.withColumn("__s", one).select(
            "__v", "__c", F.col("__s.__cut").alias("__cut"), F.col("__s.__n").alias("__n"))
    v, c = F.col("__v"), F.col("__c")
    # Up to this size a bracket could miss its quantile by a rank, and all values are few.
    small = F.col("__n") <= 2 * SKETCH_ACCURACY
    aggs = [F.first("__n").alias("__n")]
    for i in range(len(ps)):
        low = F.when(small, float("-inf")).otherwise(F.get("__cut", F.lit(i)))
        high = F.when(small, float("inf")).otherwise(F.get("__cut", F.lit(i + len(ps))))
        aggs += [F.sum(F.when(v < low, c).otherwise(0)).alias(f"__below{i}"),
                 F.array_sort(F.collect_list(F.when(v.between(low, high), F.struct(
                     v.alias("v"), c.alias("c"))))).alias(f"__near{i}")]
    gathered = joined.groupBy(*keys).agg(*aggs)

    def pick(i: int, position: Column) -> Column:
        start = F.struct(F.col(f"__below{i}").alias("seen"), F.lit(None).cast("double").alias("v"))
        return F.aggregate(f"__near{i}", start, lambda acc, x: F.struct(
            (acc.seen + x.c).alias("seen"),
            F.when((acc.seen <= position) & (position < acc.seen + x.c), x.v)
            .otherwise(acc.v).alias("v"))).v
    out = []
    for i, (name, p) in enumerate(zip(names, ps)):
        pos = F.lit(float(p)) * (F.col("__n") - 1)
        lo, hi = pick(i, F.floor(pos)), pick(i, F.ceil(pos))
        value = lo + (hi - lo) * (pos - F.floor(pos))
        missed = F.raise_error(F.lit(f"quantile {name}: its rank lies outside the bracket")).cast("double")
        out.append(F.when((F.col("__n") > 0) & value.isNull(), missed).otherwise(value).alias(name))
    return gathered.select(*keys, *out)
