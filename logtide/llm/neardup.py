"""Near-duplicate documents: inverted join over the coordinates of MinHash signatures.

1. Documents with the same set of five-word shingles form one class; the rest works on classes.
2. Every class is posted under each (coordinate, value) of its 64-value signature. Values held by one
   class only are left out, and a class needs ``MATCHES`` shared values to be posted at all.
3. Prefix: of a class's values, ordered by rising list length, only the first 64 - MATCHES + 1 lists
   are merged; two signatures that agree in MATCHES places always meet in one of them. The longest
   lists, such as those of a passage that very many documents hold, are skipped.
4. Each list names one hub, the class whose values are the most common. Every member is compared with the
   hub on full shingle sets. That is linear in the list, and a group of near copies meets at its original.
5. What hubs leave open: two members of one hub's lists in different components can only be linked if they
   differ from the hub in the same shingles (that it lacks, or that they lack), and how many of them they must share
   follows from their sizes. Members meet in the rarest of those shingles, at places that leave enough behind them.

At a similarity of exactly 0.75 two signatures agree in fewer than MATCHES = 32 of 64 places with a
probability of about 2e-6; above 0.8 it is under 1e-9. Shingles and classes are identified by 64- and 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.llm.components import components
from logtide.llm.text import lower_ascii, windows5, words
from logtide.session import materialise

COORDINATES = 64
MATCHES = 32
#: Odd multipliers and offsets of the signature's hash functions, from a fixed seed.
_RNG = np.random.default_rng(20240)
MULTIPLY = _RNG.integers(1, 2 ** 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
OFFSET = _RNG.integers(0, 2 ** 63, COORDINATES, dtype=np.uint64)


def shingle_hashes(text: Column) -> Column:
    """Hashes of the five-word windows of a text, A-Z lower-cased, repeats included."""
    return windows5(words(lower_ascii(text)))


def signature(hashes: np.ndarray, block: int = 2048) -> np.ndarray:
    """Smallest mixed hash per coordinate; the coordinate's number is mixed in, so values differ by it."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), block):
        mixed = hashes[i:i + block, None] * MULTIPLY + OFFSET
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(low, mixed.min(axis=0), out=low)
    return low


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, key (128-bit hash of the set, null if empty) and signature of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2)
            flat = spans.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.cumsum(np.diff(spans.offsets.to_numpy()))
            counts, keys, signs = [], [], []
            for start, end in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
                own = np.unique(flat[start:end])
                counts.append(len(own))
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                signs.append(signature(own).view(np.int64) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(signs, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "key", "signature"])

    spans = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), shingle_hashes(F.col("text")).alias("spans"))
    return spans.mapInArrow(sign, "doc_id bigint, text_hash bigint, n_shingles bigint, key binary, "
                            "signature array<bigint>")


def prefix_lists(classes: DataFrame) -> DataFrame:
    """(value, node, n, centre): the lists to merge; ``centre`` sums the lengths of a class's lists."""
    posted = classes.select("node", F.col("n_shingles").alias("n"), F.explode("signature").alias("value"))
    shared = posted.groupBy("value").agg(F.count("*").alias("length")).where("length > 1")
    held = posted.join(shared, "value").groupBy("node", "n").agg(
        F.sort_array(F.collect_list(F.struct("length", "value"))).alias("lists"))
    alone = F.lit(COORDINATES) - F.size("lists")
    room = F.lit(COORDINATES - MATCHES + 1) - alone
    centre = F.aggregate("lists", F.lit(0).cast("bigint"), lambda acc, x: acc + x["length"])
    return held.where(room > 0).select(
        F.explode(F.slice("lists", F.lit(1), room)).alias("list"), "node", "n", centre.alias("centre")) \
        .select("list.value", "node", "n", "centre")


def linked(shared: Column, n: Column, m: Column) -> Column:
    return 100 * shared >= 75 * (n + m - shared)


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, spans) of the wanted classes (node, doc_id and text hash of one member), read again from the texts."""
    member = wanted.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("node").alias("_node"))
    same = (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    return docs.select("doc_id", "text").join(member, same).dropDuplicates(["_node"]) \
        .select(F.col("_node").alias("node"), F.array_distinct(shingle_hashes(F.col("text"))).alias("spans"))


def link_classes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) between classes (node, n_shingles, signature, doc_id, text_hash) that connect all linked ones."""
    lists = materialise(prefix_lists(classes), "lists")
    best = F.max(F.struct("centre", "node")).alias("best")
    hubs = lists.groupBy("value").agg(best, F.count("*").alias("c")).where("c > 1") \
        .select("value", F.col("best.node").alias("hub"))
    pairs = materialise(lists.join(hubs, "value").where("node <> hub")
                        .select("hub", "node", "n").distinct(), "hub-pairs")
    nodes = pairs.select("node").union(pairs.select("hub")).distinct()
    member = classes.select("node", "doc_id", "text_hash")
    sets = materialise(shingle_sets(docs, nodes.join(member, "node")), "sets")
    hub_sets = sets.select(F.col("node").alias("hub"), F.col("spans").alias("hub_spans"))
    both = pairs.join(sets, "node").join(hub_sets, "hub")
    measured = materialise(both.select("hub", "node", "n", F.size("hub_spans").cast("long").alias("hub_n"),
                                       F.size(F.array_intersect("spans", "hub_spans")).alias("inside")), "measured")
    stars = measured.where(linked(F.col("inside"), F.col("n"), F.col("hub_n"))) \
        .select(F.col("hub").alias("a"), F.col("node").alias("b"))
    root = components(stars)
    placed = measured.join(root, "node", "left") \
        .withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("hub").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.max("n").alias("most")) \
        .where("_lo <> _hi").select("hub", "most")
    apart = F.concat(F.array_except("spans", "hub_spans"), F.array_except("hub_spans", "spans"))
    open_rows = materialise(placed.join(mixed, "hub").join(sets, "node").join(hub_sets, "hub")
                            .select("hub", "node", "n", "root", "most", apart.alias("apart")), "open")
    return stars.union(open_links(open_rows))


def open_links(rows: DataFrame) -> DataFrame:
    """Linked pairs (a, b) of one hub's members (hub, node, n, root, most, apart) in different components.

    ``apart`` holds the d shingles in which a member and its hub differ, ``most`` the largest n of the hub's members.
    Two members with o of them in common share (n + m - d - e) / 2 + o shingles, so they are linked if 14 o >= 7 (d + e)
    - (n + m). The one with the smaller d thus needs 14 o >= 14 d - (n + m), the other 7 o >= 7 d - (n + m), and m is at
    most 4/3 n. A pair meets in the rarest shingle that both have apart; o is at most what is left from there on.
    """
    entry = F.explode("apart").alias("span")
    spans = rows.select("hub", "root", entry).groupBy("hub", "span").agg(
        F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.count("*").alias("c")).where("_lo <> _hi") \
        .select("hub", "span", "c")
    common = rows.select("hub", "node", entry).join(spans, ["hub", "span"]) \
        .groupBy("hub", "node").agg(F.sort_array(F.collect_list(F.struct("c", "span"))).alias("common"))
    kept = materialise(rows.withColumn("d", F.size("apart")).drop("apart").join(common, ["hub", "node"])
                       .withColumn("common", F.col("common.span")), "kept")

    def met(side: str, least: str) -> DataFrame:
        """Rows of a side in the first places of its members, all but ``least`` and one more."""
        need = F.greatest(F.expr(f"int(ceil(({least} - n - least(floor(4 * n / 3), most)) / {least.split()[0]}))"), F.lit(1))
        prefix = kept.withColumn("m", F.size("common")).withColumn("need", need).where("m >= need") \
            .select("hub", "node", "n", "root", "d", "m", F.posexplode(
                F.slice("common", F.lit(1), F.col("m") - F.col("need") + 1)).alias("at", "span"))
        return prefix.select(F.col("hub").alias(f"{side}_hub"), F.col("span").alias(f"{side}_span"),
                             *[F.col(c).alias(f"{side}_{c}") for c in ("node", "n", "root", "d")],
                             (F.col("m") - F.col("at")).alias(f"{side}_left"))

    def enough(shared: Column) -> Column:
        return 14 * shared >= 7 * (F.col("x_d") + F.col("y_d")) - (F.col("x_n") + F.col("y_n"))

    ordered = (F.col("x_d") < F.col("y_d")) | ((F.col("x_d") == F.col("y_d")) & (F.col("x_node") < F.col("y_node")))
    pairs = met("x", "14 * d").join(met("y", "7 * d"), (F.col("x_hub") == F.col("y_hub")) & (F.col("x_span") == F.col("y_span"))
                                    & ordered & (F.col("x_root") != F.col("y_root")) & enough(F.least("x_left", "y_left"))) \
        .select("x_hub", "x_node", "y_node", "x_n", "y_n", "x_d", "y_d").distinct()
    own = kept.select(F.col("hub").alias("x_hub"), F.col("node").alias("x_node"), F.col("common").alias("x_common"))
    other = kept.select(F.col("hub").alias("x_hub"), F.col("node").alias("y_node"), F.col("common").alias("y_common"))
    return pairs.join(own, ["x_hub", "x_node"]).join(other, ["x_hub", "y_node"]) \
        .where(enough(F.size(F.array_intersect("x_common", "y_common")))) \
        .select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def leftovers(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of one hub's members in different components that can still be linked, where only the spans outside
    the hub (``rest``) are known; ``open_links`` compares by those that members lack as well.

    A pair that fits shares at least 3/4 n - inside spans outside the hub, for the n and inside of either member, as
    the other has at least 3/4 of its shingles. So two such members meet in the first spans of each, all but that
    many less one, rarest first. Members meet by narrow rows, and their spans are joined to the pairs met.
    """
    wide = rows.select("hub", "node", "n", "inside", "root", "rest")
    entry = F.explode("rest").alias("span")
    spans = wide.select("hub", "root", entry).groupBy("hub", "span").agg(
        F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.count("*").alias("c")).where("_lo <> _hi") \
        .select("hub", "span", "c")
    posted = wide.select("hub", "node", entry).join(spans, ["hub", "span"])
    common = posted.groupBy("hub", "node").agg(F.sort_array(F.collect_set(F.struct("c", "span"))).alias("common"))
    kept = materialise(wide.drop("rest").join(common, ["hub", "node"]).withColumn("common", F.col("common.span")), "kept")
    least = F.greatest(F.expr("int((3 * n + 3) div 4 - inside)"), F.lit(1))
    met = kept.withColumn("m", F.size("common")).where(F.col("m") >= least) \
        .select("hub", F.explode(F.slice("common", F.lit(1), F.col("m") - least + 1)).alias("span"),
                "node", "n", "inside", "root", "m")
    x = met.select("hub", "span", *[F.col(c).alias(f"x_{c}") for c in met.columns[2:]])
    y = met.select("hub", "span", *[F.col(c).alias(f"y_{c}") for c in met.columns[2:]])

    def enough(shared: Column) -> Column:
        return 7 * (F.least("x_inside", "y_inside") + shared) >= 3 * (F.col("x_n") + F.col("y_n"))

    fits = (F.col("x_node") < F.col("y_node")) & (F.col("x_root") != F.col("y_root")) \
        & (4 * F.least("x_n", "y_n") >= 3 * F.greatest("x_n", "y_n")) & enough(F.least("x_m", "y_m"))
    pairs = x.join(y, (x.hub == y.hub) & (x.span == y.span) & fits) \
        .select(x.hub, "x_node", "y_node", "x_n", "y_n", "x_inside", "y_inside").distinct()
    own = kept.select("hub", F.col("node").alias("x_node"), F.col("common").alias("x_common"))
    other = kept.select("hub", F.col("node").alias("y_node"), F.col("common").alias("y_common"))
    outside = pairs.join(own, ["hub", "x_node"]).join(other, ["hub", "y_node"]) \
        .where(enough(F.size(F.array_intersect("x_common", "y_common")))) \
        .select(F.col("x_node").alias("a"), F.col("y_node").alias("b"))
    near = rows.where(7 * F.col("inside") - 3 * F.col("n") >= 3 * F.col("least")) \
        .select("hub", "node", "n", "inside", "root")
    p = near.select(*[F.col(c).alias(f"x_{c}") for c in near.columns])
    q = near.select(*[F.col(c).alias(f"y_{c}") for c in near.columns])
    fits = (F.col("x_node") < F.col("y_node")) & (F.col("x_root") != F.col("y_root")) \
        & (7 * F.least("x_inside", "y_inside") >= 3 * (F.col("x_n") + F.col("y_n")))
    contained = p.join(q, (p.x_hub == q.y_hub) & fits).select(F.col("x_node").alias("a"), F.col("y_node").alias("b"))
    return outside.union(contained).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept, one row per document row.

    A null, empty or blank text has no shingle and is linked with nothing. Rows that repeat a doc_id
    are separate members; kept is true where doc_id equals component_id. A null doc_id is never the
    smallest; a component of null ids only has a null component_id and is not kept.
    """
    own = materialise(signed(docs), "signed")
    member = F.max(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash")))
    grouped = own.where("key is not null").groupBy("key").agg(
        member.alias("member"), F.min("doc_id").alias("least"),
        F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = materialise(grouped.select("key", "least", "member.doc_id", "member.text_hash", "n_shingles", "signature",
                                         F.monotonically_increasing_id().alias("node")), "classes")
    root = components(link_classes(docs, classes.where("doc_id is not null")))
    placed = classes.select("key", "least", "node").join(root, "node", "left") \
        .withColumn("root", F.coalesce("root", "node"))
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_key = placed.join(lowest, "root").select("key", "component_id")
    return own.select("doc_id", "n_shingles", "key").join(of_key, "key", "left") \
        .withColumn("component_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))) \
        .select("doc_id", "n_shingles", "component_id",
                F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
