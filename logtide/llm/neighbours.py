"""Approximate nearest neighbours by largest inner product: NN-descent graph and greedy graph search.

Equal vectors form one node. One added coordinate, kept as a float, brings all nodes to one length, so that near by
angle means near for the inner product too. The graph starts from lists found inside random-hyperplane buckets; every
round then brings the neighbours and (sampled) reverse neighbours of each node together by joins, and each
of them offers the others its best ones. Only entries that are new since the last round are compared.
A query starts at its own node and at the longest vectors; each round expands the best entries of its beam that are not yet
expanded, by a join with the graph and the nearest of its reverse edges. Graph and beam work on vectors rounded to 8 bits of their own scale; the beam's end is
scored again on the original vectors in double precision.

Every row is indexed. Lists, samples and beams have fixed lengths; these are the parameters of the method.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.session import materialise

LIST = "array<struct<sim:float,node:bigint>>"
UNSCORED = -1e9


def valid_vectors(table: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part: whole, finite, not zero, of the commonest length."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = table.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & whole
                       & F.exists("embedding", lambda x: x != 0)).select("vec_id", "embedding")
    usual = good.groupBy(F.size("embedding").alias("length")).count() \
        .agg(F.max(F.struct("count", "length"))["length"].alias("length"))
    return good.where(F.size("embedding") == usual.scalar())


def coded(nodes: DataFrame) -> DataFrame:
    """node, step and code: coordinates in 8-bit steps of the vector's own scale, then the added coordinate as a float.

    All are divided by the longest length, so that with the added coordinate every node has length 1.
    """
    square = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)
    longest = nodes.agg(F.max(square)).collect()[0][0] or 1.0

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            rows = flat.reshape(batch.num_rows, -1) / np.sqrt(longest)
            rest = np.sqrt(np.maximum(1 - (rows * rows).sum(axis=1), 0)).astype("<f4")
            step = np.abs(rows).max(axis=1) / 127
            steps = np.rint(rows / step[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(step.astype(np.float32)),
                 pa.array([r.tobytes() + x.tobytes() for r, x in zip(steps, rest, strict=True)], pa.binary())],
                names=["node", "step", "code"])

    return nodes.select("node", "embedding").where("node is not null").mapInArrow(
        code, "node bigint, step float, code binary")


def unpack(steps: np.ndarray, codes: list[bytes]) -> np.ndarray:
    """Vectors with the added coordinate last."""
    rows = np.frombuffer(b"".join(codes), dtype=np.uint8).reshape(len(codes), -1)
    rest = np.ascontiguousarray(rows[:, -4:]).view("<f4").astype(np.float64)
    return np.hstack([rows[:, :-4].view(np.int8) * np.asarray(steps, dtype=np.float64)[:, None], rest])


def best(lists: Column, size: int) -> Column:
    """The ``size`` nearest distinct entries of an array of lists' entries, nearest first."""
    return F.slice(F.array_sort(F.array_distinct(lists), lambda a, b: F.when(a["sim"] > b["sim"], -1).when(
        a["sim"] < b["sim"], 1).otherwise(F.when(a["node"] < b["node"], -1).when(
            a["node"] > b["node"], 1).otherwise(0))), 1, size)


def gathered(offers: DataFrame, size: int) -> DataFrame:
    """Best lists per node of (node, part, list): in two steps, so that a node offered to by many is spread."""
    first = offers.groupBy("node", "part").agg(F.flatten(F.collect_list("list")).alias("list")) \
        .select("node", best(F.col("list"), size).alias("list"))
    return first.groupBy("node").agg(F.flatten(F.collect_list("list")).alias("list")) \
        .select("node", best(F.col("list"), size).alias("list"))


def offers_within(rows: list[dict], take: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """Each member's best fellows of one group, if they beat the last entry of its list and one of the two is fresh."""
    vectors = unpack(np.array([r["step"] for r in rows], dtype=np.float32), [r["code"] for r in rows])
    half = (vectors * vectors).sum(axis=1) / 2
    near = (vectors @ vectors.T - half[:, None] - half[None, :]).astype(np.float32)
    fresh = np.array([r["fresh"] for r in rows])
    near[~(fresh[:, None] | fresh[None, :])] = -np.inf
    near[near <= np.array([r["worst"] for r in rows], dtype=np.float32)[:, None]] = -np.inf
    np.fill_diagonal(near, -np.inf)
    take = min(take, len(rows) - 1)
    top = np.argpartition(-near, take - 1, axis=1)[:, :take]
    for i, row in enumerate(rows):
        found = [(float(near[i, j]), rows[j]["node"]) for j in top[i] if near[i, j] > -np.inf]
        if found:
            yield row["node"], found


def local_join(groups: DataFrame, take: int) -> DataFrame:
    """(node, part, list) from (part, members): every member is offered its best fellows."""
    kind = pa.list_(pa.struct([("sim", pa.float32()), ("node", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                nodes, parts, lists = [], [], []
                for row in batch.slice(start, 256).to_pylist():
                    if len(row["members"]) > 1:
                        for node, found in offers_within(row["members"], take):
                            nodes.append(node)
                            parts.append(row["part"] % 16)
                            lists.append([{"sim": s, "node": n} for s, n in found])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), pa.array(parts, pa.int64()), pa.array(lists, kind)],
                    names=["node", "part", "list"])

    return groups.mapInArrow(run, f"node bigint, part bigint, list {LIST}")


def start_lists(codes: DataFrame, count: int, size: int, trees: int = 4, room: int = 96, seed: int = 5) -> DataFrame:
    """First lists: buckets of equal signs at random hyperplanes, cut by a hash into groups of about ``room``.

    One more grouping is by a hash of the node alone, so that a node far from all others gets a list too.
    """
    bits = max(0, int(np.ceil(np.log2(max(1, count) / room))))

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            rows = unpack(np.ones(batch.num_rows), batch.column(2).to_pylist())[:, :-1]
            if planes is None:
                planes = np.random.default_rng(seed).normal(size=(rows.shape[1], trees * max(1, bits))).astype(np.float32)
            signs = (rows @ planes > 0).reshape(batch.num_rows, trees, -1)[:, :, :bits]
            keys = signs @ (1 << np.arange(bits, dtype=np.int64)) + (np.arange(trees, dtype=np.int64) << 48)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(keys.tolist(), pa.list_(pa.int64()))], names=["node", "step", "code", "keys"])

    dealt = codes.mapInArrow(bucket, "node bigint, step float, code binary, keys array<bigint>") \
        .select("node", "step", "code", F.explode(F.array_append("keys", F.lit(trees << 48) + F.pmod(
            F.xxhash64("node", F.lit(seed)), F.lit(max(1, count // room))))).alias("key"))
    sizes = dealt.groupBy("key").count().withColumn("cuts", F.ceil(F.col("count") / (2 * room))).select("key", "cuts")
    member = F.struct("node", "step", "code", F.lit(True).alias("fresh"), F.lit(-1e9).cast("float").alias("worst"))
    groups = dealt.join(sizes, "key").groupBy("key", F.pmod(F.xxhash64("node", "key"), "cuts").alias("cut")) \
        .agg(F.collect_list(member).alias("members"))
    return gathered(local_join(groups.select(F.xxhash64("key", "cut").alias("part"), "members"), size), size)


def descend(codes: DataFrame, size: int = 32, rounds: int = 6, sample: int = 20) -> DataFrame:
    """Neighbour graph (node, list): ``size`` nearest nodes found for every node, after ``rounds`` rounds."""
    graph = materialise(start_lists(codes, codes.count(), size), "graph").withColumn("was", F.array().cast(LIST))
    for _ in range(rounds):
        entries = graph.select("node", F.explode("list").alias("e"), "was").select(
            F.col("node").alias("part"), F.col("e.node").alias("node"), F.col("e.sim").alias("sim"),
            (~F.array_contains("was", F.col("e"))).alias("fresh"))
        back = entries.select(F.col("node").alias("part"), F.col("part").alias("node"), "fresh",
                              F.xxhash64("part", "node").alias("draw"))
        ahead = entries.select("part", "node", "fresh", F.xxhash64("node", "part").alias("draw"))
        both = limited(ahead, sample).union(limited(back, sample)).groupBy("part", "node").agg(F.max("fresh").alias("fresh"))
        last = F.when(F.size("list") >= size, F.get("list", F.lit(size - 1))["sim"]).otherwise(F.lit(-1e9).cast("float"))
        worst = codes.join(graph.select("node", last.alias("worst")), "node", "left") \
            .withColumn("worst", F.coalesce("worst", F.lit(-1e9).cast("float")))
        members = both.join(worst, "node").groupBy("part").agg(
            F.collect_list(F.struct("node", "step", "code", "fresh", "worst")).alias("members")) \
            .where(F.exists("members", lambda m: m["fresh"]))
        offered = local_join(members, 10)
        old = graph.select("node", F.lit(-1).cast("bigint").alias("part"), "list")
        merged = gathered(offered.union(old), size)
        was = graph.select("node", F.col("list").alias("was"))
        graph = materialise(merged.join(was, "node", "left").withColumn(
            "was", F.coalesce("was", F.array().cast(LIST))), "graph")
    return graph.select("node", "list")


def limited(rows: DataFrame, size: int) -> DataFrame:
    """At most ``size`` fresh and ``size`` other entries of every part, drawn by a hash."""
    order = Window.partitionBy("part", "fresh").orderBy("draw")
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= size).select("part", "node", "fresh")


def longest_nodes(nodes: DataFrame, count: int) -> list[int]:
    """The ``count`` longest vectors' nodes, on the driver: whatever the direction, they are likely answers."""
    square = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)
    return [r["node"] for r in nodes.orderBy(square.desc(), "node").limit(count).select("node").collect()]


def greedy_search(queries: DataFrame, graph: DataFrame, codes: DataFrame, entries: list[int], beam: int = 160,
                  expand: int = 20, rounds: int = 7, back: int = 16) -> DataFrame:
    """(query, beam) for queries (query, node): the nearest nodes seen when ``rounds`` expansions are done.

    A search starts at the query's own node and at ``entries``, together at most ``expand`` nodes.
    """
    ahead = graph.select("node", F.transform("list", lambda e: e["node"]).alias("to"))
    turned = graph.select(F.col("node").alias("to"), F.explode("list").alias("e")).select(
        F.col("e.node").alias("node"), "to", F.row_number().over(Window.partitionBy("e.node").orderBy(
            F.desc("e.sim"), "to")).alias("_r")).where(F.col("_r") <= back)
    turned = turned.groupBy("node").agg(F.collect_list("to").alias("back"))
    edges = materialise(ahead.join(turned, "node", "left").select("node", F.array_union(
        "to", F.coalesce("back", F.array().cast("array<bigint>"))).alias("to")), "edges")
    kind = pa.list_(pa.struct([("sim", pa.float32()), ("node", pa.int64()), ("done", pa.bool_())]))
    state = "query bigint, step float, code binary, beam array<struct<sim:float,node:bigint,done:boolean>>"

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            beams = []
            for row in batch.to_pylist():
                own = unpack(np.ones(1), [row["code"]])[0]
                own[-1] = 0
                held = {e["node"]: (e["sim"], True if k < expand else e["done"]) for k, e in enumerate(
                    sorted(row["beam"], key=lambda e: (e["done"], -e["sim"], e["node"])))}
                new = [c for c in row["found"] or () if c["node"] not in held or held[c["node"]][0] == UNSCORED]
                if new:
                    sims = unpack(np.array([c["step"] for c in new]), [c["code"] for c in new]) @ own
                    held |= {c["node"]: (float(s), c["node"] in held) for c, s in zip(new, sims, strict=True)}
                top = sorted(held.items(), key=lambda x: (-x[1][0], x[0]))[:beam]
                beams.append([{"sim": s, "node": n, "done": d} for n, (s, d) in top])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(beams, kind)],
                                             names=["query", "step", "code", "beam"])

    begin = queries.join(codes, "node").join(edges, "node", "left").select(
        "query", "step", "code", F.transform(
            F.array_distinct(F.array("node", *[F.lit(n).cast("bigint") for n in entries])),
            lambda n: F.struct(F.lit(UNSCORED).cast("float").alias("sim"), n.alias("node"), F.lit(False).alias("done")))
        .alias("beam"))
    current = begin
    for _ in range(rounds + 1):
        waiting = F.slice(F.array_sort(F.filter("beam", lambda e: ~e["done"]), lambda a, b: F.when(
            a["sim"] > b["sim"], -1).when(a["sim"] < b["sim"], 1).otherwise(F.when(
                a["node"] < b["node"], -1).when(a["node"] > b["node"], 1).otherwise(0))), 1, expand)
        front = current.select("query", F.explode(waiting).alias("e")).select("query", F.col("e.node").alias("node"))
        met = front.join(edges, "node").select("query", F.explode("to").alias("node"))
        own = front.select("query", "node")
        seen = met.union(own).distinct().join(codes, "node").groupBy("query").agg(
            F.collect_list(F.struct("node", "step", "code")).alias("found"))
        joined = current.join(seen, "query", "left").select("query", "step", "code", "beam", "found")
        current = materialise(joined.mapInArrow(update, state), "beams")
    return current.select("query", F.transform("beam", lambda e: e["node"]).alias("beam"))


def search(table: DataFrame, is_query: Column, top: int = 20, size: int = 32, rounds: int = 6, beam: int = 160,
           expand: int = 20, hops: int = 7) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the ``top`` nearest other rows found for every query row.

    Score is the inner product of the original vectors in double precision; ties go to the smaller vec_id.
    Rows whose vector is null, zero, of another length, or holds null or non-finite components take no part.
    Rows that repeat a vec_id count once, with one of their vectors. With fewer candidates all are returned.
    """
    rows = valid_vectors(table).groupBy("vec_id").agg(F.max("embedding").alias("embedding"))
    marked = materialise(rows, "vectors")
    nodes = marked.groupBy("embedding").agg(F.min("vec_id").alias("node"))
    nodes = materialise(nodes, "nodes")
    member = marked.join(nodes, "embedding").select("vec_id", "node")
    member = materialise(member, "members")
    codes = materialise(coded(nodes), "codes")
    graph = descend(codes, size, rounds)
    asked = member.where(is_query).select(F.col("vec_id").alias("query"), "node")
    found = greedy_search(asked, graph, codes, longest_nodes(nodes, expand - 4), beam, expand, hops)
    first = Window.partitionBy("node").orderBy("vec_id")
    copies = member.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= top + 1).select("node", "vec_id")
    pairs = found.select("query", F.explode("beam").alias("node")).distinct()
    vectors = nodes.select("node", F.col("embedding").alias("there"))
    own = marked.select(F.col("vec_id").alias("query"), F.col("embedding").alias("here"))
    product = F.aggregate(F.zip_with("here", "there", lambda a, b: a.cast("double") * b.cast("double")),
                          F.lit(0.0), lambda acc, x: acc + x)
    scored = pairs.join(vectors, "node").join(own, "query").select("query", "node", product.alias("score"))
    near = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return scored.join(copies, "node").where(F.col("vec_id") != F.col("query")) \
        .withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= top) \
        .select(F.col("query").alias("query_id"), "rank", "vec_id", "score")
