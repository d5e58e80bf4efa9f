"""Merkle dataset manifest: one tree of documents a language, one tree above their roots, octopus multiproofs.

A tree's leaves are cut into parts of ``part`` consecutive leaves (a power of two), so no task holds a whole
tree. Each part's root is a node of the upper levels, which are built in the same way, ``part`` nodes at a
time, until a tree has one node. For its proofs a part computes the coordinates that it cannot derive from
its own leaves, their smallest union, and fetches each of them once by a join; shared interior nodes are
derived from leaves and fetched nodes, and the single proofs are read off locally.

Null ids come first among a tree's leaves and equal ids follow by leaf digest, so repeated rows get the same
root in any order (and, standing at different places, proofs of their own). Null values and empty texts have digests of
their own ("-" against "0:"). An empty table gives no rows. Columns other than the five are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.session import materialise

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PART = 4096
TOP = "*"


def field(value: Column) -> Column:
    """"-" for null, else the length in UTF-8 bytes, ":" and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(**changed: Column) -> Column:
    """SHA-256 of a document's five fields, some of them replaced."""
    return F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def parents(digests: list[str]) -> list[str]:
    """The level above: every two neighbours, and a last one alone, become their digest."""
    return [sha256("".join(digests[i:i + 2]).encode()).hexdigest() for i in range(0, len(digests), 2)]


def height(count: int) -> int:
    """Levels above ``count`` leaves until one node remains."""
    return (count - 1).bit_length() if count > 1 else 0


def missing_nodes(leaves: Iterable[int], count: int) -> list[tuple[int, int]]:
    """Smallest set of (level, index) that together with these leaves gives all their proofs, bottom up."""
    known, width, out = set(leaves), count, []
    for level in range(height(count)):
        out += [(level, i ^ 1) for i in sorted(known) if i ^ 1 not in known and i ^ 1 < width]
        known, width = {i >> 1 for i in known}, (width + 1) >> 1
    return out


def derived(leaves: dict[int, str], count: int, fetched: dict[tuple[int, int], str]) -> dict[tuple[int, int], str]:
    """All nodes on and beside the paths of these leaves, each computed once."""
    nodes = dict(fetched) | {(0, i): d for i, d in leaves.items()}
    known, width = sorted(leaves), count
    for level in range(height(count)):
        known = sorted({i >> 1 for i in known})
        for i in known:
            nodes[level + 1, i] = sha256(
                (nodes[level, 2 * i] + (nodes[level, 2 * i + 1] if 2 * i + 1 < width else "")).encode()).hexdigest()
        width = (width + 1) >> 1
    return nodes


def proof_path(nodes: dict[tuple[int, int], str], place: int, count: int) -> list[str]:
    """Siblings of a leaf bottom up, "<" before a left and ">" before a right one; a lone node's is ">" only."""
    out = []
    for level in range(height(count)):
        i = place >> level
        other = nodes.get((level, i ^ 1), "")
        out.append(("<" if i & 1 else ">") + other)
    return out


def fold(digest: str, path: list[str]) -> str:
    """Root that a leaf and its siblings give."""
    for sibling in path:
        both = sibling[1:] + digest if sibling[0] == "<" else digest + sibling[1:]
        digest = sha256(both.encode()).hexdigest()
    return digest


def placed(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place`` (from 0, by ``order`` within ``tree``) and ``count`` of the tree.

    Rows are dealt by ranges of the whole key, so a tree of any size spreads over many slices; slices are
    numbered and counted, and the small table of counts gives every slice its first place.
    """
    dealt = materialise(rows.repartitionByRange(tree, *order).withColumn("slice", F.spark_partition_id()), "slices")
    sizes = dealt.groupBy(tree, "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy(tree).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(tree, "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
                           F.sum("n").over(Window.partitionBy(tree)).alias("count"))
    rank = F.row_number().over(Window.partitionBy(tree, "slice").orderBy(*order)) - 1
    return dealt.withColumn("rank", rank).join(offsets, [tree, "slice"]) \
        .withColumn("place", F.col("first") + F.col("rank")).drop("slice", "rank", "first")


def part_roots(nodes: DataFrame, part: int) -> DataFrame:
    """(tree, level, place, count, digest) of the nodes ``log2(part)`` levels up; ``count`` is that of the tree's leaves."""
    step = part.bit_length() - 1

    def climb(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        digests = pdf.sort_values("place")["digest"].tolist()
        rest = height(int(pdf["count"].iloc[0])) - int(pdf["level"].iloc[0])
        for _ in range(min(step, rest)):
            digests = parents(digests)
        return pd.DataFrame({"tree": [key[0]], "level": [int(pdf["level"].iloc[0]) + min(step, rest)],
                             "place": [key[1]], "count": [int(pdf["count"].iloc[0])], "digest": digests})
    return nodes.select("tree", "level", "place", "count", "digest", F.floor(F.col("place") / part).alias("part")) \
        .groupBy("tree", "part").applyInPandas(climb, "tree string, level int, place long, count long, digest string")


def upper_nodes(leaves: DataFrame, part: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of the levels from the parts' roots up, and the table (tree, root).

    Rounds: log(leaves) / log(part) of the largest tree. A round stores the levels inside its parts.
    """
    step = part.bit_length() - 1
    level = materialise(part_roots(leaves, part), "nodes")
    tops = [level.where(F.col("level") == F.ceil(F.log2(F.col("count"))))]
    inner = []

    def levels(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        base, count = int(pdf["level"].iloc[0]), int(pdf["count"].iloc[0])
        digests, first, rows = pdf["digest"].tolist(), int(pdf["place"].iloc[0]), []
        for up in range(min(step, height(count) - base) + 1):
            if up < step:
                rows += [(key[0], base + up, (first >> up) + i, d) for i, d in enumerate(digests)]
            digests = parents(digests)
        return pd.DataFrame(rows, columns=["tree", "level", "index", "digest"])

    bound = leaves.agg(F.max("count")).first()[0] or 0
    for _ in range(-(-height(bound) // step) - 1):
        open_level = level.where(F.col("level") < F.ceil(F.log2(F.col("count"))))
        inner.append(open_level.withColumn("part", F.floor(F.col("place") / part)).groupBy("tree", "part")
                     .applyInPandas(levels, "tree string, level int, index long, digest string"))
        level = materialise(part_roots(open_level, part), "nodes")
        tops.append(level.where(F.col("level") == F.ceil(F.log2(F.col("count")))))
    roots = tops[0]
    for more in tops[1:]:
        roots = roots.union(more)
    stored = roots.select("tree", "level", F.col("place").alias("index"), "digest")
    for more in inner:
        stored = stored.union(more)
    return materialise(stored.distinct(), "stored"), roots.select("tree", F.col("digest").alias("root"))


def proofs(leaves: DataFrame, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """``leaves`` with ``path`` (see ``proof_path``), and the table (tree, root).

    ``leaves``: tree, place, count, digest and any columns but level, part and path. ``part``: a power of two from 2 up.
    """
    leaves = leaves.withColumn("level", F.lit(0))
    stored, roots = upper_nodes(leaves, part)
    schema = "tree string, part long, level int, index long"

    def wanted(pdfs):
        for pdf in pdfs:
            for row in pdf.itertuples(index=False):
                first = row.part * part
                own = range(first, min(first + part, row.count_))
                need = missing_nodes(own, row.count_)
                if need:
                    yield pd.DataFrame({"tree": [row.tree] * len(need), "part": [row.part] * len(need),
                                        "level": [x[0] for x in need], "index": [x[1] for x in need]})

    parted = leaves.withColumn("part", F.floor(F.col("place") / part))
    coordinates = parted.groupBy("tree", "part").agg(F.max("count").alias("count_")).mapInPandas(wanted, schema)
    fetched = coordinates.join(stored, ["tree", "level", "index"]).select("tree", "part", "level", "index", "digest")
    kept = [c for c in leaves.columns if c != "level"]
    texts = [f.name for f in leaves.schema if f.dataType.simpleString() == "string"]
    answer = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema if f.name != "level")

    def expand(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return own.reindex(columns=[*kept, "path"])
        count = int(own["count"].iloc[0])
        got = {(int(a), int(b)): d for a, b, d in zip(others["level"], others["index"], others["digest"])}
        nodes = derived(dict(zip(own["place"].tolist(), own["digest"])), count, got)
        own = own[kept].astype({c: object for c in texts})
        own["path"] = pd.Series([proof_path(nodes, i, count) for i in own["place"].tolist()], own.index, dtype=object)
        return own
    done = parted.drop("level").groupBy("tree", "part").cogroup(fetched.groupBy("tree", "part")) \
        .applyInPandas(expand, f"{answer}, path array<string>")
    return done, roots


def manifest(docs: DataFrame, tampered: Column, part: int = PART) -> DataFrame:
    """Every document's leaf, subroot, root, proof and the root its (possibly tampered) row folds to.

    ``tampered``: condition on the five columns; where true, one is added to n_chars before the row is checked
    against its proof. ``verified`` tells whether the folded root is the root. Null conditions count as false.
    """
    one_more = F.when(tampered, leaf_digest(n_chars=F.col("n_chars") + 1))
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))  # "-" sorts before "="
    rows = docs.select("doc_id", tree.alias("tree"), leaf_digest().alias("digest"), one_more.alias("changed"))
    done, roots = proofs(materialise(placed(rows, "tree", ["doc_id", "digest"]), "leaves"), part)
    done, roots = materialise(done, "proofs"), materialise(roots, "roots")
    subroots = roots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    above, top = proofs(materialise(placed(subroots, "tree", ["name"]), "subroots"), part)
    above = materialise(above.select(F.col("name").alias("tree"), F.col("digest").alias("subroot"),
                                     F.col("path").alias("upper")).crossJoin(F.broadcast(top.select("root"))), "above")

    def check(pdfs):
        for pdf in pdfs:
            paths = [[*p, *u] for p, u in zip(pdf["path"], pdf["upper"])]
            leaf = pdf["changed"].where(pdf["changed"].notna(), pdf["digest"])
            out = pdf[["doc_id", "digest", "subroot", "root"]].astype(object).rename(columns={"digest": "leaf"})
            out["proof_sha256"] = [sha256("".join(x[1:] for x in p).encode()).hexdigest() for p in paths]
            out["folded_root"] = [fold(x, p) for x, p in zip(leaf, paths)]
            out["verified"] = out["folded_root"] == out["root"]
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out
    return done.select("tree", "doc_id", "digest", "changed", "path").join(above, "tree") \
        .select("doc_id", "digest", "changed", "path", "subroot", "upper", "root") \
        .mapInPandas(check, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
                            "folded_root string, verified boolean")


def oracle(levels: int = 24) -> str:
    """DuckDB SQL for ``manifest`` of ``documents``, tampered where 7 divides the CRC-32 of doc_id; up to 2^levels leaves."""
    def part(c: str) -> str:
        return f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"

    def leaf(n_chars: str = "n_chars") -> str:
        return "sha256(" + " || ".join(part(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"
    crc = ("xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''), "
           "lambda b: [ascii(b)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, e: case when e < 0 "
           "then xor(c >> 1, 3988292384 * (c & 1)) else xor(c, e) end), 4294967295::bigint)")
    parts = [f"d as (select doc_id, coalesce('=' || lang, '-') tree, {leaf()} leaf, case when doc_id is not null and {crc} % 7 = 0 "
             f"then {leaf("(n_chars + 1)")} else {leaf()} end cur from documents)",
             "a0 as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 i from d)",
             "n0 as (select tree, i, leaf h from a0)",
             "p0 as (select doc_id, tree, leaf, cur, i, '' proof from a0)"]

    def climb(name: str, walk: str, first: int, last: int) -> None:
        for k in range(first, last):
            alone = f"(select tree, count(*) c from {name}{k} group by tree)"
            parts.append(
                f"{name}{k + 1} as (select tree, case when c > 1 then i // 2 else i end i, case when max(c) > 1 then "
                f"sha256(string_agg(h, '' order by i)) else max(h) end h from {name}{k} join {alone} using (tree) "
                f"group by tree, c, case when c > 1 then i // 2 else i end)")
            parts.append(
                f"{walk}{k + 1} as (select doc_id, {walk}.tree, leaf, case when c = 1 then cur when {walk}.i % 2 = 1 "
                f"then sha256(coalesce(s.h, '') || cur) else sha256(cur || coalesce(s.h, '')) end cur, "
                f"case when c = 1 then {walk}.i else {walk}.i // 2 end i, proof || coalesce(s.h, '') proof"
                f"{', subroot' if walk == 'q' else ''} from {walk}{k} {walk} join {alone} t on {walk}.tree = t.tree "
                f"left join {name}{k} s on s.tree = {walk}.tree and s.i = xor({walk}.i, 1))")
    climb("n", "p", 0, levels)
    parts += [f"m0 as (select '*' tree, row_number() over (order by tree) - 1 i, h, tree lang from n{levels})",
              f"q0 as (select doc_id, '*' tree, leaf, cur, m0.i, proof, m0.h subroot from p{levels} p "
              f"join m0 on m0.lang = p.tree)"]
    climb("m", "q", 0, 6)
    return ("with " + ", ".join(x.replace(" as (", " as materialized (", 1) for x in parts) +
            " select doc_id, leaf, subroot, m6.h root, sha256(proof) proof_sha256, cur folded_root, "
            "cur = m6.h verified from q6 cross join m6")
