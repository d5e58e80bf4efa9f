"""Best-fit packing of documents into training sequences under conflicts.

Documents are cut into pieces of at most ``capacity`` words; full pieces are bins of their own. The others are
dealt by a hash into blocks of about ``BLOCK`` pieces, and each block is packed on its own, longest piece
first. Open bins stand in order of their free room and carry two bitmaps, of the sources and of the
duplicate clusters they hold. For a piece the search starts at the bin with the least room that is enough
and goes on to its successors until one shares neither source nor cluster; without one a bin is opened.

A block is the unit of work and of memory, whatever share of the rows one source holds; blocks only differ in
how many bins they leave partly filled.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.llm.text import bind, lower_ascii, words

CAPACITY = 2048
BLOCK = 4096
LAYOUT = "doc_id bigint, piece int, n_words int, bin_id string, start int"


def pack_block(sizes: list[int], sources: list[object], clusters: list[object], capacity: int) -> list[tuple[int, int]]:
    """(bin number, start) of every piece; ties in length go by the order given."""
    bits: dict[tuple[int, object], int] = {}

    def bit(kind: int, value: object) -> int:
        return 1 << bits.setdefault((kind, value), len(bits))

    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    room: list[tuple[int, int]] = []
    held: list[int] = []
    placed: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for i in order:
        own = sum(bit(kind, values[i]) for kind, values in enumerate((sources, clusters)) if values[i] is not None)
        at = bisect_left(room, (sizes[i], -1))
        while at < len(room) and held[room[at][1]] & own:
            at += 1
        if at == len(room):
            free, number = capacity, len(held)
            held.append(0)
        else:
            free, number = room.pop(at)
        placed[i] = (number, capacity - free)
        held[number] |= own
        insort(room, (free - sizes[i], number))
    return placed


def counted(text: Column) -> Column:
    """total (words) and cluster of a text: texts that are equal but for case (A-Z) and white space share one, null without a word.

    The words are split once, for both.
    """
    return bind(words(lower_ascii(text)), lambda tokens: F.struct(
        F.size(tokens).alias("total"), F.when(F.size(tokens) > 0, F.xxhash64(tokens)).alias("cluster")))


def pieces(docs: DataFrame, capacity: int, cluster: Column | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, n_words, source, cluster; a text without words is one empty piece."""
    given = F.lit(None).cast("bigint") if cluster is None else cluster.cast("bigint")
    rows = docs.select("doc_id", "source", given.alias("given"), F.inline(F.array(counted(F.col("text")))))
    if cluster is not None:
        rows = rows.withColumn("cluster", F.col("given"))
    last = F.greatest(F.ceil(F.col("total") / capacity).cast("int") - 1, F.lit(0))
    return rows.select("doc_id", "source", "cluster", "total", F.explode(F.sequence(F.lit(0), last)).alias("piece")) \
        .withColumn("n_words", F.least(F.lit(capacity), F.col("total") - F.col("piece") * capacity))


def pack(docs: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, cluster: Column | None = None) -> DataFrame:
    """doc_id, piece, n_words, bin_id and start (offset in words) of every piece of every document.

    Two pieces of one bin never share a source or a duplicate cluster; a null source or a text without words
    (null, empty, blank) conflicts with nothing. Equal rows get pieces of their own. Columns other
    than doc_id, text and source are not read. The number of blocks follows the counted documents. ``cluster`` names
    the duplicate cluster of a document, such as a near-duplicate component (null: none); without it documents of
    equal words share one.
    """
    cut = pieces(docs, capacity, cluster)
    full = cut.where(F.col("n_words") == capacity).select(
        "doc_id", "piece", "n_words", F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("."),
                                               F.col("piece").cast("string"), F.lit("."),
                                               F.monotonically_increasing_id().cast("string")).alias("bin_id"),
        F.lit(0).alias("start"))
    part = cut.where(F.col("n_words") < capacity)
    blocks = max(1, -(-docs.count() // block))
    dealt = part.withColumn("block", F.pmod(F.xxhash64("doc_id", "cluster", "piece"), F.lit(blocks)).cast("int"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_words", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        given = [[None if pd.isna(x) else x for x in rows[c]] for c in ("source", "cluster")]
        placed = pack_block(rows["n_words"].tolist(), *given, capacity)
        name = f"b{rows['block'].iloc[0]}."
        return rows[["doc_id", "piece", "n_words"]].assign(
            bin_id=[f"{name}{number}" for number, _ in placed], start=[start for _, start in placed])

    packed = dealt.select("block", "doc_id", "piece", "n_words", "source", "cluster") \
        .groupBy("block").applyInPandas(fit, LAYOUT)
    return full.union(packed)
