"""Token counts of documents in flat token files, by a scan for separators.

A token store is a folder of files that hold nothing but ids of fixed width, in the order of the files' names;
documents end with a separator id and may run on from one file into the next. No index is kept. The scan cuts
the files into byte ranges, finds all separators of a range at once, and keeps of every range only what
stitching needs: the ids before its first separator and behind its last. A prefix scan over the ranges, first
inside runs of ranges and then over the runs' totals, carries open documents across their borders.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTHS = {2: np.dtype("<u2"), 4: np.dtype("<u4")}
RUN = 1024
Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    found, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (
        fs.LocalFileSystem(), folder)
    return found, path.rstrip("/")


def write_store(rows: DataFrame, folder: str, separator: int, width: int = 2, before: Batches | None = None) -> DataFrame:
    """Write ids (binary, 32-bit) to one token file per task; returns doc_id, file and nth (place in the file).

    ``rows`` has ``doc_id`` and ``ids``. With ``before`` it has doc_id and what that function makes ids of, batch by
    batch, so that ids are made and written by one worker and never pass through the JVM.

    Files are written under a name of the attempt and renamed when whole, so a repeated task leaves one
    file. A document without ids is a separator only; an id equal to the separator is an error. The frame
    must be stored before the scan starts.
    """
    kind = WIDTHS[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        name, nth = f"tokens-{task.partitionId():06d}.bin", 0
        draft = f"{base}/.{name}.{task.taskAttemptId()}"
        with system.open_output_stream(draft) as out:
            for batch in before(batches) if before else batches:
                for packed in batch.column("ids"):
                    packed = packed.as_py()
                    ids = np.frombuffer(packed or b"", dtype="<u4")
                    if len(ids) and (ids.max() > np.iinfo(kind).max or (ids == separator).any()):
                        raise ValueError(f"an id is the separator or does not fit {width} bytes")
                    out.write(ids.astype(kind).tobytes() + np.array([separator], dtype=kind).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([name] * batch.num_rows, pa.string()),
                     pa.array(range(nth, nth + batch.num_rows), pa.int64())], names=["doc_id", "file", "nth"])
                nth += batch.num_rows
        system.move(draft, f"{base}/{name}")

    given = rows if before else rows.select("doc_id", "ids")
    return given.mapInArrow(run, "doc_id bigint, file string, nth bigint")


def ranges(spark: SparkSession, folder: str, width: int, block_bytes: int) -> DataFrame:
    """(range, file, start, size) of byte ranges in stream order; the driver lists files, tasks cut them."""
    system, base = _open(folder)
    files = sorted((f.base_name, f.size) for f in system.get_file_info(fs.FileSelector(base))
                   if f.is_file and not f.base_name.startswith("."))
    bad = [name for name, size in files if size % width]
    if bad:
        raise ValueError(f"files that end inside an id: {bad[:3]}")
    step = max(width, block_bytes // width * width)
    first = np.concatenate([[0], np.cumsum([-(-size // step) for _, size in files])]).tolist()
    rows = [(int(first[i]), name, int(size)) for i, (name, size) in enumerate(files) if size]
    listed = spark.createDataFrame(rows, "first long, file string, total long")
    return listed.select("first", "file", "total", F.explode(F.sequence(
        F.lit(0), F.floor((F.col("total") - 1) / step))).alias("k")).select(
        (F.col("first") + F.col("k")).alias("range"), "file", (F.col("k") * step).alias("start"),
        F.least(F.lit(step), F.col("total") - F.col("k") * step).alias("size"))


def scan(spark: SparkSession, folder: str, separator: int, width: int = 2, block_bytes: int = 1 << 22) -> DataFrame:
    """doc (number in the stream, from 0), file and nth (where it ends) and n_tokens of every document.

    Ids behind the last separator of the stream are one more, unended document, if there are any. An empty
    folder or files without an id give no row; separators in a row give documents of 0 tokens.
    """
    kind = WIDTHS[width]
    lists = pa.list_(pa.int64())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{base}/{row['file']}") as source:
                    ids = np.frombuffer(source.read_at(row["size"], row["start"]), dtype=kind)
                ends = np.flatnonzero(ids == separator)
                whole = np.diff(ends) - 1
                head = int(ends[0]) if len(ends) else len(ids)
                tail = int(len(ids) - 1 - ends[-1]) if len(ends) else len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x]) for x in (row["range"], row["file"], len(ends), head, tail)]
                    + [pa.array([whole.tolist()], lists)], names=["range", "file", "ends", "head", "tail", "whole"])

    cut = ranges(spark, folder, width, block_bytes)
    spread = cut.repartition(min(max(1, cut.count()), 4096), "range")
    found = spread.mapInArrow(search, "range bigint, file string, ends bigint, head bigint, tail bigint, whole array<bigint>")
    return stitched(found)


def stitched(found: DataFrame) -> DataFrame:
    """Documents from the ranges' summaries, by a prefix scan in two levels."""
    rows = found.withColumn("run", F.floor(F.col("range") / RUN))
    inside = Window.partitionBy("run").orderBy("range")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    opened = F.struct(F.max(F.when(F.col("ends") > 0, F.col("range"))).over(before).alias("at"))["at"]
    rows = rows.withColumn("_run_ends", F.coalesce(F.sum("ends").over(before), F.lit(0))) \
        .withColumn("_sum", F.sum("tail").over(inside)).withColumn("_last", opened)
    closed = F.max(F.when(F.col("ends") > 0, F.struct("range", (F.col("_sum") - F.col("tail")).alias("base")))).over(before)
    rows = rows.withColumn("_carry", F.coalesce(F.sum("tail").over(before), F.lit(0))
                           - F.coalesce(closed["base"], F.lit(0)))
    totals = rows.groupBy("run").agg(F.sum("ends").alias("ends"), F.max(F.struct(
        "range", (F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("_carry") + F.col("tail"))).alias("open")))["open"]
        .alias("open"))
    over = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    shut = F.max(F.when(F.col("ends") > 0, F.struct("run", (F.col("_all") - F.col("open")).alias("base")))).over(over)
    totals = totals.withColumn("_all", F.sum("open").over(Window.orderBy("run"))) \
        .withColumn("docs_before", F.coalesce(F.sum("ends").over(over), F.lit(0))) \
        .withColumn("carried", F.coalesce(F.sum("open").over(over), F.lit(0)) - F.coalesce(shut["base"], F.lit(0))) \
        .select("run", "docs_before", "carried")
    joined = rows.join(totals, "run").withColumn(
        "first", F.col("head") + F.col("_carry") + F.when(F.col("_last").isNull(), F.col("carried")).otherwise(0))
    in_file = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    joined = joined.withColumn("nth", F.coalesce(F.sum("ends").over(in_file), F.lit(0)))
    ended = joined.where("ends > 0").select(
        "file", "nth", (F.col("docs_before") + F.col("_run_ends")).alias("doc"),
        F.posexplode(F.concat(F.array("first"), F.col("whole"))).alias("i", "n_tokens")) \
        .select((F.col("doc") + F.col("i")).alias("doc"), "file", (F.col("nth") + F.col("i")).alias("nth"), "n_tokens")
    last = joined.agg(F.max(F.struct(
        "range", "file", (F.col("docs_before") + F.col("_run_ends") + F.col("ends")).alias("doc"),
        (F.col("nth") + F.col("ends")).alias("nth"),
        F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("first")).alias("n_tokens"))).alias("z"))
    unended = last.where("z.n_tokens > 0").select("z.doc", "z.file", "z.nth", "z.n_tokens")
    return ended.union(unended)
