"""Chat formatting by quotation linking.

Lines are read with their quote level (the ``>`` marks they begin with). Quoted lines of one level in a row
are a passage; its normalised text (marks, case and white space taken out) is hashed. Original messages post
the hashes of their own unquoted paragraphs and lines. A join inside the conversation finds the message that a passage
was taken from: the latest earlier one that holds all of it. A reply hangs below the message of its
outermost quote that is found, else below the message before it, and the conversation is ordered as a
tree of replies, without the quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.llm.text import SPACE, SPACES, lower_ascii
from logtide.session import materialise

MARKS = "^((?:[ \\t]{0,3}>)*)"


def normal(text: Column) -> Column:
    """Text with A-Z lower-cased and white space runs made one blank; empty where nothing is left."""
    return F.trim(F.regexp_replace(lower_ascii(text), SPACE, " "))


def lines_of(turns: DataFrame) -> DataFrame:
    """(msg, conv_id, turn, at, level, body) of every line; carriage returns before a line break are dropped."""
    cut = turns.select("msg", "conv_id", "turn", F.posexplode(F.split(
        F.coalesce(F.col("text"), F.lit("")), "\\r?\\n", -1)).alias("at", "line"))
    marks = F.regexp_extract("line", MARKS, 1)
    return cut.withColumn("_marks", marks).select(
        "msg", "conv_id", "turn", "at", (F.length("_marks") - F.length(F.regexp_replace("_marks", ">", ""))).alias("level"),
        F.expr("substring(line, length(_marks) + 1)").alias("body"))


def runs(lines: DataFrame) -> DataFrame:
    """Lines with the number of the run of equal level (and of blank-line-free text) they belong to."""
    order = Window.partitionBy("msg").orderBy("at")
    blank = F.trim("body", F.lit(SPACES)) == ""
    starts = (F.col("level") != F.lag("level", 1, -1).over(order)) | F.lag(blank, 1, False).over(order)
    return lines.withColumn("blank", blank).withColumn("_new", starts.cast("int")) \
        .withColumn("run", F.sum("_new").over(order)).drop("_new")


def passages(numbered: DataFrame) -> DataFrame:
    """(msg, conv_id, turn, run, level, hash, n_lines): each run's normalised text as a hash."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "body"))), lambda x: x["body"]), " ")
    return numbered.where(~F.col("blank")).groupBy("msg", "conv_id", "turn", "run", "level").agg(
        joined.alias("body"), F.count("*").alias("n_lines")).withColumn("hash", F.xxhash64(normal(F.col("body"))))


def parents(turns: DataFrame, numbered: DataFrame) -> DataFrame:
    """(msg, parent, quoted): the message each one replies to; null for the first of a conversation."""
    whole = passages(numbered)
    lines = numbered.where((F.col("level") == 0) & ~F.col("blank")).select(
        "conv_id", "turn", F.col("msg").alias("source"), F.xxhash64(normal(F.col("body"))).alias("hash"))
    own = whole.where("level = 0").select("conv_id", "turn", F.col("msg").alias("source"), "hash").union(
        lines.select("conv_id", "turn", "source", "hash")).distinct().withColumnRenamed("turn", "source_turn")
    asked = whole.where("level > 0").select("conv_id", "turn", "msg", "level", "hash")
    both = asked.select("conv_id", "hash", "turn", "msg", "level", F.lit(None).cast(own.schema["source"].dataType)
                        .alias("source")).union(own.select(
        "conv_id", "hash", "source_turn", F.lit(None).cast(own.schema["source"].dataType), F.lit(None).cast("int"), "source"))
    so_far = Window.partitionBy("conv_id", "hash").orderBy("turn", F.col("msg").isNull()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    origin = F.last(F.when(F.col("source").isNotNull(), F.struct(F.col("turn").alias("at"), "source")), True).over(so_far)
    found = both.withColumn("origin", origin).where("msg is not null and origin is not null").groupBy("msg").agg(
        F.max(F.struct((-F.col("level")).alias("near"), F.col("origin.at"), F.col("origin.source")))["source"].alias("source"))
    order = Window.partitionBy("conv_id").orderBy("turn", "msg")
    return turns.select("msg", F.lag("msg").over(order).alias("previous")).join(found, "msg", "left").select(
        "msg", F.coalesce("source", "previous").alias("parent"), F.col("source").isNotNull().alias("quoted"))


def reply_paths(links: DataFrame) -> DataFrame:
    """(msg, root, depth, path): path from the root, by doubling; equal for any number of executors.

    ``path`` holds the message numbers from the root down, so sorting by it puts every reply below its parent.
    """
    state = materialise(links.select("msg", F.col("parent").alias("up"), F.array("msg").alias("path")), "paths")
    while state.where("up is not null").limit(1).count():
        above = state.select(F.col("msg").alias("up"), F.col("up").alias("_next"), F.col("path").alias("_path"))
        state = materialise(state.join(above, "up", "left").select(
            "msg", F.col("_next").alias("up"), F.when(F.col("_path").isNull(), F.col("path"))
            .otherwise(F.concat("_path", "path")).alias("path")), "paths")
    return state.select("msg", F.get("path", F.lit(0)).alias("root"), (F.size("path") - 1).alias("depth"), "path")


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, reply_to (turn, null at a root), quoted, depth, position and text without quotes.

    ``position`` counts a conversation's messages in reply order from 0. Null and empty texts become empty
    messages and keep their place; rows with a null conv_id or turn are left out; rows that repeat (conv_id, turn)
    are messages of their own, in the order of role and text. A passage found nowhere links nothing.
    Other columns are not read. Quotes are dropped whether or not they are found.
    """
    from_rows = conversations.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()) \
        .select("conv_id", "turn", "role", "text")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = materialise(from_rows.withColumn("place", F.row_number().over(order)).select(
        F.struct("conv_id", "place").alias("msg"), "conv_id", "turn", "role", "text"), "turns")
    numbered = runs(lines_of(turns))
    own = numbered.where("level = 0").groupBy("msg").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("at", "body"))), lambda x: x["body"]), "\n").alias("body"))
    links = parents(turns, numbered)
    placed = reply_paths(links).join(links, "msg")
    up = turns.select(F.col("msg").alias("parent"), F.col("turn").alias("reply_to"))
    rows = turns.join(placed, "msg").join(up, "parent", "left").join(own, "msg", "left")
    position = F.row_number().over(Window.partitionBy("conv_id").orderBy("path")) - 1
    text = F.trim(F.regexp_replace(F.coalesce("body", F.lit("")), "\\n{3,}", "\n\n"), F.lit(SPACES))
    return rows.select("conv_id", "turn", "role", "reply_to", "quoted", "depth", position.alias("position"),
                       text.alias("text"))
