"""Line dedup across documents: deletion-neighbourhood join over the words of lines.

Two lines are near-equal if one word edit (a word changed, added or left out) makes them equal. A line goes
when an equal line stands earlier, or when a near-equal one of at least ``MIN_WORDS`` words does;
"earlier" means a smaller (doc_id, line number). Lines without a word stay.

1. Equal lines meet by hash; each distinct line keeps its first place. No text is shuffled.
2. Half filter: after one edit either the words before the middle or those behind it are unchanged, so each
   distinct line posts hashes of its halves (for its own length and for one word less), and only lines
   that share a half with another line go on. This is exact and needs four rows a line.
3. Those lines emit every variant with one word deleted, as hashed keys. Lines changed in the same place share
   a variant at that place; a longer line shares one with the whole shorter line. In both cases the
   earliest of a group is within one edit of all that must yield to it, so groups are only reduced to their
   earliest line, never paired; the pairs left are then verified on their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.llm.text import SPACES, bind, words
from logtide.session import materialise

MIN_WORDS = 8
#: A bitmap of hashes has 2 ** MAP_BITS words of 64 bits, 1 MB.
MAP_BITS = 17


def has_word(line: Column) -> Column:
    return F.trim(line, F.lit(SPACES)) != ""


def places(docs: DataFrame) -> DataFrame:
    """(doc_id, at, line) for every line of every text."""
    return docs.where(F.col("text").isNotNull()).select(
        "doc_id", F.posexplode(F.split("text", "\\n", -1)).alias("at", "line"))


def two_hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def spaced(line: Column) -> Column:
    """The words of a line with one space between them; most lines stand like that already and are not split."""
    odd = F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for space in SPACES.replace(" ", ""):
        odd = odd | F.contains(line, F.lit(space))
    return F.when(odd, F.array_join(words(line), " ")).otherwise(line)


def word_count(text: Column) -> Column:
    """Words of a ``spaced`` line that has any."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1


def halves(text: Column, size: Column) -> Column:
    """Hashes of the halves of a ``spaced`` line, for its own number of words and for one less (longer side of an insertion)."""
    def of(n: Column) -> list[Column]:
        cut = F.floor(n / 2).cast("int")
        return [F.xxhash64(F.lit(0), n, F.call_function("substring_index", text, F.lit(" "), cut)),
                F.xxhash64(F.lit(1), n, F.call_function("substring_index", text, F.lit(" "), cut - n))]

    return F.array(*of(size), *of(size - 1))


def first_places(lines: DataFrame, min_words: int) -> DataFrame:
    """Distinct lines (h1, h2) with their first place (doc_id, at) and their half hashes."""
    fuzzy = F.when(F.col("_n") >= min_words, halves(F.col("_s"), F.col("_n")))
    text = spaced(F.col("line"))
    rows = lines.where(text != "").withColumn("_s", text).withColumn("_n", word_count(F.col("_s"))) \
        .select("doc_id", "at", *two_hashes(F.col("line")), fuzzy.alias("halves"))
    return rows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "at")).alias("place"),
                                        F.max("halves").alias("halves"))


def map_word(key: Column) -> Column:
    """Word of a bitmap that a 64-bit hash falls into."""
    return F.shiftrightunsigned(key, 64 - MAP_BITS).cast("int")


def map_bit(key: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), key.bitwiseAND(63).cast("int"))


def bitmap(rows: DataFrame, key: Column) -> DataFrame:
    """One row with a bitmap (array of longs) of the 64-bit hashes ``key`` of all rows, of the same size for every corpus."""
    filled = rows.select(map_word(key).alias("word"), map_bit(key).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    dense = rows.sparkSession.range(1 << MAP_BITS).select(F.col("id").cast("int").alias("word")).join(filled, "word", "left") \
        .select("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return dense.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("cells")).select(F.col("cells.bits").alias("map"))


def likely(rows: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """Rows whose hash is in the bitmap of ``wanted``, which has the columns of ``key`` too.

    It keeps most rows that find no partner out of the shuffle of the exact join that must follow; a fuller map only
    lets more of them through.
    """
    found = materialise(bitmap(wanted, key), "bitmap").scalar()
    return rows.withColumn("_map", found).where(F.get("_map", map_word(key)).bitwiseAND(map_bit(key)) != 0).drop("_map")


def with_mates(firsts: DataFrame) -> DataFrame:
    """First places (doc_id, at) of the distinct lines that share a half with another line."""
    posted = firsts.where("halves is not null").select(
        "place", F.explode(F.array_distinct("halves")).alias("half"))
    met = materialise(posted.groupBy("half").agg(F.count("*").alias("lines")).where("lines > 1").select("half"), "halves")
    return likely(posted, F.col("half"), met).join(met, "half").select("place.doc_id", "place.at").distinct()


def running_xor(values: Column) -> Column:
    """Every value of an array of longs combined by exclusive or with all before it, in rounds of doubled distance."""
    rounds = F.sequence(F.lit(0), F.length(F.bin(F.size(values) - 1)) - 1)

    def further(acc: Column, k: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1), k)
        moved = F.concat(F.array_repeat(F.lit(0).cast("long"), step), F.slice(acc, F.lit(1), F.size(acc) - step))
        return F.zip_with(acc, F.slice(moved, F.lit(1), F.size(acc)), lambda a, b: a.bitwiseXOR(b))

    return F.aggregate(rounds, values, further)


def total_xor(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x))


def variants(lines: DataFrame) -> DataFrame:
    """(place, key, pos, size): one row per deleted word, and one (pos -1) for the whole line; size is what is left.

    The key of a word sequence is the exclusive or of the hashes of its words with their positions. From the variant
    without word i - 1 to the one without word i only word i - 1 comes back and word i goes, so all variants of a
    line are one running combination and no word is hashed per variant.
    """
    def of(own: Column) -> Column:
        return bind(F.transform("tokens", lambda w, i: F.xxhash64(w, i - 1)), lambda left: bind(F.concat(
            F.array(total_xor(left).bitwiseXOR(F.get(left, F.lit(0)))),
            F.zip_with(F.slice(own, F.lit(1), F.size(own) - 1), F.slice(left, F.lit(2), F.size(left)),
                       lambda a, b: a.bitwiseXOR(b))),
            lambda steps: F.concat(
                F.transform(running_xor(steps), lambda key, i: F.struct(
                    key.alias("key"), i.alias("pos"), (F.size(own) - 1).alias("size"))),
                F.array(F.struct(total_xor(own).alias("key"), F.lit(-1).alias("pos"), F.size(own).alias("size"))))))

    own = F.transform("tokens", lambda w, i: F.xxhash64(w, i))
    return lines.select("place", F.explode(bind(own, of)).alias("v")).select("place", "v.key", "v.pos", "v.size")


def yields(rows: DataFrame) -> DataFrame:
    """(place, to): lines and the earliest line of a group that they must yield to, before verification.

    The variants are dealt by key once; all groups lie inside a key.
    """
    spot, group = Window.partitionBy("key", "size", "pos"), Window.partitionBy("key", "size")
    met = rows.repartition("key").withColumn("same", F.min("place").over(spot)) \
        .withColumn("short", F.min(F.when(F.col("pos") < 0, F.col("place"))).over(group)) \
        .withColumn("long", F.min(F.when(F.col("pos") >= 0, F.col("place"))).over(group))
    other = F.when(F.col("pos") < 0, F.col("long")).otherwise(F.col("short"))
    return met.select("place", F.explode(F.filter(F.array("same", other), lambda t: t < F.col("place"))).alias("to")).distinct()


def one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays are at most one changed, added or missing word apart."""
    n, m = F.size(a), F.size(b)
    short = F.least(n, m)
    lead = F.coalesce(F.array_min(F.filter(F.transform(F.sequence(F.lit(0), short), lambda i: F.when(
        (i == short) | (F.get(a, i) != F.get(b, i)), i)), lambda i: i.isNotNull())), short)
    tail_a = F.slice(a, lead + F.when(n >= m, 2).otherwise(1), n)
    tail_b = F.slice(b, lead + F.when(m >= n, 2).otherwise(1), m)
    return (F.abs(n - m) <= 1) & (tail_a == tail_b)


def near_copies(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(doc_id, at) of first places whose line yields to an earlier near-equal line."""
    spots = materialise(with_mates(firsts), "spots")
    found = likely(places(docs), F.xxhash64("doc_id", "at"), spots).join(spots, ["doc_id", "at"]) \
        .select(F.struct("doc_id", "at").alias("place"), words(F.col("line")).alias("tokens"))
    lines = materialise(found.where(F.size("tokens") > 0).dropDuplicates(["place"]), "mates")
    pairs = yields(variants(lines))
    old = lines.select(F.col("place").alias("to"), F.col("tokens").alias("old"))
    return pairs.join(lines, "place").join(old, "to").where(one_edit(F.col("tokens"), F.col("old"))) \
        .select("place.doc_id", "place.at").distinct()


def kept_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id and ``kept``: array of (at, h1) of the lines with a word that stay; documents without one are absent."""
    lines = places(docs)
    firsts = materialise(first_places(lines, min_words), "first-lines")
    gone = near_copies(docs, firsts)
    worded = firsts.select("h1", "place.doc_id", "place.at").join(gone, ["doc_id", "at"], "left_anti")
    return worded.groupBy("doc_id").agg(F.collect_list(F.struct("at", "h1")).alias("kept"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Documents with repeated lines taken out of ``text``; adds n_lines and n_removed.

    Null and empty texts stay as they are (0 or 1 line, none removed). A text that loses all lines
    becomes empty. Rows that repeat a doc_id are one document to the order of places: equal rows keep the
    same lines, and different texts under one id each keep their own lines. A null doc_id sorts before
    all others. Other columns pass through, except those named n_lines and n_removed.
    """
    kept = kept_lines(docs, min_words).select(F.col("doc_id").alias("_id"), F.col("kept").alias("_kept"))
    lines = F.split("text", "\\n", -1)
    joined = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")), "left").withColumn("_lines", lines)
    worded = F.transform(F.filter(F.col("_kept"), lambda k: F.xxhash64(F.get(F.col("_lines"), k["at"])) == k["h1"]),
                         lambda k: k["at"])
    blank = F.filter(F.transform("_lines", lambda line, i: F.when(~has_word(line), i)), lambda i: i.isNotNull())
    empty = F.array().cast("array<int>")
    return joined.withColumn("_stay", F.sort_array(F.concat(F.coalesce(worded, empty), F.coalesce(blank, empty)))) \
        .withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines"))) \
        .withColumn("n_removed", F.col("n_lines") - F.when(F.col("text").isNull(), 0).otherwise(F.size("_stay"))) \
        .withColumn("text", F.when(F.col("text").isNotNull(), F.array_join(
            F.transform("_stay", lambda at: F.get(F.col("_lines"), at)), "\n"))) \
        .drop("_id", "_kept", "_lines", "_stay")
