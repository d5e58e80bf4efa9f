"""Quality rules: hashed n-gram log-likelihood ratio between trusted and raw text, plus base rules.

Every document is read as words (A-Z lower-cased) and as word shapes (runs of capitals, other letters and
digits become one sign each, runs of one other sign are shortened). Words, pairs of neighbouring words and
pairs of neighbouring shapes are hashed into a fixed number of buckets. Two multinomials over the buckets are
counted over whole tables: all documents, and the trusted ones. A document's score is the mean log ratio
of its grams; the same threshold decides on every document. It is set by the trusted documents' scores, each
taken with the counts of the half of them that it is not in, as a new document would be scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.llm.text import SPACE, SPACES, bind, lower_ascii, windows5, words
from logtide.session import materialise

BUCKETS = 1 << 14
#: Trusted ids are looked up in blocks of 2 ** BLOCK_BITS neighbouring ids.
BLOCK_BITS = 10
#: The threshold lies so many standard deviations below the mean score of the trusted documents.
DEVIATIONS = 6


def lower_word(word: Column) -> Column:
    """``lower_ascii`` of one word; a word of ASCII only takes the faster way."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(lower_ascii(word))


def grams(text: Column, buckets: int = BUCKETS, tokens: Column | None = None) -> Column:
    """Bucket numbers of a text's words (A-Z lower-cased), neighbouring words and neighbouring word shapes.

    ``tokens`` are the text's words, where they are split already.
    """
    body = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    shape = F.regexp_replace(body, "[^\\p{Lu}\\P{L}]+", "a")
    shape = F.regexp_replace(shape, "\\p{Lu}+", "A")
    shape = F.regexp_replace(shape, "\\p{N}+", "0")
    shape = F.regexp_replace(shape, "([^\\x20\\x09-\\x0DAa0])\\1+", "$1")

    def bucket(h: Column) -> Column:
        return F.pmod(h, F.lit(buckets)).cast("int")

    def hashed(found: Column) -> Column:
        return F.transform(found, lambda t: F.xxhash64(t))

    def pairs(t: Column) -> Column:
        return F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1), lambda a, b: bucket(F.xxhash64(a, b)))

    plain = hashed(F.split(F.concat(F.lit("^ "), lower_ascii(body)), SPACE)) if tokens is None else \
        F.transform(F.concat(F.array(F.lit("^")), tokens), lambda t: F.xxhash64(lower_word(t)))
    shapes = hashed(F.split(F.concat(F.lit("^^ "), shape), SPACE))
    every = bind(plain, lambda t: F.concat(F.transform(F.slice(t, 2, F.size(t) - 1), bucket), pairs(t), bind(shapes, pairs)))
    return F.when(body == "", F.array().cast("array<int>")).otherwise(every)


def half_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(2))


def trusted_halves(trusted: DataFrame) -> DataFrame:
    """Every id of ``trusted`` once, null ids left out, with the half (0 or 1) it belongs to."""
    return trusted.where("doc_id is not null").select(F.col("doc_id").alias("_id")).distinct() \
        .withColumn("_half", half_of(F.col("_id")))


def trusted_grams(docs: DataFrame, halves: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``_half`` and ``_grams`` of all documents named by ``halves``, the result of ``trusted_halves``."""
    rows = docs.select("doc_id", "text").join(halves, F.col("doc_id") == F.col("_id"))
    return rows.select("_half", grams(F.col("text"), buckets).alias("_grams"))


def id_blocks(ids: DataFrame) -> DataFrame:
    """(_block, _members): the distinct ids of ``ids`` (column ``_id``), as offsets in blocks of neighbouring ids.

    About two bytes an id where ids lie close together, so that Spark can broadcast far more of them; ids that lie
    far apart take a row each, and Spark joins them as it joins any other table.
    """
    key = F.col("_id").cast("long")
    return ids.select(F.shiftright(key, BLOCK_BITS).alias("_block"),
                      key.bitwiseAND((1 << BLOCK_BITS) - 1).cast("short").alias("_at")) \
        .groupBy("_block").agg(F.sort_array(F.collect_set("_at")).alias("_members"))


def with_half(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """``docs`` with ``_half``: that of ``trusted_halves`` for ids in ``blocks``, null for all others and null ids."""
    key = F.col("doc_id").cast("long")
    offset = key.bitwiseAND((1 << BLOCK_BITS) - 1).cast("short")
    met = docs.join(blocks, F.shiftright(key, BLOCK_BITS) == F.col("_block"), "left")
    return met.withColumn("_half", F.when(F.array_contains("_members", offset), half_of(F.col("doc_id")))) \
        .drop("_block", "_members")


def log_ratios(docs: DataFrame, halves: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket_ratios`` of all ``docs``; those named by ``halves`` are read from ``target``, their ``trusted_grams``."""
    others = docs.select("doc_id", "text").join(halves, F.col("doc_id") == F.col("_id"), "left_anti") \
        .select(F.lit(None).cast("long").alias("_half"), grams(F.col("text"), buckets).alias("_grams"))
    return bucket_ratios(others.union(target.select("_half", "_grams")), buckets)


def bucket_ratios(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row with the arrays ``llr``: log(target) - log(raw) of each bucket, and ``llr0`` and ``llr1``.

    ``found`` holds ``_grams`` of all documents and ``_half``, null for those not trusted. Raw counts are those of
    all documents. They are brought to the target's size and one is added to both, so that a bucket of few
    grams stays near 0 and the ratio has the same centre at every corpus size. ``llr0`` and ``llr1`` have the half 0
    or 1 of the trusted documents as their target, its counts brought to the size of the whole.

    Grams are counted by bucket before the shuffle, so a task passes one row a bucket on. Without a trusted
    document all ratios are 0. (The outer explode keeps Spark from adding a filter that reads or makes all grams a
    second time; its null bucket meets no row.)
    """
    counted = found.select("_half", F.explode_outer("_grams").alias("bucket")).groupBy("bucket").agg(
        F.count("*").alias("raw"), F.count("_half").alias("t"), F.sum("_half").alias("t1"))
    dense = found.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")) \
        .join(counted, "bucket", "left").na.fill(0, ["raw", "t", "t1"]).withColumn("t0", F.col("t") - F.col("t1"))
    table = dense.agg(*[F.sum(c).alias(f"{c}_n") for c in ("raw", "t", "t0", "t1")],
                      F.array_sort(F.collect_list(F.struct("bucket", "raw", "t", "t0", "t1"))).alias("cells"))

    def ratios(target: str) -> Column:
        size = F.col(f"{target}_n")
        return F.transform("cells", lambda c: F.when(size > 0, F.log(
            (c[target] * F.col("t_n") / size + 1) / (c["raw"] * F.col("t_n") / F.col("raw_n") + 1))).otherwise(0.0))

    return table.select(ratios("t").alias("llr"), ratios("t0").alias("llr0"), ratios("t1").alias("llr1"))


def mean_ratio(found: Column, ratios: Column) -> Column:
    total = bind(ratios, lambda llr: F.aggregate(found, F.lit(0.0), lambda acc, b: acc + F.get(llr, b)))
    return F.when(F.size(found) > 0, total / F.size(found)).otherwise(0.0)


def trusted_threshold(target: DataFrame, ratios: DataFrame) -> DataFrame:
    """One row: mean less ``DEVIATIONS`` standard deviations of the trusted documents of ten words or more (three grams each)."""
    other = F.when(F.col("_half") == 0, ratios.select("llr1").scalar()).otherwise(ratios.select("llr0").scalar())
    scores = target.where(F.size("_grams") >= 30).withColumn("_llr", other) \
        .select(mean_ratio(F.col("_grams"), F.col("_llr")).alias("score"))
    return scores.agg(F.coalesce(F.avg("score") - DEVIATIONS * F.stddev_pop("score"), F.lit(0.0)).alias("threshold"))


def base_columns(docs: DataFrame) -> DataFrame:
    """Base counts of every document's whole text, added to its columns (null text: all 0).

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that equal an
    earlier line), n_repeat_words (words in five-word windows found twice or more, the first included)
    and base_failed. Windows are compared by 64-bit hashes within their own text.
    """
    return _counted(docs).drop("_words")


def _counted(docs: DataFrame) -> DataFrame:
    """``base_columns`` with the words (``_words``) they were counted from."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(SPACES)) != "")
    spans = F.when(F.size("_words") >= 5, windows5(F.col("_words"))).otherwise(F.array().cast("array<bigint>"))
    ranked = F.array_sort(F.transform(F.col("_spans"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(z: Column) -> Column:
        places = F.transform(z, lambda x, j: F.when(
            (x["h"] == F.get(z, j - 1)["h"]) | (x["h"] == F.get(z, j + 1)["h"]), x["i"]))
        starts = F.filter(places, lambda p: p.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.sequence(p, p + 4)))))

    out = docs.withColumn("_words", words(F.col("text"))) \
        .withColumn("_spans", spans) \
        .withColumn("n_words", F.size("_words").cast("long")) \
        .withColumn("word_chars", F.length(F.concat_ws("", "_words")).cast("long")) \
        .withColumn("n_symbols", (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", "")))
                    .cast("long")) \
        .withColumn("_lines", lines) \
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")) \
        .withColumn("_ranked", F.when(F.size(F.array_distinct("_spans")) < F.size("_spans"), ranked)) \
        .withColumn("n_repeat_words", F.when(F.col("_ranked").isNull(), 0).otherwise(
            bind(F.col("_ranked"), repeated)).cast("long")) \
        .withColumn("base_failed", (F.col("n_words") < 10)
                    | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return out.drop("_spans", "_lines", "_ranked")


def judge(docs: DataFrame, trusted: DataFrame, threshold: float | None = None,
          buckets: int = BUCKETS, text: bool = True) -> DataFrame:
    """Documents with the base counts, ``llr`` (mean log ratio, 0 without words) and ``kept``.

    Every row is judged by its own text: repeated rows get equal verdicts, null or empty texts fail the
    base rules, other columns pass through (but those of the names added here are replaced). Without ``threshold``
    it is that of ``trusted_threshold``, 0 where no trusted document has ten words.

    Texts are read once: the base counts and the grams of every document are written, and counts, threshold and
    verdicts are taken from there. ``text=False`` leaves the text out of the result and so out of what is written.
    """
    blocks = materialise(id_blocks(trusted_halves(trusted)), "trusted")
    read = _counted(with_half(docs, blocks)).withColumn("_grams", grams(F.col("text"), buckets, F.col("_words")))
    read = materialise(read.drop("_words", *([] if text else ["text"])), "grams")
    ratios = materialise(bucket_ratios(read, buckets), "ratios")
    least = F.lit(threshold) if threshold is not None else materialise(
        trusted_threshold(read.where("_half is not null"), ratios), "threshold").scalar()
    scored = read.withColumn("_llr", ratios.select("llr").scalar()) \
        .withColumn("llr", mean_ratio(F.col("_grams"), F.col("_llr"))) \
        .withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= least))
    return scored.drop("_half", "_grams", "_llr")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents that count as trusted target text: labelled quality 1."""
    return labels.where("quality = 1").select("doc_id")
