"""Corpus pipeline: quality rules, language ID, line dedup, near-duplicate removal, packing.

Every stage reads all documents that the one before kept and is written as Parquet before the next. The tables
that a stage wrote on its way are deleted once its result is written; the results stay. Stages 1 to 4 return the columns of ``documents``; ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm import langid, linededup, neardup, packing, quality
from logtide.session import materialise, noted_tables, release_tables

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least mean probability of the predicted language; texts below, and those without a letter, go.
LANGUAGE_SCORE = 0.3


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood-ratio threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.judge(docs, quality.trusted_ids(labels)).where("kept").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    answered = langid.predict(docs.select(*COLUMNS), langid.fit(docs))
    return answered.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LANGUAGE_SCORE)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier in the corpus; those that keep no word are left out."""
    done = linededup.dedup_lines(docs.select(*COLUMNS))
    # The text leaves a generator, so that it is joined from its lines once and not again for the filter and the length.
    done = done.withColumn("text", F.explode_outer(F.array("text")))
    return done.where(linededup.has_word(F.col("text"))).withColumn("n_chars", F.length("text").cast("long")) \
        .select(*COLUMNS)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of every component of near duplicates; equal rows count once."""
    kept = neardup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, F.col("doc_id") == F.col("_id")).withColumn("_text", F.xxhash64("text")) \
        .dropDuplicates(["doc_id", "_text"]).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bin and offset of every piece of every document that is left."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("line_dedup", line_dedup),
          ("minhash_near_dedup", minhash_near_dedup), ("best_fit_packing", best_fit_packing)]

#: None: SQL can express neither the network, nor the one-edit line join, nor the packing; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with noted_tables() as own:
            found = stage(spark, docs, sf_dir)
        docs = materialise(found, f"pipeline-{name}")
        release_tables(spark, own)
    return docs
