"""Registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm import (bpe, classifier, langid, linededup, manifest, neardup, neighbours, packing, quality, quotes, runs,
                         tokencount, wrappers)
from logtide.session import materialise, shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge(docs, quality.trusted_ids(table(spark, sf_dir, "labels")), text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "llr")


def tokenizer() -> str:
    """Definition of the byte-level tokenizer that the registered queries use."""
    import public_tokenizers
    return bpe.load_definition(public_tokenizers.path("byte_bpe_50k.json"))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again, as digests."""
    definition = tokenizer()
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), definition), definition)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("text", 256).alias("decoded_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted by separators in the token files written from the documents."""
    folder = shared_path(spark, "token-store")
    separator = 50257  # the first id behind the vocabulary, so no text can hold it
    split, to_ids = bpe.encoder(table(spark, sf_dir, "documents"), tokenizer())
    placed = materialise(tokencount.write_store(split, folder, separator, before=to_ids), "placed")
    return placed.join(tokencount.scan(spark, folder, separator), ["file", "nth"]).select("doc_id", "n_tokens")


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth vector."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; a quarter of the documents is held out from training."""
    docs = table(spark, sf_dir, "documents")
    answered = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return answered.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bin and offset of every piece of every document."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without lines that stand earlier in the corpus, as counts and a digest."""
    done = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of every conversation in reply order, without quotes."""
    return quotes.format_chats(table(spark, sf_dir, "conversations"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near-duplicate documents of every document, the smallest id kept."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document's words, a tenth of the documents made periodic."""
    return runs.detect_runs(table(spark, sf_dir, "documents"), runs.planted)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents, one in seven tampered with before its proof is checked."""
    return manifest.manifest(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 0)


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; a fifth of the documents is held out from training."""
    docs = table(spark, sf_dir, "documents")
    scored = classifier.score(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_language_id": op2_language_id,
    "op3_token_counts": op3_token_counts,
    "op4_nn_descent": op4_nn_descent,
    "op5_quality_rules": op5_quality_rules,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_line_dedup": op7_line_dedup,
    "op8_quotation_linking": op8_quotation_linking,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_wrapper_extraction": op10_wrapper_extraction,
    "op11_period_runs": op11_period_runs,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_quality_classifier": op13_quality_classifier,
}

ORACLES: dict[str, str] = {"op12_merkle_manifest": manifest.oracle()}


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
