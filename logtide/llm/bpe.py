"""Byte-level BPE over a distinct-word table.

Spark splits every text into words at places where the tokenizer's own pattern always splits too: before
the blank that leads a word, and around runs of other white space and special tokens. Each block of
documents (one Arrow batch) is turned into the table of its distinct words and positions in it; every
distinct word is encoded once and its ids are joined back by position. Decoding joins each id with the piece
of the vocabulary and reads the joined bytes as UTF-8.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode White_Space, as the tokenizer's pattern sees it; Java's own class is ASCII only.
WHITE = "\\u0009-\\u000D\\u0020\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
WORD = f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


def load_definition(path: str) -> str:
    """A tokenizer's JSON text; ``path`` is read on the driver and shipped to the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def special_tokens(definition: str) -> list[str]:
    return [t["content"] for t in json.loads(definition)["added_tokens"]]


def words(text: Column, specials: list[str]) -> Column:
    """Words of a text whose encodings, put in a row, are the encoding of the text; empty for null."""
    whole = F.coalesce(text, F.lit(""))
    found = lambda part: F.regexp_extract_all(part, F.lit(WORD), 0)
    if not specials:
        return found(whole)
    either = "|".join(re.sub(r"([^\w\s])", r"\\\1", s) for s in sorted(specials, key=len, reverse=True))
    between = F.transform(F.split(whole, either, -1), found)
    held = F.transform(F.regexp_extract_all(whole, F.lit(either), 0), lambda s: F.array(s))
    none = F.array().cast("array<string>")
    return F.flatten(F.zip_with(between, held, lambda a, b: F.concat(a, F.coalesce(b, none))))


@lru_cache(maxsize=2)
def _tokenizer(definition: str):
    from tokenizers import Tokenizer
    made = Tokenizer.from_str(definition)
    made.no_truncation()
    made.no_padding()
    return made


def encode_words(definition: str, distinct: list[str], step: int = 4096) -> list[bytes]:
    """Ids of every word as little-endian unsigned 32-bit integers.

    The library's encodings take about a kilobyte a word, so only ``step`` of them are held at a time.
    """
    made = _tokenizer(definition)
    return [array("I", e.ids).tobytes() for i in range(0, len(distinct), step)
            for e in made.encode_batch(distinct[i:i + step], add_special_tokens=False)]


def encoder(docs: DataFrame, definition: str) -> tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]:
    """(doc_id, words) of all documents, and the function that turns batches of them into doc_id, n_tokens and ids."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            table = lists.flatten().dictionary_encode()
            codes = encode_words(shared.value, table.dictionary.to_pylist())
            at = table.indices.to_numpy(zero_copy_only=False)
            ends = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
            ids = [b"".join([codes[i] for i in at[start:end].tolist()])
                   for start, end in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", words(F.col("text"), special_tokens(definition)).alias("words")), run


def encode(docs: DataFrame, definition: str) -> DataFrame:
    """doc_id, n_tokens and ``ids`` (little-endian unsigned 32-bit integers) of every document's whole text.

    A null or empty text has no ids. Every row is encoded for itself, repeated rows too.
    """
    split, run = encoder(docs, definition)
    return split.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary")


def byte_alphabet() -> dict[str, int]:
    """Byte of each letter of the byte-level alphabet: printable bytes stand for themselves, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def pieces(definition: str) -> list[bytes]:
    """Bytes of every id of the vocabulary, special tokens included."""
    model = json.loads(definition)
    alphabet = byte_alphabet()
    found = {i: bytes(alphabet[c] for c in token) for token, i in model["model"]["vocab"].items()}
    found |= {t["id"]: t["content"].encode() for t in model["added_tokens"]}
    return [found.get(i, b"") for i in range(max(found) + 1)]


def decode(encoded: DataFrame, definition: str) -> DataFrame:
    """Adds ``text`` to doc_id, n_tokens and ids; bytes that are no UTF-8 become replacement characters.

    The id-to-piece table has one row per id of the vocabulary (some 50,000) and is broadcast.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(pieces(definition))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(shared.value, dtype=object)
        for batch in batches:
            texts = []
            for packed in batch.column("ids"):
                ids = np.frombuffer(packed.as_buffer(), dtype="<u4") if packed.is_valid else []
                texts.append(b"".join(table[ids].tolist() if len(ids) else []).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             names=["doc_id", "n_tokens", "ids", "text"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids binary, text string")
