"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates.

A text is read as words without ASCII white space, A-Z lower-cased, and as word shapes (capitals, other letters,
digits and other signs become one sign each, runs of one sign are shortened). Words, pairs of words and
one to three neighbouring shapes are hashed into buckets; a bucket's value is its share of the text's n-grams.
The score is the logistic function of a bias and one sparse dot product, whatever the length of the text.

Training reads at most ``docs_per_class`` labelled rows of each label, chosen by a hash of id and text: the only
bounded sample. Their n-gram counts, not their texts, reach the driver. Every row is scored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 18
BLOCK_BYTES = 4 << 20
SCALE = 8.0
KINDS = 5
_SIGNS = str.maketrans("0123456789", "0" * 10)


def shape(word: str) -> str:
    """"A" for capitals, "a" for other letters, "0" for digits, other signs as they are; no sign twice in a row."""
    drawn = "".join("A" if c.isupper() else "a" if c.isalpha() else c for c in word.translate(_SIGNS))
    return re.sub(r"(.)\1+", r"\1", drawn, flags=re.DOTALL)


def _mixed(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(salt)) >> np.uint64(7)


def grams(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of a block of texts, and the number of the text of each; KINDS arrays after another."""
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split])
    codes, known = pd.factorize(np.array([w for ws in split for w in ws], dtype=object))
    plain = np.array([zlib.crc32(w.lower()) for w in known], dtype=np.uint64)[codes] if len(known) else \
        np.zeros(0, dtype=np.uint64)
    drawn = np.array([zlib.crc32(shape(w.decode("utf-8", "replace")).encode()) for w in known],
                     dtype=np.uint64)[codes] if len(known) else plain
    owner = np.repeat(np.arange(len(texts)), sizes)
    two = owner[1:] == owner[:-1]
    three = two[1:] & two[:-1]
    pair = _mixed(drawn[:-1], drawn[1:], 3)
    found = [_mixed(plain, plain, 1), _mixed(plain[:-1], plain[1:], 2)[two], _mixed(drawn, drawn, 5), pair[two],
             _mixed(pair[:-1], drawn[2:], 4)[three] if len(pair) > 1 else pair[:0]]
    owners = [owner, owner[1:][two], owner, owner[1:][two], owner[2:][three] if len(pair) > 1 else owner[:0]]
    return (np.concatenate(found) % np.uint64(buckets)).astype(np.int64), np.concatenate(owners)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        index, owner = grams(texts, len(self.weights))
        n = np.bincount(owner, minlength=len(texts))
        dot = np.bincount(owner, weights=self.weights[index], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(self.bias + SCALE * dot / np.maximum(n, 1), -35, 35)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], buckets: int = BUCKETS, epochs: int = 4,
          alpha: float = 0.5, beta: float = 1.0, l1: float = 0.01, l2: float = 0.01, seed: int = 5) -> Model:
    """Follow the regularised leader, one row after another; rows are (buckets, values). Same input, same weights.

    Weights stay implicit in ``z`` (summed gradients less the learning rate's pull) and ``n`` (summed squares); the last
    place is the bias, which is not regularised. Without rows the score is one half, with one label it leans to that.
    """
    z, n = np.zeros(buckets + 1), np.zeros(buckets + 1)

    def leader(at: np.ndarray) -> np.ndarray:
        over = np.abs(z[at]) - np.where(at == buckets, 0.0, l1)
        rate = (beta + np.sqrt(n[at])) / alpha + np.where(at == buckets, 0.0, l2)
        return np.where(over > 0, -np.sign(z[at]) * over / rate, 0.0)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, value = np.append(rows[k][0], buckets), np.append(rows[k][1], 1.0)
            w = leader(at)
            error = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - labels[k]
            slope = error * value
            z[at] += slope - (np.sqrt(n[at] + slope ** 2) - np.sqrt(n[at])) / alpha * w
            n[at] += slope ** 2
    every = leader(np.arange(buckets + 1))
    return Model(every[:-1], float(every[-1]))


def held_out(doc_id: Column) -> Column:
    """Rows kept out of training: CRC-32 of the id as text divides by 5; null ids are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[slice]:
    """Neighbouring texts of about ``limit`` bytes at most; a longer text is a block of its own."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield slice(first, i)
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield slice(first, len(texts))


def fit(docs: DataFrame, labels: DataFrame, docs_per_class: int = 3000, buckets: int = BUCKETS) -> Model:
    """Model of ``labels`` (doc_id, quality 0 or 1); other labels and nulls are ignored, of two labels for an id the smaller counts."""
    usable = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
    dealt = F.xxhash64("doc_id")
    chosen = None
    for label in (0, 1):
        ids = F.broadcast(usable.where(F.col("quality") == label).orderBy(dealt, "doc_id").limit(docs_per_class))
        rows = docs.select("doc_id", "text").join(ids, "doc_id").orderBy(dealt, F.xxhash64("text")).limit(docs_per_class)
        chosen = rows if chosen is None else chosen.union(rows)

    def counted(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for text, label in zip(pdf["text"], pdf["quality"]):
                index, _ = grams([(text or "").encode()], buckets)
                at, count = np.unique(index, return_counts=True)
                yield pd.DataFrame({"at": [at.astype(np.int32).tobytes()], "label": [int(label)],
                                    "value": [(SCALE * count / max(len(index), 1)).astype(np.float32).tobytes()]})
    found = chosen.repartition(docs.sparkSession.sparkContext.defaultParallelism) \
        .mapInPandas(counted, "at binary, label int, value binary").collect()
    found.sort(key=lambda r: (r["label"], bytes(r["at"]), bytes(r["value"])))
    rows = [(np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["value"], np.float32).astype(float))
            for r in found]
    return train(rows, [r["label"] for r in found], buckets)


def score(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` of every row by its whole text; null and empty texts have the bias alone.

    Equal texts get equal scores; ids may be null or repeat. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            texts = [(t or "").encode() for t in pdf["text"]]
            parts = [shared.value.scores(texts[s]) for s in blocks(texts)]
            pdf["score"] = np.concatenate(parts) if parts else np.zeros(0)
            pdf["doc_id"] = pdf["doc_id"].astype("Int64")
            pdf["predicted"] = (pdf["score"] >= least).astype(np.int32)
            yield pdf[["doc_id", "score", "predicted"]]
    return docs.select("doc_id", "text").mapInPandas(scored, "doc_id long, score double, predicted int")
