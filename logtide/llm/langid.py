"""Language ID: a byte convolutional network trained in numpy and applied to windows of whole texts.

Every byte has a small vector; filters of several widths slide over a window of fixed length, each keeps
its maximum, and a softmax over the kept values gives class probabilities. A text's answer is the mean
of its windows' probabilities, weighted by the bytes in them.

Training reads at most ``docs_per_class`` documents of each class, chosen by a hash, and four spans of
each. This is the only bounded sample; prediction covers every byte of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
PAD = 256
UNKNOWN = "und"


@dataclass
class ByteNet:
    """Weights: byte vectors (257, dim; the last is padding), one filter bank over the widest width."""

    classes: list[str]
    vectors: np.ndarray
    filters: np.ndarray
    filter_bias: np.ndarray
    output: np.ndarray
    output_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest filter answer of each window and where it was found."""
        reach = max(WIDTHS)
        n, length = windows.shape
        places = length - reach + 1
        spans = np.lib.stride_tricks.sliding_window_view(self.vectors[windows], reach, axis=1)
        flat = np.ascontiguousarray(spans.transpose(0, 1, 3, 2)).reshape(n * places, -1)
        answers = (flat @ self.filters).reshape(n, places, -1)
        best = answers.max(axis=1) + self.filter_bias
        return best, answers

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        best, _ = self.pooled(windows)
        logits = np.maximum(best, 0) @ self.output + self.output_bias
        logits -= logits.max(axis=1, keepdims=True)
        odds = np.exp(logits)
        return odds / odds.sum(axis=1, keepdims=True)


def cut(raw: bytes, starts: np.ndarray, ends: np.ndarray, length: int = WINDOW) -> np.ndarray:
    """Windows of ``length`` bytes from the given starts, padded behind their ends."""
    buffer = np.frombuffer(raw, dtype=np.uint8)
    at = starts[:, None] + np.arange(length)
    inside = at < ends[:, None]
    out = np.full(at.shape, PAD, dtype=np.int16)
    out[inside] = buffer[at[inside]]
    return out


def train(texts: list[str], labels: list[str], dim: int = 8, per_width: int = 8, epochs: int = 5,
          batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteNet:
    """Fit by Adam on cross-entropy; classes count alike whatever their share. Same input, same weights."""
    rng = np.random.default_rng(seed)
    classes = sorted(set(labels))
    target = np.array([classes.index(x) for x in labels])
    share = np.bincount(target, minlength=len(classes)).astype(np.float64)
    weight = (len(target) / (len(classes) * share))[target].astype(np.float32)
    reach, count = max(WIDTHS), per_width * len(WIDTHS)
    shape = np.zeros((reach, dim, count), dtype=np.float32)
    for k, width in enumerate(WIDTHS):
        shape[:width, :, k * per_width:(k + 1) * per_width] = 1
    mask = shape.reshape(reach * dim, count)
    net = ByteNet(
        classes, rng.normal(0, 0.5, (PAD + 1, dim)).astype(np.float32),
        (rng.normal(0, 0.3, (reach * dim, count)) * mask).astype(np.float32), np.zeros(count, np.float32),
        rng.normal(0, 0.2, (count, len(classes))).astype(np.float32), np.zeros(len(classes), np.float32))
    net.vectors[PAD] = 0
    raws = [x.encode("utf-8", "replace") for x in texts]
    names = ("vectors", "filters", "filter_bias", "output", "output_bias")
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(raws))
        for begin in range(0, len(order), batch):
            rows = order[begin:begin + batch]
            lengths = np.array([max(1, len(raws[i])) for i in rows])
            keep = np.minimum(lengths, rng.integers(12, WINDOW + 1, len(rows)))
            offset = (rng.random(len(rows)) * (lengths - keep + 1)).astype(np.int64)
            joined = b"".join(raws[i] or b"\0" for i in rows)
            base = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            windows = cut(joined, base + offset, base + offset + keep)
            best, answers = net.pooled(windows)
            hidden = np.maximum(best, 0)
            logits = hidden @ net.output + net.output_bias
            logits -= logits.max(axis=1, keepdims=True)
            odds = np.exp(logits)
            slope = odds / odds.sum(axis=1, keepdims=True)
            slope[np.arange(len(rows)), target[rows]] -= 1
            slope *= weight[rows][:, None] / len(rows)
            back = (slope @ net.output.T) * (best > 0)
            at = answers.argmax(axis=1)
            ids = windows[np.arange(len(rows))[:, None, None], at[:, :, None] + np.arange(reach)]
            spans = net.vectors[ids].reshape(len(rows), count, reach * dim)
            grad = {"output": hidden.T @ slope, "output_bias": slope.sum(axis=0), "filter_bias": back.sum(axis=0),
                    "filters": np.einsum("nf,nfd->df", back, spans) * mask}
            into = np.zeros_like(net.vectors)
            np.add.at(into, ids, (back[:, :, None] * net.filters.T[None]).reshape(len(rows), count, reach, dim))
            into[PAD] = 0
            grad["vectors"] = into
            step += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grad[k]
                second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
                move = rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
                setattr(net, k, (getattr(net, k) - move).astype(np.float32))
    return net


def held_out(doc_id: Column) -> Column:
    """Documents that training must not see: crc32 of the id as text leaves remainder 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike("\\p{L}"), F.lit(False))


def fit(docs: DataFrame, docs_per_class: int = 300, span: int = 400) -> ByteNet | None:
    """Train on a bounded sample of labelled documents outside the held-out quarter; None without any.

    ``docs_per_class`` bounds the rows that reach the driver (four spans of ``span`` characters each).
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()
                          & ~held_out(F.col("doc_id")) & has_letter(F.col("text")))
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = labelled.select("doc_id", "lang").withColumn("_r", F.row_number().over(by_hash)) \
        .where(F.col("_r") <= docs_per_class).select("doc_id", "lang").distinct().collect()
    if not chosen:
        return None
    room = F.greatest(F.length("text") - span, F.lit(0))
    spans = F.array(*[F.substring(F.col("text"), (room * k / 3).cast("int") + 1, F.lit(span)) for k in range(4)])
    rows = labelled.where(F.col("doc_id").isin([r[0] for r in chosen])) \
        .select("doc_id", "lang", spans.alias("spans")).dropDuplicates(["doc_id", "lang"]).collect()
    rows.sort(key=lambda r: (r["lang"], r["doc_id"]))
    pairs = [(x, r["lang"]) for r in rows for x in r["spans"] if any(c.isalpha() for c in x)]
    return train([x for x, _ in pairs], [y for _, y in pairs]) if pairs else None


def predict_texts(net: ByteNet, texts: list[str], block: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Class number and mean probability of every text, over all its bytes, a block of windows at a time."""
    raws = [x.encode("utf-8", "replace") for x in texts]
    lengths = np.array([len(x) for x in raws], dtype=np.int64)
    stride = WINDOW - max(WIDTHS) + 1
    counts = np.maximum(1, -(-(lengths - max(WIDTHS) + 1) // stride))
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(raws)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = (ends - lengths)[owner] + nth * stride
    stops = ends[owner]
    joined = b"".join(raws) or b"\0"
    total = np.zeros((len(raws), len(net.classes)))
    for i in range(0, len(owner), block):
        part = slice(i, i + block)
        share = np.minimum(stops[part] - starts[part], WINDOW)
        odds = net.probabilities(cut(joined, starts[part], stops[part])) * share[:, None]
        np.add.at(total, owner[part], odds)
    total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-300)
    return total.argmax(axis=1), total.max(axis=1)


def predict(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """Documents with ``lang_pred`` and ``score``; ``und`` and 0 for a text that is null or has no letter.

    Only the text is read. Repeated rows get equal answers; other columns pass through, whatever their
    names (but columns named lang_pred or score are replaced). Without a trained net everything is ``und``.
    """
    if net is None:
        return docs.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))

    @F.pandas_udf("struct<lang_pred string, score double>")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = np.array(net.classes, dtype=object)
        for texts in batches:
            lang = np.full(len(texts), UNKNOWN, dtype=object)
            score = np.zeros(len(texts))
            known = np.flatnonzero(texts.notna().to_numpy())
            for i in range(0, len(known), 256):
                rows = known[i:i + 256]
                best, mean = predict_texts(net, texts.iloc[rows].tolist())
                lang[rows], score[rows] = names[best], np.minimum(mean, 1.0)
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    answer = classify(F.when(has_letter(F.col("text")), F.col("text")))
    return docs.withColumn("_answer", answer).withColumn("lang_pred", F.col("_answer.lang_pred")) \
        .withColumn("score", F.col("_answer.score")).drop("_answer")
