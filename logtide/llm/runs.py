"""Periodic run detection by recompression: runs of at least four periods, without suffix arrays.

A text's word numbers are recompressed: equal neighbours become one block symbol, then pairs across a partition of
the symbols become one symbol, alternately until one symbol is left. Symbols depend on their content only, so equal
stretches get equal symbols but for their borders, and the longest common extension of two places is found by
climbing and descending the levels. A run of period q and four periods covers four neighbouring multiples of
q with equal words: places of this harmonic grid are the candidates, extended exactly on both sides by the grammar.

Texts are worked on one by one in Arrow tasks; memory is bounded by the longest text (about 10 numbers a word).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

LEAST = 6
PERIODS = 4
GRID = 1 << 20


class Grammar:
    """Run-length grammar of a sequence: levels of symbols, the first child of each symbol and each one's parent.

    Level 0 is the sequence. Odd levels hold blocks of the level below, even ones pairs.
    """

    def __init__(self, sequence: np.ndarray, seed: int = 3):
        deal = np.random.default_rng(seed)
        symbols = np.unique(sequence, return_inverse=True)[1].astype(np.int64)
        self.symbols = [memoryview(symbols)]
        self.first, self.parent = [memoryview(np.arange(len(symbols) + 1))], []
        while len(symbols) > 1:
            begin, keys = self._paired(symbols, deal) if len(self.parent) % 2 else self._blocks(symbols)
            opens = np.zeros(len(symbols), dtype=np.int64)
            opens[begin[1:]] = 1
            self.parent.append(memoryview(np.cumsum(opens)))
            self.first.append(memoryview(np.append(begin, len(symbols))))
            symbols = np.unique(keys, return_inverse=True)[1].astype(np.int64)
            self.symbols.append(memoryview(symbols))

    @staticmethod
    def _blocks(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = np.append(0, np.flatnonzero(symbols[1:] != symbols[:-1]) + 1)
        return begin, symbols[begin] * (len(symbols) + 1) + np.diff(np.append(begin, len(symbols)))

    @staticmethod
    def _paired(symbols: np.ndarray, deal: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a left and a right symbol, by the best of some partitions of the symbols."""
        size, joined = int(symbols.max()) + 1, np.zeros(len(symbols) - 1, dtype=bool)
        while not joined.any():
            for _ in range(4):
                left = deal.integers(0, 2, size).astype(bool)[symbols]
                joined = max(joined, left[:-1] & ~left[1:], ~left[:-1] & left[1:], key=np.count_nonzero)
        begin = np.flatnonzero(~np.append(False, joined))
        after = np.where(np.append(joined, False), np.append(symbols[1:], 0) + 1, 0)
        return begin, symbols[begin] * (size + 1) + after[begin]

    def forward(self, x: int, y: int) -> int:
        """Words from x on that equal those from y on (x < y)."""
        begin, level, length = x, 0, len(self.symbols[0]) - y
        while True:
            symbols = self.symbols[level]
            if y >= len(symbols):
                return length
            if symbols[x] != symbols[y]:
                if not level:
                    return x - begin
                x, y, level = self.first[level][x], self.first[level][y], level - 1
                continue
            step = 1
            if level < len(self.parent):
                p, q, edges = self.parent[level][x], self.parent[level][y], self.first[level + 1]
                if edges[p] == x and edges[q] == y and self.symbols[level + 1][p] == self.symbols[level + 1][q]:
                    x, y, level = p, q, level + 1
                    continue
                if level % 2 == 0:  # both stand in blocks of one symbol: skip what both have left
                    step = min(edges[p + 1] - x, edges[q + 1] - y)
            x, y = x + step, y + step

    def backward(self, x: int, y: int) -> int:
        """Words from x back that equal those from y back (x < y)."""
        begin, level = x, 0
        while True:
            if x < 0:
                return begin + 1
            symbols = self.symbols[level]
            if symbols[x] != symbols[y]:
                if not level:
                    return begin - x
                x, y, level = self.first[level][x + 1] - 1, self.first[level][y + 1] - 1, level - 1
                continue
            step = 1
            if level < len(self.parent):
                p, q, edges = self.parent[level][x], self.parent[level][y], self.first[level + 1]
                if edges[p + 1] - 1 == x and edges[q + 1] - 1 == y \
                        and self.symbols[level + 1][p] == self.symbols[level + 1][q]:
                    x, y, level = p, q, level + 1
                    continue
                if level % 2 == 0:
                    step = min(x - edges[p], y - edges[q]) + 1
            x, y = x - step, y - step


def candidates(sequence: np.ndarray, block: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """(period, place) where a multiple of the period and the three multiples behind it hold equal words.

    Periods ascend, and places within a period. Work is n log n over the harmonic grid, ``block`` places at a time.
    """
    n = len(sequence)
    top = (n - 1) // (PERIODS - 1)
    periods, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    low = 1
    while low <= top:
        high = min(top, low + max(1, block * low // n))
        period = np.arange(low, high + 1)
        size = (n - 1) // period - (PERIODS - 2)
        q = np.repeat(period, size)
        at = (np.arange(len(q)) - np.repeat(np.cumsum(size) - size, size)) * q
        for k in range(PERIODS - 1):
            same = np.flatnonzero(sequence[at + k * q] == sequence[at + (k + 1) * q])
            q, at = q[same], at[same]
        periods.append(q)
        places.append(at)
        low = high + 1
    return np.concatenate(periods), np.concatenate(places)


def find_runs(sequence: np.ndarray) -> list[tuple[int, int, int]]:
    """All (start, length, period): smallest period q, length at least max(6, 4 q), not extendable; by start, then period."""
    q, at = candidates(sequence)
    if not len(q):
        return []
    grammar, n, reach = Grammar(sequence), len(sequence), PERIODS - 1
    keys = q * (n + 1) + at
    open_ = np.ones(len(q), dtype=bool)
    out = []
    for k in range(len(q)):
        if not open_[k]:
            continue
        period, i = int(q[k]), int(at[k])
        start = i - grammar.backward(i - 1, i + period - 1) if i else 0
        end = i + period + grammar.forward(i, i + period)
        # Only a stretch that holds all four places counts; every run holds those of its first multiple.
        found = end > i + reach * period and end - start >= LEAST and end - start >= PERIODS * period
        if found:
            out.append((start, end - start, period))
        # The stretch answers all its candidates, a run also those of its multiples, which are no smallest periods.
        for multiple in range(period, ((end - start - 1) // reach if found else period) + 1, period):
            a, b = np.searchsorted(keys, (multiple * (n + 1) + start, multiple * (n + 1) + end - reach * multiple))
            open_[a:b] = False
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: all but those in a run behind its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge)[:n] == 0


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, every tenth document's (by the CRC-32 of its id) made periodic from some place on; null ids never."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a:a + p]
    return words[:a] + (cycle * (-(-(n - a) // p)))[:n - a]


def describe(words: list[bytes]) -> tuple:
    """n_runs, start, length, period, exponent_milli of the longest in periods, and the digests of runs and kept words."""
    runs = find_runs(pd.factorize(np.array(words, dtype=object))[0]) if len(words) >= LEAST else []
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
    if runs:
        stays = collapsed(len(words), runs)
        words = [w for w, stay in zip(words, stays) if stay]
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha256(listed.encode()).hexdigest(),
            sha256(b" ".join(words)).hexdigest())


COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def detect_runs(docs: DataFrame, change: Callable[[list[bytes], int | None], list[bytes]] | None = None) -> DataFrame:
    """``doc_id`` and the columns of ``describe`` for every row's whole text (words without ASCII white space).

    ``change`` may replace a text's words first. Null and blank texts have no runs; every row is described by its own text,
    so repeated rows get equal answers; ids may be null; other columns are ignored.
    """
    def described(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            ids = pdf["doc_id"].astype("Int64")
            rows = []
            for text, doc_id in zip(pdf["text"], ids):
                words = (text or "").encode().split()
                rows.append(describe(change(words, None if doc_id is pd.NA else int(doc_id)) if change else words))
            out = pd.DataFrame(rows, columns=list(COLUMNS), index=pdf.index, dtype=object)
            out = out.astype({c: "Int64" for c in COLUMNS[:5]})
            out.insert(0, "doc_id", ids)
            yield out
    return docs.select("doc_id", "text").mapInPandas(
        described, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
                   "runs_sha256 string, collapsed_sha256 string")
