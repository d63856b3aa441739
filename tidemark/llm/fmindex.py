"""Substring dedup by compressed FM-indexes: backward search over wavelet matrices computes matching statistics.

See repeats.py for how documents are cut into the segments of a shard. A shard's segments, in order of position and apart by
separators, are indexed by the words' ids: the Burrows-Wheeler transform in a wavelet matrix of packed bits with a count for
every 64 of them, and one text position in RATE, from which the others follow by walking back. Nothing else is kept: no
suffix array and no text.

The windows of the shard's own segments are streamed through backward search together, one word a step. The steps made
before the matched part is alone in the shard are its matching statistic, up to the window's length; windows that reach the
length are above the threshold, and are reported where the least position in their interval is before their own. Later places of
a segment are streamed through the index whole, each with its own words: all their windows go where the statistic is the
whole segment's length and the least position in the interval is an earlier place.

Null texts have no words. Empty tables give no rows. Of repeated rows and equal texts the first (least doc_id) keeps its words; rows that
share a doc_id are versions of one document (see repeats.py).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import ranges
from .repeats import CROWDED, TOGETHER, Units, remove_repeats, word_units

WORDS, GRAM = 20, 6
SHARD_BYTES = 1 << 20
#: One text position in RATE is kept.
RATE = 8


class Bits:
    """A packed bit vector with ranks: a count before every 64 bits and the bits counted in between."""

    def __init__(self, bit: np.ndarray):
        self.words = np.packbits(np.append(bit, np.zeros(64 - len(bit) % 64, bit.dtype)), bitorder="little").view("<u8")
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)

    def nbytes(self) -> int:
        return self.words.nbytes + self.before.nbytes


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions in order of the suffixes, where separators (0) differ from each other and stand in order of position."""
    n, span = len(text), 1
    rank = np.where(text == 0, np.arange(n), text + n)
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    while n and rank.max() + 1 < n:
        after = np.zeros(n, np.int64)
        after[: n - span] = rank[span:] + 1 if span < n else 0
        rank = np.unique((rank << 32) | after, return_inverse=True)[1]
        span *= 2
    return np.argsort(rank, kind="stable")


class FMIndex:
    """Counts and positions of patterns in text (symbols 0..n-1; 0 separates and ends it)."""

    def __init__(self, text: np.ndarray, rate: int = RATE):
        n = self.size = len(text)
        self.symbols = int(text.max()) + 1 if n else 1
        order = suffix_order(text)
        bwt = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])
        begins = np.append(True, text[:-1] == 0)  # where a piece begins, and every rate-th place from there on
        inside = np.arange(n) - np.maximum.accumulate(np.where(begins, np.arange(n), 0))
        marked = (inside % rate == 0)[order]
        self.marked, self.samples = Bits(marked), order[marked].astype(np.int32)
        self.bits = max(1, int(self.symbols - 1).bit_length())
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        for level in range(self.bits - 1, -1, -1):
            bit = ((bwt >> level) & 1).astype(np.uint8)
            self.levels.append(Bits(bit))
            self.zeros.append(n - int(bit.sum()))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        self.base = self._walk(np.arange(self.symbols), np.zeros(self.symbols, np.int64))

    def nbytes(self) -> int:
        return sum(x.nbytes() for x in self.levels) + self.marked.nbytes() + self.samples.nbytes + self.first.nbytes + self.base.nbytes

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.levels[k].rank(at)
            at = np.where((symbol >> level) & 1, self.zeros[k] + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + pattern from intervals of pattern."""
        shift = self.first[symbol] - self.base[symbol]
        return shift + self._walk(symbol, low), shift + self._walk(symbol, high)

    def _back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix one place before each row's."""
        at, symbol = row, np.zeros(len(row), np.int64)
        for k in range(self.bits):
            bit, ones = self.levels[k].get(at), self.levels[k].rank(at)
            at = np.where(bit, self.zeros[k] + ones, at - ones)
            symbol = (symbol << 1) | bit
        return at - self.base[symbol] + self.first[symbol]

    def positions(self, row: np.ndarray) -> np.ndarray:
        """Text positions of rows, by walking back to a sampled one."""
        out, row, todo, steps = np.zeros(len(row), np.int64), row.copy(), np.arange(len(row)), 0
        while len(todo):
            here = self.marked.get(row[todo]) == 1
            done = todo[here]
            out[done] = self.samples[self.marked.rank(row[done])] + steps
            todo = todo[~here]
            row[todo] = self._back(row[todo])
            steps += 1
        return out

    def matching_statistics(self, patterns: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each patterns[start : start + length]: how much of its end stands twice or more in the text, and the interval of that."""
        stat = np.zeros(len(start), np.int64)
        symbol = patterns[start + length - 1]
        low, high = self.first[symbol].copy(), self.first[symbol + 1].copy()
        alive = np.flatnonzero(high - low > 1)
        stat[alive] = 1
        for step in range(length - 2, -1, -1):
            if not len(alive):
                break
            a, b = self.extend(patterns[start[alive] + step], low[alive], high[alive])
            stay = b - a > 1
            alive = alive[stay]
            low[alive], high[alive] = a[stay], b[stay]
            stat[alive] += 1
        return stat, low, high

    def intervals(self, patterns: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of each whole patterns[offs[i] : offs[i + 1]], empty where it doesn't stand in the text."""
        size = np.diff(offs)
        low, high = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        alive = np.flatnonzero(size > 0)
        high[alive] = self.size
        for step in range(1, int(size.max(initial=0)) + 1):
            going = alive[size[alive] >= step]
            if not len(going):
                break
            symbol = patterns[offs[going + 1] - step]
            known = symbol < self.symbols
            low[going[~known]] = high[going[~known]] = 0
            go, symbol = going[known], symbol[known]
            low[go], high[go] = (self.first[symbol], self.first[symbol + 1]) if step == 1 else self.extend(symbol, low[go], high[go])
            alive = alive[high[alive] > low[alive]]
        return low, high

    def least_positions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least text position in each interval; intervals are disjoint or equal."""
        lows, back = np.unique(low, return_inverse=True)
        highs = np.zeros(len(lows), np.int64)
        highs[back] = high
        at = self.positions(ranges(lows, highs - lows))
        return np.minimum.reduceat(at, np.cumsum(highs - lows) - (highs - lows))[back]


class Shard:
    """The FM-index of segments (contents in order of their places, all different) and what is looked up in it."""

    def __init__(self, contents: list[bytes], ids: np.ndarray, starts: np.ndarray, length: int = WORDS):
        words, offs = _words(contents)
        self.known, symbol = np.unique(words, return_inverse=True)
        sizes = np.diff(offs)
        self.begin = offs[:-1] + np.arange(len(sizes))  # a separator follows each segment
        self.text = np.zeros(len(symbol) + len(sizes), np.int64)
        self.text[np.arange(len(symbol)) + np.repeat(np.arange(len(sizes)), sizes)] = symbol + 1
        self.index, self.ids, self.starts, self.length = FMIndex(self.text), ids, starts, length

    def _place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        segment = np.searchsorted(self.begin, at, "right") - 1
        return self.ids[segment], self.starts[segment] + at - self.begin[segment]

    def early(self, windows: np.ndarray) -> np.ndarray:
        """A flag for each window of the segments: whether it starts earlier too."""
        segment = np.repeat(np.arange(len(windows)), windows)
        at = ranges(self.begin, windows)
        stat, low, high = self.index.matching_statistics(self.text, at, self.length)
        out = np.zeros(len(at), bool)
        which = np.flatnonzero(stat >= self.length)
        if len(which):
            least = self.index.least_positions(low[which], high[which])
            (a, b), (c, d) = self._place(least), (self.ids[segment[which]], (self.starts[segment] + at - self.begin[segment])[which])
            out[which] = (least < at[which]) & ~((a == c) & (b == d))
        return out

    def find(self, contents: list[bytes], ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(doc_id, start) of the first place where each whole content stands in the shard; start is -1 where there is none."""
        words, offs = _words(contents)
        symbol = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        symbol = np.where(self.known[symbol] == words, symbol + 1, self.index.symbols)  # a word that the shard doesn't have
        low, high = self.index.intervals(symbol, offs)
        out_id, out_start = np.zeros(len(contents), np.int64), np.full(len(contents), -1, np.int64)
        hit = np.flatnonzero(high > low)
        if len(hit):
            pairs, back = np.unique(low[hit] << 32 | high[hit], return_inverse=True)
            a, b = pairs >> 32, pairs & 0xFFFFFFFF
            at = self.index.positions(ranges(a, b - a))
            least = np.minimum.reduceat(at, np.cumsum(b - a) - (b - a))
            out_id[hit], out_start[hit] = (x[back] for x in self._place(least))
        return out_id, out_start


def _words(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    u = word_units(pa.array(contents, pa.binary()))
    return u.unit, u.offs


def finish(u: Units, mask: np.ndarray, d: int) -> tuple[int, int, bytes]:
    a, b = int(u.offs[d]), int(u.offs[d + 1])
    gone = mask[a:b]
    if not gone.any():
        kept = b" ".join(u.data[u.start[a] : u.end[b - 1]].tobytes().split()) if b > a else b""
    else:
        raw = u.data[u.start[a] : u.end[b - 1]].tobytes().split()
        kept = b" ".join([raw[i] for i in np.flatnonzero(~gone).tolist()])
    return b - a, int(gone.sum()), kept


def dedup_substrings(docs: DataFrame, shard_bytes: int = SHARD_BYTES, crowded: int = CROWDED, together: int = TOGETHER) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words that stay, joined by one space, as UTF-8)."""
    return remove_repeats(docs, word_units, Shard, WORDS, GRAM, shard_bytes, finish, "n_words long, n_removed long, kept binary", crowded, together)
