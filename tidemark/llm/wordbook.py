"""Distinct byte spans of a batch, and a bounded dictionary from byte strings to id sequences in flat arrays.

Spans meet by 64-bit hashes, and equal hashes count as equal only where the bytes are. A dictionary entry takes about 40
bytes, so a worker can remember a million words; beyond `most_bytes` the entries that nobody asked for since the last time
are forgotten and learnt again when they come back. What is remembered never changes a result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .arrays import distinct, ranges, span_hash

_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every byte on, as one number each."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))


def equal_spans(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a[a_start : a_start + size] and b[b_start : b_start + size] are equal; a and b are loads()."""
    out = ((a[a_start] ^ b[b_start]) & _MASK[np.minimum(size, 8)]) == 0
    todo, k = np.flatnonzero(out & (size > 8)), 8
    while len(todo):
        left = size[todo] - k
        same = ((a[a_start[todo] + k] ^ b[b_start[todo] + k]) & _MASK[np.minimum(left, 8)]) == 0
        out[todo[~same]] = False
        k += 8
        todo = todo[same & (left > 8)]
    return out


def distinct_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first of each distinct span, which of these every span equals)."""
    first, which = distinct(hashes)
    own, size, x = first[which], end - start, loads(data)
    if np.array_equal(size, size[own]) and equal_spans(x, start, x, start[own], size).all():
        return first, which
    raw, seen = data.tobytes(), {}  # two different spans with one hash
    which = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(start.tolist(), end.tolist(), strict=True)], np.int64)
    return np.unique(which, return_index=True)[1], which


class Book:
    def __init__(self, most_bytes: int = 48 << 20):
        self.most_bytes = most_bytes
        self.clear()

    def clear(self) -> None:
        self.keys, self.used = np.zeros(0, np.uint64), np.zeros(0, bool)
        self.raw_at = self.size = self.ids_at = self.n_ids = np.zeros(0, np.int32)
        self.raw, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.uint32)
        self.words = loads(self.raw)

    def nbytes(self) -> int:
        return 25 * len(self.keys) + 2 * len(self.raw) + 4 * len(self.ids)

    def find(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The entry of each span, else -1."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = np.flatnonzero((self.keys[at] == hashes) & (self.size[at] == size))
        hit = hit[equal_spans(loads(data), start[hit], self.words, self.raw_at[at[hit]].astype(np.int64), size[hit])]
        out = np.full(len(hashes), -1)
        out[hit] = at[hit]
        self.used[at[hit]] = True
        return out

    def _keep(self, mask: np.ndarray) -> None:
        at = np.flatnonzero(mask)
        raw = self.raw[ranges(self.raw_at[at].astype(np.int64), self.size[at].astype(np.int64))]
        ids = self.ids[ranges(self.ids_at[at].astype(np.int64), self.n_ids[at].astype(np.int64))]
        self.keys, self.size, self.n_ids, self.used = self.keys[at], self.size[at], self.n_ids[at], np.zeros(len(at), bool)
        self.raw_at = (np.cumsum(self.size) - self.size).astype(np.int32)
        self.ids_at = (np.cumsum(self.n_ids) - self.n_ids).astype(np.int32)
        self.raw, self.ids, self.words = raw, ids, loads(raw)

    def add(self, hashes: np.ndarray, raw: np.ndarray, size: np.ndarray, ids: np.ndarray, n_ids: np.ndarray) -> None:
        if self.nbytes() > self.most_bytes:
            self._keep(self.used)
            if self.nbytes() > self.most_bytes * 3 // 4:
                self.clear()
        if len(raw) > self.most_bytes // 4:
            return
        keys = np.concatenate([self.keys, hashes])
        order = np.argsort(keys, kind="stable")
        both = lambda a, b: np.concatenate([a, b.astype(a.dtype)])[order]
        self.keys = keys[order]
        self.raw_at, self.ids_at = both(self.raw_at, len(self.raw) + np.cumsum(size) - size), both(self.ids_at, len(self.ids) + np.cumsum(n_ids) - n_ids)
        self.size, self.n_ids, self.used = both(self.size, size), both(self.n_ids, n_ids), both(self.used, np.zeros(len(size), bool))
        self.raw, self.ids = np.concatenate([self.raw, raw]), np.concatenate([self.ids, ids])
        self.words = loads(self.raw)


def ids_of_spans(book: Book, data: np.ndarray, start: np.ndarray, end: np.ndarray, learn: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, sizes, which): the ids of the distinct spans one after another, where each begins and how many it has,
    and which of them every span is. learn(bytes of new spans one after another, their sizes) gives (their ids, how many each has)."""
    hashes = span_hash(data, start, end, False)
    first, which = distinct_spans(data, start, end, hashes)
    h, a, size = hashes[first], start[first], (end - start)[first]
    place = book.find(h, data, a, size)
    hit, new = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
    n = np.zeros(len(first), np.int64)
    n[hit] = book.n_ids[place[hit]]
    raw = data[ranges(a[new], size[new])]
    learnt, n_new = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    if len(new):
        learnt, n_new = learn(raw, size[new])
        n[new] = n_new
    at = np.cumsum(n) - n
    ids = np.empty(int(n.sum()), np.uint32)
    ids[ranges(at[hit], n[hit])] = book.ids[ranges(book.ids_at[place[hit]].astype(np.int64), n[hit])]
    ids[ranges(at[new], n_new)] = learnt
    if len(new):
        book.add(h[new], raw, size[new], learnt, n_new)
    return ids, at, n, which


def as_list(raw: np.ndarray, size: np.ndarray) -> list[bytes]:
    whole, cuts = raw.tobytes(), np.append(0, np.cumsum(size)).tolist()
    return [whole[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]
