"""Suffix-array dedup by longest-previous-factor arrays over the bytes of texts.

See repeats.py for how documents are cut into the segments of a shard. A shard's segments stand in order of position, so
"earlier" is "smaller" in it. The windows' suffixes are sorted to the depth of a window; the previous and next smaller
positions in suffix order give each window's longest earlier match, and windows whose match has the full length go. Later places
of a segment stand in such an order with their own bytes, too, at their first byte only: all their windows go where
the earlier match is as long as they are.

Null texts are empty. Empty tables give no rows. Of repeated rows and equal texts the first (least doc_id) keeps its bytes; rows that
share a doc_id are versions of one document (see repeats.py).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .arrays import ranges
from .repeats import CROWDED, TOGETHER, Units, byte_units, remove_repeats

BYTES, GRAM = 100, 32
SHARD_BYTES = 1 << 17


def byte_words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every byte on as one number, the first byte highest."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    word = np.zeros(len(text), np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + len(text)]
    return word


def suffix_ranks(word: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(span, ranks of the suffixes by their first `span` bytes), spans doubling from 8 while below depth."""
    out = [(8, np.unique(word, return_inverse=True)[1].astype(np.int32))]
    while out[-1][0] * 2 <= depth:
        span, rank = out[-1]
        out.append((span * 2, pair_rank(rank, span)))
    return out


def pair_rank(rank: np.ndarray, shift: int) -> np.ndarray:
    """Ranks by (rank, rank `shift` further on)."""
    after = np.zeros(len(rank), np.int64)
    if shift < len(rank):
        after[:-shift] = rank[shift:] + 1
    after |= rank.astype(np.int64) << 32
    return np.unique(after, return_inverse=True)[1].astype(np.int32)


def previous_smaller(x: np.ndarray) -> np.ndarray:
    """The nearest i' < i with x[i'] < x[i], else -1, by pointer jumping."""
    n = len(x)
    link = np.arange(-1, n - 1)
    work = np.arange(n)
    while len(work):
        work = work[link[work] >= 0]
        work = work[x[link[work]] >= x[work]]
        link[work] = link[link[work]]
    return link


def longest_previous_factor(text: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(length, source) for each position in `at` (ascending): the longest match, up to depth (8 to 127), that starts at an
    earlier one of these positions, and where; source is -1 where there is none."""
    word = byte_words(text)
    ranks = suffix_ranks(word, depth)
    span, top = ranks[-1]
    whole = pair_rank(top, depth - span) if depth > span else top
    order = np.argsort(whole[at], kind="stable")
    back = np.empty(len(at), np.int64)
    back[order] = np.arange(len(at))
    before = previous_smaller(order)
    after = len(order) - 1 - previous_smaller(order[::-1])[::-1]
    length, source = np.zeros(len(at), np.int64), np.full(len(at), -1, np.int64)
    for near in (before, after):
        ok = np.flatnonzero((near >= 0) & (near < len(order)))
        i, j = order[ok], order[near[ok]]
        p, q = at[i], at[j]
        n = np.where(whole[p] == whole[q], depth, 0)
        rest = np.flatnonzero(n == 0)
        p, q, done = p[rest].copy(), q[rest].copy(), np.zeros(len(rest), np.int64)
        for step, rank in reversed(ranks):
            fits = np.flatnonzero((p <= len(text) - step) & (q <= len(text) - step) & (done + step <= depth))
            fits = fits[rank[p[fits]] == rank[q[fits]]]
            p[fits] += step
            q[fits] += step
            done[fits] += step
        apart = word[np.minimum(p, len(text) - 1)] ^ word[np.minimum(q, len(text) - 1)]  # less than eight bytes are left: count the equal ones
        equal = np.zeros(len(rest), np.int64)
        for k in range(1, 8):
            equal += apart >> np.uint64(64 - 8 * k) == 0
        n[rest] = np.minimum(np.minimum(done + equal, depth), len(text) - np.maximum(at[i[rest]], at[j[rest]]))
        better = n > length[i]
        length[i[better]], source[i[better]] = n[better], at[j[better]]
    return length, source


class Shard:
    """Segments (contents in order of their places, all different) and what is looked up among them."""

    def __init__(self, contents: list[bytes], ids: np.ndarray, starts: np.ndarray, length: int = BYTES):
        self.contents, self.ids, self.starts, self.length = contents, ids, starts, length

    def early(self, windows: np.ndarray) -> np.ndarray:
        """A flag for each window of the segments: whether it starts earlier too."""
        sizes = np.fromiter(map(len, self.contents), np.int64, len(self.contents))
        begin = np.cumsum(sizes) - sizes
        segment = np.repeat(np.arange(len(windows)), windows)
        at = ranges(begin, windows)
        found, source = longest_previous_factor(np.frombuffer(b"".join(self.contents), np.uint8), at, self.length)
        early = found >= self.length
        hit = np.flatnonzero(early)
        other = np.searchsorted(begin, source[hit], "right") - 1
        mine = segment[hit]
        same = (self.ids[other] == self.ids[mine]) & (self.starts[other] + source[hit] - begin[other] == self.starts[mine] + at[hit] - begin[mine])
        early[hit[same]] = False
        return early

    def find(self, contents: list[bytes], ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(doc_id, start) of an earlier place where each whole content begins; start is -1 where there is none.

        The previous factors of the contents and the segments at their first bytes: these suffixes are sorted as deep
        as they are long, and the previous and next smaller places in that order tell the longest earlier match."""
        texts, where_id, where_start = self.contents + contents, np.append(self.ids, ids), np.append(self.starts, starts)
        order = np.lexsort((where_start, where_id))
        new = (np.diff(where_id[order]) != 0) | (np.diff(where_start[order]) != 0)
        place = np.empty(len(texts), np.int64)
        place[order] = np.append(0, np.cumsum(new))  # equal places are equally early
        order = np.array(sorted(range(len(texts)), key=lambda i: (texts[i], place[i])), np.int64)
        x = place[order]
        before = previous_smaller(x)
        after = len(x) - 1 - previous_smaller(x[::-1])[::-1]
        out_id, out_start = np.zeros(len(contents), np.int64), np.full(len(contents), -1, np.int64)
        own = len(self.contents)
        for k in np.flatnonzero(order >= own).tolist():
            i = int(order[k])
            for near in (int(before[k]), int(after[k])):
                if 0 <= near < len(x) and texts[order[near]].startswith(texts[i]):
                    out_id[i - own], out_start[i - own] = where_id[order[near]], where_start[order[near]]
                    break
        return out_id, out_start


def finish(u: Units, mask: np.ndarray, d: int) -> tuple[int, int, int, bytes]:
    a, b = int(u.offs[d]), int(u.offs[d + 1])
    gone = mask[a:b]
    runs = int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1))
    return b - a, int(gone.sum()), runs, (u.data[a:b][~gone] if runs else u.data[a:b]).tobytes()


def dedup_bytes(docs: DataFrame, shard_bytes: int = SHARD_BYTES, crowded: int = CROWDED, together: int = TOGETHER) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay; a cut may fall inside a character)."""
    return remove_repeats(docs, byte_units, Shard, BYTES, GRAM, shard_bytes, finish, "n_bytes long, n_removed long, n_spans long, kept binary", crowded, together)
