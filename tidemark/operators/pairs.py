"""Scored pairs of two blocks of event features, all in one task: bounds from hashed bits for every pair, exact sets for those that they leave."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bits of names, and of words of titles, in the bounds.
NAME_BITS, WORD_BITS = 128, 512
#: Pairs whose bounds, and whose sets, are looked at together.
STEP, EXACT = 1 << 20, 100_000
SETS = ("models", "words", "norm_words", "names")


def _codes(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where values are; -1 for nulls."""
    both = pa.chunked_array([*a.chunks, *b.chunks], a.type).combine_chunks().dictionary_encode()
    codes = both.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return codes[: len(a)], codes[len(a) :]


def _sets(a: pa.ChunkedArray, b: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(tokens as numbers, row by row; offsets) of two list columns; nulls are empty."""
    x, y = _codes(pc.list_flatten(a), pc.list_flatten(b))
    size = lambda c: pc.fill_null(pc.list_value_length(c), 0).combine_chunks().to_numpy(zero_copy_only=False) if len(c) else np.zeros(0, np.int64)
    return [(x, np.append(0, np.cumsum(size(a)))), (y, np.append(0, np.cumsum(size(b))))]


def _bits(tokens: np.ndarray, offs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed bits of each row as 64-bit words, and how many tokens share a bit with others of the row."""
    n = np.diff(offs)
    mask = np.zeros((len(n), bits), bool)
    with np.errstate(over="ignore"):
        mask[np.repeat(np.arange(len(n)), n), ((tokens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % bits] = True
    return np.packbits(mask, axis=1).view(np.uint64), n - mask.sum(axis=1)


def _common(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the common tokens of rows i of a and j of b."""
    n = np.diff(a[1])[i]
    each = np.repeat(np.arange(len(i)), n)
    token = a[0][np.arange(len(each)) + np.repeat(a[1][i] - (np.cumsum(n) - n), n)]
    width = np.int64(max(a[0].max(initial=0), b[0].max(initial=0)) + 1)
    have = np.sort(np.repeat(np.arange(len(b[1]) - 1), np.diff(b[1])) * width + b[0])
    if not len(have):
        return np.zeros(len(i), np.int64)
    want = j[each] * width + token
    found = have[np.minimum(np.searchsorted(have, want), len(have) - 1)] == want
    return np.bincount(each[found], minlength=len(i))


def _in_order(a: pa.Table, b: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The places of the rows of both tables in one order by o1, o2 and id."""
    o = [np.concatenate([t.column(c).to_numpy() for t in (a, b)]) for c in ("id", "o2", "o1")]
    place = np.empty(len(o[0]), np.int32)
    order = np.lexsort(o)
    new = np.append(False, np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in o]))
    place[order] = np.cumsum(new)
    return place[: len(a)], place[len(a) :]


def scored(a: pa.Table, b: pa.Table, least: float, earlier_only: bool) -> pa.Table:
    """(id, other, rule) of the pairs of rows whose unrounded score is about `least` or more. Both have id, title (whether it is not empty), norm,
    category, hn, day, o1, o2 and the columns of SETS."""
    if earlier_only:  # rows meet a head of the others only
        a, b = a.take(np.argsort(_in_order(a, b)[0])), b.take(np.argsort(_in_order(a, b)[1]))
    place, place_b = _in_order(a, b)
    ids, others, titled, titled_b = a.column("id").to_numpy(), b.column("id").to_numpy(), a.column("title").to_numpy(), b.column("title").to_numpy()
    norm, cat, hn = (tuple(x.astype(np.int32) for x in _codes(a.column(c), b.column(c))) for c in ("norm", "category", "hn"))
    day = tuple(t.column("day").to_numpy().astype(np.int32) for t in (a, b))
    sets = {c: _sets(a.column(c), b.column(c)) for c in SETS}
    size = [np.diff(x[1]) for x in sets["norm_words"]]
    with_model = [np.diff(x[1]) > 0 for x in sets["models"]]
    either = _sets(*(pa.chunked_array([pa.array([list({*(x or ()), *(y or ())}) for x, y in zip(t.column("words").to_pylist(), t.column("norm_words").to_pylist(), strict=True)], pa.list_(pa.string()))]) for t in (a, b)))
    names, words = [_bits(*x, NAME_BITS) for x in sets["names"]], [_bits(*x, WORD_BITS) for x in either]
    # bounds in 200ths, the parts rounded up: names, then words and a title as like as can be
    name_part = np.array([0, *(np.ceil(200 * (min(n, 3) * 0.25 / 3 + (0.15 if n >= 2 else 0)) - 1e-9) for n in range(1, 256))]).astype(np.uint8)
    word_part = np.array([0, *(70 + 4 * min(n, 5) for n in range(1, 256))], np.uint8)
    need = max(0, int(np.floor(200 * (least - 1e-4))))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = max(1, STEP // max(1, len(others)))

    def most(bits: list, at: slice, end: int) -> np.ndarray:
        (x, more), (y, more_b) = bits
        n = np.minimum(np.minimum(more[at, None], 127).astype(np.uint8), np.minimum(more_b[None, :end], 127).astype(np.uint8))
        for w in range(x.shape[1]):
            n += np.bitwise_count(x[at, w][:, None] & y[None, :end, w])
        return n

    for first in range(0, len(ids), rows):
        at = slice(first, first + rows)
        end = int(np.searchsorted(place_b, place[at].max())) if earlier_only else len(others)
        bound = name_part[most(names, at, end)]
        bound += np.uint8(10) * ((cat[0][at, None] == cat[1][:end]) & (cat[0][at, None] >= 0))
        bound += np.uint8(10) * (np.abs(day[0][at, None] - day[1][:end]) <= 1)
        model = with_model[0][at, None] & with_model[1][:end]
        same = (norm[0][at, None] == norm[1][:end]) & (norm[0][at, None] >= 0)
        go = same | model | (bound + word_part[most(words, at, end)] >= need)
        go &= (place_b[:end] < place[at, None]) if earlier_only else (others[:end] != ids[at, None])
        i, j = np.divmod(np.flatnonzero(go), max(1, end))
        left = bound[i, j] / 200 + 0.5 * model[i, j]
        i += first
        n = np.minimum(words[0][1][i], words[1][1][j])
        for w in range(words[0][0].shape[1]):
            n = n + np.bitwise_count(words[0][0][i, w] & words[1][0][j, w])
        left += np.minimum(n, 5) * 0.02
        n = np.minimum(n, np.minimum(size[0][i], size[1][j]))
        left += 0.35 * np.where(norm[0][i] == norm[1][j], 1.0, n / np.maximum(1, size[0][i] + size[1][j] - n))
        i, j = i[left >= least - 1e-4], j[left >= least - 1e-4]
        for k in range(0, len(i), EXACT):
            out.append(exact_pairs(i[k : k + EXACT], j[k : k + EXACT], ids, others, titled, titled_b, norm, cat, hn, day, sets, size, least))
    parts = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table({"id": parts[0], "other": parts[1], "rule": parts[2]})


def exact_pairs(x, y, ids, others, titled, titled_b, norm, cat, hn, day, sets, size, least) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rule of event_score for pairs of rows, in the same order of operations."""
    keep = (hn[0][x] < 0) | (hn[1][y] < 0) | (hn[0][x] == hn[1][y])
    x, y = x[keep], y[keep]
    n = {c: _common(*sets[c], x, y) for c in SETS}
    union = size[0][x] + size[1][y] - n["norm_words"]
    title = np.where(~(titled[x] & titled_b[y]), 0.0, np.where((norm[0][x] == norm[1][y]) & (norm[0][x] >= 0), 1.0, np.where(union > 0, n["norm_words"] / np.maximum(1, union), 0.0)))
    model = np.where(n["models"] >= 2, 0.5, np.where(n["models"] == 1, 0.4, 0.0))
    name = np.minimum(n["names"], 3) * 0.25 / 3 + np.where(n["names"] >= 2, 0.15, 0.0)
    rule = model + title * 0.35 + name + np.minimum(n["words"], 5) * 0.1 / 5 + np.where((cat[0][x] == cat[1][y]) & (cat[0][x] >= 0), 0.05, 0.0) + np.where(np.abs(day[0][x] - day[1][y]) <= 1, 0.05, 0.0)
    keep = rule >= least - 1e-5
    return ids[x[keep]], others[y[keep]], rule[keep]
