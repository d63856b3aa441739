"""Numpy forms of Arrow text columns: words, word hashes and window hashes of a whole batch at once.

All functions work on one batch that a Spark task holds. `data` is the concatenated UTF-8 of the batch's
texts, `offs` the documents' byte offsets in it (one more than documents).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: White space that separates words: space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of words in the narrow sense: digits, letters, everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE_LOWER = _TABLE[LOWER]
_ODD = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)


def text_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offs) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None else np.zeros(1, np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Whole rows of a batch in runs of about `most` bytes of text; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    _, offs = text_parts(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offs, offs[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def _tables(base: int) -> list[np.ndarray]:
    """Powers of base by three digits of 12 bits."""
    return [np.array([pow(base, k << shift, 2**64) for k in range(4096)], np.uint64) for shift in (0, 12, 24)]


_POWER, _POWER_INV = _tables(_BASE), _tables(_BASE_INV)


def _power_at(tables: list[np.ndarray], k: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = tables[0][k & 4095] * tables[1][(k >> 12) & 4095]
        return out * tables[2][k >> 24] if len(k) and int(k.max()) >> 24 else out


def _powers(n: int, tables: list[np.ndarray] = _POWER) -> np.ndarray:
    """base ** 0 to base ** (n - 1)."""
    with np.errstate(over="ignore"):
        return (_power_at(tables, np.arange(0, n, 4096))[:, None] * tables[0][None, :]).ravel()[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(units: np.ndarray) -> np.ndarray:
    """Sums of a polynomial over 64-bit units; one more than units."""
    out = np.zeros(len(units) + 1, np.uint64)
    if len(units):
        with np.errstate(over="ignore"):
            x = _powers(len(units))
            x *= units
            np.cumsum(x, out=out[1:])
    return out


def prefix_hash(data: np.ndarray, lower: bool) -> np.ndarray:
    """The same over bytes."""
    return prefix_sums((_TABLE_LOWER if lower else _TABLE)[data])


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, equal for equal bytes wherever they stand."""
    if not len(start):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * _power_at(_POWER_INV, start) + (end - start).astype(np.uint64))


def rolling_hash(sums: np.ndarray, k: int) -> np.ndarray:
    """range_hash of k units at every start."""
    n = len(sums) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        return mix((sums[k:] - sums[:n]) * _powers(n, _POWER_INV) + np.uint64(k))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool, block: int = 1 << 20) -> np.ndarray:
    """The same for ascending spans, about `block` bytes at a time, so that no sums of the whole data are held."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + block, "right")))
        base = int(start[i])
        out[i:j] = range_hash(prefix_hash(data[base : int(end[j - 1])], lower), start[i:j] - base, end[i:j] - base)
        i = j
    return out


def word_spans(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, word_offs): byte spans of the words, and where each document's words begin."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = inside[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edge = offs[:-1][np.diff(offs) > 0]
    first[edge] = word[edge]
    last[edge[1:] - 1] = word[edge[1:] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offs)


def window_hash(units: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive units at every start."""
    n = len(units) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out += units[j : j + n] * _ODD[j]
    return mix(out)


def window_starts(unit_offs: np.ndarray, k: int) -> np.ndarray:
    """Starts of the k-unit windows that stay in one document."""
    n = np.diff(unit_offs)
    counts = np.maximum(n - k + 1, 0)
    return ranges(unit_offs[:-1], counts)


def ranges(start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated start, start + 1, ... of the given lengths."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(start - (ends - counts), counts)


def distinct(keys: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first place of each different key, by rising key; which of these every place has). bits: what a key takes.
    One sort of numbers that hold the key above the place; keys too wide for that lose their lowest bits in it, and where that
    leaves them out of order they are sorted whole."""
    keys, low = keys.astype(np.uint64, copy=False), max(0, len(keys) - 1).bit_length()
    place = np.uint64((1 << low) - 1)
    packed = keys << np.uint64(low) if bits + low <= 64 else keys & ~place
    packed |= np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    order = (packed & place).astype(np.int64)
    keys_in_order = keys[order]
    if bits + low > 64 and (keys_in_order[1:] < keys_in_order[:-1]).any():
        _, first, which = np.unique(keys, return_index=True, return_inverse=True)
        return first, which
    new = np.ones(len(keys), bool)
    np.not_equal(keys_in_order[1:], keys_in_order[:-1], out=new[1:])
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def covered(length: int, start: np.ndarray, span: np.ndarray | int) -> np.ndarray:
    """Mask of the positions under any of the spans."""
    delta = np.zeros(length + 1, np.int64)
    np.add.at(delta, start, 1)
    np.add.at(delta, start + span, -1)
    return np.cumsum(delta[:-1]) > 0
