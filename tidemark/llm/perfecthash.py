"""Minimal perfect hashes over byte strings, with the keys stored by slot.

Keys go through levels of bit arrays: in each, a key whose place no other key takes sets its bit, the others go to the next level.
A key's slot is the number of bits before its own. Whatever key asks, some slot answers, so the key stored there is compared. Keys
that no level parts (equal 64-bit hashes) get the last slots and are found by name.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .arrays import mix

LEVELS = 48
#: Bits of a level for each key that reaches it.
GAMMA = 2


def _places(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(hashes + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """keys: binary array in the order of the slots."""

    def __init__(self, sizes: Sequence[int], bits: bytes, keys: pa.Array):
        self.keys = keys.cast(pa.binary())
        self.words, self.before, at, total = [], [], 0, 0
        for size in sizes:
            n = -(-size // 64)
            words = np.frombuffer(bits, "<u8", n, at)
            counts = np.cumsum(np.bitwise_count(words).astype(np.int64))
            self.words.append(words)
            self.before.append(total + np.concatenate([[0], counts[:-1]]))
            at, total = at + 8 * n, total + int(counts[-1])
        self.sizes = list(sizes)
        self.named = {k: total + i for i, k in enumerate(self.keys[total:].to_pylist())}

    @staticmethod
    def build(keys: Sequence[bytes], hashes: np.ndarray) -> tuple[list[int], bytes, np.ndarray]:
        """(sizes of the levels, their bits, the keys' numbers in the order of their slots)."""
        left, sizes, bits, order = np.arange(len(keys)), [], [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, GAMMA * len(left))
            at = _places(hashes[left], level, size)
            alone = np.bincount(at, minlength=size) == 1
            mine = alone[at]
            flags = np.zeros(-(-size // 64) * 64, np.uint8)
            flags[at[mine]] = 1
            sizes.append(size)
            bits.append(np.packbits(flags, bitorder="little").tobytes())
            order.append(left[mine][np.argsort(at[mine])])
            left = left[~mine]
        return sizes, b"".join(bits), np.concatenate([*order, left]).astype(np.int64)

    def slots(self, keys: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 for keys that are not stored."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = _places(hashes[open_], level, size)
            word, bit = self.words[level][at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (self.before[level][at >> 6] + below)[hit]
            open_ = open_[~hit]
        found = np.flatnonzero(out >= 0)
        if len(found):
            same = pc.equal(self.keys.take(pa.array(out[found])), keys.take(pa.array(found))).to_numpy(zero_copy_only=False)
            out[found[~same]] = -1
        if self.named:
            for i in np.flatnonzero(out < 0):
                out[i] = self.named.get(keys[i].as_py(), -1)
        return out
