"""Exact n-gram Jaccard join by signature trees.

A document's set holds the hashes of its distinct shingles of `words` lower-cased words (the whole sequence where it has
fewer). Documents link when |A and B| / |A or B| reaches `threshold`.

1. Blocking without loss. Linked sets of sizes up to `high` differ in at most d = 2 high (1 - t) / (1 + t) shingles. Shingles are
   dealt by hash into m > d parts; a difference spoils one part, so where more than d of a set's parts hold two shingles or
   more, a linked set has one of these in full. Keys are hashes of (size class, part, what the part holds). Frequent
   shingles are left out of the parts (sets differ by no more without them). Sets with too few parts left, and all that
   they could miss are such too, give the keys of their prefix, in which frequent shingles come last.
   Linked sets have many keys in common; unlinked ones share a few by chance, the more so the larger the corpus. So common keys are
   counted for each pair. The keys of a class are dealt into groups, one of which holds its share of what a link takes: where that
   is three or more, pairs with so many in a group become edges. Where it is less, what a group counts of a pair goes on
   as a narrow row, and the rows of a pair are added up. Keys of more pairs than a group counts (PAIRS) tie all their documents
   together uncounted, which only makes groups larger.
2. Components of the edges are the groups in which all links lie. Sets that are equal are one member.
3. Every group gets a signature tree: members in order of size, nodes with OR-combined bitmaps of shingle hashes, ranges
   of sizes and the most shingles that share a bit. Some members one by one, then all by a dual traversal, meet the tree's nodes;
   pairs of nodes whose greatest possible overlap is too small, or whose members are all in one component already, are dropped.
   The rest are verified on the sets.
4. A group of more than CHUNK_SHINGLES shingles or CHUNK members is cut by size, since linked sets are of like sizes, and a cut that
   is still above is dealt into chunks, each with the cut's first member; what
   that leaves apart meets all chunks in a second pass. No task holds more than about two chunks. Texts travel, not sets: they pack to
   a third of the size of hashes.

Null and empty texts have no set and link with nothing. Equal texts link. A null doc_id counts as one id below all others; ids
of any other type than whole numbers count in their order. Rows that repeat a doc_id each give a row, and are one document to
`near_duplicates`. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import SPACE, mix, ranges, slices, span_hash, text_parts, window_hash, window_starts, word_spans
from .common import partitions, stored, trimmed, tune
from .components import components
from .ids import as_long
from .sharding import numbered

WORDS, THRESHOLD = 5, Fraction(4, 5)
#: Members and shingles (8 bytes each) of a chunk.
CHUNK, CHUNK_SHINGLES = 2500, 8_000_000
FANOUT, SINGLES = 8, 16
#: Frequent shingles: in AGAIN sets of one run of documents and 3 * AGAIN of all that; at most COMMON of them (8 bytes each).
AGAIN, COMMON = 2, 500_000
#: Members of groups up to this number are broadcast (16 bytes each) to fetch their texts; more are joined by shuffle.
BROADCAST_MEMBERS = 2_000_000
#: Pairs that a bucket of keys counts at most (about 60 bytes each in a worker).
PAIRS = 2_000_000
#: Keys that meet in one group at most, by the count of what documents can give (about 50 bytes each in a worker).
LANE_KEYS = 2_000_000
_ODD = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def shingle_sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offs): each document's distinct shingle hashes in ascending order, one after another."""
    data, offs = text_parts(column)
    start, end, word_offs = word_spans(data, offs, ~SPACE)
    units = span_hash(data, start, end, True)
    at = window_starts(word_offs, words)
    hashes = [window_hash(units, words)[at] if len(at) else np.zeros(0, np.uint64)]
    docs = [np.searchsorted(word_offs, at, "right") - 1]
    n = np.diff(word_offs)
    for size in range(1, words):
        few = np.flatnonzero(n == size)
        if len(few):
            hashes.append(window_hash(units, size)[word_offs[few]])
            docs.append(few)
    h, d = np.concatenate(hashes), np.concatenate(docs)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(len(n) + 1))


def _sums(values: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the multisets of values at each place."""
    low = np.bincount(place, weights=(values & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)
    high = np.bincount(place, weights=(values >> np.uint64(32)).astype(np.float64), minlength=n)
    with np.errstate(over="ignore"):
        return mix(low.astype(np.uint64)) + mix(high.astype(np.uint64)) * _ODD[0]


def size_classes(most: int) -> np.ndarray:
    """Greatest set size of each class, up to one that holds `most`."""
    out = [4]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return np.array(out)


def _part_keys(h: np.ndarray, offs: np.ndarray, doc: np.ndarray, cls: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the parts that hold two shingles or more, the part and the row of (doc, cls, m) of each, and how many each row has."""
    n = np.diff(offs)[doc]
    base = np.cumsum(m) - m
    total = int(m.sum())
    each = np.repeat(np.arange(len(doc)), n)
    x = h[ranges(offs[doc], n)]
    place = base[each] + (((x >> np.uint64(32)) * m[each].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    full = np.flatnonzero(np.bincount(place, minlength=total) >= 2)
    owner = np.repeat(np.arange(len(doc)), m)[full]
    with np.errstate(over="ignore"):
        keys = mix(_sums(mix(x), place, total)[full] + cls[owner].astype(np.uint64) * _ODD[1] + (full - base[owner]).astype(np.uint64) * _ODD[2])
    return keys, full - base[owner], owner, np.bincount(owner, minlength=len(doc))


def _parts(high: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Most shingles in which linked sets of each class differ, and the parts of the class."""
    p, q = t.numerator, t.denominator
    differ = 2 * high * (q - p) // (q + p)
    return differ, np.maximum(differ + 1, -(-high * 8 * (q - p) // (5 * (q + p))) + differ + differ // 6)


def _prefix(n: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(least common keys of two prefixes, length of the prefix) of linked sets by size: for one common key a prefix holds what may be missing and one
    shingle more, and for each further one another."""
    least = -(-n * t.numerator // t.denominator)
    common = np.minimum(1 + n // 40, least)
    return common, n - least + common


def most_keys(n: np.ndarray, t: Fraction) -> np.ndarray:
    """The most keys that sets of these sizes can give, by class: every part with two shingles, and the prefix."""
    n = n[n > 0]
    if not len(n):
        return np.zeros(0, np.int64)
    p, q = t.numerator, t.denominator
    high = size_classes(int(n.max()) * q // p + 1)
    first, last = np.searchsorted(high, n), np.searchsorted(high, n * q // p)
    cls = ranges(first, last - first + 1)
    n = np.repeat(n, last - first + 1)
    return np.bincount(cls, weights=np.minimum(_parts(high, t)[1][cls], n // 2) + _prefix(n, t)[1], minlength=len(high)).astype(np.int64)


def lane_splits(most: np.ndarray, lanes: int, t: Fraction, lane_keys: int = LANE_KEYS) -> np.ndarray:
    """Groups into which each lane of a class is dealt by key, so that none holds more than about lane_keys keys."""
    if not len(most):
        return np.ones(1, np.int64)
    high = [4]
    while len(high) < len(most):
        high.append(max(high[-1] + 1, high[-1] * 5 // 4))
    parts = _parts(np.array(high), t)[1]
    fullest = -(-most * -(-parts // lanes) // parts)
    return np.maximum(1, -(-fullest // lane_keys))


def _blocks(h: np.ndarray, offs: np.ndarray, common: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, document, class, part and full parts of its document in the class, by key). Keys of prefixes have a share of their hash for a part and -1 full ones."""
    n = np.diff(offs)
    p, q = t.numerator, t.denominator
    high = size_classes(int(n.max()) * q // p + 1)
    differ, parts = _parts(high, t)
    known = np.zeros(len(h), bool)
    if len(common):
        known = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
    own_offs = np.concatenate([[0], np.cumsum(~known)])[offs]
    doc = np.flatnonzero(n)
    first, last = np.searchsorted(high, n[doc]), np.searchsorted(high, n[doc] * q // p)
    doc, cls = np.repeat(doc, last - first + 1), ranges(first, last - first + 1)
    keys, part, owner, filled = _part_keys(h[~known], own_offs, doc, cls, parts[cls])
    small = lambda *xs: tuple(x.astype(np.int32) for x in xs)
    out = [(keys, *small(doc[owner], cls[owner], part, filled[owner]))]
    few = np.flatnonzero(filled <= differ[cls])
    if len(few):
        doc, cls = doc[few], cls[few]
        order = np.lexsort((h, known, np.repeat(np.arange(len(n)), n)))
        prefix = _prefix(n[doc], t)[1]
        x = h[order[ranges(offs[doc], prefix)]]
        cls = np.repeat(cls, prefix)
        with np.errstate(over="ignore"):
            keys = mix(x * _ODD[3] + cls.astype(np.uint64))
        out.append((keys, *small(np.repeat(doc, prefix), cls, x >> np.uint64(33), np.full(len(x), -1))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _lanes(keys: np.ndarray, cls: np.ndarray, part: np.ndarray, lanes: int, splits: np.ndarray | None) -> np.ndarray:
    """The group in which each key meets its like: a lane of its class, or one of those that the lane is dealt into."""
    cls = cls.astype(np.int64)
    lane = cls * lanes + part % lanes
    if splits is None:
        return lane
    split = np.ones(max(int(cls.max()) + 1, len(splits)), np.int64)
    split[: len(splits)] = splits
    own = split[cls]
    return (np.cumsum(split) - split)[cls] * lanes + lane % lanes * own + (keys % own.astype(np.uint64)).astype(np.int64)


def block_keys(h: np.ndarray, offs: np.ndarray, common: np.ndarray, t: Fraction = THRESHOLD, lanes: int = 6, splits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, document and lane of each key). Equal keys share a lane. common: hashes, sorted, that the keys leave out where they can; any will do.
    splits: by class, the groups that each of its lanes is dealt into by key."""
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, doc, cls, part, _ = _blocks(h, offs, common, t)
    return keys, doc, _lanes(keys, cls, part, lanes, splits)


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes reaches by the edges."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        open_ = np.flatnonzero(x != y)
        if not len(open_):
            return root
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root[root], root):
            root = root[root]


def _counted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each different pair and how often it comes."""
    code, times = np.unique((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64), return_counts=True)
    return (code >> np.uint64(32)).astype(np.int64), (code & np.uint64(0xFFFFFFFF)).astype(np.int64), times


def shared_keys(keys: np.ndarray, node: np.ndarray, nodes: int, need, pairs: int = PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(root of each node, and a, b, count of pairs). Every two nodes with a key in common have one root, or are a pair with the number of
    their common keys. need(a, b): how many of these are enough for one root."""
    low = max(1, int(nodes - 1).bit_length())
    packed = (keys << np.uint64(low)) | node.astype(np.uint64)  # keys lose bits at the top, which only makes more of them equal
    packed.sort()
    k, node = packed >> np.uint64(low), (packed & np.uint64((1 << low) - 1)).astype(np.int64)
    del packed

    def runs(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nonlocal k, node
        k, node = k[keep], node[keep]
        start = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(k)))
        return start, size, np.repeat(start, size)

    start, size, first = runs(np.ones(len(k), bool))
    start, size, first = runs(np.repeat(size > 1, size))
    # each with the first of its key: enough for most copies
    a, b, times = _counted(node, node[first])
    sure = times >= need(a, b)
    root = _roots(a[sure], b[sure], nodes)
    # keys whose nodes have several roots: their pairs, or one root for all where these are too many
    if len(k):
        apart = np.bitwise_or.reduceat(root[node] != root[node[first]], start)
        start, size, first = runs(np.repeat(apart, size))
    order = np.argsort(size, kind="stable")
    much = np.ones(len(size), bool)
    much[order] = np.cumsum(size[order] * (size[order] - 1) // 2) > pairs
    tied = np.repeat(much, size)
    root = _roots(np.append(node[tied], np.arange(nodes)), np.append(node[first[tied]], root), nodes)
    start, size, first = runs(~tied)
    after = size.repeat(size) - (np.arange(len(node)) - first) - 1
    a, b = np.repeat(node, after), node[ranges(np.arange(len(node)) + 1, after)]
    apart = root[a] != root[b]
    a, b, times = _counted(np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart]))
    sure = times >= need(a, b)
    root = _roots(np.append(a[sure], np.arange(nodes)), np.append(b[sure], root), nodes)
    weak = root[a] != root[b]
    return root, a[weak], b[weak], times[weak]


_KEYS = "bucket int, kind int, ids binary, places binary, low binary, high binary, sizes binary"
_COUNTS = "kind int, h long, n long"
_FOUND = "kind int, a long, b long, n long, f long, g long, t long"


def _batch(columns: list, names: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    parts = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, parts, strict=True)], names=[x for x, _ in parts])


def _frequent_here(words: int, t: Fraction):
    """Task: documents in; shingles of AGAIN different sets of a run of documents out, and the most keys of each class (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            for b in slices(batch, most=16 << 20):
                h, offs = shingle_sets(b.column("text"), words)
                doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
                once = np.zeros(len(offs) - 1, bool)
                once[np.unique(_sums(mix(h), doc, len(offs) - 1), return_index=True)[1]] = True
                x, n = np.unique(h[once[doc]], return_counts=True)
                yield _batch([np.zeros(int((n >= AGAIN).sum()), np.int32), x[n >= AGAIN].view(np.int64), n[n >= AGAIN]], _COUNTS)
                most = most_keys(np.diff(offs), t)
                yield _batch([np.ones(len(most), np.int32), np.arange(len(most)), most], _COUNTS)

    return run


def common_shingles(docs: DataFrame, words: int = WORDS, t: Fraction = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of at most COMMON frequent shingles, sorted, and the most keys of each class. The shingles make the keys more
    selective; the result is exact with any."""
    counts = docs.select("text").mapInArrow(_frequent_here(words, t), _COUNTS).groupBy("kind", "h").agg(F.sum("n").alias("n"))
    top = counts.filter((F.col("kind") == 1) | (F.col("n") >= 3 * AGAIN)).orderBy(F.desc("kind"), F.desc("n"), "h").limit(COMMON).toPandas()
    classes = top[top["kind"] == 1].sort_values("h")
    return np.sort(top[top["kind"] == 0]["h"].to_numpy(np.int64).view(np.uint64)), classes["n"].to_numpy(np.int64)


def _write_keys(buckets: int, words: int, t: Fraction, common, splits: np.ndarray):
    """Task: documents in, their sizes and set hashes and their keys by bucket out. Of equal sets only one gives keys. With the keys of a bucket go,
    for each document, its full parts and its size, as steps of _step and rounded so that links are never lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            for b in slices(batch, most=6 << 20):
                ids = b.column("doc_id").to_numpy()
                h, offs = shingle_sets(b.column("text"), words)
                n = np.diff(offs)
                doc = np.repeat(np.arange(len(n)), n)
                whole = [_sums(mix(h ^ odd), doc, len(n)) for odd in _ODD[:2]]
                rows = [[int(ids[0] % buckets), 0, ids.tobytes(), np.append(n, b.column("t").to_numpy()).astype(np.int64).tobytes(), whole[0].tobytes(), whole[1].tobytes(), b""]]
                one = np.sort(np.unique(np.stack([n.astype(np.uint64), *whole]), axis=1, return_index=True)[1])
                one = one[n[one] > 0]
                if len(one):
                    keys, owner, cls, part, filled = _blocks(h[ranges(offs[one], n[one])], np.append(0, np.cumsum(n[one])), common.value, t)
                    owner = one[owner]
                    lane = np.where(filled < 0, 1 + 2 * _lanes(keys, cls, part, 1, _groups(splits, 3)), 2 * _lanes(keys, cls, part, 1, _groups(splits, 2)))
                    order = np.argsort(lane, kind="stable")
                    keys, owner, cls, filled, lane = keys[order], owner[order], cls[order], filled[order], lane[order]
                    high = size_classes(int(n.max()) * t.denominator // t.numerator + 1)
                    used, edges = np.unique(lane, return_index=True)
                    edges = np.append(edges, len(lane))
                    for k, bucket in enumerate(used.tolist()):
                        at = slice(edges[k], edges[k + 1])
                        names, first, places = np.unique(owner[at], return_index=True, return_inverse=True)
                        x = keys[at]
                        step = _step(high[cls[edges[k]]])
                        sizes = np.append(np.maximum(filled[at][first], 0) // step, -(-n[names] // step)).astype(np.uint8)
                        rows.append([bucket // 2, 2 + bucket % 2, ids[names].tobytes(), places.astype(np.uint32 if len(names) > 65535 else np.uint16).tobytes(), (x & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), ((x >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.uint16).tobytes(), sizes.tobytes()])
                yield _batch([*zip(*rows, strict=True)], _KEYS)

    return run


def _groups(splits: np.ndarray, kind: int) -> np.ndarray:
    """Groups of each class for keys of parts (kind 2), which are two thirds of the most keys, and for those of prefixes (3)."""
    return -(-splits * (4 - kind) // 3)


def _step(high: int) -> int:
    """Full parts and sizes of a class are told in multiples of this, so that they fit a byte."""
    return -(-int(high) // 255)


def _read_keys(t: Fraction, splits: np.ndarray):
    """Task: rows in order of bucket; documents (kind 0), edges (1) and pairs to be added up (2: a, b, common keys, those that a link takes, class) out."""
    p, q = t.numerator, t.denominator
    highs = [4]
    while len(highs) < len(splits):
        highs.append(max(highs[-1] + 1, highs[-1] * 5 // 4))

    def met(bucket: int, kind: int, rows: list) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        ids, filled, size, keys, node = (np.concatenate(x) for x in zip(*rows, strict=True))
        own = _groups(splits, kind)
        cls = int(np.searchsorted(np.cumsum(own) - own, bucket, "right")) - 1
        step, groups = _step(highs[cls]), int(own[cls])

        def whole(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Keys that linked sets have in common at least: of parts the full ones of either without those in which they differ."""
            if kind == 3:
                return _prefix(np.maximum((np.minimum(size[a], size[b]) - 1) * step + 1, 1), t)[0]
            return np.maximum(1, np.maximum(filled[a], filled[b]) * step - (size[a] + size[b]) * step * (q - p) // (q + p))

        def need(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.minimum(whole(a, b), np.maximum(3, -(-whole(a, b) // groups)))

        root, a, b, times = shared_keys(keys, node, len(ids), need)
        more = whole(a, b) < 3 * groups
        a, b, times = a[more], b[more], times[more]
        tied = np.flatnonzero(root != np.arange(len(ids)))
        if len(tied):
            yield _batch([np.ones(len(tied), np.int32), ids[tied], ids[root[tied]], *[np.zeros(len(tied), np.int64)] * 4], _FOUND)
        if len(a):
            yield _batch([np.full(len(a), 2, np.int32), np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]), times, whole(a, b), np.full(len(a), 2 * cls + kind), np.zeros(len(a), np.int64)], _FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, count = None, [], 0
        for batch in trimmed(batches):
            for bucket, kind, x, y, low, high, sizes in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                names = np.frombuffer(x, np.int64)
                if kind == 0:
                    none = np.zeros(len(names), np.int64)
                    n, texts = np.frombuffer(y, np.int64).reshape(2, -1)
                    yield _batch([none, names, none, n, np.frombuffer(low, np.int64), np.frombuffer(high, np.int64), texts], _FOUND)
                    continue
                if (bucket, kind) != now:
                    yield from met(*(now or (0, 0)), rows)
                    now, rows, count = (bucket, kind), [], 0
                lows = np.frombuffer(low, np.uint32)
                keys = lows.astype(np.uint64) | (np.frombuffer(high, np.uint16).astype(np.uint64) << np.uint64(32))
                filled, size = np.frombuffer(sizes, np.uint8).astype(np.int64).reshape(2, -1)
                rows.append((names, filled, size, keys, np.frombuffer(y, np.uint16 if len(y) == 2 * len(lows) else np.uint32).astype(np.int64) + count))
                count += len(names)
        yield from met(*(now or (0, 0)), rows)

    return run


class SignatureTree:
    """Bitmaps, sizes and crowding of sets (leaves, in order of size) and of nodes over FANOUT children each."""

    def __init__(self, sets: list[np.ndarray]):
        n = np.array([len(s) for s in sets])
        width = 1 << max(8, min(16, int(4 * max(1, int(np.median(n))) - 1).bit_length()))
        while width > 256 and width * len(sets) > 1 << 25:
            width //= 2
        bits = np.zeros((len(sets), width), bool)
        for row, x in zip(bits, sets, strict=True):  # one by one: a copy of all sets would hold them twice
            row[x.astype(np.int64) & (width - 1)] = True
        sig = np.packbits(bits, axis=1).view(np.uint64)
        crowd = n - np.bitwise_count(sig).sum(axis=1).astype(np.int64)
        self.levels = [(sig, n, n, crowd)]
        while len(self.levels[-1][0]) > 1:
            sig, low, high, crowd = self.levels[-1]
            at = np.arange(0, len(sig), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(sig, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(crowd, at)))

    def may_link(self, level: int, i: np.ndarray, j: np.ndarray, t: Fraction, first: int | None = None) -> np.ndarray:
        """Whether some pair under the nodes can reach t by its sizes and greatest possible overlap; i are nodes of `first` if given."""
        a_sig, a_low, a_high, a_crowd = self.levels[level if first is None else first]
        sig, low, high, crowd = self.levels[level]
        p, q = t.numerator, t.denominator
        out = (a_high[i] * q >= low[j] * p) & (high[j] * q >= a_low[i] * p)
        k = np.flatnonzero(out)
        for at in range(0, len(k), 20_000):
            part = k[at : at + 20_000]
            a, b = i[part], j[part]
            common = np.bitwise_count(a_sig[a] & sig[b]).sum(axis=1).astype(np.int64) + np.minimum(a_crowd[a], crowd[b])
            common = np.minimum(common, np.minimum(a_high[a], high[b]))
            out[part] = common * (p + q) >= (a_low[a] + low[b]) * p
        return out

    def near(self, leaf: int, t: Fraction) -> np.ndarray:
        """Leaves that may link with one."""
        j = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            j = j[self.may_link(level, np.full(len(j), leaf), j, t, 0)]
            if level:
                j = (j[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                j = j[j < len(self.levels[level - 1][0])]
        return j[j != leaf]

    def pairs(self, t: Fraction, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves that the dual traversal leaves. label: of each leaf; pairs under one label are left out."""
        labels = [np.arange(len(self.levels[0][0])) if label is None else label]
        while len(labels) < len(self.levels):  # of a node: its leaves' if they have one, else -1
            at = np.arange(0, len(labels[-1]), FANOUT)
            low, high = np.minimum.reduceat(labels[-1], at), np.maximum.reduceat(labels[-1], at)
            labels.append(np.where(low == high, low, -1))

        def met(level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            own = labels[level]
            keep = (own[i] != own[j]) | (own[i] < 0) | ((label is None) & (i == j))
            i, j = i[keep], j[keep]
            keep = self.may_link(level, i, j, t)
            return i[keep], j[keep]

        i, j = met(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))
        step = np.arange(FANOUT)
        for level in range(len(self.levels) - 1, 0, -1):
            below, found = len(self.levels[level - 1][0]), [(i[:0], j[:0])]
            for at in range(0, len(i), 10_000):  # of the pairs below, only those that may link are held together
                a = (i[at : at + 10_000, None] * FANOUT + step)[:, :, None]
                b = (j[at : at + 10_000, None] * FANOUT + step)[:, None, :]
                a, b = np.broadcast_arrays(a, b)
                ok = (a < below) & (b < below) & ((a < b) | ((level > 1) & (a == b)))
                found.append(met(level - 1, a[ok], b[ok]))
            i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        return i[i != j], j[i != j]


def tree_links(sets: list[np.ndarray], labels: list[int], t: Fraction = THRESHOLD) -> list[tuple[int, int]]:
    """Links (positions in sets) that join what the labels and earlier links leave apart; all links lie inside the outcome."""
    order = sorted(range(len(sets)), key=lambda k: (len(sets[k]), int(sets[k][0]) if len(sets[k]) else 0))
    sets, labels = [sets[k] for k in order], [labels[k] for k in order]
    root = list(range(len(sets)))
    seen: dict[int, int] = {}
    for k, label in enumerate(labels):
        root[k] = seen.setdefault(label, k)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    tree = SignatureTree(sets)
    n = np.array([len(x) for x in sets])
    p, q = t.numerator, t.denominator
    met: set[int] = set()  # roots of those that have met the tree by themselves
    for k in range(len(sets)):
        if len(met) >= SINGLES:
            break
        met = {find(x) for x in met}
        if find(k) in met:
            continue
        met.add(find(k))
        maybe = tree.near(k, t)
        maybe = maybe[[find(x) != find(k) for x in maybe.tolist()]] if len(maybe) else maybe
        for part in np.split(maybe, np.flatnonzero(np.diff(np.cumsum(n[maybe]) >> 20)) + 1) if len(maybe) else ():  # about a million shingles
            inside = np.isin(np.concatenate([sets[x] for x in part.tolist()]), sets[k], assume_unique=False)
            both = np.add.reduceat(inside.astype(np.int64), np.cumsum(n[part]) - n[part])
            for x in part[both * q >= (n[part] + n[k] - both) * p].tolist():
                a, b = find(k), find(x)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((order[k], order[x]))
    for i, j in zip(*(x.tolist() for x in tree.pairs(t, np.array([find(k) for k in range(len(sets))]))), strict=True):
        x, y = find(i), find(j)
        if x != y:
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both * q >= (len(sets[i]) + len(sets[j]) - both) * p:
                root[max(x, y)] = min(x, y)
                out.append((order[i], order[j]))
    return out


def _grow_trees(words: int, t: Fraction):
    """Task: rows (group, set_id, label, text) in order of group; links out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, labels, sets = None, [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            if len(sets) > 1:
                links = tree_links(sets, labels, t)
                if links:
                    yield _batch([[ids[a] for a, _ in links], [ids[b] for _, b in links]], "a long, b long")

        for batch in trimmed(batches):
            for b in slices(batch):
                h, offs = shingle_sets(b.column("text"), words)
                names = zip(b.column("group").to_pylist(), b.column("set_id").to_pylist(), b.column("label").to_pylist(), strict=True)
                for d, (g, name, label) in enumerate(names):
                    if g != group:
                        yield from close()
                        group, ids, labels, sets = g, [], [], []
                    ids.append(name)
                    labels.append(label)
                    sets.append(h[offs[d] : offs[d + 1]].copy())
        yield from close()

    return run


def _join_texts(docs: DataFrame, members: DataFrame, words: int, t: Fraction) -> DataFrame:
    """Links inside each group of members (group, set_id, label)."""
    members = stored(members, "members")
    members = F.broadcast(members) if members.count() <= BROADCAST_MEMBERS else members
    rows = docs.join(members, docs["doc_id"] == members["set_id"]).select("group", "set_id", "label", "text")
    laid = rows.repartition(partitions(docs.sparkSession), "group").sortWithinPartitions("group", "set_id")
    return stored(laid.mapInArrow(_grow_trees(words, t), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: Fraction = THRESHOLD, chunk: int = CHUNK, lane_keys: int = LANE_KEYS, chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    return _judged(docs, words, threshold, chunk, lane_keys, chunk_shingles).drop("text_hash")


def _judged(docs: DataFrame, words: int = WORDS, threshold: Fraction = THRESHOLD, chunk: int = CHUNK, lane_keys: int = LANE_KEYS, chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """The same with the text's hash, which with doc_id names a row."""
    spark = tune(docs.sparkSession)
    docs, restore = as_long(docs, "text")
    buckets = partitions(spark)
    frequent, most = common_shingles(docs, words, threshold)
    common, splits = spark.sparkContext.broadcast(frequent), lane_splits(most, 1, threshold, lane_keys)
    keys = docs.withColumn("t", F.xxhash64("text")).mapInArrow(_write_keys(buckets, words, threshold, common, splits), _KEYS)
    found = stored(keys.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_read_keys(threshold, splits), _FOUND), "blocks")
    rows = found.filter("kind = 0").select(F.col("a").alias("doc_id"), "n", "f", "g", "t")
    sets = stored(rows.filter("n > 0").groupBy("n", "f", "g").agg(F.min("doc_id").alias("set_id")), "set-ids")
    owned = stored(rows.join(sets, ["n", "f", "g"], "left").select("doc_id", "n", "t", "set_id"), "sets")
    to_set = owned.filter("doc_id <> set_id").select("doc_id", "set_id").distinct()

    def as_sets(edges: DataFrame) -> DataFrame:
        for c in ("a", "b"):
            edges = edges.join(to_set.select(F.col("doc_id").alias(c), "set_id"), c, "left").withColumn(c, F.coalesce("set_id", c)).drop("set_id")
        return edges.filter("a <> b").distinct()

    added = found.filter("kind = 2").groupBy("a", "b", "g").agg(F.sum("n").alias("n"), F.min("f").alias("f")).filter("n >= f")
    edges = found.filter("kind = 1").select("a", "b").unionByName(added.select("a", "b"))
    groups = components(as_sets(edges.distinct()))
    mass = sets.groupBy(F.col("set_id").alias("node")).agg(F.max("n").alias("n"))
    groups = stored(groups.join(mass, "node", "left").select("node", "component", F.coalesce("n", F.lit(1)).alias("n")), "groups")
    parts = components(_links(docs, groups, words, threshold, chunk, chunk_shingles))
    out = owned.join(parts, owned["set_id"] == parts["node"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "set_id", "doc_id").alias("component_id"), F.col("t").alias("text_hash"))
    return restore(out, "doc_id", "component_id").select("doc_id", "n_shingles", "component_id", "text_hash")


def _by_size(groups: DataFrame, t: Fraction) -> DataFrame:
    """Groups (node, component, n, head) cut by size. A set goes to its own class and to the class of the least set that it can link
    with, which is the same or the one below; so each link lies whole in some class. Classes without a possible pair go."""
    p, q = t.numerator, t.denominator
    bounds = [1]
    while bounds[-1] < 1 << 40:
        bounds.append(max(bounds[-1] + 1, -(-bounds[-1] * 3 // 2), -(-bounds[-1] * q // p)))
    cls = lambda n: F.size(F.filter(F.lit(bounds), lambda x: x <= n))
    own, least = cls(F.col("n")), cls(F.floor((F.col("n") * p + (q - 1)) / q))
    rows = groups.select("node", "n", "component", own.alias("own"), F.explode(F.array_distinct(F.array(own, least))).alias("cls"))
    rows = stored(rows.select("node", "n", F.xxhash64("component", "cls").alias("component"), (F.col("own") == F.col("cls")).alias("here")), "sizes")
    met = rows.groupBy("component").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("members"), F.bool_or("here").alias("some"))
    return rows.join(met.filter("members > 1 and some"), "component").select("node", "component", "n", "head")


def _links(docs: DataFrame, groups: DataFrame, words: int, t: Fraction, chunk: int, chunk_shingles: int) -> DataFrame:
    """(a, b): links that span the components of all links between the sets of each group (node, component, n)."""

    def over_a_chunk(groups: DataFrame) -> DataFrame:
        sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("mass"))
        need = F.greatest(F.ceil(F.col("size") / chunk), F.least(F.ceil(F.col("mass") / chunk_shingles), F.col("size")))
        return stored(sizes.select("component", need.cast("int").alias("chunks")).filter("chunks > 1"), "big-groups")

    big = over_a_chunk(groups)
    groups = groups.withColumn("head", F.col("component"))
    if big.count():
        cut = groups.join(big.select("component"), "component", "left_semi")
        groups = stored(groups.join(big.select("component"), "component", "left_anti").unionByName(_by_size(cut, t)), "groups-by-size")
        big = over_a_chunk(groups)
    placed = groups.join(F.broadcast(big) if big.count() <= BROADCAST_MEMBERS else big, "component", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    at = F.when(F.col("node") == F.col("head"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(own))
    members = placed.select("component", F.col("node").alias("set_id"), F.col("node").alias("label"), F.explode(at).alias("chunk"))
    members = members.select(F.struct("component", "chunk").alias("g"), "set_id", "label").select(F.xxhash64("g").alias("group"), "set_id", "label")
    links = _join_texts(docs, members, words, t)
    if not big.count():
        return links
    # what is still apart in the big groups meets every chunk of its group
    parts = components(links)
    apart = groups.join(big, "component").join(parts.select("node", F.col("component").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = stored(apart, "apart")
    heads = apart.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n"))
    main = heads.groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    todo = apart.join(main, "component")
    rest = todo.filter("label <> main")
    left = rest.count()
    if not left:
        return links
    need = F.greatest(F.ceil(F.count(F.lit(1)) / chunk), F.least(F.ceil(F.sum("n") / chunk_shingles), F.count(F.lit(1))))
    slots = rest.groupBy("component").agg(need.cast("int").alias("slots"))
    todo = todo.join(slots, "component")
    slot, own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("slots")).cast("int"), F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    meets = F.flatten(F.array(
        F.transform(every("slots"), lambda s: F.struct(s.alias("slot"), own.alias("chunk"))),
        F.when(F.col("label") != F.col("main"), F.transform(every("chunks"), lambda c: F.struct(slot.alias("slot"), c.alias("chunk")))).otherwise(F.array().cast("array<struct<slot:int,chunk:int>>")),
    ))
    again = todo.select("component", F.col("node").alias("set_id"), "label", F.explode(F.array_distinct(meets)).alias("m"))
    again = again.select(F.xxhash64("component", "m.slot", "m.chunk", F.lit(2)).alias("group"), "set_id", "label")
    return links.unionByName(_join_texts(docs, again, words, t))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with the first document (least doc_id, nulls first) of each component; columns unchanged. Rows are told apart by doc_id and
    text: where an id has several texts, each is a document of its own, in order of the texts' hashes. Rows equal in both stay
    or go together."""
    text = F.xxhash64("text")
    names = docs.select("doc_id", text.alias("text_hash"))
    if names.distinct().groupBy("doc_id").count().filter("count > 1").limit(1).count():
        known, _ = numbered(names.distinct(), ["doc_id", "text_hash"], "number")
        known = stored(known.select(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_text"), "number"), "numbered-rows")
        met = docs.select("doc_id", "text").join(known, F.col("doc_id").eqNullSafe(F.col("own_id")) & (text == F.col("own_text")))
        judged = _judged(met.select(F.col("number").alias("doc_id"), "text"), **options).filter("component_id <> doc_id").select(F.col("doc_id").alias("number"))
        gone = known.join(judged.distinct(), "number").select(F.col("own_id").alias("_gone_id"), F.col("own_text").alias("_gone_text"))
    else:
        judged = _judged(docs, **options).filter(~F.col("component_id").eqNullSafe(F.col("doc_id")))
        gone = judged.select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_text")).distinct()
    gone = stored(gone, "near-duplicates")
    few = gone.count() <= BROADCAST_MEMBERS
    same = docs["doc_id"].eqNullSafe(gone["_gone_id"]) & (F.xxhash64(docs["text"]) == gone["_gone_text"])
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
