"""Finding windows of L units (words or bytes) that also start earlier, in whole corpora.

A window's minimiser is its k-unit gram of least hash, the leftmost of equals. Consecutive windows of a document with the
same minimiser are a segment. Equal windows have equal minimisers, so they meet when segments are dealt by the minimiser's hash.

1. Segments travel as hashes, each different one (minimiser and content) once from a batch. Minimisers of one segment that
   stands once are done with: none of their windows repeats. The hashes only tell what has to be looked up and where.
2. The first of each different segment of a minimiser that has several is read again, dealt by minimiser, and put into
   shards of bounded size. A shard's index (an FM-index or longest-previous-factor arrays) tells which windows start earlier.
3. Every later place of a segment is read again, too, and its own units are looked up in the index of a shard that holds the
   segment's first place: its windows go where the index finds all of them together at an earlier place. A task sends equal
   contents of a batch once, with their places. First places of common segments stand in several shards, among
   which the later places are dealt. Places that the index doesn't find (segments of equal hashes and different contents) go
   through step 2 window by window, with the segments of their minimisers.
4. A minimiser that is crowded in some batch (many different segments, as at the edges of a very common passage), or that has more
   than TOGETHER different segments in all batches, is dealt by single windows instead, of which a batch sends only the
   first and one more: a shard holds its bytes and TOGETHER segments at most, or the different windows of one hash.

So every window that goes was found by an index that was given this window's own units.

Positions are ordered by (doc_id, start). Rows that share a doc_id are versions of one document: what is found in one
is removed from all of them at that place, and places that coincide never count as earlier. Null doc_ids come first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import SPACE, covered, prefix_hash, prefix_sums, range_hash, ranges, rolling_hash, slices, span_hash, text_parts, window_starts, word_spans
from .common import partitions, stored, trimmed, tune
from .ids import as_long

CROWDED = 40
#: Different segments that one minimiser puts into an index shard at most; a segment is shorter than two windows.
TOGETHER = 8000
#: Bytes of text that a task looks at together.
SLICE = 3 << 19
#: Later places of one segment that are looked up in one shard, about.
SPREAD = 4096


@dataclass
class Units:
    """A batch of documents as units: the units (words as hashes), their hash sums, where documents begin, and the bytes of each unit."""

    unit: np.ndarray
    sums: np.ndarray
    offs: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray

    def content(self, first: int, last: int) -> bytes:
        return self.data[self.start[first] : self.end[last - 1]].tobytes()


def word_units(column: pa.Array) -> Units:
    data, offs = text_parts(column)
    start, end, word_offs = word_spans(data, offs, ~SPACE)
    words = span_hash(data, start, end, False)
    return Units(words, prefix_sums(words), word_offs, start, end, data)


def byte_units(column: pa.Array) -> Units:
    data, offs = text_parts(column)
    at = np.arange(len(data) + 1)
    return Units(data, prefix_hash(data, False), offs, at[:-1], at[1:], data)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of x[i : i + w] at every i."""
    n, span = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    while span * 2 <= w:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[w - span : w - span + n])


def segments(u: Units, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(minimiser hash, content hash, document, first unit, windows) of each segment."""
    n = len(u.sums) - 1
    starts = window_starts(u.offs, length)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    grams = rolling_hash(u.sums, gram)
    at = np.arange(len(grams))
    least = sliding_min((grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64), length - gram + 1)[starts]
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    windows = np.diff(np.append(first, len(starts)))
    s = starts[first]
    return grams[place[first]], range_hash(u.sums, s, s + windows - 1 + length), np.searchsorted(u.offs, s, "right") - 1, s, windows


def _later(keys: tuple[np.ndarray, ...], ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions of the first of each key, which of the keys they have, positions of those that stand later)."""
    order = np.lexsort((start, ids, *keys[::-1]))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    head = order[np.flatnonzero(new)]
    group = np.cumsum(new) - 1
    own = head[group] if len(head) else head
    later = (ids[order] != ids[own]) | (start[order] != start[own])
    return head, group[np.argsort(order)] if len(order) else group, order[later]


_POST = "bucket int, kind int, keys binary, hashes binary, ids binary, places binary, starts binary, windows binary"
#: kind 0: later places of a segment. First places: 1: its windows are judged; 2: the same of crowded minimisers; LOOK more where it has later places.
_FOUND = "kind int, key long, h long, doc_id long, start int, windows int"
LOOK = 4
#: What is read at a place, beside kinds 1 and 2: a segment to look others up in, and one to look up.
SOUGHT_IN, SOUGHT = 3, 4
#: A content of `windows` windows and its places, under what deals it. late: it is looked up only.
_SEGMENT = "lay long, look boolean, late boolean, ids binary, starts binary, windows int, content binary"
#: kind 0: places that the index didn't find; 1: windows that start earlier.
_EARLY = "kind int, doc_id long, start int, windows int"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(columns: list, names: str) -> pa.RecordBatch:
    parts = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[k]) for c, (_, k) in zip(columns, parts, strict=True)], names=[x for x, _ in parts])


def _post(bucket: int, kind: int, v, h, ids, start, windows) -> list:
    names, places = np.unique(ids, return_inverse=True)
    return [bucket, kind, v.tobytes(), h.tobytes(), names.tobytes(), places.astype(np.uint16 if len(names) <= 65535 else np.uint32).tobytes(), start.astype(np.uint32).tobytes(), windows.astype(np.uint8 if len(windows) == 0 or windows.max() < 256 else np.uint32).tobytes()]


def _narrow(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(x) // max(n, 1)] if n else np.uint8).astype(np.int64)


def _read_post(row) -> tuple[np.ndarray, ...]:
    v = np.frombuffer(row[2], np.uint64)
    n = len(v)
    return v, np.frombuffer(row[3], np.uint64), np.frombuffer(row[4], np.int64)[_narrow(row[5], n)], _narrow(row[6], n), _narrow(row[7], n)


def _write_posts(make: Callable, length: int, gram: int, buckets: int, crowded: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            for b in slices(batch, most=SLICE):
                u = make(b.column("text"))
                v, h, doc, s, windows = segments(u, length, gram)
                ids = b.column("doc_id").to_numpy()[doc]
                start = s - u.offs[doc]
                head, group, later = _later((v, h), ids, start)
                twice = np.zeros(len(head), np.int64)
                twice[group[later]] = 1
                rows = []
                if len(later):
                    rows.append(_post(int(ids[later[0]] % buckets), 0, v[later], h[later], ids[later], start[later], windows[later]))
                v, h, ids, start, windows = (x[head] for x in (v, h, ids, start, 2 * windows + twice[group]))
                edge = np.concatenate([[0], np.flatnonzero(v[1:] != v[:-1]) + 1]) if len(v) else np.zeros(0, np.int64)
                many = np.repeat(np.diff(np.append(edge, len(v))), np.diff(np.append(edge, len(v)))) > crowded
                where = np.where(many, h ^ v, v) % np.uint64(buckets)
                key = where.astype(np.int64) * 2 + many
                order = np.argsort(key, kind="stable")
                cuts = np.searchsorted(key[order], np.arange(2 * buckets + 1))
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    at = order[cuts[k] : cuts[k + 1]]
                    rows.append(_post(k // 2, 1 + k % 2, v[at], h[at], ids[at], start[at], windows[at]))
                told = np.unique(v[many])
                for k in np.unique(told % np.uint64(buckets)).tolist():
                    x = told[told % np.uint64(buckets) == k]
                    none = np.zeros(len(x), np.int64)
                    rows.append(_post(int(k), 3, x, x, none, none, none))
                if rows:
                    yield _batch([*zip(*rows, strict=True)], _POST)

    return run


def _found(kind, v, h, ids, start, windows) -> pa.RecordBatch:
    return _batch([(np.zeros(len(v), np.int64) + kind).astype(np.int32), v.view(np.int64), h.view(np.int64), ids, start.astype(np.int32), windows.astype(np.int32)], _FOUND)


def _match_posts(together: int):
    """Task: posts in order of bucket; windows found and segments to read out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, plain, crowded, told = None, [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            for posts, kind in ((plain, 1), (crowded, 2)):
                if posts:
                    v, h, ids, start, windows = (np.concatenate(x) for x in zip(*posts, strict=True))
                    windows, twice = windows >> 1, windows & 1
                    head, group, later = _later((v, h), ids, start)
                    if len(later):
                        yield _found(0, v[later], h[later], ids[later], start[later], windows[later])
                    again = np.bincount(group, weights=twice, minlength=len(head)) > 0
                    again[group[later]] = True
                    x = v[head]
                    edge = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1])
                    size = np.diff(np.append(edge, len(x)))
                    size = np.repeat(size, size)
                    hot = (size > together) | np.isin(x, np.concatenate(told) if told else x[:0])
                    if kind == 2:
                        hot[:] = True
                    use = np.flatnonzero((size > 1) | again | hot)
                    if len(use):
                        at = head[use]
                        judge = np.where(hot, 2, size > 1)
                        yield _found(judge[use] + LOOK * again[use], v[at], h[at], ids[at], start[at], windows[at])

        for batch in trimmed(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != bucket:
                    yield from close()
                    bucket, plain, crowded, told = row[0], [], [], []
                if row[1] == 0:
                    yield _found(0, *_read_post(row))
                elif row[1] == 3:
                    told.append(np.frombuffer(row[2], np.uint64))
                else:
                    (plain if row[1] == 1 else crowded).append(_read_post(row))
        yield from close()

    return run


def _segment(lay: int, look: bool, late: bool, ids: list, starts: list, windows: int, content: bytes) -> tuple:
    return lay, look, late, np.array(ids, np.int64).tobytes(), np.array(starts, np.int64).tobytes(), windows, content


def _single_windows(u: Units, name: np.ndarray, a: np.ndarray, start: np.ndarray, length: int) -> list[tuple]:
    """Windows at units `a`, dealt by their hashes: the first of each to be judged, and its equals of this batch to be looked up."""
    key = range_hash(u.sums, a, a + length)
    head, group, _ = _later((key,), name, start)
    first = head[group]
    same = np.ones(len(a), bool)
    for k in range(length):
        same &= u.unit[a + k] == u.unit[a[first] + k]
    key = key.view(np.int64)
    out = []
    for i in np.flatnonzero((first == np.arange(len(a))) | ~same).tolist():
        out.append(_segment(int(key[i]), False, False, [name[i]], [start[i]], 1, u.content(int(a[i]), int(a[i]) + length)))
    again = np.flatnonzero(same & ((name != name[first]) | (start != start[first])))
    again = again[np.argsort(first[again], kind="stable")]
    cuts = np.flatnonzero(np.diff(first[again], prepend=-1, append=-1))
    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        i, f = int(again[x]), int(first[again[x]])
        out.append(_segment(int(key[i]), True, False, [name[f]], [start[f]], 1, u.content(int(a[f]), int(a[f]) + length)))
        out.append(_segment(int(key[i]), True, True, name[again[x:y]], start[again[x:y]], 1, u.content(int(a[i]), int(a[i]) + length)))
    return out


def _read_segments(make: Callable, length: int):
    """Task: documents with the places to read; their contents out (crowded ones window by window)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            for b in slices(batch, most=SLICE):
                u = make(b.column("text"))
                lists = b.column("want")
                counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                role, lay, start, windows = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists.flatten().flatten())
                doc = np.repeat(np.arange(b.num_rows), counts)
                here = start + windows - 1 + length <= np.diff(u.offs)[doc]  # places beyond the end are another version's
                role, lay, start, windows, doc = (x[here] for x in (role, lay, start, windows, doc))
                name = b.column("doc_id").to_numpy()[doc]
                a = u.offs[doc] + start
                begin, end = u.start[a].tolist(), u.end[a + windows + (length - 2)].tolist()
                data = memoryview(np.ascontiguousarray(u.data))
                rows: list[tuple] = []
                for i in np.flatnonzero((role == 1) | (role == SOUGHT_IN)).tolist():
                    rows.append(_segment(int(lay[i]), bool(role[i] == SOUGHT_IN), False, [name[i]], [start[i]], int(windows[i]), bytes(data[begin[i] : end[i]])))
                sought: dict[tuple[int, int, bytes], list[int]] = {}
                for i, x, n in zip((at := np.flatnonzero(role == SOUGHT)).tolist(), lay[at].tolist(), windows[at].tolist(), strict=True):
                    sought.setdefault((x, n, bytes(data[begin[i] : end[i]])), []).append(i)
                rows += [_segment(x, True, True, name[at], start[at], n, content) for (x, n, content), at in sought.items()]
                hot = np.flatnonzero(role == 2)
                if len(hot):
                    first = ranges(start[hot], windows[hot])
                    from_doc = np.repeat(doc[hot], windows[hot])
                    rows += _single_windows(u, np.repeat(name[hot], windows[hot]), u.offs[from_doc] + first, first, length)
                for at in range(0, len(rows), 20_000):
                    yield _batch([*zip(*rows[at : at + 20_000], strict=True)], _SEGMENT)

    return run


def _index_shards(index: Callable, shard_bytes: int):
    """Task: contents in order of what deals them; windows that start earlier out. A shard ends between two lays.

    The first place of each content makes up the index, the others are looked up in it, in runs of about shard_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, size = None, {}, 0  # first: the first place and the windows of each content
        sought: list[tuple[bytes, np.ndarray, np.ndarray, int]] = []
        waiting = 0

        def close(judge: bool) -> Iterator[pa.RecordBatch]:
            heads = sorted((*place, content) for content, place in first.items())
            if not heads or (len(heads) < 2 and not sought):
                return
            ids, start, windows = (np.array(x, np.int64) for x in zip(*(r[:3] for r in heads), strict=True))
            shard = index([r[3] for r in heads], ids, start)
            if judge and len(heads) > 1:
                early = shard.early(windows)  # one flag for each window, in order
                segment = np.repeat(np.arange(len(heads)), windows)
                offset = ranges(np.zeros(len(heads), np.int64), windows)
                at = np.flatnonzero(early)
                if len(at):
                    new = np.ones(len(at), bool)
                    new[1:] = (np.diff(at) != 1) | (segment[at][1:] != segment[at][:-1])
                    begin = np.flatnonzero(new)
                    x = at[begin]
                    yield _batch([np.ones(len(x), np.int32), ids[segment[x]], (start[segment[x]] + offset[x]).astype(np.int32), np.diff(np.append(begin, len(at))).astype(np.int32)], _EARLY)
            if sought:
                least = [min(zip(i.tolist(), s.tolist(), strict=True)) for _, i, s, _ in sought]
                at_id, at_start = shard.find([x[0] for x in sought], np.array([x[0] for x in least], np.int64), np.array([x[1] for x in least], np.int64))
                n = np.array([len(x[1]) for x in sought])
                i, s = (np.concatenate([x[k] for x in sought]) for k in (1, 2))
                w, at_id, at_start = (np.repeat(x, n) for x in (np.array([x[3] for x in sought]), at_id, at_start))
                found = (at_start >= 0) & ((at_id < i) | ((at_id == i) & (at_start < s)))
                yield _batch([found.astype(np.int32), i, s.astype(np.int32), w.astype(np.int32)], _EARLY)

        for b in trimmed(batches):
            for lay, look, late, ids, starts, n, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now != (look, lay):
                    if now and (size + waiting >= shard_bytes or now[0] != look):
                        yield from close(not now[0])
                        first, size, sought, waiting = {}, 0, [], 0
                    now = (look, lay)
                i, s = np.frombuffer(ids, np.int64), np.frombuffer(starts, np.int64)
                if not late:
                    place = (int(i[0]), int(s[0]), n)
                    known = first.get(content)
                    if known is None:
                        size += len(content)
                    if known is None or place < known:
                        first[content] = place
                    if known is None or place[:2] == known[:2]:
                        continue
                    i, s = (np.array([x]) for x in max(place, known)[:2])
                sought.append((content, i, s, n))
                waiting += len(content) + 16 * len(i)
                if waiting >= max(shard_bytes, size):
                    yield from close(False)
                    sought, waiting = [], 0
        if now:
            yield from close(not now[0])

    return run


def _look_up(docs: DataFrame, found: DataFrame, make: Callable, index: Callable, length: int, shard_bytes: int) -> DataFrame:
    """What the indexes tell about the places of found, stored."""
    spark = docs.sparkSession
    common = found.filter("kind = 0").groupBy("key", "h").agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("salts")).filter("salts > 1")
    met = found.join(stored(common, "common-segments"), ["key", "h"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    read = lambda role, lay: F.struct(F.lit(role).alias("role") if isinstance(role, int) else role.alias("role"), lay.alias("lay"), "start", "windows")
    lay = lambda salt: F.xxhash64("key", "h", salt)
    judge = F.when(F.col("kind") % LOOK > 0, F.array(read(F.col("kind") % LOOK, F.col("key")))).otherwise(F.array())
    look = F.when(F.col("kind") >= LOOK, F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda k: read(SOUGHT_IN, lay(k)))).otherwise(F.array())
    dealt = F.array(read(SOUGHT, lay(F.pmod(F.xxhash64("doc_id", "start"), F.col("salts").cast("long")).cast("int"))))
    todo = met.select("doc_id", F.explode(F.when(F.col("kind") == 0, dealt).otherwise(F.concat(judge, look))).alias("x"))
    want = todo.groupBy("doc_id").agg(F.collect_list("x").alias("want"))
    out = docs.join(want, "doc_id").select("doc_id", "text", "want").mapInArrow(_read_segments(make, length), _SEGMENT)
    laid = out.repartition(partitions(spark), "look", "lay").sortWithinPartitions("look", "lay", "late")
    return stored(laid.mapInArrow(_index_shards(index, shard_bytes), _EARLY), "early-windows")


def repeated_windows(docs: DataFrame, make: Callable, index: Callable, length: int, gram: int, shard_bytes: int, crowded: int = CROWDED, together: int = TOGETHER) -> DataFrame:
    """(doc_id, start, windows): runs of windows that also start earlier. docs: doc_id (long, no nulls), text."""
    spark = tune(docs.sparkSession)
    buckets = partitions(spark)
    posts = docs.mapInArrow(_write_posts(make, length, gram, buckets, crowded), _POST)
    found = stored(posts.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_match_posts(together), _FOUND), "segments")
    return early_places(docs, found, make, index, length, shard_bytes)


def early_places(docs: DataFrame, found: DataFrame, make: Callable, index: Callable, length: int, shard_bytes: int) -> DataFrame:
    """The same for the segments found to have equal hashes or minimisers."""
    at = ("doc_id", "start", "windows")
    early = _look_up(docs, found, make, index, length, shard_bytes)
    missed = early.filter("kind = 0").select(*at).distinct()
    if missed.isEmpty():
        return early.select(*at)
    missed = stored(found.join(missed, list(at), "left_semi"), "missed")
    first = found.filter("kind > 0").join(missed.select("key").distinct(), "key", "left_semi")
    again = _look_up(docs, first.unionByName(missed).withColumn("kind", F.lit(2)), make, index, length, shard_bytes)
    return early.unionByName(again).filter("kind = 1").select(*at)


def remove_repeats(docs: DataFrame, make: Callable, index: Callable, length: int, gram: int, shard_bytes: int, finish: Callable, schema: str, crowded: int = CROWDED, together: int = TOGETHER) -> DataFrame:
    """One row per row of docs: what finish(units, removed mask, document) makes of it, under `schema` after doc_id."""
    docs, restore = as_long(docs, "text")
    gone = repeated_windows(docs, make, index, length, gram, shard_bytes, crowded, together)
    by_doc = gone.groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows")).alias("gone"))
    whole = f"doc_id long, {schema}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            for b in slices(batch, most=SLICE):
                u = make(b.column("text"))
                lists = b.column("gone")
                lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
                flat = lists.flatten()
                counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(b.num_rows), counts)
                start = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
                span = flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64) + length - 1
                size = np.diff(u.offs)[doc]
                start = np.minimum(start, size)
                span = np.minimum(span, size - start)
                mask = covered(len(u.sums) - 1, u.offs[doc] + start, span)
                rows = [finish(u, mask, d) for d in range(b.num_rows)]
                yield _batch([b.column("doc_id"), *zip(*rows, strict=True)], whole)

    out = docs.join(by_doc, "doc_id", "left").select("doc_id", "text", "gone").mapInArrow(run, whole)
    return restore(out, "doc_id")
