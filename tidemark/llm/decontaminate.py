"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over the words of whole documents.

Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z. A window is N consecutive words of an
item; an item of fewer words, but not none, is one window. Window hashes that occur in a document are verified word by
word before they count. A document word inside any occurrence of a window is hit.

A benchmark of up to BLOCK_BYTES of text is broadcast and the documents are never shuffled. A larger one is read in blocks of that
size: one block is broadcast at a time, its hits are stored as narrow rows by the text's hashes, and the broadcast is
dropped before the next; in the end the documents meet the hits of all blocks by those hashes.

Null texts and items have no words. Repeated items count by their ids. An empty benchmark hits nothing; an empty table of
documents gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import ALNUM, LOWER, covered, slices, span_hash, text_parts, window_hash, window_starts, word_spans
from .common import fresh, stored, trimmed, tune, without

WORDS = 10
BLOCK_BYTES = 8 << 20
EXTRA = T.StructType().add("n_words", "long").add("n_hit", "long").add("hits", "binary").add("items", T.ArrayType(T.StringType())).add("kept_text", "string")


def build_index(items: list[tuple], words: int) -> dict[int, tuple[np.ndarray, dict[int, dict[bytes, list[str]]]]]:
    """By window length: sorted hashes, and for each hash the windows' words with the ids of their items."""
    found: dict[int, dict[int, dict[bytes, list[str]]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
    data, offs = text_parts(pa.array([t for _, t in items], pa.large_string()))
    start, end, word_offs = word_spans(data, offs, ALNUM)
    hashes = span_hash(data, start, end, True)
    low = LOWER[data].tobytes()
    for k, (name, _) in enumerate(items):
        a, b = int(word_offs[k]), int(word_offs[k + 1])
        size = min(words, b - a)
        if size:
            for i, h in enumerate(window_hash(hashes[a:b], size).tolist()):
                text = b" ".join(low[s:e] for s, e in zip(start[a + i : a + i + size], end[a + i : a + i + size], strict=True))
                found[size][h][text].append(str(name))
    return {size: (np.array(sorted(by), np.uint64), {h: dict(x) for h, x in by.items()}) for size, by in found.items()}


def _scan(b: pa.RecordBatch, index) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, set]]:
    """(start and end of the words, where documents' words begin, hit words, items by document) of one run of documents."""
    data, offs = text_parts(b.column("text"))
    start, end, word_offs = word_spans(data, offs, ALNUM)
    hashes = span_hash(data, start, end, True)
    at, span, names = [], [], defaultdict(set)
    low = None
    for size, (known, windows) in index.items():
        grams = window_hash(hashes, size)
        maybe = window_starts(word_offs, size)
        if not len(maybe) or not len(known):
            continue
        g = grams[maybe]
        place = np.minimum(np.searchsorted(known, g), len(known) - 1)
        maybe = maybe[known[place] == g]
        if not len(maybe):
            continue
        if low is None:
            low = LOWER[data].tobytes()
        docs = np.searchsorted(word_offs, maybe, "right") - 1
        for i, doc in zip(maybe.tolist(), docs.tolist(), strict=True):
            text = b" ".join(low[s:e] for s, e in zip(start[i : i + size], end[i : i + size], strict=True))
            if ids := windows[int(grams[i])].get(text):
                at.append(i)
                span.append(size)
                names[doc].update(ids)
    return np.stack([start, end]), word_offs, covered(len(start), np.array(at, np.int64), np.array(span, np.int64)), names


def _columns(b: pa.RecordBatch, spans: np.ndarray, word_offs: np.ndarray, hit: np.ndarray, names: dict[int, set]) -> list[pa.Array]:
    """The columns EXTRA for words hit and items found."""
    data, offs = text_parts(b.column("text"))
    raw = data.tobytes()
    rows = []
    for d in range(b.num_rows):
        x, y = int(word_offs[d]), int(word_offs[d + 1])
        mask = hit[x:y]
        text = _without(raw, int(offs[d]), int(offs[d + 1]), spans[0, x:y], spans[1, x:y], mask)
        rows.append((y - x, int(mask.sum()), np.packbits(mask).tobytes() if mask.any() else b"", sorted(names.get(d, ())), text))
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.string())
    return [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)]


def _without(raw: bytes, first: int, last: int, start: np.ndarray, end: np.ndarray, mask: np.ndarray) -> str:
    """The text without runs of hit words and what stands between them."""
    if not mask.any():
        return raw[first:last].decode()
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    out, at = [], first
    for a, z in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        out.append(raw[at : start[a]])
        at = int(end[z - 1])
    out.append(raw[at:last])
    return b"".join(out).decode()


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The items in blocks of at most `most` bytes of text (a longer item is a block), one block at a time on the driver."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").filter("text is not null").toLocalIterator():
        if block and size + len(row[1]) > most:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1].encode())
    if block:
        yield block


def find_hits(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, hits (a bit for each word), items (ids as strings, sorted) and kept_text (without hit runs)."""
    spark = tune(docs.sparkSession)
    docs = without(docs, *EXTRA.names)
    schema = T.StructType([*docs.schema.fields, *EXTRA.fields])
    own = len(docs.columns)
    parts = blocks(benchmark, block_bytes)
    block, more = next(parts, []), next(parts, None)
    if more is None:
        sent = spark.sparkContext.broadcast(build_index(block, words))

        def run(batches):
            for batch in trimmed(batches):
                for b in slices(batch):
                    yield pa.RecordBatch.from_arrays([*b.columns, *_columns(b, *_scan(b, sent.value))], names=schema.names)

        return docs.mapInArrow(run, schema)
    found = None
    for part in chain([block, more], parts):
        hits = _block_hits(docs, build_index(part, words))
        found = hits if found is None else found.unionByName(hits)
    one, two, lists = fresh(docs, "text_hash", "text_hash2", "block_hits")
    by_text = found.groupBy("h", "g").agg(F.collect_list(F.struct("hits", "items")).alias(lists)).withColumnsRenamed({"h": one, "g": two})
    h, g = _text_hashes()

    def merge(batches):
        for batch in trimmed(batches):
            for b in slices(batch):
                spans, word_offs, hit, names = _scan(b, {})
                for d, rows in enumerate(b.column(lists).to_pylist()):
                    for row in rows or ():
                        x, y = int(word_offs[d]), int(word_offs[d + 1])
                        hit[x:y] |= np.unpackbits(np.frombuffer(row["hits"], np.uint8), count=y - x).astype(bool)
                        names[d].update(row["items"])
                yield pa.RecordBatch.from_arrays([*b.columns[:own], *_columns(b, spans, word_offs, hit, names)], names=schema.names)

    met = docs.withColumns({one: h, two: g}).join(by_text, [one, two], "left")
    return met.select(*(F.col(f"`{c}`") for c in docs.columns), lists).mapInArrow(merge, schema)


def _text_hashes() -> tuple[Column, Column]:
    return F.xxhash64("text"), F.xxhash64(F.lit(1), "text")


def _block_hits(docs: DataFrame, index) -> DataFrame:
    """(h, g, hits, items) of the texts that one block hits, stored; the block is broadcast for this alone."""
    sent = docs.sparkSession.sparkContext.broadcast(index)
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()))

    def run(batches):
        for batch in trimmed(batches):
            for b in slices(batch):
                _, word_offs, hit, names = _scan(b, sent.value)
                h, g = b.column("h").to_pylist(), b.column("g").to_pylist()
                rows = [(h[d], g[d], np.packbits(hit[word_offs[d] : word_offs[d + 1]]).tobytes(), sorted(x)) for d, x in names.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["h", "g", "hits", "items"])

    h, g = _text_hashes()
    hits = docs.select("text", h.alias("h"), g.alias("g")).mapInArrow(run, "h long, g long, hits binary, items array<string>")
    out = stored(hits.dropDuplicates(["h", "g"]), "block-hits")
    sent.unpersist()
    return out
