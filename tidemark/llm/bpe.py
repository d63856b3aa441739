"""Byte-level BPE by recursive DuckDB queries inside Spark tasks.

A text is cut by the tokenizer's pattern into pieces. A task puts the pieces that it hasn't met yet into token-position rows (one
for each byte) that know their next token; the recursive query joins them to the merge table, contracts each piece's leftmost
pair of minimum rank, and repeats on the pieces that still have a pair. Ordered aggregation over token positions gives the
ids. Chunks (white space and what follows up to the next) and pieces stay with their ids in bounded dictionaries (`wordbook`),
so a piece costs a query once and not once for each place where it stands. Nothing is shuffled.

Decoding starts from ids alone: an id sequence is cut before the ids whose bytes begin with white space, the distinct runs
join the vocabulary, ordered aggregation over their positions gives their bytes, and a row's bytes are those of its runs in turn.

Pieces of more than LONG bytes contract by a heap with the same rule: a recursive query holds all rounds' rows, about n * n / 2 for
a piece of n bytes (half a million at LONG, 5 * 10^9 for 100 KB).

Null and empty texts have no tokens. Repeated rows give repeated results. An empty table gives no rows. Ids that the vocabulary
lacks raise an error.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrays import SPACE, mix, prefix_sums, range_hash, ranges, slices, text_parts
from .common import give_back, trimmed, tune, without
from .wordbook import Book, as_list, distinct_spans, ids_of_spans

LONG = 1000
#: Rows that one recursive query may make, and what DuckDB may hold in a worker.
QUERY_ROWS, QUERY_MEMORY = 1_500_000, "160MB"
#: Bytes of text that a worker looks at together.
SLICE = 2 << 20
#: The same of a lean worker, and what its dictionaries of chunks and pieces may hold: more queries, less memory.
LEAN_ROWS, LEAN_SLICE, LEAN_CHUNKS, LEAN_PIECES = 400_000, 1 << 20, 16 << 20, 12 << 20
EXTRA = T.StructType().add("n_tokens", "long").add("ids", "binary").add("decoded", "binary")

ENCODE = """
WITH RECURSIVE step AS (
  SELECT key, next, tok, next_tok, 0 AS round FROM token_rows
  UNION ALL
  SELECT s.key,
    CASE WHEN s.key = b.key THEN b.next ELSE s.next END,
    CASE WHEN s.key = b.key THEN b.rank ELSE s.tok END,
    CASE WHEN s.key = b.key THEN b.next_tok WHEN s.next = b.key THEN b.rank ELSE s.next_tok END,
    s.round + 1
  FROM step s JOIN (
    SELECT c.word, c.key, c.rank, c.dead, d.next, d.next_tok
    FROM (
      SELECT word, (word << 12) | ((best >> 12) & 4095) AS key, (word << 12) | (best & 4095) AS dead, best >> 24 AS rank
      FROM (
        SELECT s.key >> 12 AS word, min((m.rank << 24) | ((s.key & 4095) << 12) | (s.next & 4095)) AS best
        FROM step s JOIN merges m ON m.pair = (s.tok << 20) | s.next_tok
        GROUP BY s.key >> 12)) c
    JOIN step d ON d.key = c.dead) b ON b.word = s.key >> 12
  WHERE s.key <> b.dead)
SELECT word, list(tok ORDER BY key) AS ids
FROM step JOIN (SELECT key >> 12 AS word, max(round) AS round FROM step GROUP BY 1) last
  ON last.word = step.key >> 12 AND last.round = step.round
GROUP BY word ORDER BY word
"""
DECODE = "SELECT string_agg(chars, '' ORDER BY pos) FROM id_rows JOIN vocabulary USING (id)"
NO_TOKEN = (1 << 20) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pair and rank of every way to make a token of two tokens."""
    pairs, made = [], []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                pairs.append(a << 20 | b)
                made.append(rank)
    return np.array(pairs, np.int64), np.array(made, np.int64)


def chunk_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where chunks begin: at documents' first bytes and just before white space, where the pattern can't look back. Not inside
    a run that holds white space beyond ASCII (whose last bytes follow 0xC2, 0x9A, 0x80 or 0x81)."""
    if not len(data):
        return np.zeros(0, np.int64)
    blank = SPACE[data]
    first = blank.copy()
    first[1:] &= ~blank[:-1]
    at = np.flatnonzero(first)
    p, q = data[np.maximum(at - 1, 0)], data[np.maximum(at - 2, 0)]
    first[at[(p >= 0x80) & ((q == 0xC2) | (q == 0x9A) | (q == 0x80) | (q == 0x81))]] = False
    first[offs[:-1][np.diff(offs) > 0]] = True
    return np.flatnonzero(first)


class Codec:
    """What one Python worker keeps: a DuckDB connection with the merge table, and the chunks and pieces met so far."""

    def __init__(self, ranks: dict[bytes, int], merges: tuple[np.ndarray, np.ndarray], pattern: str, lean: bool = False):
        import duckdb
        import regex

        self.ranks = ranks
        # the pattern's white space is the White_Space property; this library's \\s is wider by a few control characters
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": QUERY_MEMORY, "temp_directory": ""})
        for setting in ("preserve_insertion_order = false", "allocator_flush_threshold = '1MB'", "allocator_bulk_deallocation_flush_threshold = '1MB'"):
            self.db.execute(f"SET {setting}")
        vocabulary = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "chars": [t.decode("latin-1") for t in ranks]})
        for name, table in (("merges", pa.table({"pair": merges[0], "rank": merges[1]})), ("vocabulary", vocabulary)):
            self.db.register("_t", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM _t")
            self.db.unregister("_t")
        top = max(ranks.values(), default=0) + 1
        self.sizes, self.opens = np.zeros(top, np.int64), np.zeros(top, bool)
        self.sizes[list(ranks.values())] = [len(t) for t in ranks]
        self.opens[[r for t, r in ranks.items() if SPACE[t[0]]]] = True
        self.single = np.array([ranks.get(bytes([i]), NO_TOKEN) for i in range(256)], np.int64)
        self.chunks, self.pieces = (Book(LEAN_CHUNKS), Book(LEAN_PIECES)) if lean else (Book(), Book(32 << 20))
        self.query_rows = LEAN_ROWS if lean else QUERY_ROWS

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of 1 to LONG bytes by the recursive query."""
        out: list[bytes] = []
        begin, rows = 0, 0
        for k, w in enumerate(words):
            rows += len(w) * len(w) // 2 + len(w)
            if rows >= self.query_rows or k + 1 == len(words):
                out += self._merge(words[begin : k + 1])
                begin, rows = k + 1, 0
        return out

    def _merge(self, words: list[bytes]) -> list[bytes]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        tok = self.single[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(sizes)
        key = (np.repeat(np.arange(len(words)), sizes) << 12) | (np.arange(len(tok)) - np.repeat(ends - sizes, sizes))
        next_tok = np.append(tok[1:], NO_TOKEN)
        next_tok[ends - 1] = NO_TOKEN
        self.db.register("token_rows", pa.table({"key": key, "next": key + 1, "tok": tok, "next_tok": next_tok}))
        lists = self.db.sql(ENCODE).to_arrow_table().column("ids").combine_chunks()
        self.db.unregister("token_rows")
        flat = lists.flatten().to_numpy().astype(np.uint32).tobytes()
        at = (lists.offsets.to_numpy() * 4).tolist()
        return [flat[i:j] for i, j in zip(at, at[1:], strict=False)]

    def merge_long(self, word: bytes) -> bytes:
        parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
        after = list(range(1, len(word) + 1))
        before = list(range(-1, len(word) - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (r := self.ranks.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[j]))

        for i in range(len(word) - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if parts[i] != a or (j := after[i]) >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([self.ranks[p] for p in parts if p is not None], np.uint32).tobytes()

    def learn_pieces(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pieces = as_list(raw, size)
        ids: list[bytes] = [b""] * len(pieces)
        todo = []
        for k, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:
                ids[k] = r.to_bytes(4, "little")
            elif len(p) > LONG:
                ids[k] = self.merge_long(p)
            else:
                todo.append(k)
        for k, x in zip(todo, self.merge([pieces[k] for k in todo]), strict=True):
            ids[k] = x
        return np.frombuffer(b"".join(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)) >> 2

    def learn_chunks(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = [self.pattern.findall(c.decode()) for c in as_list(raw, size)]
        found = [p.encode() for x in cut for p in x]
        size = np.fromiter(map(len, found), np.int64, len(found))
        data = np.frombuffer(b"".join(found), np.uint8)
        end = np.cumsum(size)
        ids, at, n, which = ids_of_spans(self.pieces, data, end - size, end, self.learn_pieces)
        own = n[which]
        pieces = np.fromiter(map(len, cut), np.int64, len(cut))
        return ids[ranges(at[which], own)], np.add.reduceat(own, np.cumsum(pieces) - pieces)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin; one more than texts)."""
        data, offs = text_parts(column)
        start = chunk_starts(data, offs)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        end = np.append(start[1:], len(data))
        ids, at, n, which = ids_of_spans(self.chunks, data, start, end, self.learn_chunks)
        own = n[which]
        total = np.append(0, np.cumsum(own))
        return ids[ranges(at[which], own)], total[np.searchsorted(start, offs)]

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all id sequences, where each one's begin) by ordered aggregation."""
        if not len(ids):
            return np.zeros(0, np.uint8), np.zeros(len(offs), np.int64)
        if int(ids.max()) >= len(self.sizes) or not self.sizes[ids].all():
            raise ValueError("ids that the vocabulary lacks")
        cut = self.opens[ids]
        cut[offs[:-1][np.diff(offs) > 0]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(ids))
        sums = prefix_sums(mix(ids.astype(np.uint64) + np.uint64(1)))
        first, which = distinct_spans(ids.astype("<u4").view(np.uint8), start * 4, end * 4, range_hash(sums, start, end))
        n = (end - start)[first]
        wanted = ids[ranges(start[first], n)]
        self.db.register("id_rows", pa.table({"pos": np.arange(len(wanted), dtype=np.int32), "id": wanted.astype(np.int32)}))
        raw = self.db.sql(DECODE).fetchall()[0][0].encode("latin-1")
        self.db.unregister("id_rows")
        size = np.add.reduceat(self.sizes[wanted], np.cumsum(n) - n)
        cuts = np.append(0, np.cumsum(size)).tolist()
        runs = [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        total = np.append(0, np.cumsum(size[which]))
        return np.frombuffer(b"".join(map(runs.__getitem__, which.tolist())), np.uint8), total[np.searchsorted(start, offs)]


_CODECS: dict[str, Codec] = {}


def codec(sent, name: str, lean: bool = False) -> Codec:
    """The worker's codec for a broadcast rank table; a worker keeps one from task to task."""
    name += " lean" if lean else ""
    if name not in _CODECS:
        _CODECS.clear()
        _CODECS[name] = Codec(*sent.value, lean)
    return _CODECS[name]


def _send(docs: DataFrame, ranks_path: str, pattern: str):
    ranks = read_ranks(ranks_path)
    name = hashlib.sha256(repr((len(ranks), hash(frozenset(ranks.items())), pattern)).encode()).hexdigest()
    return docs.sparkSession.sparkContext.broadcast((ranks, merge_table(ranks), pattern)), name  # a fixed vocabulary file


def _binary(flat: np.ndarray, offs: np.ndarray) -> pa.Array:
    raw, at = flat.tobytes(), (offs * flat.itemsize).tolist()
    return pa.array([raw[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary())


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep_text: bool = True, lean: bool = False) -> DataFrame:
    """docs with n_tokens, ids (little-endian uint32) and decoded (the bytes that these ids decode to). lean: workers hold less and take longer, for
    jobs that share their executors with more."""
    tune(docs.sparkSession)
    docs = without(docs, *EXTRA.names)
    sent, name = _send(docs, ranks_path, pattern)
    stay = [c for c in docs.columns if keep_text or c != "text"]
    schema = T.StructType([*(f for f in docs.schema.fields if f.name in stay), *EXTRA.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(sent, name, lean)
        for batch in trimmed(batches):
            for b in slices(batch, most=LEAN_SLICE if lean else SLICE):
                ids, offs = own.encode(b.column("text"))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in stay), pa.array(np.diff(offs)), _binary(ids, offs), _binary(*own.decode(ids, offs))], names=schema.names)
                if lean:
                    give_back()

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, ranks_path: str, pattern: str, column: str = "ids") -> DataFrame:
    """tokens with `decoded`: the bytes of each row's ids (little-endian uint32); null and empty give no bytes."""
    tune(tokens.sparkSession)
    tokens = without(tokens, "decoded")
    sent, name = _send(tokens, ranks_path, pattern)
    schema = T.StructType([*tokens.schema.fields, *T.StructType().add("decoded", "binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(sent, name)
        for batch in trimmed(batches):
            for b in slices(batch, column, SLICE):
                data, offs = text_parts(b.column(column))
                yield pa.RecordBatch.from_arrays([*b.columns, _binary(*own.decode(np.frombuffer(data.tobytes(), "<u4"), offs // 4))], names=schema.names)

    return tokens.mapInArrow(run, schema)
