"""Centroids and nearest items by embedding."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .items import ago
from .store import settled

#: Cells of the index of vectors at most (each pivot is broadcast: 8 MB of 64 numbers), and cells that an item asks by default.
MOST_CELLS = 1 << 15
MOST_PROBES = 64
#: Clusters whose sums a task holds at once.
HELD_CLUSTERS = 20_000
#: Vectors that meet all pivots at once in a task.
CELL_ROWS = 512
#: Vectors in a block of items and of candidates (of 64 numbers: 1 and 8 MB), blocks of candidates that a task meets, and the sides of one matrix product.
ITEM_ROWS, CANDIDATE_ROWS, TASK_BLOCKS = 2048, 16_384, 4
HELD_ITEMS, HELD_CANDIDATES = 512, 4096
#: Texts that are embedded at once in a task.
EMBED_ROWS = 2000


def _unit(v: Column) -> Column:
    return F.transform(v, lambda x: x / F.sqrt(X.dot(v, v)))


def centroids(members: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(event_cluster_id, members, centroid): the normalised mean of the members' vectors. Tasks add up the vectors of each cluster they
    meet; only those sums are shuffled."""
    kind = members.schema["event_cluster_id"].dataType.simpleString()
    rows = members.join(embeddings, members["content_item_id"] == embeddings["content_id"]).filter("embedding is not null").select("event_cluster_id", F.col("embedding").cast("array<double>").alias("v"))

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def out() -> pd.DataFrame:
            found = pd.DataFrame({"event_cluster_id": list(held), "n": [n for n, _ in held.values()], "v": [v for _, v in held.values()]})
            held.clear()
            return found

        for frame in frames:
            for cluster, part in frame.groupby("event_cluster_id", dropna=False)["v"]:
                total = np.sum(part.tolist(), axis=0)
                n, v = held.get(cluster, (0, 0.0))
                held[cluster] = (n + len(part), v + total)
            if len(held) > HELD_CLUSTERS:
                yield out()
        if held:
            yield out()

    part = rows.mapInPandas(sums, f"event_cluster_id {kind}, n long, v array<double>")
    # few rows a cluster now: added up place by place
    flat = part.select("event_cluster_id", "n", F.posexplode("v").alias("pos", "x")).groupBy("event_cluster_id", "pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    whole = flat.groupBy("event_cluster_id").agg(F.max("n").alias("members"), F.transform(F.array_sort(F.collect_list(F.struct("pos", (F.col("x") / F.col("n")).alias("m")))), lambda s: s["m"]).alias("v"))
    return whole.select("event_cluster_id", "members", _unit(F.col("v")).alias("centroid"))


def update_centroids(now: DataFrame, added: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Centroids after new members: weighted by the members on both sides and normalised."""
    new = centroids(added, embeddings).select("event_cluster_id", F.col("members").alias("k"), F.col("centroid").alias("c"))
    both = now.join(new, "event_cluster_id", "full")
    mixed = F.zip_with(F.col("centroid"), F.col("c"), lambda a, b: a * F.col("members") + b * F.col("k"))
    out = F.when(F.col("c").isNull(), F.col("centroid")).when(F.col("centroid").isNull(), F.col("c")).otherwise(mixed)
    total = F.coalesce("members", F.lit(0)) + F.coalesce("k", F.lit(0))
    # not named members at once: inside the lambda above that would be this sum
    return both.select("event_cluster_id", total.alias("total"), out.alias("v")).select("event_cluster_id", F.col("total").alias("members"), _unit(F.col("v")).alias("centroid"))


def _pivots(vectors: DataFrame, n: int) -> np.ndarray:
    """n vectors picked by the hash of their content, as unit rows."""
    rows = vectors.select("v", F.xxhash64("v").alias("_h")).distinct().orderBy("_h").limit(n).select("v").toPandas()
    if rows.empty:
        return np.zeros((0, 0))
    m = np.array(rows["v"].tolist(), np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)


def _cells(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(v_id, cell): the nearest pivot of each vector. The pivots go to all tasks: at most MOST_CELLS of them."""
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), CELL_ROWS):
                part = frame.iloc[at : at + CELL_ROWS]
                v = np.array(part["v"].tolist(), np.float64)
                yield pd.DataFrame({"v_id": part["v_id"].to_numpy(), "cell": _angles(v, sent.value).argmin(axis=1).astype(np.int32)})

    return vectors.select("v_id", "v").mapInPandas(run, "v_id long, cell int")


def _angles(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
    return np.arccos(np.clip(unit @ pivots.T, -1, 1))


def index_size(rows: int, probes: int | None = None) -> tuple[int, int]:
    """(cells, probes) of an index over so many rows: their square root, and half of the cells (12 at least, MOST_PROBES at most), from where on the pairs
    met grow as the power 1.5."""
    cells = max(1, min(MOST_CELLS, math.isqrt(max(rows, 1))))
    return cells, min(cells, probes or min(MOST_PROBES, max(12, cells // 2)))


def _packed(columns: list[str], rows: int):
    """Task: numbers and vectors of a partition as rows of bytes, `rows` vectors each: (n, and each column's values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            if len(pc.unique(pc.list_value_length(t["v"]))) > 1:
                raise ValueError("vectors differ in their number of components")
            values = [np.ascontiguousarray(pc.list_flatten(t[c]) if c == "v" else t[c].fill_null(-1)).tobytes() for c in columns]
            return pa.RecordBatch.from_arrays([pa.array([t.num_rows], pa.int32()), *(pa.array([x], pa.binary()) for x in values)], ["n", *columns])

        for batch in batches:
            while batch.num_rows:
                room = rows - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == rows:
                    yield out()
        if held:
            yield out()

    return run


def _best_two(threshold: float, scale: float, sent, probes: int | None):
    """Task: blocks of items against blocks of candidates to (v_id, score, match): of each item the two best (score, least id) that reach the
    threshold, score by score as `sim01` adds them up. Matrix products find what can be among them, give or take their rounding. With
    pivots sent, an item meets only candidates whose cell is among its `probes` nearest."""
    slack, least = 1e-9 * scale, 2 * threshold - 1 if threshold > 0 else -math.inf

    def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.zeros(len(a))
        for j in range(a.shape[1]):
            total += a[:, j] * b[:, j]
        return np.maximum(0.0, (total + 1) / 2)

    def met(q: np.ndarray, c: np.ndarray, clean: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of what may be among the two best candidates of a row, here at least."""
        s = q @ c.T
        if not clean:
            s = np.where(np.isnan(s), -np.inf, s)
        best = s.argmax(axis=1)
        own = s[np.arange(len(s)), best]
        rows = np.flatnonzero(own >= least - slack)
        s, best, own = s[rows], best[rows], own[rows]
        s[np.arange(len(s)), best] = -np.inf
        second = np.maximum(s.max(axis=1, initial=-np.inf), least) - slack
        i, j = np.nonzero(s >= second[:, None])
        return np.concatenate([rows, rows[i]]), np.concatenate([best, j])

    def near(q: np.ndarray) -> np.ndarray:
        angle = _angles(q, sent.value)
        asks = np.zeros(angle.shape, bool)
        np.put_along_axis(asks, np.argsort(angle, axis=1, kind="stable")[:, :probes], True, axis=1)
        return asks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, asks = None, None
        for b in batches:
            names = [n for n in b.schema.names if n not in ("n", "m")]
            for k in range(b.num_rows):
                part = {n: b.column(n)[k].as_buffer() for n in names}
                n, m = b.column("n")[k].as_py(), b.column("m")[k].as_py()
                ids, q = np.frombuffer(part["v_id"], np.int64), np.frombuffer(part["v"], np.float64).reshape(n, -1)
                c = np.frombuffer(part["b"], np.float64).reshape(m, -1)
                clean = bool(np.isfinite(q).all() and np.isfinite(c).all())
                first, second = np.frombuffer(part["first"], np.int64), np.frombuffer(part["second"], np.int64)
                if sent is None:
                    spans = [(None, slice(i, i + HELD_CANDIDATES)) for i in range(0, m, HELD_CANDIDATES)]
                else:
                    cell = np.frombuffer(part["cell"], np.int32)
                    cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), m]
                    spans = [(cell[x], slice(x, y)) for x, y in zip(cuts, cuts[1:], strict=False)]
                    if last != (n, ids[0]):
                        last, asks = (n, ids[0]), near(q)
                found = []
                for which, at in spans:
                    rows = np.arange(n) if which is None else np.flatnonzero(asks[:, which])
                    for i in range(0, len(rows), HELD_ITEMS):
                        some = rows[i : i + HELD_ITEMS]
                        x, y = met(q[some], c[at], clean)
                        found.append((some[x], y + at.start))
                row, col = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))
                score = exact(q[row], c[col])
                fits = score >= threshold
                row, col, score = row[fits], col[fits], score[fits]
                row, score, match = np.concatenate([row, row]), np.concatenate([score, score]), np.concatenate([first[col], second[col]])
                there = match >= 0
                row, score, match = row[there], score[there], match[there]
                order = np.lexsort((match, -score, row))
                row, score, match = row[order], score[order], match[order]
                # the first two of each row
                keep = np.ones(len(row), bool)
                keep[2:] = row[2:] != row[:-2]
                yield pa.RecordBatch.from_arrays([pa.array(ids[row[keep]]), pa.array(score[keep]), pa.array(match[keep])], ["v_id", "score", "match"])

    return run


def _nearest(items: DataFrame, embeddings: DataFrame, as_of: str, threshold: float, days: float, approximate: bool, probes: int | None = None) -> DataFrame:
    """(id, match, score). All items meet all candidates in blocks of fixed size, each a matrix product in a task; or, approximately, those in the cells of
    their nearest pivots."""
    vec = embeddings.join(items.select(F.col("id").alias("content_id"), "processed", "published_at"), "content_id").filter("embedding is not null")
    vec = settled(vec.select("content_id", F.col("embedding").cast("array<double>").alias("v"), (F.col("processed") & (F.col("published_at") >= ago(as_of, days))).alias("_ready")), "vectors")
    # equal vectors are one row of the index: (v_id, v, first, second), the last two the smallest ids of its candidates
    ready = F.when(F.col("_ready"), F.col("content_id"))
    whole = vec.groupBy("v").agg(F.min("content_id").cast("long").alias("v_id"), F.min(ready).cast("long").alias("first"))
    later = vec.filter("_ready").join(whole.select(F.col("v").alias("w"), "first"), F.col("v") == F.col("w")).filter(F.col("content_id") > F.col("first"))
    distinct = settled(whole.join(later.groupBy("v").agg(F.min("content_id").cast("long").alias("second")), "v", "left").select("v_id", "v", "first", "second"), "different-vectors")
    candidates = distinct.filter("first is not null")
    length = X.dot(F.col("v"), F.col("v"))
    length = F.when(~F.isnan(length) & (length < math.inf), length)
    known = distinct.agg(F.count(F.lit(1)).alias("all"), F.count("first").alias("candidates"), F.max(length).alias("most"), F.max(F.when(F.col("first").isNotNull(), length)).alias("top")).first()
    if not known["candidates"]:
        return vec.limit(0).select(F.col("content_id").alias("id"), F.col("content_id").alias("match"), F.lit(0.0).alias("score"))
    sent, columns = None, ["v", "first", "second"]
    if approximate:
        cells, probes = index_size(known["candidates"], probes)
        pivots = _pivots(candidates, cells)
        candidates = candidates.join(_cells(candidates, pivots), "v_id")
        sent = vec.sparkSession.sparkContext.broadcast(pivots)
        columns = [*columns, "cell"]
    tasks = math.ceil(known["candidates"] / (TASK_BLOCKS * CANDIDATE_ROWS))
    laid = candidates.select(*columns).repartition(tasks)
    laid = laid.sortWithinPartitions("cell") if approximate else laid
    b = settled(laid.mapInArrow(_packed(columns, CANDIDATE_ROWS), "n int, " + ", ".join(f"{c} binary" for c in columns)), "candidate-blocks")
    b = b.withColumnsRenamed({"n": "m", "v": "b"})
    asked = distinct.select("v_id", "v").repartition(math.ceil(known["all"] / (2 * ITEM_ROWS)))
    asked = asked.mapInArrow(_packed(["v_id", "v"], ITEM_ROWS), "n int, v_id binary, v binary")
    # a partition of blocks is what a task of the packing wrote: TASK_BLOCKS of them at most
    met = asked.crossJoin(b.repartition(tasks) if tasks > 1 else b)
    scale = math.sqrt(known["most"] * known["top"]) if known["most"] and known["top"] else 1.0
    found = met.mapInArrow(_best_two(threshold, scale, sent, probes), "v_id long, score double, match long")
    # the two best (score, least id) suffice: only one of them can be the item itself
    order = Window.partitionBy("v_id").orderBy(F.desc("score"), "match")
    best = found.withColumn("_n", F.row_number().over(order)).filter("_n <= 2").groupBy("v_id").agg(F.sort_array(F.collect_list(F.struct("_n", "score", "match"))).alias("best"))
    own = vec.join(distinct.select("v", "v_id"), "v").select(F.col("content_id").alias("id"), "v_id")
    other = F.get(F.filter("best", lambda x: x["match"] != F.col("id")), F.lit(0))
    return own.join(best, "v_id").select("id", other.alias("o")).filter("o is not null").select("id", F.col("o.match").alias("match"), F.col("o.score").alias("score"))


def nearest_processed(items: DataFrame, embeddings: DataFrame, as_of: str, threshold: float = 0.85, days: float = 7) -> DataFrame:
    """(id, match, score): each embedded item's nearest other processed item of the last days, if its similarity (from 0 to 1)
    reaches the threshold. Exact: every item meets every candidate once, so the work is the product of both, as matrix products of blocks
    that bound a task's memory."""
    return _nearest(items, embeddings, as_of, threshold, days, False)


def nearest_approximate(items: DataFrame, embeddings: DataFrame, as_of: str, threshold: float = 0.85, days: float = 7, probes: int | None = None) -> DataFrame:
    """The same over an index of about as many cells as the square root of the candidates: an item meets those of its `probes` nearest
    pivots and is scored there exactly. More probes find more, and all cells find everything."""
    return _nearest(items, embeddings, as_of, threshold, days, True, probes)


def _hashed(dimensions: int):
    """Task: (id, words) to (id, sums), the sums of the signs of words and word pairs by place. Each different word and pair of a batch is hashed once."""

    def places(grams: list[str]) -> tuple[np.ndarray, np.ndarray]:
        d = np.frombuffer(b"".join([hashlib.md5(g.encode()).digest() for g in grams]), np.uint8).reshape(-1, 16)
        return d[:, :4].copy().view(">u4")[:, 0].astype(np.int64) % dimensions, np.where(d[:, 4] < 128, 1.0, -1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, EMBED_ROWS):
                b = whole.slice(at, EMBED_ROWS)
                lists = b.column("words")
                row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                coded = lists.flatten().dictionary_encode()
                words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
                k, sign = places(words)
                sums = np.bincount(row * dimensions + k[code], weights=sign[code], minlength=b.num_rows * dimensions)
                both = np.flatnonzero(row[1:] == row[:-1])
                pairs, place = np.unique(code[both] * len(words) + code[both + 1], return_inverse=True)
                k, sign = places([f"{words[x // len(words)]} {words[x % len(words)]}" for x in pairs.tolist()])
                sums += np.bincount(row[both] * dimensions + k[place], weights=sign[place], minlength=len(sums))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * dimensions), pa.array(sums.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("id"), lists], ["id", "sums"])

    return run


def embed(items: DataFrame, encoder=None, dimensions: int = 256) -> DataFrame:
    """(content_id, embedding) of title and content (500 characters). encoder maps an iterator of pandas frames (id, text)
    to frames (content_id, embedding); without one, hashed words and word pairs, normalised. Each text is hashed where it lies; only rows
    that share an id are moved, to be added up. Items without words have no row."""
    rows = items.select("id", F.substring(F.concat_ws(" ", "title", "content"), 1, 500).alias("text"))
    if encoder is not None:
        return rows.mapInPandas(encoder, "content_id long, embedding array<float>")
    kind = items.schema["id"].dataType.simpleString()
    words = rows.select("id", F.array_remove(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), "").alias("words")).filter(F.size("words") > 0)
    sums = words.mapInArrow(_hashed(dimensions), f"id {kind}, sums array<int>")
    repeated = settled(items.groupBy("id").count().filter("count > 1").select(F.col("id").alias("_id")), "repeated-ids")
    if not repeated.isEmpty():
        same = F.col("id").eqNullSafe(F.col("_id"))
        flat = sums.join(repeated, same, "left_semi").select("id", F.posexplode("sums").alias("k", "s")).groupBy("id", "k").agg(F.sum("s").cast("int").alias("s"))
        added = flat.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]).alias("sums"))
        sums = sums.join(repeated, same, "left_anti").unionByName(added)
    return sums.mapInArrow(_normalised, f"content_id {kind}, embedding array<float>")


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: (id, sums) to (content_id, embedding)."""
    for b in batches:
        if not b.num_rows:
            continue
        m = b.column("sums").flatten().to_numpy().reshape(b.num_rows, -1).astype(np.float64)
        n = np.sqrt((m * m).sum(axis=1, keepdims=True))
        unit = np.divide(m, n, out=np.zeros_like(m), where=n > 0).astype(np.float32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(unit.reshape(-1)))
        yield pa.RecordBatch.from_arrays([b.column("id"), lists], ["content_id", "embedding"])


def enrich(items: DataFrame, call, schema: str) -> DataFrame:
    """Rows through a user's function over batches (an iterator of pandas frames), such as a model call."""
    return items.mapInPandas(call, schema)
