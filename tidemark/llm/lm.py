"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

Tokens are lower-cased words and one end for each text. P(word | history) = P(class | history) P(word | class). Classes: the
commonest words one by one, the end, and groups of all other words by their first two bytes. P(class | history) is a
softmax over hashed features of the history: the word before, skips to the second and third word before, and the pair of words
before. Inside a group P(word | class, history) goes down DEPTH more choices of WAYS branches, each a softmax over the same features
together with the node of the tree where the choice is made, to one of GROUPS * WAYS ** DEPTH leaves (a word's leaf follows from
its hash). P(word | leaf) is (count + 1) over the leaf's sum of that, where all words of a leaf never seen in training share one place.

Everything is gathered from all training documents: counts of all words by shuffle on the word's hash (a batch sends each word once), and
the features' gradients, summed by each task and then by blocks of rows. The first update starts from the class shares alone, so
its expectations follow from the features' counts; each further update is a pass that adds up the model's expectations. The inner
choices are scaled once, from what their branches' shares let expect: that follows from counts by node and feature row.
Words are counted whole; the HEAD commonest travel to the scoring tasks by broadcast (a bounded table), all others meet
their counts by shuffle, so a hot word never gathers in one task and a rare one is never dropped.

Null and empty texts are the end alone. Rows that repeat a doc_id are scored alike by their texts. With no training documents all
counts are 0. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, SPACE, mix, slices, span_hash, text_parts, word_spans
from .common import partitions, stored, trimmed, tune
from .ids import as_long

SINGLES, GROUPS = 15, 16
CLASSES = SINGLES + 1 + GROUPS
ROWS, TEMPLATES = 8192, 4
HEAD = 200_000
#: Branches and choices inside a group, and the leaves of all groups.
WAYS, DEPTH = 32, 2
LEAVES = GROUPS * WAYS**DEPTH
#: Feature rows of each level of choices. They lie in runs, one for each node or for every 64th, so that counts by node and place in the run are few.
INNER_ROWS = 8192
NODES = [GROUPS * WAYS**k for k in range(DEPTH)]
RUNS = [min(n, 64) for n in NODES]
WIDTHS = [INNER_ROWS // n for n in RUNS]
PASSES, RATE, SHARE, SMOOTH = 1, 0.5, 0.3, 60.0
#: The same for the inner choices: a step's share of the log ratio, and what smooths it.
INNER_SHARE, INNER_SMOOTH = 0.4, 2.0
LIMIT = 18.0
END, START = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
BLOCKS = 32
#: Tokens whose probabilities a task holds at once, in training and in scoring.
CHUNK, CHUNK_SCORED = 40_000, 4_000


@dataclass
class Tokens:
    hashes: np.ndarray
    groups: np.ndarray
    offs: np.ndarray

    def histories(self) -> list[np.ndarray]:
        """Hashes of each template at each token."""
        first = np.repeat(self.offs[:-1], np.diff(self.offs))
        at = np.arange(len(self.hashes)) - first
        before = []
        for k in (1, 2, 3):
            p = np.full(len(self.hashes), START)
            p[k:] = self.hashes[:-k] if k < len(self.hashes) else p[k:]
            p[at < k] = START
            before.append(p)
        with np.errstate(over="ignore"):
            pair = mix(before[0] * np.uint64(0x9E3779B97F4A7C15) + before[1])
        with np.errstate(over="ignore"):
            return [mix(x + np.uint64(k)) for k, x in enumerate((*before, pair))]

    def features(self, histories: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """Feature rows of each template at each token."""
        return [(x % np.uint64(ROWS)).astype(np.int32) for x in histories or self.histories()]


def tokens(column: pa.Array) -> Tokens:
    data, offs = text_parts(column)
    start, end, word_offs = word_spans(data, offs, ~SPACE)
    h = span_hash(data, start, end, True)
    low = LOWER[data]
    second = np.where(end - start > 1, low[np.minimum(start + 1, max(len(low) - 1, 0))] if len(low) else 0, 0).astype(np.uint64)
    g = mix((low[start].astype(np.uint64) << np.uint64(8)) | second) % np.uint64(GROUPS)
    docs = len(offs) - 1
    out_offs = word_offs + np.arange(docs + 1)
    hashes = np.full(len(h) + docs, END)
    groups = np.zeros(len(hashes), np.uint8)
    at = np.arange(len(h)) + np.repeat(np.arange(docs), np.diff(word_offs))
    hashes[at], groups[at] = h, g
    return Tokens(hashes, groups, out_offs)


def leaf_of(hashes: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """The leaf of each word of a group: the group's own leaves by the word's hash."""
    return groups.astype(np.int64) * WAYS**DEPTH + (mix(hashes) >> np.uint64(40)).astype(np.int64) % WAYS**DEPTH


def choices(leaf: np.ndarray, histories: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(level, node, branch, place of each template's feature row in the node's run) of each choice on the way to the leaves."""
    for level in range(DEPTH):
        below = WAYS ** (DEPTH - level)
        node = leaf // below
        own = mix(node.astype(np.uint64) + np.uint64((level + 1) << 32))
        with np.errstate(over="ignore"):
            places = [(((x ^ own) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % WIDTHS[level] for x in histories]
        yield level, node, leaf // (below // WAYS) % WAYS, places


def inner_rows(level: int, node: np.ndarray, places: list[np.ndarray]) -> list[np.ndarray]:
    run = node % RUNS[level] * WIDTHS[level]
    return [run + x for x in places]


@dataclass
class Counts:
    """What the driver keeps of the counts: totals, the classes' sums and bounded tables of common words."""

    total: int
    distinct: int
    ends: int
    singles: np.ndarray
    single_counts: np.ndarray
    sums: np.ndarray
    head: np.ndarray
    head_counts: np.ndarray
    leaves: np.ndarray

    def log_shares(self) -> list[np.ndarray]:
        """Of each level: the log share of each branch in the counts at each node (nodes by branches)."""
        out = []
        for level in range(DEPTH):
            x = self.leaves.reshape(GROUPS * WAYS**level, WAYS, -1).sum(axis=2)
            out.append(np.log(x / x.sum(axis=1, keepdims=True)).astype(np.float32))
        return out

    def classes(self, t: Tokens) -> np.ndarray:
        out = t.groups.astype(np.int32) + SINGLES + 1
        if len(self.singles):
            place = np.minimum(np.searchsorted(self.singles, t.hashes), len(self.singles) - 1)
            hit = self.singles[place] == t.hashes
            out[hit] = place[hit]
        out[t.hashes == END] = SINGLES
        return out


_POST = "bucket int, hashes binary, counts binary, groups binary"
_COUNTED = "bucket int, hashes binary, counts binary, total long, distinct long, sums binary, leaves binary, head binary, head_counts binary, head_groups binary, tops binary, top_counts binary, top_groups binary"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}


def _batch(columns: list, names: str) -> pa.RecordBatch:
    parts = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, parts, strict=True)], names=[x for x, _ in parts])


def _rows(rows: list, names: str) -> pa.RecordBatch:
    return _batch([*zip(*rows, strict=True)], names)


def _count_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            for b in slices(batch, most=16 << 20):
                t = tokens(b.column("text"))
                h, first, n = np.unique(t.hashes, return_index=True, return_counts=True)
                g = t.groups[first]
                where = (h % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                cuts = np.searchsorted(where[order], np.arange(buckets + 1))
                rows = []
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    at = order[cuts[k] : cuts[k + 1]]
                    rows.append((k, h[at].tobytes(), n[at].astype(np.uint32).tobytes(), g[at].tobytes()))
                if rows:
                    yield _rows(rows, _POST)

    return run


def _sum_words(head: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            h, n, g = (np.concatenate([np.frombuffer(x[k], kind) for x in held]) for k, kind in ((0, np.uint64), (1, np.uint32), (2, np.uint8)))
            words, first, back = np.unique(h, return_index=True, return_inverse=True)
            counts = np.bincount(back, weights=n).astype(np.int64)
            groups = g[first]
            own = words != END
            sums = np.bincount(groups[own], weights=counts[own] + 1.0, minlength=GROUPS)
            leaves = np.bincount(leaf_of(words[own], groups[own]), weights=counts[own] + 1.0, minlength=LEAVES)
            by_count = np.argsort(-counts, kind="stable")
            big, top = by_count[:head], by_count[: SINGLES + 1]
            yield _rows([(bucket, words.tobytes(), counts.tobytes(), int(counts.sum()), len(words), sums.tobytes(), leaves.tobytes(), words[big].tobytes(), counts[big].tobytes(), groups[big].tobytes(), words[top].tobytes(), counts[top].tobytes(), groups[top].tobytes())], _COUNTED)

        for b in trimmed(batches):
            for k, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != bucket:
                    yield from close()
                    bucket, held = k, []
                held.append(rest)
        yield from close()

    return run


def count_words(train: DataFrame) -> tuple[DataFrame, Counts]:
    """All words' counts by bucket, and the bounded part of them."""
    buckets = partitions(train.sparkSession)
    posts = train.select("text").mapInArrow(_count_words(buckets), _POST)
    table = stored(posts.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_sum_words(-(-HEAD // buckets)), _COUNTED), "word-counts")
    rows = table.drop("bucket", "hashes", "counts").collect()  # HEAD + buckets * SINGLES words at most
    cat = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in rows]) if rows else np.zeros(0, kind)
    top, n, g = cat("tops", np.uint64), cat("top_counts", np.int64), cat("top_groups", np.uint8)
    ends = int(n[top == END].sum())
    top, n, g = top[top != END], n[top != END], g[top != END]
    best = np.lexsort((top, -n))[:SINGLES]
    best = best[np.argsort(top[best])]
    sums = sum((np.frombuffer(r["sums"], np.float64) for r in rows), np.zeros(GROUPS)) + 1
    np.subtract.at(sums, g[best], n[best] + 1.0)
    leaves = sum((np.frombuffer(r["leaves"], np.float64) for r in rows), np.zeros(LEAVES)) + 1
    np.subtract.at(leaves, leaf_of(top[best], g[best]), n[best] + 1.0)
    head, head_n = cat("head", np.uint64), cat("head_counts", np.int64)
    order = np.argsort(head)
    return table, Counts(sum(r["total"] for r in rows), sum(r["distinct"] for r in rows), ends, top[best], n[best], sums, head[order], head_n[order], leaves)


def _emit_sums(*sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i, x in enumerate(sums):
        flat = x.reshape(BLOCKS, -1).astype(np.float32)
        yield _rows([(i * BLOCKS + k, flat[k].tobytes()) for k in range(BLOCKS)], "block int, sums binary")


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: rows in order of block; one sum for each block out."""
    block, total = None, None
    for b in trimmed(batches):
        for k, x in zip(b.column("block").to_pylist(), b.column("sums").to_pylist(), strict=True):
            x = np.frombuffer(x, np.float32).astype(np.float64)
            if k != block:
                if block is not None:
                    yield _rows([(block, total.tobytes())], "block int, sums binary")
                block, total = k, x.copy()
            else:
                total += x
    if block is not None:
        yield _rows([(block, total.tobytes())], "block int, sums binary")


def _reduce(parts: DataFrame, *shapes: tuple[int, ...]) -> list[np.ndarray]:
    """Sums over all tasks; BLOCKS rows of fixed size for each of the shapes reach the driver."""
    laid = parts.repartition(BLOCKS, "block").sortWithinPartitions("block")
    out = [np.zeros((BLOCKS, int(np.prod(shape)) // BLOCKS)) for shape in shapes]
    for k, x in laid.mapInArrow(_add_blocks, "block int, sums binary").collect():
        out[k // BLOCKS][k % BLOCKS] = np.frombuffer(x, np.float64)
    return [x.reshape(shape) for x, shape in zip(out, shapes, strict=True)]


def _observe(counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((TEMPLATES, CLASSES * ROWS))
        inner = [np.zeros((TEMPLATES, WAYS * INNER_ROWS)) for _ in NODES]
        met = [np.zeros((TEMPLATES, n * w)) for n, w in zip(NODES, WIDTHS, strict=True)]
        for batch in trimmed(batches):
            for b in slices(batch):
                t = tokens(b.column("text"))
                past = t.histories()
                cls = counts.value.classes(t)
                for k, f in enumerate(t.features(past)):
                    seen[k] += np.bincount(cls * ROWS + f, minlength=CLASSES * ROWS)
                deep = np.flatnonzero(cls > SINGLES)
                for level, node, branch, places in choices(leaf_of(t.hashes[deep], t.groups[deep]), [x[deep] for x in past]):
                    for k, f in enumerate(inner_rows(level, node, places)):
                        inner[level][k] += np.bincount(branch * INNER_ROWS + f, minlength=WAYS * INNER_ROWS)
                        met[level][k] += np.bincount(node * WIDTHS[level] + places[k], minlength=NODES[level] * WIDTHS[level])
        yield from _emit_sums(seen, *inner, *met)

    return run


def _softmax(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray], at: slice) -> np.ndarray:
    """Log probabilities of the classes at some tokens. weights: templates by classes by rows."""
    x = np.repeat(bias[:, None], len(rows[0][at]), axis=1)
    for k in range(TEMPLATES):
        x += np.take(weights[k], rows[k][at], axis=1)
    x -= x.max(axis=0)
    x -= np.log(np.exp(x).sum(axis=0))
    return x.T


def by_row(weights: np.ndarray) -> np.ndarray:
    """The weights as _chosen takes them."""
    return np.ascontiguousarray(weights.swapaxes(1, 2))


def _chosen(start: np.ndarray, at: np.ndarray | None, weights: np.ndarray, rows: list[np.ndarray], which: np.ndarray) -> np.ndarray:
    """Log probability of the class `which` at each token; start: logits before the features, for all tokens or by `at`. Weights (templates
    by rows by classes) are within LIMIT, so that no exponential leaves the range of a float."""
    out = np.empty(len(which))
    classes = weights.shape[2]
    space, one = np.empty((2, CHUNK_SCORED, classes), np.float32), np.ones(classes, np.float32)
    for i in range(0, len(which), CHUNK_SCORED):
        cut = slice(i, i + CHUNK_SCORED)
        n = len(which[cut])
        x, y = space[0, :n], space[1, :n]
        if at is None:
            x[:] = start
        else:
            np.take(start, at[cut], axis=0, out=x, mode="clip")
        for k in range(TEMPLATES):
            x += np.take(weights[k], rows[k][cut], axis=0, out=y, mode="clip")
        out[cut] = x[np.arange(n), which[cut]] - np.log(np.exp(x, out=y) @ one)
    return out


def _expect(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        out = np.zeros((TEMPLATES, CLASSES, ROWS))
        for batch in trimmed(batches):
            for b in slices(batch):
                t = tokens(b.column("text"))
                rows = t.features()
                for i in range(0, len(t.hashes), CHUNK):
                    at = slice(i, i + CHUNK)
                    p = np.exp(_softmax(weights, bias, rows, at).T)
                    for k in range(TEMPLATES):
                        f = rows[k][at].astype(np.int64)
                        for c in range(CLASSES):
                            out[k, c] += np.bincount(f, weights=p[c], minlength=ROWS)
        yield from _emit_sums(out)

    return run


@dataclass
class Model:
    counts: Counts
    table: DataFrame
    weights: np.ndarray
    bias: np.ndarray
    inner: list[np.ndarray]


def train(docs: DataFrame, passes: int = PASSES) -> Model:
    """docs: the training documents (text)."""
    spark = tune(docs.sparkSession)
    docs = docs.select("text")
    table, counts = count_words(docs)
    sent = spark.sparkContext.broadcast(counts)
    shape, inside = (TEMPLATES, CLASSES, ROWS), (TEMPLATES, WAYS, INNER_ROWS)
    seen, *found = _reduce(docs.mapInArrow(_observe(sent), "block int, sums binary"), shape, *[inside] * DEPTH, *((TEMPLATES, n * w) for n, w in zip(NODES, WIDTHS, strict=True)))
    share = ((seen[0].sum(axis=1) + 1) / (seen[0].sum() + CLASSES))[:, None]
    bias = np.log(share[:, 0]).astype(np.float32)
    near = seen + SMOOTH * share
    weights = (SHARE * (np.log(near / near.sum(axis=1, keepdims=True)) - np.log(share))).astype(np.float32)
    inner = []
    for level, log in enumerate(counts.log_shares()):
        met = found[DEPTH + level].reshape(TEMPLATES, -1, RUNS[level], WIDTHS[level])
        expected = np.einsum("qbc,kqbw->kcbw", np.exp(log.astype(np.float64)).reshape(-1, RUNS[level], WAYS), met).reshape(inside)
        inner.append(by_row(INNER_SHARE * np.log((found[level] + INNER_SMOOTH) / (expected + INNER_SMOOTH))).astype(np.float32))
    for _ in range(passes):
        model = spark.sparkContext.broadcast((weights, bias))
        (expected,) = _reduce(docs.mapInArrow(_expect(model), "block int, sums binary"), shape)
        weights = np.clip(weights + RATE * np.clip((seen - expected) / (expected + SMOOTH * share), -2, 2), -LIMIT, LIMIT).astype(np.float32)
    return Model(counts, table, weights, bias, inner)


_SCORED = "bucket int, uid long, doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, log_classes double, hashes binary, places binary, uids binary"


def _score(counts, model, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c: Counts = counts.value
        weights, bias, inner, shares = model.value
        uid = TaskContext.get().partitionId() << 33
        log_leaves = np.log10(c.leaves)
        for batch in trimmed(batches):
            for b in slices(batch):
                t = tokens(b.column("text"))
                docs = b.num_rows
                uids = uid + np.arange(docs)
                uid += docs
                cls = c.classes(t)
                past = t.histories()
                rows = t.features(past)
                log_class = _chosen(bias, None, weights, rows, cls)
                group = cls > SINGLES
                deep = np.flatnonzero(group)
                leaf = leaf_of(t.hashes[deep], t.groups[deep])
                for level, node, branch, places in choices(leaf, [x[deep] for x in past]):
                    log_class[deep] += _chosen(shares[level], node, inner[level], inner_rows(level, node, places), branch)
                log_sums = np.zeros(len(cls))
                log_sums[deep] = log_leaves[leaf]
                doc = np.repeat(np.arange(docs), np.diff(t.offs))
                n = np.zeros(len(cls), np.int64)
                found = np.zeros(len(cls), bool)
                if len(c.head):
                    place = np.minimum(np.searchsorted(c.head, t.hashes), len(c.head) - 1)
                    found = c.head[place] == t.hashes
                    n[found] = c.head_counts[place[found]]
                n[cls == SINGLES] = c.ends
                found |= cls == SINGLES
                logs = np.log10(n + 1.0)
                log_n = np.bincount(doc, weights=np.where(found, logs, 0), minlength=docs)
                model_log = log_class / np.log(10) - log_sums + np.where(found & group, logs, 0)
                # a class of one word gives it with certainty; its count is in the base alone
                log_all = np.bincount(doc, weights=model_log, minlength=docs)
                known = np.bincount(doc, weights=found & (n > 0), minlength=docs).astype(np.int64)
                yield _batch([np.zeros(docs, np.int32), uids, b.column("doc_id"), b.column("held_out"), np.diff(t.offs), known, log_n, log_all, *[[None] * docs] * 3], _SCORED)
                h, d = t.hashes[~found], doc[~found]
                where = (h % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                cuts = np.searchsorted(where[order], np.arange(buckets + 1))
                out = []
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    at = order[cuts[k] : cuts[k + 1]]
                    names, places = np.unique(d[at], return_inverse=True)
                    out.append((k, None, None, None, None, None, None, None, h[at].tobytes(), places.astype(np.uint32).tobytes(), uids[names].tobytes()))
                if out:
                    yield _rows(out, _SCORED)

    return run


_PART = "uid long, n_known long, log_counts double"


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: rows in order of (bucket, kind); a bucket's counts (kind 0) come before the words that want them."""
    bucket, words, counts = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for b in trimmed(batches):
        for k, kind, x, y, z in zip(*(b.column(c).to_pylist() for c in ("bucket", "kind", "hashes", "places", "uids")), strict=True):
            if k != bucket:
                bucket, words, counts = k, np.zeros(0, np.uint64), np.zeros(0, np.int64)
            h = np.frombuffer(x, np.uint64)
            if kind == 0:
                words, counts = h, np.frombuffer(y, np.int64)
                continue
            n = np.zeros(len(h), np.int64)
            if len(words):
                place = np.minimum(np.searchsorted(words, h), len(words) - 1)
                hit = words[place] == h
                n[hit] = counts[place[hit]]
            uids, places = np.frombuffer(z, np.int64), np.frombuffer(y, np.uint32)
            known = np.bincount(places, weights=n > 0, minlength=len(uids)).astype(np.int64)
            logs = np.bincount(places, weights=np.log10(n + 1.0), minlength=len(uids))
            some = known > 0
            if some.any():
                yield _batch([uids[some], known[some], logs[some]], _PART)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out (passed through), n_tokens, n_known, train_tokens, base_score, score. docs: doc_id, text, held_out."""
    spark = tune(docs.sparkSession)
    c = model.counts
    buckets = partitions(spark)
    counts, sent = spark.sparkContext.broadcast(c), spark.sparkContext.broadcast((by_row(model.weights), model.bias, model.inner, c.log_shares()))
    docs, restore = as_long(docs, "text", "held_out")
    scored = stored(docs.mapInArrow(_score(counts, sent, buckets), _SCORED), "scored")
    rare = scored.filter("hashes is not null").select("bucket", F.lit(1).alias("kind"), "hashes", "places", "uids")
    table = model.table.select("bucket", F.lit(0).alias("kind"), "hashes", F.col("counts").alias("places"), F.lit(None).cast("binary").alias("uids"))
    met = rare.unionByName(table).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_look_up, _PART)
    own = scored.filter("hashes is null")
    parts = met.groupBy("uid").agg(F.sum("n_known").alias("more_known"), F.sum("log_counts").alias("more_logs"))
    zero = F.lit(0)
    more = F.coalesce("more_logs", F.lit(0.0))
    space = float(np.log10(c.total + c.distinct + 1))
    out = own.join(parts, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", zero)).alias("n_known"),
        F.lit(c.total).cast("long").alias("train_tokens"),
        (F.col("log_counts") + more - F.col("n_tokens") * space).alias("base_score"),
        (F.col("log_classes") + more).alias("score"),
    )
    return restore(out, "doc_id")


def held_out() -> Column:
    """The split of the contract: one document in seven by the CRC of its id."""
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7) == 2
