"""Divergence of sources within a language, by two passes over the texts.

The first pass filters exactly: it counts in how many documents of its language a term stands and keeps those of min_docs or more.
The kept terms of a language are dealt by hash into shards of about SHARD_KEYS terms; each becomes a minimal perfect hash with its
terms stored by slot. The second pass recounts: shards are broadcast in blocks of at most BLOCK_BYTES, and a task looks up its terms, compares
them with the stored ones, and increments a dense array of slots for each group and shard; at DENSE_BYTES the arrays are
sent as one packed row for each group and shard, which are added up array by array. A vocabulary of several blocks is recounted block by block, one
live broadcast at a time, which reads the texts once for each.

Smoothed shares are whole numbers: 1 + floor(SCALE * (count + 1) / (N + V)). They are divided as decimals, so counts may be of any
size. Sums over all kept terms for pairs of sources are made by ranges of slots: a task holds the shares of all sources over a range
of at most RANGE_CELLS cells and adds up each pair; a terms' ranking keeps its best rows before it is gathered.

Null text, lang and source are ''. Each row counts as a document, also where doc_ids repeat. A language with one source has no pairs; one
without kept terms has pairs of value 0. An empty table gives no rows. Ties of value go by the item's UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import LOWER, ranges, slices, span_hash, text_parts, word_spans
from .common import discard, partitions, stored, trimmed, tune
from .perfecthash import PerfectHash
from .wordbook import distinct_spans

SCALE = 1_000_000_000
SHARD_KEYS = 1 << 16
#: Bytes of perfect hashes that are broadcast at once.
BLOCK_BYTES = 48 << 20
#: Bytes of counts that a task holds, and different terms that it gathers before it looks them up.
DENSE_BYTES = 64 << 20
PENDING = 300_000
#: Words that a task gathers before it counts them.
PENDING_WORDS = 4_000_000
#: Shares that a task of the pair sums holds at once.
RANGE_CELLS = 1 << 21
#: Slots of a range at most, so that a large language is many ranges.
RANGE_SLOTS = 1 << 13
#: Rows of counts that a task of the first pass holds before it adds them up.
HELD = 600_000
#: Fixed value: a term, over lower-cased UTF-8, and its bytes before that.
TERM_BYTES = re.compile(rb"[a-z\x80-\xff]+")
TERM = np.zeros(256, bool)
TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True


class Terms:
    """The terms of a batch of texts: each different term once, which of them stands at every place, and each place's text."""

    def __init__(self, column: pa.Array):
        data, offs = text_parts(column)
        start, end, word_offs = word_spans(data, offs, TERM)
        self.low = LOWER[data]
        self.first, self.which = distinct_spans(self.low, start, end, span_hash(self.low, start, end, False))
        self.start, self.size = start[self.first], (end - start)[self.first]
        self.text = np.repeat(np.arange(len(word_offs) - 1), np.diff(word_offs))

    def array(self, which: np.ndarray) -> pa.Array:
        """These terms' bytes."""
        size = self.size[which]
        offs = np.append(0, np.cumsum(size)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(offs), pa.py_buffer(self.low[ranges(self.start[which], size)])])

    def counts(self, group: np.ndarray, documents: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(group, terms, how often each stands there, or in how many texts) for each text's group from 0 on; texts of -1 are left out."""
        n = max(len(self.first), 1)
        if documents:
            key = np.sort(self.text * n + self.which)
            key = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
            text, which = key // n, key % n
        else:
            text, which = self.text, self.which
        own = group[text]
        key = np.sort((own * n + which)[own >= 0])
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        times, key = np.diff(np.append(at, len(key))), key[at]
        cuts = np.flatnonzero(np.append(True, key[1:] // n != key[:-1] // n)[: len(key)])
        for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)], strict=True):
            yield int(key[a] // n), key[a:z] % n, times[a:z]


def _codes(column: pa.Array) -> tuple[list[str], np.ndarray]:
    """(the different values, each row's place among them)."""
    coded = column.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def kept_terms(docs: DataFrame, min_docs: int = 3) -> DataFrame:
    """(lang, term) of the terms in at least min_docs documents of the language. Tasks count before the shuffle."""
    tune(docs.sparkSession)

    def merged(held: list[pa.Table]) -> pa.Table:
        rows = pa.concat_tables(held).group_by(["lang", "term"], use_threads=False).aggregate([("n", "sum")])
        return rows.rename_columns({"n_sum": "n"}).select(["lang", "term", "n"])

    def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from rows.set_column(1, "term", rows.column("term").cast(pa.string())).to_batches()

    def run(batches):
        held, size = [], 0
        for batch in trimmed(batches):
            for b in slices(batch):
                t = Terms(b.column("text"))
                langs, lang = _codes(b.column("lang"))
                for k, which, n in t.counts(lang, documents=True):
                    held.append(pa.table({"lang": pa.array([langs[k]] * len(which), pa.string()), "term": t.array(which), "n": n}))
                    size += len(which)
                if size >= HELD:
                    held = [merged(held)]
                    size = held[0].num_rows
                    if size >= PENDING:
                        yield from out(held[0])
                        held, size = [], 0
        if held:
            yield from out(merged(held))

    rows = _narrow(docs).select("lang", "text").mapInArrow(run, "lang string, term string, n long")
    return rows.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).select("lang", "term")


def _shard(term: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(shards)).cast("int")


def _hashes(keys) -> np.ndarray:
    """As Spark's xxhash64, unsigned."""
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(k, 42) for k in keys), np.uint64, len(keys))


def build_shards(kept: DataFrame, shards: int) -> DataFrame:
    """(lang, shard, n, bytes, sizes, bits, terms by slot): a perfect hash for each group of kept terms."""

    def build(key, table):
        terms = table.column("term").combine_chunks().cast(pa.binary())
        keys = terms.to_pylist()
        sizes, bits, order = PerfectHash.build(keys, _hashes(keys))
        laid = terms.take(pa.array(order)).cast(pa.string())
        size = len(bits) + laid.nbytes
        return pa.table({"lang": pa.array([key[0].as_py()]), "shard": pa.array([key[1].as_py()], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "bytes": pa.array([size], pa.int64()), "sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": pa.array([bits], pa.binary()), "terms": pa.array([laid.to_pylist()], pa.list_(pa.string()))})

    dealt = kept.select("lang", "term", _shard(F.col("term"), shards).alias("shard"))
    return dealt.groupBy("lang", "shard").applyInArrow(build, "lang string, shard int, n long, bytes long, sizes array<long>, bits binary, terms array<string>")


class _Numbers(dict):
    """Numbers of the terms of a language that a task has met, in the order of their first sight."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


class _Counts:
    """A task's counts: dense by slot for each (lang, source, shard)."""

    def __init__(self, hashes: dict, shards: int, most: int):
        self.hashes, self.shards, self.most = hashes, shards, most
        self.numbers: dict[str, _Numbers] = {}
        self.pending: dict[str, dict[str, list[np.ndarray]]] = {}
        self.words = 0
        self.dense: dict[tuple[str, str, int], np.ndarray] = {}
        self.bytes = 0

    def add(self, lang: str, source: str, text: bytes) -> Iterator[pa.RecordBatch]:
        words = TERM_BYTES.findall(text.lower())
        numbers = self.numbers.setdefault(lang, _Numbers())
        self.pending.setdefault(lang, {}).setdefault(source, []).append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        self.words += len(words)
        if self.words >= PENDING_WORDS or sum(map(len, self.numbers.values())) >= PENDING:
            yield from self.settle()

    def settle(self) -> Iterator[pa.RecordBatch]:
        """Look the gathered terms up, once for each language, and count them."""
        for lang, sources in self.pending.items():
            terms = pa.array(self.numbers[lang].keys(), pa.binary())
            hashes = _hashes(self.numbers[lang].keys())
            shard = hashes.astype(np.int64) % self.shards  # signed, as Spark's hash is
            found = []
            for k in np.unique(shard):
                known = self.hashes.get((lang, int(k)))
                if known is not None:
                    mine = np.flatnonzero(shard == k)
                    slot = known.slots(terms.take(pa.array(mine)), hashes[mine])
                    found.append((int(k), len(known.keys), mine[slot >= 0], slot[slot >= 0]))
            for source, parts in sources.items():
                counts = np.bincount(np.concatenate(parts), minlength=len(terms))
                for k, size, mine, slot in found:
                    at = (lang, source, k)
                    if at not in self.dense:
                        self.dense[at] = np.zeros(size, np.int64)
                        self.bytes += 8 * size
                    self.dense[at][slot] += counts[mine]  # different terms have different slots
                    if self.bytes >= self.most:
                        yield from self.flush()
        self.pending, self.numbers, self.words = {}, {}, 0

    def flush(self) -> Iterator[pa.RecordBatch]:
        for (lang, source, shard), counts in self.dense.items():
            slots = np.flatnonzero(counts)
            if len(slots):
                row = [lang, source, shard, len(counts), slots.astype(np.int32).tobytes(), counts[slots].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=PACKED_NAMES)
        self.dense, self.bytes = {}, 0


PACKED = "lang string, source string, shard int, size int, slots binary, counts binary"
PACKED_NAMES = [x.split()[0] for x in PACKED.split(", ")]


def _add_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: tasks' counts in order of (lang, source, shard); their sums, one array of slots at a time."""
    at, total = None, np.zeros(0, np.int64)

    def out() -> Iterator[pa.RecordBatch]:
        slots = np.flatnonzero(total)
        if len(slots):
            same = pa.array(np.zeros(len(slots), np.int32))
            names = [pa.array([x], pa.string()).take(same) for x in at[:2]]
            yield pa.RecordBatch.from_arrays([*names, pa.array(np.full(len(slots), at[2], np.int32)), pa.array(slots.astype(np.int32)), pa.array(total[slots])], names=["lang", "source", "shard", "slot", "n"])

    for b in trimmed(batches):
        for lang, source, shard, size, slots, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (lang, source, shard) != at:
                yield from out()
                at, total = (lang, source, shard), np.zeros(size, np.int64)
            total[np.frombuffer(slots, np.int32)] += np.frombuffer(counts, np.int64)
    yield from out()


def _blocks(shards: DataFrame, most: int) -> list[list[tuple[str, int]]]:
    """The shards' keys in blocks of at most `most` bytes (a larger shard alone); one short row a shard reaches the driver."""
    out, size = [[]], 0
    for lang, shard, n in sorted(map(tuple, shards.select("lang", "shard", "bytes").collect())):
        if out[-1] and size + n > most:
            out.append([])
            size = 0
        out[-1].append((lang, shard))
        size += n
    return [b for b in out if b]


def recount(docs: DataFrame, shards: DataFrame, n_shards: int, block_bytes: int = BLOCK_BYTES, dense_bytes: int = DENSE_BYTES) -> DataFrame:
    """(lang, source, shard, slot, n): occurrences of the kept terms in each group, by the broadcast perfect hashes."""
    spark = tune(docs.sparkSession)
    context = spark.sparkContext
    narrow = _narrow(docs)
    schema = "lang string, source string, shard int, slot int, n long"
    parts = []
    for block in _blocks(shards, block_bytes):
        wanted = spark.createDataFrame(block, "lang string, shard int")
        rows = shards.join(F.broadcast(wanted), ["lang", "shard"], "left_semi").select("lang", "shard", "sizes", "bits", "terms").toArrow()
        hashes = {}
        for i in range(rows.num_rows):
            row = rows.slice(i, 1)
            terms = row.column("terms").combine_chunks().flatten().cast(pa.binary())
            hashes[row["lang"][0].as_py(), row["shard"][0].as_py()] = PerfectHash(row["sizes"][0].as_py(), row["bits"][0].as_py(), terms)
        sent = context.broadcast(hashes)
        del rows, hashes

        def run(batches, sent=sent):
            counts = _Counts(sent.value, n_shards, dense_bytes)
            for b in trimmed(batches):
                texts = b.column("text").cast(pa.large_binary())
                for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), texts, strict=True):
                    yield from counts.add(lang, source, text.as_py())
            yield from counts.settle()
            yield from counts.flush()

        by = ["lang", "source", "shard"]
        found = narrow.mapInArrow(run, PACKED).repartition(partitions(spark), *by).sortWithinPartitions(*by).mapInArrow(_add_packed, schema)
        parts.append(stored(found, "recounted"))
        sent.destroy()
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _share(n: str, total: str) -> Column:
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({n} + 1 AS DECIMAL(20,0))) div CAST({total} AS DECIMAL(20,0))").cast("long")


def _pair_sums(cells: DataFrame, groups: DataFrame, shards: DataFrame, width: int) -> DataFrame:
    """(lang, source, item, value): floor((p - q)^2 / q) summed over all kept terms, by ranges of `width` slots."""
    ranges = shards.select("lang", "shard", "n").filter("n > 0").select("lang", "shard", "n", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / width).cast("int"))).alias("range"))
    ranges = ranges.select("lang", "shard", "range", F.least(F.lit(width), F.col("n") - F.col("range") * width).alias("size"))
    every = ranges.join(groups.select("lang", "source", "p0"), "lang")
    inside = cells.select("lang", "shard", F.expr(f"slot div {width}").cast("int").alias("range"), "source", F.expr(f"slot % {width}").alias("place"), "p")
    by = ["lang", "shard", "range"]

    def sums(key, left, right):
        names = right.column("source").combine_chunks()
        size = right["size"][0].as_py()
        p = np.repeat(right["p0"].to_numpy()[:, None], size, axis=1)
        if left.num_rows:
            p[pc.index_in(left.column("source").combine_chunks(), names).to_numpy(), left["place"].to_numpy()] = left["p"].to_numpy()
        count, values = len(names), []
        for i in range(count):
            d = p[i] - p
            values.append(((d * d) // p).sum(axis=1))
        mine, other = np.repeat(np.arange(count), count), np.tile(np.arange(count), count)
        away = mine != other
        return pa.table({"lang": pa.array([key[0].as_py()] * int(away.sum()), pa.string()), "source": names.take(pa.array(mine[away])), "item": names.take(pa.array(other[away])), "value": pa.array(np.concatenate(values)[away])})

    parts = inside.groupBy(*by).cogroup(every.groupBy(*by)).applyInArrow(sums, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = 3, top_terms: int = 200, shard_keys: int = SHARD_KEYS, block_bytes: int = BLOCK_BYTES, dense_bytes: int = DENSE_BYTES, range_cells: int = RANGE_CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group (lang, source): part `pair` has the other sources of the language by
    divergence, part `term` the top_terms terms that the group uses more than its language does."""
    narrow = _narrow(docs)
    kept = stored(kept_terms(docs, min_docs), "kept-terms")
    most = kept.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    n_shards = max(1, -(-most // shard_keys))
    shards = stored(build_shards(kept, n_shards), "perfect-hashes")
    discard(kept)
    counts = recount(docs, shards, n_shards, block_bytes, dense_bytes)
    volume = shards.groupBy("lang").agg(F.sum("n").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = narrow.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(volume, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
    groups = stored(groups.withColumn("p0", F.when(F.col("v") > 0, _share("CAST(0 AS BIGINT)", "total + nullif(v, 0)"))), "groups")
    langs = groups.groupBy("lang").agg(F.sum("total").alias("all"), F.max("v").alias("lang_v"))
    cells = counts.join(groups.select("lang", "source", "total", "v"), ["lang", "source"]).select("lang", "source", "shard", "slot", "n", _share("n", "total + v").alias("p"))
    sources = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1

    pairs = _pair_sums(cells, groups.filter("v > 0"), shards, max(1, min(RANGE_SLOTS, range_cells // sources)))
    bare = groups.filter("v = 0")  # no kept terms: pairs of the few such languages, all of value 0
    none = bare.select("lang", "source").join(bare.select("lang", F.col("source").alias("item")), "lang").filter("source <> item").withColumn("value", F.lit(0).cast("long"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.unionByName(none).withColumn("rank", F.row_number().over(order))

    by = ["lang", "shard", "slot"]
    whole = counts.groupBy(*by).agg(F.sum("n").alias("lang_n")).join(langs, "lang").select(*by, _share("lang_n", "all + lang_v").alias("q"))
    names = shards.select("lang", "shard", F.posexplode("terms").alias("slot", "item"))
    over = cells.join(whole, by).filter("p > q").join(names, by)
    terms = over.select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms)
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return out(pairs, "pair").unionByName(out(terms, "term"))
