"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (key hashes, number of documents, full) that is bucketed and sorted by the hashes, so runs meet each other and
new batches by merge joins without moving a run's rows. A new batch of documents is counted and merge-anti-joined with
the keys that some run marks as full, that is frequent already; the rest looks up its counts in the runs, marks what reaches
`min_docs` as full, and becomes a run of level 0. When a level has FANOUT runs they are merged into one run of the next
level. The full keys of all runs are the frequent ones, and all lines with such keys go.

A line's key is the line without white space (0x20, 0x09-0x0D) at its ends and with A-Z lower-cased. Empty keys never
count. Null and empty texts are one empty line. A key counts once in a row of documents, however often it stands there;
rows with the same doc_id count once for each. An empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, fresh, new_path, partitions, stored, trimmed, tune, without

FANOUT = 4
#: Frequent keys up to this number are broadcast (16 bytes each); more are joined by shuffle.
BROADCAST_KEYS = 500_000
EXTRA = T.StructType().add("n_lines", "long").add("n_dropped", "long").add("kept_text", "string")
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def key_hash(key: Column) -> Column:
    """128 bits of hash; null for the empty key."""
    return F.when(key != "", F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.concat(F.lit("\0"), key)).alias("g")))


def doc_lines() -> Column:
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)


class LineRuns:
    """Levels of runs: bucketed, sorted tables whose files lie in the shared folder. close() drops them."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, fanout: int = FANOUT):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = partitions(spark)
        self.levels: list[list[DataFrame]] = []
        self.names: list[str] = []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def frequent(self) -> DataFrame:
        """(h, g) of the full keys; a key is full in one run."""
        out = self.spark.createDataFrame([], "h long, g long")
        for r in self.runs():
            out = out.unionByName(r.filter("full").select("h", "g"))
        return out

    def _run(self, rows: DataFrame, level: int) -> DataFrame:
        path = new_path(self.spark, f"run{level}")
        name = path.rsplit("/", 1)[1].replace("-", "_")
        laid = rows.select("h", "g", "n", "full").repartition(self.buckets, "h", "g").sortWithinPartitions("h", "g")
        laid.write.bucketBy(self.buckets, "h", "g").sortBy("h", "g").option("path", path).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def met(self, counts: DataFrame) -> DataFrame:
        """The batch's keys that no run has as full, with full where they reach min_docs now."""
        rows = counts.select("h", "g", "n").repartition(self.buckets, "h", "g")
        total = F.col("n")
        for k, r in enumerate(self.runs()):
            rows = rows.join(r.filter("full").select("h", "g"), ["h", "g"], "left_anti")
            rows = rows.join(r.select("h", "g", F.col("n").alias(f"n{k}")), ["h", "g"], "left")
            total = total + F.coalesce(f"n{k}", F.lit(0))
        return rows.select("h", "g", "n", (total >= self.min_docs).alias("full"))

    def add(self, counts: DataFrame) -> None:
        """counts: h, g, n of one batch, a row for each key."""
        self._push(0, self._run(self.met(counts), 0))

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            out = full[0]
            for r in full[1:]:
                both = out.withColumnsRenamed({"n": "n1", "full": "full1"}).join(r, ["h", "g"], "full")
                out = both.select("h", "g", (F.coalesce("n1", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n"), (F.coalesce("full1", F.lit(False)) | F.coalesce("full", F.lit(False))).alias("full"))
            self._push(level + 1, self._run(out, level + 1))

    def close(self) -> None:
        for name in self.names:
            discard(self.spark.table(name))
            self.spark.sql(f"DROP TABLE {name}")
        self.names, self.levels = [], []


def batch_counts(docs: DataFrame, batches: int) -> DataFrame:
    """batch, h, g, n: in how many documents of each batch a key stands. One pass; a document gives each key once."""
    keys = F.array_distinct(F.transform(F.split(F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER), "\n", -1), lambda x: key_hash(F.btrim(x, F.lit(BLANK)))))
    rows = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"), F.explode(keys).alias("k")).filter("k is not null")
    return rows.groupBy("batch", "k.h", "k.g").agg(F.count(F.lit(1)).alias("n"))


def frequent_keys(docs: DataFrame, min_docs: int = 10, batches: int = 5) -> DataFrame:
    """(h, g) of the keys that stand in min_docs documents or more, by way of the runs."""
    counted = stored(batch_counts(docs, batches), "line-counts", ["batch"])
    runs = LineRuns(docs.sparkSession, min_docs)
    try:
        for b in range(batches):
            runs.add(counted.filter(F.col("batch") == b).select("h", "g", "n"))
        return stored(runs.frequent(), "frequent-lines")
    finally:
        runs.close()
        discard(counted)


def _drop_by_broadcast(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    spark = tune(docs.sparkSession)
    rows = frequent.toPandas()  # at most BROADCAST_KEYS rows of 16 bytes
    known = spark.sparkContext.broadcast(set(zip(rows["h"].tolist(), rows["g"].tolist(), strict=True)))
    lower = bytes.maketrans(UPPER.encode(), LOWER.encode())
    blank = BLANK.encode()
    schema = T.StructType([*docs.schema.fields, *EXTRA.fields])

    def run(batches):
        from xxhash import xxh64_intdigest

        banned, seen = known.value, {}

        def frequent_line(line: bytes) -> bool:
            got = seen.get(line)
            if got is None:
                key = line.strip(blank).translate(lower)
                sign = lambda x: x - (1 << 64) if x >= 1 << 63 else x
                got = bool(key) and (sign(xxh64_intdigest(key, 42)), sign(xxh64_intdigest(b"\0" + key, 42))) in banned
                if len(seen) > 100_000 or len(line) > 2000:
                    seen.clear()
                else:
                    seen[line] = got
            return got

        for b in trimmed(batches):
            n, dropped, texts = [], [], []
            for text in b.column("text").cast(pa.binary() if b.column("text").nbytes < 1 << 31 else pa.large_binary()).to_pylist():
                lines = (text or b"").split(b"\n")
                kept = [x for x in lines if not frequent_line(x)]
                n.append(len(lines))
                dropped.append(len(lines) - len(kept))
                texts.append(b"\n".join(kept).decode())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.string())], names=schema.names)

    return docs.mapInArrow(run, schema)


def _drop_by_join(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """For more frequent keys than may be broadcast: lines meet the keys by shuffle; a hot key's lines are split by adaptive skew joins."""
    other = [c for c in docs.columns if c != "text"]
    row, text, at, line, k, h, g, hit, stay = fresh(docs, "row", "text", "at", "line", "k", "h", "g", "hit", "stay")
    own = lambda c: F.col(f"`{c}`")
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    lines = rows.select(row, *map(own, other), F.col("text").alias(text), F.posexplode(doc_lines()).alias(at, line))
    lines = lines.withColumn(k, key_hash(line_key(F.col(line)))).withColumns({h: F.col(k)["h"], g: F.col(k)["g"]})
    lines = lines.withColumn(text, F.when(F.col(at) == 0, F.col(text))).drop(k)
    marked = lines.join(frequent.select(F.col("h").alias(h), F.col("g").alias(g), F.lit(True).alias(hit)), [h, g], "left")
    kept = F.when(F.col(hit).isNull(), F.struct(F.col(at).alias("at"), F.col(line).alias("line")))
    out = marked.groupBy(row).agg(
        *(F.any_value(own(c)).alias(c) for c in other),
        F.max(text).alias("text"),
        F.count(F.lit(1)).alias("n_lines"),
        F.count(hit).alias("n_dropped"),
        F.sort_array(F.collect_list(kept)).alias(stay),
    )
    return out.select(*map(own, docs.columns), "n_lines", "n_dropped", F.array_join(F.transform(stay, lambda x: x["line"]), "\n").alias("kept_text"))


def drop_lines(docs: DataFrame, frequent: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """docs with the columns n_lines, n_dropped and kept_text."""
    docs = without(docs, *EXTRA.names)
    few = frequent.count() <= broadcast_keys
    return _drop_by_broadcast(docs, frequent) if few else _drop_by_join(docs, frequent)
