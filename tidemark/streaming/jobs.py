"""Incremental forms of the batch operators. Streams need TIMESTAMP event times; TIMESTAMP_NTZ is cast at the edge."""

from __future__ import annotations

import contextlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import stats, store


#: Buckets of keys in a cache's state. A started stream keeps the number it began with.
TTL_BUCKETS = 256


def dedup_stream(stream: DataFrame, keys: list[str], at: str, watermark: str) -> DataFrame:
    """First row of each key within the watermark."""
    return stream.withWatermark(at, watermark).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, at: str, key: str, window: str, slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """(start, key, n) of tumbling or sliding windows."""
    frame = F.window(at, window, slide) if slide else F.window(at, window)
    rows = stream.withWatermark(at, watermark) if stream.isStreaming else stream
    return rows.groupBy(frame.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def trend_alerts(rows: DataFrame, at: str, key: str, window: str, ratio: float = 3.0, least: int = 3, watermark: str = "1 hour") -> DataFrame:
    """(start, key, n, previous): windows whose count is `ratio` times that of the window just before (none counts as one). One aggregation
    over windows of double length that begin at each window before gives both counts, on batches and on streams, and rows
    may come late by the watermark after the later window's end."""
    number, unit = re.fullmatch(r"\s*(\d+)\s+(\w+)\s*", window).groups()
    rows = rows.withWatermark(at, watermark) if rows.isStreaming else rows
    middle = F.col("w.start") + F.expr(f"INTERVAL {number} {unit}")
    both = rows.select(key, F.col(at).alias("t"), F.window(at, f"{2 * int(number)} {unit}", window).alias("w")).groupBy("w", key)
    counts = both.agg(F.count_if(F.col("t") >= middle).alias("n"), F.count_if(F.col("t") < middle).alias("previous"))
    hit = (F.col("n") >= least) & (F.col("n") >= F.greatest("previous", F.lit(1)) * ratio)
    return counts.filter(hit).select(middle.alias("start"), key, "n", "previous")


def run_once(stream: DataFrame, mode: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """What a stream over the data that is there now leaves: the rows of all batches in append mode, each key's last row in update mode,
    the last batch's table in complete mode. Every batch is written under its number, so a repeated batch has no second effect."""
    spark = stream.sparkSession
    path = store.new_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch_number={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    if mode == "complete":
        out = out.filter(F.col("batch_number") == out.agg(F.max("batch_number")).first()[0])
    if mode == "update":
        rest = [c for c in stream.columns if c not in keys]
        out = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_number").alias("_r")).select(*keys, "_r.*").select(*stream.columns)
    return out.drop("batch_number")


def usage_stream(stream: DataFrame) -> DataFrame:
    """Running totals by call type, for update mode: state and each batch's rows are the call types, and only those that changed are sent on."""
    return stats.usage_by_type(stream, "1970-01-01 00:00:00")


def ingest_batch(target: str, cursors: str, key: str, position: str):
    """For foreachBatch: appends what lies beyond each key's cursor to the table at target and advances the cursors, kept
    by batch under `cursors`; a repeated batch rewrites the same folders, so it has no second effect."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kind = batch.schema[position].dataType.simpleString()
        now = spark.createDataFrame([], f"{key} {batch.schema[key].dataType.simpleString()}, last {kind}")
        if number > 0:
            now = spark.read.schema(now.schema).parquet(f"{cursors}/n={number - 1}")
        new, moved = store.above_cursor(batch, now, key, position)
        new.write.mode("overwrite").parquet(f"{target}/n={number}")
        moved.write.mode("overwrite").parquet(f"{cursors}/n={number}")

    return run


class TtlCache(StatefulProcessor):
    """A value for each key that holds for ttl_ms from the event that computed it. An event before its end is a hit and gets the
    value; any other computes anew. Keys are dealt into buckets, so that a call and a read and write of state serve a bucket's events and not
    one key's. When the watermark passes an end, the row goes with the bucket's next events, and with a timer at the latest end of all."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cached = handle.getListState("cached", "key string, value string, ends long")

    def _held(self) -> dict:
        return {key: (value, ends) for key, value, ends in self.cached.get()} if self.cached.exists() else {}

    def _keep(self, held: dict) -> None:
        if held:
            self.cached.put([(key, value, ends) for key, (value, ends) in held.items()])
        else:
            self.cached.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a batch's events of a bucket in order of time
        frame = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        held = self._held()
        last = max((ends for _, ends in held.values()), default=-1)
        hits, values = [], []
        for name, at, fresh in zip(frame["key"].tolist(), frame["at"].tolist(), frame["value"].tolist(), strict=True):
            name = None if pd.isna(name) else name
            own = held.get(name)
            hit = own is not None and at < own[1]
            if not hit:
                own = held[name] = (None if pd.isna(fresh) else fresh, int(at) + self.ttl_ms)
            hits.append(hit)
            values.append(own[0])
        now = timerValues.getCurrentWatermarkInMs()
        self._keep({k: v for k, v in held.items() if v[1] > now})
        end = max(ends for _, ends in held.values())
        if end > max(last, now):
            self.handle.registerTimer(end)
        yield pd.DataFrame({"key": frame["key"].to_numpy(), "id": frame["id"].to_numpy(), "hit": hits, "value": pd.Series(values, dtype="object")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = self._held()
        left = {k: v for k, v in held.items() if v[1] > now}
        if len(left) < len(held):
            self._keep(left)
        return iter(())

    def close(self) -> None:
        pass


def ttl_cache_stream(stream: DataFrame, key: str, at: str, value: str, ttl_ms: int, id: str = "id", watermark: str = "1 hour", buckets: int = TTL_BUCKETS) -> DataFrame:
    """(key, id, hit, value) of each event: value is what the cache answers, computed by the column `value` of the event that found nothing.
    Time is the event's, and state ends with the watermark. A task holds a batch's events of one bucket. Needs the RocksDB state store (`rocksdb`)."""
    kind, own = stream.schema[key].dataType.simpleString(), stream.schema[id].dataType.simpleString()
    name = F.col(key).cast("string")
    rows = stream.withWatermark(at, watermark).select(F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int").alias("bucket"), name.alias("key"), F.col(id).alias("id"), F.unix_millis(at).alias("at"), F.col(value).cast("string").alias("value"), at)
    out = rows.groupBy("bucket").transformWithStateInPandas(TtlCache(ttl_ms), f"key string, id {own}, hit boolean, value string", "Append", "eventTime")
    return out.select(F.col("key").cast(kind).alias("key"), "id", "hit", "value")


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that keeps values with a time to live, for streams started inside; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)
