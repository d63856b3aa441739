"""Reproducible sharding by a Feistel permutation of global row numbers (law `rows`).

Rows are numbered 0..N-1 in the order of (doc_id, CRC, size); the number is permuted by a keyed Feistel network over
the smallest even-bit domain that holds N, walking the cycle until the image is below N. shard = image mod shards,
slot = image div shards: shard sizes differ by one at most, slots have no gaps, and both can be computed for any row
number without the data.

Null texts have size 1 and the CRC of no bytes. Null doc_ids come first. Repeated rows are equal in all that is
returned, so any order of theirs gives the same result. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import mix
from .common import partitions, stored, tune

ROUNDS = 6


def permute(numbers: np.ndarray, total: int, seed: int) -> np.ndarray:
    """Images of row numbers under the permutation of 0..total-1 that the seed picks."""
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    keys = [mix(np.array([seed * 1_000_003 + r], np.uint64))[0] for r in range(ROUNDS)]
    out = numbers.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        x = out[walking]
        left, right = x >> shift, x & mask
        for key in keys:
            left, right = right, left ^ (mix(right + key) & mask)
        x = (left << shift) | right
        out[walking] = x
        walking = walking[x >= total]
    return out.astype(np.int64)


def numbered(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """df with gapless global row numbers in the given order; only one count per partition reaches the driver."""
    spark = df.sparkSession
    at = F.monotonically_increasing_id()
    laid = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    laid = stored(laid.select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND((1 << 33) - 1).alias("_row")), "numbered")
    counts = sorted(map(tuple, laid.groupBy("_part").count().collect()))
    first, total = [], 0
    for part, n in counts:
        first.append((part, total))
        total += n
    offsets = spark.createDataFrame(first, "_part long, _first long")
    return laid.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_first") + F.col("_row")).drop("_part", "_row", "_first"), total


def assign(docs: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard, slot for every row of docs."""
    tune(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    rows, total = numbered(narrow, ["doc_id", "text_crc32", "size"])
    names = ["doc_id", "size", "text_crc32", "row_number"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            image = permute(b.column("row_number").to_numpy(), total, seed)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((image % shards).astype(np.int32)), pa.array(image // shards)], names=[*names, "shard", "slot"])

    id_type = dict(docs.dtypes)["doc_id"]
    return rows.select(*names).mapInArrow(place, f"doc_id {id_type}, size long, text_crc32 long, row_number long, shard int, slot long")
