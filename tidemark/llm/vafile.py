"""Centroid clustering over a vector-approximation file.

Vectors become whole numbers, floor(256 * x), and are written twice: whole, and as an approximation that holds BITS bits a dimension, the
number of the cell between that dimension's bounds. The bounds are approximate quantiles; any bounds give the same result. A round
scans the approximations only: tables of the least and greatest squared distance from each centroid to each cell are looked up and added
over the dimensions, which gives an interval of the distance to each centroid. A centroid whose least distance is over another one's
greatest can't be nearest. Whole vectors are fetched, by a join on row numbers in buckets that leaves them where they are, only for rows
whose intervals overlap, and for rows that change their cluster; for these the exact distances to the centroids left decide.
Sums of clusters are kept as exact numbers and corrected by the rows that move, so a row that stays is not read again.

Kept are vectors of exactly `dimensions` components, none null or not finite, with whole numbers up to LARGEST in size (beyond, squared
distances fit no long). Null, short and longer vectors give no rows. Rows are told apart by row numbers, so repeated vec_ids and rows
are clustered each. Null vec_ids are hashed as an empty text. Ties of first centroids' hashes go by the vectors' components. With
fewer kept vectors than k every one is a first centroid, and equal ones leave all but the first empty, which stay as they are. A
table without kept vectors gives no rows. A total that fits no long is null. Columns beyond vec_id and embedding are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, new_path, partitions, stored, trimmed, tune

BITS = 6
LARGEST = 1 << 27
#: Rows that a task handles at once.
ROWS = 4096


def whole_vectors(table: DataFrame, dimensions: int) -> DataFrame:
    """(vec_id, v): the kept vectors as arrays of long."""
    x = F.transform("embedding", lambda e: F.floor(e.cast("double") * 256))
    sound = (F.size("embedding") == dimensions) & ~F.exists("embedding", lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double") * 256) > LARGEST))
    return table.filter(F.coalesce(sound, F.lit(False))).select("vec_id", x.cast("array<long>").alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the least SHA-256 of `seed:vec_id`."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def cell_bounds(vectors: DataFrame, dimensions: int, bits: int) -> np.ndarray:
    """[dimension, cell edge]: least value, inner edges and greatest value; cell c holds the whole numbers from edge c to edge c + 1, less one."""
    cells = 1 << bits
    shares = F.array(*(F.lit(i / cells) for i in range(cells + 1)))
    found = vectors.agg(*(F.percentile_approx(F.col("v")[d], shares, F.lit(1000)).alias(f"q{d}") for d in range(dimensions)), *(F.struct(F.min(F.col("v")[d]), F.max(F.col("v")[d])).alias(f"m{d}") for d in range(dimensions))).first()
    edges = np.array([found[f"q{d}"] for d in range(dimensions)], np.int64)
    ends = np.array([tuple(found[f"m{d}"]) for d in range(dimensions)], np.int64)
    edges[:, 0], edges[:, -1] = ends[:, 0], ends[:, 1] + 1
    return np.maximum.accumulate(np.clip(edges, ends[:, :1], ends[:, 1:] + 1), axis=1)


def pack(cells: np.ndarray, bits: int) -> np.ndarray:
    """Rows of cell numbers as rows of bytes, `bits` bits a cell."""
    places = (cells[:, :, None] >> np.arange(bits - 1, -1, -1)) & 1
    return np.packbits(places.reshape(len(cells), -1).astype(np.uint8), axis=1)


def unpack(rows: np.ndarray, dimensions: int, bits: int) -> np.ndarray:
    places = np.unpackbits(rows, axis=1)[:, : dimensions * bits].reshape(len(rows), dimensions, bits)
    return places @ (1 << np.arange(bits - 1, -1, -1))


def distance_tables(edges: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[dimension, cell, centroid]: the least and the greatest squared difference between the centroid and the numbers of the cell."""
    low, high = edges[:, :-1, None], np.maximum(edges[:, 1:] - 1, edges[:, :-1])[:, :, None]
    c = centroids.T[:, None, :]
    least = np.maximum(np.maximum(low - c, c - high), 0)
    most = np.maximum(np.abs(c - low), np.abs(c - high))
    return least * least, most * most


def intervals(cells: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[row, centroid]: bounds of the squared distances."""
    low = np.zeros((len(cells), least.shape[2]), np.int64)
    high = np.zeros_like(low)
    for d in range(cells.shape[1]):
        low += least[d][cells[:, d]]
        high += most[d][cells[:, d]]
    return low, high


def nearest(vectors: np.ndarray, centroids: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) among the centroids that are open to each row; the smaller number of equal ones."""
    best, cluster = np.full(len(vectors), np.iinfo(np.int64).max), np.zeros(len(vectors), np.int32)
    for k in range(len(centroids)):
        rows = np.flatnonzero(open_[:, k])
        d = vectors[rows] - centroids[k]
        d = (d * d).sum(axis=1)
        nearer = d < best[rows]
        best[rows[nearer]] = d[nearer]
        cluster[rows[nearer]] = k
    return cluster, best


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of equal lengths as a matrix of bytes."""
    column = column.cast(pa.large_binary())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]].reshape(-1, width)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.py_buffer(rows.tobytes())])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in trimmed(batches):
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


class VectorFile:
    """Whole vectors in buckets of their row numbers, and approximations with the cluster of each row. close() drops the files."""

    def __init__(self, vectors: DataFrame, dimensions: int, bits: int = BITS):
        self.spark: SparkSession = tune(vectors.sparkSession)
        self.dimensions, self.bits = dimensions, bits
        self.edges = cell_bounds(vectors, dimensions, bits)
        path = new_path(self.spark, "vectors")
        self.name = path.rsplit("/", 1)[1].replace("-", "_")
        laid = vectors.repartition(partitions(self.spark), "row").sortWithinPartitions("row")
        laid.write.bucketBy(partitions(self.spark), "row").sortBy("row").option("path", path).saveAsTable(self.name)
        self.whole = self.spark.table(self.name)
        self.sums: dict[int, list[int]] = {}
        self.counts: dict[int, int] = {}
        self.state = stored(self._approximated(), "approximations")
        self.fetched = 0

    def _approximated(self) -> DataFrame:
        edges, bits = self.edges, self.bits

        def run(batches):
            for b in _slices(batches):
                v = b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)
                cells = np.stack([np.searchsorted(edges[d, 1:-1], v[:, d], side="right") for d in range(v.shape[1])], axis=1)
                yield pa.RecordBatch.from_arrays([b.column("row"), _binary(pack(cells, bits)), pa.array(np.full(len(v), -1, np.int32))], names=["row", "cells", "cluster"])

        return self.whole.select("row", "v").mapInArrow(run, "row long, cells binary, cluster int")

    def _judged(self, centroids: np.ndarray) -> DataFrame:
        """(row, cells, cluster, new, open): new is -1 where intervals overlap; open has a bit for each centroid that may be nearest."""
        sent = self.spark.sparkContext.broadcast(distance_tables(self.edges, centroids))
        dimensions, bits = self.dimensions, self.bits

        def run(batches):
            least, most = sent.value
            for b in _slices(batches):
                cells = unpack(_fixed(b.column("cells"), -(-dimensions * bits // 8)), dimensions, bits)
                low, high = intervals(cells, least, most)
                open_ = low <= high.min(axis=1, keepdims=True)
                new = np.where(open_.sum(axis=1) == 1, open_.argmax(axis=1), -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("cells"), b.column("cluster"), pa.array(new), _binary(np.packbits(open_, axis=1))], names=["row", "cells", "cluster", "new", "open"])

        return self.state.mapInArrow(run, "row long, cells binary, cluster int, new int, open binary")

    def _exact(self, rows: DataFrame, centroids: np.ndarray) -> DataFrame:
        """Rows with their whole vectors: (row, cells, cluster, distance), and with row null a task's changes of each cluster's sums."""
        sent = self.spark.sparkContext.broadcast(centroids)

        def run(batches):
            c = sent.value
            k, dimensions = c.shape
            sums, counts = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
            for b in _slices(batches):
                v = b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)
                open_ = np.unpackbits(_fixed(b.column("open"), -(-k // 8)), axis=1)[:, :k].astype(bool)
                cluster, distance = nearest(v, c, open_)
                old = b.column("cluster").to_numpy()
                moved = np.flatnonzero(old != cluster)
                for to, sign in ((cluster, 1), (old, -1)):
                    rows = moved[to[moved] >= 0]
                    np.add.at(sums, to[rows], sign * v[rows])
                    np.add.at(counts, to[rows], sign)
                none = pa.nulls(b.num_rows, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("cells"), pa.array(cluster), pa.array(distance), none], names=["row", "cells", "cluster", "distance", "sums"])
            hit = np.flatnonzero((counts != 0) | (sums != 0).any(axis=1))
            none = pa.nulls(len(hit), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.nulls(len(hit), pa.binary()), pa.array(hit.astype(np.int32)), pa.array(counts[hit]), pa.array(list(sums[hit]), pa.list_(pa.int64()))], names=["row", "cells", "cluster", "distance", "sums"])

        met = rows.join(self.whole.select("row", "v"), "row").select("row", "cells", "cluster", "open", "v")
        return met.mapInArrow(run, "row long, cells binary, cluster int, distance long, sums array<long>")

    def assign(self, centroids: np.ndarray) -> None:
        """Every row to its nearest centroid; sums and counts follow."""
        judged = stored(self._judged(centroids), "judged")
        fetch = (F.col("new") < 0) | (F.col("new") != F.col("cluster"))
        exact = stored(self._exact(judged.filter(fetch), centroids), "fetched")
        changes = exact.filter("row is null")
        total = [F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(self.dimensions)]
        for r in changes.groupBy("cluster").agg(F.sum("distance").alias("n"), *total).collect():  # a row for each centroid at most
            k = r["cluster"]
            self.counts[k] = self.counts.get(k, 0) + r["n"]
            self.sums[k] = [a + int(r[f"s{d}"]) for d, a in enumerate(self.sums.get(k, [0] * self.dimensions))]
        done = judged.filter(~fetch).select("row", "cells", F.col("new").alias("cluster"))
        moved = exact.filter("row is not null").select("row", "cells", "cluster")
        state = stored(done.unionByName(moved), "approximations")
        self.fetched += moved.count()
        for old in (judged, exact, self.state):
            discard(old)
        self.state = state

    def moved_centroids(self, centroids: np.ndarray) -> np.ndarray:
        """The clusters' floored means; centroids of empty clusters stay."""
        return np.array([[s // self.counts[k] for s in self.sums[k]] if self.counts.get(k) else list(map(int, c)) for k, c in enumerate(centroids)], np.int64)

    def distances(self, centroids: np.ndarray) -> DataFrame:
        """(row, cluster, distance) of all rows: every vector is fetched, and meets the centroids that its intervals leave."""
        return self._exact(self._judged(centroids), centroids).filter("row is not null").select("row", "cluster", "distance")

    def close(self) -> None:
        discard(self.state)
        discard(self.whole)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def cluster(table: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dimensions: int = 64, bits: int = BITS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    kind = dict(table.dtypes)["vec_id"]
    spark = tune(table.sparkSession)
    vectors = stored(whole_vectors(table, dimensions).withColumn("row", F.monotonically_increasing_id()), "whole-vectors")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    file = VectorFile(vectors, dimensions, bits)
    try:
        for _ in range(rounds):
            file.assign(centroids)
            centroids = file.moved_centroids(centroids)
        found = stored(file.distances(centroids).join(file.whole.select("row", "vec_id"), "row").select("vec_id", "cluster", "distance"), "clustered")
    finally:
        file.close()
        discard(vectors)
    inertia = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # k rows at most
    long = lambda n: n if n < 1 << 63 else None
    facts = [(c, long(n), long(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, n in inertia.items()]
    return found.join(F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
