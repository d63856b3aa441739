"""Event clusters that live across micro-batches: a table of changes by batch number, and the batch step that extends it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from . import events, vectors
from .store import settled

CLUSTERS = "id long, event_title string, category string, first_seen_at timestamp_ntz, last_updated_at timestamp_ntz, article_count long"
MEMBERS = "event_cluster_id long, content_item_id long, score double, role string"
CENTROIDS = "event_cluster_id long, members long, centroid array<double>"
#: Batches after which the clusters' changes are written whole once.
SNAPSHOT_BATCHES = 16
OTHER_CATEGORY = "其他"


class ClusterTable:
    """Clusters, members and centroids at a path. Batch n writes the clusters it changed, its members and the changed centroids under n, and
    every SNAPSHOT_BATCHES batches all clusters once; what holds before batch n is read from the folders of the batches below n, so a
    repeated batch reads the same and rewrites its own folders. Members without a cluster (role single) are attempts."""

    def __init__(self, spark: SparkSession, path: str, every: int = SNAPSHOT_BATCHES):
        self.spark, self.path, self.every = spark, path.rstrip("/"), every

    def create(self, clusters: DataFrame | None = None, centroids: DataFrame | None = None) -> ClusterTable:
        """Begin with the clusters and centroids given, or with none."""
        for kind, schema, given in (("clusters", CLUSTERS, clusters), ("centroids", CENTROIDS, centroids)):
            start = self.spark.createDataFrame([], schema)
            rows = start if given is None else start.unionByName(given.select(*start.columns))
            rows.write.mode("overwrite").parquet(f"{self.path}/{kind}-whole/n=-1")
        return self

    def _latest(self, kind: str, schema: str, before: int, key: str) -> DataFrame:
        """The rows of a kind by key as the batches below `before` left them."""
        base = before // self.every * self.every - 1
        columns = self.spark.createDataFrame([], schema).columns
        read = lambda folder, n: self.spark.read.schema(schema).parquet(f"{self.path}/{folder}/n={n}").withColumn("_n", F.lit(n))
        rows = read(f"{kind}-whole", base)
        for n in range(base + 1, before):
            rows = rows.unionByName(read(kind, n))
        if before == base + 1:
            return rows.drop("_n")
        last = rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in columns if c != key)), "_n").alias("_r"))
        return last.select(key, "_r.*").select(*columns)

    def clusters(self, before: int) -> DataFrame:
        return self._latest("clusters", CLUSTERS, before, "id")

    def centroids(self, before: int) -> DataFrame:
        return self._latest("centroids", CENTROIDS, before, "event_cluster_id")

    def members(self, before: int) -> DataFrame:
        if not before:
            return self.spark.createDataFrame([], MEMBERS + ", n int")
        return self.spark.read.schema(MEMBERS + ", n int").option("basePath", f"{self.path}/members").parquet(*(f"{self.path}/members/n={n}" for n in range(before)))

    def commit(self, number: int, clusters: DataFrame, members: DataFrame, centroids: DataFrame) -> None:
        """Write what a batch changed; the snapshot last, from what is written."""
        for kind, rows in (("members", members), ("clusters", clusters), ("centroids", centroids)):
            rows.write.mode("overwrite").parquet(f"{self.path}/{kind}/n={number}")
        if (number + 1) % self.every == 0:
            for kind, schema, key in (("clusters", CLUSTERS, "id"), ("centroids", CENTROIDS, "event_cluster_id")):
                # bases are read for whole spans only, so the one being written is no part of this
                self._before_snapshot(kind, schema, number, key).write.mode("overwrite").parquet(f"{self.path}/{kind}-whole/n={number}")

    def _before_snapshot(self, kind: str, schema: str, number: int, key: str) -> DataFrame:
        old = self._latest(kind, schema, number, key)
        new = self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/n={number}")
        return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new)


def cluster_batch(table: ClusterTable, patterns: list[str] = X.ENTITIES, days: float = 3, least: float = 0.55, leader_importance: int = 6, skip: tuple[str, ...] = ("rss",), first_id: int = 0, embeddings: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over items: those not yet in a cluster join the best cluster of the last days that accepts them, the others are
    clustered among themselves; counts, times and, with embeddings, centroids of the clusters follow. A new cluster's id is its
    leader's plus first_id. Time is the batch's latest item. Sources in `skip` are not clustered."""

    def run(batch: DataFrame, number: int) -> None:
        batch = settled(batch, "batch")
        as_of = batch.agg(F.max("published_at").cast("string")).first()[0]
        spark = batch.sparkSession
        if as_of is None:
            table.commit(number, *(spark.createDataFrame([], s) for s in (CLUSTERS, MEMBERS, CENTROIDS)))
            return
        known = table.members(number).filter("role <> 'single'").select(F.col("content_item_id").alias("id"))
        new = batch.filter(~F.coalesce(F.col("source_type").isin(*skip), F.lit(False))).dropDuplicates(["id"]).join(known, "id", "left_anti")
        now = table.clusters(number)
        out = settled(events.cluster_new(new, now, as_of, patterns, days, least, leader_importance), "assigned")
        own = (F.col("leader") + first_id).cast("long")
        members = out.select(F.coalesce(F.col("cluster"), own).alias("event_cluster_id"), F.col("id").alias("content_item_id"), F.when(F.col("role") == "leader", 1.0).otherwise(F.col("score")).alias("score"), "role")
        counts = members.filter("event_cluster_id is not null").groupBy(F.col("event_cluster_id").alias("id")).agg(F.count(F.lit(1)).alias("_added"))
        time = F.lit(as_of).cast("timestamp_ntz")
        grown = now.join(counts, "id").select("id", "event_title", "category", "first_seen_at", F.greatest("last_updated_at", time).alias("last_updated_at"), (F.col("article_count") + F.col("_added")).alias("article_count"))
        born = new.join(out.filter("role = 'leader'").select("id"), "id").select((F.col("id") + first_id).alias("id"), events.event_title(F.col("title")).alias("event_title"), F.coalesce("category", F.lit(OTHER_CATEGORY)).alias("category"), F.col("published_at").cast("timestamp_ntz").alias("first_seen_at"), time.alias("last_updated_at"))
        born = born.join(counts, "id").select("*", F.col("_added").alias("article_count")).drop("_added")
        centroids = spark.createDataFrame([], CENTROIDS)
        if embeddings is not None:
            added = members.filter("event_cluster_id is not null")
            touched = table.centroids(number).join(counts.select(F.col("id").alias("event_cluster_id")), "event_cluster_id", "left_semi")
            centroids = vectors.update_centroids(touched, added, embeddings)
        table.commit(number, grown.unionByName(born), members, centroids)

    return run
