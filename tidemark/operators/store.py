"""Idempotent writes expressed as joins between what is there and what comes."""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table under a fixed schema; columns that older files lack are null."""
    return spark.read.schema(schema).parquet(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "append") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_new(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """existing plus the incoming rows with new keys; of incoming rows with one key the first by `order`."""
    first = Window.partitionBy(*keys).orderBy(order)
    new = incoming.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return existing.unionByName(new.join(existing.select(*keys), keys, "left_anti").select(*existing.columns))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """Rows by key; incoming replaces existing, the last incoming row by `order` wins."""
    last = Window.partitionBy(*keys).orderBy(F.desc(order))
    new = incoming.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
    return existing.join(new.select(*keys), keys, "left_anti").select(*existing.columns).unionByName(new.select(*existing.columns))


def update_where(df: DataFrame, keys: DataFrame, assignments: dict[str, Column], on: str = "id") -> DataFrame:
    """Sets columns in the rows whose key is in `keys`."""
    marked = df.join(keys.select(F.col(on)).distinct().withColumn("_hit", F.lit(True)), on, "left")
    return marked.select(*((F.when(F.col("_hit"), assignments[c]).otherwise(F.col(c)) if c in assignments else F.col(c)).alias(c) for c in df.columns))


def delete_cascade(tables: dict[str, tuple[DataFrame, str]], parents: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table (frame, its foreign key) without the rows of the parents."""
    return {name: df.join(parents.select(F.col(key).alias(fk)), fk, "left_anti") for name, (df, fk) in tables.items()}


def above_cursor(incoming: DataFrame, cursors: DataFrame, key: str, position: str) -> tuple[DataFrame, DataFrame]:
    """Rows beyond each key's cursor, and the advanced cursors (key, last)."""
    new = incoming.join(cursors, key, "left").filter(F.col("last").isNull() | (F.col(position) > F.col("last"))).drop("last")
    moved = new.groupBy(key).agg(F.max(position).alias("last")).unionByName(cursors)
    return new, moved.groupBy(key).agg(F.max("last").alias("last"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, which is one process, may leave it unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: what several branches of a plan read is computed once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class VersionedTable:
    """A keyed table at a path whose writes commit as a whole. Rows are dealt by their keys' hash into buckets; a version is a list that
    names a folder for each bucket, in one small file that appears at once and is written last. A write makes new folders for the buckets
    whose rows change and names the old ones for the rest, so a lost run leaves the version before it in force, one that
    changes nothing commits nothing, and readers of a version are not disturbed. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, buckets: int = 64):
        self.spark, self.path, self.keys, self.schema, self.buckets = spark, path.rstrip("/"), keys, schema, buckets
        self.empty = spark.createDataFrame([], schema)
        self.empty.select(F.lit("").alias("version"), F.lit(0).alias("bucket"), F.lit("").alias("folder")).write.mode("append").parquet(f"{self.path}/commits")

    def _commits(self) -> DataFrame:
        return self.spark.read.schema("version string, bucket int, folder string").parquet(f"{self.path}/commits")

    def versions(self) -> list[str]:
        return sorted(r[0] for r in self._commits().select("version").distinct().collect())

    def version(self) -> str | None:
        return self._commits().agg(F.max("version")).first()[0]

    def folders(self, version: str | None) -> dict[int, str]:
        """Folder by bucket; buckets without rows are missing."""
        rows = self._commits().filter((F.col("version") == version) & (F.col("folder") != "")) if version else None
        return {r["bucket"]: r["folder"] for r in rows.collect()} if version else {}

    def _rows(self, folders: dict[int, str]) -> DataFrame:
        paths = [f"{self.path}/data/{f}/bucket={b}" for b, f in folders.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.empty

    def read(self, version: str | None = None) -> DataFrame:
        return self._rows(self.folders(version or self.version()))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _write(self, base: dict[int, str], hit: list[int], rows: DataFrame) -> str:
        """Commit the buckets `hit` as `rows` and the others as they are in `base`."""
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        target = f"{self.path}/data/{name}"
        rows.withColumn("bucket", self._bucket()).write.partitionBy("bucket").parquet(target)
        full = {r[0] for r in self.spark.read.schema(f"{self.schema}, bucket int").parquet(target).select("bucket").distinct().collect()}
        now = {b: f for b, f in base.items() if b not in hit} | {b: name for b in hit if b in full}
        listed = [(name, b, f) for b, f in now.items()] or [(name, 0, "")]
        self.spark.createDataFrame(listed, "version string, bucket int, folder string").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return name

    def _hit(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self._bucket()).distinct().collect()]  # as many as buckets at most

    def upsert(self, incoming: DataFrame, order: str) -> None:
        """Rows by key: incoming ones replace, the last by `order` wins; what is there already changes nothing."""
        base = self.folders(self.version())
        last = Window.partitionBy(*self.keys).orderBy(F.desc(order))
        new = settled(incoming.select(*self.empty.columns).withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n"), "incoming")
        near = self._rows({b: f for b, f in base.items() if b in self._hit(new)})
        changed = settled(new.subtract(near), "changed")
        if hit := self._hit(changed):
            old = self._rows({b: f for b, f in base.items() if b in hit})
            self._write(base, hit, old.join(changed.select(*self.keys), self.keys, "left_anti").select(*self.empty.columns).unionByName(changed))

    def append_new(self, incoming: DataFrame, order: str) -> None:
        """Rows with keys that are not there; of several with one key the first by `order`."""
        base = self.folders(self.version())
        first = Window.partitionBy(*self.keys).orderBy(order)
        rows = settled(incoming.select(*self.empty.columns).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n"), "incoming")
        near = self._rows({b: f for b, f in base.items() if b in self._hit(rows)})
        new = settled(rows.join(near.select(*self.keys), self.keys, "left_anti").select(*self.empty.columns), "new")
        if hit := self._hit(new):
            self._write(base, hit, self._rows({b: f for b, f in base.items() if b in hit}).unionByName(new))

    def delete(self, keys: DataFrame) -> None:
        """Without the rows of the keys given."""
        base = self.folders(self.version())
        gone = settled(keys.select(*self.keys).distinct(), "keys")
        near = {b: f for b, f in base.items() if b in self._hit(gone)}
        if hit := self._hit(self._rows(near).join(gone, self.keys, "left_semi")):
            self._write(base, hit, self._rows({b: f for b, f in base.items() if b in hit}).join(gone, self.keys, "left_anti").select(*self.empty.columns))

    def compact(self, keep: int = 1) -> None:
        """Forget all versions but the last `keep`; folders that no version names any more are deleted."""
        versions = self.versions()[-keep:]
        kept = settled(self._commits().filter(F.col("version").isin(versions)), "commits")
        named = {r[0] for r in kept.select("folder").distinct().collect()}
        kept.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits")
        jvm = self.spark.sparkContext._jvm
        data = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        files = data.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for status in files.listStatus(data):
            if status.getPath().getName() not in named and status.getPath().getName() < versions[-1]:
                files.delete(status.getPath(), True)


def write_report(parts: dict[str, DataFrame], path: str, form: str = "parquet") -> str:
    """Every part of a report as its own table under a new version, which counts only when its name stands under versions/: that
    is written last, so a lost run leaves the version before it in force. The version's name."""
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    for name, df in parts.items():
        df.write.format(form).save(f"{path}/{version}/{name}")
    spark = next(iter(parts.values())).sparkSession
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return version


def read_report(spark: SparkSession, path: str, name: str, form: str = "parquet") -> DataFrame:
    """A part of the latest whole version of a report."""
    version = spark.read.parquet(f"{path}/versions").agg(F.max("version")).first()[0]
    return spark.read.format(form).load(f"{path}/{version}/{name}")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
