"""Session helpers of the training-data operators: shared scratch tables and Arrow batch limits."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch that a Python worker holds.
ARROW_ROWS = 2000
ARROW_BYTES = 16 << 20


def tune(spark: SparkSession) -> SparkSession:
    """Bound what a Python worker holds at once; call before building a plan that maps Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; at the end of the task the worker, which Spark keeps, gives its free memory back to the system."""
    yield from batches
    gc.collect()
    give_back()


def give_back() -> None:
    """Free memory of this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps its own counsel
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, which is one process, may leave it unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")  # one process, as in tests
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends here, and a lost executor costs a reread."""
    spark = df.sparkSession
    path = new_path(spark, name)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        writer = df.write.mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a stored() table that no later plan reads."""
    spark = df.sparkSession
    root = shared_dir(spark)
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.startswith(root) or folder.startswith(root.replace("file://", "file:")):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(docs: DataFrame, *names: str) -> DataFrame:
    """docs without columns that an operator's output columns replace."""
    low = {n.lower() for n in names}
    return docs.drop(*(c for c in docs.columns if c.lower() in low))


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df doesn't have."""
    have = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = f"_{stem}"
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
