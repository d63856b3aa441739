"""Documents' ids as long numbers in the ids' own order, whatever their type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .sharding import numbered

NULL_ID = -(2**63)
WHOLE = ("tinyint", "smallint", "int", "bigint")


def as_long(docs: DataFrame, *columns: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """(doc_id as long without nulls, the columns named; restore(df, names) that turns such ids back into the type given).

    Null ids become NULL_ID, below all others. Whole numbers stay as they are; ids of any other type are numbered in their
    order, for which documents meet the numbers by a join."""
    kind = dict(docs.dtypes)["doc_id"]
    if kind in WHOLE:
        out = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), *columns)
        return out, lambda df, *names: df.withColumns({n: F.nullif(F.col(n), F.lit(NULL_ID)).cast(kind) for n in names})
    known, _ = numbered(docs.select("doc_id").filter("doc_id is not null").distinct(), ["doc_id"], "number")
    known = stored(known.select(F.col("doc_id").alias("own_id"), "number"), "numbered-ids")
    met = docs.select("doc_id", *columns).join(known, F.col("doc_id") == F.col("own_id"), "left")

    def restore(df: DataFrame, *names: str) -> DataFrame:
        for n in names:
            back = known.select(F.col("number").alias("_number"), F.col("own_id").alias("_own"))
            df = df.join(back, F.col(n) == F.col("_number"), "left").withColumn(n, F.col("_own")).drop("_number", "_own")
        return df

    return met.select(F.coalesce("number", F.lit(NULL_ID)).alias("doc_id"), *columns), restore
