"""Duplicate groups and near-title joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .items import ago
from .store import settled


def exact_duplicates(items: DataFrame, key) -> DataFrame:
    """(key, keep, n) of keys that stand more than once; the latest id stays."""
    return items.withColumn("key", key).filter("key is not null").groupBy("key").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1")


#: A title of SHORT characters (first and last) is a start by itself; longer ones have one of LONG characters. Shorter ones are equal or nothing.
SHORT, LONG = (21, 49), 50


def similar_titles(items: DataFrame, existing: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """(id, match): for each item the newest other item of the last days whose normalised title is equal, or one of the two
    starts with the first 50 characters of the other (both over 20). Ids are unique. Titles that are null or empty have no match;
    of equal dates the largest id counts.

    That is: titles of up to 20 characters are equal, those of 50 or more have equal first 50, and one of 21 to 49 is a start of the
    other. For the last, the lengths at which titles of 21 to 49 characters stand are gathered for each start of 21 characters, so
    a title asks only at lengths where such a title may be (29 at most). Of each key only the two newest items matter (one may be
    the item itself), and these are cut inside tasks before they move: a common title or start yields two rows, not all pairs."""
    size = F.length("t")
    name = lambda df: df.select("id", "published_at", X.normalize_title(F.col("title")).alias("t")).filter("t <> ''")
    recent = existing.filter(F.col("published_at") >= ago(as_of, days))
    short = name(items).unionByName(name(recent)).filter(size.between(*SHORT))
    lengths = settled(short.select(F.substring("t", 1, SHORT[0]).alias("head"), size.alias("n")).distinct().groupBy("head").agg(F.sort_array(F.collect_list("n")).alias("ns")), "title-lengths")

    def keyed(df: DataFrame, own: str, others: str) -> DataFrame:
        """Rows of df by kind and key: its own key under `own` and its starts under `others`."""
        tag = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
        full = F.when(size < SHORT[0], tag("equal", F.col("t"))).when(size < LONG, tag(own, F.col("t"))).otherwise(tag("long", F.substring("t", 1, LONG)))
        starts = F.transform(F.filter(F.coalesce("ns", F.array().cast("array<int>")), lambda n: n <= size), lambda n: tag(others, F.substr("t", F.lit(1), n)))
        known = df.withColumn("head", F.when(size >= SHORT[0], F.substring("t", 1, SHORT[0]))).join(lengths, "head", "left")
        keys = F.explode(F.concat(F.array(full), starts)).alias("k")
        return known.select(*(c for c in df.columns if c != "t"), keys).select(*(c for c in df.columns if c != "t"), "k.*")

    newest = Window.partitionBy("kind", "key").orderBy(F.desc("at"), F.desc("other"))
    # a short title of existing answers as "end" and one of items asks as "begin"; the starts of either meet the short ones of the other
    right = keyed(name(recent).select(F.col("id").alias("other"), F.col("published_at").alias("at"), "t"), "end", "begin")
    right = right.withColumn("n", F.row_number().over(newest)).filter("n <= 2").drop("n")
    left = keyed(name(items).select("id", "t"), "begin", "end")
    met = left.join(right, ["kind", "key"]).filter(F.col("id") != F.col("other"))
    return met.groupBy("id").agg(F.max_by("other", F.struct("at", "other")).alias("match"))


def prefilter(items: DataFrame, matches: DataFrame) -> DataFrame:
    """items (with skip_reason) with route: skip, reuse (a similar item's result, by matches(id, match)), or process."""
    joined = items.join(matches, "id", "left")
    route = F.when(F.col("skip_reason").isNotNull(), "skip").when(F.col("match").isNotNull(), "reuse").otherwise("process")
    return joined.withColumn("route", route)


def prefilter_stats(routed: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return routed.groupBy("route", "skip_reason").agg(n.alias("n"))
