"""Counts, rates and reports: one aggregation pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .items import ago, top, ts
from .store import settled

#: US dollars for a million input and output tokens.
PRICES = [("haiku", 0.25, 1.25), ("sonnet", 3.0, 15.0), ("opus", 15.0, 75.0)]


def n(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def between(column: str, start: str, end: str) -> Column:
    return (F.col(column) >= ts(start)) & (F.col(column) <= ts(end))


def category_stats(items: DataFrame) -> DataFrame:
    return items.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def state_stats(items: DataFrame) -> DataFrame:
    return items.groupBy(F.coalesce("state", F.lit("unread")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


def content_stats(items: DataFrame) -> DataFrame:
    return items.agg(F.count(F.lit(1)).alias("total"), n(F.col("processed")).alias("processed"), n(F.col("delivered")).alias("delivered"), F.round(F.avg("importance_score"), 2).alias("avg_importance"))


def cluster_stats(clusters: DataFrame) -> DataFrame:
    return clusters.agg(F.count(F.lit(1)).alias("clusters"), F.sum("article_count").alias("members"), F.round(F.avg("article_count"), 2).alias("avg_members"))


def cache_stats(cache: DataFrame, as_of: str) -> DataFrame:
    valid = F.col("expires_at") > ts(as_of)
    return cache.agg(F.count(F.lit(1)).alias("entries"), n(valid).alias("valid"), n(~valid).alias("expired"), F.min(F.when(valid, F.col("created_at"))).alias("oldest"), F.max(F.when(valid, F.col("created_at"))).alias("newest"))


def cache_report(cache: DataFrame, as_of: str) -> DataFrame:
    """Utilisation, estimated size (500 bytes an entry) and advice."""
    s = cache_stats(cache, as_of)
    rate = F.coalesce(F.try_divide(F.col("valid") * 100.0, F.col("entries")), F.lit(0.0))
    expired = F.coalesce(F.try_divide(F.col("expired") * 100.0, F.col("entries")), F.lit(0.0))
    advice = F.array_compact(F.array(F.when(expired > 30, "clean up expired entries"), F.when(rate < 50, "raise the time to live"), F.when(F.col("entries") == 0, "cache is empty")))
    return s.select("entries", "valid", "expired", F.round(rate, 1).alias("utilisation"), F.round(F.col("valid") * 500 / 1024, 2).alias("size_kb"), F.array_join(advice, "; ").alias("advice"))


def deliveries_by_day(items: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    sent = items.filter(F.col("delivered") & (F.col("delivered_at") >= ago(as_of, days)))
    return sent.groupBy(F.to_date("delivered_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def attempt_stats(items: DataFrame) -> DataFrame:
    pool = items.filter(F.col("processed") & ~F.col("delivered"))
    tried = F.col("cluster_attempted_at").isNotNull()
    return pool.agg(n(tried).alias("attempted"), n(~tried).alias("never"))


def embedding_stats(items: DataFrame, embeddings: DataFrame, centroids: DataFrame) -> DataFrame:
    total = items.agg(F.count(F.lit(1)).alias("items"))
    have = embeddings.select("content_id").distinct().join(items, F.col("content_id") == items["id"], "left_semi").agg(F.count(F.lit(1)).alias("embedded"))
    middle = centroids.agg(F.count(F.lit(1)).alias("centroids"))
    one = total.withColumn("k", F.lit(1)).join(have.withColumn("k", F.lit(1)), "k").join(middle.withColumn("k", F.lit(1)), "k")
    return one.select("items", "embedded", "centroids", F.round(F.coalesce(F.try_divide(F.col("embedded") * 100.0, F.col("items")), F.lit(0.0)), 1).alias("coverage"))


def usage_by_type(usage: DataFrame, since: str) -> DataFrame:
    """Tokens are those of calls that the cache didn't answer."""
    fresh = ~F.col("cached")
    return usage.filter(F.col("timestamp") >= ts(since)).groupBy("call_type").agg(
        F.count(F.lit(1)).alias("calls"), n(F.col("cached")).alias("cached"), F.sum(F.when(fresh, F.col("input_tokens")).otherwise(0)).alias("input_tokens"), F.sum(F.when(fresh, F.col("output_tokens")).otherwise(0)).alias("output_tokens")
    )


def usage_totals(usage: DataFrame, since: str) -> DataFrame:
    fresh = ~F.col("cached")
    return usage.filter(F.col("timestamp") >= ts(since)).agg(
        F.count(F.lit(1)).alias("calls"), n(F.col("cached")).alias("cached"), n(~F.col("success")).alias("errors"),
        F.sum(F.when(fresh, F.col("input_tokens")).otherwise(0)).alias("input_tokens"), F.sum(F.when(fresh, F.col("output_tokens")).otherwise(0)).alias("output_tokens"),
        F.round(F.coalesce(F.try_divide(n(F.col("cached")) * 100.0, F.count(F.lit(1))), F.lit(0.0)), 1).alias("hit_rate"),
    )


def usage_cost(usage: DataFrame, since: str, prices: list[tuple] = PRICES) -> DataFrame:
    """What the tokens would cost at each model's prices (a short list)."""
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(a).alias("a"), F.lit(b).alias("b")) for m, a, b in prices))).alias("p")
    cost = (F.col("input_tokens") * F.col("p.a") + F.col("output_tokens") * F.col("p.b")) / 1e6
    return usage_totals(usage, since).select("input_tokens", "output_tokens", rows).select("p.model", F.round(cost, 6).alias("cost"))


def cluster_rollup(members: DataFrame, items: DataFrame) -> DataFrame:
    joined = members.select("event_cluster_id", F.col("content_item_id").alias("id")).join(items, "id")
    best = F.struct(F.coalesce("importance_score", F.lit(0)), -F.col("id"))
    return joined.groupBy("event_cluster_id").agg(
        F.min("published_at").alias("first_seen_at"), F.max("published_at").alias("last_updated_at"), F.count(F.lit(1)).alias("article_count"), F.max("importance_score").alias("max_importance"),
        F.array_join(F.array_sort(F.collect_set("source_type")), ",").alias("sources"), F.max_by("id", best).alias("representative"), F.max_by("title", best).alias("title"),
    )


def event_timeline(members: DataFrame, items: DataFrame, titles: int = 3) -> DataFrame:
    """Per cluster and day: articles and the first titles by importance."""
    joined = members.select("event_cluster_id", F.col("content_item_id").alias("id")).join(items, "id").withColumn("day", F.to_date("published_at"))
    order = Window.partitionBy("event_cluster_id", "day").orderBy(F.desc_nulls_last("importance_score"), "id")
    ranked = joined.withColumn("_n", F.row_number().over(order))
    heads = F.array_sort(F.collect_list(F.when(F.col("_n") <= titles, F.struct("_n", "title"))))
    return ranked.groupBy("event_cluster_id", "day").agg(F.count(F.lit(1)).alias("articles"), F.array_join(F.transform(heads, lambda x: x["title"]), " | ").alias("titles"))


def event_heat(clusters: DataFrame, rollup: DataFrame, as_of: str, recency: bool = True) -> DataFrame:
    joined = clusters.join(rollup.select("event_cluster_id", "max_importance"), F.col("id") == F.col("event_cluster_id"), "left")
    hours = (F.unix_seconds(ts(as_of).cast("timestamp")) - F.unix_seconds(F.col("last_updated_at").cast("timestamp"))) / 3600.0
    heat = F.col("article_count") * 2 + F.coalesce("max_importance", F.lit(0)) + (F.greatest(F.lit(0.0), 5 - hours / 12) if recency else F.lit(0.0))
    return joined.select("id", F.round(heat, 4).alias("heat"))


def period_summary(items: DataFrame, start: str, end: str) -> DataFrame:
    pool = items.filter(between("published_at", start, end) & F.col("processed"))
    return pool.groupBy(F.coalesce("category", F.lit("未分类")).alias("category")).agg(F.count(F.lit(1)).alias("items"), n(F.col("importance_score") >= 7).alias("important"))


def action_review(actions: DataFrame, start: str, end: str) -> DataFrame:
    done = n(F.col("status") == "done")
    total = F.count(F.lit(1))
    return actions.filter(between("created_at", start, end)).agg(
        total.alias("created"), done.alias("done"), n(F.col("status") == "pending").alias("pending"), n(F.col("status") == "dismissed").alias("dismissed"), F.round(F.coalesce(F.try_divide(done * 100.0, total), F.lit(0.0)), 1).alias("completion")
    )


def top_events(clusters: DataFrame, start: str, end: str, k: int = 10) -> DataFrame:
    return top(clusters.filter(between("last_updated_at", start, end)), [F.desc("article_count"), F.asc("id")], k)


def order_events(clusters: DataFrame, rollup: DataFrame, priority: tuple[str, ...]) -> DataFrame:
    """Priority categories first, then by articles and importance; `place` is the rank."""
    joined = clusters.join(rollup.select("event_cluster_id", "max_importance"), F.col("id") == F.col("event_cluster_id"), "left")
    first = F.when(F.col("category").isin(*priority), 0).otherwise(1)
    order = [F.asc("first"), F.desc("article_count"), F.desc_nulls_last("max_importance"), F.asc("id")]
    ranked, _ = numbered(joined.withColumn("first", first).drop("event_cluster_id"), order, "place")
    return ranked.withColumn("place", F.col("place") + 1).orderBy("place")


def numbered(df: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """df with gapless numbers from 0 in the given order, and how many there are; one count for each partition reaches the driver."""
    spark = df.sparkSession
    at = F.monotonically_increasing_id()
    laid = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    laid = settled(laid.select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND((1 << 33) - 1).alias("_row")), "numbered")
    first, total = [], 0
    for part, n in sorted(map(tuple, laid.groupBy("_part").count().collect())):
        first.append((part, total))
        total += n
    offsets = spark.createDataFrame(first, "_part long, _first long")
    return laid.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_first") + F.col("_row")).drop("_part", "_row", "_first"), total


def topic_changes(snapshots: DataFrame) -> DataFrame:
    """The latest two snapshots of each topic and the change between them in per cent."""
    order = Window.partitionBy("topic_id").orderBy(F.desc("snapshot_date"))
    both = snapshots.withColumn("_n", F.row_number().over(order)).withColumn("previous", F.lead("article_count").over(order)).filter("_n = 1 and previous is not null")
    change = F.when(F.col("previous") == 0, 100.0).otherwise((F.col("article_count") - F.col("previous")) * 100.0 / F.col("previous"))
    return both.select("topic_id", "article_count", "previous", F.round(change, 2).alias("change"))


def dedup_memberships(members: DataFrame) -> DataFrame:
    order = Window.partitionBy("content_item_id").orderBy(F.desc("similarity_score"), "event_cluster_id")
    return members.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def week_bounds(as_of: Column, back: int = 0) -> tuple[Column, Column]:
    start = F.date_trunc("week", as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(7 * back))
    return start, start + F.make_dt_interval(F.lit(7)) - F.make_dt_interval(secs=F.lit(1.0))


def month_bounds(as_of: Column, back: int = 0) -> tuple[Column, Column]:
    start = F.add_months(F.trunc(as_of, "month"), -back)
    return start.cast("timestamp_ntz"), F.add_months(start, 1).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(1.0))
