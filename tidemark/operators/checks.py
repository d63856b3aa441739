"""Data-quality checks: each gives its offending rows; validate() counts them in one table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .items import top, ts
from .stats import dedup_memberships
from .store import union_all


def unknown_subscription(t) -> DataFrame:
    return t.items.join(t.subscriptions.select(F.col("id").alias("subscription_id")), "subscription_id", "left_anti").select("id")


def duplicate_keys(t) -> DataFrame:
    return t.items.groupBy("source_type", "external_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def without_summary(t) -> DataFrame:
    return t.items.filter(F.col("processed") & F.col("summary").isNull()).select("id")


def bad_importance(t) -> DataFrame:
    return t.items.filter("importance_score < 1 or importance_score > 10").select("id", "importance_score")


def empty_clusters(t) -> DataFrame:
    return t.clusters.join(t.members.select(F.col("event_cluster_id").alias("id")), "id", "left_anti").select("id")


def wrong_counts(t) -> DataFrame:
    actual = t.members.groupBy(F.col("event_cluster_id").alias("id")).agg(F.count(F.lit(1)).alias("actual"))
    both = t.clusters.join(actual, "id", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return both.filter("actual <> article_count").select("id", "article_count", "actual")


def lost_members(t) -> DataFrame:
    no_cluster = t.members.join(t.clusters.select(F.col("id").alias("event_cluster_id")), "event_cluster_id", "left_anti")
    no_item = t.members.join(t.items.select(F.col("id").alias("content_item_id")), "content_item_id", "left_anti")
    cols = ["event_cluster_id", "content_item_id"]
    return no_cluster.select(*cols, F.lit("cluster").alias("missing")).unionByName(no_item.select(*cols, F.lit("item").alias("missing")))


def unindexed(t, index: DataFrame | None = None) -> DataFrame:
    index = index if index is not None else t.items.filter("summary is not null").select("id")
    return t.items.filter("processed").join(index.select("id").distinct(), "id", "left_anti").select("id")


def double_members(t) -> DataFrame:
    return t.members.groupBy("content_item_id").agg(F.countDistinct("event_cluster_id").alias("clusters")).filter("clusters > 1")


def lost_actions(t) -> DataFrame:
    return t.actions.filter("content_item_id is not null").join(t.items.select(F.col("id").alias("content_item_id")), "content_item_id", "left_anti").select("id", "content_item_id")


def lost_topics(t) -> DataFrame:
    topics = t.topics.select(F.col("topic_id").cast("long").alias("topic_id")).distinct()
    links = t.content_topics.join(topics, "topic_id", "left_anti").groupBy("topic_id").agg(F.count(F.lit(1)).alias("n")).withColumn("table", F.lit("content_topics"))
    shots = t.topic_snapshots.join(topics, "topic_id", "left_anti").groupBy("topic_id").agg(F.count(F.lit(1)).alias("n")).withColumn("table", F.lit("topic_snapshots"))
    return links.unionByName(shots)


def expired_cache(t, as_of: str) -> DataFrame:
    return t.cache.filter(F.col("expires_at") <= ts(as_of)).select("content_hash")


def recently_clustered(t, limit: int = 50) -> DataFrame:
    joined = t.members.join(t.items, t.members["content_item_id"] == t.items["id"]).join(t.clusters.select(F.col("id").alias("event_cluster_id"), "event_title"), "event_cluster_id")
    return top(joined.select("id", "event_cluster_id", "event_title", "published_at"), [F.desc("published_at"), F.asc("id"), F.asc("event_cluster_id")], limit)


#: check, what a finding means, whether it can be mended.
CHECKS: list[tuple[str, Callable, str, bool]] = [
    ("unknown_subscription", unknown_subscription, "fail", False),
    ("duplicate_keys", duplicate_keys, "warn", False),
    ("without_summary", without_summary, "warn", False),
    ("bad_importance", bad_importance, "fail", False),
    ("empty_clusters", empty_clusters, "fail", True),
    ("wrong_counts", wrong_counts, "fail", True),
    ("lost_members", lost_members, "fail", False),
    ("unindexed", unindexed, "warn", True),
    ("double_members", double_members, "fail", True),
    ("lost_actions", lost_actions, "warn", False),
    ("lost_topics", lost_topics, "warn", False),
]


def validate(t, as_of: str) -> DataFrame:
    """check, status, issues, can_fix: one row for each check."""
    parts = []
    for name, check, kind, fix in [*CHECKS, ("expired_cache", lambda x: expired_cache(x, as_of), "warn", True)]:
        issues = check(t).agg(F.count(F.lit(1)).alias("issues"))
        status = F.when(F.col("issues") == 0, "pass").otherwise(kind)
        parts.append(issues.select(F.lit(name).alias("check"), status.alias("status"), "issues", F.lit(fix).alias("can_fix")))
    return union_all(parts)


def fix_counts(t) -> DataFrame:
    """Clusters with members only, and their true counts."""
    actual = dedup_memberships(t.members).groupBy(F.col("event_cluster_id").alias("id")).agg(F.count(F.lit(1)).alias("article_count"))
    return t.clusters.drop("article_count").join(actual, "id")
