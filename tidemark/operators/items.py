"""Filters, joins and rankings over content items. Every ranking ends with the id, so results don't depend on the layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ts(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def ago(as_of: str, days: float = 0, hours: float = 0) -> Column:
    return ts(as_of) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(days * 86400 + hours * 3600)))


def top(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    df = df.orderBy(*order)
    return df.limit(limit) if limit is not None else df


def newest(*keys: str) -> list[Column]:
    return [F.desc_nulls_last(k) for k in keys] + [F.asc("id")]


def undelivered(items: DataFrame, min_importance: int = 1, limit: int | None = 50) -> DataFrame:
    return top(items.filter(F.col("processed") & ~F.col("delivered") & (F.col("importance_score") >= min_importance)), newest("importance_score", "published_at"), limit)


def browse_by_date(items: DataFrame, date: str, category: str | None = None, limit: int | None = 50) -> DataFrame:
    day = ts(date)
    out = items.filter((F.col("published_at") >= day) & (F.col("published_at") < ago(date, days=-1)))
    if category is not None:
        out = out.filter(F.col("category") == category)
    return top(out, newest("importance_score", "published_at"), limit)


def by_state(items: DataFrame, state: str) -> DataFrame:
    """Missing states count as unread."""
    return items.filter(F.coalesce("state", F.lit("unread")) == state)


def recent_clusters(clusters: DataFrame, as_of: str, days: int = 3, category: str | None = None, limit: int | None = None) -> DataFrame:
    out = clusters.filter(F.col("last_updated_at") >= ago(as_of, days))
    if category is not None:
        out = out.filter(F.col("category") == category)
    return top(out, newest("last_updated_at"), limit)


def action_list(actions: DataFrame, status: str | None = None, priority: str | None = None, limit: int | None = 50, ranks: tuple[str, ...] = ("low", "mid", "high")) -> DataFrame:
    """Ordered by the priority's place in `ranks`, then newest first."""
    out = actions
    if status is not None:
        out = out.filter(F.col("status") == status)
    if priority is not None:
        out = out.filter(F.col("priority") == priority)
    place = F.array_position(F.array(*(F.lit(r) for r in ranks)), F.col("priority"))
    return top(out, [place.asc(), *newest("created_at")], limit)


def suggestion_list(suggestions: DataFrame, status: str | None = None, limit: int | None = 20) -> DataFrame:
    if status is None:
        return top(suggestions, newest("suggested_at"), limit)
    return top(suggestions.filter(F.col("status") == status), [F.desc(F.col("confidence") * F.col("frequency")), F.asc("id")], limit)


def unclustered(items: DataFrame, members: DataFrame, as_of: str, min_importance: int = 5, retry_hours: int = 24, limit: int | None = 100) -> DataFrame:
    free = (F.col("cluster_attempted_at").isNull()) | (F.col("cluster_attempted_at") < ago(as_of, hours=retry_hours))
    todo = items.filter(F.col("processed") & (F.col("importance_score") >= min_importance) & free)
    return top(todo.join(members.select(F.col("content_item_id").alias("id")), "id", "left_anti"), newest("importance_score", "published_at"), limit)


def members_of(items: DataFrame, members: DataFrame) -> DataFrame:
    return members.join(items, members["content_item_id"] == items["id"]).drop("content_item_id")


def delivered_clusters(clusters: DataFrame, members: DataFrame, items: DataFrame, date: str) -> DataFrame:
    sent = items.filter((F.col("delivered_at") >= ts(date)) & (F.col("delivered_at") < ago(date, days=-1)))
    hit = members.join(sent.select(F.col("id").alias("content_item_id")), "content_item_id", "left_semi")
    return clusters.join(hit, clusters["id"] == hit["event_cluster_id"], "left_semi")


def _digest_pool(items: DataFrame, min_importance: int, as_of: str, include_today: bool) -> DataFrame:
    fresh = ~F.col("delivered")
    if include_today:
        fresh = fresh | ((F.col("delivered_at") >= ts(as_of)) & (F.col("delivered_at") < ago(as_of, days=-1)))
    return items.filter(F.col("processed") & (F.col("importance_score") >= min_importance) & fresh)


def digest_members(items: DataFrame, members: DataFrame, min_importance: int, as_of: str, include_today: bool = False, limit: int | None = None) -> DataFrame:
    pool = _digest_pool(items, min_importance, as_of, include_today)
    joined = pool.join(members.select("event_cluster_id", F.col("content_item_id").alias("id")), "id")
    return top(joined, [*newest("importance_score", "published_at"), F.asc("event_cluster_id")], limit)


def digest_singles(items: DataFrame, members: DataFrame, min_importance: int, as_of: str, include_today: bool = False, limit: int | None = None) -> DataFrame:
    pool = _digest_pool(items, min_importance, as_of, include_today)
    return top(pool.join(members.select(F.col("content_item_id").alias("id")), "id", "left_anti"), newest("importance_score", "published_at"), limit)


def topic_content(items: DataFrame, content_topics: DataFrame, min_relevance: float, limit: int) -> DataFrame:
    """The best items of every topic."""
    hits = content_topics.filter(F.col("relevance") >= min_relevance).join(items.withColumnRenamed("id", "content_id"), "content_id")
    order = Window.partitionBy("topic_id").orderBy(F.desc("relevance"), F.desc("published_at"), "content_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def missing_embeddings(items: DataFrame, embeddings: DataFrame, limit: int | None = None) -> DataFrame:
    return top(items.join(embeddings.select(F.col("content_id").alias("id")), "id", "left_anti"), newest("published_at"), limit)


def embedded_items(items: DataFrame, embeddings: DataFrame, since: str, limit: int | None = None) -> DataFrame:
    recent = items.filter(F.col("processed") & (F.col("published_at") >= ts(since)))
    return top(recent.join(embeddings.withColumnRenamed("content_id", "id"), "id"), newest("published_at"), limit)


def reuse_results(work: DataFrame, cache: DataFrame, as_of: str) -> DataFrame:
    """Work rows (content_hash) whose result is in the cache and has not expired."""
    return work.join(cache.filter(F.col("expires_at") > ts(as_of)), "content_hash")


def ingest_dedup(existing: DataFrame, incoming: DataFrame, url_key: Column | None = None) -> DataFrame:
    """Incoming rows whose source id and URL (raw or by url_key) are new."""
    known = existing.filter("url is not null")
    out = incoming.join(existing.select("source_type", "external_id").distinct(), ["source_type", "external_id"], "left_anti")
    seen = known.select(F.col("url").alias("_u")).distinct()
    out = out.join(seen, out["url"] == seen["_u"], "left_anti")
    if url_key is not None:
        keyed = known.select(url_key.alias("_k")).filter("_k <> ''").distinct()
        out = out.withColumn("_key", url_key)
        out = out.join(keyed, out["_key"] == keyed["_k"], "left_anti").drop("_key")
    return out


def page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def recent_content(parts: list[DataFrame], as_of: str, days: int) -> DataFrame:
    """Union of item sets, each item once, of the last days."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.col("published_at") >= ago(as_of, days)).dropDuplicates(["id"])


def build_digest(items: DataFrame, members: DataFrame, min_importance: int, as_of: str, max_items: int = 30) -> DataFrame:
    """Events (one row each, counted as heavy) and single items compete for max_items by (heavy, importance)."""
    events = digest_members(items, members, min_importance, as_of).groupBy("event_cluster_id").agg(
        F.max("importance_score").alias("importance_score"), F.count(F.lit(1)).alias("articles"), F.min_by("title", F.struct(-F.col("importance_score"), "id")).alias("title"), F.min_by("category", F.struct(-F.col("importance_score"), "id")).alias("category")
    )
    events = events.select(F.lit(True).alias("is_event"), F.col("event_cluster_id").alias("id"), "title", "category", "importance_score", "articles", F.lit(True).alias("heavy"))
    singles = digest_singles(items, members, min_importance, as_of)
    singles = singles.select(F.lit(False).alias("is_event"), "id", "title", "category", "importance_score", F.lit(1).cast("long").alias("articles"), (F.col("summary").isNotNull() & (F.length("summary") >= 200)).alias("heavy"))
    return top(events.unionByName(singles), [F.desc("heavy"), F.desc("importance_score"), F.desc("is_event"), F.asc("id")], max_items)


def by_category(digest: DataFrame) -> DataFrame:
    order = Window.partitionBy("category").orderBy(F.desc("is_event"), F.desc("heavy"), F.desc("importance_score"), "id")
    return digest.withColumn("rank", F.row_number().over(order))


def section_topk(digest: DataFrame, section: Column, k: int) -> DataFrame:
    order = Window.partitionBy("section").orderBy(F.desc("importance_score"), "id")
    return digest.withColumn("section", section).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
