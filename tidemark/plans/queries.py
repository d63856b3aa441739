"""Queries over the views, by the operators' ids, each with DuckDB SQL for the same result."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import checks, classify, clusters, dedup, events, items, search, stats, store, topics, vectors
from ..operators import rules as R
from ..sources import feeds
from ..streaming import jobs
from .views import AS_OF, Tables, duck

SPARK: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DAY, END = "2024-01-20 00:00:00", "2024-01-31 00:00:00"
START = "2024-01-17 00:00:00"
#: Patterns and rules for these data, whose words are invented and whose hosts are example domains.
WORDS = [r"(erth[a-z]*|heed|qued[a-z]*)", r"(tion[a-z]{2,})"]
HOSTS = [*R.DOMAINS, ("example.com", "技术", "6"), ("example.org", "科学", "8"), ("example.net", "AI", "3")]
Q = lambda x: x.replace("'", "''")


def _edge(p: str) -> str:
    """A pattern whose word boundaries know letters beyond ASCII, as Java's do and RE2's don't."""
    return p.replace(r"\b(", r"(?:^|[^\p{L}\p{N}_])(").replace(r")\b", r")(?:[^\p{L}\p{N}_]|$)")


def add(name: str, run: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    SPARK[name] = run
    if sql is not None:
        ORACLE[name] = duck(sql)


def ids(df: DataFrame, *more: str) -> DataFrame:
    return df.select("id", *more)


TS = lambda x: f"TIMESTAMP '{x}'"
AGO = lambda days: f"{TS(AS_OF)} - to_seconds({int(days * 86400)})"

# -- scans and writes
add("s03_read_table", lambda t: t.items.select("id", "source_type", "published_at", "importance_score"), "SELECT id, source_type, published_at, importance_score FROM items")
add("s04_append_new", lambda t: ids(store.append_new(t.items.filter("id % 3 = 0"), t.items, ["source_type", "external_id"]), "external_id"),
    "WITH old AS (SELECT * FROM items WHERE id % 3 = 0), new AS (SELECT *, row_number() OVER (PARTITION BY source_type, external_id ORDER BY id) AS n FROM items) SELECT id, external_id FROM old UNION ALL SELECT id, external_id FROM new WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM old WHERE old.source_type = new.source_type AND old.external_id = new.external_id)")


def _versioned(t: Tables) -> DataFrame:
    """Two upserts and an append to a table of versions, one of them twice."""
    kind = "external_id string, id long"
    table = store.VersionedTable(t.spark, store.new_path(t.spark, "versioned"), ["external_id"], kind, 16)
    for part in ("id % 3 <> 0", "id % 2 = 0", "id % 2 = 0"):
        table.upsert(t.items.filter(part), "id")
    table.append_new(t.items, "id")
    return table.read()


add("s05_versioned", _versioned, "SELECT external_id, coalesce(max(id) FILTER (WHERE id % 2 = 0), max(id) FILTER (WHERE id % 3 <> 0), min(id)) AS id FROM items GROUP BY 1")
add("s05_upsert_all", lambda t: ids(store.upsert(t.items.filter("id % 3 <> 0"), t.items.filter("id % 2 = 0 or id % 3 = 0"), ["external_id"]), "external_id"),
    "WITH old AS (SELECT * FROM items WHERE id % 3 <> 0), new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY id DESC) AS n FROM items WHERE id % 2 = 0 OR id % 3 = 0) WHERE n = 1) SELECT id, external_id FROM old WHERE external_id NOT IN (SELECT external_id FROM new) UNION ALL SELECT id, external_id FROM new")
add("s06_update_where", lambda t: ids(store.update_where(t.items, t.members.select(F.col("content_item_id").alias("id")), {"state": F.lit("read"), "delivered": F.lit(True)}), "state", "delivered"),
    "SELECT id, CASE WHEN m THEN 'read' ELSE state END AS state, CASE WHEN m THEN true ELSE delivered END AS delivered FROM (SELECT *, id IN (SELECT content_item_id FROM members) AS m FROM items)")
add("s07_delete_cascade", lambda t: store.delete_cascade({"links": (t.content_topics, "topic_id")}, t.topics.filter("name = 'beta'").select(F.col("topic_id").cast("long").alias("topic_id")), "topic_id")["links"].select("content_id", "topic_id"),
    "SELECT content_id, topic_id FROM content_topics WHERE topic_id <> 2")

# -- filters
add("f01_undelivered", lambda t: ids(items.undelivered(t.items, 5, 40), "importance_score"), "SELECT id, importance_score FROM items WHERE processed AND NOT delivered AND importance_score >= 5 ORDER BY importance_score DESC, published_at DESC, id LIMIT 40")


def _priority(t: Tables) -> F.Column:
    return X.priority_score(F.col("url"), F.col("content"), F.col("author"), F.col("source_type"), R.SOURCE_TIERS, R.AUTHORS, R.SHORT_BELOW, R.OTHER_SOURCE)


PRIORITY_SQL = """CASE source_type WHEN 'reddit' THEN 40 WHEN 'twitter' THEN 30 WHEN 'hackernews' THEN 20 ELSE 35 END
 + CASE WHEN length(coalesce(content, '')) < 50 THEN 20 WHEN source_type = 'twitter' AND length(content) < 108 THEN 10 WHEN source_type = 'reddit' AND length(content) < 396 THEN 10 ELSE 0 END"""
add("f02_unprocessed", lambda t: ids(items.top(t.items.filter(~F.col("processed")).withColumn("score", _priority(t)), [F.asc("score"), F.desc("published_at"), F.asc("id")], 100), "score"),
    f"SELECT id, {PRIORITY_SQL} AS score FROM items WHERE NOT processed ORDER BY score, published_at DESC, id LIMIT 100")
add("f03_browse_by_date", lambda t: ids(items.browse_by_date(t.items, DAY, "en", None), "published_at"), f"SELECT id, published_at FROM items WHERE published_at >= {TS(DAY)} AND published_at < {TS(DAY)} + INTERVAL 1 DAY AND category = 'en'")
add("f04_by_state", lambda t: ids(items.by_state(t.items, "unread")), "SELECT id FROM items WHERE coalesce(state, 'unread') = 'unread'")
add("f05_recent_clusters", lambda t: ids(items.recent_clusters(t.clusters, AS_OF, 3), "last_updated_at"), f"SELECT id, last_updated_at FROM clusters WHERE last_updated_at >= {AGO(3)}")
add("f06_action_list", lambda t: ids(items.action_list(t.actions, "pending", None, 60), "priority"), "SELECT id, priority FROM actions WHERE status = 'pending' ORDER BY CASE priority WHEN 'low' THEN 1 WHEN 'mid' THEN 2 ELSE 3 END, created_at DESC, id LIMIT 60")
add("f07_suggestion_list", lambda t: ids(items.suggestion_list(t.suggestions, "pending", 20), "name"), "SELECT id, name FROM suggestions WHERE status = 'pending' ORDER BY confidence * frequency DESC, id LIMIT 20")


def _sum(parts: list[str]) -> str:
    return " + ".join(parts)


HEAD = "concat_ws(' ', coalesce(title, ''), substring(coalesce(content, ''), 1, 500))"
HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)), '^www\\.', '')"
DOMAIN_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{d}', '{c}', {i})" for d, c, i in HOSTS) + f""") AS r(domain_rule, domain_category, domain_importance)),
hits AS (SELECT i.id, arg_max(struct_pack(d := domain_rule, c := domain_category, i := domain_importance), length(domain_rule)) AS b FROM (SELECT id, {HOST} AS host FROM items WHERE url IS NOT NULL) i JOIN rules ON host = domain_rule OR ends_with(host, '.' || domain_rule) GROUP BY i.id),
dom AS (SELECT items.*, b.d AS domain_rule, b.c AS domain_category, b.i AS domain_importance FROM items LEFT JOIN hits USING (id))"""
_matches = lambda p: f"regexp_matches({HEAD}, '{Q(_edge(p))}')"
_cats = list(dict.fromkeys(c for _, c, _ in R.TITLE_KEYWORDS))
SCORES = ", ".join(f"{_sum([f'CASE WHEN {_matches(p)} THEN {1 + b} ELSE 0 END' for p, k, b in R.TITLE_KEYWORDS if k == c])} AS s{n}" for n, c in enumerate(_cats))
BEST = "CASE " + f"WHEN greatest({', '.join(f's{n}' for n in range(len(_cats)))}) < 2 THEN NULL " + " ".join(f"WHEN s{n} = greatest({', '.join(f's{m}' for m in range(len(_cats)))}) THEN '{c}'" for n, c in enumerate(_cats)) + " END"
BOOST = "greatest(" + ", ".join(f"CASE WHEN {_matches(p)} THEN {b} ELSE 0 END" for p, _, b in R.TITLE_KEYWORDS) + ")"
KEY_SQL = f"kw AS (SELECT *, {BEST} AS best FROM (SELECT *, {SCORES}, {BOOST} AS boost FROM dom))"
_strong = [f"regexp_matches({HEAD}, '(?i){Q(_edge(p))}')" for p, _, _ in R.STRONG]
_weak = [f"regexp_matches({HEAD}, '(?i){Q(_edge(p))}')" for p, _, _ in R.WEAK]
EST_SQL = f"""est0 AS (SELECT *, greatest(0.3, {', '.join(f'CASE WHEN {m} THEN {c} ELSE 0 END' for m, (_, _, c) in zip(_weak, R.WEAK))}) AS sure, CASE {' '.join(f'WHEN {m} THEN {k}' for k, m in enumerate(_strong))} END AS st,
 least(10, 5 + {_sum([f'CASE WHEN {m} THEN {b} ELSE 0 END' for m, (_, b, _) in zip(_weak, R.WEAK)])}) AS weak_score FROM dom),
est AS (SELECT *, CASE WHEN domain_category IS NOT NULL THEN domain_importance WHEN st IS NOT NULL THEN {'CASE st ' + ' '.join(f'WHEN {k} THEN {min(10, 5 + b)}' for k, (_, b, _) in enumerate(R.STRONG)) + ' END'} ELSE weak_score END AS est_score,
 CASE WHEN domain_category IS NOT NULL THEN 0.85 WHEN st IS NOT NULL THEN {'CASE st ' + ' '.join(f'WHEN {k} THEN {c}' for k, (_, _, c) in enumerate(R.STRONG)) + ' END'} WHEN sure >= 0.4 THEN sure
  WHEN source_type IN ('reddit', 'twitter') THEN 0.5 WHEN source_type = 'hackernews' THEN 0.6 ELSE sure END AS est_confidence,
 domain_category IS NULL AND st IS NULL AND sure < 0.4 AND source_type = 'rss' AS unknown FROM est0)"""
T_, C_ = "coalesce(title, '')", "coalesce(content, '')"
_words = f"list_filter(regexp_split_to_array(lower({C_}), '\\s+'), lambda w: w <> '')"
SKIP = f"""CASE WHEN trim(regexp_replace({C_}, '\\s+', ' ', 'g')) = '' THEN 'Empty content' WHEN length({C_}) < 150 AND length({T_}) < 50 THEN 'Content too short (<150 chars)'
 {' '.join(f"WHEN regexp_matches({T_}, '{Q(p)}') THEN '{r}'" for r, p in R.SKIP_TITLE)}
 WHEN est_score <= 3 AND est_confidence >= 0.5 THEN 'Low importance'
 WHEN source_type = 'twitter' AND length({C_}) < 200 AND NOT regexp_matches(concat_ws(' ', {T_}, {C_}), '{Q(R.SKIP_SIGNALS)}') THEN 'Twitter short content'
 WHEN length({C_}) < 100 AND contains(lower({C_}), '[link]') THEN 'Reddit link-post with no content'
 WHEN starts_with(trim({C_}), 'submitted by') AND length({C_}) < 150 THEN 'Reddit submission boilerplate only'
 WHEN starts_with(lower({T_}), 'rt @') AND length({C_}) < 500 THEN 'Retweet with no added content' WHEN regexp_matches({T_}, '{Q(R.SKIP_ART)}') THEN 'Art post'
 {' '.join(f"WHEN regexp_matches(lower({C_}), '{Q(p)}')" + (f" AND length({C_}) < {m}" if m else '') + f" THEN '{r}'" for r, p, m in R.SKIP_CONTENT)}
 WHEN len(regexp_extract_all({C_}, 'https?://\\S+')) >= 5 AND length({C_}) < 500 AND length(trim(regexp_replace({C_}, 'https?://\\S+', '', 'g'))) < 100 THEN 'Link aggregation with minimal content'
 WHEN len({_words}) >= 20 AND len(list_distinct({_words})) / len({_words}) < 0.3 THEN 'Repetitive/spam content' END"""
_est = lambda t: classify.estimate_importance(t.items, HOSTS)
_skipped = lambda t: classify.skip_reason(_est(t))
add("f08_skip_reason", lambda t: ids(_skipped(t), "skip_reason"), f"WITH {DOMAIN_SQL}, {EST_SQL} SELECT id, {SKIP} AS skip_reason FROM est")
add("f09_is_paper", lambda t: t.pages.select("page_id", classify.is_paper(F.col("url"), F.lit(None).cast("string"), [*R.PAPER_DOMAINS, "example.org"]).alias("paper")),
    f"SELECT page_id, {HOST} = 'example.org' OR ends_with({HOST}, '.example.org') OR regexp_matches(lower(url), '/abs/\\d+\\.\\d+|/pdf/\\d+\\.\\d+|/paper/|/doi/|/article/|/publication/|/papers?/\\d+|10\\.\\d{{4,}}/') AS paper FROM pages")
add("f10_is_link_post", lambda t: ids(t.items.filter(classify.is_link_post(F.col("content")))), "SELECT id FROM items WHERE length(trim(coalesce(content, ''))) < 100 OR regexp_matches(content, '(?i)^\\s*submitted by\\s+/u/\\S+\\s*\\[link\\]\\s*\\[comments\\]\\s*$')")
add("f11_is_heavy", lambda t: ids(t.items.withColumn("heavy", classify.is_heavy(X.key_points(F.col("title")))), "heavy"), "SELECT id, regexp_matches(title, '\\d+(?:\\.\\d+)?%|\\$\\d') OR regexp_matches(title, '(?i)\\b(OpenAI|Anthropic|Google|Meta|Microsoft|Apple|Nvidia)\\b|\\b(GPT-?\\d+|Claude|Gemini|Llama|ChatGPT)\\b|\\d\\s*(用户|users?|downloads?)') OR regexp_matches(title, '阿里|腾讯|百度|字节跳动|华为|小米') AS heavy FROM items")
add("f12_is_fetchable", lambda t: t.pages.filter(classify.is_fetchable(F.col("url"), [*R.MEDIA_HOSTS, "m.ththth.example.net"])).select("page_id"),
    f"SELECT page_id FROM pages WHERE {HOST} NOT IN ({', '.join(repr(h) for h in R.MEDIA_HOSTS)}, 'm.ththth.example.net') AND NOT regexp_matches(lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1)), '{Q(R.MEDIA_ENDINGS)}')")

# -- joins
FREE = "processed AND importance_score >= 5"
add("j01_unclustered", lambda t: ids(items.unclustered(t.items, t.members, AS_OF, 5, 24, None)), f"SELECT id FROM items WHERE {FREE} AND (cluster_attempted_at IS NULL OR cluster_attempted_at < {TS(AS_OF)} - to_seconds(86400)) AND id NOT IN (SELECT content_item_id FROM members)")
add("j02_members_of", lambda t: ids(items.members_of(t.items, t.members), "event_cluster_id", "published_at"), "SELECT i.id, event_cluster_id, published_at FROM members m JOIN items i ON i.id = content_item_id")
add("j03_delivered_clusters", lambda t: ids(items.delivered_clusters(t.clusters, t.members, t.items, "2024-01-25 00:00:00"), "event_title"), "SELECT id, event_title FROM clusters c WHERE EXISTS (SELECT 1 FROM members m JOIN items i ON i.id = m.content_item_id WHERE m.event_cluster_id = c.id AND i.delivered_at >= TIMESTAMP '2024-01-25 00:00:00' AND i.delivered_at < TIMESTAMP '2024-01-26 00:00:00')")
add("j04_digest_members", lambda t: ids(items.digest_members(t.items, t.members, 5, DAY, True), "event_cluster_id"), f"SELECT i.id, event_cluster_id FROM items i JOIN members m ON m.content_item_id = i.id WHERE {FREE} AND (NOT delivered OR (delivered_at >= {TS(DAY)} AND delivered_at < {TS(DAY)} + INTERVAL 1 DAY))")
add("j05_digest_singles", lambda t: ids(items.digest_singles(t.items, t.members, 5, DAY)), f"SELECT id FROM items WHERE {FREE} AND NOT delivered AND id NOT IN (SELECT content_item_id FROM members)")
add("j06_topic_content", lambda t: items.topic_content(t.items, t.content_topics, 0.4, 15).select("topic_id", "content_id", "rank"), "SELECT topic_id, content_id, rank FROM (SELECT topic_id, content_id, row_number() OVER (PARTITION BY topic_id ORDER BY relevance DESC, published_at DESC, content_id) AS rank FROM content_topics JOIN items ON id = content_id WHERE relevance >= 0.4) WHERE rank <= 15")
add("j07_missing_embeddings", lambda t: ids(items.missing_embeddings(t.items, t.content_embeddings)), "SELECT id FROM items WHERE id NOT IN (SELECT content_id FROM content_embeddings)")
add("j08_embedded_items", lambda t: ids(items.embedded_items(t.items, t.content_embeddings, START).withColumn("size", F.size("embedding")), "size"), f"SELECT id, len(embedding) AS size FROM items JOIN content_embeddings ON content_id = id WHERE processed AND published_at >= {TS(START)}")
add("j09_reuse_results", lambda t: items.reuse_results(t.items.select("id", F.concat(F.lit("h"), F.col("id") * 7).alias("content_hash")), t.cache, AS_OF).select("id", "content_hash"), f"SELECT id, content_hash FROM items JOIN cache ON content_hash = concat('h', id * 7) WHERE expires_at > {TS(AS_OF)}")
ITEMS_KEYWORDS = "SELECT i.id AS content_id, t.topic_id, count(*) FILTER (WHERE h) AS hits, sum(CASE WHEN h THEN greatest(0.3, 1 - pos * 0.05) ELSE 0 END) / count(*) AS s FROM (SELECT id, lower(concat_ws(' ', title, content)) AS x FROM items) i, LATERAL (SELECT topic_id, pos, contains(i.x, keyword) AS h FROM topics) t GROUP BY i.id, t.topic_id"
add("j10_match_topics", lambda t: topics.match_topics(t.items, t.topics), f"SELECT content_id, topic_id, round(CAST(r AS DOUBLE), 3) AS relevance FROM (SELECT content_id, topic_id, CASE WHEN hits >= 3 THEN least(1.0, least(1.0, s) * 1.2) ELSE least(1.0, s) END AS r FROM ({ITEMS_KEYWORDS})) WHERE round(CAST(r AS DOUBLE), 3) > 0.3")
DOT = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
add("j12_nearest_processed", lambda t: vectors.nearest_processed(t.items, t.content_embeddings, AS_OF, 0.6, 7).select("id", "match", F.round("score", 6).alias("score")),
    f"SELECT id, match, round(score, 6) AS score FROM (SELECT a.vec_id AS id, b.vec_id AS match, ({DOT} + 1) / 2 AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY ({DOT} + 1) / 2 DESC, b.vec_id) AS n FROM embeddings a JOIN items ia ON ia.id = a.vec_id JOIN embeddings b ON a.vec_id <> b.vec_id JOIN items ib ON ib.id = b.vec_id WHERE ib.processed AND ib.published_at >= {AGO(7)} AND ({DOT} + 1) / 2 >= 0.6) WHERE n = 1")

add("j12_nearest_approximate", lambda t: vectors.nearest_approximate(t.items, t.content_embeddings, AS_OF, 0.6).select("id", "match", F.round("score", 6).alias("score")))


def _chain(expr: str, chain: list[tuple[str, str]]) -> str:
    for p, r in chain:
        expr = f"regexp_replace({expr}, '{Q(p)}', '{r}', 'g')"
    return f"trim({expr})"


NORM = _chain("lower(title)", X.TITLE_STEPS)
add("j13_similar_titles", lambda t: dedup.similar_titles(t.items, t.items, AS_OF, 15), f"WITH n AS (SELECT id, published_at, {NORM} AS t FROM items), p AS (SELECT a.id, b.id AS o, b.published_at AS seen FROM n a JOIN n b ON a.id <> b.id AND a.t <> '' AND b.published_at >= {AGO(15)} AND (a.t = b.t OR (length(a.t) > 20 AND length(b.t) > 20 AND substring(a.t, 1, 20) = substring(b.t, 1, 20) AND (starts_with(a.t, substring(b.t, 1, 50)) OR starts_with(b.t, substring(a.t, 1, 50)))))) SELECT id, o AS match FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seen DESC, o DESC) AS k FROM p) WHERE k = 1")
add("j14_ingest_dedup", lambda t: ids(items.ingest_dedup(t.items.filter("id % 2 = 0"), t.items)), "WITH old AS (SELECT * FROM items WHERE id % 2 = 0) SELECT id FROM items WHERE (source_type, external_id) NOT IN (SELECT (source_type, external_id) FROM old) AND (url IS NULL OR url NOT IN (SELECT url FROM old WHERE url IS NOT NULL))")

# -- aggregates
add("a01_category_stats", lambda t: stats.category_stats(t.items), "SELECT category, count(*) AS n FROM items GROUP BY 1")
add("a02_state_stats", lambda t: stats.state_stats(t.items), "SELECT coalesce(state, 'unread') AS state, count(*) AS n FROM items GROUP BY 1")
add("a03_content_stats", lambda t: stats.content_stats(t.items), "SELECT count(*) AS total, sum(CASE WHEN processed THEN 1 ELSE 0 END) AS processed, sum(CASE WHEN delivered THEN 1 ELSE 0 END) AS delivered, round(avg(importance_score), 2) AS avg_importance FROM items")
add("a04_cluster_stats", lambda t: stats.cluster_stats(t.clusters), "SELECT count(*) AS clusters, sum(article_count) AS members, round(avg(article_count), 2) AS avg_members FROM clusters")
VALID = f"expires_at > {TS(AS_OF)}"
add("a05_cache_stats", lambda t: stats.cache_stats(t.cache, AS_OF), f"SELECT count(*) AS entries, count(*) FILTER (WHERE {VALID}) AS valid, count(*) FILTER (WHERE NOT {VALID}) AS expired, min(created_at) FILTER (WHERE {VALID}) AS oldest, max(created_at) FILTER (WHERE {VALID}) AS newest FROM cache")
add("a06_deliveries_by_day", lambda t: stats.deliveries_by_day(t.items, AS_OF), f"SELECT CAST(delivered_at AS DATE) AS day, count(*) AS n FROM items WHERE delivered AND delivered_at >= {AGO(7)} GROUP BY 1")
add("a07_attempt_stats", lambda t: stats.attempt_stats(t.items), "SELECT count(cluster_attempted_at) AS attempted, count(*) - count(cluster_attempted_at) AS never FROM items WHERE processed AND NOT delivered")
add("a08_embedding_stats", lambda t: stats.embedding_stats(t.items, t.content_embeddings, vectors.centroids(t.members, t.content_embeddings)), "SELECT i AS items, e AS embedded, c AS centroids, round(e * 100.0 / i, 1) AS coverage FROM (SELECT (SELECT count(*) FROM items) AS i, (SELECT count(*) FROM content_embeddings WHERE content_id IN (SELECT id FROM items)) AS e, (SELECT count(DISTINCT event_cluster_id) FROM members) AS c)")
SINCE = "2024-01-05 00:00:00"
USE = f"FROM usage WHERE timestamp >= {TS(SINCE)}"
add("a09_usage_by_type", lambda t: stats.usage_by_type(t.usage, SINCE), f"SELECT call_type, count(*) AS calls, count(*) FILTER (WHERE cached) AS cached, sum(CASE WHEN cached THEN 0 ELSE input_tokens END) AS input_tokens, sum(CASE WHEN cached THEN 0 ELSE output_tokens END) AS output_tokens {USE} GROUP BY 1")
TOTALS = f"SELECT count(*) AS calls, count(*) FILTER (WHERE cached) AS cached, count(*) FILTER (WHERE NOT success) AS errors, sum(CASE WHEN cached THEN 0 ELSE input_tokens END) AS input_tokens, sum(CASE WHEN cached THEN 0 ELSE output_tokens END) AS output_tokens, round(count(*) FILTER (WHERE cached) * 100.0 / count(*), 1) AS hit_rate {USE}"
add("a09_usage_totals", lambda t: stats.usage_totals(t.usage, SINCE), TOTALS)
add("a10_usage_cost", lambda t: stats.usage_cost(t.usage, SINCE), f"SELECT model, round((input_tokens * a + output_tokens * b) / 1e6, 6) AS cost FROM ({TOTALS}), (VALUES " + ", ".join(f"('{m}', {a}, {b})" for m, a, b in stats.PRICES) + ") p(model, a, b)")
add("a11_cache_report", lambda t: stats.cache_report(t.cache, AS_OF), f"SELECT e AS entries, v AS valid, e - v AS expired, round(v * 100.0 / e, 1) AS utilisation, round(v * 500 / 1024, 2) AS size_kb, concat_ws('; ', CASE WHEN (e - v) * 100.0 / e > 30 THEN 'clean up expired entries' END, CASE WHEN v * 100.0 / e < 50 THEN 'raise the time to live' END) AS advice FROM (SELECT count(*) AS e, count(*) FILTER (WHERE {VALID}) AS v FROM cache)")
CENT = "c0 AS (SELECT event_cluster_id, p, avg(CAST(embedding[p] AS DOUBLE)) AS m, count(*) AS n FROM members JOIN content_embeddings ON content_id = content_item_id, generate_series(1, 64) AS g(p) GROUP BY 1, 2), c1 AS (SELECT event_cluster_id, sqrt(sum(m * m)) AS norm FROM c0 GROUP BY 1)"
add("a12_centroids", lambda t: vectors.centroids(t.members, t.content_embeddings).select("event_cluster_id", "members", F.posexplode("centroid").alias("pos", "x")).select("event_cluster_id", "members", "pos", F.round("x", 5).alias("x")),
    f"WITH {CENT} SELECT event_cluster_id, n AS members, CAST(p - 1 AS INTEGER) AS pos, round(m / norm, 5) AS x FROM c0 JOIN c1 USING (event_cluster_id)")
ROLL = "SELECT event_cluster_id, min(published_at) AS first_seen_at, max(published_at) AS last_updated_at, count(*) AS article_count, max(importance_score) AS max_importance, array_to_string(list_sort(list_distinct(list(source_type))), ',') AS sources, arg_max(id, coalesce(importance_score, 0) * 1000000000 - id) AS representative, arg_max(title, coalesce(importance_score, 0) * 1000000000 - id) AS title FROM members JOIN items ON id = content_item_id GROUP BY 1"
_roll = lambda t: stats.cluster_rollup(t.members, t.items)
add("a13_cluster_rollup", _roll, ROLL)
add("a14_event_timeline", lambda t: stats.event_timeline(t.members, t.items), "SELECT event_cluster_id, day, count(*) AS articles, string_agg(title, ' | ' ORDER BY n) FILTER (WHERE n <= 3) AS titles FROM (SELECT event_cluster_id, CAST(published_at AS DATE) AS day, title, row_number() OVER (PARTITION BY event_cluster_id, CAST(published_at AS DATE) ORDER BY importance_score DESC NULLS LAST, id) AS n FROM members JOIN items ON id = content_item_id) GROUP BY 1, 2")
ENT = "list_concat(" + ", ".join(f"regexp_extract_all(concat_ws(' ', title, content), '(?i){Q(p)}', 1)" for p in WORDS) + ")"
FREQ = "SELECT name, frequency, round(greatest({low}, least({high}, frequency / (total * {share}))), 6) AS confidence FROM (SELECT name, count(*) AS frequency FROM (SELECT unnest({terms}) AS name FROM items) GROUP BY name HAVING count(*) >= {least}), (SELECT count(*) AS total FROM items) ORDER BY frequency DESC, name LIMIT {limit}"
_freq = lambda df: df.select("name", "frequency", F.round("confidence", 6).alias("confidence"))
add("a15_discover_by_entities", lambda t: _freq(topics.discover_by_entities(t.items, 5, WORDS)), FREQ.format(low=0.3, high=1.0, share=0.1, terms=ENT, least=5, limit=50))
PSTOP = "[" + ", ".join(f"'{w}'" for w in X.PHRASE_STOPWORDS) + "]"
PAIRS = f"list_concat(regexp_extract_all(title, '{X.CHINESE}', 1), [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws)) IF length(ws[i]) > 2 AND length(ws[i + 1]) > 2 AND NOT list_contains({PSTOP}, ws[i]) AND NOT list_contains({PSTOP}, ws[i + 1])])"
add("a16_discover_by_keywords", lambda t: _freq(topics.discover_by_keywords(t.items, 2, 40)), FREQ.replace("FROM (SELECT unnest({terms}) AS name FROM items)", "FROM (SELECT unnest({terms}) AS name FROM (SELECT *, regexp_extract_all(lower(title), '([a-z]+)', 1) AS ws FROM items))").format(low=0.2, high=0.8, share=0.15, terms=PAIRS, least=2, limit=40))
TREND = f"SELECT name, c AS frequency, p AS previous, round(least(0.9, 0.5 + c / 20), 6) AS confidence FROM (SELECT name, count(*) FILTER (WHERE published_at >= {AGO(7)}) AS c, count(*) FILTER (WHERE published_at < {AGO(7)}) AS p FROM (SELECT published_at, unnest({ENT}) AS name FROM items WHERE published_at >= {AGO(14)} AND published_at < {TS(AS_OF)}) GROUP BY name) WHERE c >= 3 AND c >= greatest(p, 1) * 3"
add("a17_discover_by_trends", lambda t: topics.discover_by_trends(t.items, AS_OF, WORDS).select("name", "frequency", "previous", F.round("confidence", 6).alias("confidence")), TREND)
TT = f"SELECT topic_id, c AS current, p AS previous, round(CASE WHEN p = 0 AND c > 0 THEN 100.0 WHEN p = 0 THEN 0.0 ELSE (c - p) * 100.0 / p END, 2) AS change FROM (SELECT topic_id, count(*) FILTER (WHERE published_at >= {AGO(7)}) AS c, count(*) FILTER (WHERE published_at < {AGO(7)}) AS p FROM content_topics JOIN items ON id = content_id WHERE relevance >= 0.4 AND published_at >= {AGO(14)} AND published_at < {TS(AS_OF)} GROUP BY 1)"
UPDOWN = "CASE WHEN change > 20 THEN 'up' WHEN change < -20 THEN 'down' ELSE 'stable' END AS trend"
add("a18_topic_trend", lambda t: topics.topic_trend(t.items, t.content_topics, AS_OF), f"SELECT *, {UPDOWN} FROM ({TT})")
add("a19_topic_snapshots", lambda t: topics.topic_snapshots(t.items, t.content_topics, AS_OF), f"SELECT topic_id, article_count, avg_importance, high_importance, trend FROM (SELECT topic_id, count(*) AS article_count, round(avg(coalesce(importance_score, 5)), 4) AS avg_importance, count(*) FILTER (WHERE importance_score >= 7) AS high_importance FROM content_topics JOIN items ON id = content_id WHERE relevance >= 0.4 AND published_at >= {AGO(7)} AND published_at < {TS(AS_OF)} GROUP BY 1) LEFT JOIN (SELECT topic_id, {UPDOWN} FROM ({TT})) USING (topic_id)")
PERIOD = f"published_at >= {TS(START)} AND published_at <= {TS(END)}"
add("a20_period_summary", lambda t: stats.period_summary(t.items, START, END), f"SELECT coalesce(category, '未分类') AS category, count(*) AS items, count(*) FILTER (WHERE importance_score >= 7) AS important FROM items WHERE processed AND {PERIOD} GROUP BY 1")
add("a21_action_review", lambda t: stats.action_review(t.actions, "1996-01-01 00:00:00", "1997-12-31 23:59:59"), "SELECT count(*) AS created, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'dismissed') AS dismissed, round(count(*) FILTER (WHERE status = 'done') * 100.0 / count(*), 1) AS completion FROM actions WHERE created_at >= TIMESTAMP '1996-01-01 00:00:00' AND created_at <= TIMESTAMP '1997-12-31 23:59:59'")
add("a22_trending_words", lambda t: topics.trending_words(t.items), "WITH p AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(concat_ws(' ', title, coalesce(summary, '')), '([\\x{4e00}-\\x{9fff}]{2,}|[a-zA-Z]{3,})', 1)) AS word FROM items) GROUP BY word ORDER BY n DESC, word LIMIT 20) SELECT word, n FROM p WHERE n >= 3 AND lower(word) NOT IN ('the', 'and', 'for', 'with') ORDER BY n DESC, word LIMIT 10")
add("a23_new_entities", lambda t: topics.new_entities(t.items, START, END, WORDS), f"WITH e AS (SELECT published_at, lower(unnest({ENT})) AS name FROM items) SELECT name, count(*) AS n FROM e WHERE {PERIOD} AND name NOT IN (SELECT name FROM e WHERE published_at < {TS(START)}) GROUP BY name")
ROUTE = f"near AS (SELECT a.vec_id AS id FROM embeddings a JOIN items ia ON ia.id = a.vec_id JOIN embeddings b ON a.vec_id <> b.vec_id JOIN items ib ON ib.id = b.vec_id WHERE ib.processed AND ib.published_at >= {AGO(7)} AND ({DOT} + 1) / 2 >= 0.6 GROUP BY 1), routed AS (SELECT id, {SKIP} AS skip_reason, id IN (SELECT id FROM near) AS m FROM est)"
_routed = lambda t: dedup.prefilter(_skipped(t), vectors.nearest_processed(t.items, t.content_embeddings, AS_OF, 0.6, 7).select("id", "match"))
ROUTED = "CASE WHEN skip_reason IS NOT NULL THEN 'skip' WHEN m THEN 'reuse' ELSE 'process' END AS route"
add("a24_prefilter_stats", lambda t: dedup.prefilter_stats(_routed(t)), f"WITH {DOMAIN_SQL}, {EST_SQL}, {ROUTE} SELECT route, skip_reason, count(*) AS n FROM (SELECT *, {ROUTED} FROM routed) GROUP BY 1, 2")
add("a25_event_heat", lambda t: stats.event_heat(t.clusters, _roll(t), AS_OF), f"SELECT c.id, round(c.article_count * 2 + coalesce(max_importance, 0) + greatest(0.0, 5 - (epoch({TS(AS_OF)}) - floor(epoch(c.last_updated_at))) / 3600.0 / 12), 4) AS heat FROM clusters c LEFT JOIN ({ROLL}) r ON r.event_cluster_id = c.id")

# -- windows, rankings, sets
add("w01_dedup_memberships", lambda t: stats.dedup_memberships(t.members), "SELECT event_cluster_id, content_item_id, similarity_score FROM (SELECT *, row_number() OVER (PARTITION BY content_item_id ORDER BY similarity_score DESC, event_cluster_id) AS n FROM members) WHERE n = 1")
add("w02_topic_changes", lambda t: stats.topic_changes(t.topic_snapshots), "SELECT topic_id, article_count, previous, round(CASE WHEN previous = 0 THEN 100.0 ELSE (article_count - previous) * 100.0 / previous END, 2) AS change FROM (SELECT *, row_number() OVER w AS n, lead(article_count) OVER w AS previous FROM topic_snapshots WINDOW w AS (PARTITION BY topic_id ORDER BY snapshot_date DESC)) WHERE n = 1 AND previous IS NOT NULL")
DIGEST = """ev AS (SELECT true AS is_event, event_cluster_id AS id, arg_max(title, importance_score * 1000000000 - i.id) AS title, arg_max(category, importance_score * 1000000000 - i.id) AS category, max(importance_score) AS importance_score, count(*) AS articles, true AS heavy
 FROM items i JOIN members ON content_item_id = i.id WHERE processed AND NOT delivered AND importance_score >= 5 GROUP BY event_cluster_id),
si AS (SELECT false AS is_event, id, title, category, importance_score, CAST(1 AS BIGINT) AS articles, summary IS NOT NULL AND length(summary) >= 200 AS heavy FROM items WHERE processed AND NOT delivered AND importance_score >= 5 AND id NOT IN (SELECT content_item_id FROM members)),
digest AS (SELECT * FROM (SELECT * FROM ev UNION ALL SELECT * FROM si) ORDER BY heavy DESC, importance_score DESC, is_event DESC, id LIMIT 60)"""
_digest = lambda t: items.build_digest(t.items, t.members, 5, AS_OF, 60)
add("t03_build_digest", _digest, f"WITH {DIGEST} SELECT * FROM digest")
add("w05_by_category", lambda t: items.by_category(_digest(t)).select("id", "is_event", "category", "rank"), f"WITH {DIGEST} SELECT id, is_event, category, row_number() OVER (PARTITION BY category ORDER BY is_event DESC, heavy DESC, importance_score DESC, id) AS rank FROM digest")
add("t06_section_topk", lambda t: items.section_topk(_digest(t), F.when(F.col("is_event"), "events").otherwise("regular"), 5).select("section", "id", "rank"), f"WITH {DIGEST} SELECT section, id, rank FROM (SELECT CASE WHEN is_event THEN 'events' ELSE 'regular' END AS section, id, row_number() OVER (PARTITION BY is_event ORDER BY importance_score DESC, id) AS rank FROM digest) WHERE rank <= 5")
add("t01_rank_content", lambda t: ids(items.top(t.items.withColumn("score", _priority(t)), [F.asc("score"), F.desc("published_at"), F.asc("id")], 80), "score"), f"SELECT id, {PRIORITY_SQL} AS score FROM items ORDER BY score, published_at DESC, id LIMIT 80")
add("t02_page", lambda t: ids(items.page(t.items, [F.desc("published_at"), F.asc("id")], 25, 50)), "SELECT id FROM items ORDER BY published_at DESC, id LIMIT 25 OFFSET 50")
add("t04_top_events", lambda t: ids(stats.top_events(t.clusters, START, END, 5), "article_count"), f"SELECT id, article_count FROM clusters WHERE last_updated_at >= {TS(START)} AND last_updated_at <= {TS(END)} ORDER BY article_count DESC, id LIMIT 5")
add("t05_order_events", lambda t: stats.order_events(t.clusters, _roll(t), ("fr", "de")).select("id", "first", "article_count", "place"),
    f"SELECT id, first, article_count, row_number() OVER (ORDER BY first, article_count DESC, max_importance DESC NULLS LAST, id) AS place FROM (SELECT c.id, CASE WHEN category IN ('fr', 'de') THEN 0 ELSE 1 END AS first, c.article_count, max_importance FROM clusters c LEFT JOIN ({ROLL}) r ON r.event_cluster_id = c.id)")
add("u01_recent_content", lambda t: ids(items.recent_content([t.items.filter("processed"), t.items.filter("not delivered")], AS_OF, 7)), f"SELECT id FROM items WHERE (processed OR NOT delivered) AND published_at >= {AGO(7)}")
add("u02_merge_suggestions", lambda t: topics.merge_suggestions(t.suggestions.filter("id % 2 = 0"), t.suggestions.filter("id % 2 = 1")).select(F.lower("name").alias("name"), "confidence"), "SELECT lower(name) AS name, max(confidence) AS confidence FROM suggestions GROUP BY 1")
FOUND = FREQ.format(low=0.3, high=1.0, share=0.1, terms=ENT, least=5, limit=50)
add("u03_discover_topics", lambda t: _freq(topics.discover_topics(topics.discover_by_entities(t.items, 5, WORDS), t.topics)), f"SELECT * FROM ({FOUND}) WHERE lower(name) NOT IN (SELECT lower(name) FROM topics UNION SELECT lower(keyword) FROM topics) ORDER BY confidence * frequency DESC, name LIMIT 20")
add("u04_merge_keywords", lambda t: topics.merge_keywords(t.topics, t.suggestions.select((F.col("id") % 3 + 1).cast("int").alias("topic_id"), F.lower("name").alias("keyword"))).select("topic_id", "keyword"), "SELECT topic_id, keyword FROM topics UNION SELECT CAST(id % 3 + 1 AS INTEGER), lower(name) FROM suggestions")
add("u05_accept_suggestions", lambda t: topics.accept_suggestions(t.suggestions, t.suggestions.filter("status = 'pending' and confidence > 0.5"))[0].groupBy("status").agg(F.count(F.lit(1)).alias("n")), "SELECT status, count(*) AS n FROM (SELECT CASE WHEN status = 'pending' AND confidence > 0.5 THEN 'accepted' ELSE status END AS status FROM suggestions) GROUP BY 1")

# -- text features
KEY = _chain("lower(trim(title))", X.KEY_STEPS)
CONTENT16 = "substring(sha256(concat(coalesce(title, ''), chr(10), substring(coalesce(content, ''), 1, 500))), 1, 16)"
add("p01_title_key", lambda t: t.items.select("id", X.title_key(F.col("title")).alias("key")), f"SELECT id, CASE WHEN length({KEY}) >= 5 THEN {KEY} END AS key FROM items")
add("p02_hashes", lambda t: t.items.select("id", X.title_hash(F.col("title")).alias("title_hash"), X.content_hash(F.col("title"), F.col("content")).alias("content_hash"), X.result_hash(F.col("title"), F.col("content")).alias("result_hash")),
    f"SELECT id, CASE WHEN length({KEY}) >= 5 THEN substring(sha256({KEY}), 1, 16) END AS title_hash, {CONTENT16} AS content_hash, substring(sha256(concat(title, '||', content)), 1, 16) AS result_hash FROM items")
QUERY = "regexp_extract(url, '\\?([^#]*)', 1)"
TAIL = f"array_to_string([p FOR p IN string_split({QUERY}, '&') IF contains(p, '=') AND NOT ends_with(p, '=') AND NOT list_contains(['utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'ref', 'source'], lower(split_part(p, '=', 1)))], '&')"
add("p03_normalize_url", lambda t: t.pages.select("page_id", X.normalize_url(F.col("url")).alias("url")), f"SELECT page_id, regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/+$', '') || CASE WHEN {TAIL} <> '' THEN '?' || {TAIL} ELSE '' END AS url FROM pages")
add("p04_url_host", lambda t: t.pages.select("page_id", X.url_host(F.col("url")).alias("host")), f"SELECT page_id, {HOST} AS host FROM pages")
URLS = "concat('https://', CASE source_type WHEN 'reddit' THEN concat('www.reddit.com/r/', category) WHEN 'twitter' THEN 'x.com/' WHEN 'hackernews' THEN 'news.ycombinator.com/item' ELSE substring(url, 9) END, '/', substring(author, 2))"
add("p05_source_key", lambda t: t.items.select("id", X.source_key(F.expr(URLS)).alias("key")), "SELECT id, CASE source_type WHEN 'reddit' THEN 'reddit/' || category WHEN 'twitter' THEN 'twitter' WHEN 'hackernews' THEN 'hackernews' ELSE 'other' END AS key FROM items")
add("p06_priority_score", lambda t: t.items.select("id", _priority(t).alias("score")), f"SELECT id, {PRIORITY_SQL} AS score FROM items")
BARE = "regexp_replace(html, '(?s)<[^>]+>', ' ', 'g')"


def _entities_sql(x: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return f"trim(regexp_replace({x}, '[\\s\\x{{a0}}]+', ' ', 'g'))"


add("p07_clean_html", lambda t: t.pages.select("page_id", X.clean_html(F.col("html")).alias("text")), f"SELECT page_id, {_entities_sql(BARE)} AS text FROM pages")
BODY = "html"
for _tag in ("script", "style", "nav", "header", "footer"):
    BODY = f"regexp_replace({BODY}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}>', ' ', 'g')"
_pick = lambda tag: f"nullif(regexp_extract(b, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}>', 1), '')"
add("p08_extract_pages", lambda t: feeds.extract_pages(t.pages).select("page_id", "text"), f"SELECT page_id, substring({_entities_sql(BARE)}, 1, 5000) AS text FROM (SELECT page_id, coalesce({_pick('article')}, {_pick('main')}, b) AS html FROM (SELECT page_id, {BODY} AS b FROM pages))")
HEADT = _chain("title", X.HEAD_STEPS)
_cut = " ".join(f"WHEN strpos(x, '{s}') - 1 > 10 AND strpos(x, '{s}') - 1 < 50 THEN trim(substring(x, 1, strpos(x, '{s}')))" for s in ("。", "！", "？", ".", "!", "?", "，", ",", " - ", " | "))
add("p10_rule_summary", lambda t: t.items.select("id", X.rule_summary(F.col("title")).alias("summary"), X.one_liner(F.col("title"), F.lit("AI")).alias("line")),
    f"SELECT id, CASE WHEN length(x) <= 50 THEN x {_cut} ELSE substring(x, 1, 47) || '...' END AS summary, 'AI动态：' || CASE WHEN length(x) <= 30 THEN x " + " ".join(f"WHEN contains(x, '{s}') THEN substring(trim(split_part(x, '{s}', 1)), 1, 30)" for s in ("：", ":", " - ", " | ")) + f" ELSE substring(x, 1, 30) || '...' END AS line FROM (SELECT id, {HEADT} AS x FROM items)")
# items of hackernews get a prefix by their titles' lengths, since the titles of these data have none
add("p11_hn_type", lambda t: t.items.select("id", X.hn_type(F.concat_ws(" ", F.when(F.col("source_type") == "hackernews", F.element_at(F.split(F.lit("Ask HN:,Show HN:,Tell HN:,Launch HN:"), ","), F.pmod(F.length("title"), F.lit(4)) + 1)), "title")).alias("kind")),
    "SELECT id, CASE WHEN source_type = 'hackernews' THEN (['ask', 'show', 'tell', 'launch'])[length(title) % 4 + 1] END AS kind FROM items")
add("p12_normalize_title", lambda t: t.items.select("id", X.normalize_title(F.col("title")).alias("title")), f"SELECT id, {NORM} AS title FROM items")
add("p13_entities", lambda t: t.items.select("id", F.array_join(X.entities(F.concat_ws(" ", "title", "content"), WORDS), ",").alias("names")), f"SELECT id, array_to_string({ENT}, ',') AS names FROM items")
_join = lambda c: F.array_join(F.array_sort(c), ",")
MODELT = "concat_ws(' ', title, CASE id % 3 WHEN 0 THEN 'GPT-5 and Claude 3' WHEN 1 THEN 'Step 3.5 Flash' END)"
MODELS_SQL = f"[lower(m) FOR m IN regexp_extract_all({MODELT}, '{Q(X.MODEL_NAMES)}', 1)]"


def _with_models() -> F.Column:
    return F.concat_ws(" ", F.col("title"), F.when(F.col("id") % 3 == 0, "GPT-5 and Claude 3").when(F.col("id") % 3 == 1, "Step 3.5 Flash"))


add("p14_model_names", lambda t: t.items.select("id", _join(X.model_names(_with_models())).alias("models")), f"SELECT id, array_to_string(list_sort(list_distinct(list_concat({MODELS_SQL}, [regexp_replace(m, '[- ]+', '', 'g') FOR m IN {MODELS_SQL}]))), ',') AS models FROM items")
STOP = "[" + ", ".join(f"'{w}'" for w in X.TITLE_STOPWORDS) + "]"
KW = lambda x: f"[w FOR w IN regexp_extract_all(lower({x}), '{X.TOKEN}', 1) IF length(w) > 1 AND NOT list_contains({STOP}, w)]"
add("p15_keywords", lambda t: t.items.select("id", _join(X.keywords(F.col("title"))).alias("words")), f"SELECT id, array_to_string(list_sort(list_distinct({KW('title')})), ',') AS words FROM items")
add("p16_bigrams", lambda t: t.items.select("id", F.array_join(X.bigrams(F.col("title")), ",").alias("pairs")), f"SELECT id, array_to_string({PAIRS}, ',') AS pairs FROM (SELECT *, regexp_extract_all(lower(title), '([a-z]+)', 1) AS ws FROM items)")
POINTS = [r"(?i)\b(OpenAI|Anthropic|Google|Meta|Microsoft|Apple|Nvidia)\b", r"(?i)\b(GPT-?\d+|Claude|Gemini|Llama|ChatGPT)\b", "(阿里|腾讯|百度|字节跳动|华为|小米)", r"(?i)\$(\d+(?:\.\d+)?[BMK]?)", r"(\d+(?:\.\d+)?%)", r"(?i)(\d+(?:,\d+)*)\s*(?:用户|users?|downloads?)"]
add("p17_key_points", lambda t: t.items.select("id", F.array_join(X.key_points(F.col("content")), "|").alias("points")),
    "SELECT id, array_to_string(list_slice(list_filter([" + ", ".join(f"regexp_extract(content, '{_edge(p)}', 1)" for p in POINTS) + "], lambda x: x <> ''), 1, 3), '|') AS points FROM items")
add("p17_key_points_titles", lambda t: t.items.select("id", F.array_join(X.key_points(F.col("title")), "|").alias("points")),
    "SELECT id, array_to_string(list_slice(list_filter([" + ", ".join(f"regexp_extract(title, '{_edge(p)}', 1)" for p in POINTS) + "], lambda x: x <> ''), 1, 3), '|') AS points FROM items")
add("p18_title_similarity", lambda t: t.items.join(t.items.select((F.col("id") - 1).alias("id"), F.col("title").alias("other")), "id").select("id", F.round(X.title_similarity(F.col("title"), F.col("other")), 6).alias("score")),
    f"WITH n AS (SELECT id, title, {NORM} AS t FROM items), k AS (SELECT *, list_distinct({KW('t')}) AS w FROM n) SELECT a.id, round(CASE WHEN a.title = '' OR b.title = '' THEN 0 WHEN a.t = b.t THEN 1 ELSE coalesce(len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0), 0) END, 6) AS score FROM k a JOIN k b ON b.id = a.id + 1")
add("p19_cosine", lambda t: t.content_embeddings.join(t.content_embeddings.select((F.col("content_id") - 1).alias("content_id"), F.col("embedding").alias("o")), "content_id").select("content_id", F.round(X.cosine(F.col("embedding"), F.col("o")), 5).alias("cosine"), F.round(X.sim01(F.col("embedding"), F.col("o")), 5).alias("sim")),
    f"SELECT a.vec_id AS content_id, round({DOT} / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 5) AS cosine, round(greatest(0, ({DOT} + 1) / 2), 5) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
add("p20_hybrid_score", lambda t: t.members.select("event_cluster_id", "content_item_id", F.round(X.hybrid_score(F.lit(0.5), F.col("similarity_score")), 6).alias("score")), "SELECT event_cluster_id, content_item_id, round(CASE WHEN similarity_score = 0 THEN 0.5 ELSE 0.5 * 0.4 + similarity_score * 0.6 END, 6) AS score FROM members")
LANGS, LANG_ALIASES = ["en", "de", "fr"], {"es": "de", "src1": "fr"}
add("p21_normalize_category", lambda t: t.items.select("id", X.normalize_category(F.concat(F.substring("author", 2, 10), F.when(F.col("processed"), "、").otherwise("-"), F.col("category")), LANGS, LANG_ALIASES, "其他").alias("category")),
    "SELECT id, CASE WHEN author = '@src1' AND processed THEN 'fr' WHEN category IN ('en', 'de', 'fr') THEN category WHEN category = 'es' AND processed THEN 'de' ELSE '其他' END AS category FROM items")
add("p24_estimate_tokens", lambda t: t.conversations.select("conv_id", "turn", X.estimate_tokens(F.col("text")).alias("tokens")), "SELECT conv_id, turn, greatest(CAST(floor(length(text) / 3) AS BIGINT), 10) AS tokens FROM conversations")


def _bounds(t: Tables) -> DataFrame:
    (w1, w2), (m1, m2) = stats.week_bounds(F.col("published_at")), stats.month_bounds(F.col("published_at"), 1)
    return t.items.select("id", w1.alias("week_start"), w2.alias("week_end"), m1.alias("month_start"), m2.alias("month_end"))


add("p25_bounds", _bounds, "SELECT id, date_trunc('week', published_at) AS week_start, date_trunc('week', published_at) + to_seconds(7 * 86400 - 1) AS week_end, CAST(date_trunc('month', published_at) - INTERVAL 1 MONTH AS TIMESTAMP) AS month_start, CAST(date_trunc('month', published_at) AS TIMESTAMP) - to_seconds(1) AS month_end FROM items")

# -- classification
add("c01_classify_domain", lambda t: ids(classify.classify_domain(t.items, HOSTS), "domain_rule", "domain_category", "domain_importance"), f"WITH {DOMAIN_SQL} SELECT id, domain_rule, domain_category, domain_importance FROM dom")
add("c02_classify_keywords", lambda t: t.items.select("id", *(c.alias(n) for c, n in zip(classify.keyword_scores(classify.head(F.col("title"), F.col("content"))), ("best", "boost")))), f"WITH {DOMAIN_SQL}, {KEY_SQL} SELECT id, best, boost FROM kw")
add("c03_classify", lambda t: ids(classify.classify(t.items, HOSTS), "class", "class_importance", "class_reason"), f"WITH {DOMAIN_SQL}, {KEY_SQL} SELECT id, coalesce(domain_category, best) AS class, CASE WHEN domain_category IS NOT NULL THEN least(10, domain_importance + boost) WHEN best IS NOT NULL THEN 6 END AS class_importance, CASE WHEN domain_category IS NOT NULL THEN 'domain:' || domain_rule WHEN best IS NOT NULL THEN 'keywords:' || best END AS class_reason FROM kw")
add("c04_estimate_importance", lambda t: ids(_est(t), "est_score", "est_confidence"), f"WITH {DOMAIN_SQL}, {EST_SQL} SELECT id, est_score, est_confidence FROM est")
CONF = lambda c, x: f"CASE WHEN {' OR '.join(f'regexp_matches({x}, {chr(39)}(?i){Q(p)}{chr(39)})' for p, _ in R.CONFIRMING[c])} THEN least(2, {_sum([f'CASE WHEN regexp_matches({x}, {chr(39)}(?i){Q(p)}{chr(39)}) THEN {b} ELSE 0 END' for p, b in R.CONFIRMING[c]])}) END"
add("c05_rule_only", lambda t: ids(classify.rule_only(t.items.withColumn("title", F.concat(F.col("title"), F.lit(" AI model"))), [*R.HIGH_CONFIDENCE, ("example.net", "AI", "7")]), "rule_category", "rule_importance"),
    f"SELECT id, 'AI' AS rule_category, least(6, 7 + b) AS rule_importance FROM (SELECT id, {CONF('AI', 'x')} AS b FROM (SELECT id, concat_ws(' ', title || ' AI model', substring(content, 1, 300)) AS x FROM items WHERE ({HOST} = 'example.net' OR ends_with({HOST}, '.example.net')) AND length(content) <= 1000)) WHERE b >= 1")
add("c06_route_tier", lambda t: ids(classify.route_tier(_est(t)), "tier"), f"WITH {DOMAIN_SQL}, {EST_SQL} SELECT id, CASE WHEN est_score >= 7 OR est_confidence < 0.5 OR unknown THEN 'heavy' ELSE 'light' END AS tier FROM est")
add("c07_screen_route", lambda t: ids(classify.screen_route(t.items.filter("processed").select("id", F.col("importance_score").alias("importance"), ((F.col("id") % 10) / 10.0).alias("confidence")), F.col("id") % 4 == 0), "refine"), "SELECT id, importance_score >= 7 OR (importance_score >= 5 AND id % 10 < 5) OR (id % 4 = 0 AND importance_score >= 10) AS refine FROM items WHERE processed")
add("c08_assign_batches", lambda t: ids(classify.assign_batches(t.items.withColumn("part", F.col("source_type"))), "size_class", "batch"), "SELECT id, size_class, CAST(floor((row_number() OVER (PARTITION BY size_class, source_type ORDER BY id) - 1) / CASE size_class WHEN 'short' THEN 12 ELSE 6 END) AS BIGINT) AS batch FROM (SELECT *, CASE WHEN length(coalesce(content, '')) < 500 THEN 'short' ELSE 'long' END AS size_class FROM items)")
add("c09_reprocess_list", lambda t: ids(classify.reprocess_list(classify.route_tier(_est(t)))), f"WITH {DOMAIN_SQL}, {EST_SQL} SELECT id FROM est WHERE NOT (est_score >= 7 OR est_confidence < 0.5 OR unknown) AND importance_score >= 7")
add("c10_prefilter", lambda t: ids(_routed(t), "route"), f"WITH {DOMAIN_SQL}, {EST_SQL}, {ROUTE} SELECT id, {ROUTED} FROM routed")
add("c11_exact_duplicates", lambda t: dedup.exact_duplicates(t.items, X.content_hash(F.col("title"), F.col("content"))), f"SELECT {CONTENT16} AS key, max(id) AS keep, count(*) AS n FROM items GROUP BY 1 HAVING count(*) > 1")
NAMES = lambda x: "list_distinct([lower(e) FOR e IN list_concat(" + ", ".join(f"regexp_extract_all({x}, '(?i){Q(p)}', 1)" for p in WORDS) + ")])"
FEAT = f"""fa AS (SELECT id, title, category, published_at AS at, {NORM} AS norm, {NAMES("concat_ws(' ', title, content)")} AS names FROM items),
fb AS (SELECT id, event_title AS title, category, last_updated_at AS at, {_chain('lower(event_title)', X.TITLE_STEPS)} AS norm, {NAMES('event_title')} AS names FROM clusters WHERE last_updated_at >= {AGO(3)}),
ga AS (SELECT *, list_distinct({KW('title')}) AS w, list_distinct({KW('norm')}) AS v FROM fa), gb AS (SELECT *, list_distinct({KW('title')}) AS w, list_distinct({KW('norm')}) AS v FROM fb),
pr AS (SELECT a.id, b.id AS cluster, CASE WHEN a.title = '' OR b.title = '' THEN 0 WHEN a.norm = b.norm THEN 1 ELSE coalesce(len(list_intersect(a.v, b.v)) / nullif(len(list_distinct(list_concat(a.v, b.v))), 0), 0) END AS ti, len(list_intersect(a.names, b.names)) AS n, len(list_intersect(a.w, b.w)) AS k, a.category = b.category AS same, abs(CAST(a.at AS DATE) - CAST(b.at AS DATE)) <= 1 AS near FROM ga a, gb b),
sc AS (SELECT id, cluster, round(ti * 0.35 + least(n, 3) * 0.25 / 3 + CASE WHEN n >= 2 THEN 0.15 ELSE 0 END + least(k, 5) * 0.1 / 5 + CASE WHEN same THEN 0.05 ELSE 0 END + CASE WHEN near THEN 0.05 ELSE 0 END, 6) AS score,
 CASE WHEN least(n, 3) * 0.25 / 3 + CASE WHEN n >= 2 THEN 0.15 ELSE 0 END > 0.2 THEN 'entity' WHEN ti >= 0.8 THEN 'title' ELSE 'keyword' END AS method FROM pr),
ca AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, cluster) AS rank FROM sc WHERE score >= CASE method WHEN 'entity' THEN 0.35 WHEN 'keyword' THEN 0.5 ELSE 0.4 END) WHERE rank <= 5)"""
_cand = lambda t: events.cluster_candidates(t.items, t.clusters, AS_OF, 3, 5, WORDS)
add("j11_cluster_candidates", lambda t: _cand(t).select("id", "cluster", "score", "method", "rank"), f"WITH {FEAT} SELECT id, cluster, score, method, rank FROM ca")
add("c13_accept_candidates", lambda t: events.accept_candidates(_cand(t)).select("id", "cluster", "accepted"), f"WITH {FEAT} SELECT id, cluster, score >= 0.55 AS accepted FROM ca WHERE rank = 1")
add("c12_event_score", lambda t: events.candidates(store.settled(events.features(t.items, "title", F.col("content"), WORDS), "item-features"), store.settled(events.features(t.clusters, "event_title", None, WORDS, "last_updated_at"), "cluster-features")).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 3).alias("total")),
    f"WITH {FEAT.replace(f'WHERE last_updated_at >= {AGO(3)}', '')} SELECT method, count(*) AS n, round(sum(score), 3) AS total FROM sc WHERE score >= CASE method WHEN 'entity' THEN 0.35 WHEN 'keyword' THEN 0.5 ELSE 0.4 END GROUP BY 1")
_free = lambda t: items.unclustered(t.items, t.members, AS_OF, 5, 24, None)
# the greedy clustering of a set of items `fr` (with `bn`, the batch), one item after another: {n} names the step, {known} the clusters born in earlier batches
ORDER = "-coalesce(importance_score, 0), published_at DESC, id"
_score = lambda n: f"round(ti * 0.35 + least({n}, 3) * 0.25 / 3 + CASE WHEN {n} >= 2 THEN 0.15 ELSE 0 END + least(k, 5) * 0.1 / 5 + CASE WHEN same THEN 0.05 ELSE 0 END + CASE WHEN near THEN 0.05 ELSE 0 END, 6)"
_title_part = "CASE WHEN a.title = '' OR b.title = '' THEN 0 WHEN a.norm = b.norm THEN 1 ELSE coalesce(len(list_intersect(a.v, b.v)) / nullif(len(list_distinct(list_concat(a.v, b.v))), 0), 0) END AS ti, len(list_intersect(a.w, b.w)) AS k, a.category = b.category AS same, abs(CAST(a.at AS DATE) - CAST(b.at AS DATE)) <= 1 AS near"


def _featured(name: str, rows: str, title: str = "title", body: str = "concat_ws(' ', title, content)", at: str = "published_at", more: str = "") -> str:
    norm = f"{_chain(f'lower({title})', X.TITLE_STEPS)}"
    return f"{name}0 AS (SELECT id, {title} AS title, category, {at} AS at, {norm} AS norm, {NAMES(body)} AS names{more} FROM {rows}), {name} AS MATERIALIZED (SELECT *, list_distinct({KW('title')}) AS w, list_distinct({KW('norm')}) AS v FROM {name}0)"


def _greedy_sql(n: str, rows: str) -> str:
    """CTEs l{n} (id, other, score: who accepts whom) and o{n} (id, leader, score, role) of the items in `rows`."""
    return f"""{_featured(f"f{n}", rows, more=f", coalesce(importance_score, 0) >= 6 AS can, row_number() OVER (ORDER BY {ORDER}) AS k0")},
p{n} AS (SELECT a.id, b.id AS other, len(list_intersect(a.names, b.names)) AS n, {_title_part} FROM f{n} a JOIN f{n} b ON b.k0 < a.k0 AND b.can),
l{n} AS MATERIALIZED (SELECT id, other, {_score('n')} AS score FROM p{n} WHERE {_score('n')} >= 0.55),
s{n} AS MATERIALIZED (SELECT f.k0, f.id, f.can, coalesce(list(other) FILTER (WHERE other IS NOT NULL), []) AS adj FROM f{n} f LEFT JOIN l{n} USING (id) GROUP BY ALL),
r{n} AS (SELECT CAST(0 AS BIGINT) AS k0, CAST([] AS BIGINT[]) AS led UNION ALL SELECT s.k0, CASE WHEN list_has_any(r.led, s.adj) OR NOT s.can THEN r.led ELSE list_append(r.led, s.id) END FROM r{n} r JOIN s{n} s ON s.k0 = r.k0 + 1),
h{n} AS MATERIALIZED (SELECT unnest(led) AS id FROM (SELECT led FROM r{n} ORDER BY k0 DESC LIMIT 1)),
o{n} AS MATERIALIZED (SELECT f.id, CASE WHEN h.id IS NOT NULL THEN f.id ELSE m.other END AS leader, m.score, CASE WHEN h.id IS NOT NULL THEN 'leader' WHEN m.other IS NOT NULL THEN 'member' ELSE 'single' END AS role
 FROM f{n} f LEFT JOIN h{n} h USING (id) LEFT JOIN (SELECT l.id, arg_min(l.other, struct_pack(s := -l.score, o := l.other)) AS other, max(l.score) AS score FROM l{n} l JOIN h{n} g ON g.id = l.other WHERE l.id NOT IN (SELECT id FROM h{n}) GROUP BY l.id) m USING (id))"""


UNCLUSTERED = f"(SELECT * FROM items WHERE {FREE} AND (cluster_attempted_at IS NULL OR cluster_attempted_at < {TS(AS_OF)} - to_seconds(86400)) AND id NOT IN (SELECT content_item_id FROM members))"
add("c14_cluster_events", lambda t: events.cluster_events(_free(t), WORDS), f"WITH RECURSIVE {_greedy_sql('', UNCLUSTERED)} SELECT id, leader, score, role FROM o")
add("c14_attempted", lambda t: ids(store.update_where(t.items, _free(t).select("id"), {"cluster_attempted_at": F.lit(AS_OF).cast("timestamp_ntz")}), "cluster_attempted_at"),
    f"SELECT id, CASE WHEN {FREE} AND (cluster_attempted_at IS NULL OR cluster_attempted_at < {TS(AS_OF)} - to_seconds(86400)) AND id NOT IN (SELECT content_item_id FROM members) THEN {TS(AS_OF)} ELSE cluster_attempted_at END AS cluster_attempted_at FROM items")
add("c15_update_centroids", lambda t: vectors.update_centroids(vectors.centroids(t.members.filter("content_item_id % 2 = 0"), t.content_embeddings), t.members.filter("content_item_id % 2 = 1"), t.content_embeddings).select("event_cluster_id", "members", F.posexplode("centroid").alias("pos", "x")).select("event_cluster_id", "members", "pos", F.round("x", 4).alias("x")),
    """WITH e AS (SELECT event_cluster_id, content_item_id % 2 AS odd, p, avg(CAST(embedding[p] AS DOUBLE)) AS m, count(*) AS n FROM members JOIN content_embeddings ON content_id = content_item_id, generate_series(1, 64) AS g(p) GROUP BY 1, 2, 3),
u AS (SELECT event_cluster_id, odd, p, n, m / sqrt(sum(m * m) OVER (PARTITION BY event_cluster_id, odd)) AS x FROM e), b AS (SELECT event_cluster_id, p, sum(n) AS n, sum(n * x) AS x FROM u GROUP BY 1, 2)
SELECT event_cluster_id, CAST(n AS BIGINT) AS members, CAST(p - 1 AS INTEGER) AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY event_cluster_id)), 4) AS x FROM b""")
add("c16_extract_actions", lambda t: classify.extract_actions(t.items.withColumn("actionable_items", F.expr("transform(array(state, category), x -> struct(coalesce(x, 'none') AS type, title AS description, CASE WHEN delivered THEN 'low' ELSE 'high' END AS priority))"))),
    "SELECT id, coalesce(unnest([state, category]), 'none') AS type, title AS description, CASE WHEN delivered THEN 'low' ELSE 'high' END AS priority FROM items WHERE importance_score IS NULL OR importance_score >= 7")
TERMS = "[w FOR w IN regexp_extract_all(lower(concat_ws(' ', title, content, coalesce(summary, ''), category, author)), '([\\p{L}\\p{N}]+)', 1)]"


def _kept(t: Tables, name: str, rows: DataFrame, fields: tuple[str, ...] = search.FIELDS) -> search.SearchIndex:
    """The kept index of rows in the shared folder; it is brought up to date when the files behind the items are others."""
    index = search.SearchIndex(t.spark, f"{store.shared_dir(t.spark)}/{name}-{hashlib.sha256(t.dir.encode()).hexdigest()[:12]}", fields)
    index.refresh(rows, search.file_state(t.documents, t.labels, t.pages))
    return index


def _updated(t: Tables) -> DataFrame:
    """Postings after all items came with their titles for contents, then as they are, and the archived ones went."""
    index = search.SearchIndex(t.spark, store.new_path(t.spark, "search-updates"))
    index.upsert(t.items.withColumn("content", F.col("title")))
    index.upsert(t.items)
    index.delete(t.items.filter("state = 'archived'"))
    return index.postings()


add("c17_search", lambda t: ids(search.search(_kept(t, "search-items", t.items).postings(), t.items, "the OR que th* NOT with", None, 3, 50)), f"SELECT id FROM (SELECT *, {TERMS} AS w FROM items) WHERE (list_contains(w, 'the') OR list_contains(w, 'que')) AND len([x FOR x IN w IF starts_with(x, 'th')]) > 0 AND NOT list_contains(w, 'with') AND importance_score >= 3 ORDER BY importance_score DESC, published_at DESC, id LIMIT 50")
add("c17_search_updates", lambda t: ids(search.search(_updated(t), t.items, "the OR que th* NOT with", limit=None)), f"SELECT id FROM (SELECT *, {TERMS} AS w FROM items) WHERE (list_contains(w, 'the') OR list_contains(w, 'que')) AND len([x FOR x IN w IF starts_with(x, 'th')]) > 0 AND NOT list_contains(w, 'with') AND coalesce(state, '') <> 'archived'")
GRAMS = r"""SELECT id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS g FROM (SELECT id, list_filter(regexp_split_to_array(lower(substring(concat_ws(' ', title, content), 1, 500)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM items)"""
add("c18_embed", lambda t: vectors.embed(t.items).select("content_id", F.posexplode("embedding").alias("pos", "x")).filter("x <> 0").select("content_id", "pos", F.round(F.col("x").cast("double"), 4).alias("x")),
    f"""WITH gr AS ({GRAMS}), s AS (SELECT id, CAST(CAST('0x' || substring(md5(g), 1, 8) AS BIGINT) % 256 AS INTEGER) AS k, sum(CASE WHEN substring(md5(g), 9, 1) < '8' THEN 1.0 ELSE -1.0 END) AS v FROM gr GROUP BY 1, 2),
n AS (SELECT id, sqrt(sum(CAST(v * v AS DOUBLE))) AS norm FROM s GROUP BY 1) SELECT id AS content_id, k AS pos, round(CAST(CAST(v / norm AS FLOAT) AS DOUBLE), 4) AS x FROM s JOIN n USING (id) WHERE v <> 0""")


def _feed(t: Tables) -> DataFrame:
    """The pages as a feed: written as XML, read back by the reader."""
    none = F.lit(None).cast("string")
    cols = {"guid": F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("g"), "page_id")), "link": F.col("url"), "comments": F.when(F.col("page_id") % 2 > 0, F.concat(F.lit("https://comments.example.org/"), "page_id")), "title": F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), "description": F.col("html"), "author": none, "pubDate": F.date_format(F.timestamp_seconds(F.col("page_id") * 86400), "EEE, dd MMM yyyy HH:mm:ss Z")}
    path = store.new_path(t.spark, "feed")
    t.pages.select(*(c.alias(n) for n, c in cols.items())).write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)
    return feeds.read_feed_xml(t.spark, path, "hackernews")


add("s01_feed_rows", lambda t: _feed(t).withColumn("published_at", F.col("published_at").cast("timestamp_ntz")), f"""SELECT 'hackernews' AS source_type, CASE WHEN page_id % 3 > 0 THEN 'g' || page_id ELSE url END AS external_id, {_entities_sql("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title, substring({_entities_sql(BARE)}, 1, 5000) AS content,
 CASE WHEN page_id % 2 > 0 THEN 'https://comments.example.org/' || page_id ELSE url END AS url, '' AS author, TIMESTAMP '1970-01-01' + to_seconds(page_id * 86400) AS published_at FROM pages""")


def _posts(t: Tables) -> DataFrame:
    """The items as posts: written as JSON lines, read back by the reader."""
    path = store.new_path(t.spark, "posts")
    t.items.select(F.col("id").cast("string").alias("id"), F.col("content").alias("text"), "url", F.substring("author", 2, 100).alias("user"), F.date_format("published_at", "EEE MMM dd HH:mm:ss '+0000' yyyy").alias("created_at")).write.json(path)
    return feeds.read_post_json(t.spark, path)


LINE = "split_part(coalesce(content, ''), chr(10), 1)"
add("s02_post_rows", lambda t: _posts(t).withColumn("published_at", F.col("published_at").cast("timestamp_ntz")), f"SELECT 'twitter' AS source_type, CAST(id AS VARCHAR) AS external_id, CASE WHEN length(coalesce(content, '')) > 100 THEN substring({LINE}, 1, 97) || '...' ELSE substring({LINE}, 1, 100) END AS title, coalesce(content, '') AS content, coalesce(url, 'https://x.com/i/status/' || id) AS url, author, published_at FROM items")


def _report(t: Tables) -> DataFrame:
    """Two parts of a report, written as a version each time; the latest is read."""
    path = store.new_path(t.spark, "report")
    store.write_report({"categories": t.items.limit(0).select("category", F.lit(0).alias("n"))}, path)
    store.write_report({"categories": stats.category_stats(t.items), "states": stats.state_stats(t.items)}, path)
    rows = [store.read_report(t.spark, path, p).select(F.lit(p).alias("part"), F.col(c).alias("name"), "n") for p, c in (("categories", "category"), ("states", "state"))]
    return store.union_all(rows)


add("s08_write_report", _report, "SELECT 'categories' AS part, category AS name, count(*) AS n FROM items GROUP BY 2 UNION ALL SELECT 'states', coalesce(state, 'unread'), count(*) FROM items GROUP BY 2")
REPLY = lambda: F.to_json(F.struct(F.col("title").alias("summary"), F.col("category"), F.coalesce(F.col("importance_score") * 2 - 6, F.lit(0)).cast("string").alias("importance_score")))
add("p22_parse_results", lambda t: feeds.parse_results(t.items.select("id", F.when(F.col("delivered"), F.concat(F.lit("Here it is:\n```json\n"), REPLY(), F.lit("\n```"))).when(F.col("state") == "flagged", F.lit("no object")).otherwise(REPLY()).alias("reply")))[0].select("id", "summary", "category", "importance_score"),
    "SELECT id, title AS summary, '其他' AS category, greatest(1, least(10, coalesce(importance_score * 2 - 6, 0))) AS importance_score FROM items WHERE title IS NOT NULL AND (delivered OR coalesce(state, '') <> 'flagged')")
ONE = lambda: F.when(F.col("state").isNotNull(), F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.translate("title", "{}", "").alias("summary"), F.col("importance_score").cast("string").alias("importance_score"))))
add("p23_parse_batches", lambda t: feeds.parse_batches(t.items.withColumn("one", ONE()).groupBy((F.col("id") / 6).cast("int").alias("batch")).agg(F.array_sort(F.collect_list(F.struct("id", "one"))).alias("r")).select("batch", F.col("r.id").alias("ids"), F.array_join("r.one", "\n").alias("reply"))).select("batch", "item", "summary", "importance_score", "success"),
    "SELECT CAST(floor(id / 6) AS INTEGER) AS batch, id AS item, CASE WHEN ok THEN translate(title, '{}', '') END AS summary, CASE WHEN ok THEN importance_score END AS importance_score, ok AS success FROM (SELECT *, state IS NOT NULL AND title IS NOT NULL AS ok FROM items)")


def _nested(t: Tables) -> DataFrame:
    """JSON text from the items' own columns, a broken one where a state is flagged; nested and taken apart again."""
    text = lambda *cols: F.to_json(F.array(F.struct(*cols)))
    rows = t.items.withColumns({
        "key_points": text(F.lit("k").alias("type"), F.col("title").alias("value"), F.col("category").alias("impact")),
        "impact_assessment": F.to_json(F.struct(F.col("author").alias("short_term"), F.col("source_type").alias("certainty"))),
        "actionable_items": F.when(F.col("state") == "flagged", F.lit("[{")).otherwise(text(F.col("state").alias("type"), F.col("external_id").alias("description"))),
    })
    return feeds.nest_json(rows).select("id", F.col("key_points")[0]["value"].alias("point"), F.col("impact_assessment.certainty").alias("certainty"), F.col("actionable_items")[0]["type"].alias("action"), F.col("actionable_items")[0]["description"].alias("description"))


add("p26_nest_json", _nested, "SELECT id, CASE WHEN ok THEN title END AS point, CASE WHEN ok THEN source_type END AS certainty, CASE WHEN ok THEN state END AS action, CASE WHEN ok THEN external_id END AS description FROM (SELECT *, coalesce(state, '') <> 'flagged' AS ok FROM items)")
add("p27_skip_results", lambda t: classify.skip_results(_skipped(t)).select("id", "summary", "importance_score", "skip_reason"), f"WITH {DOMAIN_SQL}, {EST_SQL} SELECT id, '[Skipped] ' || CASE WHEN length(title) > 40 THEN substring(title, 1, 40) || '...' ELSE title END AS summary, 1 AS importance_score, skip_reason FROM (SELECT id, title, {SKIP} AS skip_reason FROM est) WHERE skip_reason IS NOT NULL")
add("p28_call_tokens", lambda t: t.usage.groupBy("call_type").agg(F.sum(X.call_tokens(F.col("call_type"), {"click": 900, "view": 300})).alias("tokens")), "SELECT call_type, sum(CASE call_type WHEN 'click' THEN 900 WHEN 'view' THEN 300 ELSE 500 END) AS tokens FROM usage GROUP BY 1")
add("w06_sample_titles", lambda t: topics.discover_by_entities(t.items, 5, WORDS).select("name", F.array_join("samples", " | ").alias("samples")),
    f"WITH r AS (SELECT DISTINCT id, published_at, title, unnest({ENT}) AS name FROM items), c AS (SELECT name, count(*) AS f FROM (SELECT unnest({ENT}) AS name FROM items) GROUP BY 1 HAVING count(*) >= 5 ORDER BY f DESC, name LIMIT 50) SELECT name, string_agg(title, ' | ' ORDER BY published_at, id) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY published_at, id) AS n FROM r) JOIN c USING (name) WHERE n <= 3 GROUP BY name")

# -- the user's own rules and functions
_hosts = lambda t: t.pages.select(X.url_host(F.col("url")).alias("domain_rule")).distinct().withColumns({"domain_category": F.substring_index("domain_rule", ".", 1), "domain_importance": F.length("domain_rule") % 10})
add("e01_rules_in_a_table", lambda t: ids(classify.classify_domain(t.items, _hosts(t)), "domain_rule", "domain_category", "domain_importance"), f"SELECT id, h AS domain_rule, split_part(h, '.', 1) AS domain_category, CAST(length(h) % 10 AS INTEGER) AS domain_importance FROM (SELECT id, {HOST} AS h FROM items)")


def _lengths(frames):
    for x in frames:
        yield pd.DataFrame({"content_id": x["id"], "embedding": [[float(len(v)), float(v.count(" "))] for v in x["text"]]})


def _marks(frames):
    for x in frames:
        yield pd.DataFrame({"id": x["id"], "marks": x["content"].fillna("").str.count(r"[.!?]").astype("int64")})


add("e02_embed_by_function", lambda t: vectors.embed(t.items, _lengths).select("content_id", F.col("embedding")[0].cast("long").alias("chars"), F.col("embedding")[1].cast("long").alias("blanks")), "SELECT id AS content_id, length(x) AS chars, length(x) - length(replace(x, ' ', '')) AS blanks FROM (SELECT id, substring(concat_ws(' ', title, content), 1, 500) AS x FROM items)")
add("e03_enrich", lambda t: vectors.enrich(t.items.select("id", "content"), _marks, "id long, marks long"), "SELECT id, length(x) - length(replace(replace(replace(x, '.', ''), '!', ''), '?', '')) AS marks FROM (SELECT id, coalesce(content, '') AS x FROM items)")
add("x01_ingest", lambda t: ids(store.above_cursor(t.items, t.subscriptions.select(F.col("id").alias("subscription_id"), (F.col("id") * 40).alias("last")), "subscription_id", "id")[0]), "SELECT i.id FROM items i LEFT JOIN subscriptions s ON s.id = i.subscription_id WHERE s.id IS NULL OR i.id > s.id * 40")
add("x03_windowed_counts", lambda t: jobs.windowed_counts(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 day").withColumn("start", F.col("start").cast("timestamp_ntz")), "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
_events = lambda t: t.events.withColumn("ts", F.col("ts").cast("timestamp"))
_wall = lambda df: df.withColumn("start", F.col("start").cast("timestamp_ntz"))
HOURS = "(SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2)"
ALERTS = f"SELECT a.start, a.event_type, a.n, coalesce(b.n, 0) AS previous FROM {HOURS} a LEFT JOIN {HOURS} b ON b.event_type = a.event_type AND b.start = a.start - INTERVAL 1 HOUR WHERE a.n >= 3 AND a.n >= greatest(coalesce(b.n, 0), 1) * 3"
add("x04_trend_alerts", lambda t: _wall(jobs.trend_alerts(_events(t), "ts", "event_type", "1 hour")), ALERTS)
ORACLE_X5 = "SELECT call_type, count(*) AS calls, count(*) FILTER (WHERE cached) AS cached, sum(CASE WHEN cached THEN 0 ELSE input_tokens END) AS input_tokens, sum(CASE WHEN cached THEN 0 ELSE output_tokens END) AS output_tokens FROM usage GROUP BY 1"
add("x05_usage_totals", lambda t: jobs.usage_stream(t.usage), ORACLE_X5)


# -- the same on streams: rows as files that a stream finds, batch by batch
def _usage_of(stream: DataFrame) -> DataFrame:
    return stream.selectExpr("event_type AS call_type", "ts AS timestamp", "user_id % 3 = 0 AS cached", "cast(floor(value) AS long) AS input_tokens", "event_id % 500 AS output_tokens", "event_type <> 'error' AS success")


#: The days that part the items into the batches of a stream.
CUTS = ("2024-01-11 00:00:00", "2024-01-21 00:00:00")


def _in_batches(t: Tables, rows: DataFrame, at: str, name: str, files: int = 4, late: Column | None = None, again: bool = False) -> tuple[DataFrame, str]:
    """rows as a stream whose batches are the spans between CUTS: each is written as so many files, which one trigger takes. late moves rows to
    so many batches after their own; again brings a span's rows with the next batch, too. The folder is for the stream's own state."""
    path = store.new_path(t.spark, name)
    place = sum((F.when(F.col(at) >= F.lit(c).cast("timestamp_ntz"), 1).otherwise(0) for c in CUTS), F.lit(0))
    place = place if late is None else F.least(place + late, F.lit(len(CUTS)))
    for k in range(len(CUTS) + 1):
        rows.filter((place == k) | (place == k - 1) if again else place == k).repartition(files).write.parquet(f"{path}/in/part={k}")
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/in/part=*")
    return stream, path


#: Events by batch: every 50th comes with the batch after its own, every 50th but one with the third.
LATE = "CASE event_id % 50 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END"
PART = " + ".join(f"CASE WHEN ts >= {TS(c)} THEN 1 ELSE 0 END" for c in CUTS)
BATCHED = f"(SELECT *, least({PART} + {LATE}, 2) AS bn FROM events)"


def _late_events(t: Tables, name: str) -> tuple[DataFrame, str]:
    stream, path = _in_batches(t, t.events, "ts", name, late=F.expr(LATE))
    return stream.withColumn("ts", F.col("ts").cast("timestamp")), path


def _ingested(t: Tables) -> DataFrame:
    """Files that overlap: each batch brings the events of the one before it once more. Only what is beyond a user's cursor arrives."""
    stream, path = _in_batches(t, t.events, "ts", "ingest", again=True)
    write = jobs.ingest_batch(f"{path}/rows", f"{path}/cursors", "user_id", "event_id")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{path}/rows").select("event_id", "user_id", F.col("n").alias("batch"))


def _cached(t: Tables) -> DataFrame:
    stream, _ = _in_batches(t, t.events, "ts", "ttl")
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("answer", F.concat(F.col("event_type"), F.lit(":"), F.col("event_id")))
    with jobs.rocksdb(t.spark):
        return jobs.run_once(jobs.ttl_cache_stream(rows, "user_id", "ts", "answer", 86_400_000, "event_id"), "append", "ttl").select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "hit", "value")


def _lasting(t: Tables) -> DataFrame:
    """Items come in three batches and join clusters that earlier batches have left, or each other."""
    stream, path = _in_batches(t, t.items, "published_at", "clustered")
    table = clusters.ClusterTable(t.spark, f"{path}/table").create()
    step = clusters.cluster_batch(table, WORDS, days=3650)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    now = table.clusters(len(CUTS) + 1).select(F.col("id").alias("event_cluster_id"), "event_title", "last_updated_at", "article_count")
    return table.members(len(CUTS) + 1).join(now, "event_cluster_id", "left").select(F.col("content_item_id").alias("id"), F.col("event_cluster_id").alias("cluster"), "score", "role", F.col("n").alias("batch"), "event_title", "last_updated_at", "article_count")


SHORT = "CASE WHEN length(trim(title)) <= 50 THEN trim(title) ELSE trim(CASE WHEN 50 - strpos(reverse(substring(trim(title), 1, 50)), ' ') > 30 AND strpos(reverse(substring(trim(title), 1, 50)), ' ') > 0 THEN substring(trim(title), 1, 50 - strpos(reverse(substring(trim(title), 1, 50)), ' ')) ELSE substring(trim(title), 1, 50) END) END"


def _lasting_sql() -> str:
    """Batch after batch: items against the clusters of earlier batches, then among themselves."""
    parts = [f"it AS MATERIALIZED (SELECT *, {' + '.join(f'CASE WHEN published_at >= {TS(c)} THEN 1 ELSE 0 END' for c in CUTS)} AS bn FROM items WHERE source_type <> 'rss')"]
    parts.append(f"tm AS (SELECT bn, max(published_at) AS now FROM (SELECT published_at, {' + '.join(f'CASE WHEN published_at >= {TS(c)} THEN 1 ELSE 0 END' for c in CUTS)} AS bn FROM items) GROUP BY bn)")
    known = "(SELECT CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS event_title, CAST(NULL AS VARCHAR) AS category, CAST(NULL AS TIMESTAMP) AS last_updated_at, CAST(NULL AS BIGINT) AS article_count WHERE false)"
    for n in range(len(CUTS) + 1):
        parts.append(f"k{n} AS MATERIALIZED (SELECT * FROM {known})")
        parts.append(_featured(f"a{n}", f"(SELECT * FROM it WHERE bn = {n})"))
        parts.append(_featured(f"b{n}", f"k{n}", "event_title", "event_title", "last_updated_at"))
        parts.append(f"x{n} AS (SELECT a.id, b.id AS other, len(list_intersect(a.names, b.names)) AS n, {_title_part} FROM a{n} a, b{n} b)")
        parts.append(f"j{n} AS MATERIALIZED (SELECT id, arg_min(other, struct_pack(s := -score, o := other)) AS cluster, max(score) AS score FROM (SELECT id, other, {_score('n')} AS score FROM x{n}) WHERE score >= 0.55 GROUP BY id)")
        parts.append(_greedy_sql(str(n), f"(SELECT * FROM it WHERE bn = {n} AND id NOT IN (SELECT id FROM j{n}))"))
        parts.append(f"m{n} AS MATERIALIZED (SELECT id, cluster, score, 'joined' AS role, {n} AS batch FROM j{n} UNION ALL SELECT id, leader, CASE WHEN role = 'leader' THEN 1.0 ELSE score END, role, {n} FROM o{n})")
        parts.append(f"""c{n} AS MATERIALIZED (SELECT k.id, k.event_title, k.category, CASE WHEN m.n > 0 THEN greatest(last_updated_at, now) ELSE last_updated_at END AS last_updated_at, article_count + coalesce(m.n, 0) AS article_count
 FROM k{n} k CROSS JOIN (SELECT now FROM tm WHERE bn = {n}) LEFT JOIN (SELECT cluster AS id, count(*) AS n FROM m{n} GROUP BY 1) m USING (id)
 UNION ALL SELECT it.id, {SHORT}, coalesce(category, '其他'), now, m.n FROM it JOIN (SELECT cluster AS id, count(*) AS n FROM m{n} WHERE cluster NOT IN (SELECT id FROM k{n}) GROUP BY 1) m USING (id) CROSS JOIN (SELECT now FROM tm WHERE bn = {n}))""")
        known = f"c{n}"
    members = " UNION ALL ".join(f"SELECT * FROM m{n}" for n in range(len(CUTS) + 1))
    return f"WITH RECURSIVE {', '.join(parts)} SELECT m.id, m.cluster, CAST(m.score AS DOUBLE) AS score, m.role, m.batch, c.event_title, c.last_updated_at, CAST(c.article_count AS BIGINT) AS article_count FROM ({members}) m LEFT JOIN {known} c ON c.id = m.cluster"


INGESTED = f"WITH b AS (SELECT event_id, user_id, {PART} AS bn FROM events UNION ALL SELECT event_id, user_id, {PART} + 1 FROM events WHERE ts < {TS(CUTS[-1])}) SELECT event_id, user_id, CAST(bn AS INTEGER) AS batch FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id ORDER BY bn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM b) WHERE last IS NULL OR event_id > last"
add("x01_ingest_stream", _ingested, INGESTED)
add("x02_dedup_stream", lambda t: jobs.run_once(jobs.dedup_stream(_late_events(t, "dedup-in")[0], ["user_id", "event_type"], "ts", "3650 days").select("user_id", "event_type"), "append", "dedup"), "SELECT DISTINCT user_id, event_type FROM events")
# in append mode a window ends with the watermark: a row counts unless its window had ended two batches before, and windows that are open at the end don't show
WM = "(SELECT max(ts) FROM x WHERE bn <= {0}) - INTERVAL 1 HOUR"
DAYS = f"WITH x AS {BATCHED} SELECT * FROM (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM x WHERE bn < 2 OR date_trunc('day', ts) + INTERVAL 1 DAY > {WM.format(0)} GROUP BY 1, 2) WHERE start + INTERVAL 1 DAY <= {WM.format(2)}"
add("x03_windowed_counts_stream", lambda t: _wall(jobs.run_once(jobs.windowed_counts(_late_events(t, "windows-in")[0], "ts", "event_type", "1 day"), "append", "windows")), DAYS)
LATE_ALERTS = f"""WITH x AS {BATCHED}, d AS (SELECT event_type, date_trunc('hour', ts) AS own, bn, unnest([date_trunc('hour', ts), date_trunc('hour', ts) + INTERVAL 1 HOUR]) AS start FROM x),
c AS (SELECT start, event_type, count(*) FILTER (WHERE own = start) AS n, count(*) FILTER (WHERE own < start) AS previous FROM d WHERE bn < 2 OR start + INTERVAL 1 HOUR > {WM.format(0)} GROUP BY 1, 2)
SELECT start, event_type, n, previous FROM c WHERE n >= 3 AND n >= greatest(previous, 1) * 3 AND start + INTERVAL 1 HOUR <= {WM.format(2)}"""
add("x04_trend_alerts_stream", lambda t: _wall(jobs.run_once(jobs.trend_alerts(_late_events(t, "alerts-in")[0], "ts", "event_type", "1 hour"), "append", "alerts")), LATE_ALERTS)
add("x05_usage_stream", lambda t: jobs.run_once(jobs.usage_stream(_usage_of(_late_events(t, "usage-in")[0])), "update", "usage", ["call_type"]), ORACLE_X5)
add("x06_ttl_cache_stream", _cached, """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, epoch_ms(ts) AS tm, event_type || ':' || event_id AS answer, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS k FROM events),
r AS (SELECT user_id, event_id, k, false AS hit, answer AS value, tm + 86400000 AS ends FROM e WHERE k = 1
 UNION ALL SELECT e.user_id, e.event_id, e.k, e.tm < r.ends, CASE WHEN e.tm < r.ends THEN r.value ELSE e.answer END, CASE WHEN e.tm < r.ends THEN r.ends ELSE e.tm + 86400000 END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, event_id, hit, value FROM r""")
add("x07_cluster_stream", _lasting, _lasting_sql())

# -- checks
add("q01_unknown_subscription", checks.unknown_subscription, "SELECT id FROM items WHERE subscription_id NOT IN (SELECT id FROM subscriptions)")
add("q02_duplicate_keys", checks.duplicate_keys, "SELECT source_type, external_id, count(*) AS n FROM items GROUP BY 1, 2 HAVING count(*) > 1")
add("q03_without_summary", checks.without_summary, "SELECT id FROM items WHERE processed AND summary IS NULL")
add("q04_bad_importance", checks.bad_importance, "SELECT id, importance_score FROM items WHERE importance_score < 1 OR importance_score > 10")
add("q05_empty_clusters", checks.empty_clusters, "SELECT id FROM clusters WHERE id NOT IN (SELECT event_cluster_id FROM members)")
add("q06_wrong_counts", checks.wrong_counts, "SELECT id, article_count, coalesce(n, 0) AS actual FROM clusters LEFT JOIN (SELECT event_cluster_id, count(*) AS n FROM members GROUP BY 1) m ON event_cluster_id = id WHERE article_count <> coalesce(n, 0)")
_some = lambda t, **tables: SimpleNamespace(**{n: getattr(t, n) for n in ("items", "members", "clusters")} | tables)
add("q07_lost_members", lambda t: checks.lost_members(_some(t, items=t.items.filter("processed"), clusters=t.clusters.filter("article_count < 40"))),
    "SELECT event_cluster_id, content_item_id, 'cluster' AS missing FROM members WHERE event_cluster_id NOT IN (SELECT id FROM clusters WHERE article_count < 40) UNION ALL SELECT event_cluster_id, content_item_id, 'item' FROM members WHERE content_item_id NOT IN (SELECT id FROM items WHERE processed)")
add("q08_unindexed", lambda t: checks.unindexed(t, _kept(t, "search-early", t.items.filter(F.col("published_at") < F.lit(START).cast("timestamp_ntz")), ("title", "summary")).postings()),
    f"SELECT id FROM items WHERE processed AND NOT (published_at < {TS(START)} AND regexp_matches(concat_ws(' ', title, summary), '[\\p{{L}}\\p{{N}}]'))")
add("q09_double_members", checks.double_members, "SELECT content_item_id, count(DISTINCT event_cluster_id) AS clusters FROM members GROUP BY 1 HAVING count(DISTINCT event_cluster_id) > 1")
add("q10_lost_actions", checks.lost_actions, "SELECT id, content_item_id FROM actions WHERE content_item_id NOT IN (SELECT id FROM items)")
add("q11_lost_topics", checks.lost_topics, "SELECT topic_id, count(*) AS n, 'content_topics' AS \"table\" FROM content_topics WHERE topic_id NOT IN (SELECT topic_id FROM topics) GROUP BY 1 UNION ALL SELECT topic_id, count(*), 'topic_snapshots' FROM topic_snapshots WHERE topic_id NOT IN (SELECT topic_id FROM topics) GROUP BY 1")
add("q12_expired_cache", lambda t: checks.expired_cache(t, AS_OF), f"SELECT content_hash FROM cache WHERE expires_at <= {TS(AS_OF)}")
add("q13_recently_clustered", checks.recently_clustered, "SELECT i.id, event_cluster_id, event_title, published_at FROM members m JOIN items i ON i.id = content_item_id JOIN clusters c ON c.id = event_cluster_id ORDER BY published_at DESC, i.id, event_cluster_id LIMIT 50")
add("q_validate", lambda t: checks.validate(t, AS_OF).groupBy("status").agg(F.count(F.lit(1)).alias("n")))
add("q_fix_counts", lambda t: checks.fix_counts(t).select("id", "article_count"), "SELECT event_cluster_id AS id, count(*) AS article_count FROM (SELECT *, row_number() OVER (PARTITION BY content_item_id ORDER BY similarity_score DESC, event_cluster_id) AS n FROM members) WHERE n = 1 GROUP BY 1")


def queries() -> dict[str, Callable]:
    return {name: (lambda spark, sf_dir, run=run: run(Tables(spark, sf_dir))) for name, run in SPARK.items()}
