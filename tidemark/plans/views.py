"""Model tables as views over the given tables; the same SQL runs in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31 00:00:00"

#: Of items, what is short is taken from the text before the joins, and labels and pages are one row a key, so that Spark leaves out a join
#: whose columns a query doesn't ask for and doesn't move whole texts for a query on titles.
SQL = {
    "items": """
SELECT d.doc_id AS id, CAST(substring(d.source, 4) AS BIGINT) AS subscription_id,
 CASE d.doc_id % 4 WHEN 0 THEN 'reddit' WHEN 1 THEN 'twitter' WHEN 2 THEN 'hackernews' ELSE 'rss' END AS source_type,
 concat('x', d.doc_id % 980) AS external_id,
 d.title AS title, d.text AS content, p.url AS url,
 concat('@', d.source) AS author, d.lang AS category,
 {T0} + {SEC}((d.doc_id * 7919) % 2592000) AS published_at,
 l.doc_id IS NOT NULL AS processed,
 CASE WHEN l.doc_id IS NULL THEN NULL WHEN d.doc_id % 97 = 0 THEN 11 WHEN l.toxic = 1 THEN 1 + d.doc_id % 3
      WHEN l.quality = 1 THEN 5 + d.doc_id % 6 ELSE 3 + d.doc_id % 3 END AS importance_score,
 CASE WHEN l.doc_id IS NULL OR d.doc_id % 50 = 1 THEN NULL ELSE d.head END AS summary,
 CASE d.doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'read' WHEN 2 THEN 'saved' WHEN 3 THEN 'archived'
      WHEN 4 THEN 'flagged' ELSE 'unread' END AS state,
 d.doc_id % 5 = 0 AS delivered,
 CASE WHEN d.doc_id % 5 = 0 THEN {T0} + {SEC}(86400 * (20 + d.doc_id % 11)) END AS delivered_at,
 CASE WHEN d.doc_id % 9 = 0 THEN {T0} + {SEC}(3600 * (690 + d.doc_id % 30)) END AS cluster_attempted_at
FROM (SELECT *, substring(split_part(text, chr(10), 1), 1, 100) AS title, substring(text, 1, 200) AS head FROM documents) d
 LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id
 LEFT JOIN (SELECT page_id, max(url) AS url FROM pages GROUP BY page_id) p ON p.page_id = d.doc_id""",
    "members": """
SELECT CAST(label AS BIGINT) AS event_cluster_id, vec_id AS content_item_id, CAST(vec_id % 100 AS DOUBLE) / 100 AS similarity_score
FROM embeddings WHERE vec_id % 3 <> 2
UNION ALL
SELECT CAST((label + 1) % 10 AS BIGINT), vec_id, CAST((vec_id * 7) % 100 AS DOUBLE) / 100 FROM embeddings WHERE vec_id % 25 = 0""",
    "clusters": """
SELECT m.event_cluster_id AS id, min_by(i.title, i.id) AS event_title, min_by(i.category, i.id) AS category,
 min(i.published_at) AS first_seen_at, max(i.published_at) AS last_updated_at,
 count(*) + CASE WHEN m.event_cluster_id % 3 = 0 THEN 1 ELSE 0 END AS article_count
FROM members m JOIN items i ON i.id = m.content_item_id GROUP BY m.event_cluster_id
UNION ALL SELECT 10, 'Empty event', 'en', {T0}, {T0}, 0""",
    "usage": """
SELECT event_id AS id, event_type AS call_type, ts AS timestamp, user_id % 3 = 0 AS cached, CAST(floor(value) AS BIGINT) AS input_tokens,
 event_id % 500 AS output_tokens, event_id % 1000 AS duration_ms, event_type <> 'error' AS success FROM events""",
    "cache": """
SELECT concat('h', event_id) AS content_hash, ts AS created_at, ts + {SEC}(86400 * (1 + event_id % 30)) AS expires_at FROM events""",
    "actions": """
SELECT o_orderkey AS id, o_orderkey % 1200 AS content_item_id,
 CASE WHEN o_orderpriority < '3' THEN 'high' WHEN o_orderpriority < '4' THEN 'mid' ELSE 'low' END AS priority,
 CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'dismissed' END AS status, o_orderdate AS created_at FROM orders""",
    "subscriptions": "SELECT DISTINCT CAST(substring(source, 4) AS BIGINT) AS id, source AS name FROM documents WHERE source <> 'src19'",
    "topics": """
SELECT * FROM (VALUES (1, 'alpha', 0, 'the'), (1, 'alpha', 1, 'ing'), (2, 'beta', 0, 'que'), (2, 'beta', 1, 'ment'),
 (2, 'beta', 2, 'ure'), (3, 'gamma', 0, 'schaft')) AS t(topic_id, name, pos, keyword)""",
    "content_embeddings": "SELECT vec_id AS content_id, embedding FROM embeddings",
    "content_topics": """
SELECT d.doc_id AS content_id, CAST(1 + d.doc_id % 3 AS BIGINT) AS topic_id, CAST((d.doc_id * 13) % 100 AS DOUBLE) / 100 AS relevance FROM documents d WHERE d.doc_id % 2 = 0""",
    "topic_snapshots": """
SELECT CAST(user_id % 40 AS BIGINT) AS topic_id, CAST(ts AS DATE) AS snapshot_date, count(*) AS article_count FROM events GROUP BY 1, 2""",
    "suggestions": """
SELECT user_id AS id, concat(CASE WHEN user_id % 2 = 0 THEN 'Topic' ELSE 'topic' END, CAST(user_id % 25 AS STRING)) AS name, count(*) AS frequency,
 round(CAST(user_id % 20 AS DOUBLE) / 20, 2) AS confidence,
 CASE user_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'accepted' ELSE 'rejected' END AS status, min(ts) AS suggested_at FROM events GROUP BY user_id""",
}
NEEDS = {"members": [], "clusters": ["members", "items"]}


def _text(name: str, t0: str, sec: str) -> str:
    return SQL[name].replace("{T0}", t0).replace("{SEC}", sec)


def duck(query: str) -> str:
    """A query over the views as one DuckDB statement."""
    texts = [f"{n} AS ({_text(n, chr(84) + 'IMESTAMP ' + chr(39) + '2024-01-01 00:00:00' + chr(39), 'to_seconds')})" for n in SQL]
    query, recursive = query.strip(), "RECURSIVE " if query.strip().startswith("WITH RECURSIVE ") else ""
    return f"WITH {recursive}" + ",\n".join(texts) + ("," + query.removeprefix("WITH ").removeprefix(recursive).join(" \n") if query.startswith("WITH ") else "\n" + query)


class Tables:
    """DataFrames of the given tables and of the views, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in SQL:
                text = _text(name, "TIMESTAMP_NTZ'2024-01-01 00:00:00'", "make_interval(0, 0, 0, 0, 0, 0, ")
                text = text.replace("make_interval(0, 0, 0, 0, 0, 0, (", "make_interval(0, 0, 0, 0, 0, 0, ")
                names = [t for t in (*SQL, "documents", "labels", "pages", "embeddings", "events", "orders") if t != name and f" {t}" in text]
                used = {}
                for t in names:
                    if re.search(rf"\b(FROM|JOIN) {t}\b", text):
                        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
                        used[t] = getattr(self, t)
                self.made[name] = self.spark.sql(text, **used) if used else self.spark.sql(text)
            else:
                self.made[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self.made[name]
