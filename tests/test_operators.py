"""Operators on small tables and on the driver's tables, against DuckDB or a plain computation."""

import datetime
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import events, search, store, topics, vectors
from tidemark.plans.queries import ORACLE, queries
from tidemark.plans.views import Tables
from tidemark.sources import feeds
from tidemark.streaming import jobs

DATA = "/root/testdata/sf0.001"
TABLES = "documents labels pages embeddings events orders conversations".split()
NAMES = ["f01_undelivered", "j05_digest_singles", "a13_cluster_rollup", "a14_event_timeline", "w02_topic_changes", "t03_build_digest", "p03_normalize_url", "p15_keywords", "c03_classify", "j11_cluster_candidates", "q11_lost_topics", "c17_search", "c17_search_updates", "q08_unindexed", "c01_classify_domain", "c15_update_centroids", "j10_match_topics", "t05_order_events", "q07_lost_members", "c08_assign_batches", "s01_feed_rows", "s02_post_rows", "s08_write_report", "p22_parse_results", "p23_parse_batches", "p26_nest_json", "p27_skip_results", "p28_call_tokens", "w06_sample_titles", "e01_rules_in_a_table", "e02_embed_by_function", "e03_enrich", "x01_ingest_stream", "x02_dedup_stream", "x04_trend_alerts_stream", "x05_usage_stream", "x03_windowed_counts_stream", "x06_ttl_cache_stream", "c14_attempted", "c14_cluster_events", "s05_versioned", "j12_nearest_processed", "a12_centroids"]


def plain(v):
    return "~" if v is None else f"{float(v):.6f}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries()[name](spark, DATA)
    mine = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    cur = con.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    theirs = sorted(tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall())
    assert sorted(cols) == sorted(df.columns)
    assert mine == theirs


def test_greedy_clustering_equals_one_by_one(spark):
    rows = [(i, f"{a} {b} {c}", "", 5 + i % 5, datetime.datetime(2024, 1, 1 + i % 3), "en", "hn") for i, (a, b, c) in enumerate((x, y, z) for x in ("apple", "pear", "plum") for y in ("red", "green") for z in ("big", "small", "tiny"))]
    items = spark.createDataFrame(rows, "id long, title string, content string, importance_score int, published_at timestamp_ntz, category string, source_type string")
    patterns = [r"(apple|pear|plum)", r"(red|green)"]
    got = {r.id: (r.role, r.leader) for r in events.cluster_events(items, patterns).collect()}
    f = events.features(items, "title", F.col("content"), patterns)
    score = {(r.id, r.other): r.score for r in events.candidates(f, f).collect()}
    leaders, want = [], {}
    for i, _, _, imp, at, _, _ in sorted(rows, key=lambda r: (-r[3], -r[4].timestamp(), r[0])):
        fit = sorted(((-score[(i, j)], j) for j in leaders if score.get((i, j), 0) >= 0.55))
        if fit:
            want[i] = ("member", fit[0][1])
        elif imp >= 6:
            leaders.append(i)
            want[i] = ("leader", i)
        else:
            want[i] = ("single", None)
    assert got == want


def test_items_join_clusters_or_lead(spark):
    at = datetime.datetime(2024, 1, 30)
    rows = [(i, t, "", 8, at, "en", "hn") for i, t in enumerate(["apple red big", "apple red huge", "plum blue", "plum blue sky", "stone"])]
    items = spark.createDataFrame(rows, "id long, title string, content string, importance_score int, published_at timestamp_ntz, category string, source_type string")
    clusters = spark.createDataFrame([(70, "Apple red big news", "en", at)], "id long, event_title string, category string, last_updated_at timestamp_ntz")
    patterns = [r"(apple|pear|plum)", r"(red|blue)"]
    got = {r.id: (r.role, r.cluster, r.leader) for r in events.cluster_new(items, clusters, "2024-01-31 00:00:00", patterns, least=0.45).collect()}
    assert got[0] == ("joined", 70, None) and got[1] == ("joined", 70, None)
    assert got[2] == ("leader", None, 2) and got[3] == ("member", None, 2)
    assert got[4] == ("leader", None, 4)


def test_a_lost_report_leaves_the_one_before(spark, tmp_path):
    path = str(tmp_path / "report")
    frame = lambda x: spark.createDataFrame([(x,)], "n int")
    store.write_report({"a": frame(1), "b": frame(2)}, path)
    frame(3).write.parquet(f"{path}/99999999999999999999-lost/a")  # a run that ended before its version was written
    assert [store.read_report(spark, path, p).first().n for p in "ab"] == [1, 2]
    store.write_report({"a": frame(4), "b": frame(5)}, path)
    assert [store.read_report(spark, path, p).first().n for p in "ab"] == [4, 5]


def test_alerts_look_at_the_window_just_before(spark):
    rows = [("k", datetime.datetime(2024, 1, 1, h, m)) for h, n in ((0, 2), (1, 6), (5, 6), (6, 7)) for m in range(n)]
    got = jobs.trend_alerts(spark.createDataFrame(rows, "key string, ts timestamp"), "ts", "key", "1 hour").collect()
    assert sorted((r.start.hour, r.n, r.previous) for r in got) == [(1, 6, 2), (5, 6, 0)]


def test_topics_in_blocks(spark):
    items = spark.createDataFrame([(1, "red apple", "pie"), (2, "x", "y")], "id long, title string, content string")
    words = [(1, 0, "Apple"), (1, 1, "pie"), (2, 0, "red"), (3, 0, "none")]
    topic = spark.createDataFrame(words, "topic_id int, pos int, keyword string")
    want = sorted(map(tuple, topics.match_topics(items, topic).collect()))
    assert want == [(1, 1, 0.975), (1, 2, 1.0)]
    assert sorted(map(tuple, topics.match_topics(items, topic, block=1).collect())) == want
    assert topics.match_topics(items, topic.limit(0)).count() == 0


def test_centroid_has_unit_length(spark):
    members = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "event_cluster_id long, content_item_id long")
    emb = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0])], "content_id long, embedding array<float>")
    c = vectors.centroids(members, emb).first().centroid
    assert abs(sum(x * x for x in c) - 1) < 1e-9
    assert vectors.centroids(members.limit(0), emb).count() == 0


def test_kept_index_follows_its_items(spark, tmp_path):
    fields = ("title", "content")
    frame = lambda rows: spark.createDataFrame(rows, "id long, title string, content string, seq int")
    rows = {i: (i, f"word{i % 3} common", f"body of {i} of common", 0) for i in range(60)} | {60: (60, None, None, 0), 61: (61, "", "...", 0), 62: (62, "long", "x y " * 5000, 0)}
    index = search.SearchIndex(spark, f"{tmp_path}/index", fields)

    def same():
        plain = lambda df: sorted((r.term, r.field, r.id, r.tf, tuple(r.positions)) for r in df.collect())
        assert plain(index.postings()) == plain(search.build_index(frame([*rows.values()]), fields))
        assert {r.id for r in index.entries().collect()} == set(rows)

    assert index.postings().count() == 0
    index.upsert(frame([*rows.values(), (None, "no id", "at all", 0)]))
    same()
    first = index.segments()
    index.upsert(frame([*rows.values()]))  # nothing changed: no commit
    index.delete(frame([(999, "", "", 0)]))
    assert index.segments() == first

    rows |= {5: (5, "word2 new", None, 1), 100: (100, "word1 late", "common", 1)}
    index.upsert(frame([*rows.values()]))
    same()
    assert [s["items"] for s in index.segments()] == [63, 2]  # the other items' postings stay where they are
    added = spark.read.parquet(f"{tmp_path}/index/postings/{index.segments()[-1]['segment']}")
    assert {r.id for r in added.select("id").distinct().collect()} == {5, 100}

    del rows[7], rows[100]
    index.delete(frame([(7, "", "", 0), (100, "", "", 0)]))
    same()
    rows[7] = (7, "word1 back", "again", 2)  # a deleted item comes back
    index.upsert(frame([*rows.values()]))
    same()
    search.build_index(frame([(1, "lost", "run", 0)]), fields).selectExpr("*", "99L as seq").write.parquet(f"{tmp_path}/index/postings/lost")
    same()
    found = search.search(index.postings(), frame([*rows.values()]).withColumn("importance_score", F.lit(1)).withColumn("published_at", F.lit(0)), 'title:word1 NOT "body of"', limit=None)
    assert [r.id for r in found.collect()] == [7]

    rows = {i: (i, f"new {i}", None, 3) for i in range(50, 90)}  # refresh takes others out, and merges what became large
    index.refresh(frame([*rows.values()]), "a")
    same()
    assert len(index.segments()) == 1
    index.refresh(frame([]), "a")  # the same mark: nothing is read
    same()
    index.vacuum()
    same()
    assert len(list((tmp_path / "index" / "postings").iterdir())) == 1
    rows = {}
    index.refresh(frame([]), "b")
    same()


def test_search_asks_the_kept_index_for_terms_only(spark, tmp_path):
    items = spark.createDataFrame([(1, "a b"), (2, "b c")], "id long, title string")
    index = search.SearchIndex(spark, f"{tmp_path}/index", ("title",))
    index.upsert(items)
    index.delete(items.filter("id = 2").select("id"))
    plan = index.postings().filter(F.col("term") == "b").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,b)" in plan


def test_postings_are_made_without_a_shuffle(spark):
    items = spark.createDataFrame([(2, "b a b", None), (1, "a \u00c4b a", "B"), (3, None, "...")], "id long, title string, content string")
    index = search.build_index(items.coalesce(1), ("title", "content"))
    want = [("a", "title", 1, 2, [0, 2]), ("a", "title", 2, 1, [1]), ("b", "content", 1, 1, [0]), ("b", "title", 2, 2, [0, 2]), ("\u00e4b", "title", 1, 1, [1])]
    assert [tuple(r) for r in index.collect()] == want
    assert sorted(map(tuple, search.build_index(items, ("title", "content"), most=1).collect())) == sorted(want)
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()


def test_search_finds_phrases(spark):
    rows = [(1, "Big red apple", "a b a b c"), (2, "red big apple", "b a, c"), (3, "apple", "red; APPLE red"), (4, "Red", "apple pie")]
    items = spark.createDataFrame(rows, "id long, title string, content string").withColumns({"importance_score": F.lit(5), "published_at": F.lit(None).cast("timestamp_ntz")})
    index = search.build_index(items, ("title", "content"))
    find = lambda q: [r.id for r in search.search(index, items, q).collect()]
    assert find('"red apple"') == [1, 3]
    assert find('title:"red apple"') == [1]
    assert find('"a b c"') == [1]
    assert find('"a b a"') == [1]
    assert find('apple NOT "red apple"') == [2, 4]
    assert find('"apple pie" OR "big red" apple') == [1, 4]
    assert find('pie OR "red big"') == [2, 4]
    assert find("apple") == [1, 2, 3, 4]


def test_merge_keeps_most_confident(spark):
    df = spark.createDataFrame([("A", 1, 0.7), ("a", 2, 0.9), ("a", 3, 0.5)], "name string, frequency int, confidence double")
    assert [r.confidence for r in topics.merge_suggestions(df).collect()] == [0.9]


def test_append_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a")], "id long, k string")
    new = spark.createDataFrame([(2, "a"), (3, "b"), (4, "b")], "id long, k string")
    once = store.append_new(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (3, "b")]
    assert sorted(map(tuple, store.append_new(once, new, ["k"]).collect())) == [(1, "a"), (3, "b")]


def test_replies(spark):
    rows = [("1", '```json\n{"summary": "s", "category": "AI/x", "importance_score": 12}\n```'), ("2", 'broken "summary": "t", "importance_score": 3'), ("3", "nothing")]
    good, bad = feeds.parse_results(spark.createDataFrame(rows, "id string, reply string"))
    assert sorted((r.id, r.summary, r.category, r.importance_score) for r in good.collect()) == [("1", "s", "AI", 10), ("2", "t", "其他", 3)]
    assert [r.id for r in bad.collect()] == ["3"]


def test_feed_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss><channel><item><title>A &amp;amp; B</title><link>http://l</link><comments>http://c</comments><pubDate>Fri, 24 Jan 2025 18:30:00 +0000</pubDate><guid>g</guid></item></channel></rss>")
    row = feeds.read_feed_xml(spark, str(tmp_path), "hackernews").first()
    assert (row.title, row.url, row.external_id) == ("A & B", "http://c", "g")
    assert row.published_at == datetime.datetime(2025, 1, 24, 18, 30)


def test_streams_equal_batch(spark, tmp_path):
    rows = [(i, i % 4, datetime.datetime(2024, 1, 1, i % 24, 0, 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, kind int, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = jobs.dedup_stream(stream, ["kind"], "ts", "2 days").writeStream.format("memory").queryName("dedup").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("dedup").count() == 4
    q = jobs.windowed_counts(stream, "ts", "kind", "6 hours").writeStream.format("memory").queryName("wins").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("wins").collect())) == sorted(map(tuple, jobs.windowed_counts(df, "ts", "kind", "6 hours").collect()))
    target, cursors = str(tmp_path / "t"), str(tmp_path / "c")
    q = stream.writeStream.foreachBatch(jobs.ingest_batch(target, cursors, "kind", "id")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(target).count() == 60


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_items_hold_whole_texts(spark):
    t = Tables(spark, DATA)
    longer = t.documents.filter("length(text) > 5000").join(t.items, F.col("doc_id") == F.col("id"))
    assert longer.count() > 0
    assert longer.filter("content <> text").count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["s05_upsert_all", "p17_key_points_titles", "p13_entities"])
def test_whole_items_same_as_sql(spark, name):
    test_same_as_sql(spark, name)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_upsert_reads_all_items(spark):
    t = Tables(spark, DATA)
    assert queries()["s05_upsert_all"](spark, DATA).count() == t.items.select("external_id").distinct().count()


def test_similar_titles_equal_all_pairs_and_stay_linear(spark):
    import itertools
    import random

    from tidemark.operators.dedup import similar_titles

    rng = random.Random(4)
    stems = ["".join(rng.choice("ab ") for _ in range(60)) for _ in range(3)] + ["one more common title for all"]
    rows = [(i, f"2024-06-{1 + i % 20:02}", rng.choice(stems)[: rng.choice([10, 20, 21, 30, 49, 50, 55, 60])] + rng.choice(["", "", "x", "tail y z"])) for i in range(300)]
    items = spark.createDataFrame([*rows, (900, "2024-06-02", None), (901, "2024-06-02", "")], "id long, d string, title string").selectExpr("id", "to_timestamp(d) as published_at", "title")
    norm = {r.id: r.t for r in items.select("id", X.normalize_title(F.col("title")).alias("t")).collect() if r.t}
    day = dict((i, d) for i, d, _ in rows)
    want = {}
    for a, b in itertools.permutations(norm, 2):
        t, u = norm[a], norm[b]
        if day[b] >= "2024-06-08" and (t == u or (len(t) > 20 and len(u) > 20 and (t.startswith(u[:50]) or u.startswith(t[:50])))):
            want[a] = max(want.get(a, ("", -1)), (day[b], b))
    found = similar_titles(items, items, "2024-06-15 00:00:00")
    assert {r.id: r.match for r in found.collect()} == {a: b for a, (_, b) in want.items()}
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
