"""What keeps queries in bounds on larger tables: where work is done once, in blocks, or on fewer pairs, with the same results."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import classify, events, vectors
from tidemark.operators import rules as R
from tidemark.plans import queries
from tidemark.plans.views import Tables


def _plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "10000")
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_embed_hashes_where_the_text_lies_and_adds_up_rows_of_one_id(spark):
    rows = [(1, "One two", "two, THREE one two"), (2, None, "x"), (3, "", ""), (4, "a b", "a b a b"), (4, "b", "c"), (None, "null id", None)]
    items = spark.createDataFrame(rows, "id long, title string, content string")
    got = {r["content_id"]: r["embedding"] for r in vectors.embed(items).collect()}
    want = {}
    for i, title, content in rows:
        ws = [w for w in re.split(r"[\W_]+", " ".join(x for x in (title, content) if x is not None).lower()) if w]
        for g in ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])]:
            h = hashlib.md5(g.encode()).hexdigest()
            want.setdefault(i, np.zeros(256))[int(h[:8], 16) % 256] += 1 if h[8] < "8" else -1
    assert got.keys() == want.keys()
    for i, v in want.items():
        assert np.allclose(got[i], v / max(math.sqrt((v * v).sum()), 1e-30), atol=1e-6)
    # rows of single ids aren't cut into one row a word
    assert "Generate" not in _plan(vectors.embed(items.filter("id < 4")))


@pytest.mark.parametrize("approximate", [False, True])
def test_nearest_meets_in_blocks_of_any_size(spark, monkeypatch, approximate):
    for name, size in (("ITEM_ROWS", 7), ("CANDIDATE_ROWS", 5), ("TASK_BLOCKS", 2), ("HELD_ITEMS", 3), ("HELD_CANDIDATES", 4)):
        monkeypatch.setattr(vectors, name, size)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(90, 8))
    v[40:50] = v[3]  # equal vectors
    v[60] = np.nan
    v[61] = -v[3]
    v[:30] /= np.linalg.norm(v[:30], axis=1, keepdims=True)
    items = spark.createDataFrame([(i, i % 3 != 0) for i in range(90)], "id long, processed boolean").withColumn("published_at", F.to_timestamp_ntz(F.lit("2024-01-30 00:00:00")))
    emb = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(90)], "content_id long, embedding array<double>")
    if approximate:
        found = vectors.nearest_approximate(items, emb, "2024-01-31 00:00:00", 0.6, probes=100)  # all cells find everything
    else:
        found = vectors.nearest_processed(items, emb, "2024-01-31 00:00:00", 0.6)
    got = {r["id"]: (r["match"], r["score"]) for r in found.collect()}
    want = {}
    for i in range(90):
        scores = []
        for j in range(90):
            dot = 0.0
            for a, b in zip(v[i], v[j]):
                dot += a * b
            if j % 3 and j != i and (dot + 1) / 2 >= 0.6:
                scores.append((-(dot + 1) / 2, j))
        if scores:
            s, j = min(scores)
            want[i] = (j, -s)
    assert got == want


def test_needles_leave_out_no_match_and_patterns_are_tried_once(spark):
    texts = [
        "OpenAI announces x", "meta  RELEASE", "$5B", "Major update", "significant advancement", "series d", "an IPO", "Acquired", "gpt5", "Claude 3", "gemini 2", "chatgpt", "an LLM.", "ml", "深度学习",
        "we're hiring", "were hiring x", "job opening", "career opportunity", "join our team", "招聘", "岗位空缺", "apply now", "submit your resume", "send me your cv", "click here", "subscribe now", "limited time", "act now",
        "don't miss", "dont miss", "免费领取", "扫码关注", "🔥🔥", "💰🎁", "giveaway", "airdrop", "free tokens", "cross-posted", "xpost", "x-post", "originally posted", "i am a bot", "this is an automated", "auto-generated", "[bot]",
        "[automated]", "this action was performed automatically", "上线", "launch", "nothing of these", "", "RÉSUMÉ ı K",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("low", F.lower("t"))
    for pattern in R.NEEDLES:
        text = F.col("t") if pattern.startswith("(?i)") else F.col("low")
        rows = df.select(classify.has(text, F.col("low"), pattern).alias("a"), text.rlike(pattern).alias("b")).collect()
        assert [r["a"] for r in rows] == [r["b"] for r in rows], pattern
        assert any(r["b"] for r in rows), pattern
    columns = "id long, title string, content string, url string, source_type string"
    items = spark.createDataFrame([(k, "A title that is longer than fifty characters, so that it is", t, "http://a.example.com/", "rss") for k, t in enumerate(texts)], columns)
    judged = classify.skip_reason(classify.estimate_importance(items))
    assert judged.columns == [*items.columns, "domain_rule", "domain_category", "domain_importance", "est_score", "est_confidence", "est_reason", "skip_reason"]
    for df in (judged, classify.skip_results(judged)):
        assert _plan(df).count("(announces?|launches?|releases?)") == 1


def test_types_of_discussions_are_all_met(spark):
    kinds = {r["kind"] for r in queries.SPARK["p11_hn_type"](Tables(spark, "/root/testdata/sf0.001")).collect()}
    assert kinds == {None, "ask", "show", "tell", "launch"}


def test_pairs_by_word_and_name_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    words, names = [f"w{'x' * (k % 4)}{k}" for k in range(14)], ["Google", "Meta", "Apple", "Tesla", "Intel"]
    rows = []
    for i in range(160):
        title = " ".join(rng.choice(words, rng.integers(0, 15)).tolist() + (["GPT-4"] if i % 11 == 0 else []))
        rows.append((i, "Ask HN: " + title if i % 13 == 0 else title, " ".join(rng.choice(names, rng.integers(0, 4)).tolist()), "en" if i % 5 else "de", int(i % 9)))
    items = spark.createDataFrame(rows, "id long, title string, content string, category string, day int").withColumn("published_at", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, day)"))
    f = events.features(items, "title", F.col("content")).cache()
    pairs = f.drop("keys").select(*(F.col(c).alias("a_" + c) for c in f.columns if c != "keys")).crossJoin(f.select(*(F.col(c).alias("b_" + c) for c in f.columns if c != "keys")))
    pairs = pairs.filter("a_id <> b_id and (a_hn is null or b_hn is null or a_hn = b_hn)").select("a_id", "b_id", events.event_score("a_", "b_")["score"].alias("s"))
    for least in (0.52, 0.55, 0.7):
        want = {tuple(r) for r in pairs.filter(F.col("s") >= least).collect()}
        found = events.accepting(f.drop("keys"), f.drop("keys"), least)
        got = [tuple(r) for r in found.collect()]
        assert set(got) == want and len(got) == len(want) > 20


def test_event_pairs_meet_once_in_blocks(spark, monkeypatch):
    """Every pair in one task by blocks, whatever the blocks; no join brings pairs together."""
    rng = np.random.default_rng(12)
    word = lambda n: " ".join(f"{rng.choice(['red', 'blue', 'new', 'old', 'big'])}{rng.integers(0, 4)}" for _ in range(n))
    rows = [(i, str(rng.choice(["Ask HN: ", "", "", "GPT-4 "])) + word(rng.integers(0, 6)), word(8), [None, "a", "b"][i % 3], i % 11) for i in range(150)]
    items = spark.createDataFrame(rows, "id long, title string, content string, category string, importance_score int").withColumn("published_at", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 9 as int))"))
    order = F.struct(-F.col("importance_score"), -F.unix_micros(F.col("published_at").cast("timestamp")), "id")
    f = events.settled(events.features(items, "title", F.col("content"), [r"(red\d|blue\d)"]).join(items.select("id", order.alias("o")), "id"), "f")
    side = lambda p: f.drop("keys").select(*(F.col(c).alias(p + c) for c in f.columns if c != "keys"))
    pairs = side("a_").crossJoin(side("b_")).filter("b_o < a_o and (a_hn is null or b_hn is null or a_hn = b_hn)").select("a_id", "b_id", events.event_score("a_", "b_")["score"].alias("s"))
    want = {tuple(r) for r in pairs.filter("s >= 0.55").collect()}
    for block in (40, 1000):
        monkeypatch.setattr(events, "BLOCK", block)
        found = events.accepting(f.drop("keys"), f.drop("keys"), 0.55, earlier_only=True)
        assert "Join" not in _plan(found)
        got = [tuple(r) for r in found.collect()]
        assert set(got) == want and len(got) == len(want) > 50
    none = f.drop("keys").filter("id < 0")
    assert events.accepting(none, f.drop("keys"), 0.55, earlier_only=True).count() == 0 == events.accepting(f.drop("keys"), none, 0.55, earlier_only=True).count()
