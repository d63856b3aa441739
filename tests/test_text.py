"""Literal cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import classify
from tidemark.operators import rules as R


def value(spark, column, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'array<double>' if isinstance(v, list) else 'string'}" for k, v in cols.items()))
    return df.select(column).first()[0]


def test_title_hash_ignores_case_retweets_and_mentions(spark):
    titles = ["Harbour opens at dawn", "HARBOUR OPENS AT DAWN", "RT Harbour opens at dawn", "@harbour: Harbour opens at dawn"]
    df = spark.createDataFrame([(t,) for t in titles], "t string").select(X.title_hash(F.col("t")))
    assert len({r[0] for r in df.collect()}) == 1


@pytest.mark.parametrize("title", ["", "Hi"])
def test_short_titles_have_no_key(spark, title):
    assert value(spark, X.title_key(F.col("t")), t=title) is None


def test_content_hash_looks_at_500_characters(spark):
    rows = spark.createDataFrame([("t", "x" * 1000), ("t", "x" * 500)], "t string, c string").select(X.content_hash(F.col("t"), F.col("c")))
    assert len({r[0] for r in rows.collect()}) == 1


def test_entities_and_phrases(spark):
    assert value(spark, X.entities(F.col("t")), t="Nvidia chips sell to Oracle again") == ["Nvidia", "Oracle"]
    assert value(spark, X.bigrams(F.col("t")), t="river otters and harbour seals are back") == ["river otters", "harbour seals"]
    words = value(spark, X.keywords(F.col("t")), t="the old lighthouse was painted by two sailors")
    assert set(words) == {"old", "lighthouse", "painted", "two", "sailors"}


def test_vectors(spark):
    sim = X.cosine(F.col("a"), F.col("b"))
    assert [round(value(spark, sim, a=[1.0, 0.0], b=b), 6) for b in ([1.0, 0.0], [0.0, 1.0], [-1.0, 0.0])] == [1, 0, -1]
    one = spark.range(1)
    got = one.select(X.hybrid_score(F.lit(1.0), F.lit(0.0)).alias("a"), X.hybrid_score(F.lit(0.0), F.lit(1.0)).alias("b")).first()
    assert (got.a, got.b) == (1.0, 0.6)


def test_source_key_is_strict_about_hosts(spark):
    assert value(spark, X.source_key(F.col("u")), u="https://netflix.com/x") == "other"
    assert value(spark, X.source_key(F.col("u"), strict=False), u="https://netflix.com/x") == "twitter"
    assert value(spark, X.source_key(F.col("u")), u="https://www.reddit.com/r/Rust/1") == "reddit/rust"


def test_normalize_url(spark):
    assert value(spark, X.normalize_url(F.col("u")), u="https://a.b/c/?utm_source=x&q=1&ref=y#z") == "https://a.b/c?q=1"


@pytest.mark.parametrize(
    ("title", "content", "source", "reason"),
    [
        ("t", " ", "rss", "Empty content"),
        ("Ask HN: " + "w" * 60, "c" * 200, "hackernews", "Discussion/Ask post"),
        ("Weekly Thread " + "w" * 60, "c" * 200, "rss", "Periodic thread"),
        ("w" * 60, "c" * 180, "twitter", "Twitter short content"),
        ("w" * 60, "we are hiring now, we're hiring " + "c" * 200, "rss", "Job posting"),
        ("w" * 60, "same " * 60, "rss", "Repetitive/spam content"),
        ("w" * 60, "a plain text about nothing in particular " + " ".join(f"w{i}" for i in range(40)), "rss", None),
    ],
)
def test_skip_reasons(spark, title, content, source, reason):
    df = spark.createDataFrame([(1, title, content, None, source)], "id long, title string, content string, url string, source_type string")
    assert classify.skip_reason(classify.estimate_importance(df)).first().skip_reason == reason


def test_paper_and_category(spark):
    assert value(spark, classify.is_paper(F.col("u"), F.col("t")), u="https://export.arxiv.org/x", t="t") is True
    assert value(spark, classify.is_paper(F.col("u"), F.col("t")), u="https://a.b/x", t="t") is False
    assert value(spark, X.normalize_category(F.col("c"), R.CATEGORIES, R.ALIASES, "其他"), c="foo/投资") == "金融"


def test_features_need_no_python(spark):
    df = spark.createDataFrame([(1, "t", "c", None, "en")], "id long, title string, content string, url string, category string").withColumn("published_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    plan = classify.featurize(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
