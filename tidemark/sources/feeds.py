"""Readers: feed dumps, post JSON, and tolerant parsing of model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators.rules import ALIASES, CATEGORIES

ITEM = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "guid", "link", "comments", "title", "content", "summary", "description", "author", "creator", "published", "pubDate", "updated")])
REPLY = T.StructType().add("id", "string").add("summary", "string").add("category", "string").add("importance_score", "string").add("one_liner", "string").add("key_points", T.ArrayType(T.StringType()))


def rows_of_feed(raw: DataFrame, source_type: str, most: int = 5000) -> DataFrame:
    """Content rows of feed items with the fallbacks id, guid, link, title:date and so on."""
    c = lambda *names: F.coalesce(*(F.nullif(F.trim(F.col(n)), F.lit("")) for n in names))
    when = c("published", "pubDate", "updated")
    date = F.coalesce(F.try_to_timestamp(F.regexp_replace(when, r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(when))
    link = c("comments", "link") if source_type == "hackernews" else c("link", "comments")
    return raw.select(
        F.lit(source_type).alias("source_type"),
        F.coalesce(c("id", "guid", "link"), F.concat_ws(":", F.col("title"), when)).alias("external_id"),
        F.coalesce(X.clean_html(F.col("title")), F.lit("")).alias("title"),
        F.substring(X.clean_html(F.coalesce(c("content", "summary", "description"), F.lit(""))), 1, most).alias("content"),
        link.alias("url"), F.coalesce(c("author", "creator"), F.lit("")).alias("author"), date.alias("published_at"),
    )


def read_feed_xml(spark: SparkSession, path: str, source_type: str) -> DataFrame:
    """Every <item> of the feed dumps under path."""
    return rows_of_feed(spark.read.format("xml").option("rowTag", "item").schema(ITEM).load(path), source_type)


def rows_of_posts(raw: DataFrame) -> DataFrame:
    """Content rows of posts (id, text, url, user, created_at)."""
    text = F.coalesce("text", F.lit(""))
    line = F.split_part(text, F.lit("\n"), F.lit(1))
    title = F.when(F.length(text) > 100, F.concat(F.substring(line, 1, 97), F.lit("..."))).otherwise(F.substring(line, 1, 100))
    date = F.coalesce(F.try_to_timestamp(F.substring("created_at", 5, 100), F.lit("MMM dd HH:mm:ss Z yyyy")), F.try_to_timestamp("created_at"))
    return raw.select(F.lit("twitter").alias("source_type"), F.col("id").alias("external_id"), title.alias("title"), text.alias("content"), F.coalesce("url", F.concat(F.lit("https://x.com/i/status/"), F.col("id"))).alias("url"), F.concat(F.lit("@"), F.col("user")).alias("author"), date.alias("published_at"))


def read_post_json(spark: SparkSession, path: str) -> DataFrame:
    return rows_of_posts(spark.read.schema("id string, text string, url string, user string, created_at string").json(path))


def extract_pages(pages: DataFrame, most: int = 5000) -> DataFrame:
    """(page_id, url, text): the main text of raw pages."""
    return pages.select("page_id", "url", X.page_text(F.col("html"), most).alias("text"))


def _braces(reply: Column) -> Column:
    return F.nullif(F.regexp_extract(F.regexp_replace(reply, r"(?s)```(json)?", ""), r"(?s)(\{.*\})", 1), F.lit(""))


def parse_results(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, rejects) of model replies (id, reply): fences stripped, the outer object read, importance clamped to 1-10 (5 if
    missing), the category normalised; where the object is broken, single fields by pattern."""
    parsed = replies.withColumn("j", F.from_json(_braces(F.col("reply")), REPLY, {"mode": "PERMISSIVE"}))
    field = lambda name: F.nullif(F.regexp_extract("reply", rf'"{name}"\s*:\s*"((?:[^"\\]|\\.)*)"', 1), F.lit(""))
    number = F.coalesce(F.regexp_extract(F.coalesce("j.importance_score", F.lit("")), r"(-?\d+)", 1).try_cast("int"), F.regexp_extract("reply", r'"importance_score"\s*:\s*"?(-?\d+)', 1).try_cast("int"), F.lit(5))
    summary = F.coalesce("j.summary", field("summary"))
    category = F.coalesce("j.category", field("category"), F.lit(""))
    out = parsed.withColumns({"summary": summary, "category": X.normalize_category(category, CATEGORIES, ALIASES, "其他"), "importance_score": F.greatest(F.lit(1), F.least(F.lit(10), number)), "one_liner": F.coalesce("j.one_liner", field("one_liner"))})
    good = out.filter("summary is not null").select("id", "summary", "category", "importance_score", "one_liner", F.col("j.key_points").alias("key_points"))
    return good, out.filter("summary is null").select("id", "reply")


def parse_batches(replies: DataFrame) -> DataFrame:
    """One row for each wanted item of batch replies (batch, ids, reply): objects line by line, matched by id, else by position;
    items without an object have success = false."""
    wanted = replies.select("batch", "reply", F.posexplode("ids").alias("pos", "item"))
    lines = replies.select("batch", F.posexplode(F.regexp_extract_all("reply", F.lit(r"(\{[^{}]*\})"), F.lit(1))).alias("line", "json"))
    objects = lines.withColumn("j", F.from_json("json", REPLY)).filter("j.summary is not null")
    by_id = objects.filter("j.id is not null").select(F.col("batch").alias("b1"), F.col("j.id").alias("i1"), F.col("j").alias("r1"))
    by_place = objects.filter("j.id is null").select(F.col("batch").alias("b2"), F.col("line").alias("p2"), F.col("j").alias("r2"))
    out = wanted.join(by_id, (F.col("batch") == F.col("b1")) & (F.col("item").cast("string") == F.col("i1")), "left").join(by_place, (F.col("batch") == F.col("b2")) & (F.col("pos") == F.col("p2")), "left")
    r = F.coalesce("r1", "r2")
    return out.select("batch", "item", r["summary"].alias("summary"), r["importance_score"].try_cast("int").alias("importance_score"), r.isNotNull().alias("success"))


def nest_json(items: DataFrame) -> DataFrame:
    """JSON text columns as nested ones; if any of a row's is broken, all are null."""
    points = T.ArrayType(T.StructType().add("type", "string").add("value", "string").add("impact", "string"))
    impact = T.StructType().add("short_term", "string").add("long_term", "string").add("certainty", "string")
    actions = T.ArrayType(T.StructType().add("type", "string").add("description", "string").add("priority", "string"))
    kinds = {"key_points": points, "impact_assessment": impact, "actionable_items": actions}
    read = {c: F.from_json(c, k, {"mode": "PERMISSIVE"}) for c, k in kinds.items()}
    broken = None
    for c in kinds:
        bad = F.col(c).isNotNull() & F.try_parse_json(c).isNull()
        broken = bad if broken is None else broken | bad
    return items.withColumns({c: F.when(~broken, v) for c, v in read.items()})
