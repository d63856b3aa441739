"""Topic discovery, matching and trends."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .items import ago, ts

#: Characters of one block of keywords (with 50 for each keyword), which bounds the automaton that a task holds.
BLOCK_CHARACTERS = 8_000_000


def _frequency(items: DataFrame, terms: Column, least: int, low: float, high: float, share: float, source: str, limit: int | None) -> DataFrame:
    """(name, frequency, confidence, samples): terms of `least` mentions or more; samples are the first three titles."""
    rows = items.select("id", "published_at", "title", F.explode(terms).alias("name"))
    firsts = F.transform(F.slice(F.array_sort(F.collect_set(F.struct("published_at", "id", "title"))), 1, 3), lambda s: s["title"])
    # only the three first titles of a term are kept while it is gathered
    order = Window.partitionBy("name").orderBy("published_at", "id")
    counts = rows.groupBy("name").agg(F.count(F.lit(1)).alias("frequency")).filter(F.col("frequency") >= least)
    few = rows.join(counts.select("name"), "name", "left_semi").dropDuplicates(["name", "id"]).withColumn("_n", F.row_number().over(order)).filter("_n <= 3")
    samples = few.groupBy("name").agg(firsts.alias("samples"))
    total = items.agg(F.count(F.lit(1)).alias("total")).withColumn("k", F.lit(1))
    out = counts.join(samples, "name").withColumn("k", F.lit(1)).join(F.broadcast(total), "k")
    sure = F.greatest(F.lit(low), F.least(F.lit(high), F.try_divide(F.col("frequency"), F.col("total") * share)))
    out = out.select("name", "frequency", sure.alias("confidence"), F.lit(source).alias("source"), "samples").orderBy(F.desc("frequency"), "name")
    return out.limit(limit) if limit else out


def discover_by_entities(items: DataFrame, min_frequency: int = 5, patterns: list[str] = X.ENTITIES, limit: int | None = 50) -> DataFrame:
    return _frequency(items, X.entities(F.concat_ws(" ", "title", "content"), patterns), min_frequency, 0.3, 1.0, 0.1, "entity", limit)


def discover_by_keywords(items: DataFrame, min_frequency: int = 5, limit: int | None = 50) -> DataFrame:
    return _frequency(items, X.bigrams(F.col("title")), min_frequency, 0.2, 0.8, 0.15, "keyword", limit)


def discover_by_trends(items: DataFrame, as_of: str, patterns: list[str] = X.ENTITIES, days: int = 7, ratio: float = 3.0, least: int = 3) -> DataFrame:
    """Entities whose mentions of the last days are `ratio` times those of the days before."""
    rows = items.filter((F.col("published_at") >= ago(as_of, 2 * days)) & (F.col("published_at") < ts(as_of))).select("published_at", F.explode(X.entities(F.concat_ws(" ", "title", "content"), patterns)).alias("name"))
    now = F.col("published_at") >= ago(as_of, days)
    c = rows.groupBy("name").agg(F.sum(F.when(now, 1).otherwise(0)).alias("current"), F.sum(F.when(now, 0).otherwise(1)).alias("previous"))
    hit = c.filter((F.col("current") >= least) & (F.col("current") >= F.greatest(F.col("previous"), F.lit(1)) * ratio))
    return hit.select("name", F.col("current").alias("frequency"), "previous", F.least(F.lit(0.9), 0.5 + F.col("current") / 20).alias("confidence"), F.lit("trend").alias("source"))


def merge_suggestions(*frames: DataFrame) -> DataFrame:
    """The most confident suggestion of each lower-cased name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    order = Window.partitionBy(F.lower("name")).orderBy(F.desc("confidence"), F.desc("frequency"), "name")
    return out.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def discover_topics(suggestions: DataFrame, topics: DataFrame, limit: int = 20) -> DataFrame:
    """Suggestions that belong to no topic yet (by its name or keywords), best first."""
    known = topics.select(F.lower("name").alias("_k")).unionByName(topics.select(F.lower("keyword").alias("_k"))).distinct()
    new = suggestions.join(known, F.lower("name") == known["_k"], "left_anti")
    return new.orderBy(F.desc(F.col("confidence") * F.col("frequency")), "name").limit(limit)


def merge_keywords(topics: DataFrame, words: DataFrame) -> DataFrame:
    """topics (topic_id, name, pos, keyword) with the new ones of words (topic_id, keyword) behind."""
    new = words.select("topic_id", "keyword").distinct().join(topics.select("topic_id", "keyword"), ["topic_id", "keyword"], "left_anti")
    heads = topics.groupBy("topic_id").agg(F.first("name").alias("name"), F.max("pos").alias("last"))
    order = Window.partitionBy("topic_id").orderBy("keyword")
    added = new.join(heads, "topic_id").select("topic_id", "name", (F.col("last") + F.row_number().over(order)).alias("pos"), "keyword")
    return topics.select("topic_id", "name", "pos", "keyword").unionByName(added)


def accept_suggestions(suggestions: DataFrame, ids: DataFrame, status: str = "accepted") -> tuple[DataFrame, DataFrame]:
    """(suggestions with the new status, topic rows of those accepted)."""
    hit = suggestions.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    out = hit.withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status"))).drop("_hit")
    return out, hit.filter("_hit").select("id", "name")


def _keyword_blocks(topics: DataFrame, most: int) -> Iterator[list[tuple[int, int, int, str]]]:
    """Rows (topic_id, pos, keywords of the topic, keyword) in blocks of whole topics and about `most` characters, one block at a time on the driver."""
    size = topics.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"))
    rows = topics.select("topic_id", "pos", F.lower("keyword").alias("keyword")).join(size, "topic_id").orderBy("topic_id", "pos", "keyword")
    block, held, last = [], 0, None
    for r in rows.toLocalIterator():
        if block and held >= most and r["topic_id"] != last:
            yield block
            block, held = [], 0
        last = r["topic_id"]
        block.append((last, r["pos"], r["n"], r["keyword"] or ""))
        held += len(block[-1][3]) + 50
    if block:
        yield block


def _automaton(block: list[tuple[int, int, int, str]]) -> tuple[object, list[int]]:
    """The block's keywords as an Aho-Corasick automaton that gives the numbers of their rows; and those of empty keywords, which stand in every text."""
    import ahocorasick

    rows: dict[str, list[int]] = {}
    for i, (*_, keyword) in enumerate(block):
        rows.setdefault(keyword, []).append(i)
    always, found = rows.pop("", []), ahocorasick.Automaton()
    for keyword, numbers in rows.items():
        found.add_word(keyword, numbers)
    found.make_automaton()
    return found, always


def match_topics(items: DataFrame, topics: DataFrame, threshold: float = 0.3, block: int = BLOCK_CHARACTERS) -> DataFrame:
    """(content_id, topic_id, relevance): keywords inside title and content; early keywords weigh more; three hits or more add a
    fifth. A text is gone through once for all keywords of a block, about a hundred thousand of them, by an automaton that tasks
    build from the broadcast block; only more keywords than a block holds take another scan. A row leaves only the topics that it matches."""
    kind, id_kind = dict(topics.dtypes)["topic_id"], dict(items.dtypes)["id"]
    rows = items.select(F.col("id").alias("content_id"), F.lower(F.concat_ws(" ", "title", "content")).alias("text"))
    out = None
    for part in _keyword_blocks(topics, block):
        sent = items.sparkSession.sparkContext.broadcast(part)

        def run(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            known = sent.value
            automaton, always = _automaton(known)
            for frame in frames:
                ids, names, hits, sizes, sums = [], [], [], [], []
                for content, text in zip(frame["content_id"], frame["text"], strict=True):
                    met = set(always)
                    if len(automaton):
                        for _, numbers in automaton.iter(text):
                            met.update(numbers)
                    by: dict[int, list[int]] = {}
                    for i in sorted(met):
                        by.setdefault(known[i][0], []).append(i)
                    for topic, mine in by.items():
                        total = 0.0
                        for i in mine:  # in the order of the keywords
                            total += max(0.3, 1 - known[i][1] * 0.05)
                        ids.append(content)
                        names.append(topic)
                        hits.append(len(mine))
                        sizes.append(known[mine[0]][2])
                        sums.append(total)
                yield pd.DataFrame({"content_id": ids, "topic_id": names, "hits": hits, "n": sizes, "sum": sums})

        found = rows.mapInPandas(run, f"content_id {id_kind}, topic_id {kind}, hits long, n long, sum double")
        score = F.least(F.lit(1.0), F.col("sum") / F.col("n"))
        score = F.when(F.col("hits") >= 3, F.least(F.lit(1.0), score * 1.2)).otherwise(score)
        found = found.select("content_id", "topic_id", F.round(score, 3).alias("relevance")).filter(F.col("relevance") > threshold)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return items.limit(0).select(F.col("id").alias("content_id"), F.lit(None).cast(kind).alias("topic_id"), F.lit(0.0).alias("relevance"))
    return out


def topic_trend(items: DataFrame, content_topics: DataFrame, as_of: str, days: int = 7, least: float = 0.4) -> DataFrame:
    """(topic_id, current, previous, change, trend): more than a fifth up or down, else stable; from nothing is 100 per cent up."""
    rows = content_topics.filter(F.col("relevance") >= least).join(items.select(F.col("id").alias("content_id"), "published_at"), "content_id")
    rows = rows.filter((F.col("published_at") >= ago(as_of, 2 * days)) & (F.col("published_at") < ts(as_of)))
    now = F.col("published_at") >= ago(as_of, days)
    c = rows.groupBy("topic_id").agg(F.sum(F.when(now, 1).otherwise(0)).alias("current"), F.sum(F.when(now, 0).otherwise(1)).alias("previous"))
    change = F.when((F.col("previous") == 0) & (F.col("current") > 0), 100.0).when(F.col("previous") == 0, 0.0).otherwise((F.col("current") - F.col("previous")) * 100.0 / F.col("previous"))
    return c.withColumn("change", F.round(change, 2)).withColumn("trend", F.when(F.col("change") > 20, "up").when(F.col("change") < -20, "down").otherwise("stable"))


def topic_snapshots(items: DataFrame, content_topics: DataFrame, as_of: str, days: int = 7, least: float = 0.4) -> DataFrame:
    rows = content_topics.filter(F.col("relevance") >= least).join(items.withColumnRenamed("id", "content_id"), "content_id").filter((F.col("published_at") >= ago(as_of, days)) & (F.col("published_at") < ts(as_of)))
    facts = rows.groupBy("topic_id").agg(F.count(F.lit(1)).alias("article_count"), F.round(F.avg(F.coalesce("importance_score", F.lit(5))), 4).alias("avg_importance"), F.sum(F.when(F.col("importance_score") >= 7, 1).otherwise(0)).alias("high_importance"))
    return facts.join(topic_trend(items, content_topics, as_of, days, least).select("topic_id", "trend"), "topic_id", "left")


def trending_words(items: DataFrame, stopwords: tuple[str, ...] = ("的", "是", "在", "了", "和", "与", "有", "这", "一个", "可以", "the", "and", "for", "with"), pool: int = 20, least: int = 3, limit: int = 10) -> DataFrame:
    words = F.regexp_extract_all(F.concat_ws(" ", F.col("title"), F.coalesce("summary", F.lit(""))), F.lit(r"([\x{4e00}-\x{9fff}]{2,}|[a-zA-Z]{3,})"), F.lit(1))
    common = items.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(pool)
    return common.filter((F.col("n") >= least) & ~F.lower("word").isin(*stopwords)).orderBy(F.desc("n"), "word").limit(limit)


def new_entities(items: DataFrame, start: str, end: str, patterns: list[str] = X.ENTITIES) -> DataFrame:
    """Entities of the period that no earlier item names."""
    names = items.select("published_at", F.explode(X.entities(F.concat_ws(" ", "title", "content"), patterns)).alias("name")).withColumn("name", F.lower("name"))
    now = names.filter((F.col("published_at") >= ts(start)) & (F.col("published_at") <= ts(end))).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return now.join(names.filter(F.col("published_at") < ts(start)).select("name").distinct(), "name", "left_anti")
