"""Event clustering: candidates, scores, acceptance and the greedy leader clustering of a batch."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import pairs
from .items import ago
from .store import settled

#: The least score of a candidate by the method that found it.
THRESHOLDS = {"model": 0.35, "entity": 0.35, "keyword": 0.50}
OTHER_THRESHOLD = 0.40
#: Without a shared model and with one shared name at most, a score of 0.5 (or 0.4 for titles alike by 0.8) needs 0.61 or more.
LEAST_JACCARD = 0.6
#: What a score can have at most without models, a like title or shared words of titles: names, category and date.
MOST_WITHOUT_TITLE = 0.4 + 0.05 + 0.05
#: Items of a block whose pairs with another block one task scores.
BLOCK = 8192
#: Items of a slice that one task of the greedy clustering goes through.
SLICE_ITEMS = 200_000


def features(df: DataFrame, title: str, body: Column | None = None, patterns: list[str] = X.ENTITIES, at: str = "published_at") -> DataFrame:
    """(id, at, category, title, norm, hn, models, words, norm_words, names, keys).

    keys are what a pair over the thresholds must share: a model; two names; the normalised title; or, as nothing else adds up to
    a threshold without it, a Jaccard similarity of LEAST_JACCARD of the title's words. For that the words stand in one
    order for all items, longest first, since long words are rare, and a pair that is so similar shares one of the first few of
    them, so common short words are no keys."""
    t = F.coalesce(F.col(title), F.lit(""))
    text = t if body is None else F.concat_ws(" ", t, body)
    out = df.select("id", F.col(at).alias("at"), "category", t.alias("title"), text.alias("text"))
    lower_names = F.array_distinct(F.transform(X.entities(F.col("text"), patterns), F.lower))
    out = out.select("*", X.normalize_title(F.col("title")).alias("norm"), X.hn_type(F.col("title")).alias("hn"), X.model_names(F.col("title")).alias("models"), X.keywords(F.col("title")).alias("words"), lower_names.alias("names")).drop("text")
    out = out.withColumn("norm_words", X.keywords(F.col("norm")))
    tag = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(kind), x))
    ranked = F.transform(F.array_sort(F.transform("norm_words", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])
    size = F.size("norm_words")
    prefix = F.when(size > 0, F.slice(ranked, F.lit(1), size - F.ceil(size * LEAST_JACCARD).cast("int") + 1)).otherwise(F.array().cast("array<string>"))
    ordered = F.array_sort("names")
    two = F.flatten(F.transform(ordered, lambda x, i: F.transform(F.slice(ordered, i + 2, F.greatest(F.size(ordered), F.lit(1))), lambda y: F.concat_ws("\0", x, y))))
    keys = F.array_distinct(F.concat(tag("m:", F.col("models")), tag("w:", prefix), tag("e:", two), F.array(F.concat(F.lit("t:"), F.col("norm")))))
    return out.withColumn("keys", keys)


def event_title(title: Column, most: int = 50, least: int = 30) -> Column:
    """A cluster's title from its first item's: without the prefixes of discussions, cut at the last blank among `most` characters if that is behind `least`."""
    bare = F.trim(F.regexp_replace(title, X.DISCUSSION, ""))
    head = F.substring(bare, 1, most)
    blank = F.length(head) - F.locate(" ", F.reverse(head))  # where the last blank stands, from 0
    cut = F.when((F.locate(" ", head) > 0) & (blank > least), F.substr(head, F.lit(1), blank)).otherwise(head)
    return F.when(F.length(bare) > most, F.trim(cut)).otherwise(bare)


def event_score(a: str, b: str, semantic: Column | None = None) -> dict[str, Column]:
    """score, method and what they are made of, for feature rows under two prefixes."""
    x, y = (lambda c: F.col(f"{a}{c}")), (lambda c: F.col(f"{b}{c}"))
    shared = lambda c: F.size(F.array_intersect(x(c), y(c)))
    models, words, names = shared("models"), shared("words"), shared("names")
    title = F.when((x("title") == "") | (y("title") == ""), 0.0).when(x("norm") == y("norm"), 1.0).otherwise(X.jaccard(x("norm_words"), y("norm_words")))
    model_part = F.when(models >= 2, 0.5).when(models == 1, 0.4).otherwise(0.0)
    name_part = F.least(names, F.lit(3)) * 0.25 / 3 + F.when(names >= 2, 0.15).otherwise(0.0)
    near = F.abs(F.datediff(x("at").cast("date"), y("at").cast("date"))) <= 1
    rule = model_part + title * 0.35 + name_part + F.least(words, F.lit(5)) * 0.1 / 5 + F.when(x("category") == y("category"), 0.05).otherwise(0.0) + F.when(near, 0.05).otherwise(0.0)
    score = rule if semantic is None else X.hybrid_score(rule, semantic)
    method = F.when(name_part > 0.2, "entity").when(title >= 0.8, "title").when(models >= 1, "model").otherwise("keyword")
    if semantic is not None:
        method = F.when(semantic > 0.7, "semantic").when((semantic > 0.5) & (rule > 0.1), "hybrid").otherwise(method)
    return {"score": F.round(score, 6), "method": method}


def candidates(left: DataFrame, right: DataFrame, earlier_only: bool = False) -> DataFrame:
    """Scored pairs (id, other, score, method) over their thresholds. Pairs come from shared keys; a pair is scored once."""
    a, b = left.select(F.col("id").alias("a_id"), F.explode("keys").alias("k")), right.select(F.col("id").alias("b_id"), F.explode("keys").alias("k"))
    pairs = a.join(b, "k").select("a_id", "b_id").distinct()
    name = lambda df, p: df.drop("keys").select(*(F.col(c).alias(p + c) for c in df.columns if c != "keys"))
    rows = pairs.join(name(left, "a_"), "a_id").join(name(right, "b_"), "b_id")
    rows = rows.filter(F.col("a_hn").isNull() | F.col("b_hn").isNull() | (F.col("a_hn") == F.col("b_hn")))
    s = event_score("a_", "b_")
    out = rows.select(F.col("a_id").alias("id"), F.col("b_id").alias("other"), s["score"].alias("score"), s["method"].alias("method"))
    return out.filter(F.col("score") >= F.coalesce(X.lookup(F.col("method"), THRESHOLDS), F.lit(OTHER_THRESHOLD)))


def accepting(left: DataFrame, right: DataFrame, least: float, earlier_only: bool = False) -> DataFrame:
    """(id, other, score) of the pairs of features that score `least` or more, which is over all thresholds; with earlier_only, of those whose
    other one has the smaller `o`.

    Titles and names are drawn from few words, so most pairs share some, and keys bring a pair together many times over. So every pair meets
    once: both sides are dealt into blocks of about BLOCK items, and a task looks at two blocks, first at bounds from hashed bits for
    every pair, then at the sets of the few that are left. The pairs grow as the square of the items, at some nanoseconds each;
    a task holds its two blocks and a bounded number of pairs."""
    count = {id(x): max(1, math.ceil(x.count() / BLOCK)) for x in (left, right)}
    rows, columns = count[id(left)], count[id(right)]

    def dealt(df: DataFrame, own: int, other: int, mine: bool) -> DataFrame:
        day = F.coalesce(F.datediff(F.col("at").cast("date"), F.lit("1970-01-01").cast("date")).cast("long"), F.lit(1 << 28 if mine else -(1 << 28)))
        order = [F.coalesce(F.col(f"o.{k}").cast("long"), F.lit(-(1 << 63))) if earlier_only else F.lit(0).cast("long") for k in ("col1", "col2")]
        out = df.select(F.col("id").cast("long").alias("id"), (F.col("title") != "").alias("title"), day.alias("day"), order[0].alias("o1"), order[1].alias("o2"), *(F.col(c).alias(c) for c in ("norm", "category", "hn", *pairs.SETS)))
        block = F.pmod(F.xxhash64("id"), F.lit(own)).cast("int")
        at = lambda k: (block * other + k) if mine else (k * own + block)
        return out.withColumn("g", F.explode(F.transform(F.sequence(F.lit(0), F.lit(other - 1)), at)))

    def met(a: pa.Table, b: pa.Table) -> pa.Table:
        return pairs.scored(a, b, least, earlier_only)

    a, b = dealt(left, rows, columns, True), dealt(right, columns, rows, False)
    found = a.groupBy("g").cogroup(b.groupBy("g")).applyInArrow(met, "id long, other long, rule double")
    return found.select("id", "other", F.round("rule", 6).alias("score")).filter(F.col("score") >= least).distinct()


def _serves(least: float) -> bool:
    """Whether `accepting` finds all pairs of that score."""
    return least - 1e-6 > MOST_WITHOUT_TITLE and least >= max(*THRESHOLDS.values(), OTHER_THRESHOLD)


def cluster_candidates(items: DataFrame, clusters: DataFrame, as_of: str, days: float = 3, k: int = 5, patterns: list[str] = X.ENTITIES) -> DataFrame:
    """(id, cluster, score, method, rank): the best k recent clusters of each item."""
    left = settled(features(items, "title", F.col("content"), patterns), "item-features")
    right = features(clusters.filter(F.col("last_updated_at") >= ago(as_of, days)), "event_title", None, patterns, "last_updated_at")
    order = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    return candidates(left, right).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumnRenamed("other", "cluster")


def accept_candidates(ranked: DataFrame, labels: DataFrame | None = None, sure: float = 0.75, least: float = 0.55) -> DataFrame:
    """The best candidate of each item with accepted: sure scores by themselves, others by a label (id, label) or by `least`."""
    best = ranked.filter("rank = 1")
    if labels is None:
        return best.withColumn("accepted", F.col("score") >= least)
    return best.join(labels.select("id", "label"), "id", "left").withColumn("accepted", F.when(F.col("score") >= sure, True).otherwise(F.coalesce("label", F.col("score") >= least))).drop("label")


def _greedy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Roles of items that come in order, each with a row for every earlier item that accepts it: leads where that one leads already."""
    leaders: set[int] = set()
    current, led, can = None, False, False

    def role() -> str:
        if not led and can:
            leaders.add(current)
        return "member" if led else "leader" if can else "single"

    for frame in frames:
        ids, roles = [], []
        for id_, may, other, leads in zip(frame["id"], frame["can"], frame["other"], frame["leads"], strict=True):
            if id_ != current:
                if current is not None:
                    ids.append(current)
                    roles.append(role())
                current, led, can = id_, False, may
            led = led or bool(leads) or other in leaders
        yield pd.DataFrame({"id": pd.Series(ids, dtype="int64"), "s": pd.Series(roles, dtype="object")})
    if current is not None:
        yield pd.DataFrame({"id": [current], "s": [role()]})


def _roles(place: DataFrame, e: DataFrame, slice_items: int) -> DataFrame:
    """(id, s) of all items of place (id, o, can), given who accepts whom (e: id, other; other is earlier and may lead).

    Rounds settle the items whose earlier neighbours are settled, all at once, for as long as a round settles half of what is
    open. What is left then, such as long chains, is cut by order into slices of about slice_items items. A slice depends only on
    itself and on earlier ones, so one task goes through it in order, holding its leaders only, while its pairs stream by."""
    state, left = place.select("id", "o", "can", F.lit(None).cast("string").alias("s")), place.count()
    while left:
        t = state.select(F.col("id").alias("other"), F.col("s").alias("t"))
        seen = e.join(t, "other").groupBy("id").agg(F.max(F.when(F.col("t") == "leader", 1).otherwise(0)).alias("led"), F.max(F.when(F.col("t").isNull(), 1).otherwise(0)).alias("open"))
        new = F.when(F.col("s").isNotNull(), F.col("s")).when(F.col("led") == 1, "member").when(F.coalesce("open", F.lit(0)) == 0, F.when(F.col("can"), "leader").otherwise("single"))
        state = settled(state.join(seen, "id", "left").select("id", "o", "can", new.alias("s")), "roles")
        now = state.filter("s is null").count()
        if now > left // 2:
            left = now
            break
        left = now
    roles = state.filter("s is not null").select("id", "s")
    if not left:
        return roles
    laid = settled(state.filter("s is null").select("id", "o", "can").repartitionByRange(math.ceil(left / slice_items), "o").withColumn("slice", F.spark_partition_id()), "slices")
    for k in range(laid.agg(F.max("slice")).first()[0] + 1):
        asked = laid.filter(F.col("slice") == k).join(e.select("id", "other"), "id", "left")
        met = asked.join(roles.select(F.col("id").alias("other"), F.col("s").alias("t")), "other", "left")
        leads = F.coalesce(F.col("t") == "leader", F.lit(False))
        # pairs with settled items that don't lead have no effect; their rows stay for the item
        rows = met.select("o", "id", "can", F.when(F.col("t").isNull() | leads, F.coalesce("other", F.lit(None).cast("long"))).alias("other"), leads.alias("leads"))
        solved = rows.repartition(1).sortWithinPartitions("o").select("id", "can", "other", "leads").mapInPandas(_greedy, "id long, s string")
        roles = roles.unionByName(settled(solved, "solved"))
    return roles


def cluster_events(items: DataFrame, patterns: list[str] = X.ENTITIES, least: float = 0.55, leader_importance: int = 6, slice_items: int = SLICE_ITEMS) -> DataFrame:
    """(id, leader, score, role): items in order (importance, date) join their best accepting earlier leader or, if important enough,
    lead. A leader is an item that no earlier leader accepts."""
    pool = items.withColumn("_o", F.struct(-F.coalesce("importance_score", F.lit(0)), -F.unix_micros(F.col("published_at").cast("timestamp")), "id"))
    f = settled(features(pool, "title", F.col("content"), patterns).drop(*(["keys"] if _serves(least) else [])), "item-features")
    place = settled(pool.select("id", F.col("_o").alias("o"), (F.coalesce("importance_score", F.lit(0)) >= leader_importance).alias("can")), "places")
    if _serves(least):
        placed = settled(f.join(place, "id"), "placed-features")
        e = accepting(placed, placed.filter("can"), least, earlier_only=True)
    else:
        e = candidates(f, f).filter((F.col("id") != F.col("other")) & (F.col("score") >= least))
        e = e.join(place.select("id", "o"), "id").join(place.select(F.col("id").alias("other"), F.col("o").alias("p"), F.col("can").alias("other_can")), "other").filter(F.col("other_can") & (F.col("p") < F.col("o")))
    e = settled(e.select("id", "other", "score"), "accepting")
    state = _roles(place, e, slice_items)
    leaders = state.filter("s = 'leader'").select(F.col("id").alias("other"))
    best = e.join(leaders, "other", "left_semi").groupBy("id").agg(F.max(F.struct("score", (-F.col("other")).alias("m"))).alias("r"))
    joined = state.join(best, "id", "left")
    member = F.col("s") == "member"
    return joined.select("id", F.when(member, -F.col("r.m")).when(F.col("s") == "leader", F.col("id")).alias("leader"), F.when(member, F.col("r.score")).alias("score"), F.col("s").alias("role"))


def cluster_new(items: DataFrame, clusters: DataFrame, as_of: str, patterns: list[str] = X.ENTITIES, days: float = 3, least: float = 0.55, leader_importance: int = 6) -> DataFrame:
    """(id, cluster, leader, score, role): items join the best recent cluster that accepts them; the others are clustered among themselves."""
    if _serves(least):
        left = settled(features(items, "title", F.col("content"), patterns).drop("keys"), "item-features")
        right = features(clusters.filter(F.col("last_updated_at") >= ago(as_of, days)), "event_title", None, patterns, "last_updated_at").drop("keys")
        best = accepting(left, settled(right, "cluster-features"), least).groupBy("id").agg(F.max(F.struct("score", (-F.col("other")).alias("m"))).alias("r"))
        best = best.select("id", (-F.col("r.m")).alias("cluster"), F.col("r.score").alias("score"))
    else:
        best = accept_candidates(cluster_candidates(items, clusters, as_of, days, 1, patterns), least=least).filter("accepted")
    joined = settled(best.select("id", "cluster", "score"), "joined")
    rest = cluster_events(items.join(joined.select("id"), "id", "left_anti"), patterns, least, leader_importance)
    none = F.lit(None).cast("long")
    return joined.select("id", F.col("cluster").cast("long").alias("cluster"), none.alias("leader"), "score", F.lit("joined").alias("role")).unionByName(
        rest.select("id", none.alias("cluster"), F.col("leader").cast("long").alias("leader"), "score", "role")
    )
