"""Rule-based filtering, classification and routing of items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import rules as R
from .stats import numbered


def head(title: Column, content: Column, size: int = 500) -> Column:
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.substring(F.coalesce(content, F.lit("")), 1, size))


def _suffixes(url: Column) -> Column:
    """The host and the domains above it, longest first."""
    parts = F.split(X.url_host(url), r"\.")
    return F.transform(F.array(parts), lambda p: F.transform(F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1))), lambda k: F.array_join(F.slice(p, k, F.size(p)), ".")))[0]


def classify_domain(items: DataFrame, domains: list[tuple] | DataFrame = R.DOMAINS) -> DataFrame:
    """items with domain_rule, domain_category, domain_importance: the longest listed domain that the host is or lies below.
    A list is looked up as a literal map in the same projection; rules in a table (the three columns) of any size meet the
    hosts by a join, which carries ids and hosts alone."""
    names = ("domain_rule", "domain_category", "domain_importance")
    if isinstance(domains, DataFrame):
        hosts = items.filter("url is not null").select("id", F.explode(_suffixes(F.col("url"))).alias("domain_rule"))
        best = hosts.join(domains.select(*names), "domain_rule").groupBy("id").agg(F.max_by(F.struct(*names), F.length("domain_rule")).alias("r"))
        return items.join(best.select("id", "r.*"), "id", "left")
    rules = {d: (d, c, int(i)) for d, c, i in reversed(domains)}
    row = lambda r: F.struct(*(F.lit(x).alias(n) for x, n in zip(r, names, strict=True)))
    table = F.create_map(*(x for d, r in rules.items() for x in (F.lit(d), row(r))))
    found = F.get(F.filter(F.transform(_suffixes(F.col("url")), lambda d: F.try_element_at(table, d)), lambda r: r.isNotNull()), F.lit(0))
    return items.withColumn("_rule", found).select(*(F.col(c) for c in items.columns), "_rule.*")


def keyword_scores(text: Column, keywords: list[tuple] = R.TITLE_KEYWORDS) -> tuple[Column, Column]:
    """(best category with a score of 2 or more, greatest boost)."""
    order = list(dict.fromkeys(c for _, c, _ in keywords))
    score = {c: reduce(lambda a, b: a + b, [F.when(text.rlike(p), 1 + boost).otherwise(0) for p, k, boost in keywords if k == c]) for c in order}
    ranked = F.array_max(F.array(*(F.struct(score[c].alias("s"), F.lit(-k).alias("k"), F.lit(c).alias("c")) for k, c in enumerate(order))))
    boost = F.greatest(*(F.when(text.rlike(p), b).otherwise(0) for p, _, b in keywords))
    return F.when(ranked["s"] >= 2, ranked["c"]), boost


def classify(items: DataFrame, domains: list[tuple] = R.DOMAINS, keywords: list[tuple] = R.TITLE_KEYWORDS) -> DataFrame:
    """items with class, class_importance, class_reason: by domain raised by keywords, else by keywords, else null."""
    best, boost = keyword_scores(head(F.col("title"), F.col("content")), keywords)
    out = classify_domain(items, domains).withColumns({"_best": best, "_boost": boost})
    by_domain = F.col("domain_category").isNotNull()
    return out.withColumns(
        {
            "class": F.coalesce("domain_category", "_best"),
            "class_importance": F.when(by_domain, F.least(F.lit(10), F.col("domain_importance") + F.col("_boost"))).when(F.col("_best").isNotNull(), 6),
            "class_reason": F.when(by_domain, F.concat(F.lit("domain:"), F.col("domain_rule"))).when(F.col("_best").isNotNull(), F.concat(F.lit("keywords:"), F.col("_best"))),
        }
    ).drop("_best", "_boost")


def has(text: Column, low: Column, pattern: str, needles: dict[str, tuple[str, ...]] = R.NEEDLES) -> Column:
    """Whether the pattern is found in text. low is text in lower case: where none of the pattern's needles is in it, the pattern isn't tried."""
    found = text.rlike(pattern)
    return reduce(lambda a, b: a | b, [low.contains(n) for n in needles[pattern]]) & found if pattern in needles else found


def estimate_importance(items: DataFrame, domains: list[tuple] = R.DOMAINS, strong: list[tuple] = R.STRONG, weak: list[tuple] = R.WEAK) -> DataFrame:
    """items with est_score, est_confidence, est_reason."""
    out = items if "domain_rule" in items.columns else classify_domain(items, domains)
    # the text and each pattern's hit are columns of their own: Spark computes once what several expressions name
    out = out.withColumn("_text", head(F.col("title"), F.col("content"))).withColumn("_head", F.lower("_text"))
    out = out.withColumns({f"_{kind}{k}": has(F.col("_text"), F.col("_head"), f"(?i){p}") for kind, rules in (("hit", strong), ("weak", weak)) for k, (p, _, _) in enumerate(rules)})
    hit = [F.col(f"_hit{k}") for k in range(len(strong))]
    low = [F.col(f"_weak{k}") for k in range(len(weak))]
    domain = F.col("domain_category").isNotNull()
    pick = lambda values, tests, other: F.coalesce(*(F.when(t, F.lit(v)) for t, v in zip(tests, values, strict=True)), other)
    sure = F.greatest(F.lit(0.3), *(F.when(t, F.lit(c)) for t, (_, _, c) in zip(low, weak, strict=True)))
    source = F.when(F.col("source_type").isin("reddit", "twitter"), 0.5).when(F.col("source_type") == "hackernews", 0.6)
    weak_score = F.least(F.lit(10), F.lit(5) + reduce(lambda a, b: a + b, [F.when(t, b).otherwise(0) for t, (_, b, _) in zip(low, weak, strict=True)]))
    any_strong = reduce(lambda a, b: a | b, hit)
    first = F.array_compact(F.array(*(F.when(t, F.struct(F.lit(c).alias("c"), F.lit(-k).alias("k"), F.lit(f"weak_keyword:{p[:20]}").alias("r"))) for k, (t, (p, _, c)) in enumerate(zip(low, weak, strict=True)))))
    return out.withColumns(
        {
            "est_score": F.when(domain, F.col("domain_importance")).when(any_strong, pick([min(10, 5 + b) for _, b, _ in strong], hit, F.lit(5))).otherwise(weak_score),
            "est_confidence": F.when(domain, 0.85).when(any_strong, pick([c for _, _, c in strong], hit, F.lit(0.3))).when(sure < 0.4, F.coalesce(source, sure)).otherwise(sure),
            "est_reason": F.when(domain, F.concat(F.lit("domain:"), F.col("domain_rule"))).when(any_strong, pick([f"strong_keyword:{p[:25]}" for p, _, _ in strong], hit, F.lit("")))
            .when(sure >= 0.4, F.array_max(first)["r"]).when(source.isNotNull(), F.concat(F.lit("source:"), F.col("source_type"))).otherwise("unknown"),
        }
    ).drop("_text", "_head", *(f"_hit{k}" for k in range(len(strong))), *(f"_weak{k}" for k in range(len(weak))))


def skip_reason(items: DataFrame, short: int = 150, least: int = 3, sure: float = 0.5) -> DataFrame:
    """items (with est_*) with skip_reason: the first rule that finds the item of low value, else null. What is cheap is asked first."""
    title, content = F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))
    out = items.withColumns({"_low": F.lower(content), "_size": F.length(content)})
    low, size = F.col("_low"), F.col("_size")
    urls = F.regexp_count(content, F.lit(r"https?://\S+"))
    rest = F.length(F.trim(F.regexp_replace(content, r"https?://\S+", "")))
    rule = F.when(~content.rlike(r"\S"), "Empty content").when((size < short) & (F.length(title) < 50), f"Content too short (<{short} chars)")
    for reason, pattern in R.SKIP_TITLE:
        rule = rule.when(title.rlike(pattern), reason)
    rule = rule.when((F.col("est_score") <= least) & (F.col("est_confidence") >= sure), "Low importance")
    rule = rule.when((F.col("source_type") == "twitter") & (size < 200) & ~F.concat_ws(" ", title, content).rlike(R.SKIP_SIGNALS), "Twitter short content")
    rule = rule.when((size < 100) & low.contains("[link]"), "Reddit link-post with no content")
    rule = rule.when((size < 150) & F.trim(content).startswith("submitted by"), "Reddit submission boilerplate only")
    rule = rule.when(F.lower(title).startswith("rt @") & (size < 500), "Retweet with no added content").when(title.rlike(R.SKIP_ART), "Art post")
    for reason, pattern, most in R.SKIP_CONTENT:
        found = has(low, low, pattern)
        rule = rule.when((size < most) & found if most else found, reason)
    rule = rule.when((size < 500) & (urls >= 5) & (rest < 100), "Link aggregation with minimal content")
    repetitive = F.transform(F.array(F.array_remove(F.split(low, r"\s+"), "")), lambda ws: (F.size(ws) >= 20) & (F.size(F.array_distinct(ws)) / F.size(ws) < 0.3))[0]
    # fewer than 39 characters hold no 20 words
    rule = rule.when((size >= 39) & repetitive, "Repetitive/spam content")
    return out.withColumn("skip_reason", rule).drop("_low", "_size")


def skip_results(items: DataFrame) -> DataFrame:
    """What stands in for a model's reply on skipped items."""
    cut = F.when(F.length("title") > 40, F.concat(F.substring("title", 1, 40), F.lit("..."))).otherwise(F.col("title"))
    # a filter would be moved below the rules and have them computed twice; exploding none or one reason isn't
    kept = items.select("id", "title", F.explode(F.array_compact(F.array("skip_reason"))).alias("skip_reason"))
    return kept.select("id", F.concat(F.lit("[Skipped] "), cut).alias("summary"), F.lit("其他").alias("category"), F.lit(1).alias("importance_score"), "skip_reason")


def is_paper(url: Column, title: Column, domains: list[str] = R.PAPER_DOMAINS) -> Column:
    paths = r"/abs/\d+\.\d+|/pdf/\d+\.\d+|/paper/|/doi/|/article/|/publication/|/papers?/\d+|10\.\d{4,}/"
    titles = r"(?i)^arXiv:\d+\.\d+|^\[\d+\.\d+\]|\[arXiv\]|\(arXiv:\d+\)|^Paper:"
    found = X.in_domains(X.url_host(url), domains) | F.lower(url).rlike(paths) | F.coalesce(title, F.lit("")).rlike(titles)
    return F.when(url.isNull() | (url == ""), False).otherwise(F.coalesce(found, F.lit(False)))


def is_link_post(content: Column) -> Column:
    text = F.trim(F.coalesce(content, F.lit("")))
    return (F.length(text) < 100) | text.rlike(r"(?i)^\s*submitted by\s+/u/\S+\s*\[link\]\s*\[comments\]\s*$")


def is_fetchable(url: Column, hosts: list[str] = R.MEDIA_HOSTS, endings: str = R.MEDIA_ENDINGS) -> Column:
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    return F.coalesce((url != "") & ~F.coalesce(X.url_host(url), F.lit("")).isin(*hosts) & ~path.rlike(endings), F.lit(False))


def is_heavy(key_points: Column) -> Column:
    return F.coalesce(F.size(key_points) > 0, F.lit(False))


def confirming(text: Column, category: Column, table: dict = R.CONFIRMING) -> Column:
    """The boost (2 at most) of patterns that confirm a category; null where none does."""
    out = F.lit(None).cast("int")
    for c, patterns in table.items():
        hits = [text.rlike(f"(?i){p}") for p, _ in patterns]
        boost = F.least(F.lit(2), reduce(lambda a, b: a + b, [F.when(t, b).otherwise(0) for t, (_, b) in zip(hits, patterns, strict=True)]))
        out = F.when(category == c, F.when(reduce(lambda a, b: a | b, hits), boost)).otherwise(out)
    return out


def rule_only(items: DataFrame, domains: list[tuple] = R.HIGH_CONFIDENCE, communities: list[tuple] = R.SUBREDDITS, most: int = 1000, papers: int = 3000, least: int = 1, cap: int = 6) -> DataFrame:
    """Items that rules alone can finish: by community, paper archive or domain, if keywords confirm the category."""
    found = classify_domain(items, domains)
    sub = F.regexp_extract(F.lower("url"), r"reddit\.com/r/([^/]+)", 1)
    category = lambda rows: X.lookup(sub, {n: c for n, c, _ in rows})
    text = head(F.col("title"), F.col("content"), 300)
    size = F.length(F.coalesce("content", F.lit("")))
    found = found.withColumns({"_c": category(communities), "_i": X.lookup(sub, {n: int(i) for n, _, i in communities})})
    by_sub = F.col("_c").isNotNull()
    paper = F.col("domain_rule") == "arxiv.org"
    domain = F.col("domain_category").isNotNull() & ~X.url_host(F.col("url")).isin(*R.NOT_BY_RULE) & (size <= F.when(paper, papers).otherwise(most))
    found = found.withColumns({"rule_category": F.when(by_sub, F.col("_c")).when(domain, F.col("domain_category")), "_i": F.when(by_sub, F.col("_i")).otherwise(F.col("domain_importance"))})
    found = found.withColumn("_b", confirming(text, F.col("rule_category")))
    ok = F.col("title").isNotNull() & F.col("_b").isNotNull() & (F.col("_c").isNotNull() | (F.col("_b") >= least))
    done = found.filter(ok).withColumn("rule_importance", F.least(F.lit(cap), F.col("_i") + F.col("_b")))
    return done.withColumns({"summary": X.rule_summary(F.col("title")), "one_liner": X.one_liner(F.col("title"), F.col("rule_category")), "key_points": X.key_points(F.col("title"))}).drop("_c", "_i", "_b")


def route_tier(items: DataFrame) -> DataFrame:
    """heavy for high or doubtful estimates, else light."""
    return items.withColumn("tier", F.when((F.col("est_score") >= 7) | (F.col("est_confidence") < 0.5) | (F.col("est_reason") == "unknown"), "heavy").otherwise("light"))


def screen_route(screens: DataFrame, paper: Column, novelty: Column | None = None) -> DataFrame:
    """screens (importance, confidence) with refine: whether a second, larger model looks at the item."""
    refine = (F.col("importance") >= 7) | ((F.col("importance") >= 5) & (F.col("confidence") < 0.5)) | (paper & (F.col("importance") >= 10))
    if novelty is not None:
        refine = refine | (paper & novelty)
    return screens.withColumn("refine", refine)


def assign_batches(items: DataFrame, short: int = 12, long: int = 6, limit: int = 500) -> DataFrame:
    """Batches of short items and of long ones, in order of id within the partitions of `part` if there is such a column."""
    keys = ["size_class"] + (["part"] if "part" in items.columns else [])
    size = F.when(F.length(F.coalesce("content", F.lit(""))) < limit, "short").otherwise("long")
    rows, _ = numbered(items.withColumn("size_class", size).select("id", *keys), [F.asc(k) for k in (*keys, "id")], "_n")
    firsts = rows.groupBy(*keys).agg(F.min("_n").alias("_first"))
    same = [F.col(f"f.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    placed = rows.alias("r").join(firsts.alias("f"), same).select("r.id", "r.size_class", (F.col("_n") - F.col("_first")).alias("_n"))
    batch = F.floor(F.col("_n") / F.when(F.col("size_class") == "short", short).otherwise(long)).cast("long")
    return items.join(placed.select("id", "size_class", batch.alias("batch")), "id")


def reprocess_list(results: DataFrame) -> DataFrame:
    """Light results of high importance, which the heavy tier looks at again."""
    return results.filter((F.col("tier") == "light") & (F.col("importance_score") >= 7))


def extract_actions(digest: DataFrame) -> DataFrame:
    """One row for each action of important (or unrated) items."""
    return digest.filter("importance_score is null or importance_score >= 7").select("id", F.explode("actionable_items").alias("a")).select("id", "a.*")


def featurize(items: DataFrame) -> DataFrame:
    """The narrow feature row of each item that joins carry instead of texts."""
    t, c = F.col("title"), F.col("content")
    return items.select(
        "id", "category", "published_at", X.title_key(t).alias("title_key"), X.title_hash(t).alias("title_hash"), X.content_hash(t, c).alias("content_hash"), X.normalize_title(t).alias("norm_title"),
        X.hn_type(t).alias("hn_type"), X.entities(F.concat_ws(" ", t, c)).alias("entities"), X.model_names(t).alias("models"), X.keywords(t).alias("keywords"), X.source_key(F.col("url")).alias("source_key"), X.estimate_tokens(c).alias("tokens"),
    )
