"""Text features as column expressions; patterns use the syntax that Java and RE2 share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stopwords of titles and of phrases.
TITLE_STOPWORDS = """的 是 在 了 和 与 我 你 他 她 它 这 那 a an the is are was were be been being to of in for on with at by from as i you he she it we
they my your his her this that these those what which who how why and or but if so just have has had do does""".split()
PHRASE_STOPWORDS = """the a an is are was were be been being to of in for on with at by from as i you he she it we they my your his her this that
these those what which who how why and or but if so just have has had do does did will would could should can may might must shall""".split()
# Names of models in titles.
MODEL_NAMES = (
    r"(?i)\b(Step[- ]?[\d.]+[- ]?\w+|GLM[- ]?(?:[\d.]+|OCR|V\d+)|GPT[- ]?[\d.]+|DeepSeek[- ]?v?[\d.]+|Qwen[- ]?[\d.]+|Llama[- ]?[\d.]+|Claude[- ]?[\d.]+"
    r"|Gemini[- ]?[\d.]+|TranslateGemma|Galactica|ComfyUI[- ]?\w+|Waymo|SpaceX|xAI)\b"
)
# Entity patterns of discovery.
ENTITIES = [
    r"\b(OpenAI|Google|Microsoft|Meta|Apple|Amazon|Tesla|Anthropic|Nvidia|AMD|Intel)\b",
    r"\b(DeepMind|Stability\s*AI|Hugging\s*Face|Cohere|Mistral|xAI|Perplexity)\b",
    r"\b(Netflix|Spotify|Adobe|Salesforce|Oracle|IBM|Cisco|Dell|HP)\b",
    r"(阿里巴巴|腾讯|百度|字节跳动|华为|小米|京东|美团|拼多多|滴滴)",
    r"(商汤|旷视|智谱|月之暗面|零一万物|百川智能|MiniMax)",
    r"\b(GPT-\d+[a-z]*|Claude|Gemini|Llama\s*\d*|ChatGPT)\b",
    r"\b(Sora|Grok|Flux|DeepSeek|Qwen|Kimi|DALL-E|Midjourney)\b",
    r"\b(iPhone|iPad|MacBook|Vision\s*Pro|Copilot|GitHub)\b",
    r"\b(Sam\s*Altman|Elon\s*Musk|Mark\s*Zuckerberg|Sundar\s*Pichai|Jensen\s*Huang)\b",
    r"(马斯克|扎克伯格|马化腾|李彦宏|雷军|任正非)",
]
#: Cleaning steps (pattern, replacement) of the duplicate key and of the compared title, on lower-cased text.
KEY_STEPS = [(r"^rt\s+", ""), (r"^@[\p{L}\p{N}_]+[:\s]*", ""), (r"https?://\S+", ""), (r"#[\p{L}\p{N}_]+", ""), (r"[.,!?;:\"'()\[\]{}]", " "), (r"\s+", " ")]
TITLE_STEPS = [(r"^rt\s+", ""), (r"^ask hn[:\s]+", ""), (r"^show hn[:\s]+", ""), (r"^tell hn[:\s]+", ""), (r"^launch hn[:\s]+", ""), (r"^@[\p{L}\p{N}_]+[:\s]+", ""), (r"https?://\S+", ""), (r"\s+", " ")]
# Fixed value: prefixes of discussions.
DISCUSSION = r"(?i)^(ask|show|tell|launch) hn[:\s]+"
HEAD_STEPS = [(r"^(RT\s+)?@[\p{L}\p{N}_]+[:\s]*", ""), (r"https?://\S+", "")]
# The prefix of one-liners by category.
PREFIXES = {"AI": "AI动态", "研究": "科研进展", "技术": "技术更新", "编程": "开发资讯", "产品": "产品动态", "创业": "创业动态", "创新": "创新资讯", "金融": "金融快讯", "商业": "商业资讯"}
# Parameters that only track.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "source"]
# Tokens of a call by its type.
CALL_TOKENS = {"heavy": 900, "light": 750, "batch": 300, "confirm": 220, "title": 100, "timeline": 150, "digest": 600, "report": 1000}
TOKEN = r"([\x{4e00}-\x{9fff}]+|[a-z0-9]+)"
CHINESE = r"([\x{4e00}-\x{9fff}]{2,4})"


def steps(text: Column, chain: list[tuple[str, str]]) -> Column:
    return F.trim(reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), chain, text))


def title_key(title: Column) -> Column:
    """What makes titles duplicates; null if under 5 characters."""
    key = steps(F.lower(F.trim(title)), KEY_STEPS)
    return F.when(F.length(key) >= 5, key)


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def title_hash(title: Column) -> Column:
    return short_hash(title_key(title))


def content_hash(title: Column, content: Column) -> Column:
    return short_hash(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.substring(F.coalesce(content, F.lit("")), 1, 500)))


def result_hash(title: Column, content: Column) -> Column:
    return short_hash(F.concat(title, F.lit("||"), content))


def normalize_title(title: Column) -> Column:
    return steps(F.lower(title), TITLE_STEPS)


def hn_type(title: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(title), "^(ask|show|tell|launch) hn", 1), F.lit(""))


def url_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def in_domains(host: Column, domains: list[str]) -> Column:
    """Whether the host is one of the domains or below one."""
    return reduce(lambda a, b: a | b, [(host == d) | host.endswith("." + d) for d in domains])


def normalize_url(url: Column) -> Column:
    """Without fragment, trailing slash and tracking parameters; empty for sites that have ids of their own."""
    part = lambda p: F.try_parse_url(url, F.lit(p))
    host = F.lower(part("HOST"))
    query = F.filter(F.split(part("QUERY"), "&"), lambda x: x.contains("=") & ~x.endswith("=") & ~F.lower(F.split_part(x, F.lit("="), F.lit(1))).isin(*TRACKING))
    tail = F.array_join(query, "&")
    clean = F.concat(part("PROTOCOL"), F.lit("://"), part("AUTHORITY"), F.regexp_replace(F.coalesce(part("PATH"), F.lit("")), "/+$", ""), F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise(""))
    return F.when(url.isNull() | (url == ""), "").when(in_domains(host, ["reddit.com", "twitter.com", "x.com"]), "").otherwise(F.coalesce(clean, url))


def source_key(url: Column, strict: bool = True) -> Column:
    low = F.lower(url)
    host = url_host(url)
    at = (lambda d: in_domains(host, [d])) if strict else (lambda d: low.contains(d))
    sub = F.regexp_extract(low, r"reddit\.com/r/([^/]+)", 1)
    out = F.when(at("twitter.com") | at("x.com"), "twitter").when(at("news.ycombinator.com"), "hackernews").when(at("arxiv.org"), "arxiv").when(at("nature.com"), "nature").when(at("science.org"), "science")
    return F.coalesce(out.when(sub != "", F.concat(F.lit("reddit/"), sub)).otherwise("other"), F.lit("other"))


def lookup(key: Column, table: dict[str, int]) -> Column:
    """The value of a short table, as one CASE."""
    out = F.when(key == next(iter(table)), table[next(iter(table))])
    for k in list(table)[1:]:
        out = out.when(key == k, table[k])
    return out


def priority_score(url: Column, content: Column, author: Column, source_type: Column, tiers: dict, authors: dict, short: dict, other: int) -> Column:
    """Lower comes first: the source's tier, a bonus for some authors, a penalty for short content."""
    key = source_key(url)
    key = F.when((key == "other") & source_type.isNotNull(), F.lower(source_type)).otherwise(key)
    name = F.lower(F.trim(author))
    name = F.when(name.startswith("@"), name).otherwise(F.concat(F.lit("@"), name))
    size = F.length(F.coalesce(content, F.lit("")))
    bonus = F.when(key == "twitter", F.coalesce(lookup(name, authors), F.lit(0))).otherwise(0)
    penalty = F.when(size < 50, 20).when(size < lookup(F.split_part(key, F.lit("/"), F.lit(1)), short), 10).otherwise(0)
    return F.coalesce(lookup(key, tiers), F.lit(other)) + bonus + penalty


def clean_html(html: Column) -> Column:
    """Text without tags; the commonest entities decoded."""
    text = F.regexp_replace(html, r"(?s)<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[\s\x{a0}]+", " "))


def page_text(html: Column, most: int = 5000) -> Column:
    """The main part of a page: <article>, else <main>, else everything, without scripts and frames."""
    body = reduce(lambda c, tag: F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " "), ("script", "style", "nav", "header", "footer"), html)
    pick = lambda tag: F.nullif(F.regexp_extract(body, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), F.lit(""))
    return F.substring(clean_html(F.coalesce(pick("article"), pick("main"), body)), 1, most)


def entities(text: Column, patterns: list[str] = ENTITIES) -> Column:
    """Matches of each pattern's first group, in order of the patterns, with repeats."""
    return F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(f"(?i){p}"), F.lit(1)) for p in patterns)))


def model_names(text: Column) -> Column:
    raw = F.transform(F.regexp_extract_all(text, F.lit(MODEL_NAMES), F.lit(1)), F.lower)
    return F.array_union(raw, F.transform(raw, lambda x: F.regexp_replace(x, "[- ]+", "")))


def keywords(title: Column, stopwords: list[str] = TITLE_STOPWORDS) -> Column:
    """The set of tokens of two characters or more that are no stopwords, and of model names."""
    words = F.regexp_extract_all(F.lower(F.regexp_replace(title, MODEL_NAMES, " ")), F.lit(TOKEN), F.lit(1))
    plain = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*stopwords))
    return F.array_union(F.array_distinct(plain), model_names(title))


def bigrams(text: Column, stopwords: list[str] = PHRASE_STOPWORDS) -> Column:
    """Chinese runs of 2-4 characters and pairs of neighbouring English words, both over two letters and no stopwords."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))
    fit = lambda w: (F.length(w) > 2) & ~w.isin(*stopwords)
    pairs = F.transform(F.array(words), lambda ws: F.zip_with(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))), lambda a, b: F.when(fit(a) & fit(b), F.concat_ws(" ", a, b))))[0]
    return F.concat(F.regexp_extract_all(text, F.lit(CHINESE), F.lit(1)), F.array_compact(pairs))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def title_similarity(a: Column, b: Column) -> Column:
    x, y = normalize_title(a), normalize_title(b)
    same = F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), 0.0).when(x == y, 1.0)
    return same.otherwise(jaccard(keywords(x), keywords(y)))


def rule_summary(title: Column) -> Column:
    text = steps(title, HEAD_STEPS)
    out = F.when(F.length(text) <= 50, text)
    for sep in ("。", "！", "？", ".", "!", "?", "，", ",", " - ", " | "):
        at = F.locate(sep, text) - 1
        out = out.when((at > 10) & (at < 50), F.trim(F.substring(text, F.lit(1), at + 1)))
    return out.otherwise(F.concat(F.substring(text, 1, 47), F.lit("...")))


def one_liner(title: Column, category: Column) -> Column:
    text = steps(title, HEAD_STEPS)
    prefix = F.concat(F.coalesce(lookup(category, PREFIXES), F.lit("资讯")), F.lit("："))
    out = F.when(F.length(text) <= 30, text)
    for sep in ("：", ":", " - ", " | "):
        out = out.when(text.contains(sep), F.substring(F.trim(F.split_part(text, F.lit(sep), F.lit(1))), 1, 30))
    return F.concat(prefix, out.otherwise(F.concat(F.substring(text, 1, 30), F.lit("..."))))


def key_points(title: Column) -> Column:
    """Up to three finds: companies, models, Chinese companies, money, per cent, scale."""
    found = [
        r"(?i)\b(OpenAI|Anthropic|Google|Meta|Microsoft|Apple|Nvidia)\b",
        r"(?i)\b(GPT-?\d+|Claude|Gemini|Llama|ChatGPT)\b",
        r"(阿里|腾讯|百度|字节跳动|华为|小米)",
        r"(?i)\$(\d+(?:\.\d+)?[BMK]?)",
        r"(\d+(?:\.\d+)?%)",
        r"(?i)(\d+(?:,\d+)*)\s*(?:用户|users?|downloads?)",
    ]
    return F.slice(F.array_compact(F.array(*(F.nullif(F.regexp_extract(title, p, 1), F.lit("")) for p in found))), 1, 3)


def normalize_category(category: Column, valid: list[str], aliases: dict[str, str], other: str) -> Column:
    """A valid category: itself, an alias, the first valid part of a list, or one that it contains."""
    named = lambda c: F.when(c.isin(*valid), c).otherwise(lookup(c, aliases))
    parts = F.filter(F.transform(F.split(category, "[/、,，]"), lambda p: named(F.trim(p))), lambda p: p.isNotNull())
    inside = F.filter(F.array(*(F.lit(v) for v in valid)), lambda v: category.contains(v))
    return F.coalesce(named(category), F.get(parts, F.lit(0)), F.get(inside, F.lit(0)), F.lit(other))


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.floor(F.length(text) / 3), F.lit(10)).cast("long")


def call_tokens(kind: Column, table: dict[str, int] = CALL_TOKENS, other: int = 500) -> Column:
    return F.coalesce(lookup(kind, table), F.lit(other))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Of vectors of any length; 0 if one is 0."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def sim01(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), (dot(a, b) + 1) / 2)


def hybrid_score(rule: Column, semantic: Column, rule_weight: float = 0.4, semantic_weight: float = 0.6) -> Column:
    return F.when(semantic.isNull() | (semantic == 0), rule).otherwise(rule * rule_weight + semantic * semantic_weight)
