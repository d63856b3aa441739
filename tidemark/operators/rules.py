"""Rule tables. Every table is a parameter of the operators that use it; these are the defaults."""

# Domain, category, importance.
DOMAINS = [
    ("github.com", "编程", 6),
    ("gitlab.com", "编程", 6),
    ("stackoverflow.com", "编程", 5),
    ("dev.to", "编程", 5),
    ("hackernews.com", "技术", 6),
    ("news.ycombinator.com", "技术", 7),
    ("medium.com", "技术", 5),
    ("substack.com", "技术", 5),
    ("hashnode.dev", "编程", 5),
    ("codepen.io", "编程", 5),
    ("replit.com", "编程", 5),
    ("codesandbox.io", "编程", 5),
    ("console.dev", "编程", 6),
    ("infoq.com", "编程", 6),
    ("dzone.com", "编程", 5),
    ("arxiv.org", "科学", 7),
    ("nature.com", "科学", 8),
    ("science.org", "科学", 8),
    ("sciencedirect.com", "科学", 7),
    ("pubmed.ncbi.nlm.nih.gov", "科学", 7),
    ("biorxiv.org", "科学", 7),
    ("medrxiv.org", "科学", 7),
    ("pnas.org", "科学", 7),
    ("cell.com", "科学", 8),
    ("openai.com", "AI", 8),
    ("anthropic.com", "AI", 8),
    ("deepmind.com", "AI", 8),
    ("huggingface.co", "AI", 7),
    ("replicate.com", "AI", 6),
    ("stability.ai", "AI", 7),
    ("midjourney.com", "AI", 6),
    ("paperswithcode.com", "AI", 7),
    ("the-decoder.com", "AI", 7),
    ("together.ai", "AI", 7),
    ("cohere.com", "AI", 7),
    ("mistral.ai", "AI", 8),
    ("perplexity.ai", "AI", 7),
    ("runway.com", "AI", 6),
    ("pika.art", "AI", 6),
    ("suno.ai", "AI", 6),
    ("claude.ai", "AI", 8),
    ("chat.openai.com", "AI", 7),
    ("gemini.google.com", "AI", 7),
    ("labs.google", "AI", 7),
    ("ai.meta.com", "AI", 8),
    ("techcrunch.com", "技术", 6),
    ("theverge.com", "技术", 5),
    ("wired.com", "技术", 5),
    ("arstechnica.com", "技术", 6),
    ("engadget.com", "技术", 5),
    ("thenextweb.com", "技术", 5),
    ("zdnet.com", "技术", 5),
    ("cnet.com", "技术", 5),
    ("9to5mac.com", "技术", 5),
    ("9to5google.com", "技术", 5),
    ("macrumors.com", "技术", 5),
    ("tomshardware.com", "技术", 5),
    ("anandtech.com", "技术", 6),
    ("producthunt.com", "产品", 6),
    ("indiegogo.com", "产品", 5),
    ("kickstarter.com", "产品", 5),
    ("betalist.com", "产品", 5),
    ("alternativeto.net", "产品", 5),
    ("crunchbase.com", "创业", 6),
    ("ycombinator.com", "创业", 6),
    ("techstars.com", "创业", 6),
    ("bloomberg.com", "商业", 6),
    ("wsj.com", "商业", 6),
    ("ft.com", "商业", 6),
    ("venturebeat.com", "创业", 6),
    ("pitchbook.com", "创业", 6),
    ("sifted.eu", "创业", 6),
    ("eu-startups.com", "创业", 5),
    ("36kr.com", "创业", 6),
    ("geekpark.net", "技术", 6),
    ("jiqizhixin.com", "AI", 7),
    ("leiphone.com", "AI", 6),
    ("sspai.com", "产品", 5),
    ("ifanr.com", "技术", 5),
]

# Pattern, category, boost.
TITLE_KEYWORDS = [
    (r"(?i)\b(GPT-?[45]|Claude|Gemini|LLM|ChatGPT)\b", "AI", 2),
    (r"(?i)\b(machine learning|deep learning|neural network)\b", "AI", 1),
    (r"(?i)\b(transformer|diffusion|RLHF)\b", "AI", 1),
    (r"(?i)\b(AI|artificial intelligence|ML model)\b", "AI", 1),
    (r"(?i)\b(RAG|fine-?tun|embeddings?|vector)\b", "AI", 1),
    (r"\b(Python|Rust|Go|JavaScript|TypeScript)\b", "编程", 0),
    (r"(?i)\b(API|SDK|framework|library)\b", "编程", 0),
    (r"(?i)\b(React|Vue|Angular|Node\.?js|Django|Flask)\b", "编程", 0),
    (r"(?i)\b(database|SQL|PostgreSQL|MongoDB|Redis)\b", "编程", 0),
    (r"(?i)\b(Docker|Kubernetes|K8s|DevOps|CI/CD)\b", "编程", 1),
    (r"(?i)\b(launch|announce|release|introducing)\b", "产品", 1),
    (r"(?i)\b(new feature|update|v\d+\.\d+)\b", "产品", 0),
    (r"(?i)\$\d+[MBK]|\d+ million|\d+ billion", "商业", 1),
    (r"(?i)\b(Series [A-Z]|seed round|IPO|acquisition)\b", "创业", 2),
    (r"(?i)\b(startup|founder|YC|Y Combinator)\b", "创业", 1),
    (r"(?i)^(How|What|Why|When|Where|Who|Which|Can|Should|Is|Are|Does|Do)\b", "其他", 0),
    (r"\?$", "其他", 0),
    (r"(?i)\b(research|study|paper|published)\b", "科学", 0),
    (r"(?i)\b(breakthrough|discovery|experiment)\b", "科学", 1),
]
# Pattern, boost, confidence.
STRONG = [
    (r"(OpenAI|Anthropic|Google|Meta)\s+(announces?|launches?|releases?)", 3, 0.8),
    (r"\$\d+[BM]\b", 2, 0.75),
    (r"(breakthrough|major|significant)\s+(discovery|advancement|update)", 2, 0.7),
    (r"(Series [C-Z]|IPO|acqui)", 2, 0.7),
    (r"(GPT-?5|Claude\s+\d|Gemini\s+\d)", 2, 0.75),
]
WEAK = [
    (r"\b(GPT|Claude|Gemini|LLM|ChatGPT)\b", 1, 0.55),
    (r"\b(AI|ML|机器学习|深度学习)\b", 1, 0.5),
    (r"\b(launch|announce|release|发布|上线)\b", 1, 0.45),
]
# Source key and its priority (lower comes first); others have 40.
SOURCE_TIERS = {
    "reddit/hardware": 10, "reddit/technology": 10, "reddit/programming": 10, "reddit/localllama": 10, "reddit/futurology": 10,
    "reddit/artificial": 20, "reddit/python": 20, "reddit/ycombinator": 20, "hackernews": 20, "reddit/reinforcementlearning": 20,
    "reddit/indiehackers": 20, "reddit/datascience": 20, "reddit/mlquestions": 20, "arxiv": 15, "nature": 15, "science": 15,
    "twitter": 30, "reddit/machinelearning": 30, "reddit/sideproject": 30, "reddit/stablediffusion": 30, "reddit/startups": 30,
    "reddit/learnmachinelearning": 30, "reddit/statistics": 30, "reddit/entrepreneur": 50, "reddit/design": 50,
    "reddit/creativecoding": 50, "reddit/art": 50, "rss": 35,
}
OTHER_SOURCE = 40
# Author and what is added to the priority; source and the length below which 10 is added.
AUTHORS = {"@anthropicai": -15, "@openai": -15, "@a16z": -10, "@paperswithcode": -10, "@karpathy": -10, "@googledeepmind": -5, "@stanfordhai": -5}
SHORT_BELOW = {"twitter": 108, "reddit": 396}
# Publishers of papers.
PAPER_DOMAINS = [
    "arxiv.org",
    "biorxiv.org",
    "medrxiv.org",
    "ssrn.com",
    "nature.com",
    "science.org",
    "cell.com",
    "pnas.org",
    "sciencedirect.com",
    "ieee.org",
    "acm.org",
    "openreview.net",
    "aclanthology.org",
    "papers.nips.cc",
    "proceedings.mlr.press",
    "paperswithcode.com",
    "springer.com",
    "wiley.com",
    "tandfonline.com",
    "oup.com",
    "cambridge.org",
]
# Hosts and file endings that are never fetched.
MEDIA_HOSTS = [
    "youtube.com",
    "youtu.be",
    "vimeo.com",
    "twitch.tv",
    "imgur.com",
    "i.imgur.com",
    "gfycat.com",
    "reddit.com",
    "i.redd.it",
    "v.redd.it",
    "preview.redd.it",
    "twitter.com",
    "x.com",
]
MEDIA_ENDINGS = r"\.(jpg|jpeg|png|gif|webp|mp4|webm|mov|pdf)$"
# Domains that classify by themselves.
HIGH_CONFIDENCE = [
    ("openai.com", "AI", 8),
    ("anthropic.com", "AI", 8),
    ("deepmind.com", "AI", 8),
    ("mistral.ai", "AI", 8),
    ("huggingface.co", "AI", 7),
    ("developer.nvidia.com", "AI", 7),
    ("stability.ai", "AI", 7),
    ("cohere.com", "AI", 7),
    ("midjourney.com", "AI", 7),
    ("nature.com", "研究", 8),
    ("science.org", "研究", 8),
    ("arxiv.org", "研究", 7),
    ("biorxiv.org", "研究", 7),
    ("cell.com", "研究", 8),
    ("blog.google", "技术", 7),
    ("engineering.fb.com", "编程", 7),
    ("github.blog", "编程", 7),
    ("blog.cloudflare.com", "技术", 7),
    ("engineering.linkedin.com", "编程", 6),
    ("engineering.uber.com", "编程", 6),
    ("netflixtechblog.com", "编程", 6),
    ("pytorch.org", "编程", 7),
    ("tensorflow.org", "编程", 7),
    ("rust-lang.org", "编程", 6),
    ("python.org", "编程", 6),
    ("golang.org", "编程", 6),
    ("kotlinlang.org", "编程", 6),
    ("typescriptlang.org", "编程", 6),
    ("github.com", "编程", 6),
    ("gitlab.com", "编程", 6),
    ("stackoverflow.com", "编程", 5),
    ("dev.to", "编程", 5),
    ("hashnode.com", "编程", 5),
    ("techcrunch.com", "创业", 6),
    ("arstechnica.com", "技术", 6),
    ("wired.com", "技术", 5),
    ("theverge.com", "技术", 5),
    ("venturebeat.com", "AI", 6),
    ("thenewstack.io", "编程", 6),
    ("infoworld.com", "技术", 5),
    ("hackernoon.com", "编程", 5),
    ("the-decoder.com", "AI", 7),
    ("aiweekly.co", "AI", 6),
    ("jiqizhixin.com", "AI", 7),
    ("36kr.com", "创业", 6),
    ("infoq.cn", "技术", 6),
    ("sspai.com", "技术", 5),
    ("oschina.net", "编程", 5),
    ("segmentfault.com", "编程", 5),
    ("juejin.cn", "编程", 5),
    ("bloomberg.com", "金融", 7),
    ("reuters.com", "金融", 7),
    ("wsj.com", "金融", 7),
    ("ft.com", "金融", 7),
    ("coindesk.com", "金融", 6),
    ("theblock.co", "金融", 6),
    ("seekingalpha.com", "金融", 6),
    ("cointelegraph.com", "金融", 6),
    ("producthunt.com", "创新", 6),
    ("ycombinator.com", "创业", 7),
    ("crunchbase.com", "创业", 6),
    ("betalist.com", "创新", 5),
]
NOT_BY_RULE = ("news.ycombinator.com", "hnrss.org")
# Community, category, importance.
SUBREDDITS = [
    ("machinelearning", "AI", 5),
    ("learnmachinelearning", "AI", 5),
    ("localllama", "AI", 6),
    ("stablediffusion", "AI", 5),
    ("reinforcementlearning", "AI", 6),
    ("artificial", "AI", 6),
    ("openai", "AI", 6),
    ("claudeai", "AI", 6),
    ("chatgpt", "AI", 5),
    ("singularity", "AI", 4),
    ("deeplearning", "AI", 6),
    ("mlquestions", "AI", 6),
    ("python", "编程", 6),
    ("programming", "编程", 7),
    ("coding", "编程", 5),
    ("learnprogramming", "编程", 4),
    ("rust", "编程", 6),
    ("golang", "编程", 6),
    ("javascript", "编程", 5),
    ("typescript", "编程", 6),
    ("cpp", "编程", 6),
    ("java", "编程", 5),
    ("webdev", "编程", 5),
    ("devops", "编程", 6),
    ("creativecoding", "编程", 2),
    ("technology", "技术", 7),
    ("futurology", "技术", 6),
    ("gadgets", "技术", 4),
    ("hardware", "技术", 7),
    ("linux", "技术", 5),
    ("selfhosted", "技术", 5),
    ("entrepreneur", "创业", 4),
    ("startups", "创业", 5),
    ("sideproject", "创业", 5),
    ("smallbusiness", "创业", 4),
    ("ycombinator", "创业", 6),
    ("indiehackers", "创业", 6),
    ("statistics", "研究", 5),
    ("datascience", "研究", 6),
    ("science", "研究", 5),
    ("compsci", "研究", 6),
    ("design", "设计", 3),
    ("web_design", "设计", 3),
    ("ui_design", "设计", 3),
    ("userexperience", "设计", 4),
]
# By category, patterns that confirm it and what each adds (2 at most).
CONFIRMING = {
    "AI": [(r"\b(GPT|Claude|Gemini|LLMs?|models?|AI|机器学习)\b", 1), (r"\b(launch|release|announce|发布|上线|更新)\b", 1), (r"\b(研究|论文|paper|research)\b", 0)],
    "研究": [(r"\b(研究|论文|paper|study|research)\b", 1), (r"\b(发现|breakthrough|discovery)\b", 2), (r"\b(实验|experiment|trial)\b", 0), (r"\b(learning|neural|network|algorithm|method)\b", 1), (r"\b(evaluation|benchmark|dataset|training)\b", 1)],
    "技术": [(r"\b(技术|tech|engineering|架构)\b", 0), (r"\b(更新|update|release|版本)\b", 1), (r"\b(开源|open.?source)\b", 1)],
    "编程": [(r"\b(code|coding|程序|开发|developer)\b", 0), (r"\b(API|SDK|库|library|framework)\b", 1), (r"\b(bug|fix|feature|PR|commit)\b", 0)],
    "创业": [(r"\b(startup|初创|创业|融资|funding)\b", 1), (r"\b(seed|series.?[a-d]|pre.?ipo|ipo)\b", 1), (r"\b(YC|Y.?Combinator|accelerator|孵化器)\b", 1)],
    "创新": [(r"\b(launch|发布|新品|product|产品)\b", 1), (r"\b(innovation|创新|disruption|颠覆)\b", 1), (r"\b(patent|专利|breakthrough|突破)\b", 1)],
    "金融": [(r"\b(invest|investment|投资|股票|stock)\b", 1), (r"\b(crypto|bitcoin|btc|eth|区块链|blockchain)\b", 1), (r"\b(市场|market|经济|economy|金融|finance)\b", 0)],
}
# The valid categories in order, and aliases.
CATEGORIES = ["AI", "机器学习", "编程", "技术", "创业", "创新", "金融", "研究", "设计", "其他"]
ALIASES = {"经济": "金融", "投资": "金融", "商业": "创业", "产品": "创新", "开发": "编程", "科研": "研究", "学术": "研究", "ML": "机器学习", "深度学习": "机器学习"}
# The skip rules by pattern: reason, column, patterns, greatest content length.
SKIP_TITLE = [
    ("Discussion/Ask post", r"(?i)^\[Discussion\]|^Ask HN:|^Ask Reddit:|^\[?AskReddit\]?:"),
    ("Poll/voting post", r"(?i)^\[Poll\]|^Vote:|^Poll:|^\[Voting\]"),
    ("Periodic thread", r"(?i)^(Daily|Weekly|Monthly)\s+(Thread|Discussion|Megathread)|^(Daily|Weekly)\s+\w+\s+Thread|^\[?(Weekly|Daily)\]?\s*-?\s*\w+\s*(Thread|Discussion)"),
]
SKIP_SIGNALS = r"(?i)\b(announce|launch|release|发布|上线)\b|\b(GPT|Claude|Gemini|LLM|AI model)\b|\$\d+[BMK]?\b|\b(breaking|重大|突破)\b"
SKIP_ART = r"(?i),\s*(digital|oil|acrylic|watercolor|charcoal|graphite|mixed media)\s*,?\s*\d{4}|\[OC\]\s*$|,\s*\d+\s*x\s*\d+\s*(cm|in|px|mm)?"
SKIP_CONTENT = [
    ("Job posting", r"\b(we.?re hiring|job opening|career opportunity|join our team)\b|\b(招聘|招人|求职|职位|岗位空缺)\b|\b(apply now|submit.*resume|send.*cv)\b", None),
    ("Promotional/spam content", r"\b(click here|subscribe now|limited time|act now|don.?t miss)\b|\b(免费领取|限时优惠|点击领取|扫码关注)\b|(🔥|💰|🎁|💯){2,}|\b(giveaway|airdrop|free.*tokens?)\b", None),
    ("Cross-post reference", r"(cross-?posted?|x-?post|originally posted)", None),
    ("Bot-generated content", r"^(i am a bot|this is an automated|auto-generated)|\[bot\]|\[automated\]|(this action was performed automatically)", None),
    ("Social media engagement request", r"\b(follow me|like and subscribe|hit that.*button)\b|\b(关注我|点赞|转发|求关注)\b|(follow|subscribe|like).*(@|#)", 200),
    ("Newsletter subscription prompt", r"(subscribe.*newsletter|sign up.*updates|join.*mailing list)", 300),
]
#: What a text in lower case holds at least one of if a pattern above is found in it; patterns that are not listed are always tried.
_NEEDLES = [
    ("announce", "launch", "release"),
    ("$",),
    ("discovery", "advancement", "update"),
    ("series ", "ipo", "acqui"),
    ("gpt", "claude", "gemini"),
]
_WEAK_NEEDLES = [("gpt", "claude", "gemini", "llm"), ("ai", "ml", "机器学习", "深度学习"), ("launch", "announce", "release", "发布", "上线")]
_SKIP_NEEDLES = [
    ("hiring", "job opening", "career opportunity", "join our team", "招聘", "招人", "求职", "职位", "岗位空缺", "apply now", "resume", "cv"),
    ("click here", "subscribe now", "limited time", "act now", "t miss", "免费领取", "限时优惠", "点击领取", "扫码关注", "🔥", "💰", "🎁", "💯", "giveaway", "airdrop", "token"),
    ("post",),
    ("bot", "auto"),
]
NEEDLES = {f"(?i){p}": n for (p, _, _), n in zip(STRONG + WEAK, _NEEDLES + _WEAK_NEEDLES, strict=True)} | {p: n for (_, p, _), n in zip(SKIP_CONTENT, _SKIP_NEEDLES, strict=False)}
