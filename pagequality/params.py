"""Parameters of the scoring, filtering and dedup rules.

Every operator takes ``params=`` and falls back to ``DEFAULT``.  The list
values below are fixed values that must stay equal to the behaviour this
engine reproduces; they are stated plainly and in their natural order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (word lists, patterns, thresholds) -- do not reorder.
# ---------------------------------------------------------------------------

SKIP_EXTENSIONS = (".pdf", ".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx", ".zip", ".tar", ".gz")

HIGH_QUALITY_TLDS = ("edu", "gov", "mil", "ac.uk", "gov.uk", "edu.au")

LOW_QUALITY_TLDS = (
    "xyz", "click", "top", "buzz", "site", "online", "store", "club", "icu", "fun",
    "wang", "gdn", "bid", "loan", "racing",
)

SEO_KEYWORDS = ("best", "top", "review", "guide", "tips", "ultimate", "cheap", "deals", "coupon")

AI_PHRASES = (
    "it's important to note",
    "it is important to note",
    "in this article",
    "let's dive",
    "dive into",
    "in today's digital",
    "whether you're a",
    "in conclusion",
    "game changer",
    "game-changer",
    "comprehensive guide",
    "everything you need to know",
    "look no further",
    "without further ado",
    "in the world of",
    "navigating the",
    "at the end of the day",
    "it's worth noting",
    "unlock the power",
    "the ultimate guide",
    "streamline your",
    "take it to the next level",
    "leverage the power",
    "delve into",
)

DISCUSSION_MARKERS = ("replied", "says", "wrote:", "commented", "points)", "upvote")

AD_TRACKERS = (
    "adsbygoogle", "googletag", "doubleclick", "adsense", "taboola", "outbrain",
    "analytics.js", "gtag", "fbevents", "hotjar",
)

CUSTOM_BLOCKED = (
    "linkedin.com", "facebook.com", "instagram.com", "tiktok.com", "x.com", "twitter.com",
    "threads.net", "researchgate.net", "quora.com", "pinterest.com", "pinterest.co.uk",
    "yelp.com", "tripadvisor.com", "amazon.com", "ebay.com", "walmart.com", "indeed.com",
    "glassdoor.com", "scribd.com", "academia.edu",
)

# label -> URL substrings; the first label with a hit wins, so order matters.
PAGE_TYPES = (
    ("qa", ("/questions/", "/answers/")),
    ("wiki", ("/wiki/", ".wiki.")),
    ("docs", ("/docs/", "/doc/", "/documentation/", ".readthedocs.", "/reference/")),
    ("code", ("/blob/", "/tree/", "/commit/", "/pull/", "/issues/", "/issue/")),
    ("discussion", ("/comments/", "/comment/", "/discuss", "/forum", "/thread")),
    ("article", ("/blog/", "/posts/", "/post/", "/article")),
    ("product", ("/product/", "/buy/", "/pricing", "/shop/")),
)

URL_REWRITES = (("reddit.com", "old.reddit.com"),)

TRUNCATION_MARKER = "\n[...truncated]"

PROMPT_TEMPLATE = (
    "Extract information relevant to the query from this page content.\n"
    "Focus on: project names, features, technical details, URLs, and anything directly useful.\n"
    "Skip: boilerplate, navigation, ads, unrelated content.\n"
    "Be concise. Only include what's relevant.\n"
    "\n"
    "Query: {query}\n"
    "\n"
    "Content:\n"
    "{content}\n"
    "\n"
    "Relevant information:"
)

# Public suffixes known to the built-in registered-domain split.  A user with
# the full public suffix list passes it as ``Params(public_suffixes=...)``.
PUBLIC_SUFFIXES = (
    # generic
    "com", "net", "org", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "mobi",
    "aero", "coop", "museum", "io", "co", "ai", "app", "dev", "page", "blog", "news", "tech",
    "cloud", "online", "site", "store", "shop", "xyz", "top", "click", "buzz", "club", "icu",
    "fun", "wang", "gdn", "bid", "loan", "racing", "live", "life", "world", "today", "space",
    "website", "link", "win", "vip", "art", "design", "media", "social", "wiki", "guru",
    # country codes
    "ac", "ad", "ae", "ar", "at", "au", "be", "bg", "br", "by", "ca", "ch", "cl", "cn", "cz",
    "de", "dk", "ee", "es", "eu", "fi", "fr", "gr", "hk", "hr", "hu", "id", "ie", "il", "in",
    "ir", "is", "it", "jp", "kr", "kz", "lt", "lu", "lv", "me", "mx", "my", "nl", "no", "nz",
    "pe", "ph", "pk", "pl", "pt", "ro", "rs", "ru", "se", "sg", "si", "sk", "th", "tr", "tv",
    "tw", "ua", "uk", "us", "vn", "za", "ly", "gg", "to", "fm", "am", "cc", "ws", "la", "st",
    # second level
    "co.uk", "ac.uk", "gov.uk", "org.uk", "ltd.uk", "plc.uk", "me.uk", "nhs.uk", "sch.uk",
    "com.au", "net.au", "org.au", "edu.au", "gov.au", "asn.au", "id.au",
    "co.nz", "org.nz", "ac.nz", "govt.nz", "co.jp", "ne.jp", "or.jp", "ac.jp", "go.jp",
    "co.kr", "or.kr", "ac.kr", "go.kr", "com.br", "org.br", "gov.br", "edu.br",
    "com.cn", "net.cn", "org.cn", "gov.cn", "edu.cn", "ac.cn", "com.tw", "edu.tw", "gov.tw",
    "com.hk", "edu.hk", "gov.hk", "co.in", "ac.in", "gov.in", "edu.in", "org.in", "net.in",
    "com.mx", "edu.mx", "gob.mx", "com.ar", "gob.ar", "edu.ar", "co.za", "ac.za", "gov.za",
    "com.sg", "edu.sg", "gov.sg", "com.tr", "edu.tr", "gov.tr", "com.ru", "com.ua",
    "co.il", "ac.il", "gov.il", "ac.at", "co.at", "or.at", "com.es", "gob.es", "com.pl",
    "github.io", "blogspot.com", "herokuapp.com", "readthedocs.io", "pages.dev", "netlify.app",
)


@dataclass(frozen=True)
class Params:
    # search / results flow
    max_pages: int = 20
    search_limit: int = 100
    cli_limit: int = 10
    # scoring
    baseline: int = 50
    ai_penalty: int = -20
    min_text: int = 50
    off_topic: float = 0.15
    low_relevance: float = 0.2
    moderate_relevance: float = 0.3
    high_relevance: float = 0.5
    # near-dup removal
    dedup_threshold: float = 0.6
    shingle_size: int = 5
    num_perm: int = 128
    lsh_bands: int = 18
    lsh_rows: int = 7
    min_content_length: int = 100
    # output
    max_chars: int = 12000
    min_length: int = 200
    min_score: int = 30
    max_slug_length: int = 80
    tokens_per_char: int = 4
    truncation_marker: str = TRUNCATION_MARKER
    tier_high: int = 70
    tier_med: int = 45
    embedding_max_chars: int = 5000
    llm_max_input_chars: int = 4000
    # sample-affinity (own provider for the ai_score input)
    affinity_ngram: int = 3
    affinity_threshold: float = 0.5
    # lists
    skip_extensions: tuple = SKIP_EXTENSIONS
    high_quality_tlds: tuple = HIGH_QUALITY_TLDS
    low_quality_tlds: tuple = LOW_QUALITY_TLDS
    seo_keywords: tuple = SEO_KEYWORDS
    ai_phrases: tuple = AI_PHRASES
    discussion_markers: tuple = DISCUSSION_MARKERS
    ad_trackers: tuple = AD_TRACKERS
    custom_blocked: tuple = CUSTOM_BLOCKED
    page_types: tuple = PAGE_TYPES
    url_rewrites: tuple = URL_REWRITES
    public_suffixes: tuple = PUBLIC_SUFFIXES
    prompt_template: str = PROMPT_TEMPLATE
    extra: dict = field(default_factory=dict)


DEFAULT = Params()
