"""URL expressions: identity keys, roles, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Query parameters that do not change which page a URL means.
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "gclsrc", "dclid", "gbraid",
    "wbraid", "msclkid", "twclid", "sc_campaign", "sc_channel", "sc_content", "sc_medium", "sc_outcome", "sc_geo", "sc_country",
    "ref", "source", "source_type", "from", "isappinstalled",
]
# Hosts and file endings that hold no article.
SKIPPED_HOSTS = [
    "github.com", "gitlab.com", "bitbucket.org", "x.com", "twitter.com", "t.me", "telegram.org", "reddit.com", "redd.it",
    "news.ycombinator.com", "lobste.rs", "producthunt.com", "youtube.com", "youtu.be", "discord.com", "discord.gg",
]
SKIPPED_ENDINGS = [
    ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".ico", ".mp3", ".mp4", ".avi", ".mov", ".webm", ".pdf", ".doc", ".docx",
    ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".tar", ".gz", ".bz2", ".7z", ".rar",
]
# Marks of pictures that are no photographs.
ICON_MARKS = ["icon", "logo", "sprite", "badge", "avatar", "pixel", "spacer", "tracking"]
# Roles of sources by the beginning of host and path; the longest beginning counts.
ROLE_PREFIXES = {
    "official_model_page": [
        "github.com", "huggingface.co", "modelscope.cn", "gitlab.com", "bitbucket.org",
    ],
    "paper": [
        "arxiv.org", "arxiv.org/abs", "openreview.net", "paperswithcode.com", "proceedings.neurips.cc", "proceedings.mlr.press",
        "dl.acm.org", "ieeexplore.ieee.org", "aclanthology.org", "research.google", "ai.meta.com/research",
        "cdn.openai.com/papers",
    ],
    "official_company_blog": [
        "openai.com", "anthropic.com", "deepmind.google", "blog.google", "ai.googleblog.com", "ai.meta.com/blog", "about.fb.com",
        "engineering.fb.com", "aws.amazon.com/blogs", "azure.microsoft.com", "blogs.microsoft.com", "nvidia.com/blog",
        "developer.nvidia.com", "blog.x.ai", "x.ai/blog", "mistral.ai", "cohere.com", "stability.ai", "deepseek.com",
        "tech.meituan.com", "seed.bytedance.com", "qwenlm.github.io", "huggingface.co/blog",
    ],
    "expert_blog": [
        "simonwillison.net", "karpathy.ai", "lilianweng.github.io", "ycombinator.com", "gwern.net", "colah.github.io",
        "jalammar.github.io",
    ],
    "aggregator": [
        "news.ycombinator.com", "reddit.com", "lobste.rs", "producthunt.com", "techmeme.com",
    ],
    "media_report": [
        "techcrunch.com", "theverge.com", "arstechnica.com", "wired.com", "venturebeat.com", "zdnet.com", "theregister.com",
        "bloomberg.com", "reuters.com", "techinasia.com", "36kr.com", "jiqizhixin.com", "theinformation.com", "infoq.com",
        "thenewstack.io",
    ],
    "social_post": [
        "x.com", "twitter.com", "t.me", "telegram.org", "linkedin.com", "weibo.com", "zhihu.com",
    ],
    "community_discussion": [
        "stackoverflow.com", "discord.com", "discuss.pytorch.org", "community.openai.com", "huggingface.co/spaces",
    ],
}
# Lower numbers are more authoritative.
ROLE_PRIORITY = {"official_company_blog": 1, "official_product_page": 2, "official_model_page": 3, "paper": 4, "social_post": 5, "media_report": 6, "expert_blog": 7, "community_discussion": 8, "aggregator": 9, "unknown": 10}

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def normalize_url(url: Column) -> Column:
    """Host without www., path without closing slashes, and the sorted, decoded query without tracking and blank values."""

    def decoded(part: Column) -> Column:
        return F.coalesce(F.try_url_decode(part), part)

    pairs = F.transform(F.split(F.regexp_extract(url, QUERY, 1), "&"), lambda p: F.struct(decoded(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), decoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: (p["v"] != "") & ~F.lower(p["k"]).isin(TRACKING_PARAMS)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    base = F.concat(bare_host(url), F.regexp_replace(path(url), "/+$", ""))
    return F.when(query == "", base).otherwise(F.concat(base, F.lit("?"), query))


def skip_reason(url: Column) -> Column:
    """Why a URL is no article, or null: a host that contains a listed one, else a listed file ending."""
    reason = F.lit(None).cast("string")
    for ending in reversed(SKIPPED_ENDINGS):
        reason = F.when(F.lower(path(url)).endswith(ending), f"skip_extension:{ending}").otherwise(reason)
    for name in reversed(SKIPPED_HOSTS):
        reason = F.when(host(url).contains(name), f"skip_domain:{name}").otherwise(reason)
    return reason


def looks_like_icon(url: Column) -> Column:
    """SVG files, marked file names and thumbnails narrower than 100 pixels."""
    whole = F.lower(path(url))
    name = F.regexp_extract(whole, "([^/]*)$", 1)
    narrow = F.coalesce(F.regexp_extract(name, r"^(\d{1,9})px-", 1).try_cast("int") < 100, F.lit(False))
    return whole.endswith(".svg") | whole.contains(".svg.") | name.rlike("|".join(ICON_MARKS)) | narrow


def safe_link(url: Column) -> Column:
    """http(s) without control characters, spaces or angle brackets, and with balanced parentheses."""
    opened, closed = F.length(F.regexp_replace(url, r"[^(]", "")), F.length(F.regexp_replace(url, r"[^)]", ""))
    return F.coalesce(F.lower(url).rlike("^https?://[^/?#]+") & ~url.rlike(r"[\x00-\x20\x7f<>\[\]]") & (opened == closed), F.lit(False))


def with_role(items: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``role``: that of the longest listed beginning of host and path, else unknown."""
    role_of = {p: role for role, patterns in ROLE_PREFIXES.items() for p in patterns}
    longest_first = "|".join(p.replace(".", r"\.") for p in sorted(role_of, key=len, reverse=True))
    full = F.concat(bare_host(F.col(url)), F.lower(path(F.col(url))))
    roles = F.create_map(*(F.lit(x) for pair in role_of.items() for x in pair))
    return items.withColumn("role", F.coalesce(roles[F.regexp_extract(full, f"^({longest_first})", 1)], F.lit("unknown")))
