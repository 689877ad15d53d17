"""Text expressions: sentences, cleaning, languages, sections, templates."""

from __future__ import annotations

import html
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Signals of a call to action.
CTA_KEYWORDS = ["订阅", "会员", "newsletter", "ad-free", "立即订阅", "注册", "联系我们", "we're hiring", "we are hiring", "apply", "join our team", "subscribe", "sign up", "sign-up"]
CTA = "(?i)(" + "|".join(CTA_KEYWORDS) + ")"
SENTENCE_END = "[。！？.!?]"
# Patterns of lines that are no article text.
NOISE_LINES = [
    r"阅读原文(\s*[·丨\-:：]\s*.+)?",
    r"原文链接(\s*[·丨\-:：]\s*.+)?",
    r"点击(查看|阅读)原文.*",
    r"read\s+more(\s+(at|on)\s+\S+)?[.…»]*",
    r"continue\s+reading(\s+\S+)?[.…»]*",
    r"the\s+post\s+.+\s+appeared\s+first\s+on\s+.+\.?",
    r"(来源|来自|转自|source|via)\s*[:：]\s*.+",
]
NOISE = r"(?i)^\s*(" + "|".join(NOISE_LINES) + r")\s*$"
COMMENTS = "--- Top Comments ---"
CJK = "一-鿿㐀-䶿豈-﫿"
LEAST_KEPT, LEAST_CHARS = 0.3, 200


def strip_tags(text: Column) -> Column:
    """Tags become spaces; entities are left to ``unescape``."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"[ \t\r\n]+", " "))


@F.udf(StringType(), useArrow=False)
def unescape(text: str | None) -> str | None:
    """Decodes HTML entities; workers hold a hundred texts at a time, not an Arrow batch of 10,000."""
    return html.unescape(text) if text is not None else None


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), f"(?<={SENTENCE_END})\\s*"), lambda s: F.trim(s) != "")


def strip_cta(text: Column) -> Column:
    """(text, changed): the text without the sentences that call to action."""
    every = sentences(text)
    kept = F.filter(every, lambda s: ~s.rlike(CTA))
    return F.struct(F.trim(F.array_join(kept, " ")).alias("text"), (F.size(kept) != F.size(every)).alias("changed"))


def collapse_blank_lines(text: Column) -> Column:
    """Runs of blank lines become one."""
    return F.trim(F.regexp_replace(text, "\n{3,}", "\n\n"))


def drop_noise_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.rlike(NOISE)), "\n")


def _bare(text: str) -> str:
    return re.sub(r"[\s\W_]+", "", unicodedata.normalize("NFKC", text)).lower()


_PY_NOISE, _PY_CTA = re.compile(NOISE), re.compile(CTA)


def clean_text(raw: str | None, title: str | None = None) -> str:
    """An article without its repeated title, noise lines, closing site line and calls to action; the last only if enough is left."""
    if not raw or not raw.strip():
        return ""
    lines = [line.strip() for line in re.split(r"\r\n|\r|\n", html.unescape(raw))]
    name, start = _bare(title or ""), 0
    if name:
        while start < len(lines) and (not lines[start] or _bare(lines[start]) == name):
            start += 1
    lines = lines[start:]
    while lines and not lines[-1]:
        lines.pop()
    if lines and re.match(r"^[-—–]{1,2}\s*[^-—–\n]{1,40}$", lines[-1]):
        lines.pop()
    lines = [line for line in lines if not line or not _PY_NOISE.match(line)]

    def joined(parts: list[str]) -> str:
        return re.sub(r"\n{3,}", "\n\n", "\n".join(parts)).strip()

    def without_cta(line: str) -> str:
        parts = [s for s in re.split(f"(?<={SENTENCE_END})\\s*", line) if s.strip()]
        return " ".join(s for s in parts if not _PY_CTA.search(s)).strip()

    before, after = joined(lines), joined([without_cta(line) for line in lines])
    return before if before and (len(after) < LEAST_KEPT * len(before) or len(after) < LEAST_CHARS) else after


@F.pandas_udf(StringType())
def clean_article(raw: pd.Series, title: pd.Series) -> pd.Series:
    return pd.Series([clean_text(r, t) for r, t in zip(raw, title, strict=True)])


def split_comments(text: Column) -> Column:
    """(main, comments), parted at the first comment mark."""
    at = F.instr(text, COMMENTS)
    main = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    rest = F.when(at > 0, F.substring(text, at + len(COMMENTS), F.length(text))).otherwise("")
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    return F.struct(strip(main).alias("main"), strip(rest).alias("comments"))


def resolve_content(clean: Column, raw: Column, summary: Column, status: Column) -> Column:
    """The best text there is: cleaned, raw, the source's summary, nothing."""
    some = lambda c: F.nullif(c, F.lit(""))
    full = some(raw).isNotNull()
    tier = F.when(full, "full_text").when(some(summary).isNotNull(), "rss_summary").otherwise("none")
    text = F.when(full, F.coalesce(some(clean), raw)).otherwise(F.coalesce(summary, F.lit("")))
    return F.struct(text.alias("text"), tier.alias("tier"), full.alias("is_full"), F.coalesce(some(status), F.lit("unknown")).alias("status"))


def stage_input(text: Column, stage: str) -> Column:
    """What a stage is sent: 800 characters with comments and 1000 without for analysis, 4000 for enrichment."""
    main = split_comments(text)["main"]
    limit = F.lit(4000) if stage == "enrichment" else F.when(text.contains(COMMENTS), 800).otherwise(1000)
    sent = F.substring(main, F.lit(1), limit)
    return F.struct(sent.alias("text"), F.length(main).alias("original_length"), F.length(sent).alias("sent_length"), limit.alias("truncation_limit"))


def source_note(tier: Column, status: Column, is_full: Column) -> Column:
    note = F.concat(F.lit("注意：本条目正文抓取"), status, F.lit("（来源："), tier, F.lit("），以下内容仅为来源摘要，请勿因此判定为内容单薄而扣分。"))
    return F.when(is_full, "").otherwise(note)


ENGAGEMENT = [("score", "score: %s"), ("descendants", "%s comments"), ("favorite_count", "%s likes"), ("retweet_count", "%s retweets"), ("reply_count", "%s replies"), ("views", "%s views"), ("bookmarks", "%s bookmarks")]


def discussion_section(columns: list[str], comments: Column) -> Column:
    """Comments and the engagement figures that are neither null nor 0, in lines; ratios in percent."""
    parts = [F.when(F.coalesce(F.col(c), F.lit(0)) != 0, F.format_string(fmt, F.col(c).cast("string"))) for c, fmt in ENGAGEMENT if c in columns]
    if "upvote_ratio" in columns:
        parts.append(F.when(F.coalesce(F.col("upvote_ratio"), F.lit(0)) != 0, F.concat(F.lit("upvote ratio: "), F.bround(F.col("upvote_ratio") * 100, 0).cast("int").cast("string"), F.lit("%"))))
    figures = F.concat_ws(", ", *parts)
    lines = [F.when(F.coalesce(comments, F.lit("")) != "", F.concat(F.lit("Community Comments:\n"), comments)), F.when(figures != "", F.concat(F.lit("Engagement: "), figures))]
    lines += [F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(label), F.col(c))) for c, label in (("discussion_url", "Discussion: "), ("community_note", "Community Note: ")) if c in columns]
    return F.concat_ws("\n", *lines)


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def detect_language(text: Column) -> Column:
    """zh if more than three tenths of the characters are CJK, else en; unknown without text."""
    share = F.length(F.regexp_replace(text, f"[^{CJK}]", "")) / F.length(text)
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", "unknown").when(share > 0.3, "zh").otherwise("en")


def language_block(original: Column, title_en: Column, title_zh: Column) -> Column:
    """Languages that can be shown, with the original first if it lacks a title of its own."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    titles = F.array_compact(F.array(F.when(has(title_en), "en"), F.when(has(title_zh), "zh")))
    add = original.isin("en", "zh") & ~F.array_contains(titles, original)
    available = F.when(add, F.concat(F.array(original), titles)).otherwise(titles)
    return F.struct(available.alias("available"), F.lit("zh").alias("shown"), ((original != "zh") & F.array_contains(available, "zh")).alias("is_ai_translated"))


def content_block(languages: Column, fields: dict[str, dict[str, Column]], fallback: dict[str, Column]) -> Column:
    """By language a struct of fields, each falling back to the unlocalised value."""
    structs = [F.struct(F.lit(lang).alias("lang"), *(F.coalesce(F.nullif(by.get(lang, F.lit(None)), F.lit("")), fallback[name]).alias(name) for name, by in fields.items())) for lang in ("en", "zh")]
    return F.filter(F.array(*structs), lambda s: F.array_contains(languages, s["lang"]))


def translation_status(original: Column, html_zh: Column, html: Column, is_selected: Column, failed: Column) -> Column:
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(original == "zh", "not_needed").when(has(html_zh), "translated").when(~has(html), "no_content").when(~is_selected, "not_selected").when(failed, "failed").otherwise("pending")


def parse_model_json(response: Column) -> Column:
    """The first JSON object that can be read: the whole text, a json code fence, any code fence, then by Python the outermost braces."""
    whole = F.trim(response)
    tries = [whole, F.regexp_extract(response, r"(?s)```json\s*(.*?)\s*```", 1), F.regexp_extract(response, r"(?s)```\s*(.*?)\s*```", 1)]
    good = [F.when(F.try_parse_json(t).isNotNull() & t.startswith("{"), t) for t in tries]
    return F.coalesce(*good, braces(response))


@F.pandas_udf(StringType())
def braces(response: pd.Series) -> pd.Series:
    """The first balanced object in prose, with braces inside strings passed over."""

    def find(text: str | None) -> str | None:
        for start in (m.start() for m in re.finditer(r"\{", text or "")):
            try:
                value, end = json.JSONDecoder().raw_decode(text, start)
            except ValueError:
                continue
            if isinstance(value, dict):
                return text[start:end]
        return None

    return response.map(find)


def parse_yes_no(response: Column) -> Column:
    """True if the JSON answer's r, or else relevant, is 是; without readable JSON, if the text begins with 是 or y. A cut JSON answer is closed first."""
    t = F.trim(response)
    closed = F.when(t.contains("{") & ~t.endswith("}"), F.concat(t, F.lit('"}'))).otherwise(t)
    readable = t.contains("{") & F.try_parse_json(closed).isNotNull()
    field = lambda name: F.nullif(F.get_json_object(closed, f"$.{name}"), F.lit(""))
    said = F.coalesce(F.coalesce(field("r"), field("relevant")) == "是", F.lit(False))
    return F.when(readable, said).otherwise(F.coalesce(F.substring(t, 1, 1).isin("是", "Y", "y"), F.lit(False)))


def pangu(text: Column) -> Column:
    """A space between CJK and ASCII letters or digits."""
    return F.regexp_replace(F.regexp_replace(text, f"([{CJK}])([A-Za-z0-9])", "$1 $2"), f"([A-Za-z0-9])([{CJK}])", "$1 $2")


def truncate_segments(text: Column, limit: int, delimiter: str) -> Column:
    """Whole segments as long as their total stays within the limit; the first always stays."""
    parts = F.split(text, f"\\Q{delimiter}\\E")
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def add(state: Column, part: Column) -> Column:
        longer = F.when(state["n"] == 0, part).otherwise(F.concat(state["kept"], F.lit(delimiter), part))
        stop = state["full"] | ((state["n"] > 0) & (F.length(longer) > limit))
        return F.struct(F.when(stop, state["kept"]).otherwise(longer).alias("kept"), (state["n"] + F.when(stop, 0).otherwise(1)).alias("n"), stop.alias("full"))

    return F.aggregate(parts, start, add)["kept"]


_HOLE = re.compile(r"#\{(\w+)(?:\?([^}]*))?\}")


def fill(template: str, values: dict[str, str]) -> str:
    """``#{key}`` and ``#{key?limit=N&split=D}``; unknown keys stay."""

    def one(m: re.Match) -> str:
        if m[1] not in values:
            return m[0]
        options = dict(o.split("=", 1) for o in (m[2] or "").split("&") if "=" in o)
        value = values[m[1]] or ""
        if "limit" in options:
            split, limit = options.get("split", "\n"), int(options["limit"])
            kept: list[str] = []
            for part in value.split(split):
                if kept and len(split.join([*kept, part])) > limit:
                    break
                kept.append(part)
            value = split.join(kept)
        return value

    return _HOLE.sub(one, template)


@F.pandas_udf(StringType())
def render_template(template: pd.Series, values: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else fill(t, dict(v or {})) for t, v in zip(template, values, strict=True)])


def flatten(markdown: str) -> str:
    """Markdown for plain messengers: details blocks become lists, anchors go, unsafe links lose their target."""
    text = re.sub(r"(?is)<details[^>]*>\s*<summary[^>]*>(.*?)</summary>(.*?)</details>", lambda m: f"- {m[1].strip()}\n" + "\n".join(f"  - {line.strip()}" for line in m[2].strip().splitlines() if line.strip()), markdown)
    text = re.sub(r"(?i)<a\s+(?:id|name)=[^>]*>\s*</a>", "", text)
    safe = lambda u: re.fullmatch(r"https?://[^\s<>\[\]\x00-\x1f]+", u) is not None and u.count("(") == u.count(")")
    return re.sub(r"\[([^\]]*)\]\(((?:[^()\s]|\([^()\s]*\))*)\)", lambda m: m[0] if safe(m[2]) else m[1], text)


@F.pandas_udf(StringType())
def flatten_markdown(markdown: pd.Series) -> pd.Series:
    return markdown.map(lambda t: None if t is None else flatten(t))


def sanitize_filename(name: Column, longest: int = 80) -> Column:
    """Characters that file systems refuse become underscores; a long name keeps its ending."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(name, r'[\\/:*?"<>|\x00-\x1f]', "_"), r"\s+", " "))
    ending = F.regexp_extract(plain, r"(\.[A-Za-z0-9]{1,5})$", 1)
    cut = F.concat(F.substring(plain, F.lit(1), F.lit(longest) - F.length(ending)), ending)
    return F.when(F.length(plain) > longest, cut).otherwise(plain)


def block_batches(blocks: Column, most: int = 20, chars: int = 3000) -> Column:
    """Batch number of each block: greedy, in order, up to so many blocks and characters."""
    start = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(0).alias("chars"))

    def add(state: Column, block: Column) -> Column:
        full = (state["n"] > 0) & ((state["n"] >= most) | (state["chars"] + F.length(block) > chars))
        batch = state["batch"] + F.when(full, 1).otherwise(0)
        return F.struct(F.concat(state["at"], F.array(batch)).alias("at"), batch.alias("batch"), F.when(full, 1).otherwise(state["n"] + 1).alias("n"), F.when(full, F.length(block)).otherwise(state["chars"] + F.length(block)).alias("chars"))

    return F.aggregate(blocks, start, add)["at"]
