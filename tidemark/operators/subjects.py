"""Topics: classification, bridges to items, sections, and the match of interests to sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# arXiv codes by unified topic.
ARXIV_TOPICS = {
    "computer-vision": ["cs.CV", "cs.GR", "eess.IV"],
    "nlp-llm": ["cs.CL"],
    "machine-learning": ["cs.LG", "cs.AI", "cs.NE", "stat.ML"],
    "embodied-robotics": ["cs.RO"],
    "agent-multi-agent": ["cs.MA"],
    "interdisciplinary": ["cs.HC", "cs.IR", "cs.CE", "cs.CR"],
    "multimodal": ["cs.MM"],
    "ai-systems": ["cs.SE", "cs.DC", "cs.AR", "cs.PF"],
    "speech-audio": ["cs.SD", "eess.AS", "eess.SP"],
}
#: Names of a catalogue's topics by unified topic; our own choice.
CATALOGUE_TOPICS = {"nlp-llm": ["Natural Language Processing Techniques", "Topic Modeling"], "computer-vision": ["Advanced Neural Network Applications"], "reinforcement-learning": ["Reinforcement Learning in Robotics"], "speech-audio": ["Speech Recognition and Synthesis"]}
#: Keywords in order of preference; our own choice.
KEYWORDS = {
    "machine-learning": ["machine learning", "transfer learning", "federated learning", "zero-shot"],
    "deep-learning": ["deep learning", "neural network", "transformer", "attention mechanism"],
    "reinforcement-learning": ["reinforcement learning", "policy gradient", "reward function"],
    "nlp-llm": ["language model", "machine translation", "question answering", "llm"],
    "computer-vision": ["image", "object detection", "segmentation"],
    "agent-multi-agent": ["agent", "tool use"],
}
# Sections of a daily list by the slug of an item's content form.
SECTIONS = {"model-release": "模型与产品", "product-update": "模型与产品", "benchmark-evaluation": "模型与产品", "industry-news": "行业与趋势", "phenomenon-trend": "行业与趋势", "policy-regulation": "行业与趋势", "paper-research": "论文与研究", "tutorial-practice": "技巧与观点", "expert-opinion": "技巧与观点"}
DEFAULT_SECTION, CONTENT_FORM, DEFAULT_FORM = "行业与趋势", "内容形态", "industry-news"


# Slugs of the packaged topics by group, news topics in three groups, paper topics in five.
NEWS_GROUPS = {
    "公司与模型": ["openai-chatgpt", "anthropic-claude", "google-gemini", "deepseek", "qwen", "kimi-moonshot", "minimax", "zhipu-glm", "xai-grok", "meta-llama", "microsoft-copilot", "nvidia", "huggingface", "cursor", "openrouter"],
    "技术方向": ["ai-agent", "ai-coding", "reasoning", "multimodal", "image-generation", "ai-video", "speech-audio", "embodied-ai", "on-device-ai", "open-source-ecosystem", "deployment-engineering", "data-training", "safety-alignment", "mcp-tool-use"],
    "内容形态": ["model-release", "product-update", "paper-research", "benchmark-evaluation", "tutorial-practice", "expert-opinion", "phenomenon-trend", "industry-news", "policy-regulation"],
}
PAPER_GROUPS = {
    "基础与模型": ["machine-learning", "deep-learning", "reinforcement-learning"],
    "语言与视觉": ["nlp-llm", "computer-vision", "multimodal", "speech-audio"],
    "生成与智能体": ["llm", "image-video-generation", "agent-multi-agent"],
    "系统与机器人": ["ai-systems", "embodied-robotics"],
    "其他": ["interdisciplinary", "other"],
}
#: Most sources and domains that count as configuration; more of them is an error, not a plan.
MOST_CONFIGURED = 10_000
#: Keywords up to which each is looked for by itself.
FEW_KEYWORDS = 16


def _mapping(table: dict[str, list[str]]) -> Column:
    return F.create_map(*(F.lit(x) for topic, names in table.items() for name in names for x in (name, topic)))


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """The distinct keywords, which are lower-case and not empty, that the lower-cased text contains; none for a null text.

    Up to FEW_KEYWORDS are looked for natively, more by one automaton of all of them in one pass over the text.
    """
    distinct = list(dict.fromkeys(k for k in keywords if k))
    if not distinct:
        return F.array().cast("array<string>")
    if len(distinct) > FEW_KEYWORDS:
        return _found_by_automaton(distinct)(F.lower(text))
    # The text is bound once: every mention of an expression under a condition would lower it again.
    within = F.transform(F.array(F.lower(text)), lambda t: F.filter(F.array(*map(F.lit, distinct)), lambda k: t.contains(k)))
    return F.filter(F.flatten(within), lambda k: k.isNotNull())


def _found_by_automaton(keywords: list[str]) -> Callable[[Column], Column]:
    @F.pandas_udf(ArrayType(StringType()))
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for k in keywords:
            automaton.add_word(k, k)
        automaton.make_automaton()

        def inside(text: str | None) -> list[str]:
            # A keyword that ends another's match is reported too.
            return [] if text is None else list({k for _, k in automaton.iter(text)})

        for texts in batches:
            yield texts.map(inside, na_action=None)

    return found


def paper_topics(papers: DataFrame, keywords: dict[str, list[str]] = KEYWORDS) -> DataFrame:
    """(id, slug, confidence, reason) of papers (id, title, abstract, categories).

    Catalogue names and codes give 0.85, of several names of one topic the last; a keyword gives 0.7 where these gave
    nothing, of several the first; papers without any topic get other with 0.5. One row at a time, without a shuffle.
    """
    papers = papers.withColumn("_hits", keyword_hits(F.concat_ws(" ", "title", "abstract"), [t for terms in keywords.values() for t in terms]))

    def found(table: dict, label: str) -> Column:
        mapping = _mapping(table)
        return F.filter(F.transform("categories", lambda c: F.struct(mapping[c].alias("slug"), F.lit(0.85).alias("confidence"), F.concat(F.lit(f"{label}: "), c).alias("reason"))), lambda s: s["slug"].isNotNull())

    def once(entries: Column, last: bool) -> Column:
        """One entry per slug: the last or the first."""
        ordered = F.reverse(entries) if last else entries
        return F.aggregate(ordered, F.slice(entries, 1, 0), lambda kept, e: F.when(F.exists(kept, lambda k: k["slug"] == e["slug"]), kept).otherwise(F.concat(kept, F.array(e))))

    words = []
    for slug, terms in keywords.items():
        hit = F.get(F.filter(F.array(*map(F.lit, terms)), lambda t: F.array_contains("_hits", t)), F.lit(0))
        words.append(F.when(hit.isNotNull(), F.struct(F.lit(slug).alias("slug"), F.lit(0.7).alias("confidence"), F.concat(F.lit("keyword: "), hit).alias("reason"))))
    other = F.array(F.struct(F.lit("other").alias("slug"), F.lit(0.5).alias("confidence"), F.lit("no topic matched").alias("reason")))
    named = papers.withColumn("_n", once(found(CATALOGUE_TOPICS, "catalogue topic"), True)).withColumn("_c", once(found(ARXIV_TOPICS, "arXiv category"), False))
    named = named.withColumn("_all", F.concat("_n", "_c", F.array_compact(F.array(*words))))
    every = once(F.col("_all"), False)
    return named.withColumn("_t", every).select("id", F.explode(F.when(F.size("_t") == 0, other).otherwise(F.col("_t"))).alias("t")).select("id", "t.*")


def clean_topic_response(answers: DataFrame) -> DataFrame:
    """(id, slug, name, confidence) of JSON arrays: trimmed, blank slugs dropped, confidence 0.5 and name slug by default."""
    kind = "array<struct<slug: string, name: string, confidence: double>>"
    rows = answers.select("id", F.explode(F.from_json("response", kind)).alias("t")).select("id", F.trim("t.slug").alias("slug"), F.trim("t.name").alias("name"), "t.confidence")
    return rows.filter("slug != ''").select("id", "slug", F.coalesce(F.nullif("name", F.lit("")), F.col("slug")).alias("name"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"))


def ensure_content_form(rows: DataFrame) -> DataFrame:
    """Items of (id, slug, group_name, confidence) without a content form get the default one."""
    lacking = rows.groupBy("id").agg(F.bool_or(F.col("group_name") == CONTENT_FORM).alias("has")).filter("NOT has")
    return rows.unionByName(lacking.select("id", F.lit(DEFAULT_FORM).alias("slug"), F.lit(CONTENT_FORM).alias("group_name"), F.lit(0.5).alias("confidence")))


def attach_topics(rows: DataFrame, topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(attached, rejected) of rows (id, slug, confidence, pos): the last row per item and active topic; unknown and inactive slugs are rejected."""
    active = topics.filter("is_active").select("topic", "slug")
    last = rows.join(active, "slug").groupBy("id", "topic").agg(F.max_by("confidence", "pos").alias("confidence"))
    return last, rows.join(active, "slug", "left_anti")


def seed_topics(old: DataFrame, new: DataFrame) -> DataFrame:
    """Topics by slug; a new row replaces an old one."""
    both = old.alias("o").join(new.alias("n"), "slug", "full")
    there = F.col("n.name").isNotNull()
    return both.select("slug", *(F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns if c != "slug"))


def taxonomy(spark: SparkSession) -> DataFrame:
    """(kind, slug, name, group_name, sort_order, is_active) of the packaged topics, kind news or paper; names are ours, made of the slugs."""
    rows = []
    for kind, groups in (("news", NEWS_GROUPS), ("paper", PAPER_GROUPS)):
        ordered = [(slug, group) for group, slugs in groups.items() for slug in slugs]
        rows += [(kind, slug, slug.replace("-", " ").capitalize(), group, 10 * (at + 1), True) for at, (slug, group) in enumerate(ordered)]
    return spark.createDataFrame(rows, "kind string, slug string, name string, group_name string, sort_order int, is_active boolean")


def sections(items: DataFrame, bridge: DataFrame) -> DataFrame:
    """Adds ``section``: that of the first content form of bridge (id, slug, group_name, pos), its slug if that has none, else the default."""
    first = bridge.filter(F.col("group_name") == CONTENT_FORM).groupBy("id").agg(F.min_by("slug", "pos").alias("slug"))
    mapped = F.coalesce(F.create_map(*(F.lit(x) for pair in SECTIONS.items() for x in pair))[F.col("slug")], F.col("slug"), F.lit(DEFAULT_SECTION))
    return items.join(first, "id", "left").withColumn("section", mapped).drop("slug")


def top_per_section(items: DataFrame) -> DataFrame:
    return items.withColumn("_n", F.row_number().over(W.partitionBy("section").orderBy(F.coalesce("ai_score", F.lit(0.0)).desc(), "pos"))).filter("_n = 1").drop("_n")


def filter_by_keywords(papers: DataFrame, keywords: list[str], columns: list[str]) -> DataFrame:
    """Papers with any keyword in any column; all papers if there is none."""
    marked = papers.withColumn("_hit", F.size(keyword_hits(F.concat_ws(" ", *columns), [k.lower() for k in keywords])) > 0)
    any_hit = marked.agg(F.coalesce(F.bool_or("_hit"), F.lit(False)).alias("_any"))
    return marked.crossJoin(F.broadcast(any_hit)).filter("_hit OR NOT _any").drop("_hit", "_any")


def _configured(rows: DataFrame, fields: list[str]) -> DataFrame:
    """One row with the list ``_list`` of all configured rows; a table that is no configuration is an error."""
    if (n := rows.limit(MOST_CONFIGURED + 1).count()) > MOST_CONFIGURED:
        raise ValueError(f"a configured list has at most {MOST_CONFIGURED} rows, this one has {n} or more")
    return F.broadcast(rows.agg(F.collect_list(F.struct(*fields)).alias("_list")))


def _scored_against(interests: DataFrame, listed: DataFrame, score: Callable[[Column], Column], threshold: float) -> DataFrame:
    """(interest_id, key, score) of the entries of the list that reach the threshold; the scores of a row are one expression."""
    low = interests.withColumn("_t", F.lower("text")).withColumn("_w", F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")))
    every = F.transform("_list", lambda s: F.struct(s["key"].alias("key"), score(s).alias("score")))
    return low.crossJoin(listed).select("interest_id", F.explode(F.filter(every, lambda s: s["score"] >= threshold)).alias("s")).select("interest_id", "s.*")


def _hits(terms: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(F.coalesce(terms, F.array()), test))


def interest_match(interests: DataFrame, sources: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(interest_id, key, score) of interests (interest_id, text) and sources (key, keywords, tags, description, pos).

    A keyword of the domain counts 1, a tag or one of its aliases 0.5, a word of at least three letters that the description
    has 0.3, divided by the number of words and at most 1. Of sources with one key the first counts. Sources are a
    configured list of at most MOST_CONFIGURED rows; the list goes to every row, no pair of rows is joined.
    """
    once = sources.withColumn("_n", F.row_number().over(W.partitionBy("key").orderBy("pos"))).filter("_n = 1")
    listed = _configured(once.withColumn("_d", F.split(F.lower("description"), r"\s+")), ["key", "keywords", "tags", "_d"])

    def score(s: Column) -> Column:
        keys = _hits(s["keywords"], lambda k: F.col("_t").contains(F.lower(k)))
        tags = _hits(s["tags"], lambda t: F.exists(t, lambda a: F.col("_t").contains(F.lower(a))))
        words = F.size(F.filter("_w", lambda w: (F.length(w) >= 3) & F.array_contains(s["_d"], w)))
        return F.least(F.lit(1.0), (keys * 10 + tags * 5 + words * 3) / 10.0 / F.greatest(F.lit(1), F.size("_w")))

    return _scored_against(interests, listed, score, threshold)


def domain_match(interests: DataFrame, domains: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(interest_id, key, score) of interests (interest_id, text) and domains (key, keywords, tags: all tags of its sources).

    A keyword that the text contains counts 1, a tag 0.3; the sum is divided by the number of keywords and at most 1.
    """
    listed = _configured(domains, ["key", "keywords", "tags"])

    def score(d: Column) -> Column:
        inside = lambda k: F.col("_t").contains(F.lower(k))
        return F.least(F.lit(1.0), (_hits(d["keywords"], inside) * 10 + _hits(d["tags"], inside) * 3) / 10.0 / F.greatest(F.lit(1), F.size(d["keywords"])))

    return _scored_against(interests, listed, score, threshold)


def sources_of_domains(matched: DataFrame, sources: DataFrame) -> DataFrame:
    """(interest_id, source_key) of matched domains (interest_id, key, score) and their sources (key, source_key), each source once."""
    return matched.join(sources, "key").select("interest_id", "source_key").distinct()
