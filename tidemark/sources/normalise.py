"""Landed payloads of connectors as items."""

from __future__ import annotations

import html
import json
import logging
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import strip_tags
from tidemark.operators.linking import extract_arxiv_id, reconstruct_abstract

log = logging.getLogger(__name__)


def union_sources(sources: list[Callable[[], DataFrame]]) -> DataFrame:
    """All rows of the sources that can be read, columns by name; a source that fails to resolve is skipped and logged."""
    found = []
    for source in sources:
        try:
            found.append(source())
        except AnalysisException as error:
            log.warning("a source was skipped: %s", error)
    if not found:
        raise ValueError("no source could be read")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


#: Column of rows that a reader could not parse.
BROKEN = "_corrupt_record"


def land_sources(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], path: str, at_once: int = 4) -> tuple[DataFrame, DataFrame]:
    """(rows, status): every source lands in a job and a folder of its own, and a source that fails at any time costs only itself.

    rows are those of all sources that landed, columns by name; status has source, status (landed or failed), rows,
    quarantined and error. Rows whose BROKEN column is not null are quarantined under path/quarantine/<source>; that column
    is dropped from the rest. ``at_once`` sources run at a time. A folder counts only if its job has committed, and ``path``
    must be new. If no source lands, rows has no columns.
    """

    def land(name: str) -> tuple:
        try:
            rows = sources[name]()
            out, bad = f"{path}/landed/{name}", f"{path}/quarantine/{name}"
            watched = BROKEN in rows.columns
            if watched:
                # Kept as they were parsed: a reader may not be asked for broken rows alone.
                rows.write.parquet(f"{path}/parsed/{name}")
                parsed = spark.read.schema(rows.schema).parquet(f"{path}/parsed/{name}")
                parsed.filter(F.col(BROKEN).isNotNull()).write.parquet(bad)
                rows = parsed.filter(F.col(BROKEN).isNull()).drop(BROKEN)
            rows.write.parquet(out)
            landed = spark.read.schema(rows.schema).parquet(out)
            broken = spark.read.parquet(bad).count() if watched else 0
            return name, "landed", landed.count(), broken, None, landed
        except Exception as error:  # whatever a source's reader or its data raises
            log.warning("source %s failed: %s", name, error)
            return name, "failed", 0, 0, str(error).splitlines()[0][:500], None

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        ended = list(pool.map(inheritable_thread_target(spark)(land), sources))
    status = spark.createDataFrame([e[:5] for e in ended], "source string, status string, rows long, quarantined long, error string")
    landed = [e[5] for e in ended if e[5] is not None]
    return (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), landed) if landed else spark.range(0).select()), status


COMMENTS = "--- Top Comments ---"


def shortened(text: Column, most: int) -> Column:
    """A text over ``most`` characters is cut and ends in three dots."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def _with_comments(first: Column, lines: Column) -> Column:
    """The text, then the comment mark and the lines, in paragraphs; empty parts are left out."""
    marked = F.when(F.size(lines) > 0, F.concat(F.array(F.lit("\n" + COMMENTS)), lines)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array_compact(F.array(F.nullif(first, F.lit("")))), marked), "\n\n")


def _lines_of(comments: DataFrame, key: str, order: list[Column], line: Column) -> DataFrame:
    return comments.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda c: c["line"]).alias("lines"))


def hn_items(stories: DataFrame, comments: DataFrame, since: int, min_score: int, kids: int = 5) -> DataFrame:
    """Stories (id, title, url, author, sec, score, text, kids) with the first kids' comments (id, author, text, deleted, dead).

    The kids are counted before deleted, dead and empty ones go.
    """
    kept = stories.filter((F.col("score") >= min_score) & (F.col("sec") >= since))
    wanted = kept.select(F.col("id").alias("story"), F.posexplode(F.slice("kids", 1, kids)).alias("at", "kid"))
    alive = comments.filter(~F.coalesce("deleted", F.lit(False)) & ~F.coalesce("dead", F.lit(False)) & (F.coalesce("text", F.lit("")) != ""))
    line = F.concat(F.lit("["), F.coalesce("author", F.lit("anon")), F.lit("]: "), shortened(strip_tags(F.col("text")), 500))
    lines = _lines_of(wanted.join(alive, wanted["kid"] == alive["id"]), "story", [F.col("at")], line)
    joined = kept.join(lines, kept["id"] == lines["story"], "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))
    page = F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("id").cast("string"))
    return joined.select(F.concat(F.lit("hackernews:story:"), F.col("id").cast("string")).alias("id"), "title", F.coalesce("url", page).alias("url"), _with_comments(strip_tags(F.coalesce("text", F.lit(""))), F.col("lines")).alias("content"), "sec", "score", F.size("lines").alias("comment_count"))


def reddit_items(posts: DataFrame, comments: DataFrame, since: int, min_score: int, k: int) -> DataFrame:
    """Posts (id, title, is_self, permalink, url, sec, score, text) with their k best comments (post, pos, author, text, score, distinguished)."""
    kept = posts.filter((F.col("score") >= min_score) & (F.col("sec") >= since))
    plain = comments.filter(~F.coalesce(F.col("distinguished") == "moderator", F.lit(False)))
    best = plain.withColumn("n", F.row_number().over(W.partitionBy("post").orderBy(F.desc("score"), "pos"))).filter(F.col("n") <= k)
    line = F.concat(F.lit("["), F.coalesce("author", F.lit("anon")), F.lit(" ("), F.col("score").cast("string"), F.lit(" pts)]: "), shortened(F.trim("text"), 500))
    lines = _lines_of(best, "post", [F.col("n")], line)
    joined = kept.join(lines, kept["id"] == lines["post"], "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))
    discussion = F.concat(F.lit("https://www.reddit.com"), F.col("permalink"))
    url = F.when(F.col("is_self"), discussion).otherwise(F.coalesce("url", discussion))
    return joined.select("id", "title", url.alias("url"), _with_comments(shortened(F.coalesce("text", F.lit("")), 1500), F.col("lines")).alias("content"), "sec", "score")


def github_event_items(events: DataFrame, since: int) -> DataFrame:
    """Events (id, kind, sec, user, repo, ref_type, description, tag, body, html_url, messages) of the five kinds that say something."""
    name = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    user, repo = F.col("user"), F.col("repo")
    title = (
        F.when(F.col("kind") == "PushEvent", name(user, " pushed ", F.coalesce(F.size("messages"), F.lit(0)).cast("string"), " commit(s) to ", repo))
        .when(F.col("kind") == "CreateEvent", name(user, " created ", F.coalesce("ref_type", F.lit("repository")), " in ", repo))
        .when(F.col("kind") == "ReleaseEvent", name(user, " released ", F.coalesce("tag", F.lit("")), " in ", repo))
        .when(F.col("kind") == "PublicEvent", name(user, " made ", repo, " public"))
        .when(F.col("kind") == "WatchEvent", name(user, " starred ", repo))
    )
    content = F.when(F.col("kind") == "PushEvent", F.array_join(F.slice("messages", 1, 3), "\n")).when(F.col("kind") == "CreateEvent", F.col("description")).when(F.col("kind") == "ReleaseEvent", F.col("body")).otherwise("")
    page = F.concat(F.lit("https://github.com/"), repo)
    url = F.when(F.col("kind") == "ReleaseEvent", F.coalesce("html_url", page)).otherwise(page)
    return events.filter(F.col("sec") >= since).select(F.concat(F.lit("github:event:"), F.col("id").cast("string")).alias("id"), title.alias("title"), url.alias("url"), F.coalesce(content, F.lit("")).alias("content"), "sec").filter("title IS NOT NULL")


def github_release_items(releases: DataFrame, since: int) -> DataFrame:
    title = F.concat("repo", F.lit(" "), F.col("tag"), F.when(F.col("prerelease"), " (pre-release)").otherwise(""))
    return releases.filter(F.col("sec") >= since).select(F.concat(F.lit("github:release:"), F.col("id").cast("string")).alias("id"), title.alias("title"), F.col("html_url").alias("url"), F.coalesce("body", F.lit("")).alias("content"), "sec")


def reply_lines(replies: DataFrame, tweets: DataFrame, min_likes: int, k: int) -> DataFrame:
    """(tweet_id, lines) of the k best replies (conversation_id, id, pos, handle, text, likes, replies) to tweets (tweet_id, conversation_id, author).

    The tweet itself, its author's own replies and empty ones do not count; likes count twice, replies once.
    """
    both = replies.join(tweets, "conversation_id").filter((F.col("id") != F.col("tweet_id")) & (F.lower("handle") != F.lower("author")) & (F.trim("text") != "") & (F.col("likes") >= min_likes))
    ranked = both.withColumn("n", F.row_number().over(W.partitionBy("tweet_id").orderBy(F.desc(2 * F.col("likes") + F.col("replies")), "pos"))).filter(F.col("n") <= k)
    line = F.concat(F.lit("[@"), "handle", F.lit(" | ❤️ "), F.col("likes").cast("string"), F.lit(" | 💬 "), F.col("replies").cast("string"), F.lit("] "), F.substring(F.trim("text"), 1, 280))
    return _lines_of(ranked, "tweet_id", [F.col("n")], line)


def append_discussion(content: Column, block: Column) -> Column:
    """The block under the comment mark; a block that is there already is not added again."""
    body = F.coalesce(content, F.lit(""))
    added = F.when(body.contains(COMMENTS), F.when(body.contains(block), body).otherwise(F.concat(body, F.lit("\n"), block))).when(body == "", F.concat(F.lit(f"{COMMENTS}\n"), block)).otherwise(F.concat(body, F.lit(f"\n\n{COMMENTS}\n"), block))
    return F.when(F.coalesce(block, F.lit("")) == "", content).otherwise(added)


def feed_items(entries: DataFrame, since: int, name: str) -> DataFrame:
    """Feed entries (entry_id, title, link, author, published, updated, encoded, summary) with a date of any of their fields or of the link.

    Dates are RFC 822 or ISO text; a link's /YYYY/MM/DD/ is the last resort. Content is the encoded text, then the summary.
    """
    # The day of the month says all that the name of the day does.
    when = lambda c: F.coalesce(F.try_to_timestamp(F.regexp_replace(c, r"^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(c))
    linked = F.try_to_timestamp(F.nullif(F.regexp_extract("link", r"/(\d{4}/\d{2}/\d{2})/", 1), F.lit("")), F.lit("yyyy/MM/dd"))
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    content = F.coalesce(some("encoded"), some("summary"), F.lit(""))
    native = F.substring(F.sha2(F.coalesce(some("entry_id"), F.col("link")), 256), 1, 16)
    quality = F.when(F.length(F.trim(content)) >= 1000, "high").when(F.trim(content) != "", "low").otherwise("none")
    dated = entries.withColumn("sec", F.unix_seconds(F.coalesce(when(F.col("published")), when(F.col("updated")), linked)))
    return dated.filter(F.col("sec") >= since).select(F.concat(F.lit(f"rss:{name}:"), native).alias("id"), F.coalesce("title", F.lit("Untitled")).alias("title"), F.col("link").alias("url"), content.alias("content"), F.coalesce(some("author"), F.lit(name)).alias("author"), quality.alias("quality"), "sec")


def read_feed(spark, path: str, row_tag: str = "item") -> DataFrame:
    """Landed feed files as rows, one per element; the schema is given, not inferred."""
    return spark.read.format("xml").option("rowTag", row_tag).schema("guid string, title string, link string, author string, pubDate string, updated string, `content:encoded` string, description string").load(path)


def first_entries(entries: DataFrame, n: int) -> DataFrame:
    """The first n entries by pos of each feed, before any other filter."""
    return entries.withColumn("_n", F.row_number().over(W.partitionBy("feed").orderBy("pos"))).filter(F.col("_n") <= n).drop("_n")


def message_title(text: Column, most: int = 80) -> Column:
    """The first paragraph if it is short, else cut after the first full stop of CJK text within reach, else at the limit."""
    first = F.trim(F.split_part(text, F.lit("\n"), F.lit(1)))
    stop = F.regexp_extract(F.substring(first, 1, most), "^(.*?[。！？])", 1)
    return F.when(F.length(first) <= most, first).when(stop != "", stop).otherwise(F.substring(first, 1, most))


def telegram_items(messages: DataFrame, since: int, fetch_limit: int) -> DataFrame:
    """The last messages (channel, pos, message_id, text, sec, links) of each channel; the first link elsewhere is the URL."""
    last = messages.withColumn("_n", F.row_number().over(W.partitionBy("channel").orderBy(F.desc("pos")))).filter((F.col("_n") <= fetch_limit) & (F.col("sec") >= since))
    outside = F.get(F.filter("links", lambda u: u.rlike("^https?://") & ~u.rlike(r"^https?://(t\.me|telegram\.org)(/|$)")), F.lit(0))
    own = F.concat(F.lit("https://t.me/"), "channel", F.lit("/"), F.col("message_id").cast("string"))
    return last.select(F.concat(F.lit("telegram:"), "channel", F.lit(":"), F.col("message_id").cast("string")).alias("id"), message_title(F.col("text")).alias("title"), F.coalesce(outside, own).alias("url"), "sec")


def tweet_items(tweets: DataFrame, since: int) -> DataFrame:
    """Tweets (id, id_str, created_at, full_text, text, screen_name, handle, name, url, permalink) as items."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    # Java's EEE parsing needs no weekday; it is cut off.
    legacy = F.try_to_timestamp(F.substring("created_at", F.lit(5), F.length("created_at")), F.lit("MMM dd HH:mm:ss Z yyyy"))
    sec = F.unix_seconds(F.coalesce(legacy, F.try_to_timestamp("created_at")))
    number = F.when(F.col("id").startswith("tweet-"), F.substring("id", F.lit(7), F.length("id"))).otherwise(F.coalesce(some("id_str"), F.col("id")))
    text, who = F.coalesce(some("full_text"), some("text")), F.coalesce(some("screen_name"), some("handle"), F.lit("unknown"))
    made = tweets.withColumns({"sec": sec, "number": number, "body": text, "who": who}).filter((F.col("sec") >= since) & F.col("body").isNotNull() & (F.coalesce("number", F.lit("")) != ""))
    status = F.concat(F.lit("https://twitter.com/"), "who", F.lit("/status/"), F.coalesce(some("id_str"), F.col("id")))
    linked = F.when(some("permalink").isNotNull() & (F.col("who") != "unknown"), F.concat(F.lit("https://twitter.com/"), "who", "permalink"))
    title = F.concat(F.lit("@"), "who", F.lit(": "), F.trim(F.translate(F.substring("body", 1, 50), "\n", " ")), F.when(F.length("body") > 50, "...").otherwise(""))
    return made.select(F.concat(F.lit("twitter:tweet:"), "number").alias("id"), title.alias("title"), F.coalesce(some("url"), linked, status).alias("url"), F.col("body").alias("content"), F.coalesce(some("name"), F.col("who")).alias("author"), "sec")


def gdelt_items(articles: DataFrame) -> DataFrame:
    """Articles (url, title, seendate, domain) that have an address, a title and a date in the compact form."""
    sec = F.unix_seconds(F.try_to_timestamp(F.trim("seendate"), F.lit("yyyyMMdd'T'HHmmss'Z'")))
    kept = articles.withColumn("sec", sec).filter((F.trim("url") != "") & (F.trim("title") != "") & F.col("sec").isNotNull())
    return kept.select(F.concat(F.lit("gdelt:article:"), F.trim("seendate"), F.lit("::"), F.trim("url")).alias("id"), F.trim("title").alias("title"), F.trim("url").alias("url"), "domain", "sec")


def ossinsight_items(rows: DataFrame, min_stars: int, keywords: list[str], max_items: int, period: str) -> DataFrame:
    """Trending repositories (pos, repo_id, repo_name, stars text, description, collections): the first row per repository, most stars first."""
    stars = F.coalesce(F.col("stars").try_cast("int"), F.lit(0))
    once = rows.withColumn("n", F.row_number().over(W.partitionBy("repo_id").orderBy("pos"))).filter("n = 1 AND repo_name IS NOT NULL").withColumn("gained", stars)
    text, hit = F.lower(F.concat_ws(" ", F.coalesce("description", F.lit("")), F.coalesce("collections", F.lit("")), "repo_name")), F.lit(not keywords)
    for k in keywords:
        hit = hit | text.contains(k.lower())
    wanted = once.filter(hit & ((F.col("gained") >= min_stars) | F.lit(min_stars == 0)))
    title = F.concat("repo_name", F.lit(" (+"), F.col("gained").cast("string"), F.lit(f"⭐ {period})"))
    return wanted.orderBy(F.desc("gained"), "pos").limit(max_items).select(F.concat(F.lit("ossinsight:trending:"), F.col("repo_id").cast("string")).alias("id"), title.alias("title"), "gained")


def openbb_items(news: DataFrame, watchlists: DataFrame, since: int) -> DataFrame:
    """News (watchlist, pos, url, title, sec, symbols text) later than since, the first per address; symbols default to the watchlist's."""
    kept = news.filter((F.coalesce("url", F.lit("")) != "") & (F.col("sec") > since) & (F.trim("title") != ""))
    once = kept.withColumn("n", F.row_number().over(W.partitionBy("url").orderBy("pos"))).filter("n = 1").join(F.broadcast(watchlists.withColumnRenamed("symbols", "defaults")), "watchlist")
    own = F.array_distinct(F.filter(F.transform(F.split(F.coalesce("symbols", F.lit("")), ","), lambda s: F.upper(F.trim(s))), lambda s: s != ""))
    return once.select("url", F.trim("title").alias("title"), "sec", "watchlist", F.when(F.size(own) > 0, own).otherwise(F.col("defaults")).alias("symbols"))


def any_date(text: Column) -> Column:
    """Dates in ISO, slashed, dotted and CJK forms; null if none fits."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "yyyy年M月d日", "MMM d, yyyy"))).cast("date")


def dated_news(articles: DataFrame, since: str, now: str) -> DataFrame:
    """Articles (url, title, date_text) from ``since`` on; undated ones count as of ``now``. Ids are 12 digits of the address's MD5."""
    day = F.coalesce(any_date(F.col("date_text")), F.lit(now).cast("date"))
    return articles.withColumn("day", day).filter(F.col("day") >= F.lit(since).cast("date")).select(F.substring(F.md5("url"), 1, 12).alias("id"), "url", "title", F.date_format("day", "yyyy-MM-dd").alias("day"))


def embedded_json_items(pages: DataFrame, pattern: str, schema: str, since: int, limit: int) -> DataFrame:
    """Items (page_id, place, title, sec) of a JSON array in a page's script; Chinese titles come first, dates are epoch milliseconds."""
    raw = F.regexp_extract("html", pattern, 1)
    rows = pages.select("page_id", F.posexplode(F.from_json(raw, schema)).alias("place", "e"))
    made = rows.select("page_id", "place", F.coalesce(F.nullif("e.title_zh", F.lit("")), "e.title_en").alias("title"), F.expr("e.ms div 1000").alias("sec")).filter(F.col("sec") >= since)
    return made.withColumn("_n", F.row_number().over(W.partitionBy("page_id").orderBy("place"))).filter(F.col("_n") <= limit).drop("_n")


@dataclass(frozen=True)
class Rules:
    """How records are cut out of pages: a pattern for a record, and one per field, each with one group."""

    record: str
    fields: dict[str, str]


def extract_records(pages: DataFrame, rules: Rules, key: str = "page_id") -> DataFrame:
    """One row per record of each page: key, place and the fields as plain text, empty where a pattern does not match."""
    record, fields = re.compile(rules.record, re.S), {name: re.compile(p, re.S) for name, p in rules.fields.items()}

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for page, source in zip(batch[key], batch["html"], strict=True):
                for place, m in enumerate(record.finditer(source or "")):
                    hits = [p.search(m[0]) for p in fields.values()]
                    found.append((page, place, *(" ".join(html.unescape(re.sub(r"<[^>]+>", " ", h[1])).split()) if h else "" for h in hits)))
            yield pd.DataFrame(found, columns=[key, "place", *fields])

    return pages.select(key, "html").mapInPandas(cut, f"{key} long, place int, " + ", ".join(f"`{f}` string" for f in fields))


def tweets_in_json(payloads: DataFrame, since: int, limit: int) -> DataFrame:
    """Distinct tweets (user, id, text, sec) anywhere in nested JSON (user, pos, payload), at most ``limit`` per user by pos."""

    def walk(node, found: list) -> None:
        if isinstance(node, dict):
            legacy = node.get("legacy")
            if node.get("rest_id") and isinstance(legacy, dict):
                found.append((str(node["rest_id"]), str(legacy.get("full_text") or ""), int(legacy.get("sec") or 0)))
            for child in node.values():
                walk(child, found)
        elif isinstance(node, list):
            for child in node:
                walk(child, found)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for user, pos, payload in zip(batch["user"], batch["pos"], batch["payload"], strict=True):
                try:
                    walk(json.loads(payload or "null"), found := [])
                except ValueError:
                    continue
                rows += [(user, pos, at, *x) for at, x in enumerate(found)]
            yield pd.DataFrame(rows, columns=["user", "pos", "at", "id", "text", "sec"])

    every = payloads.select("user", "pos", "payload").mapInPandas(read, "user long, pos long, at int, id string, text string, sec long")
    once = every.filter(F.col("sec") >= since).groupBy("user", "id").agg(F.min_by(F.struct("text", "sec", "pos", "at"), F.struct("pos", "at")).alias("t")).select("user", "id", "t.*")
    return once.withColumn("_n", F.row_number().over(W.partitionBy("user").orderBy("pos", "at"))).filter(F.col("_n") <= limit).select("user", "id", "text", "sec")


def capped_by_group(rows: DataFrame, group: str, cutoff: Column, cap: int, key: str) -> DataFrame:
    """Rows from the cutoff on, the first ``cap`` by pos of each group, and of those with one key the first."""
    kept = rows.filter(cutoff).withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy("pos"))).filter(F.col("_n") <= cap)
    return kept.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("pos"))).filter("_n = 1").drop("_n")


WORK = "id string, display_name string, publication_year int, publication_date string, doi string, cited_by_count int, is_retracted boolean, authorships array<struct<author: struct<display_name: string>>>, primary_location struct<pdf_url: string, landing_page_url: string, source: struct<display_name: string>>, topics array<struct<display_name: string>>, abstract_inverted_index map<string, array<int>>"


def catalogue_papers(works: DataFrame) -> DataFrame:
    """Catalogue works (column json) as papers; those without id, title or date are left out."""
    w = works.select(F.from_json("json", WORK).alias("w")).select("w.*")
    native = F.element_at(F.split("id", "/"), -1)
    names = lambda c, get: F.filter(F.transform(F.coalesce(c, F.array()), get), lambda x: x.isNotNull())
    made = w.withColumn("published", F.col("publication_date").try_cast("date")).filter((F.coalesce("id", F.lit("")) != "") & (F.trim("display_name") != "") & F.col("published").isNotNull())
    return made.select(
        F.concat(F.lit("openalex:"), native).alias("id"), F.trim("display_name").alias("title"), names(F.col("authorships"), lambda a: a["author"]["display_name"]).alias("authors"), reconstruct_abstract(F.col("abstract_inverted_index")).alias("abstract"),
        "publication_year", F.date_format("published", "yyyy-MM-dd").alias("published"), "doi", F.col("cited_by_count").alias("citations"), extract_arxiv_id(F.col("doi"), F.col("primary_location.landing_page_url")).alias("arxiv_id"), names(F.col("topics"), lambda t: t["display_name"]).alias("categories"),
    )


def daily_papers(rows: DataFrame) -> DataFrame:
    """Community papers (native_id, title, summary, published, upvotes) with all that is required."""
    kept = rows.filter((F.coalesce("native_id", F.lit("")) != "") & (F.trim("title") != "") & F.col("published").isNotNull())
    return kept.select(F.concat(F.lit("huggingface:"), "native_id").alias("id"), F.trim("title").alias("title"), F.trim(F.coalesce("summary", F.lit(""))).alias("abstract"), F.concat(F.lit("https://arxiv.org/pdf/"), "native_id").alias("pdf_url"), "published", "upvotes")


ATOM_ENTRY = (
    "id string, title string, summary string, published string, author array<struct<name: string>>, link array<struct<_title: string, _href: string>>, category array<struct<_term: string>>, "
    "`arxiv:journal_ref` string, `arxiv:comment` string, `arxiv:primary_category` struct<_term: string>"
)


def read_atom(spark, path: str) -> DataFrame:
    """Landed Atom files as one row per entry; the schema is given, not inferred."""
    return spark.read.format("xml").option("rowTag", "entry").schema(ATOM_ENTRY).load(path)


def atom_entries(rows: DataFrame, column: str = "xml") -> DataFrame:
    """The other columns of rows and the fields of the Atom entry in ``column``; text that is no entry has null fields."""
    return rows.select(*(c for c in rows.columns if c != column), F.from_xml(F.col(column), ATOM_ENTRY).alias("_e")).select(*(c for c in rows.columns if c != column), "_e.*")


def arxiv_records(entries: DataFrame) -> DataFrame:
    """Atom entries (see ATOM_ENTRY) as partial records; the identifier loses its version. The PDF is the link of that title, else made of the identifier."""
    some = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    arxiv_id = F.nullif(F.regexp_extract("id", r"abs/(\S+?)(v\d+)?\s*$", 1), F.lit(""))
    year = F.nullif(F.regexp_extract("published", r"^\s*(\d{4})", 1), F.lit("")).cast("int")
    linked = F.get(F.filter("link", lambda x: x["_title"] == "pdf"), F.lit(0))["_href"]
    return entries.withColumn("_aid", arxiv_id).select(
        F.col("_aid").alias("arxiv_id"), some(F.col("title")).alias("title"), F.filter(F.transform(F.coalesce("author", F.array()), lambda a: some(a["name"])), lambda x: x.isNotNull()).alias("authors"), some(F.col("summary")).alias("abstract"), year.alias("year"),
        F.coalesce(linked, F.concat(F.lit("https://arxiv.org/pdf/"), "_aid")).alias("pdf_url"), F.when(F.col("_aid").isNotNull(), "arXiv").alias("venue"), some(F.col("`arxiv:journal_ref`")).alias("journal"), some(F.col("`arxiv:comment`")).alias("comment"),
        F.filter(F.transform(F.coalesce("category", F.array()), lambda c: c["_term"]), lambda x: x.isNotNull() & (x != "")).alias("categories"), F.col("`arxiv:primary_category`._term").alias("primary_category"),
    )


def semantic_scholar_records(rows: DataFrame) -> DataFrame:
    """Graph answers (id, column json) as partial records; authors without a name are left out, an empty venue is none."""
    kind = (
        "paperId string, title string, abstract string, year int, venue string, citationCount long, externalIds struct<DOI: string, ArXiv: string>, "
        "authors array<struct<name: string>>, openAccessPdf struct<url: string>"
    )
    r = rows.select("id", F.from_json("json", kind).alias("r"))
    names = F.filter(F.transform(F.coalesce("r.authors", F.array()), lambda a: a["name"]), lambda x: F.coalesce(x, F.lit("")) != "")
    return r.select(
        "id", "r.title", names.alias("authors"), "r.abstract", "r.year", F.col("r.externalIds.DOI").alias("doi"), F.col("r.externalIds.ArXiv").alias("arxiv_id"), F.col("r.paperId").alias("semantic_scholar_id"),
        F.col("r.openAccessPdf.url").alias("pdf_url"), F.nullif("r.venue", F.lit("")).alias("venue"), F.col("r.citationCount").alias("citation_count"),
    )


def crossref_records(rows: DataFrame) -> DataFrame:
    """Registry answers (column json) as partial records."""
    kind = "DOI string, title array<string>, `container-title` array<string>, author array<struct<given: string, family: string>>, URL string"
    r = rows.select("id", F.from_json("json", kind).alias("r"))
    authors = F.transform("r.author", lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"])))
    return r.select("id", F.get("r.title", F.lit(0)).alias("title"), F.get("r.container-title", F.lit(0)).alias("journal_ref"), F.col("r.DOI").alias("doi"), authors.alias("authors"), F.col("r.URL").alias("url"))


def report_records(rows: DataFrame, source: str) -> DataFrame:
    """Report answers (native_id, title, category text, pdf, html, sec) as reports; categories are split, a missing file gives no file list."""
    split = F.filter(F.transform(F.split(F.coalesce("category", F.lit("")), "[,，、]"), lambda c: F.trim(c)), lambda c: c != "")
    pdfs = F.array_compact(F.array(F.when(F.coalesce("pdf", F.lit("")) != "", F.struct(F.lit("report.pdf").alias("name"), F.col("pdf").alias("url")))))
    return rows.select(F.concat(F.lit(f"{source}:"), F.col("native_id").cast("string")).alias("id"), F.trim("title").alias("title"), split.alias("categories"), pdfs.alias("pdf_urls"), strip_tags(F.col("html")).alias("content_text"), "sec")
