"""Digest texts and their delivery, one row per text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import pangu

LABELS = {"en": ("Daily Digest", "items selected from", "fetched", "Nothing was selected today.", "Why"), "zh": ("每日精选", "条选自", "条", "今日没有入选内容。", "推荐理由")}


def shown_title(lang: str) -> Column:
    """Square brackets would end a link, so they become round ones; Chinese titles get spaces around Latin words."""
    title = F.translate(F.coalesce(F.nullif(F.col(f"title_{lang}"), F.lit("")), F.col("title")), "[]", "()")
    return pangu(title) if lang == "zh" else title


def shown_score() -> Column:
    return F.when(F.coalesce("ai_score", F.lit(0.0)) == 0, "?").otherwise(F.format_number("ai_score", 1))


def source_line(lang: str) -> Column:
    """Kind, name and date, then a link to a discussion elsewhere."""
    at = F.timestamp_seconds("published_sec")
    when = F.date_format(at, "M月d日 HH:mm") if lang == "zh" else F.date_format(at, "MMM d, HH:mm")
    name = F.coalesce(F.nullif(F.col("feed_name"), F.lit("")), F.nullif(F.col("author"), F.lit("")), F.lit("unknown"))
    line = F.concat_ws(" · ", "source_type", name, when)
    other = F.coalesce(F.col("discussion_url") != F.col("url"), F.lit(False))
    return F.when(other, F.concat(line, F.lit(" · ["), F.lit("讨论" if lang == "zh" else "Discussion"), F.lit("]("), "discussion_url", F.lit(")"))).otherwise(line)


def item_markdown(lang: str, place: Column) -> Column:
    """Anchor, heading, summary, source line and reason of one item."""
    heading = F.concat(F.lit('<a id="item-'), place.cast("string"), F.lit('"></a>\n## ['), shown_title(lang), F.lit("]("), "url", F.lit(") ⭐️ "), shown_score(), F.lit("/10"))
    reason = F.when(F.coalesce("ai_reason", F.lit("")) != "", F.concat(F.lit(f"**{LABELS[lang][4]}**: "), "ai_reason"))
    return F.concat(F.concat_ws("\n\n", heading, F.nullif(F.col("ai_summary"), F.lit("")), source_line(lang), reason), F.lit("\n\n---\n\n"))


def ranked(items: DataFrame) -> DataFrame:
    """Adds place, the order of an item within its day."""
    return items.withColumn("place", F.row_number().over(W.partitionBy("day").orderBy(F.coalesce("ai_score", F.lit(0.0)).desc(), "id")))


def _in_order(column: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("place", column))), lambda x: x[column])


def daily_digest(items: DataFrame, days: DataFrame, lang: str) -> DataFrame:
    """(day, markdown) of each of days (day, total): heading, contents and items of selected, limited items; a day without any says so."""
    title, chosen, fetched, empty, _ = LABELS[lang]
    placed = ranked(items)
    toc = F.concat(F.col("place").cast("string"), F.lit(". ["), shown_title(lang), F.lit("](#item-"), F.col("place").cast("string"), F.lit(") ⭐️ "), shown_score(), F.lit("/10"))
    texts = placed.select("day", "place", toc.alias("toc"), item_markdown(lang, F.col("place")).alias("md"))
    bodies = texts.groupBy("day").agg(F.count("*").alias("n"), F.array_join(_in_order("toc"), "\n").alias("toc"), F.array_join(_in_order("md"), "").alias("body"))
    joined = days.join(bodies, "day", "left")
    head = F.concat(F.lit(f"# {title} - "), F.col("day").cast("string"), F.lit("\n\n> "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(f" {chosen} "), F.col("total").cast("string"), F.lit(f" {fetched}\n\n"))
    return joined.select("day", F.when(F.col("n").isNull(), F.concat(head, F.lit(empty))).otherwise(F.concat(head, F.lit("---\n\n"), "toc", F.lit("\n\n---\n\n"), "body")).alias("markdown"))


def overview(items: DataFrame, lang: str) -> DataFrame:
    """(day, markdown): one numbered line per item."""
    line = F.concat(F.col("place").cast("string"), F.lit(". ["), shown_title(lang), F.lit("]("), "url", F.lit(") ⭐️ "), shown_score(), F.lit("/10"))
    return ranked(items).withColumn("line", line).groupBy("day").agg(F.array_join(_in_order("line"), "\n").alias("markdown"))


def delivery_messages(items: DataFrame, mode: str, languages: list[str], wanted: list[str] | None = None, overview_last: bool = False) -> DataFrame:
    """(day, lang, at, kind, title) of the messages of each day: one summary, or an overview and its items, which come backwards before a closing overview."""
    langs = [x for x in languages if not wanted or x in wanted]
    spoken = items.sparkSession.createDataFrame([(x,) for x in langs], "lang string")
    days = items.select("day").distinct().crossJoin(F.broadcast(spoken))
    if mode != "summary_and_items":
        return days.select("day", "lang", F.lit(0).cast("long").alias("at"), F.lit("summary").alias("kind"), F.lit("").alias("title"))
    each = ranked(items).withColumn("n", F.count("*").over(W.partitionBy("day"))).crossJoin(F.broadcast(spoken))
    at = F.col("n") - F.col("place") if overview_last else F.col("place")
    name = F.concat(F.col("place").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" "), "title")
    lines = each.select("day", "lang", at.cast("long").alias("at"), F.lit("item").alias("kind"), name.alias("title"))
    counted = items.groupBy("day").agg(F.count("*").alias("n"))
    first = days.join(counted, "day").select("day", "lang", (F.col("n") if overview_last else F.lit(0)).cast("long").alias("at"), F.lit("overview").alias("kind"), F.lit("").alias("title"))
    return lines.unionByName(first)


def post_front_matter(markdown: Column, title: Column, day: Column, lang: Column) -> Column:
    """Metadata in place of the leading heading."""
    body = F.regexp_replace(markdown, r"^# [^\n]*\n+", "")
    return F.concat(F.lit("---\nlayout: post\ntitle: \""), title, F.lit('"\ndate: '), day, F.lit("\nlang: "), lang, F.lit("\n---\n\n"), body)


def subscriber_fanout(digests: DataFrame, subscribers: DataFrame) -> DataFrame:
    """One row per digest and subscriber; the digests of a day are few, so they are what is sent to all tasks."""
    return subscribers.crossJoin(F.broadcast(digests))
