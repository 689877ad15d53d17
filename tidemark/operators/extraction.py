"""Article extraction over landed pages: gates in native expressions first, parsing after them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import html as H
from tidemark.functions.urls import looks_like_icon, skip_reason

LEAST_HTML, LEAST_TEXT, MOST_IMAGES = 500, 200, 20


def per_row(df: DataFrame, column: str, out: str, function: Callable[[str | None], str], kind: str = "string") -> DataFrame:
    """Adds ``out``, a Python function of one column. Workers hold a hundred rows at a time; an Arrow batch would be 10,000 pages."""
    return df.withColumn(out, F.udf(function, kind, useArrow=False)(F.col(column)))


def strip_boilerplate_containers(pages: DataFrame) -> DataFrame:
    return per_row(pages, "html", "stripped", lambda t: H.serialise(H.strip_containers(H.parse(t))))


def sanitize_html(pages: DataFrame) -> DataFrame:
    return per_row(pages, "html", "safe_html", H.sanitize)


def structured_html(pages: DataFrame) -> DataFrame:
    return per_row(pages, "html", "structured", H.structured)


def gate(url: Column, http_status: Column, content_type: Column, html: Column, rss_quality: Column) -> Column:
    """Why a page is not parsed, or null."""
    return (
        F.when(rss_quality == "high", "rss_high_quality")
        .when(skip_reason(url).isNotNull(), skip_reason(url))
        .when(http_status != 200, F.concat(F.lit("http_"), http_status.cast("string")))
        .when(~F.coalesce(F.lower(content_type).contains("html"), F.lit(False)), "not_html")
        .when(F.length(F.coalesce(html, F.lit(""))) < LEAST_HTML, "html_too_short")
    )


def extract_article(pages: DataFrame) -> DataFrame:
    """Adds article, status (success, skipped or failed) and error. Only pages that pass the native gates reach the parser."""
    gated = pages.withColumn("error", gate(F.col("url"), F.col("http_status"), F.col("content_type"), F.col("html"), F.col("rss_quality")))
    parsed = per_row(gated.withColumn("_html", F.when(F.col("error").isNull(), F.col("html"))), "_html", "article", lambda t: H.article_text(t) if t else "")
    short = F.col("error").isNull() & (F.length("article") < LEAST_TEXT)
    error = F.when(short, "text_too_short").otherwise(F.col("error"))
    skipped = F.coalesce(F.col("error").rlike("^(rss_high_quality|skip_)"), F.lit(False))
    status = F.when(error.isNull(), "success").when(skipped, "skipped").otherwise("failed")
    return parsed.withColumn("error", error).withColumn("status", status).withColumn("article", F.when(F.col("status") == "success", F.col("article"))).drop("_html")


def extraction_route(mode: Column) -> Column:
    """skip uses the summary, browser renders, all else fetches."""
    return F.when(mode == "skip", "summary").when(mode == "browser", "browser").otherwise("http")


def extraction_stats(items: DataFrame, label: str = "label", status: str = "status") -> DataFrame:
    """Per label: total, extracted, skipped and the skipped share."""
    found = items.groupBy(label).agg(F.count("*").alias("total"), F.count_if(F.col(status) == "success").alias("extracted"), F.count_if(F.col(status) == "skipped").alias("skipped"))
    return found.withColumn("skip_ratio", F.round(F.col("skipped") / F.col("total"), 4))


def extract_images(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, place, image_url, caption, is_cover): distinct pictures in order, at most MOST_IMAGES; the page's preview or else the first that is no icon is the cover."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [(k, *x) for k, url, source in zip(rows[key], rows["url"], rows["html"], strict=True) for x in H.images(source, url or "")]
            yield pd.DataFrame(found, columns=[key, "place", "image_url", "caption"])

    every = pages.select(key, "url", "html").mapInPandas(find, f"{key} long, place int, image_url string, caption string")
    first = every.withColumn("_n", F.row_number().over(W.partitionBy(key, "image_url").orderBy("place"))).filter("_n = 1")
    kept = first.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("place"))).filter(F.col("_n") <= MOST_IMAGES)
    cover = F.min(F.when((F.col("place") == -1) | ~looks_like_icon(F.col("image_url")), F.col("place"))).over(W.partitionBy(key))
    return kept.withColumn("is_cover", F.coalesce(F.col("place") == cover, F.lit(False))).drop("_n")


def apply_translations(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, translated, status) of blocks (doc_id, batch, at, text) and answers (doc_id, batch, texts): all or nothing per document."""
    counted = blocks.groupBy("doc_id", "batch").agg(F.count("*").alias("n"), F.sum(F.regexp_count("text", F.lit("<img"))).alias("images"))
    pictures = F.aggregate(F.transform("texts", lambda t: F.regexp_count(t, F.lit("<img"))), F.lit(0), lambda a, b: a + b)
    joined = counted.join(answers, ["doc_id", "batch"], "left").withColumn("ok", F.coalesce((F.size("texts") == F.col("n")) & (pictures == F.col("images")), F.lit(False)))
    whole = joined.groupBy("doc_id").agg(F.bool_and("ok").alias("ok"), F.array_sort(F.collect_list(F.struct("batch", "texts"))).alias("parts"))
    text = F.array_join(F.flatten(F.transform("parts", lambda p: p["texts"])), "\n")
    return whole.select("doc_id", F.when(F.col("ok"), text).alias("translated"), F.when(F.col("ok"), "translated").otherwise("failed").alias("status"))
