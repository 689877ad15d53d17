"""How the operators' inputs are read from the given tables, in Spark and, for the oracles, in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The start of the items' clock, in seconds.
START = 1_704_067_200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RATINGS = {
    "source_authority": "doc_id % 3",
    "novelty": "(doc_id * 5 + 1) % 3",
    "technical_substance": "(doc_id * 7) % 3",
    "real_world_impact": "(doc_id * 11 + 2) % 3",
    "community_validation": "doc_id % 2",
    "content_completeness": "(doc_id * 3 + 1) % 2",
    "marketing_penalty": "CASE WHEN doc_id % 5 = 0 THEN -1 ELSE 0 END",
    "duplicate_penalty": "CASE WHEN doc_id % 7 = 0 THEN -2 ELSE 0 END",
    "thin_content_penalty": "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 0 END",
    "weak_relevance_penalty": "CASE WHEN doc_id % 6 = 0 THEN -2 ELSE 0 END",
}
_SUM = " + ".join(f"coalesce({e}, 0)" for e in RATINGS.values())
_EXPRESSIONS = {
    "id": "d.doc_id", "pos": "d.doc_id", "title": r"regexp_extract(d.text, '^([^.\n]*)', 1)", "text": "d.text", "n_chars": "d.n_chars",
    "url": "concat('https://site', cast(d.doc_id % 50 AS VARCHAR(9)), '.example.com/a/', cast(d.doc_id AS VARCHAR(20)))",
    "source_type": "concat('s', cast(d.doc_id % 4 AS VARCHAR(9)))", "category": "CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE d.source END",
    "published_sec": f"{START} + d.doc_id * 3600", "day": "d.doc_id % 10", "ai_relevant": "CASE WHEN d.quality IS NULL THEN NULL ELSE d.quality = 1 END",
    "ai_score": f"CASE WHEN d.doc_id % 17 = 0 THEN NULL WHEN d.quality = 1 THEN cast(greatest(0, least(10, {_SUM.replace('doc_id', 'd.doc_id')})) AS DOUBLE) ELSE cast(0 AS DOUBLE) END",
}
_COLUMNS = ", ".join(f"{e.replace('d.quality', 'l.quality')} AS {c}" for c, e in _EXPRESSIONS.items())
ITEMS = f"items AS (SELECT {_COLUMNS} FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
TAGS = """item_tags AS (SELECT doc_id AS id, tag FROM (SELECT doc_id, unnest(list_distinct(string_split(lower(text), ' '))) AS tag FROM documents) WHERE tag <> '')"""
NEWS_TOPICS = """news_topics AS (SELECT DISTINCT doc_id AS id, topic FROM (SELECT doc_id, doc_id % 25 AS topic FROM documents UNION ALL SELECT doc_id, (doc_id * 7) % 25 FROM documents))"""
URL_ITEMS = """url_items AS (
  SELECT page_id AS pos, page_id AS id, url, 'web' AS source_type, html AS content FROM pages
  UNION ALL
  SELECT page_id + 1000000, page_id + 1000000, concat(CASE WHEN contains(url, '#') THEN split_part(url, '#', 1) ELSE url END,
         CASE WHEN contains(url, '?') THEN '&' ELSE '?' END, 'utm_campaign=x'), 'feed', replace(html, 'e', '') FROM pages WHERE page_id % 3 = 0)"""
THREADS = "threads AS (SELECT conv_id, turn, role, text, length(text) % 100 AS score FROM conversations)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as scored items; labels decide relevance."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    both = d.join(l, "doc_id", "left").alias("d")
    return both.selectExpr(*(f"{e} AS {c}" for c, e in _EXPRESSIONS.items()))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of ten ratings per document, with its relevance."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.select("doc_id").join(l.select("doc_id", "quality"), "doc_id", "left").selectExpr("doc_id AS id", "quality = 1 AS relevant", *(f"cast({e} AS DOUBLE) AS {c}" for c, e in RATINGS.items()))


RATINGS_SQL = "ratings AS (SELECT d.doc_id AS id, l.quality = 1 AS relevant, " + ", ".join(f"({e.replace('doc_id', 'd.doc_id')})::DOUBLE AS {c}" for c, e in RATINGS.items()) + " FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def item_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.selectExpr("doc_id AS id", "explode(array_distinct(split(lower(text), ' '))) AS tag").filter("tag != ''")


def news_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.selectExpr("doc_id AS id", "explode(array_distinct(array(doc_id % 25, (doc_id * 7) % 25))) AS topic")


def url_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, and for every third a copy that a feed links with a tracking parameter."""
    p = table(spark, sf_dir, "pages")
    tracked = "concat(split_part(url, '#', 1), CASE WHEN contains(url, '?') THEN '&' ELSE '?' END, 'utm_campaign=x')"
    first = p.selectExpr("page_id AS pos", "page_id AS id", "url", "'web' AS source_type", "html AS content")
    return first.unionByName(p.filter("page_id % 3 = 0").selectExpr("page_id + 1000000 AS pos", "page_id + 1000000 AS id", f"{tracked} AS url", "'feed' AS source_type", "replace(html, 'e', '') AS content"))


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "role", "text", "cast(length(text) % 100 AS bigint) AS score")
