"""Queries of the normalisers over landed rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tidemark.operators import sinks as K
from tidemark.plans.bindings import START, table, threads
from tidemark.registry import query
from tidemark.sources import landed
from tidemark.sources import normalise as N


def _short(e: str, n: int) -> str:
    return f"CASE WHEN length({e}) > {n} THEN substr({e}, 1, {n - 3}) || '...' ELSE {e} END"


def _stripped(e: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({e}, '<[^>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))"


_JOIN = "CASE WHEN lines IS NULL THEN {first} ELSE CASE WHEN {first} = '' THEN '' ELSE {first} || chr(10) || chr(10) END || chr(10) || '--- Top Comments ---' || chr(10) || chr(10) || lines END"
_THREADS = "t AS (SELECT conv_id, turn, role, text, length(text) % 100 AS score FROM conversations)"


@query(f"""WITH {_THREADS}, s AS (SELECT * FROM t WHERE turn = 0 AND score >= 20),
c AS (SELECT conv_id, string_agg('[' || role || ']: ' || {_short(_stripped('text'), 500)}, chr(10) || chr(10) ORDER BY turn) AS lines, count(*) AS n FROM t WHERE turn BETWEEN 1 AND 5 AND turn % 4 <> 3 GROUP BY conv_id)
SELECT 'hackernews:story:' || s.conv_id AS id, {_JOIN.format(first=_stripped('s.text'))} AS content, coalesce(n, 0) AS comment_count FROM s LEFT JOIN c ON s.conv_id = c.conv_id""")
def s2_hn_items(spark, sf_dir):
    t = threads(spark, sf_dir)
    stories = t.filter("turn = 0").selectExpr("conv_id AS id", "'t' AS title", "CAST(NULL AS string) AS url", "role AS author", "conv_id AS sec", "score", "text", "transform(sequence(1, 8), k -> conv_id * 1000 + k) AS kids")
    comments = t.filter("turn > 0").selectExpr("conv_id * 1000 + turn AS id", "role AS author", "text", "turn % 4 = 3 AS deleted", "false AS dead")
    return N.hn_items(stories, comments, 0, 20).selectExpr("id", "content", "cast(comment_count AS bigint) AS comment_count")


_KIND = "CASE event_type WHEN 'click' THEN 'PushEvent' WHEN 'view' THEN 'CreateEvent' WHEN 'purchase' THEN 'ReleaseEvent' WHEN 'signup' THEN 'WatchEvent' ELSE 'ForkEvent' END"


@query(f"""WITH e AS (SELECT *, {_KIND} AS k, 'u' || user_id AS u, 'o/r' || (event_id % 9) AS r FROM events)
SELECT 'github:event:' || event_id AS id, CASE k WHEN 'PushEvent' THEN u || ' pushed ' || (event_id % 5) || ' commit(s) to ' || r WHEN 'CreateEvent' THEN u || ' created repository in ' || r
 WHEN 'ReleaseEvent' THEN u || ' released v' || event_id || ' in ' || r WHEN 'WatchEvent' THEN u || ' starred ' || r END AS title,
CASE k WHEN 'PushEvent' THEN CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'm1' WHEN 2 THEN 'm1' || chr(10) || 'm2' ELSE 'm1' || chr(10) || 'm2' || chr(10) || 'm3' END WHEN 'ReleaseEvent' THEN props ELSE '' END AS content
FROM e WHERE k <> 'ForkEvent' AND floor(epoch(ts))::BIGINT >= {START + 86400}""")
def s3_github_event_items(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", f"{_KIND} AS kind", "unix_seconds(cast(ts AS timestamp)) AS sec", "concat('u', user_id) AS user", "concat('o/r', event_id % 9) AS repo", "CAST(NULL AS string) AS ref_type", "CAST(NULL AS string) AS description",
        "concat('v', event_id) AS tag", "props AS body", "CAST(NULL AS string) AS html_url", "transform(slice(sequence(1, 5), 1, cast(event_id % 5 AS int)), k -> concat('m', k)) AS messages",
    )
    return N.github_event_items(e, START + 86400).select("id", "title", "content")


@query(f"SELECT 'github:release:' || event_id AS id, 'o/r v' || user_id || CASE WHEN event_id % 2 = 0 THEN ' (pre-release)' ELSE '' END AS title, props AS content FROM events WHERE floor(epoch(ts))::BIGINT >= {START}")
def s4_github_release_items(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id AS id", "'o/r' AS repo", "concat('v', user_id) AS tag", "event_id % 2 = 0 AS prerelease", "'u' AS html_url", "props AS body", "unix_seconds(cast(ts AS timestamp)) AS sec")
    return N.github_release_items(e, START).select("id", "title", "content")


@query(f"""WITH {_THREADS}, c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS n FROM t WHERE turn > 0 AND role <> 'system'),
l AS (SELECT conv_id, string_agg('[' || role || ' (' || score || ' pts)]: ' || {_short('trim(text)', 500)}, chr(10) || chr(10) ORDER BY n) AS lines FROM c WHERE n <= 3 GROUP BY conv_id)
SELECT s.conv_id AS id, CASE WHEN s.conv_id % 2 = 0 THEN 'https://www.reddit.com/r/' || s.conv_id ELSE 'https://x.org' END AS url, {_JOIN.format(first=_short('s.text', 1500))} AS content FROM t s LEFT JOIN l ON s.conv_id = l.conv_id WHERE s.turn = 0 AND s.score >= 10""")
def s5_reddit_items(spark, sf_dir):
    t = threads(spark, sf_dir)
    posts = t.filter("turn = 0").selectExpr("conv_id AS id", "'t' AS title", "conv_id % 2 = 0 AS is_self", "concat('/r/', conv_id) AS permalink", "'https://x.org' AS url", "conv_id AS sec", "score", "text")
    comments = t.filter("turn > 0").selectExpr("conv_id AS post", "turn AS pos", "role AS author", "text", "score", "IF(role = 'system', 'moderator', NULL) AS distinguished")
    return N.reddit_items(posts, comments, 0, 10, 3).select("id", "url", "content")


@query()
def s6_listing_posts(spark, sf_dir):
    """Posts of a listing in landed pages, by rules."""
    rules = N.Rules(r"<li>.*?</li>", {"title": r"<a[^>]*>(.*?)</a>", "link": r'href="([^"]*)"'})
    return N.extract_records(table(spark, sf_dir, "pages"), rules)


@query(f"SELECT page_id, {_stripped('html')} AS content FROM pages WHERE page_id % 5 < 3")
def s7_reddit_feed(spark, sf_dir):
    entries = table(spark, sf_dir, "pages").selectExpr("page_id", "html", "page_id div 5 AS feed", "page_id AS pos")
    return N.first_entries(entries, 3).select("page_id", N.strip_tags(F.col("html")).alias("content"))


@query("""SELECT doc_id, CASE WHEN length(f) <= 80 THEN f ELSE substr(f, 1, 80) END AS title FROM (SELECT doc_id, trim(split_part(text, chr(10), 1)) AS f FROM documents)""")
def s8_message_title(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", N.message_title(F.col("text")).alias("title"))


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id DESC) AS n FROM documents)
SELECT 'telegram:c' || (doc_id % 50) || ':' || doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'https://x.org/' || doc_id ELSE 'https://t.me/c' || (doc_id % 50) || '/' || doc_id END AS url FROM m WHERE n <= 4""")
def s8_telegram_items(spark, sf_dir):
    d = table(spark, sf_dir, "documents").selectExpr("concat('c', doc_id % 50) AS channel", "doc_id AS pos", "doc_id AS message_id", "text", "doc_id AS sec", "array_compact(array('https://t.me/x', IF(doc_id % 3 = 0, concat('https://x.org/', doc_id), NULL))) AS links")
    return N.telegram_items(d, 0, 4).select("id", "url")


@query(f"""WITH t AS (SELECT event_id, user_id, event_type || ' ' || repeat('word ', (event_id % 20)::INT) AS body, ts FROM events WHERE event_id % 11 <> 0)
SELECT 'twitter:tweet:' || event_id AS id, '@' || CASE WHEN event_id % 4 = 0 THEN 'unknown' ELSE 'u' || user_id END || ': ' || trim(substr(body, 1, 50)) || CASE WHEN length(body) > 50 THEN '...' ELSE '' END AS title,
CASE WHEN event_id % 4 = 0 THEN 'https://twitter.com/unknown/status/' || CASE WHEN event_id % 2 = 0 THEN 'tweet-' ELSE '' END || event_id ELSE 'https://twitter.com/u' || user_id || '/p' || event_id END AS url,
floor(epoch(ts))::BIGINT AS sec FROM t WHERE floor(epoch(ts))::BIGINT >= {START + 3 * 86400}""")
def s9_tweet_items(spark, sf_dir):
    when = "IF(event_id % 2 = 0, date_format(ts, 'EEE MMM dd HH:mm:ss +0000 yyyy'), date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"))"
    e = table(spark, sf_dir, "events").selectExpr(
        "concat(IF(event_id % 2 = 0, 'tweet-', ''), event_id) AS id", "'' AS id_str", f"{when} AS created_at", "IF(event_id % 11 = 0, '', concat(event_type, ' ', repeat('word ', cast(event_id % 20 AS int)))) AS full_text", "'' AS text",
        "IF(event_id % 4 = 0, '', concat('u', user_id)) AS screen_name", "CAST(NULL AS string) AS handle", "'n' AS name", "'' AS url", "concat('/p', event_id) AS permalink",
    )
    return N.tweet_items(e, START + 3 * 86400).select("id", "title", "url", "sec")


@query("""WITH t AS (SELECT user_id, event_id % 40 AS x, min(event_id) AS pos FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS n FROM t)
SELECT user_id AS user, x::VARCHAR AS id FROM r WHERE n <= 5""")
def s10_tweet_graph(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("user_id AS user", "event_id AS pos", "concat('{\"a\": [{\"b\": {\"rest_id\": \"', event_id % 40, '\", \"legacy\": {\"full_text\": \"t\", \"sec\": 5}}}, {\"rest_id\": \"\"}]}') AS payload")
    return N.tweets_in_json(e, 1, 5).select("user", "id")


_REPLIES = f"""{_THREADS}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY 2 * score + turn DESC, turn) AS n FROM t WHERE turn > 0 AND role <> 'user' AND trim(text) <> '' AND score >= 30),
rl AS (SELECT conv_id AS tweet_id, string_agg('[@' || role || ' | ❤️ ' || score || ' | 💬 ' || turn || '] ' || substr(trim(text), 1, 280), chr(10) ORDER BY n) AS block FROM r WHERE n <= 2 GROUP BY conv_id)"""


def _reply_lines(spark, sf_dir):
    t = threads(spark, sf_dir)
    replies = t.selectExpr("conv_id AS conversation_id", "concat(conv_id, '-', turn) AS id", "turn AS pos", "role AS handle", "text", "score AS likes", "turn AS replies")
    tweets = t.filter("turn = 0").selectExpr("concat(conv_id, '-0') AS tweet_id", "conv_id AS conversation_id", "'User' AS author")
    return N.reply_lines(replies, tweets, 30, 2).select(F.split_part("tweet_id", F.lit("-"), F.lit(1)).cast("long").alias("tweet_id"), F.array_join("lines", "\n").alias("block"))


@query(f"WITH {_REPLIES} SELECT * FROM rl")
def s11_reply_lines(spark, sf_dir):
    return _reply_lines(spark, sf_dir)


@query(f"""WITH {_REPLIES}, d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN source || chr(10) || '--- Top Comments ---' || chr(10) || 'old' ELSE source END AS content FROM documents)
SELECT doc_id, CASE WHEN block IS NULL THEN content WHEN doc_id % 4 = 0 THEN '--- Top Comments ---' || chr(10) || block WHEN doc_id % 4 = 1 THEN content || chr(10) || block ELSE content || chr(10) || chr(10) || '--- Top Comments ---' || chr(10) || block END AS content
FROM d LEFT JOIN rl ON doc_id = tweet_id""")
def s12_append_discussion(spark, sf_dir):
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat(source, '\\n--- Top Comments ---\\nold') ELSE source END AS content")
    joined = d.join(_reply_lines(spark, sf_dir), F.col("doc_id") == F.col("tweet_id"), "left")
    once = joined.withColumn("content", N.append_discussion(F.col("content"), F.col("block")))
    return once.select("doc_id", N.append_discussion(F.col("content"), F.col("block")).alias("content"))


@query("SELECT 'gdelt:article:' || strftime(ts, '%Y%m%dT%H%M%SZ') || '::http://x.org/' || event_id AS id, event_type AS title, floor(epoch(ts))::BIGINT AS sec FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0")
def s13_gdelt_items(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("IF(event_id % 7 = 0, ' ', concat(' http://x.org/', event_id)) AS url", "event_type AS title", "IF(event_id % 5 = 0, '2024-01-01', date_format(ts, \"yyyyMMdd'T'HHmmss'Z'\")) AS seendate", "'d' AS domain")
    return N.gdelt_items(e).select("id", "title", "sec")


@query("SELECT doc_id, 'Untitled' AS title, CASE WHEN length(trim(text)) >= 1000 THEN 'high' ELSE 'low' END AS quality FROM documents WHERE doc_id % 30 < 4")
def s1_s14_feed_items(spark, sf_dir):
    """Feed entries of several date forms, the first four of each feed; the undated ones take the date in their link."""
    published = "CASE doc_id % 3 WHEN 0 THEN 'Tue, 2 Jan 2024 10:00:00 +0000' WHEN 1 THEN '2024-01-03T00:00:00Z' ELSE 'soon' END"
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id div 30 AS feed", "doc_id AS pos", "cast(doc_id AS string) AS entry_id", "CAST(NULL AS string) AS title", "concat('http://x.org/2024/01/05/', doc_id) AS link", "'' AS author", f"{published} AS published", "CAST(NULL AS string) AS updated", "text AS encoded", "source AS summary")
    made = N.feed_items(N.first_entries(d, 4), START, "feed")
    return made.select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("doc_id"), "title", "quality")


@query("""WITH p AS (SELECT *, coalesce(try_cast(CASE WHEN p_size % 6 = 0 THEN 'many' ELSE p_size::VARCHAR END AS INTEGER), 0) AS g, row_number() OVER (PARTITION BY p_partkey % 700 ORDER BY p_partkey) AS n FROM part)
SELECT 'ossinsight:trending:' || (p_partkey % 700) AS id, g::BIGINT AS gained FROM p WHERE n = 1 AND g >= 5 AND contains(lower(p_type || ' ' || p_name), 'e') ORDER BY g DESC, p_partkey LIMIT 40""")
def s15_ossinsight_items(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS pos", "p_partkey % 700 AS repo_id", "p_name AS repo_name", "IF(p_size % 6 = 0, 'many', cast(p_size AS string)) AS stars", "p_type AS description", "CAST(NULL AS string) AS collections")
    names = N.ossinsight_items(p.withColumn("repo_name", F.col("repo_name")), 5, ["E", "steel"], 40, "week")
    return names.selectExpr("id", "cast(gained AS bigint) AS gained")


@query(f"""WITH n AS (SELECT 'http://x.org/' || (event_id % 4000) AS url, event_id, event_type, floor(epoch(ts))::BIGINT AS sec, CASE WHEN event_id % 3 = 0 THEN '' ELSE ' aapl, msft ,AAPL' END AS symbols FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY event_id) AS r FROM n WHERE sec > {START + 5 * 86400})
SELECT url, sec, CASE WHEN symbols = '' THEN CASE WHEN event_type IN ('click', 'view') THEN 'SPY' ELSE 'QQQ,DIA' END ELSE 'AAPL,MSFT' END AS symbols FROM k WHERE r = 1""")
def s16_openbb_items(spark, sf_dir):
    watch = spark.createDataFrame([("a", ["SPY"]), ("b", ["QQQ", "DIA"])], "watchlist string, symbols array<string>")
    n = table(spark, sf_dir, "events").selectExpr("IF(event_type IN ('click', 'view'), 'a', 'b') AS watchlist", "event_id AS pos", "concat('http://x.org/', event_id % 4000) AS url", "event_type AS title", "unix_seconds(cast(ts AS timestamp)) AS sec", "IF(event_id % 3 = 0, '', ' aapl, msft ,AAPL') AS symbols")
    return N.openbb_items(n, watch, START + 5 * 86400).select("url", "sec", F.array_join("symbols", ",").alias("symbols"))


@query("""SELECT substr(md5('u' || o_orderkey), 1, 12) AS id, CASE WHEN o_orderkey % 5 = 4 THEN '2030-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders WHERE o_orderkey % 5 = 4 OR o_orderdate >= DATE '1996-01-01'""")
def s17_dated_news(spark, sf_dir):
    text = "CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'yyyy年M月d日') WHEN 2 THEN date_format(o_orderdate, 'MMM d, yyyy') WHEN 3 THEN date_format(o_orderdate, 'yyyy/MM/dd') ELSE 'today' END"
    o = table(spark, sf_dir, "orders").selectExpr("concat('u', o_orderkey) AS url", "o_orderpriority AS title", f"{text} AS date_text")
    return N.dated_news(o, "1996-01-01", "2030-01-01").select("id", "day")


@query("SELECT page_id, 0 AS place, CASE WHEN page_id % 2 = 0 THEN '标题' ELSE 'title' END AS title, page_id AS sec FROM pages WHERE page_id >= 50")
def s18_embedded_json(spark, sf_dir):
    script = "concat(html, '<script>window.__DATA__ = [{\"title_zh\": \"', IF(page_id % 2 = 0, '标题', ''), '\", \"title_en\": \"title\", \"ms\": ', page_id, '999}, {\"title_en\": \"x\", \"ms\": ', page_id, '000}];</script>')"
    return N.embedded_json_items(table(spark, sf_dir, "pages").selectExpr("page_id", f"{script} AS html"), r"(?s)window\.__DATA__ = (\[.*?\]);</script>", "array<struct<title_zh: string, title_en: string, ms: long>>", 50, 1)


@query("""SELECT 'openalex:W' || doc_id AS id, 'T' || doc_id AS title, 'A,B' AS authors, 'one two one' AS abstract, (2000 + doc_id % 20)::BIGINT AS year, CASE WHEN doc_id % 2 = 0 THEN '24.' || doc_id END AS arxiv_id FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0""")
def s23_catalogue_papers(spark, sf_dir):
    doi = "IF(doc_id % 2 = 0, concat('\"10.48550/arXiv.24.', doc_id, '\"'), 'null')"
    work = f"""concat('{{"id": "https://x.org/W', doc_id, '", "display_name": "', IF(doc_id % 7 = 0, ' ', concat(' T', doc_id)), '", "publication_year": ', 2000 + doc_id % 20, ', "publication_date": "', IF(doc_id % 5 = 0, 'soon', '2020-02-03'),
      '", "doi": ', {doi}, ', "authorships": [{{"author": {{"display_name": "A"}}}}, {{"author": {{}}}}, {{"author": {{"display_name": "B"}}}}], "abstract_inverted_index": {{"two": [1], "one": [0, 2]}}}}')"""
    papers = N.catalogue_papers(table(spark, sf_dir, "documents").selectExpr(f"{work} AS json"))
    return papers.select("id", "title", F.array_join("authors", ",").alias("authors"), "abstract", F.col("publication_year").cast("long").alias("year"), "arxiv_id")


@query("SELECT 'huggingface:' || doc_id AS id, trim(text) AS title, doc_id % 9 AS upvotes FROM documents WHERE doc_id % 8 <> 0 AND trim(text) <> ''")
def s24_daily_papers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").selectExpr("cast(doc_id AS string) AS native_id", "text AS title", "source AS summary", "IF(doc_id % 8 = 0, NULL, date'2024-01-01') AS published", "doc_id % 9 AS upvotes")
    return N.daily_papers(d).select("id", "title", "upvotes")


_SPACED = r"nullif(trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')), '')"


@query(f"""SELECT CASE WHEN doc_id % 3 = 0 THEN 'solv-int/' || doc_id ELSE '2401.' || doc_id END AS arxiv_id, 'A title ' || doc_id AS title, 'Ada L,Bo' AS authors, {_SPACED} AS abstract, 2000 + doc_id % 20 AS year,
CASE WHEN doc_id % 2 = 0 THEN 'https://x.org/' || doc_id ELSE 'https://arxiv.org/pdf/' || CASE WHEN doc_id % 3 = 0 THEN 'solv-int/' || doc_id ELSE '2401.' || doc_id END END AS pdf_url, 'cs.LG,cs.' || coalesce(lang, 'xx') AS categories, 'cs.LG' AS primary_category FROM documents""")
def s25_arxiv_records(spark, sf_dir):
    """Atom entries around the documents' texts, landed as XML."""
    text = "replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    name = "IF(doc_id % 3 = 0, concat('solv-int/', doc_id), concat('2401.', doc_id))"
    entry = f"""concat('<entry><id>http://arxiv.org/abs/', {name}, IF(doc_id % 5 = 0, '', 'v3'), '</id><title>A\n  title ', doc_id, ' </title><summary>', {text}, '</summary><published>', 2000 + doc_id % 20, '-12-10T00:00:00Z</published>',
      '<author><name>Ada L</name></author><author><name>Bo</name></author><author><name> </name></author>', IF(doc_id % 2 = 0, concat('<link title="pdf" href="https://x.org/', doc_id, '"/>'), '<link href="https://y.org"/>'),
      '<category term="cs.LG"/><category term="cs.', coalesce(lang, 'xx'), '"/><arxiv:primary_category xmlns:arxiv="http://arxiv.org/schemas/atom" term="cs.LG"/></entry>')"""
    records = N.arxiv_records(N.atom_entries(table(spark, sf_dir, "documents").selectExpr(f"{entry} AS xml")))
    return records.select("arxiv_id", "title", F.array_join("authors", ",").alias("authors"), "abstract", F.col("year").cast("long"), "pdf_url", F.array_join("categories", ",").alias("categories"), "primary_category")


@query("""SELECT doc_id AS id, source AS title, 'Ada,Bo' AS authors, text AS abstract, CASE WHEN doc_id % 3 = 0 THEN '10.1/' || doc_id END AS doi, CASE WHEN doc_id % 2 = 0 THEN '24.' || doc_id END AS arxiv_id,
CASE WHEN doc_id % 5 = 0 THEN 'https://x.org/' || doc_id END AS pdf_url, CASE WHEN doc_id % 7 <> 0 THEN 'V' END AS venue, doc_id % 30 AS citation_count FROM documents""")
def s26_semantic_scholar_records(spark, sf_dir):
    answer = """to_json(named_struct('paperId', concat('p', doc_id), 'title', source, 'abstract', text, 'year', 2000 + doc_id % 20, 'venue', IF(doc_id % 7 = 0, '', 'V'), 'citationCount', doc_id % 30, 'authors', array(named_struct('name', 'Ada'), named_struct('name', ''), named_struct('name', 'Bo')),
      'externalIds', named_struct('DOI', IF(doc_id % 3 = 0, concat('10.1/', doc_id), NULL), 'ArXiv', IF(doc_id % 2 = 0, concat('24.', doc_id), NULL)), 'openAccessPdf', IF(doc_id % 5 = 0, named_struct('url', concat('https://x.org/', doc_id)), NULL)))"""
    records = N.semantic_scholar_records(table(spark, sf_dir, "documents").selectExpr("doc_id AS id", f"{answer} AS json"))
    return records.select("id", "title", F.array_join("authors", ",").alias("authors"), "abstract", "doi", "arxiv_id", "pdf_url", "venue", "citation_count")


@query("SELECT doc_id AS id, 'T' || doc_id AS title, 'J' AS journal_ref, '10.1/' || doc_id AS doi, 'Ada L,Bo' AS authors FROM documents")
def s26_crossref_records(spark, sf_dir):
    answer = """concat('{"DOI": "10.1/', doc_id, '", "title": ["T', doc_id, '"], "container-title": ["J"], "author": [{"given": "Ada", "family": "L"}, {"family": "Bo"}], "URL": "u"}')"""
    return N.crossref_records(table(spark, sf_dir, "documents").selectExpr("doc_id AS id", f"{answer} AS json")).select("id", "title", "journal_ref", "doi", F.array_join("authors", ",").alias("authors"))


@query(f"SELECT 'ali:' || page_id AS id, CASE WHEN page_id % 2 = 0 THEN 'a|b' ELSE '' END AS categories, (page_id % 3 = 0)::BIGINT AS files, {_stripped('html')} AS content_text FROM pages")
def s27_report_records(spark, sf_dir):
    p = table(spark, sf_dir, "pages").selectExpr("page_id AS native_id", "url AS title", "IF(page_id % 2 = 0, 'a， b,', NULL) AS category", "IF(page_id % 3 = 0, 'x.pdf', '') AS pdf", "html", "page_id AS sec")
    return N.report_records(p, "ali").select("id", F.array_join("categories", "|").alias("categories"), F.size("pdf_urls").cast("long").alias("files"), "content_text")


@query()
def s28_report_html_records(spark, sf_dir):
    """Paragraph records of landed pages, cut by rules, capped per host and distinct by text."""
    from tidemark.functions.urls import host

    rules = N.Rules(r"<p>.*?(?=<p>|</article>|$)", {"summary": r"<p>(.*?)(?:</p>|<br>|$)"})
    pages = table(spark, sf_dir, "pages")
    records = N.extract_records(pages, rules).join(pages.select("page_id", host(F.col("url")).alias("org")), "page_id")
    placed = records.filter("summary != ''").withColumn("pos", F.col("page_id") * 10_000 + F.col("place"))
    return N.capped_by_group(placed, "org", F.col("page_id") >= 0, 40, "summary").select("page_id", "place", "org", "summary")


@query("""WITH r AS (SELECT o_orderkey AS pos, o_custkey % 50 AS org, o_orderkey % 3000 AS id, o_orderdate, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS n FROM orders WHERE o_orderdate >= DATE '1995-01-01')
SELECT pos, id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS k FROM r WHERE n <= 60) WHERE k = 1""")
def s28_cutoff_and_caps(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS pos", "o_custkey % 50 AS org", "o_orderkey % 3000 AS id", "o_orderdate")
    return N.capped_by_group(o, "org", F.col("o_orderdate") >= F.lit("1995-01-01"), 60, "id").select("pos", "id")


@query("""SELECT doc_id AS id, source, '2024-01-' || lpad((doc_id % 10 + 1)::VARCHAR, 2, '0') AS day, text AS content FROM documents WHERE doc_id % 10 >= 4""")
def s0_landed_payloads(spark, sf_dir):
    """Documents that have landed as JSON lines by source and date; the dates asked for are the feature."""
    out = K.workdir(spark, "landed")
    lines = table(spark, sf_dir, "documents").selectExpr("to_json(struct(doc_id AS id, text AS content)) AS value", "source", "concat('2024-01-', lpad(doc_id % 10 + 1, 2, '0')) AS date")
    lines.write.partitionBy("source", "date").text(f"{out}/landed")
    rows = landed.read_landed(spark, f"{out}/landed", since=date(2024, 1, 5))
    return rows.select(F.from_json("payload", "id long, content string").alias("r"), "source", F.col("date").cast("string").alias("day")).select("r.id", "source", "day", "r.content")
