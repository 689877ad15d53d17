"""Queries of text, HTML and language functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators import extraction as E
from tidemark.plans.bindings import table
from tidemark.registry import query

_HOST = f"lower(regexp_extract(url, '{U.HOST}', 1))"
_PATH = f"regexp_extract(url, '{U.PATH}', 1)"
_LINKS = """links AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id + 1000000, 'https://' || h || '/x/' || page_id || e FROM pages,
  (VALUES ('github.com', ''), ('www.openai.com', ''), ('example.com', '.pdf'), ('img.example.com', '/40px-a.png'), ('img.example.com', '/site-Logo.png'), ('a.example.com', '/b(c.html'), ('a.example.com', '/b(c).SVG')) v(h, e))"""


def links(spark, sf_dir):
    """Page URLs, and for every page URLs of several hosts and endings."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    more = spark.createDataFrame([("github.com", ""), ("www.openai.com", ""), ("example.com", ".pdf"), ("img.example.com", "/40px-a.png"), ("img.example.com", "/site-Logo.png"), ("a.example.com", "/b(c.html"), ("a.example.com", "/b(c).SVG")], "h string, e string")
    return p.union(p.crossJoin(F.broadcast(more)).selectExpr("page_id + 1000000", "concat('https://', h, '/x/', page_id, e)"))


_SKIP = "CASE " + " ".join(f"WHEN contains({_HOST}, '{h}') THEN 'skip_domain:{h}'" for h in U.SKIPPED_HOSTS) + " " + " ".join(f"WHEN ends_with(lower({_PATH}), '{e}') THEN 'skip_extension:{e}'" for e in U.SKIPPED_ENDINGS) + " END"


@query(f"WITH {_LINKS} SELECT page_id, url, {_SKIP} AS reason FROM links")
def c1_skip_reason(spark, sf_dir):
    return links(spark, sf_dir).withColumn("reason", U.skip_reason(F.col("url")))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS plain FROM pages")
def c2_strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("plain"))


@query()
def c2_html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.unescape(T.strip_tags(F.col("html"))).alias("plain"))


@query()
def c3_strip_containers(spark, sf_dir):
    return E.strip_boilerplate_containers(table(spark, sf_dir, "pages")).select("page_id", "stripped")


def _landed(spark, sf_dir):
    status = "CASE WHEN page_id % 7 = 0 THEN 404 ELSE 200 END"
    return table(spark, sf_dir, "pages").selectExpr("*", f"{status} AS http_status", "CASE WHEN page_id % 11 = 0 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS content_type", "CASE WHEN page_id % 13 = 0 THEN 'high' ELSE 'low' END AS rss_quality")


_GATE = f"""CASE WHEN page_id % 13 = 0 THEN 'rss_high_quality' WHEN ({_SKIP}) IS NOT NULL THEN ({_SKIP}) WHEN page_id % 7 = 0 THEN 'http_404'
WHEN page_id % 11 = 0 THEN 'not_html' WHEN length(coalesce(html, '')) < 500 THEN 'html_too_short' END"""


@query(f"SELECT page_id, {_GATE} AS error FROM pages")
def c4_extraction_gates(spark, sf_dir):
    p = _landed(spark, sf_dir)
    return p.select("page_id", E.gate(F.col("url"), F.col("http_status"), F.col("content_type"), F.col("html"), F.col("rss_quality")).alias("error"))


@query()
def c4_extract_article(spark, sf_dir):
    return E.extract_article(_landed(spark, sf_dir)).select("page_id", "article", "status", "error")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'summary' WHEN 'error' THEN 'browser' ELSE 'http' END AS route FROM events")
def c5_extraction_route(spark, sf_dir):
    mode = F.expr("CASE event_type WHEN 'click' THEN 'skip' WHEN 'error' THEN 'browser' END")
    return table(spark, sf_dir, "events").select("event_id", E.extraction_route(mode).alias("route"))


@query(f"""WITH p AS (SELECT {_HOST} AS label, {_GATE} AS error FROM pages)
SELECT label, count(*) AS total, count(*) FILTER (error IS NULL) AS extracted, count(*) FILTER (error = 'rss_high_quality' OR error LIKE 'skip%') AS skipped,
round(count(*) FILTER (error = 'rss_high_quality' OR error LIKE 'skip%') / count(*), 4) AS skip_ratio FROM p GROUP BY label""")
def c6_extraction_stats(spark, sf_dir):
    error = E.gate(F.col("url"), F.col("http_status"), F.col("content_type"), F.col("html"), F.col("rss_quality"))
    status = F.when(F.col("error").isNull(), "success").when(F.col("error").rlike("^(rss_high|skip)"), "skipped").otherwise("failed")
    p = _landed(spark, sf_dir).select(U.host(F.col("url")).alias("label"), error.alias("error")).withColumn("status", status)
    return E.extraction_stats(p)


_CALLS = "t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' Please subscribe now! More text.' ELSE text END AS text FROM documents)"


def _calls(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 3 = 0 THEN concat(text, ' Please subscribe now! More text.') ELSE text END AS text")


@query(rf"""WITH {_CALLS}, s AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(text), '({T.SENTENCE_END})\s*', '\1␞', 'g'), '␞'), lambda x: trim(x) <> '') AS every FROM t),
k AS (SELECT doc_id, len(every) AS n, list_filter(every, lambda x: NOT regexp_matches(x, '{T.CTA.replace("'", "''")}')) AS kept FROM s)
SELECT doc_id, trim(array_to_string(kept, ' ')) AS text, len(kept) <> n AS changed FROM k""")
def c7_strip_cta(spark, sf_dir):
    return _calls(spark, sf_dir).select("doc_id", T.strip_cta(F.col("text")).alias("c")).select("doc_id", "c.*")


@query()
def c8_clean_article(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_article("text", F.split_part("text", F.lit("\n"), F.lit(1))).alias("clean"))


_NOISY = "t AS (SELECT doc_id, text || chr(10) || CASE doc_id % 4 WHEN 0 THEN 'Read more at example.com' WHEN 1 THEN 'Source: a site' WHEN 2 THEN '  ' ELSE 'the post x appeared first on y' END || chr(10) || 'end' AS text FROM documents)"


@query(rf"WITH {_NOISY} SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '{T.NOISE}')), chr(10)) AS text FROM t")
def c8_noise_lines(spark, sf_dir):
    tail = "CASE doc_id % 4 WHEN 0 THEN 'Read more at example.com' WHEN 1 THEN 'Source: a site' WHEN 2 THEN '  ' ELSE 'the post x appeared first on y' END"
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", f"concat(text, char(10), {tail}, char(10), 'end') AS text")
    return d.select("doc_id", T.drop_noise_lines(F.col("text")).alias("text"))


@query("SELECT doc_id, trim(regexp_replace(replace(text, '. ', '.' || chr(10) || chr(10) || chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')) AS text FROM documents")
def c9_collapse_blank_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse_blank_lines(F.replace("text", F.lit(". "), F.lit(".\n\n\n"))).alias("text"))


@query()
def c10_sanitize_html(spark, sf_dir):
    return E.sanitize_html(table(spark, sf_dir, "pages")).select("page_id", "safe_html")


@query()
def c11_structured_html(spark, sf_dir):
    return E.structured_html(table(spark, sf_dir, "pages")).select("page_id", "structured")


@query()
def c12_extract_images(spark, sf_dir):
    img = "concat(html, '<img src=\"/a/logo.png\"><figure><img src=\"b', page_id % 3, '.jpg\"><figcaption>cap</figcaption></figure><img src=\"b', page_id % 3, '.jpg\">')"
    return E.extract_images(table(spark, sf_dir, "pages").selectExpr("page_id", "url", f"{img} AS html"))


@query(rf"""WITH {_LINKS}, n AS (SELECT page_id, url, lower({_PATH}) AS p, regexp_extract(lower({_PATH}), '([^/]*)$', 1) AS f FROM links)
SELECT page_id, url, ends_with(p, '.svg') OR contains(p, '.svg.') OR regexp_matches(f, '{"|".join(U.ICON_MARKS)}')
  OR coalesce(try_cast(regexp_extract(f, '^(\d{{1,9}})px-', 1) AS INTEGER) < 100, false) AS is_icon FROM n""")
def c13_looks_like_icon(spark, sf_dir):
    return links(spark, sf_dir).withColumn("is_icon", U.looks_like_icon(F.col("url")))


_TIERS = """t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN '' END AS raw, CASE WHEN doc_id % 6 = 0 THEN replace(text, 'e', '') END AS clean,
 CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'summary ' || doc_id END AS summary, CASE WHEN doc_id % 4 = 0 THEN 'failed' END AS status FROM documents)"""


@query(f"""WITH {_TIERS} SELECT doc_id, CASE WHEN nullif(raw, '') IS NOT NULL THEN coalesce(nullif(clean, ''), raw) ELSE coalesce(summary, '') END AS text,
CASE WHEN nullif(raw, '') IS NOT NULL THEN 'full_text' WHEN nullif(summary, '') IS NOT NULL THEN 'rss_summary' ELSE 'none' END AS tier,
nullif(raw, '') IS NOT NULL AS is_full, coalesce(status, 'unknown') AS status FROM t""")
def c14_resolve_content(spark, sf_dir):
    t = table(spark, sf_dir, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN '' END AS raw", "CASE WHEN doc_id % 6 = 0 THEN replace(text, 'e', '') END AS clean", "CASE WHEN doc_id % 5 != 0 THEN concat('summary ', doc_id) END AS summary", "CASE WHEN doc_id % 4 = 0 THEN 'failed' END AS status")
    return t.select("doc_id", T.resolve_content(*map(F.col, ("clean", "raw", "summary", "status"))).alias("c")).select("doc_id", "c.*")


_COMMENTED = f"t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ' ' || text || chr(10) || '{T.COMMENTS}' || chr(10) || ' c1 {T.COMMENTS} c2 ' ELSE text END AS text FROM documents)"
_MAIN = rf"regexp_replace(CASE WHEN contains(text, '{T.COMMENTS}') THEN substr(text, 1, instr(text, '{T.COMMENTS}') - 1) ELSE text END, '^\s+|\s+$', '', 'g')"


def _commented(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"CASE WHEN doc_id % 2 = 0 THEN concat(' ', text, char(10), '{T.COMMENTS}', char(10), ' c1 {T.COMMENTS} c2 ') ELSE text END AS text")


@query(rf"WITH {_COMMENTED} SELECT doc_id, {_MAIN} AS main, regexp_replace(CASE WHEN contains(text, '{T.COMMENTS}') THEN substr(text, instr(text, '{T.COMMENTS}') + {len(T.COMMENTS)}) ELSE '' END, '^\s+|\s+$', '', 'g') AS comments FROM t")
def c15_split_comments(spark, sf_dir):
    return _commented(spark, sf_dir).select("doc_id", T.split_comments(F.col("text")).alias("c")).select("doc_id", "c.*")


@query(rf"""WITH {_COMMENTED}, m AS (SELECT doc_id, {_MAIN} AS main, CASE WHEN contains(text, '{T.COMMENTS}') THEN 800 ELSE 1000 END AS cap FROM t)
SELECT doc_id, substr(main, 1, cap) AS text, length(main) AS original_length, length(substr(main, 1, cap)) AS sent_length, cap AS truncation_limit FROM m""")
def c16_stage_input(spark, sf_dir):
    return _commented(spark, sf_dir).select("doc_id", T.stage_input(F.col("text"), "analysis").alias("c")).select("doc_id", "c.*")


@query("""SELECT event_id, concat_ws(chr(10), CASE WHEN event_type = 'click' THEN 'Community Comments:' || chr(10) || event_type END,
'Engagement: ' || nullif(concat_ws(', ', CASE WHEN event_id % 3 <> 0 THEN 'score: ' || (event_id % 3) END, CASE WHEN user_id % 2 <> 0 THEN (user_id % 2) || ' comments' END,
 CASE WHEN event_id % 4 <> 0 THEN 'upvote ratio: ' || ((event_id % 4) * 25) || '%' END), '')) AS section FROM events""")
def c17_discussion_section(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id", "event_id % 3 AS score", "user_id % 2 AS descendants", "(event_id % 4) / 4.0D AS upvote_ratio", "CASE WHEN event_type = 'click' THEN event_type END AS said")
    return e.select("event_id", T.discussion_section(e.columns, F.col("said")).alias("section"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents")
def c18_content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


_MIXED = "t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || repeat('中文内容很多AI模型', length(text) // 10 + 1) WHEN 1 THEN ' ' || text ELSE text END AS text FROM documents)"


def _mixed(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "CASE doc_id % 4 WHEN 0 THEN concat(text, repeat('中文内容很多AI模型', CAST(length(text) div 10 + 1 AS int))) WHEN 1 THEN concat(' ', text) ELSE text END AS text")


@query(f"WITH {_MIXED} SELECT doc_id, CASE WHEN coalesce(trim(text), '') = '' THEN 'unknown' WHEN length(regexp_replace(text, '[^{T.CJK}]', '', 'g')) / length(text) > 0.3 THEN 'zh' ELSE 'en' END AS language FROM t")
def c19_detect_language(spark, sf_dir):
    return _mixed(spark, sf_dir).select("doc_id", T.detect_language(F.col("text")).alias("language"))


@query("""WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'zh' WHEN 1 THEN 'en' ELSE 'unknown' END AS o, doc_id % 2 = 0 AS en, doc_id % 5 = 0 AS zh FROM documents),
b AS (SELECT doc_id, o, list_filter([CASE WHEN en THEN 'en' END, CASE WHEN zh THEN 'zh' END], lambda x: x IS NOT NULL) AS l FROM t),
a AS (SELECT doc_id, o, CASE WHEN o <> 'unknown' AND NOT list_contains(l, o) THEN list_concat([o], l) ELSE l END AS l FROM b)
SELECT doc_id, array_to_string(l, ',') AS available, 'zh' AS shown, o <> 'zh' AND list_contains(l, 'zh') AS is_ai_translated FROM a""")
def c20_language_block(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    block = T.language_block(F.expr("CASE doc_id % 3 WHEN 0 THEN 'zh' WHEN 1 THEN 'en' ELSE 'unknown' END"), F.expr("CASE WHEN doc_id % 2 = 0 THEN 'x' END"), F.expr("CASE WHEN doc_id % 5 = 0 THEN 'y' ELSE '' END"))
    return d.select("doc_id", block.alias("b")).select("doc_id", F.array_join("b.available", ",").alias("available"), "b.shown", "b.is_ai_translated")


@query("""SELECT doc_id, l AS lang, coalesce(CASE WHEN l = 'en' AND doc_id % 2 = 0 THEN 'Title ' || doc_id END, substr(text, 1, 20)) AS title,
coalesce(CASE WHEN l = 'zh' THEN '摘要' END, 'no summary') AS summary FROM documents, (VALUES ('en'), ('zh')) v(l)""")
def c21_content_block(spark, sf_dir):
    titles = {"en": F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Title "), "doc_id")), "zh": F.lit("")}
    block = T.content_block(F.array(F.lit("en"), F.lit("zh")), {"title": titles, "summary": {"zh": F.lit("摘要")}}, {"title": F.substring("text", 1, 20), "summary": F.lit("no summary")})
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(block).alias("b")).select("doc_id", "b.*")


@query()
def c22_attach_clean(spark, sf_dir):
    c = _commented(spark, sf_dir).select("doc_id", T.split_comments(F.col("text"))["main"].alias("raw"))
    return c.select("doc_id", T.clean_article("raw", F.lit(None).cast("string")).alias("clean"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'not_needed' WHEN event_id % 3 = 0 THEN 'translated' WHEN event_id % 5 = 0 THEN 'no_content'
WHEN event_id % 7 = 0 THEN 'not_selected' WHEN event_type = 'error' THEN 'failed' ELSE 'pending' END AS status FROM events""")
def c23_translation_status(spark, sf_dir):
    status = T.translation_status(F.expr("IF(event_id % 2 = 0, 'zh', 'en')"), F.expr("IF(event_id % 3 = 0, 'x', NULL)"), F.expr("IF(event_id % 5 = 0, '', 'x')"), F.expr("event_id % 7 != 0"), F.expr("event_type = 'error'"))
    return table(spark, sf_dir, "events").select("event_id", status.alias("status"))


@query(rf"""WITH {_COMMENTED}, m AS (SELECT doc_id, text, {_MAIN} AS main FROM t)
SELECT doc_id, length(text) AS raw_length, length(main) AS main_length, length(substr(main, 1, CASE WHEN contains(text, '{T.COMMENTS}') THEN 800 ELSE 1000 END)) AS analysis_sent, length(substr(main, 1, 4000)) AS enrichment_sent FROM m""")
def c24_diagnostics(spark, sf_dir):
    text = F.col("text")
    return _commented(spark, sf_dir).select("doc_id", F.length(text).alias("raw_length"), F.length(T.split_comments(text)["main"]).alias("main_length"), T.stage_input(text, "analysis")["sent_length"].alias("analysis_sent"), T.stage_input(text, "enrichment")["sent_length"].alias("enrichment_sent"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE props END AS answer FROM events")
def c25_parse_model_json(spark, sf_dir):
    wrapped = F.expr("CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat('```json\\n', props, '\\n```') WHEN 2 THEN concat('So: ', props, ' ok') ELSE 'no answer {' END")
    return table(spark, sf_dir, "events").select("event_id", T.parse_model_json(wrapped).alias("answer"))


@query("SELECT event_id, event_id % 5 IN (0, 2, 3) AS verdict FROM events")
def c26_parse_yes_no(spark, sf_dir):
    said = F.expr("CASE event_id % 5 WHEN 0 THEN '{\"relevant\": \"是\"}' WHEN 1 THEN 'No, it is not' WHEN 2 THEN ' 是的' WHEN 3 THEN '{\"r\": \"是' ELSE '{\"r\": \"否\"}' END")
    return table(spark, sf_dir, "events").select("event_id", T.parse_yes_no(said).alias("verdict"))


@query(rf"WITH {_MIXED} SELECT doc_id, regexp_replace(regexp_replace(text, '([{T.CJK}])([A-Za-z0-9])', '\1 \2', 'g'), '([A-Za-z0-9])([{T.CJK}])', '\1 \2', 'g') AS text FROM t")
def c27_pangu(spark, sf_dir):
    return _mixed(spark, sf_dir).select("doc_id", T.pangu(F.col("text")).alias("text"))


@query("""WITH s AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS part FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
r AS (SELECT *, sum(length(part)) OVER w + i - 1 AS total FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, string_agg(part, chr(10) ORDER BY i) AS kept FROM r WHERE i = 1 OR total <= 600 GROUP BY doc_id""")
def c28_truncate_segments(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate_segments(F.col("text"), 600, "\n").alias("kept"))


@query("SELECT doc_id, 'Doc ' || doc_id || ': ' || source || ' #{unknown}' AS text FROM documents")
def c29_render_template(spark, sf_dir):
    values = F.create_map(F.lit("id"), F.col("doc_id").cast("string"), F.lit("source"), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", T.render_template(F.lit("Doc #{id}: #{source?limit=99} #{unknown}"), values).alias("text"))


@query("SELECT doc_id, '- More' || chr(10) || '  - line ' || doc_id || ' [a](https://x.org/' || doc_id || ') b' AS text FROM documents")
def c30_flatten_markdown(spark, sf_dir):
    md = F.expr("concat('<details><summary>More</summary>line ', doc_id, '</details> [a](https://x.org/', doc_id, ') [b](javascript:x)<a id=\"q\"></a>')")
    return table(spark, sf_dir, "documents").select("doc_id", T.flatten_markdown(md).alias("text"))


@query(rf"""WITH {_LINKS} SELECT page_id, url, regexp_matches(lower(url), '^https?://[^/?#]+') AND NOT regexp_matches(url, '[\x00-\x20\x7f<>\[\]]')
AND length(regexp_replace(url, '[^(]', '', 'g')) = length(regexp_replace(url, '[^)]', '', 'g')) AS safe FROM links""")
def c31_safe_link(spark, sf_dir):
    return links(spark, sf_dir).withColumn("safe", U.safe_link(F.col("url")))


@query(r"""WITH n AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(p_name || ' a/b:c?  d' || repeat('x', (p_partkey % 90)::INT) || '.pdf', '[\\/:*?"<>|\x00-\x1f]', '_', 'g'), '\s+', ' ', 'g')) AS s FROM part)
SELECT p_partkey, CASE WHEN length(s) > 80 THEN substr(s, 1, 76) || '.pdf' ELSE s END AS name FROM n""")
def c32_sanitize_filename(spark, sf_dir):
    name = F.expr("concat(p_name, ' a/b:c?  d', repeat('x', cast(p_partkey % 90 AS int)), '.pdf')")
    return table(spark, sf_dir, "part").select("p_partkey", T.sanitize_filename(name).alias("name"))


@query()
def c33_block_batches(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("blocks"))
    return lines.select("doc_id", F.posexplode(T.block_batches(F.col("blocks"))).alias("at", "batch"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN array_to_string(list_transform(string_split(text, chr(10)), lambda l: 'x' || l), chr(10)) END AS translated, CASE WHEN doc_id % 3 <> 0 THEN 'translated' ELSE 'failed' END AS status FROM documents""")
def c34_apply_translations(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    blocks = d.select("doc_id", F.posexplode("lines").alias("at", "text")).withColumn("batch", F.expr("at div 7"))
    cut = F.when(F.col("doc_id") % 3 == 0, F.lit(1)).otherwise(F.lit(0))
    answers = blocks.groupBy("doc_id", "batch").agg(F.array_sort(F.collect_list(F.struct("at", F.concat(F.lit("x"), "text").alias("t")))).alias("p"))
    answers = answers.select("doc_id", "batch", F.slice(F.transform("p", lambda p: p["t"]), F.lit(1), F.size("p") - cut).alias("texts"))
    return E.apply_translations(blocks, answers)
