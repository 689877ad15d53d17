"""Queries of papers and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import detect_language
from tidemark.operators import linking as L
from tidemark.plans.bindings import table
from tidemark.registry import query

_PLAIN = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT p_partkey, {_PLAIN.format(chr(39) + 'The ' + chr(39) + ' || p_name || ' + chr(39) + '-x: ' + chr(39) + ' || p_brand')} AS plain FROM part")
def p1_normalize_title(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", L.normalize_title(F.expr("concat('The ', p_name, '-x: ', p_brand)")).alias("plain"))


def seeds(spark, sf_dir):
    """Every twentieth document as a curated paper: its title with small changes, some with keys."""
    d = table(spark, sf_dir, "documents").filter("doc_id % 20 = 0")
    title = "CASE WHEN doc_id % 100 = 20 THEN concat('Unheard of: ', doc_id, ' and more') ELSE concat(substr(text, 1, 60), IF(doc_id % 40 = 0, '!', 's')) END"
    return d.selectExpr("doc_id AS seed_id", f"{title} AS title", "IF(doc_id % 60 = 0, doc_id, NULL) AS override_id", "IF(doc_id % 80 = 0, concat('10.1/', doc_id), NULL) AS doi", "IF(doc_id % 140 = 0, concat('24.', doc_id), NULL) AS arxiv_id", "2000 + doc_id % 20 AS year", "array(concat('A B', doc_id % 7)) AS authors")


def works(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.selectExpr("doc_id AS work_id", "substr(text, 1, 60) AS title", "doc_id % 50 = 49 AS is_retracted", "IF(doc_id % 16 = 0, concat('10.1/', doc_id), NULL) AS doi", "IF(doc_id % 7 = 0, concat('24.', doc_id), NULL) AS arxiv_id", "2000 + doc_id % 20 AS year", "array(concat('C B', doc_id % 7)) AS authors", "doc_id % 30 AS citations")


@query()
def p2_title_similarity(spark, sf_dir):
    """Every document's first sentence or line against the same with small changes."""
    line = r"regexp_extract(text, '^([^.\\n]*)', 1)"
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{line} AS a", f"concat(IF(doc_id % 3 = 0, 'On ', ''), {line}, IF(doc_id % 2 = 0, '!', 's')) AS b")
    return d.select("doc_id", F.round(L.title_similarity(L.normalize_title(F.col("a")), L.normalize_title(F.col("b"))), 6).alias("similarity"))


@query("""WITH a AS (SELECT doc_id, ['x n' || (doc_id % 3), 'Y  N' || (doc_id % 5)] AS x, CASE WHEN doc_id % 6 = 0 THEN [] ELSE ['n' || (doc_id % 4)] END AS y FROM documents),
n AS (SELECT doc_id, list_distinct(['n' || (doc_id % 3), 'n' || (doc_id % 5)]) AS x, y FROM a)
SELECT doc_id, len(y) = 0 OR len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) >= 0.5 AS overlap FROM n""")
def p3_author_overlap(spark, sf_dir):
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", "array(concat('x n', doc_id % 3), concat('Y  N', doc_id % 5)) AS x", "IF(doc_id % 6 = 0, array(), array(concat('n', doc_id % 4))) AS y")
    return d.select("doc_id", L.author_overlap(F.col("x"), F.col("y")).alias("overlap"))


@query("SELECT doc_id, doc_id % 9 = 0 OR abs(doc_id % 5 - doc_id % 3) <= 1 AS ok FROM documents")
def p4_year_matches(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", L.year_matches(F.expr("IF(doc_id % 9 = 0, NULL, doc_id % 5)"), F.expr("doc_id % 3")).alias("ok"))


@query()
def p5_candidate_pool(spark, sf_dir):
    return L.candidate_pool(seeds(spark, sf_dir), works(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


@query("""SELECT doc_id AS seed_id, doc_id AS work_id, CASE WHEN doc_id % 60 = 0 THEN 'override' WHEN doc_id % 80 = 0 AND doc_id % 100 <> 20 THEN 'doi' ELSE 'arxiv_id' END AS method
FROM documents WHERE doc_id % 20 = 0 AND (doc_id % 60 = 0 OR (doc_id % 80 = 0 AND doc_id % 100 <> 20) OR doc_id % 140 = 0)""")
def p6_match_by_keys(spark, sf_dir):
    return L.match_by_keys(seeds(spark, sf_dir), works(spark, sf_dir))


@query()
def p6_match_seeds(spark, sf_dir):
    return L.match_seeds(seeds(spark, sf_dir), works(spark, sf_dir))


@query()
def p7_collapse_same_work(spark, sf_dir):
    pool = L.candidate_pool(seeds(spark, sf_dir), works(spark, sf_dir))
    detail = pool.join(works(spark, sf_dir), "work_id").withColumn("is_preprint", F.col("arxiv_id").isNotNull())
    return L.collapse_same_work(detail.select("seed_id", "work_id", "title", "year", "is_preprint", "doi", "citations", "place"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'canon' ELSE 'work' END AS title, CASE WHEN o_orderkey % 3 = 0 THEN 2001 ELSE year(o_orderdate) END::BIGINT AS publication_year,
CASE WHEN o_orderkey % 5 = 0 THEN 'c' WHEN o_orderkey % 7 = 0 THEN 's' WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'w' END AS doi,
strftime(CASE WHEN o_orderkey % 3 = 0 AND year(o_orderdate) <> 2001 THEN CASE WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN DATE '2001-01-01' ELSE make_date(2001, month(o_orderdate), day(o_orderdate)) END ELSE o_orderdate::DATE END, '%Y-%m-%d') AS published_at FROM orders""")
def p8_canonical_overrides(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "IF(o_orderkey % 2 = 0, 'canon', NULL) AS canonical_title", "'work' AS work_title", "IF(o_orderkey % 3 = 0, 2001, NULL) AS canonical_year", "year(o_orderdate) AS publication_year",
        "IF(o_orderkey % 5 = 0, 'c', NULL) AS canonical_doi", "IF(o_orderkey % 7 = 0, 's', NULL) AS seed_doi", "IF(o_orderkey % 4 = 0, 'r', NULL) AS reprint_doi", "'w' AS work_doi", "cast(o_orderdate AS date) AS published_at",
    )
    return L.canonical_overrides(o).withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd")).withColumn("publication_year", F.col("publication_year").cast("long"))


@query("SELECT doc_id, array_to_string(list_filter(string_split(text, ' '), lambda w: w <> ''), ' ') AS abstract FROM documents")
def p9_reconstruct_abstract(spark, sf_dir):
    words = F.filter(F.split("text", " "), lambda w: w != "")
    index = L.invert_abstracts(table(spark, sf_dir, "documents"), words, "i")
    return index.select("doc_id", L.reconstruct_abstract(F.col("i")).alias("abstract"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '24.' || doc_id WHEN 1 THEN '1512.0' || doc_id WHEN 2 THEN 'cs' END AS arxiv_id FROM documents")
def p10_extract_arxiv_id(spark, sf_dir):
    doi = F.expr("IF(doc_id % 4 = 0, concat('https://doi.org/10.48550/ArXiv.24.', doc_id), IF(doc_id % 4 = 3, '10.1/x', NULL))")
    landing = F.expr("CASE doc_id % 4 WHEN 1 THEN concat('http://arXiv.org/abs/1512.0', doc_id, 'v12?x') WHEN 2 THEN 'http://arxiv.org/abs/cs/001' ELSE 'http://x.org' END")
    return table(spark, sf_dir, "documents").select("doc_id", L.extract_arxiv_id(doi, landing).alias("arxiv_id"))


_FIELDS = {"title": "IF(id % 2 = 0, 't', '')", "abstract": "IF(id % 3 = 0, 'a', NULL)", "publication_year": "IF(id % 4 = 0, 2000, NULL)", "doi": "IF(id % 5 = 0, 'd', NULL)", "url": "'u'", "journal_ref": "IF(id % 7 = 0, 'j', '')"}


def _papers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").selectExpr("doc_id AS id")
    return d.selectExpr("id", *(f"{e} AS {c}" for c, e in _FIELDS.items()), "IF(id % 11 = 0, 'r', NULL) AS reprint_doi", "IF(id % 22 = 0, 'c', NULL) AS canonical_doi")


@query("""SELECT doc_id AS id, concat_ws(',', CASE WHEN doc_id % 2 <> 0 THEN 'title' END, CASE WHEN doc_id % 3 <> 0 THEN 'abstract' END, CASE WHEN doc_id % 4 <> 0 THEN 'publication_year' END,
CASE WHEN doc_id % 5 <> 0 THEN 'doi' END, CASE WHEN doc_id % 7 <> 0 THEN 'journal_ref' END) AS missing FROM documents""")
def p11_missing_fields(spark, sf_dir):
    p = _papers(spark, sf_dir)
    return p.select("id", F.array_join(L.missing_fields(dict(p.dtypes)), ",").alias("missing"))


@query("""WITH f AS (SELECT doc_id AS id, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN 't' ELSE '' END, ''), CASE WHEN doc_id % 6 IN (1, 2) THEN 's2' END) AS title,
 coalesce(CASE WHEN doc_id % 3 = 0 THEN 'a' END, CASE WHEN doc_id % 8 < 4 THEN 'ax' END, CASE WHEN doc_id % 9 < 5 THEN 'cr' END) AS abstract,
 coalesce(CASE WHEN doc_id % 4 = 0 THEN 2000 END, CASE WHEN doc_id % 6 IN (1, 2) THEN 1999 END)::BIGINT AS publication_year,
 CASE WHEN doc_id % 11 = 0 AND doc_id % 22 <> 0 THEN NULL ELSE coalesce(CASE WHEN doc_id % 5 = 0 THEN 'd' END, CASE WHEN doc_id % 9 < 5 THEN 'crd' END) END AS doi,
 coalesce(CASE WHEN doc_id % 7 = 0 THEN 'j' END, CASE WHEN doc_id % 8 < 4 THEN 'aj' END) AS journal_ref,
 doc_id % 6 IN (1, 2) OR doc_id % 8 < 4 OR doc_id % 9 < 5 AS tried, doc_id % 420 = 0 AS before_ FROM documents)
SELECT id, title, abstract, publication_year, doi, 'u' AS url, journal_ref, CASE WHEN before_ OR (title IS NOT NULL AND abstract IS NOT NULL AND publication_year IS NOT NULL AND doi IS NOT NULL AND journal_ref IS NOT NULL) THEN 'complete' WHEN tried THEN 'partial' ELSE 'failed' END AS enrichment_status FROM f""")
def p12_fill_from_fallbacks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").selectExpr("doc_id AS id")
    s2 = d.filter("id % 6 IN (1, 2)").selectExpr("id", "'s2' AS title", "1999 AS publication_year")
    arxiv = d.filter("id % 8 < 4").selectExpr("id", "'ax' AS abstract", "'aj' AS journal_ref")
    crossref = d.filter("id % 9 < 5").selectExpr("id", "'cr' AS abstract", "'crd' AS doi")
    return L.fill_from_fallbacks(_papers(spark, sf_dir), [("s2", s2), ("arxiv", arxiv), ("crossref", crossref)]).withColumn("publication_year", F.col("publication_year").cast("long"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE source END AS journal FROM documents")
def p13_overlay(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    other = d.filter("doc_id % 2 = 0").selectExpr("doc_id AS id", "IF(doc_id % 4 = 0, 'new', '') AS journal")
    return L.overlay(d.selectExpr("doc_id AS id", "source AS journal"), other, ["journal"])


@query("""WITH b AS (SELECT * FROM (SELECT o_orderkey AS pos, o_totalprice, o_orderpriority, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE floor(o_totalprice / 1000)::BIGINT END AS u FROM orders) ORDER BY u DESC, pos LIMIT 200)
SELECT pos, u AS upvotes FROM b WHERE o_orderpriority LIKE '%URGENT%' ORDER BY u DESC, pos LIMIT 20""")
def p14_top_papers(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS pos", "o_orderpriority", "IF(o_orderkey % 10 = 0, NULL, cast(floor(o_totalprice / 1000) AS bigint)) AS upvotes")
    return L.top_papers(o, 20, F.col("o_orderpriority").contains("URGENT"), 200).select("pos", F.coalesce("upvotes", F.lit(0)).alias("upvotes"))


@query("""WITH d AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders)
SELECT strftime(d, '%Y-%m-%d') AS day, strftime(date_trunc('month', d) - INTERVAL 1 MONTH, '%Y-%m') AS last_month, strftime((date_trunc('week', d) - INTERVAL 7 DAY)::DATE, '%G-W%V') AS last_week FROM d""")
def p15_period_keys(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return days.select(F.date_format("d", "yyyy-MM-dd").alias("day"), L.period_keys(F.col("d")).alias("p")).select("day", "p.*")


@query()
def p16_match_report(spark, sf_dir):
    return L.match_report(L.match_seeds(seeds(spark, sf_dir), works(spark, sf_dir)))


@query("SELECT doc_id AS id, 'translation' AS what FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'topics' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def p17_pending(spark, sf_dir):
    d = table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "IF(doc_id % 3 = 0, '标题', '') AS title_zh")
    return L.pending(d, table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'zh' ELSE 'en' END AS original_language, CASE WHEN doc_id % 4 = 0 THEN '中文标题' || doc_id END AS title_zh, CASE WHEN doc_id % 4 = 0 THEN text END AS abstract_zh FROM documents")
def p18_copy_if_zh(spark, sf_dir):
    d = table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "IF(doc_id % 4 = 0, concat('中文标题', doc_id), concat('A title of ', source)) AS title", "text AS abstract", "CAST(NULL AS string) AS title_zh", "CAST(NULL AS string) AS abstract_zh")
    return L.copy_if_zh(d, detect_language(F.col("title"))).select("id", "original_language", "title_zh", "abstract_zh")


@query("SELECT d.doc_id AS id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE coalesce(l.quality = 1, true) OR d.source = 'src0'")
def r1_relevance_filter(spark, sf_dir):
    reports = table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "source")
    verdicts = table(spark, sf_dir, "labels").selectExpr("doc_id AS id", "quality = 1 AS verdict")
    return L.relevance_filter(reports, verdicts, [f"src{k}" for k in range(1, 20)]).select("id")


@query("SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN '其他' WHEN 1 THEN '其他' ELSE p_type END AS category FROM part")
def r2_default_category(spark, sf_dir):
    c = F.expr("CASE p_size % 3 WHEN 0 THEN array() WHEN 2 THEN array(p_type) END")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), L.default_category(c)[0].alias("category"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN ' & ' ELSE p_brand END AS institution FROM part")
def r3_first_institution(spark, sf_dir):
    raw = F.expr("IF(p_size % 3 = 0, ' & ', concat(' ', p_brand, ' 、', p_type))")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), L.first_institution(raw).alias("institution"))


_PDFS = "array(named_struct('url', concat('https://x.org/', p_partkey, IF(p_size % 4 = 1, '.pdf?x', '')), 'type', IF(p_size % 4 = 2, 'reader', ''), 'local_path', IF(p_size % 4 = 0, 'a.pdf', NULL)))"


@query("SELECT p_partkey AS id, CASE WHEN p_size % 4 = 1 THEN 'http' ELSE 'reader' END AS way FROM part WHERE p_size % 4 <> 0 ORDER BY p_size % 4 <> 1, p_partkey LIMIT 600")
def r4_pdf_backfill_plan(spark, sf_dir):
    return L.pdf_backfill_plan(table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_partkey AS pos", f"{_PDFS} AS pdf_urls"), 600)


@query("SELECT count(*) AS total, count(*) FILTER (p_size % 4 = 0) AS local FROM part")
def r5_pdf_summary(spark, sf_dir):
    return L.pdf_summary(table(spark, sf_dir, "part").selectExpr(f"{_PDFS} AS pdf_urls"))


@query("SELECT page_id, page_id % 3 = 0 AND strlen(html) >= 996 AS valid FROM pages")
def r6_pdf_valid(spark, sf_dir):
    content = F.expr("cast(concat(IF(page_id % 3 = 0, '%PDF', 'none'), html) AS binary)")
    return table(spark, sf_dir, "pages").select("page_id", L.pdf_valid(content).alias("valid"))
