"""Queries of topics and interests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import subjects as S
from tidemark.plans.bindings import ITEMS, NEWS_TOPICS, items, news_topics, table
from tidemark.registry import query

_TERMS = {"alpha": ["ertion", "the th"], "beta": ["que la", "de la"], "gamma": ["heit", "schen"], "delta": ["no such words"]}
_PAPERS = "p AS (SELECT doc_id AS id, lower(text) AS t, CASE doc_id % 4 WHEN 0 THEN ['cs.LG', 'cs.AI', 'x'] WHEN 1 THEN ['Topic Modeling', 'Natural Language Processing Techniques', 'cs.CL'] ELSE [] END AS c FROM documents)"
_HITS = ", ".join(f"('{slug}', {n})" for n, slug in enumerate(_TERMS))
_CASES = " UNION ALL ".join(f"SELECT id, '{slug}' AS slug, 0.7 AS confidence, 'keyword: ' || CASE " + " ".join(f"WHEN contains(t, '{w}') THEN '{w}'" for w in words) + " END AS reason FROM p WHERE " + " OR ".join(f"contains(t, '{w}')" for w in words) for slug, words in _TERMS.items())


@query(f"""WITH {_PAPERS}, a AS (
SELECT id, 'machine-learning' AS slug, 0.85 AS confidence, 'arXiv category: cs.LG' AS reason FROM p WHERE id % 4 = 0
UNION ALL SELECT id, 'nlp-llm', 0.85, 'catalogue topic: Natural Language Processing Techniques' FROM p WHERE id % 4 = 1 UNION ALL {_CASES})
SELECT id, slug, confidence::DOUBLE AS confidence, reason FROM a UNION ALL SELECT id, 'other', 0.5, 'no topic matched' FROM p WHERE id NOT IN (SELECT id FROM a)""")
def t1_paper_topics(spark, sf_dir):
    cats = "CASE doc_id % 4 WHEN 0 THEN array('cs.LG', 'cs.AI', 'x') WHEN 1 THEN array('Topic Modeling', 'Natural Language Processing Techniques', 'cs.CL') ELSE array() END"
    papers = table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "text AS title", "CAST(NULL AS string) AS abstract", f"{cats} AS categories")
    return S.paper_topics(papers, _TERMS)


@query("""SELECT event_id AS id, event_type AS slug, CASE WHEN event_id % 2 = 0 THEN 'N' || user_id ELSE event_type END AS name, CASE WHEN event_id % 3 = 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence
FROM events WHERE event_id % 7 <> 6""")
def t2_clean_topic_response(spark, sf_dir):
    one = "concat('{\"slug\": \" ', event_type, '\"', IF(event_id % 2 = 0, concat(', \"name\": \"N', user_id, ' \"'), ''), IF(event_id % 3 = 0, ', \"confidence\": 0.9', ''), '}')"
    answer = f"IF(event_id % 7 = 6, 'not json', concat('[', {one}, ', {{\"slug\": \"  \"}}]'))"
    return S.clean_topic_response(table(spark, sf_dir, "events").selectExpr("event_id AS id", f"{answer} AS response"))


_FORMS = f"r AS (SELECT id, 't' || topic AS slug, CASE WHEN topic % 3 = 0 THEN '{S.CONTENT_FORM}' ELSE 'field' END AS group_name, 0.8 AS confidence FROM news_topics)"


@query(f"WITH {NEWS_TOPICS}, {_FORMS} SELECT id, slug, group_name, confidence::DOUBLE AS confidence FROM r UNION ALL SELECT id, '{S.DEFAULT_FORM}', '{S.CONTENT_FORM}', 0.5 FROM r GROUP BY id HAVING NOT bool_or(group_name = '{S.CONTENT_FORM}')")
def t3_ensure_content_form(spark, sf_dir):
    rows = news_topics(spark, sf_dir).selectExpr("id", "concat('t', topic) AS slug", f"IF(topic % 3 = 0, '{S.CONTENT_FORM}', 'field') AS group_name", "0.8D AS confidence")
    return S.ensure_content_form(rows)


_SLUGS = "rows_ AS (SELECT event_id AS pos, event_id % 1000 AS id, 'NATION_' || (event_id % 30) AS slug, (event_id % 10) / 10.0 AS confidence FROM events), active AS (SELECT n_nationkey AS topic, n_name AS slug FROM nation WHERE n_nationkey % 4 <> 1)"


def _attached(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id AS pos", "event_id % 1000 AS id", "concat('NATION_', event_id % 30) AS slug", "(event_id % 10) / 10.0D AS confidence")
    return S.attach_topics(rows, table(spark, sf_dir, "nation").selectExpr("n_nationkey AS topic", "n_name AS slug", "n_nationkey % 4 != 1 AS is_active"))


@query(f"WITH {_SLUGS} SELECT id, topic, arg_max(confidence, pos)::DOUBLE AS confidence FROM rows_ JOIN active USING (slug) GROUP BY id, topic")
def t4_attach_topics(spark, sf_dir):
    return _attached(spark, sf_dir)[0]


@query(f"WITH {_SLUGS} SELECT pos, slug FROM rows_ WHERE slug NOT IN (SELECT slug FROM active)")
def t4_rejected_topics(spark, sf_dir):
    return _attached(spark, sf_dir)[1].select("pos", "slug")


@query("""WITH o AS (SELECT p_brand AS slug, min(p_name) AS name, min(p_size)::INTEGER AS sort_order FROM part GROUP BY p_brand), n AS (SELECT p_brand || CASE WHEN p_brand LIKE '%1' THEN 'x' ELSE '' END AS slug, 'new' AS name, 1 AS sort_order FROM part WHERE p_brand LIKE '%1' OR p_brand LIKE '%2' GROUP BY ALL)
SELECT coalesce(o.slug, n.slug) AS slug, coalesce(n.name, o.name) AS name, coalesce(n.sort_order, o.sort_order)::INTEGER AS sort_order FROM o FULL JOIN n ON o.slug = n.slug""")
def t5_seed_topics(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    old = p.groupBy(F.col("p_brand").alias("slug")).agg(F.min("p_name").alias("name"), F.min("p_size").cast("int").alias("sort_order"))
    new = p.filter("p_brand LIKE '%1' OR p_brand LIKE '%2'").selectExpr("concat(p_brand, IF(p_brand LIKE '%1', 'x', '')) AS slug", "'new' AS name", "1 AS sort_order").distinct()
    return S.seed_topics(old, new)


_PACKAGED = [(kind, slug, group) for kind, groups in (("news", S.NEWS_GROUPS), ("paper", S.PAPER_GROUPS)) for group, slugs in groups.items() for slug in slugs]
_NEWS_COUNT = len([1 for kind, *_ in _PACKAGED if kind == "news"])


@query(f"""WITH tax(kind, slug, group_name) AS (VALUES {", ".join(map(str, _PACKAGED))}), used AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'paper' ELSE 'news' END AS kind, o_custkey % 50 + 1 AS at_, count(*) AS n FROM orders GROUP BY ALL)
SELECT t.kind, t.slug, t.group_name, coalesce(n, 0) AS n FROM (SELECT kind, slug, group_name, list_position([{", ".join(f"'{kind}:{slug}'" for kind, slug, _ in _PACKAGED)}], kind || ':' || slug) - CASE kind WHEN 'paper' THEN {_NEWS_COUNT} ELSE 0 END AS at_ FROM tax) t LEFT JOIN used USING (kind, at_)""")
def t6_taxonomy_use(spark, sf_dir):
    """How many orders fall under each packaged topic, those without any too; the customer decides the topic's place."""
    used = table(spark, sf_dir, "orders").selectExpr("IF(o_orderkey % 3 = 0, 'paper', 'news') AS kind", "cast(10 * (o_custkey % 50 + 1) AS int) AS sort_order").groupBy("kind", "sort_order").agg(F.count("*").alias("n"))
    return S.taxonomy(spark).join(used, ["kind", "sort_order"], "left").select("kind", "slug", "group_name", F.coalesce("n", F.lit(0)).alias("n"))


_FORM = "CASE topic % 5 WHEN 0 THEN 'model-release' WHEN 1 THEN 'paper-research' WHEN 2 THEN 'odd-form' ELSE 'expert-opinion' END"
_NAMED = "CASE slug " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.SECTIONS.items()) + f" ELSE coalesce(slug, '{S.DEFAULT_SECTION}') END"
_SECTIONED = f"{ITEMS}, {NEWS_TOPICS}, f AS (SELECT id, arg_min({_FORM}, topic) AS slug FROM news_topics WHERE topic % 2 = 0 GROUP BY id), sec AS (SELECT i.id, pos, ai_score, {_NAMED} AS section FROM items i LEFT JOIN f ON i.id = f.id)"


def _sectioned(spark, sf_dir):
    bridge = news_topics(spark, sf_dir).selectExpr("id", f"{_FORM} AS slug", f"IF(topic % 2 = 0, '{S.CONTENT_FORM}', 'field') AS group_name", "topic AS pos")
    return S.sections(items(spark, sf_dir).select("id", "pos", "ai_score"), bridge)


@query(f"WITH {_SECTIONED} SELECT id, section FROM sec")
def t7_section_of(spark, sf_dir):
    return _sectioned(spark, sf_dir).select("id", "section")


@query(f"WITH {_SECTIONED} SELECT section, id FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY coalesce(ai_score, 0) DESC, pos) AS n FROM sec) WHERE n = 1")
def t7_top_per_section(spark, sf_dir):
    return S.top_per_section(_sectioned(spark, sf_dir)).select("section", "id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'worthless') OR contains(lower(source), 'src11')")
def t8_filter_by_keywords(spark, sf_dir):
    return S.filter_by_keywords(table(spark, sf_dir, "documents"), ["Worthless", "SRC11"], ["text", "source"]).select("doc_id")


@query("SELECT count(*) AS n FROM documents")
def t8_no_keyword_matches(spark, sf_dir):
    return S.filter_by_keywords(table(spark, sf_dir, "documents"), ["no such text"], ["source"]).agg(F.count("*").alias("n"))


#: Configured sources of the queries: a word, the number of its domain.
_SOURCES = [(word, k) for k, words in enumerate((["copper", "steel", "tin"], ["small", "large"], ["red", "green", "blue", "burnished"], ["anodized", "polished"])) for word in words]
_INTERESTS = "i AS (SELECT p_partkey AS interest_id, lower(p_name || ' ' || p_type) AS t, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS w FROM part)"


def _interests(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS interest_id", "concat(p_name, ' ', p_type) AS text")


@query(f"""WITH {_INTERESTS}, s(word, k) AS (VALUES {", ".join(map(str, _SOURCES))}),
m AS (SELECT interest_id, 's' || k || ':' || word AS key, least(1.0, (CASE WHEN contains(t, word) THEN 10 ELSE 0 END + CASE WHEN contains(t, 'x' || k) OR contains(t, word) THEN 5 ELSE 0 END
 + 3 * len(list_filter(w, lambda x: length(x) >= 3 AND (x = word OR x = 'about')))) / 10.0 / greatest(1, len(w))) AS score FROM i, s)
SELECT interest_id, key, score::DOUBLE AS score FROM m WHERE score >= 0.1""")
def t9_interest_match(spark, sf_dir):
    sources = spark.createDataFrame(_SOURCES, "word string, k int")
    sources = sources.selectExpr("concat('s', k, ':', word) AS key", "array(word) AS keywords", "array(array(concat('x', k), word)) AS tags", "concat('About ', word) AS description", "k AS pos")
    return S.interest_match(_interests(spark, sf_dir), sources)


@query(f"""WITH {_INTERESTS}, s(word, k) AS (VALUES {", ".join(map(str, _SOURCES))}), d AS (SELECT k, list(word) AS keywords FROM s GROUP BY k),
m AS (SELECT interest_id, 'd' || k AS key, least(1.0, (10 * len(list_filter(keywords, lambda x: contains(t, x))) + 3 * len(list_filter(keywords, lambda x: contains(t, substr(x, 1, 4))))) / 10.0 / len(keywords)) AS score FROM i, d)
SELECT interest_id, key, score::DOUBLE AS score FROM m WHERE score >= 0.1""")
def t9_domain_match(spark, sf_dir):
    sources = spark.createDataFrame(_SOURCES, "word string, k int")
    domains = sources.groupBy(F.concat(F.lit("d"), F.col("k").cast("string")).alias("key")).agg(F.collect_list(F.upper("word")).alias("keywords"), F.collect_list(F.substring("word", 1, 4)).alias("tags"))
    return S.domain_match(_interests(spark, sf_dir), domains)
