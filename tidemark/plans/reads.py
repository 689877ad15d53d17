"""Queries of the read layer and of user state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import facets as C
from tidemark.operators import reads as R
from tidemark.operators import sinks as K
from tidemark.plans.bindings import ITEMS, NEWS_TOPICS, TAGS, item_tags, items, news_topics, table
from tidemark.registry import query

_SEL = f"{ITEMS}, sel AS (SELECT *, coalesce(ai_relevant AND ai_score >= 6, false) AS selected FROM items)"
_TOPICS = "topics AS (SELECT n_nationkey AS topic, n_name AS name, r_name AS group_name, n_nationkey % 8 <> 7 AS is_active FROM nation JOIN region ON n_regionkey = r_regionkey)"


def selected_items(spark, sf_dir):
    return items(spark, sf_dir).withColumn("selected", F.coalesce(F.col("ai_relevant") & (F.col("ai_score") >= 6), F.lit(False)))


def topics(spark, sf_dir):
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.selectExpr("n_nationkey AS topic", "n_name AS name", "r_name AS group_name", "n_nationkey % 8 != 7 AS is_active")


_PAGED = "SELECT id, (SELECT count(*) FROM f) AS total, greatest(1, ceil((SELECT count(*) FROM f) / {size}))::BIGINT AS pages FROM f ORDER BY {order} LIMIT {size} OFFSET {skip}"


@query(f"WITH {_SEL}, f AS (SELECT * FROM sel WHERE day = 3 AND ai_score >= 1 AND source_type = 's1') {_PAGED.format(size=5, skip=5, order='coalesce(ai_score, 0) DESC, id')}")
def q1_get_items(spark, sf_dir):
    return R.page(R.get_items(selected_items(spark, sf_dir), day=3, source_type="s1", min_score=1), "score", 2, 5).select("id", "total", "pages")


@query(f"WITH {_SEL} SELECT id, coalesce(ai_score, 0) AS cursor_key FROM sel WHERE source_type = 's1' AND (coalesce(ai_score, 0) < 5 OR coalesce(ai_score, 0) = 5 AND id > 100) ORDER BY cursor_key DESC, id LIMIT 20")
def q1_page_after(spark, sf_dir):
    """The page behind an item that was shown with a score of 5."""
    return R.page_after(R.get_items(items(spark, sf_dir), source_type="s1"), "score", 20, (5.0, 100)).select("id", "cursor_key")


@query(f"WITH {_SEL}, f AS (SELECT * FROM sel WHERE contains(lower(title), 'the') OR contains(lower(text), 'erth%')) {_PAGED.format(size=20, skip=0, order='published_sec DESC, id')}")
def q2_search(spark, sf_dir):
    found = selected_items(spark, sf_dir).filter(R.matches("THE", "title") | R.matches("erth%", "text"))
    return R.page(found, "newest", 1, 20).select("id", "total", "pages")


@query(f"WITH {_SEL} SELECT id FROM sel WHERE contains(lower(text), 'worthless')")
def q3_fulltext(spark, sf_dir):
    return R.fulltext(items(spark, sf_dir), "Worthless", "text").select("id")


@query(f"WITH {ITEMS}, {TAGS} SELECT id, source_type FROM items WHERE id IN (SELECT id FROM item_tags WHERE tag = 'the')")
def q4_tag_membership(spark, sf_dir):
    return R.get_items(items(spark, sf_dir), tag="the", tags=item_tags(spark, sf_dir)).select("id", "source_type")


@query(f"WITH {ITEMS}, {NEWS_TOPICS} SELECT id FROM items WHERE id NOT IN (SELECT id FROM news_topics WHERE topic IN (1, 7, 9))")
def q5_without_blocked(spark, sf_dir):
    return R.get_items(items(spark, sf_dir), blocked=news_topics(spark, sf_dir).filter("topic IN (1, 7, 9)")).select("id")


_LISTED = f"{NEWS_TOPICS}, {_TOPICS}, lists AS (SELECT id, string_agg(name, ',' ORDER BY topic) AS topics FROM news_topics JOIN topics USING (topic) GROUP BY id)"


@query(f"WITH {ITEMS}, {_LISTED} SELECT i.id, title, coalesce(topics, '') AS topics FROM items i LEFT JOIN lists l ON i.id = l.id WHERE i.id = 42")
def q6_get_item(spark, sf_dir):
    one = items(spark, sf_dir).filter("id = 42").select("id", "title")
    return R.with_topics(one, news_topics(spark, sf_dir), topics(spark, sf_dir)).withColumn("topics", F.array_join("topics", ","))


@query(f"WITH {ITEMS}, {_LISTED} SELECT i.id, coalesce(topics, '') AS topics FROM items i LEFT JOIN lists l ON i.id = l.id")
def q7_with_topics(spark, sf_dir):
    return R.with_topics(items(spark, sf_dir).select("id"), news_topics(spark, sf_dir), topics(spark, sf_dir)).withColumn("topics", F.array_join("topics", ","))


@query(f"WITH {TAGS} SELECT tag, count(*) AS n FROM item_tags GROUP BY tag HAVING count(*) >= 5")
def q8_tag_counts(spark, sf_dir):
    return R.tag_counts(item_tags(spark, sf_dir), 5)


@query(f"WITH {ITEMS}, c AS (SELECT CASE WHEN id % 29 = 0 THEN '' ELSE category END AS category, count(*) AS n FROM items GROUP BY 1) SELECT CASE WHEN coalesce(category, '') = '' THEN 'unknown' ELSE category END AS category, n FROM c")
def q9_category_counts(spark, sf_dir):
    return R.category_counts(items(spark, sf_dir).withColumn("category", F.expr("CASE WHEN id % 29 = 0 THEN '' ELSE category END")))


@query(f"WITH {ITEMS} SELECT count(*) AS total, nullif(round_even(avg(ai_score), 2), 0) AS avg_score, max(ai_score) AS max_score, count(DISTINCT source_type) AS sources FROM items")
def q10_stats(spark, sf_dir):
    return R.stats(items(spark, sf_dir))


@query("SELECT DISTINCT o_orderdate::DATE::VARCHAR AS day FROM orders ORDER BY day DESC LIMIT 12")
def q11_run_dates(spark, sf_dir):
    return R.latest(table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")), "day", 12)


_COUNTED = f"{_SEL}, {NEWS_TOPICS}, {_TOPICS}, tc AS (SELECT t.*, count(s.id) AS n FROM topics t LEFT JOIN news_topics b ON t.topic = b.topic LEFT JOIN sel s ON b.id = s.id AND selected WHERE is_active GROUP BY ALL)"


def _counted(spark, sf_dir):
    return R.topics_with_counts(topics(spark, sf_dir), news_topics(spark, sf_dir), selected_items(spark, sf_dir))


@query(f"WITH {_COUNTED} SELECT topic, name, group_name, n FROM tc")
def q12_topics_with_counts(spark, sf_dir):
    return _counted(spark, sf_dir).select("topic", "name", "group_name", "n")


@query(f"WITH {_COUNTED} SELECT group_name, string_agg(name || ':' || n, ',' ORDER BY topic) AS topics FROM tc GROUP BY group_name")
def q12_topics_by_group(spark, sf_dir):
    nested = R.nest_by_group(_counted(spark, sf_dir))
    return nested.select("group_name", F.array_join(F.transform("topics", lambda t: F.concat(t["name"], F.lit(":"), t["n"].cast("string"))), ",").alias("topics"))


@query(f"WITH {_TOPICS} SELECT topic, name FROM topics WHERE name = 'NATION_3' AND is_active OR topic = 5")
def q13_topic_by_slug(spark, sf_dir):
    return topics(spark, sf_dir).filter("(name = 'NATION_3' AND is_active) OR topic = 5").select("topic", "name")


@query(f"WITH {_SEL}, {NEWS_TOPICS}, f AS (SELECT * FROM sel WHERE selected AND id IN (SELECT id FROM news_topics WHERE topic = 4)) {_PAGED.format(size=10, skip=0, order='published_sec DESC, id')}")
def q14_topic_news(spark, sf_dir):
    return R.page(R.topic_items(selected_items(spark, sf_dir), news_topics(spark, sf_dir), 4, [9]), "newest", 1, 10).select("id", "total", "pages")


@query(f"WITH {_COUNTED} SELECT group_name, count(*) AS n FROM tc WHERE topic NOT IN (0, 5, 14, 15, 16) GROUP BY group_name")
def q15_filter_blocked_groups(spark, sf_dir):
    return R.filter_blocked_groups(R.nest_by_group(_counted(spark, sf_dir)), [0, 5, 14, 15, 16]).select("group_name", F.size("topics").cast("long").alias("n"))


@query(f"WITH {ITEMS} SELECT day, count(*) AS total, max(ai_score) AS max_score, count(DISTINCT source_type) AS sources FROM items WHERE day = 4 GROUP BY day")
def q16_daily_detail(spark, sf_dir):
    return R.stats(R.get_items(items(spark, sf_dir), day=4)).select(F.lit(4).cast("long").alias("day"), "total", "max_score", "sources")


@query(f"WITH {ITEMS}, {NEWS_TOPICS} SELECT id FROM items WHERE category IN ('src1', 'src3', 'src9') AND strftime(epoch_ms(published_sec * 1000), '%Y-%m') = '2024-01' AND lower(text) LIKE '%tion%' AND id IN (SELECT id FROM news_topics WHERE topic = 2)")
def q17_get_papers(spark, sf_dir):
    i = items(spark, sf_dir).filter(F.col("category").isin("src1", "src3", "src9") & (F.date_format(F.timestamp_seconds("published_sec"), "yyyy-MM") == "2024-01") & R.like("tion", "text"))
    return i.join(news_topics(spark, sf_dir).filter("topic = 2"), "id", "left_semi").select("id")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY ALL")
def q18_month_counts(spark, sf_dir):
    return R.month_counts(table(spark, sf_dir, "orders"), "o_orderdate")


@query(f"WITH {ITEMS}, {_LISTED} SELECT i.id, title, topics FROM items i JOIN lists l ON i.id = l.id WHERE i.id = 7")
def q19_get_paper(spark, sf_dir):
    one = items(spark, sf_dir).filter("id = 7").select("id", "title")
    return R.with_topics(one, news_topics(spark, sf_dir), topics(spark, sf_dir)).withColumn("topics", F.array_join("topics", ","))


@query(f"WITH {ITEMS}, {NEWS_TOPICS} SELECT id FROM items WHERE source_type = 's2' AND lower(text) LIKE '%th_r%' AND id IN (SELECT id FROM news_topics WHERE topic = 6)")
def q20_topic_papers(spark, sf_dir):
    i = items(spark, sf_dir).filter((F.col("source_type") == "s2") & R.like("th_r", "text"))
    return i.join(news_topics(spark, sf_dir).filter("topic = 6"), "id", "left_semi").select("id")


@query("SELECT r_name AS name, count(n_nationkey) AS n FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def q21_paper_topic_counts(spark, sf_dir):
    return table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"), "left").groupBy(F.col("r_name").alias("name")).agg(F.count("n_nationkey").alias("n"))


@query(f"WITH {ITEMS}, {TAGS} SELECT id FROM items WHERE contains(source_type, '3') AND id IN (SELECT id FROM item_tags WHERE tag IN ('the', 'de')) AND lower(text) LIKE '%ion%'")
def q22_get_reports(spark, sf_dir):
    tags = item_tags(spark, sf_dir).filter(F.col("tag").isin("the", "de")).select("id").distinct()
    return items(spark, sf_dir).filter(F.col("source_type").contains("3") & R.like("ion", "text")).join(tags, "id", "left_semi").select("id")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN '/files/' || p_partkey || '.pdf' ELSE 'https://x.org/' || p_partkey END AS link, p_size % 3 = 0 AS has_local_pdf FROM part")
def q23_get_report(spark, sf_dir):
    pdfs = F.expr("array(named_struct('url', concat('https://x.org/', p_partkey), 'local_path', IF(p_size % 3 = 0, concat('data/reports/', p_partkey, '.pdf'), NULL)))")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), pdfs.alias("pdfs"))
    moved = F.transform("pdfs", lambda p: F.coalesce(F.regexp_replace(p["local_path"], "^data/reports/", "/files/"), p["url"]))
    return rows.select("id", moved[0].alias("link"), F.exists("pdfs", lambda p: p["local_path"].isNotNull()).alias("has_local_pdf"))


_INST = r"list_filter(list_transform(regexp_split_to_array(p_brand || ' & ' || p_type || '；', '\s*[&,、;；]\s*'), lambda x: trim(x)), lambda x: x <> '')"


@query(f"SELECT institution, source, count(*) AS n FROM (SELECT unnest({_INST}) AS institution, p_size % 2 AS source FROM part) GROUP BY ALL")
def q24_institution_counts(spark, sf_dir):
    return R.institution_counts(table(spark, sf_dir, "part").selectExpr("concat(p_brand, ' & ', p_type, '；') AS names", "p_size % 2 AS source"), "names")


@query(f"""WITH {ITEMS}, a AS (SELECT 'news' AS kind, id, row_number() OVER (ORDER BY id) AS place FROM items WHERE contains(lower(title), 'an')),
b AS (SELECT 'pages', page_id, row_number() OVER (ORDER BY page_id) FROM pages WHERE contains(lower(url), 'an'))
SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE place <= 10""")
def q25_global_search(spark, sf_dir):
    return R.global_search("an", {"news": (items(spark, sf_dir), ["title"]), "pages": (table(spark, sf_dir, "pages").withColumnRenamed("page_id", "id"), ["url"])}, 10)


@query(f"WITH {ITEMS} SELECT coalesce(printf('%.1f', avg(ai_score) FILTER (ai_score <> 0)), '—') AS mean_score FROM (SELECT * FROM items ORDER BY coalesce(ai_score, 0) DESC, id LIMIT 200)")
def q26_mean_score(spark, sf_dir):
    return R.mean_score_label(items(spark, sf_dir).orderBy(*R.SORTS["score"]()).limit(200))


@query(f"WITH {_SEL}, {_LISTED} SELECT i.id, i.title, i.published_sec, coalesce(topics, '') AS topics FROM sel i LEFT JOIN lists l ON i.id = l.id WHERE selected")
def q27_items_index(spark, sf_dir):
    i = selected_items(spark, sf_dir).filter("selected").select("id", "title", "published_sec")
    return R.with_topics(i, news_topics(spark, sf_dir), topics(spark, sf_dir)).withColumn("topics", F.array_join("topics", ","))


@query(f"WITH {_SEL}, f AS (SELECT * FROM sel WHERE coalesce(ai_score, 0) >= 0 AND contains(lower(title), 'th')) {_PAGED.format(size=15, skip=15, order='title, id')}")
def q28_snapshot_query(spark, sf_dir):
    i = selected_items(spark, sf_dir).withColumn("ai_score", F.coalesce("ai_score", F.lit(0.0)))
    return R.page(R.get_items(i, min_score=0).filter(R.matches("th", "title")), "title", 2, 15).select("id", "total", "pages")


_STATE = """state AS (SELECT event_id, user_id, event_id % 1000 AS item_id, floor(epoch(ts))::BIGINT AS sec, CASE WHEN event_type IN ('signup', 'click', 'view') THEN 'add' ELSE 'remove' END AS action FROM events),
fav AS (SELECT user_id, item_id, sec FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY sec DESC, event_id DESC) AS n FROM state) WHERE n = 1 AND action = 'add')"""


def _state(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "event_id % 1000 AS item_id", "unix_seconds(cast(ts AS timestamp)) AS sec", "CASE WHEN event_type IN ('signup', 'click', 'view') THEN 'add' ELSE 'remove' END AS action")


@query(f"WITH {_STATE} SELECT user_id, item_id, sec FROM fav")
def u1_apply_favorites(spark, sf_dir):
    return R.favorites_of(_state(spark, sf_dir))


@query(f"WITH {ITEMS}, {_STATE} SELECT id, id IN (SELECT item_id FROM fav WHERE user_id = 5) AS favorited FROM items")
def u2_flag_favorited(spark, sf_dir):
    return R.flag_favorited(items(spark, sf_dir).select("id"), R.favorites_of(_state(spark, sf_dir)), 5)


@query(f"WITH {ITEMS}, {_STATE} SELECT id, sec FROM items JOIN fav ON id = item_id WHERE user_id = 5 AND source_type <> 's0' ORDER BY sec DESC, id LIMIT 10 OFFSET 3")
def u3_favorites(spark, sf_dir):
    mine = R.favorites_of(_state(spark, sf_dir)).filter("user_id = 5").withColumnRenamed("item_id", "id")
    return items(spark, sf_dir).filter("source_type != 's0'").join(mine, "id").orderBy(F.desc("sec"), "id").offset(3).limit(10).select("id", "sec")


_PREF = """pref AS (SELECT user_id, event_id % 25 AS topic, arg_max(CASE event_type WHEN 'click' THEN 'subscribed' WHEN 'error' THEN 'blocked' ELSE 'cleared' END, floor(epoch(ts))::BIGINT * 1000000 + event_id) AS pref FROM events GROUP BY ALL)"""


def _prefs(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("user_id", "event_id % 25 AS topic", "event_id", "unix_seconds(cast(ts AS timestamp)) AS sec", "CASE event_type WHEN 'click' THEN 'subscribed' WHEN 'error' THEN 'blocked' ELSE 'cleared' END AS pref")
    return R.latest_state(e, ["user_id", "topic"], "pref", ["sec", "event_id"])


@query(f"WITH {_PREF} SELECT * FROM pref")
def u4_topic_pref(spark, sf_dir):
    return _prefs(spark, sf_dir)


@query(f"WITH {_PREF}, {_TOPICS} SELECT user_id, pref, string_agg(name, ',' ORDER BY name) AS names FROM pref JOIN topics USING (topic) WHERE pref <> 'cleared' GROUP BY ALL")
def u5_topic_prefs(spark, sf_dir):
    named = _prefs(spark, sf_dir).filter("pref != 'cleared'").join(topics(spark, sf_dir).select("topic", "name"), "topic")
    return named.groupBy("user_id", "pref").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))


@query("""WITH m AS (SELECT 'u' || user_id AS sender, CASE WHEN event_type = 'click' THEN 'SUBSCRIBE' ELSE 'UNSUBSCRIBE' END AS word, floor(epoch(ts))::BIGINT * 1000000 + event_id AS o FROM events WHERE event_type IN ('click', 'error') AND user_id % 9 <> 0)
SELECT sender FROM (SELECT sender, arg_max(word, o) AS w FROM m GROUP BY sender) WHERE w = 'SUBSCRIBE'""")
def u6_subscribers(spark, sf_dir):
    m = table(spark, sf_dir, "events").selectExpr("event_id", "unix_seconds(cast(ts AS timestamp)) AS sec", "IF(user_id % 9 = 0, 'No-Reply@x', concat('U', user_id)) AS sender", "CASE event_type WHEN 'click' THEN ' subscribe ' WHEN 'error' THEN 'Unsubscribe' ELSE 're: subscribe' END AS subject")
    return R.subscribers(m)


@query("""WITH l AS (SELECT event_type AS provider, event_id % 7 - 2 AS i, user_id % 5 - 1 AS o FROM events)
SELECT provider, sum(greatest(0, i))::BIGINT AS tokens_in, sum(greatest(0, o))::BIGINT AS tokens_out, count(*) AS calls FROM l WHERE i > 0 OR o > 0 GROUP BY provider""")
def u7_usage_by_provider(spark, sf_dir):
    return R.usage_by_provider(table(spark, sf_dir, "events").selectExpr("event_type AS provider", "event_id % 7 - 2 AS tokens_in", "user_id % 5 - 1 AS tokens_out"))


@query(f"""WITH {ITEMS}, {NEWS_TOPICS}, i AS (SELECT id, source_type, category, ai_score, CASE WHEN id % 20 = 4 THEN 3 ELSE day END AS day FROM items WHERE NOT (id % 10 = 3 AND id % 4 = 1)),
f AS (SELECT 'source_type' AS facet, source_type AS value, ai_score FROM i UNION ALL SELECT 'category', category, ai_score FROM i
UNION ALL SELECT 'topic', topic::VARCHAR, ai_score FROM i JOIN news_topics USING (id) UNION ALL SELECT '*', NULL, ai_score FROM i)
SELECT facet, value, count(*) AS n, count(ai_score) AS scored, round(avg(ai_score), 6) AS avg_score, max(ai_score) AS max_score FROM f GROUP BY facet, value""")
def q9_kept_facets(spark, sf_dir):
    """Facets of ten dates; then one date is saved anew, without some of its items and with some of another date, and refreshed."""
    out = K.workdir(spark, "facets")
    all_items = items(spark, sf_dir).select("id", "source_type", "category", "ai_score", "day")
    topics_of = {"source_type": F.col("source_type"), "category": F.col("category"), "topic": F.expr("array(id % 25, (id * 7) % 25)")}
    dated = all_items.withColumn("run_date", F.expr("date_add(DATE '2024-01-01', cast(day AS int))"))
    K.replace_slots(spark, f"{out}/items", dated.withColumn(K.SLOT, F.col("run_date").cast("string")), set())
    C.refresh_facets(spark, f"{out}/items", all_items.schema, f"{out}/facets", topics_of)
    K.save_items(spark, f"{out}/items", all_items.filter("(day = 3 AND id % 4 != 1) OR id % 20 = 4"), "2024-01-04")
    C.refresh_facets(spark, f"{out}/items", all_items.schema, f"{out}/facets", topics_of)
    kept = [C.facet_counts(spark, f"{out}/facets", facet).withColumn("facet", F.lit(facet)) for facet in ("*", *topics_of)]
    return reduce(DataFrame.unionByName, kept).select("facet", "value", "n", "scored", "avg_score", "max_score")
