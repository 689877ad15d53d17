"""Queries of writers, texts and streams; what is written is read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import render as O
from tidemark.operators import sinks as K
from tidemark.plans.bindings import ITEMS, NEWS_TOPICS, TAGS, item_tags, items, news_topics, table
from tidemark.plans.reads import _SEL, _TOPICS, selected_items, topics
from tidemark.registry import query
from tidemark.streaming import jobs as J


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 10 IN (3, 4) THEN 'b' ELSE 'a' END AS v, CASE WHEN doc_id % 10 IN (3, 4) THEN '2024-01-04' ELSE '2024-01-0' || (doc_id % 5 + 1) END AS run_date
FROM documents WHERE NOT (doc_id % 5 = 3 AND doc_id % 10 NOT IN (3, 4))""")
def w1_save_items(spark, sf_dir):
    d = table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "'a' AS v", "doc_id % 5 AS day")
    path = K.workdir(spark, "items")
    for day in range(5):
        K.save_items(spark, path, d.filter(f"day = {day}").select("id", "v"), f"2024-01-0{day + 1}")
    K.save_items(spark, path, d.filter("id % 10 IN (3, 4)").selectExpr("id", "'b' AS v"), "2024-01-04")
    return K.read_items(spark, path, d.select("id", "v").schema).select("id", "v", F.date_format("run_date", "yyyy-MM-dd").alias("run_date"))


_OLD = "o AS (SELECT doc_id AS id, source AS title, CASE WHEN doc_id % 2 = 0 THEN 'raw' END AS raw, 'first' AS published FROM documents WHERE doc_id % 3 <> 0)"
_NEW = "n AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END AS title, CASE WHEN doc_id % 8 < 3 THEN 'new raw' END AS raw, 'second' AS published FROM documents WHERE doc_id % 5 <> 0)"


def _old_new(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    old = d.filter("doc_id % 3 != 0").selectExpr("doc_id AS id", "source AS title", "IF(doc_id % 2 = 0, 'raw', NULL) AS raw", "'first' AS published")
    return old, d.filter("doc_id % 5 != 0").selectExpr("doc_id AS id", "IF(doc_id % 4 = 0, NULL, lang) AS title", "IF(doc_id % 8 < 3, 'new raw', NULL) AS raw", "'second' AS published")


@query(f"WITH {_OLD}, {_NEW} SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.title ELSE o.title END AS title, coalesce(n.raw, o.raw) AS raw, CASE WHEN n.id IS NOT NULL THEN n.published ELSE o.published END AS published FROM o FULL JOIN n ON o.id = n.id")
def w2_upsert_items(spark, sf_dir):
    return K.upsert(*_old_new(spark, sf_dir), {"raw": "fill"})


@query("SELECT doc_id AS id, CASE WHEN doc_id % 50 = 0 AND doc_id % 4 <> 0 THEN lang ELSE source END AS title, CASE WHEN doc_id % 50 = 0 THEN 'second' ELSE 'first' END AS seen, 'first' AS published FROM documents")
def w2_upsert_table(spark, sf_dir):
    """A table of all documents, and a second arrival of every fiftieth merged into the buckets that hold it."""
    d, path = table(spark, sf_dir, "documents"), K.workdir(spark, "papers")
    policy = {"title": "fill", "published": "keep"}
    K.upsert_table(spark, path, d.selectExpr("doc_id AS id", "source AS title", "'first' AS seen", "'first' AS published"), policy)
    again = d.filter("doc_id % 50 = 0").selectExpr("doc_id AS id", "IF(doc_id % 4 = 0, NULL, lang) AS title", "'second' AS seen", "'second' AS published")
    K.upsert_table(spark, path, again, policy)
    return K.read_slots(spark, path, again.schema)


@query(f"WITH {_SEL} SELECT id, selected, CASE WHEN NOT selected THEN CASE WHEN ai_relevant IS TRUE THEN 'score' ELSE 'relevance' END END AS drop_reason FROM sel")
def w3_mark_selected(spark, sf_dir):
    i = selected_items(spark, sf_dir)
    reasons = i.filter("NOT selected").select("id", F.when(F.col("ai_relevant").eqNullSafe(True), "score").otherwise("relevance").alias("drop_reason"))
    return K.mark_selected(items(spark, sf_dir), i.filter("selected"), reasons).select("id", "selected", "drop_reason")


@query(f"WITH {_SEL} SELECT day, count(*) AS total_fetched, count(*) FILTER (selected) AS total_selected, string_agg(DISTINCT d.lang, ',' ORDER BY d.lang) AS languages FROM sel JOIN documents d ON sel.id = d.doc_id GROUP BY day")
def w4_daily_runs(spark, sf_dir):
    return K.daily_runs(selected_items(spark, sf_dir).join(table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "lang"), "id"))


@query(f"WITH {_OLD}, {_NEW} SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.title ELSE o.title END AS title, CASE WHEN o.id IS NOT NULL THEN o.published ELSE n.published END AS published FROM o FULL JOIN n ON o.id = n.id")
def w5_save_papers(spark, sf_dir):
    return K.upsert(*_old_new(spark, sf_dir), {"published": "keep"}).select("id", "title", "published")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'set' ELSE json_extract_string(props, '$.k') END AS category, NULL::VARCHAR AS cover FROM events")
def w6_evolve_schema(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id", "IF(event_id % 2 = 0, 'set', NULL) AS category", "replace(props, '\"k\"', '\"category\"') AS metadata_json")
    return K.evolve_schema(e, {"cover": "string"}).select("event_id", "category", "cover")


@query(f"""WITH {_SEL}, r AS (SELECT 'run' || (day % 3) AS run_id, * FROM sel)
SELECT run_id, count(*) AS raw, count(*) FILTER (ai_score IS NOT NULL) AS scored, nullif(count(*) FILTER (selected AND run_id <> 'run2'), 0) AS filtered, NULL::BIGINT AS enriched FROM r GROUP BY run_id""")
def w7_stage_runs(spark, sf_dir):
    path, i = K.workdir(spark, "stages"), selected_items(spark, sf_dir).select("id", "day", "ai_score", "selected")
    for k in range(3):
        run = i.filter(f"day % 3 = {k}")
        for stage, rows in (("raw", run), ("scored", run.filter("ai_score IS NOT NULL")), ("filtered", run.filter("selected"))):
            if stage != "filtered" or k != 2:
                K.save_stage(spark, path, f"run{k}", stage, rows)
    return K.list_runs(spark.read.parquet(path))


@query(f"WITH {_SEL} SELECT id FROM sel WHERE ai_score IS NOT NULL")
def w7_load_latest_stage(spark, sf_dir):
    path, i = K.workdir(spark, "stages"), selected_items(spark, sf_dir).select("id", "ai_score")
    K.save_stage(spark, path, "run1", "raw", i)
    K.save_stage(spark, path, "run1", "scored", i.filter("ai_score IS NOT NULL"))
    return K.load_stage(spark, path, "run1").select("id")


_NAMES = "lists AS (SELECT id, string_agg(DISTINCT name, ',' ORDER BY name) AS topics FROM named GROUP BY id)"


@query(f"""WITH {_SEL}, {NEWS_TOPICS}, {_TOPICS}, {TAGS},
chosen AS (SELECT * FROM sel WHERE selected), named AS (SELECT b.id, t.topic, name FROM news_topics b JOIN topics t ON b.topic = t.topic JOIN chosen c ON b.id = c.id WHERE is_active), {_NAMES},
runs AS (SELECT day, count(*) AS total_fetched, count(*) FILTER (selected) AS total_selected, string_agg(DISTINCT d.lang, ',' ORDER BY d.lang) AS languages FROM sel JOIN documents d ON sel.id = d.doc_id GROUP BY day ORDER BY day DESC LIMIT 30)
SELECT 'runs' AS artefact, concat_ws('|', day, total_fetched, total_selected, languages) AS line FROM runs
UNION ALL SELECT 'daily', concat_ws('|', day, total_fetched, total_selected, languages) FROM runs
UNION ALL SELECT 'runs_dates', concat_ws('|', day) FROM (SELECT DISTINCT day FROM sel)
UNION ALL SELECT 'daily_detail', concat_ws('|', c.id, day, url, category, topics) FROM chosen c LEFT JOIN lists l ON c.id = l.id
UNION ALL SELECT 'topics', concat_ws('|', t.topic, name, n) FROM (SELECT t.topic, t.name, count(n.id) AS n FROM topics t LEFT JOIN named n ON t.topic = n.topic WHERE is_active GROUP BY ALL) t
UNION ALL SELECT 'items_index', concat_ws('|', id, title, day) FROM chosen
UNION ALL SELECT 'categories', concat_ws('|', coalesce(category, 'unknown'), count(*)) FROM chosen GROUP BY category
UNION ALL SELECT 'tags', concat_ws('|', tag, count(*)) FROM item_tags JOIN chosen USING (id) GROUP BY tag
UNION ALL SELECT 'stats', concat_ws('|', count(*), count(*) FILTER (selected), count(DISTINCT day)) FROM sel
UNION ALL SELECT 'papers', concat_ws('|', o_orderkey, o_orderstatus) FROM orders
UNION ALL SELECT 'paper_topics', concat_ws('|', 's' || (o_custkey % 7), count(*)) FROM orders GROUP BY o_custkey % 7
UNION ALL SELECT 'reports', concat_ws('|', p_partkey, p_brand) FROM part
UNION ALL SELECT 'report_institutions', concat_ws('|', p_size % 2, p_brand, count(*)) FROM part GROUP BY p_size % 2, p_brand""")
def w8_export_static(spark, sf_dir):
    """All thirteen artefacts are written, then each is read back as lines of its main fields."""
    out, i = K.workdir(spark, "export"), selected_items(spark, sf_dir)
    runs = K.daily_runs(i.join(table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "lang"), "id"))
    papers = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_orderstatus AS source")
    paper_topics = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "concat('s', o_custkey % 7) AS slug")
    reports = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_size % 2 AS source", "p_brand AS institution")
    named = topics(spark, sf_dir).withColumnRenamed("group_name", "grp")
    artefacts = K.site_artefacts(i, runs, named, news_topics(spark, sf_dir), item_tags(spark, sf_dir), papers, paper_topics, reports)
    K.export_static(artefacts, out, ("daily_detail",))
    lines = {
        "runs": "day, total_fetched, total_selected, languages", "daily": "day, total_fetched, total_selected, languages", "runs_dates": "day", "daily_detail": "id, day, url, category, array_join(topics, ',')",
        "topics": "topic, name, n", "items_index": "id, title, day", "categories": "category, n", "tags": "tag, n", "stats": "total_items, total_selected, total_days", "papers": "id, source",
        "paper_topics": "slug, n", "reports": "id, institution", "report_institutions": "source, institution, n",
    }
    read = [spark.read.schema(artefacts[name].schema).json(f"{out}/{name}").selectExpr(f"'{name}' AS artefact", f"concat_ws('|', {line}) AS line") for name, line in lines.items()]
    return reduce(DataFrame.union, read)


@query(f"WITH {ITEMS}, {NEWS_TOPICS}, {_TOPICS} SELECT DISTINCT day, t.topic, name FROM items i JOIN news_topics b ON i.id = b.id JOIN topics t ON b.topic = t.topic")
def w9_topics_per_date(spark, sf_dir):
    return K.topics_per_date(topics(spark, sf_dir), items(spark, sf_dir), news_topics(spark, sf_dir))


def _texts(spark, sf_dir):
    extra = {"title_en": F.lit(""), "title_zh": F.concat(F.lit("标题"), F.col("id").cast("string")), "feed_name": F.when(F.col("id") % 2 == 0, "feed"), "author": F.lit("ann"), "discussion_url": F.when(F.col("id") % 3 == 0, F.col("url")).when(F.col("id") % 3 == 1, "https://d.org"), "ai_reason": F.lit("because"), "ai_summary": F.lit("sum")}
    return selected_items(spark, sf_dir).filter("selected").withColumns(extra)


@query(f"""WITH {_SEL} SELECT id, replace(replace(title, '[', '('), ']', ')') AS title, source_type || ' · ' || CASE WHEN id % 2 = 0 THEN 'feed' ELSE 'ann' END || ' · ' || strftime(epoch_ms(published_sec * 1000), '%b %-d, %H:%M')
|| CASE WHEN id % 3 = 1 THEN ' · [Discussion](https://d.org)' ELSE '' END AS line FROM sel WHERE selected""")
def o1_digest_item_fields(spark, sf_dir):
    return _texts(spark, sf_dir).select("id", O.shown_title("en").alias("title"), O.source_line("en").alias("line"))


@query()
def o1_digest_item_markdown(spark, sf_dir):
    t = O.ranked(_texts(spark, sf_dir))
    return t.select("id", O.item_markdown("en", F.col("place")).alias("en"), O.item_markdown("zh", F.col("place")).alias("zh"))


@query()
def o2_daily_digest_markdown(spark, sf_dir):
    days = items(spark, sf_dir).groupBy("day").agg(F.count("*").alias("total"))
    t = O.ranked(_texts(spark, sf_dir)).filter("place <= 30").drop("place")
    return O.daily_digest(t, days, "en").withColumn("lang", F.lit("en")).unionByName(O.daily_digest(t, days, "zh").withColumn("lang", F.lit("zh")))


@query(f"""WITH {_SEL}, r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ai_score DESC, id) AS place FROM sel WHERE selected)
SELECT day, string_agg(place || '. [' || replace(replace(title, '[', '('), ']', ')') || '](' || url || ') ⭐️ ' || printf('%.1f', ai_score) || '/10', chr(10) ORDER BY place) AS markdown FROM r GROUP BY day""")
def o3_overview(spark, sf_dir):
    return O.overview(_texts(spark, sf_dir), "en")


@query(f"""WITH {_SEL}, r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ai_score DESC, id) AS place, count(*) OVER (PARTITION BY day) AS n FROM sel WHERE selected)
SELECT day, 'en' AS lang, n - place AS at, 'item' AS kind, place || '/' || n || ' ' || title AS title FROM r UNION ALL SELECT DISTINCT day, 'en', n, 'overview', '' FROM r""")
def o4_delivery_messages(spark, sf_dir):
    return O.delivery_messages(_texts(spark, sf_dir), "summary_and_items", ["en", "zh"], ["en"], overview_last=True)


@query("""SELECT doc_id, '---' || chr(10) || 'layout: post' || chr(10) || 'title: "T' || doc_id || '"' || chr(10) || 'date: 2024-01-01' || chr(10) || 'lang: ' || lang || chr(10) || '---' || chr(10) || chr(10) || regexp_replace(text, '^\n+', '') AS post FROM documents""")
def o5_front_matter(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", O.post_front_matter(F.concat(F.lit("# Head\n\n"), "text"), F.concat(F.lit("T"), F.col("doc_id").cast("string")), F.lit("2024-01-01"), F.col("lang")).alias("post"))


@query("SELECT c_custkey AS subscriber, lang FROM customer, (VALUES ('en'), ('zh')) v(lang)")
def o6_subscriber_fanout(spark, sf_dir):
    digests = spark.createDataFrame([("en",), ("zh",)], "lang string")
    return O.subscriber_fanout(digests, table(spark, sf_dir, "customer").selectExpr("c_custkey AS subscriber"))


def _stream(spark, sf_dir, name):
    """The table's files as they land, whether it is one file or a folder of them."""
    path = f"{sf_dir}/{name}.parquet"
    parts = K.children(spark, path)
    whole = len(parts) == 1 and parts[0] == f"{name}.parquet"
    return J.landing(spark, *((sf_dir, table(spark, sf_dir, name).schema, f"{name}.parquet") if whole else (path, table(spark, sf_dir, name).schema)))


def _drain(spark, stream, mode, label):
    """Runs a stream over all that has landed and gives what it wrote."""
    out = K.workdir(spark, label)
    stream.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


@query("SELECT DISTINCT 'x.org/' || user_id || '/' || event_type AS url_key FROM events")
def x1_unique_urls_stream(spark, sf_dir):
    e = _stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("published_at"), F.concat(F.lit("http://www.x.org/"), F.col("user_id").cast("string"), F.lit("/"), "event_type", F.lit("?utm_source="), F.col("event_id").cast("string")).alias("url"))
    return _drain(spark, J.unique_urls(e), "append", "unique").select("url_key")


#: Seconds between the items of a visit, and the event time of the mark that ends the feed.
_GAP, _FAR = 6 * 3600, 4_000_000_000


@query(f"""WITH e AS (SELECT event_id AS id, 'x.org/' || user_id AS url_key, event_type, floor(epoch(ts))::BIGINT AS sec, repeat('a', event_id % 11) AS content FROM events),
b AS (SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY url_key ORDER BY sec, id) < {_GAP} THEN 0 ELSE 1 END AS fresh FROM e),
v AS (SELECT *, sum(fresh) OVER (PARTITION BY url_key ORDER BY sec, id) AS visit FROM b)
SELECT url_key, min(sec)::BIGINT AS began, max(sec)::BIGINT + {_GAP} AS ended, first(id ORDER BY length(content) DESC, sec, id) AS id, max(content) AS content, count(*) AS n_items, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS sources
FROM v GROUP BY url_key, visit""")
def x1_merged_urls_stream(spark, sf_dir):
    """Events as items that land in files, and last a mark far ahead that ends all visits but its own."""
    out = K.workdir(spark, "visits")
    e = table(spark, sf_dir, "events").selectExpr("event_id AS id", "concat('https://www.x.org/', user_id, '/?utm_source=', event_id) AS url", "event_type AS source_type", "repeat('a', cast(event_id % 11 AS int)) AS content", "timestamp_seconds(unix_seconds(cast(ts AS timestamp))) AS published_at")
    mark = spark.range(1).selectExpr("-1L AS id", "'https://x.org/end' AS url", "'' AS source_type", "'' AS content", f"timestamp_seconds({_FAR}) AS published_at")
    e.write.parquet(f"{out}/landed")
    mark.coalesce(1).write.mode("append").parquet(f"{out}/landed")
    # The mark's file is the newest and comes last; before it nothing is late, in whatever order the files are taken.
    rows = _drain(spark, J.merged_urls(J.landing(spark, f"{out}/landed", e.schema), f"{_GAP} seconds", f"{_FAR // 2} seconds"), "append", "visits")
    return rows.select("url_key", F.unix_seconds("began").alias("began"), F.unix_seconds("ended").alias("ended"), "id", "content", "n_items", F.array_join("sources", ",").alias("sources"))


@query("SELECT user_id AS id, arg_max(event_type, floor(epoch(ts))::BIGINT * 1000000 + event_id) AS event_type FROM events GROUP BY user_id")
def x2_upsert_stream(spark, sf_dir):
    out = K.workdir(spark, "upserts")
    e = _stream(spark, sf_dir, "events").selectExpr("user_id AS id", "event_type", "unix_seconds(cast(ts AS timestamp)) AS sec", "event_id")
    J.upsert_sink(e, f"{out}/table", ["sec", "event_id"], ["id"]).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return J.read_upserts(spark, f"{out}/table", ["id"]).select("id", "event_type")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def x3_hourly_counts_stream(spark, sf_dir):
    out = K.workdir(spark, "hours")
    counted = J.hourly_counts(_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    sink = J.upsert_sink(counted, f"{out}/table", [], ["hour", "event_type"]).outputMode("update")
    sink.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return J.read_upserts(spark, f"{out}/table", ["hour", "event_type"]).select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")
