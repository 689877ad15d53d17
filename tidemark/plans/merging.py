"""Queries of URL keys, merges and provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import urls as U
from tidemark.operators import merging as M
from tidemark.plans.bindings import URL_ITEMS, table, url_items
from tidemark.plans.content import _LINKS, links
from tidemark.registry import query

_PARAMS = ", ".join(f"'{p}'" for p in U.TRACKING_PARAMS)
_BASE = rf"regexp_replace(lower(regexp_extract(url, '{U.HOST}', 1)), '^www\.', '') || regexp_replace(regexp_extract(url, '{U.PATH}', 1), '/+$', '')"
_ARGS = rf"""array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '{U.QUERY}', 1), '&'), lambda p: lower(split_part(p, '=', 1)) NOT IN ({_PARAMS}) AND regexp_extract(p, '^[^=]*=(.*)$', 1) <> '')), '&')"""
_KEY = f"CASE WHEN {_ARGS} = '' THEN {_BASE} ELSE {_BASE} || '?' || {_ARGS} END"
_KEYED = f"{URL_ITEMS}, keyed AS (SELECT *, {_KEY} AS key FROM url_items)"
_HEADS = "heads AS (SELECT key, arg_max(id, length(coalesce(content, '')) * 10000000 - pos) AS id, arg_max(pos, length(coalesce(content, '')) * 10000000 - pos) AS primary_pos, min(pos) AS first_pos, count(*) AS n_items FROM keyed GROUP BY key)"


def _keyed(spark, sf_dir):
    return url_items(spark, sf_dir).withColumn("key", U.normalize_url(F.col("url")))


@query(f"WITH {_KEYED} SELECT id, key FROM keyed")
def d1_normalize_url(spark, sf_dir):
    return _keyed(spark, sf_dir).select("id", "key")


@query(f"WITH {_KEYED}, {_HEADS} SELECT key, id, first_pos, n_items FROM heads")
def d2_url_survivors(spark, sf_dir):
    return M.merge_url_duplicates(url_items(spark, sf_dir)).select("key", "id", "first_pos", "n_items")


@query()
def d2_merged_content(spark, sf_dir):
    extracted = url_items(spark, sf_dir).selectExpr("*", "content AS raw_content", "CASE WHEN source_type = 'feed' THEN 'success' ELSE 'failed' END AS extraction_status")
    return M.merge_url_duplicates(extracted)


@query(f"""WITH {_KEYED}, {_HEADS}, x AS (SELECT *, pos % 4 = 0 AS ok FROM keyed),
g AS (SELECT key, arg_min(id, pos) FILTER (ok) AS good FROM x GROUP BY key)
SELECT h.key, CASE WHEN h.primary_pos % 4 = 0 OR good IS NULL THEN h.id ELSE good END AS from_id FROM heads h JOIN g USING (key)""")
def d3_merge_extraction(spark, sf_dir):
    x = _keyed(spark, sf_dir).selectExpr("*", "id AS from_id", "CASE WHEN pos % 4 = 0 THEN 'success' ELSE 'failed' END AS extraction_status")
    return M.merge_extraction(x, ["from_id"])


@query(f"""WITH {_KEYED}, {_HEADS}, i AS (SELECT k.key, CASE WHEN pos = primary_pos THEN -1 ELSE pos END AS at_, unnest([0, 1, 2]) AS place, unnest(['i' || (pos % 3), 'i' || (pos % 7), 'j' || (pos % 2)]) AS image FROM keyed k JOIN heads h ON k.key = h.key),
f AS (SELECT key, image, min(row(at_, place)) AS o FROM i GROUP BY ALL)
SELECT key, string_agg(image, ',' ORDER BY o) AS images FROM f GROUP BY key""")
def d4_merge_images(spark, sf_dir):
    x = _keyed(spark, sf_dir).selectExpr("*", "array(concat('i', pos % 3), concat('i', pos % 7), concat('j', pos % 2)) AS images")
    return M.merge_images(x).select("key", F.array_join("images", ",").alias("images"))


@query(f"""WITH {_KEYED}, {_HEADS}, e AS (SELECT k.key, pos, pos = primary_pos AS p, unnest(['a', 'b']) AS name, unnest([CASE WHEN pos % 3 = 0 THEN '' ELSE 'v' || pos END, CASE WHEN pos % 2 = 0 THEN NULL ELSE '' END]) AS value FROM keyed k JOIN heads h ON k.key = h.key)
SELECT key, name, coalesce(arg_min(value, CASE WHEN p THEN 0 ELSE 10000000 END + pos) FILTER (coalesce(value, '') <> ''), arg_max_null(value, pos)) AS value FROM e GROUP BY key, name""")
def d5_merge_metadata(spark, sf_dir):
    k = _keyed(spark, sf_dir)
    x = k.join(M.primaries(k).select("key", "primary_pos"), "key").selectExpr("key", "pos", "pos = primary_pos AS is_primary", "inline(array(named_struct('name', 'a', 'value', CASE WHEN pos % 3 = 0 THEN '' ELSE concat('v', pos) END), named_struct('name', 'b', 'value', CASE WHEN pos % 2 != 0 THEN '' END)))")
    return M.merge_metadata(x)


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'r/' || event_type WHEN event_id % 5 = 0 THEN 'feed' || user_id WHEN event_id % 3 = 0 THEN 'ossinsight:' || CASE WHEN event_id % 2 = 0 THEN 'go' ELSE 'all' END
WHEN event_id % 2 = 0 THEN 'repo' || user_id WHEN event_id % 11 = 0 THEN 'unknown' ELSE 'u' || user_id END AS label FROM events""")
def d6_source_label(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 7 = 0 THEN event_type END AS subreddit", "CASE WHEN event_id % 5 = 0 THEN concat('feed', user_id) ELSE '' END AS feed_name", "CASE WHEN event_id % 3 = 0 THEN 'week' END AS period",
        "CASE WHEN event_id % 3 = 0 OR event_id % 2 = 0 THEN concat('repo', user_id) END AS repo", "CASE WHEN event_id % 2 = 0 THEN 'go' ELSE '' END AS primary_language", "CASE WHEN event_id % 11 != 0 THEN concat('u', user_id) END AS author",
    )
    return e.select("event_id", M.source_label(e.columns).alias("label"))


_ROLES = "roles(pattern, role) AS (VALUES " + ", ".join(f"('{p}', '{r}')" for r, ps in U.ROLE_PREFIXES.items() for p in ps) + ")"
_FULL = rf"regexp_replace(lower(regexp_extract(url, '{U.HOST}', 1)), '^www\.', '') || lower(regexp_extract(url, '{U.PATH}', 1))"


@query(f"""WITH {_LINKS}, {_ROLES}, l AS (SELECT page_id, url, {_FULL} AS f FROM links)
SELECT page_id, url, coalesce(arg_max(role, length(pattern)), 'unknown') AS role FROM l LEFT JOIN roles ON starts_with(f, pattern) GROUP BY page_id, url""")
def d7_url_role(spark, sf_dir):
    return U.with_role(links(spark, sf_dir))


_PRIORITY = "CASE role " + " ".join(f"WHEN '{r}' THEN {n}" for r, n in U.ROLE_PRIORITY.items()) + " END"
_GROUPS = "g AS (SELECT text, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1), d AS (SELECT doc_id, first FROM documents JOIN g USING (text) WHERE doc_id <> first)"


def _text_groups(d):
    """Documents of one text are an event, at = 0 the first and else the number behind it."""
    keyed = d.filter("text IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("hash"))
    first = keyed.groupBy("hash", "text").agg(F.min("doc_id").alias("primary_pos"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return keyed.join(first, ["hash", "text"]).selectExpr("primary_pos AS group_id", "primary_pos", "doc_id - primary_pos AS at", "doc_id AS pos")


def _event_groups(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return M.merge_event_groups(d.selectExpr("doc_id AS pos", "source"), _text_groups(d))


@query(f"WITH {_GROUPS} SELECT doc_id AS pos, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM d)")
def d8_event_survivors(spark, sf_dir):
    return _event_groups(spark, sf_dir)[0]


@query(f"WITH {_GROUPS} SELECT first AS primary_pos, doc_id AS covered_pos FROM d")
def d8_event_coverage(spark, sf_dir):
    return _event_groups(spark, sf_dir)[1].select("primary_pos", "covered_pos")


_TURNS = """turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS at_ FROM (SELECT conv_id, turn, any_value(role) AS role, any_value(text) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn)),
pics AS (SELECT conv_id, image, min(row(at_, place)) AS o FROM (SELECT conv_id, at_, unnest([0, 1]) AS place, unnest(['i' || turn, 'j' || (length(coalesce(text, '')) % 5)]) AS image FROM turns) GROUP BY ALL),
seen AS (SELECT conv_id, string_agg(image, ',' ORDER BY o) AS images FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY o) AS n FROM pics) WHERE n <= 20 GROUP BY conv_id)"""


def _turns(spark, sf_dir):
    """A turn as an item; all turns of a conversation are one event, and its first turn is the primary."""
    c = table(spark, sf_dir, "conversations").filter("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    items = c.selectExpr("conv_id", "turn", "concat(conv_id, ':', turn) AS pos", "text AS content", "coalesce(role, 'unknown') AS source_type", "array(concat('i', turn), concat('j', length(coalesce(text, '')) % 5)) AS images")
    first = items.groupBy("conv_id").agg(F.min_by("pos", "turn").alias("primary_pos"), F.min("turn").alias("first"))
    return items, items.join(first, "conv_id").selectExpr("conv_id AS group_id", "primary_pos", "turn - first AS at", "pos")


@query(f"""WITH {_TURNS}, l AS (SELECT conv_id, list({{'text': coalesce(text, ''), 'kind': coalesce(role, 'unknown')}} ORDER BY at_) AS parts, conv_id || ':' || min(turn) AS pos FROM turns GROUP BY conv_id)
SELECT pos, list_reduce(parts, lambda a, p: {{'text': CASE WHEN contains(a.text, p.text) THEN a.text ELSE a.text || chr(10) || chr(10) || '--- From ' || p.kind || ' ---' || chr(10) || p.text END, 'kind': a.kind}}).text AS content, images, 'turns of ' || conv_id AS facts
FROM l JOIN seen USING (conv_id)""")
def d8_merge_events(spark, sf_dir):
    items, groups = _turns(spark, sf_dir)
    facts = groups.select("group_id").distinct().selectExpr("group_id", "array(concat('turns of ', group_id)) AS facts")
    return M.merge_events(items, groups, facts).select("pos", F.coalesce("content", F.lit("")).alias("content"), F.array_join("images", ",").alias("images"), F.array_join("merged_facts", ",").alias("facts"))


_SITES = [patterns[-1] for patterns in U.ROLE_PREFIXES.values()] + ["example.com"]
_SITE = f"concat('https://', element_at(array({', '.join(map(repr, _SITES))}), cast(doc_id % {len(_SITES)} AS int) + 1), '/', doc_id % 50)"


@query(f"""WITH {_GROUPS}, {_ROLES}, m AS (SELECT first, doc_id FROM d UNION ALL SELECT first, first FROM g WHERE text IS NOT NULL),
u AS (SELECT *, ([{', '.join(map(repr, _SITES))}])[doc_id % {len(_SITES)} + 1] || '/' || (doc_id % 50) AS f FROM m),
e AS (SELECT first, doc_id, f, coalesce(arg_max(role, length(pattern)), 'unknown') AS role FROM u LEFT JOIN roles ON starts_with(f, pattern) GROUP BY ALL),
p AS (SELECT *, CASE WHEN doc_id = first AND doc_id % 2 = 0 THEN 'paper' ELSE role END AS said FROM e),
b AS (SELECT first, arg_min(f, {_PRIORITY.replace("CASE role", "CASE said")} * 1000000000000 + doc_id) AS best FROM p GROUP BY first)
SELECT p.first AS primary_pos, doc_id AS pos, 'https://' || f AS url, said AS role, f = best AS is_primary FROM p JOIN b ON p.first = b.first""")
def d8_event_sources(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    items = d.selectExpr("doc_id AS pos", f"{_SITE} AS url", "source AS title", "'web' AS source_type", "source AS label")
    answers = items.filter("pos % 2 = 0").selectExpr("pos AS primary_pos", "url", "'paper' AS role")
    groups = _text_groups(d)
    return M.event_sources(items, groups, answers).select("primary_pos", "pos", "url", "role", "is_primary")


_SETS = "s AS (SELECT p_partkey AS id, list_sort(list_distinct(string_split(p_name || ' ' || p_brand, ' '))) AS t FROM part), r AS (SELECT t, min(id) AS rep FROM s GROUP BY t)"


def _titles(spark, sf_dir):
    return M.event_candidates(table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "split(concat(p_name, ' ', p_brand), ' ') AS tokens"))


@query(f"""WITH {_SETS}, p AS (SELECT x.rep AS a, y.rep AS b, len(list_intersect(x.t, y.t)) AS shared, len(list_distinct(list_concat(x.t, y.t))) AS total FROM r x JOIN r y ON x.rep < y.rep)
SELECT a, b, shared, total FROM p WHERE 100 * shared >= 50 * total""")
def d9_event_candidates(spark, sf_dir):
    return _titles(spark, sf_dir)[0]


@query(f"WITH {_SETS} SELECT id, rep FROM s JOIN r USING (t)")
def d9_event_classes(spark, sf_dir):
    return _titles(spark, sf_dir)[1]


_ENTRIES = f"{_LINKS}, {_ROLES}, l AS (SELECT page_id % 200 AS key, page_id AS pos, url, 'title of ' || url AS title, {_FULL} AS f FROM links), e AS (SELECT key, pos, url, title, coalesce(arg_max(role, length(pattern)), 'unknown') AS role FROM l LEFT JOIN roles ON starts_with(f, pattern) GROUP BY ALL)"


@query(f"""WITH {_ENTRIES}, u AS (SELECT key, url, min(pos) AS pos, arg_min(title, pos) AS title, arg_min(role, pos) AS role FROM e GROUP BY key, url),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {_PRIORITY}, pos, url) AS place, count(*) OVER (PARTITION BY key) AS source_count FROM u)
SELECT key, place = 1 AS is_primary, source_count, count(*) AS n, max(length(title)) > 60 AS long FROM o GROUP BY ALL""")
def d10_source_attribution(spark, sf_dir):
    entries = U.with_role(links(spark, sf_dir)).selectExpr("page_id % 200 AS key", "page_id AS pos", "url", "concat('title of ', url) AS title", "role")
    long = F.max(F.length(F.concat(F.lit("title of "), "url"))) > 60
    return M.source_attribution(entries).groupBy("key", "is_primary", "source_count").agg(F.count("*").alias("n"), long.alias("long"))


@query("SELECT doc_id % 300 AS id, max(doc_id) AS pos FROM documents GROUP BY ALL")
def d12_dedup_by_id_last(spark, sf_dir):
    return M.dedup_by_id_last(table(spark, sf_dir, "documents").selectExpr("doc_id % 300 AS id", "doc_id AS pos"))
