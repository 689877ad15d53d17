"""Queries of scoring, gates, quotas, windows and counts, up to the daily digest."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import scoring as S
from tidemark.plans.bindings import ITEMS, RATINGS_SQL, items, ratings, table
from tidemark.registry import query

_ALL = [*S.POSITIVE, *S.PENALTIES]
_TOTAL = " + ".join(f"coalesce({c}, 0)" for c in _ALL)
_SCORE = f"CASE WHEN relevant THEN greatest(0.0::DOUBLE, least(10.0::DOUBLE, {_TOTAL})) ELSE 0.0::DOUBLE END"
QUOTAS = S.Quotas({"g0": S.Group(["src0", "src1", "src2"], 4), "g1": S.Group(["src2", "src3"], 2), "g2": S.Group(["src5"], None)}, "rest", 6, 15)
_GROUP = "CASE WHEN category IN ('src0', 'src1', 'src2') THEN 'g0' WHEN category = 'src3' THEN 'g1' WHEN category = 'src5' THEN 'g2' ELSE 'rest' END"


@query(f"WITH {RATINGS_SQL} SELECT id, {_SCORE} AS score FROM ratings")
def a1_compose_score(spark, sf_dir):
    return ratings(spark, sf_dir).select("id", S.compose_score().alias("score"))


@query(f"WITH {RATINGS_SQL} SELECT id, {_SCORE} AS total, " + ", ".join(f"coalesce({c}, 0.0)::DOUBLE AS {c}" for c in _ALL) + " FROM ratings")
def a2_score_breakdown(spark, sf_dir):
    return ratings(spark, sf_dir).select("id", S.score_breakdown(S.compose_score()).alias("b")).select("id", "b.*")


@query(f"""WITH {ITEMS}, {RATINGS_SQL}, r AS (SELECT ratings.*, 'why ' || id AS reason, CASE WHEN id % 4 = 0 THEN NULL ELSE 'sum ' || id END AS summary FROM ratings WHERE relevant IS NOT NULL)
SELECT items.id, coalesce(relevant, false) AS ai_relevant, coalesce({_SCORE.replace('ELSE 0.0', 'ELSE 0.0')}, 0.0) AS ai_score,
       CASE WHEN r.id IS NULL THEN 'analysis failed' ELSE reason END AS ai_reason, coalesce(summary, title) AS ai_summary
FROM items LEFT JOIN r ON items.id = r.id""")
def a3_apply_ratings(spark, sf_dir):
    responses = ratings(spark, sf_dir).filter("relevant IS NOT NULL").selectExpr("*", "concat('why ', id) AS reason", "CASE WHEN id % 4 != 0 THEN concat('sum ', id) END AS summary")
    return S.apply_ratings(items(spark, sf_dir).select("id", "title"), responses)


@query(f"""WITH {ITEMS}, b(bucket, low, high) AS (VALUES ('0-3', -1, 3), ('3-5', 3, 5), ('5-7', 5, 7), ('7-9', 7, 9), ('9-10', 9, 99))
SELECT bucket, count(id) AS n FROM b LEFT JOIN items ON coalesce(ai_score, 0) >= low AND coalesce(ai_score, 0) < high GROUP BY bucket""")
def a4_score_distribution(spark, sf_dir):
    return S.score_distribution(items(spark, sf_dir))


@query(f"WITH {ITEMS} SELECT id, ai_score FROM items WHERE ai_relevant IS TRUE")
def f1_relevance_gate(spark, sf_dir):
    return S.relevance_gate(items(spark, sf_dir)).select("id", "ai_score")


_PASSED = """above AS (SELECT * FROM rel WHERE ai_score <> 0 AND ai_score >= {t}),
below AS (SELECT *, row_number() OVER (ORDER BY ai_score DESC, pos) AS n FROM rel WHERE ai_score <> 0 AND ai_score < {t}),
passed AS (SELECT id, pos, ai_score, category FROM above UNION ALL SELECT id, pos, ai_score, category FROM below WHERE n <= {m} - (SELECT count(*) FROM above))"""


@query(f"WITH {ITEMS}, rel AS (SELECT * FROM items WHERE ai_relevant IS TRUE), {_PASSED.format(t=9, m=60)} SELECT id, ai_score FROM passed")
def f2_threshold_backfill(spark, sf_dir):
    return S.threshold_with_backfill(S.relevance_gate(items(spark, sf_dir)), 9, 60).select("id", "ai_score")


@query(f"WITH {ITEMS} SELECT id, ai_score FROM items WHERE ai_score >= 7")
def f3_threshold_filter(spark, sf_dir):
    return items(spark, sf_dir).filter("ai_score >= 7").orderBy(F.desc("ai_score"), "pos").select("id", "ai_score")


_DIGEST = f"""grouped AS (SELECT *, {_GROUP} AS group_key FROM {{src}}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY coalesce(ai_score, 0) DESC, pos) AS r FROM grouped),
kept AS (SELECT * FROM ranked WHERE r <= CASE group_key WHEN 'g0' THEN 4 WHEN 'g1' THEN 2 WHEN 'g2' THEN 1000000000 ELSE 6 END),
digest AS (SELECT id, group_key, ai_score FROM kept ORDER BY coalesce(ai_score, 0) DESC, pos LIMIT 15)"""


@query(f"WITH {ITEMS}, {_DIGEST.format(src='items')} SELECT * FROM digest")
def f4_balanced_digest(spark, sf_dir):
    return S.balanced_digest(items(spark, sf_dir), QUOTAS).select("id", "group_key", "ai_score")


@query(f"WITH {ITEMS}, {_DIGEST.format(src='items')} SELECT group_key, count(*) AS n FROM digest GROUP BY group_key")
def f4_group_counts(spark, sf_dir):
    return S.balanced_digest(items(spark, sf_dir), QUOTAS).groupBy("group_key").agg(F.count("*").alias("n"))


@query("SELECT p_brand AS category, count(DISTINCT p_size) AS n_groups FROM part GROUP BY p_brand HAVING count(DISTINCT p_size) > 1")
def f5_duplicate_categories(spark, sf_dir):
    return S.duplicate_categories(table(spark, sf_dir, "part").selectExpr("p_brand AS category", "p_size AS group_key"))


_STAGES = f"""rel AS (SELECT * FROM items WHERE ai_relevant IS TRUE), {_PASSED.format(t=9, m=60)},
uniq AS (SELECT * FROM passed WHERE id % 9 <> 0), {_DIGEST.format(src='uniq')}"""
_AUDIT = """SELECT id, CASE WHEN id NOT IN (SELECT id FROM rel) THEN 'relevance' WHEN id NOT IN (SELECT id FROM passed) THEN 'score'
WHEN id NOT IN (SELECT id FROM uniq) THEN 'topic_duplicate' WHEN id NOT IN (SELECT id FROM digest) THEN 'category_quota' END AS drop_reason FROM items"""


def _stages(spark, sf_dir):
    every = items(spark, sf_dir)
    relevant = S.relevance_gate(every)
    passed = S.threshold_with_backfill(relevant, 9, 60)
    unique = passed.filter("id % 9 != 0")
    return every, relevant, passed, unique, S.balanced_digest(unique, QUOTAS)


@query(f"WITH {ITEMS}, {_STAGES}, audit AS ({_AUDIT}) SELECT * FROM audit WHERE drop_reason IS NOT NULL")
def f6_drop_audit(spark, sf_dir):
    return S.drop_audit(*_stages(spark, sf_dir))


@query(f"WITH {ITEMS}, {_STAGES}, audit AS ({_AUDIT}) SELECT coalesce(drop_reason, 'selected') AS outcome, count(*) AS n FROM audit GROUP BY ALL")
def f6_drop_counts(spark, sf_dir):
    stages = _stages(spark, sf_dir)
    audit = S.drop_audit(*stages)
    return stages[0].select("id").join(audit, "id", "left").groupBy(F.coalesce("drop_reason", F.lit("selected")).alias("outcome")).agg(F.count("*").alias("n"))


@query(f"""WITH {ITEMS}, {_STAGES}, audit AS ({_AUDIT}) SELECT i.id, i.title, i.source_type, i.ai_score, d.group_key, a.drop_reason
FROM items i JOIN audit a ON i.id = a.id LEFT JOIN digest d ON i.id = d.id""")
def daily_digest(spark, sf_dir):
    """The flagship: gate, threshold with backfill, merge, quotas, and the audit of all that was dropped."""
    stages = _stages(spark, sf_dir)
    return stages[0].select("id", "title", "source_type", "ai_score").join(stages[-1].select("id", "group_key"), "id", "left").join(S.drop_audit(*stages), "id", "left")


@query(f"WITH {ITEMS} SELECT id, (SELECT count(*) FROM items) AS total, (SELECT count(*) FROM items) > 25 AS truncated FROM items ORDER BY pos LIMIT 25")
def f7_first_n(spark, sf_dir):
    return S.first_n(items(spark, sf_dir).select("id", "pos"), 25).select("id", "total", "truncated")


@query(f"""WITH {ITEMS} SELECT id, CASE WHEN ai_score IS NOT NULL THEN CASE WHEN id % 5 >= 3 THEN 1.0 ELSE 0.0 END END::DOUBLE AS bonus,
least(10.0, ai_score + CASE WHEN id % 5 >= 3 THEN 1.0 ELSE 0.0 END)::DOUBLE + CASE WHEN ai_score IS NULL THEN NULL ELSE 0 END AS ai_score FROM items""")
def d11_multi_source_bonus(spark, sf_dir):
    counted = items(spark, sf_dir).withColumn("source_count", F.expr("CASE WHEN id % 5 = 0 THEN NULL ELSE id % 5 END"))
    return S.multi_source_bonus(counted).select("id", "bonus", "ai_score")


@query("SELECT source AS source_type, count(*) AS n FROM documents GROUP BY source")
def s20_source_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("source_type")).agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-09' AND ts < TIMESTAMP '2024-01-10'")
def s21_time_window(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("ts >= timestamp'2024-01-10' - interval 24 hours AND ts < timestamp'2024-01-10'").select("event_id", "event_type")


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src4')")
def s22_source_subset(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.col("source").isin("src1", "src4")).select("doc_id", "source")


@query("SELECT wanted FROM (VALUES ('src1'), ('src4'), ('nowhere')) t(wanted) WHERE wanted NOT IN (SELECT source FROM documents WHERE source IS NOT NULL)")
def s22_unknown_sources(spark, sf_dir):
    wanted = spark.createDataFrame([("src1",), ("src4",), ("nowhere",)], "wanted string")
    known = table(spark, sf_dir, "documents").select(F.col("source").alias("wanted")).distinct()
    return wanted.join(known, "wanted", "left_anti")


@query("SELECT 'docs' AS origin, doc_id AS id, text AS title FROM documents UNION ALL SELECT 'pages', page_id, NULL FROM pages UNION ALL SELECT 'events', event_id, event_type FROM events")
def s19_union_sources(spark, sf_dir):
    from tidemark.sources.normalise import union_sources

    return union_sources([
        lambda: table(spark, sf_dir, "documents").selectExpr("'docs' AS origin", "doc_id AS id", "text AS title"),
        lambda: table(spark, sf_dir, "pages").selectExpr("'pages' AS origin", "page_id AS id"),
        lambda: table(spark, sf_dir, "no_such_source"),
        lambda: table(spark, sf_dir, "events").selectExpr("'events' AS origin", "event_id AS id", "event_type AS title"),
    ])


def _landed(spark, sf_dir):
    """Documents, pages and events land; one source fails in its first task, one cannot be resolved."""
    from tidemark.operators.sinks import workdir
    from tidemark.sources.normalise import land_sources

    sources = {
        "docs": lambda: table(spark, sf_dir, "documents").selectExpr("'docs' AS origin", "doc_id AS id", "text AS title"),
        "pages": lambda: table(spark, sf_dir, "pages").selectExpr("'pages' AS origin", "page_id AS id"),
        "broken": lambda: table(spark, sf_dir, "pages").selectExpr("'broken' AS origin", "CAST(raise_error('a broken payload') AS bigint) AS id"),
        "missing": lambda: table(spark, sf_dir, "no_such_source"),
        "events": lambda: table(spark, sf_dir, "events").selectExpr("'events' AS origin", "event_id AS id", "event_type AS title"),
    }
    return land_sources(spark, sources, workdir(spark, "sources"))


@query("SELECT 'docs' AS origin, doc_id AS id, text AS title FROM documents UNION ALL SELECT 'pages', page_id, NULL FROM pages UNION ALL SELECT 'events', event_id, event_type FROM events")
def s19_landed_sources(spark, sf_dir):
    return _landed(spark, sf_dir)[0]


@query("SELECT 'docs' AS source, 'landed' AS status, count(*) AS rows FROM documents UNION ALL SELECT 'pages', 'landed', count(*) FROM pages UNION ALL SELECT 'events', 'landed', count(*) FROM events UNION ALL VALUES ('broken', 'failed', 0), ('missing', 'failed', 0)")
def s19_source_status(spark, sf_dir):
    return _landed(spark, sf_dir)[1].select("source", "status", "rows")
