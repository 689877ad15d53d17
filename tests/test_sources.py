"""Normalisers on small landed payloads."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources import normalise as N
from tidemark.streaming import jobs as J

FEED = """<rss><channel>
<item><guid>a</guid><title>One</title><link>http://x.org/1</link><pubDate>Tue, 02 Jan 2024 10:00:00 +0000</pubDate><description>short</description></item>
<item><guid>b</guid><title>Two</title><link>http://x.org/2024/01/03/two</link><description>&lt;p&gt;text&lt;/p&gt;</description></item>
<item><guid>c</guid><title>Old</title><link>http://x.org/3</link><pubDate>Mon, 01 Jan 2001 10:00:00 +0000</pubDate></item>
<item><guid>d</guid><title>Undated</title><link>http://x.org/4</link></item>
</channel></rss>"""


def test_feed_files(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(FEED)
    rows = N.read_feed(spark, f"file://{tmp_path}/feed.xml")
    entries = rows.selectExpr("guid AS entry_id", "title", "link", "author", "pubDate AS published", "updated", "`content:encoded` AS encoded", "description AS summary")
    found = {r.title: r for r in N.feed_items(entries, 1_700_000_000, "feed").collect()}
    assert set(found) == {"One", "Two"}
    assert (found["One"].sec, found["One"].author, found["One"].quality) == (1704189600, "feed", "low")
    assert found["Two"].content == "<p>text</p>" and found["One"].id.startswith("rss:feed:") and len(found["One"].id) == len("rss:feed:") + 16


def test_hn_counts_kids_before_dropping(spark):
    stories = spark.createDataFrame([(1, "t", None, "a", 100, 50, "<p>Hi &amp; x</p>", [1, 2, 3, 4, 5, 6])], "id long, title string, url string, author string, sec long, score long, text string, kids array<long>")
    comments = spark.createDataFrame([(k, "c", None if k == 1 else "x" * (600 if k == 2 else 3), k == 3, k == 4) for k in range(1, 7)], "id long, author string, text string, deleted boolean, dead boolean")
    made = N.hn_items(stories, comments, 100, 50).first()
    assert made.comment_count == 2 and made.content.count("[c]: ") == 2 and "x" * 497 + "..." in made.content
    assert N.hn_items(stories, comments, 101, 50).count() == 0


@pytest.mark.parametrize(("text", "day"), [("2024-02-29", "2024-02-29"), ("2024年2月9日", "2024-02-09"), ("2024/03/01", "2024-03-01"), ("Feb 3, 2024", "2024-02-03"), ("soon", None), ("2024-02-30", None)])
def test_any_date(spark, text, day):
    assert str(spark.createDataFrame([(text,)], "d string").select(N.any_date(F.col("d"))).first()[0]) == str(day)


def test_discussion_is_added_once(spark):
    rows = spark.createDataFrame([(None, "b"), ("", "b"), ("x", "b"), ("x\n\n--- Top Comments ---\na", "b"), ("x", "")], "c string, b string")
    once = rows.select(N.append_discussion(F.col("c"), F.col("b")).alias("c"), "b")
    first = [r.c for r in once.collect()]
    assert first == ["--- Top Comments ---\nb", "--- Top Comments ---\nb", "x\n\n--- Top Comments ---\nb", "x\n\n--- Top Comments ---\na\nb", "x"]
    assert [r[0] for r in once.select(N.append_discussion(F.col("c"), F.col("b"))).collect()] == first


def test_stream_drops_repeats_and_upserts(spark, tmp_path):
    kind = "id long, published_at timestamp, url string"
    for k, rows in enumerate([[(1, "2024-01-01 00:00:00", "http://a.org/x"), (2, "2024-01-01 01:00:00", "http://www.a.org/x/?utm_source=q")], [(3, "2024-01-01 02:00:00", "http://a.org/x#y"), (1, "2024-01-01 03:00:00", "http://a.org/z")]]):
        spark.createDataFrame(rows, "id long, published_at string, url string").withColumn("published_at", F.col("published_at").cast("timestamp")).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    schema = spark.createDataFrame([], kind).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    write = J.unique_urls(stream).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True)
    write.start().awaitTermination()
    assert sorted(r.url_key for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == ["a.org/x", "a.org/z"]
    sink = J.upsert_sink(stream.withColumn("sec", F.unix_seconds("published_at")), f"file://{tmp_path}/table", ["sec"], ["id"], compact_every=1)
    sink.option("checkpointLocation", f"file://{tmp_path}/state2").trigger(availableNow=True).start().awaitTermination()
    assert {p.name for p in (tmp_path / "table").iterdir()} >= {"delta-0", "delta-1", "base-1"}
    assert sorted((r.id, r.url) for r in J.read_upserts(spark, f"file://{tmp_path}/table", ["id"]).collect()) == [(1, "http://a.org/z"), (2, "http://www.a.org/x/?utm_source=q"), (3, "http://a.org/x#y")]


def test_a_source_that_fails_costs_only_itself(spark, tmp_path):
    """A truncated Parquet file, a malformed feed and a missing folder beside sources that land."""
    from tidemark.sources.normalise import BROKEN, land_sources

    good = spark.createDataFrame([(1, "a"), (2, "b")], "id long, title string")
    good.coalesce(1).write.parquet(f"file://{tmp_path}/cut")
    part = next((tmp_path / "cut").glob("*.parquet"))
    part.write_bytes(part.read_bytes()[:-20])
    (tmp_path / "feed.json").write_text('{"id": 3, "title": "c"}\n{"id": 4, "tit\n{"id": 5}\n')
    (tmp_path / "feed.xml").write_text("<rss><item><id>6</id></item><item><id>7</item></rss>")
    fields = "id long, title string"
    sources = {
        "good": lambda: good,
        "cut": lambda: spark.read.schema(fields).parquet(f"file://{tmp_path}/cut"),
        "json": lambda: spark.read.schema(f"{fields}, {BROKEN} string").json(f"file://{tmp_path}/feed.json"),
        "xml": lambda: spark.read.schema("id long").option("rowTag", "item").option("mode", "FAILFAST").xml(f"file://{tmp_path}/feed.xml"),
        "missing": lambda: spark.read.parquet(f"file://{tmp_path}/nowhere"),
    }
    found, status = land_sources(spark, sources, f"file://{tmp_path}/out")
    assert sorted((r.id, r.title or "") for r in found.collect()) == [(1, "a"), (2, "b"), (3, "c"), (5, "")]
    told = {r.source: (r.status, r["rows"], r.quarantined, r.error is None) for r in status.collect()}
    assert told == {"good": ("landed", 2, 0, True), "json": ("landed", 2, 1, True), "cut": ("failed", 0, 0, False), "xml": ("failed", 0, 0, False), "missing": ("failed", 0, 0, False)}
    none, failed = land_sources(spark, {"missing": sources["missing"]}, f"file://{tmp_path}/none")
    assert none.columns == [] and failed.first().status == "failed"
