"""Merged URLs of a stream against those of a table, whatever the order of arrival, and the end of their state."""

import random
from datetime import UTC, datetime, timedelta

from tidemark.streaming import jobs as J

KIND = "id long, url string, source_type string, content string, published_at timestamp"
START = datetime(2024, 1, 1, tzinfo=UTC)


def rows():
    rng = random.Random(7)
    made = [(k, f"https://www.a.org/{rng.randrange(6)}{rng.choice(['', '/', '?utm_source=q', '#top'])}", rng.choice(["rss", "hn"]), rng.choice([None, "", "x" * rng.randrange(5)]), START + timedelta(minutes=rng.randrange(4 * 24 * 60))) for k in range(120)]
    return [*made, *((1000 + k, *made[k][1:]) for k in range(10)), (2000, None, "rss", "no url", START), (2001, "https://a.org/0", "rss", "no time", None)]


def plain(data, gap):
    keys = {}
    for r in data:
        if r[1] and r[4]:
            keys.setdefault(r[1].split("?")[0].split("#")[0].rstrip("/").removeprefix("https://www."), []).append(r)
    found = []
    for key, of in keys.items():
        visit = []
        for r in sorted(of, key=lambda r: r[4]):
            if visit and r[4] > visit[-1][4] + gap:
                found.append((key, visit))
                visit = []
            visit.append(r)
        found.append((key, visit))
    best = lambda v: min(v, key=lambda r: (-len(r[3] or ""), r[4], r[0]))
    return sorted((key, v[0][4], v[-1][4] + gap, best(v)[0], best(v)[3] or "", len(v), sorted({r[2] for r in v})) for key, v in found)


def given(frame):
    at = lambda t: t.replace(tzinfo=UTC) if t.tzinfo is None else t
    return sorted((r.url_key, at(r.began), at(r.ended), r.id, r.content, r.n_items, list(r.sources)) for r in frame.collect())


def test_stream_and_table_agree_in_any_order(spark, tmp_path):
    data, gap, late = rows(), timedelta(hours=6), timedelta(days=30)
    table = J.merged_urls(spark.createDataFrame(data, KIND), "6 hours")
    assert given(table) == plain(data, gap)
    schema = table.sparkSession.createDataFrame([], KIND).schema
    for run in range(2):
        random.Random(run).shuffle(data)
        source, out = f"file://{tmp_path}/{run}/in", f"file://{tmp_path}/{run}/out"

        def drain(out=out, source=source):
            visits = J.merged_urls(J.landing(spark, source, schema, files_per_batch=1), "6 hours", f"{late.days} days")
            query = visits.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
            query.awaitTermination()
            return spark.read.schema(visits.schema).parquet(f"{out}/rows"), query.lastProgress["stateOperators"][0]["numRowsTotal"]

        for k in range(3):
            spark.createDataFrame(data[k::3], KIND).coalesce(1).write.mode("append").parquet(source)
        early, held = drain()
        assert early.count() == 0 and held == len(plain(data, gap))
        spark.createDataFrame([(-1, "https://z.org/end", "", "", START + timedelta(days=365))], KIND).coalesce(1).write.mode("append").parquet(source)
        ended, held = drain()
        assert given(ended) == plain(data, gap) and held == 1


def test_an_item_at_exactly_the_gap_begins_a_visit(spark, tmp_path):
    hours = [(1, 0, 0), (2, 6, 0), (3, 12, -1), (4, 18, -1)]  # 2 and 4 come at the gap, 3 a microsecond before it
    data = [(k, "https://a.org/x", "rss", "x" * k, START + timedelta(hours=h, microseconds=us)) for k, h, us in hours]
    wanted = [(1, 1, START), (3, 2, START + timedelta(hours=6)), (4, 1, START + timedelta(hours=18, microseconds=-1))]
    table = J.merged_urls(spark.createDataFrame(data, KIND), "6 hours")
    visits = sorted((r[3], r[5], r[1]) for r in given(table))
    assert visits == wanted
    assert {r[2] for r in given(table)} == {START + timedelta(hours=h, microseconds=us) for h, us in ((6, 0), (18, -1), (24, -1))}
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for rows in (*([d] for d in data), [(-1, "https://z.org/end", "", "", START + timedelta(days=365))]):
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(source)
    stream = J.merged_urls(J.landing(spark, source, spark.createDataFrame([], KIND).schema, files_per_batch=1), "6 hours", "30 days")
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    assert given(spark.read.schema(stream.schema).parquet(f"{out}/rows")) == given(table)
