"""Tables behind one pointer: writers that die, writers that meet, and what a merge rewrites."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sinks as K
from tidemark.streaming import jobs as J

FIELDS = "id int, v string"


def rows(spark, *pairs):
    return spark.createDataFrame(pairs, FIELDS)


def state(spark, path):
    return sorted((r.id, r.v, str(r.run_date)) for r in K.read_items(spark, path, FIELDS).collect())


@pytest.mark.parametrize("step", ["replace_slots", "commit", "_sweep"])
def test_a_writer_that_dies_leaves_the_old_state_or_the_new(spark, tmp_path, monkeypatch, step):
    path = f"file://{tmp_path}/items"
    K.save_items(spark, path, rows(spark, (1, "a"), (2, "a")), "2024-01-01")
    K.save_items(spark, path, rows(spark, (3, "a")), "2024-01-02")
    old, new = state(spark, path), [(1, "a", "2024-01-01"), (2, "b", "2024-01-03"), (3, "b", "2024-01-03")]
    with monkeypatch.context() as patched:
        patched.setattr(K, step, lambda *args: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            K.save_items(spark, path, rows(spark, (2, "b"), (3, "b")), "2024-01-03")
    assert state(spark, path) == (new if step == "_sweep" else old)
    K.save_items(spark, path, rows(spark, (2, "b"), (3, "b")), "2024-01-03")
    assert state(spark, path) == new and set(K.slots(spark, path)[1]) == {"2024-01-01", "2024-01-03"}
    assert state(spark, f"file://{tmp_path}/none") == []


def test_of_two_writers_the_second_fails(spark, tmp_path):
    path = f"file://{tmp_path}/items"
    K.save_items(spark, path, rows(spark, (1, "a")), "2024-01-01")
    number, live = K.slots(spark, path)
    K.save_items(spark, path, rows(spark, (2, "b")), "2024-01-02")
    with pytest.raises(RuntimeError, match="another writer"):
        K.commit(spark, path, number + 1, live)
    assert state(spark, path) == [(1, "a", "2024-01-01"), (2, "b", "2024-01-02")]


def test_only_the_two_newest_commits_are_kept(spark, tmp_path):
    path = f"file://{tmp_path}/items"
    for k in range(6):
        K.save_items(spark, path, rows(spark, (k % 2, f"v{k}")), "2024-01-01")
    assert state(spark, path) == [(1, "v5", "2024-01-01")]
    assert len(os.listdir(tmp_path / "items" / "data")) == 2 and len([n for n in os.listdir(tmp_path / "items") if n.startswith("manifest-")]) == 2


def files(path):
    return {os.path.join(d, n): os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_a_merge_rewrites_what_arrives(spark, tmp_path):
    """Bytes that a merge writes follow the arriving ids, not the table; merging again changes nothing."""
    path, known = f"file://{tmp_path}/table", {k: f"text {k}" for k in range(4000)}
    K.upsert_table(spark, path, rows(spark, *known.items()), {}, buckets=64)
    before = files(tmp_path / "table")
    for arriving in ({5: "new"}, {6: None, 9000: "more"}):
        for _ in range(2):
            assert K.upsert_table(spark, path, rows(spark, *arriving.items()), {"v": "fill"}, buckets=64) <= len(arriving)
        known |= {k: v for k, v in arriving.items() if v is not None}
        now = files(tmp_path / "table")
        assert sum(size for f, size in now.items() if f not in before) < sum(before.values()) / 8
        assert {r.id: r.v for r in K.read_slots(spark, path, FIELDS).collect()} == known
    assert K.upsert_table(spark, path, rows(spark, (None, "x")), {}, buckets=64) == 0


def test_replaced_bases_and_deltas_go(spark, tmp_path):
    """A stream of many batches keeps two bases, and a batch that comes again changes nothing."""
    path = f"file://{tmp_path}/table"
    landed = tmp_path / "landed"
    for k in range(9):
        arrived = rows(spark, (k % 3, f"v{k}"), (100 + k, "once")).withColumn("at", F.lit(k))
        arrived.coalesce(1).write.mode("append").parquet(f"file://{landed}")
    stream = J.landing(spark, f"file://{landed}", arrived.schema, files_per_batch=1)
    sink = J.upsert_sink(stream, path, ["at"], ["id"], compact_every=2)
    sink.option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    names = set(os.listdir(tmp_path / "table"))
    assert {n for n in names if n.startswith("base-")} == {"base-6", "base-8"} and {n for n in names if n.startswith("delta-")} == {"delta-7", "delta-8"}
    wanted = {**{100 + k: "once" for k in range(9)}, 0: "v6", 1: "v7", 2: "v8"}
    assert {r.id: r.v for r in J.read_upserts(spark, path, ["id"]).collect()} == wanted
