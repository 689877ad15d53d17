"""Mixing: targets, whole words, caps and reruns on awkward rows."""

import heapq
import random
from collections import defaultdict

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import mixing
from tidemark.llm.mixing import mix

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("target", T.StringType())])


def targets(sizes):
    """Fills up by weight, source after source reaching three times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, found = float(sum(sizes.values())), set(order), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * sizes[s] < share * weight[s]}
        if not full:
            return found | {s: share * weight[s] for s in open_}
        for s in full:
            found[s] = 3.0 * sizes[s]
            left -= found[s]
        open_ -= full
    return found


def test_mix_meets_targets(spark):
    rows = [(k, "word " * (k % 97), f"s{k % 5}", "x") for k in range(1500)]
    rows += [(k, "a\tb\x0bc " * 40, None, None) for k in range(2000, 2010)] + [(3000, None, "s1", "x"), (3001, "", "s2", "x"), (None, "three more words", "s2", "x"), (5, "word " * 5, "s0", "x"), (4000, "one " * 30_000, "s3", "x"), (4001, "tiny", "zz", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = mix(docs).collect()
    assert len(found) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    by_id = {(r[0], len((r[1] or "").split())): r[2] for r in rows}
    for r in found:
        source = by_id[r.doc_id, r.size]
        sizes[source] += r.size
        taken[source] += r.taken
        target[source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    wanted = targets(sizes)
    for source in sizes:
        assert abs(target[source] - wanted[source]) < 1e-6 * max(1, wanted[source])
        assert abs(taken[source] - target[source]) <= 64 + 0.02 * target[source]
    assert sorted(map(str, mix(docs.repartition(3)).collect())) == sorted(map(str, found))


def test_no_rows_and_no_words(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
    found = mix(spark.createDataFrame([(1, None, "a", "x"), (2, " ", None, "x")], SCHEMA)).collect()
    assert [(r.size, r.taken) for r in found] == [(0, 0), (0, 0)]


def test_short_documents_reach_their_targets(spark, monkeypatch):
    """Shards of about four rows: whole blocks are more than three times most of them."""
    monkeypatch.setattr(mixing, "SHARD_ROWS", 4)
    rows = [(k, "word " * (10, 25, 3)[k % 3], f"s{k % 3}", "x") for k in range(3000)] + [(9000 + k, "word " * 10, "s3", "x") for k in range(90)] + [(9500 + k, "word " * (2000 if k == 0 else 1), "s4", "x") for k in range(50)]
    found = mix(spark.createDataFrame(rows, SCHEMA)).collect()
    source = {r[0]: r[2] for r in rows}
    taken, target = defaultdict(int), {}
    for r in found:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert len(found) == len(rows) and len(target) == 5
    for s in target:
        assert abs(taken[s] - target[s]) <= 64, (s, taken[s], target[s])


def test_uneven_shares_are_exact(spark):
    """One large share beside many small ones is due every block; half a block rounds to none."""
    parts = spark.createDataFrame([(k, 100_000 if k == 0 else 20, 1875) for k in range(1000)], "shard int, words long, blocks long")
    found = mixing._seats(parts.withColumn("k", F.lit("a")), ["k"], "words", "blocks", F.floor(F.col("words") * 3 / 64).cast("long"), ["shard"])
    assert [(r.shard, r.quota) for r in found.filter("quota > 0").collect()] == [(0, 1875)]


def test_seats_equal_one_seat_at_a_time(spark):
    """Quotas by divisors against a heap that gives each seat to the highest next quotient."""
    pick = random.Random(4)
    rows = [(group, part, size, blocks) for group, blocks in enumerate((0, 1, 7, 250, 400, 90)) for part, size in enumerate([10_000, *(pick.choice([0, 1, 30, 30, 64, pick.randint(1, 5000)]) for _ in range(200))])]
    parts = spark.createDataFrame(rows, "k int, shard int, words long, blocks long")
    found = {(r.k, r.shard): r.quota for r in mixing._seats(parts, ["k"], "words", "blocks", F.floor(F.col("words") * 3 / 64).cast("long"), ["shard"]).collect()}
    for group in range(6):
        own = {shard: words for k, shard, words, _ in rows if k == group}
        seats, given = next(r[3] for r in rows if r[0] == group), dict.fromkeys(own, 0)
        heap = [(-words, shard) for shard, words in own.items() if words * 3 // 64]
        heapq.heapify(heap)
        while seats and heap:
            _, shard = heapq.heappop(heap)
            given[shard] += 1
            seats -= 1
            if given[shard] < own[shard] * 3 // 64:
                heapq.heappush(heap, (-own[shard] / (2 * given[shard] + 1), shard))
        assert {shard: found[group, shard] for shard in own} == given
