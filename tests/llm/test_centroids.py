"""Centroid clustering against plain Python integers."""

import hashlib
import math

import pytest
from pyspark.sql import types as T

from tidemark.llm import centroids
from tidemark.llm.centroids import cluster_vectors

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("cluster", T.StringType())])
MOST = 2**63 - 1


def plain(rows, clusters=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    drawn = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    ends = [list(v) for _, v in drawn[:clusters]]

    def assign(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), c) for c, e in enumerate(ends))

    for _ in range(rounds):
        of = [assign(v)[1] for _, v in kept]
        for c in range(len(ends)):
            members = [v for (_, v), k in zip(kept, of, strict=True) if k == c]
            if members:
                ends[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    found = [(i, *assign(v)[::-1]) for i, v in kept]
    within = {c: sum(d for _, k, d in found if k == c) for c in range(len(ends))}
    digest = [hashlib.sha256(",".join(map(str, e)).encode()).hexdigest() for e in ends]
    return sorted(((i, c, min(d, MOST), min(within[c], MOST), min(sum(within.values()), MOST), digest[c]) for i, c, d in found), key=repr)


def vectors():
    import random

    draw = random.Random(7)
    rows = [(k, [draw.gauss(k % 7, 0.4) for _ in range(64)], "x") for k in range(300)]
    rows += [(400, None, "x"), (401, [], "x"), (402, [0.5] * 63, "x"), (403, [0.5] * 65, "x"), (404, [None] + [0.5] * 63, "x"), (405, [math.nan] * 64, "x"), (406, [-math.inf] * 64, "x")]
    return rows + [(None, [-0.01] * 64, "x"), (None, [3.0] * 64, None), rows[0], rows[0], (407, rows[1][1], "x")]


@pytest.mark.parametrize("step", [8192, 7])
def test_against_plain_integers(spark, monkeypatch, step):
    monkeypatch.setattr(centroids, "STEP_ROWS", step)
    found = cluster_vectors(spark.createDataFrame(vectors(), SCHEMA)).collect()
    assert sorted(map(tuple, found), key=repr) == plain(vectors())


@pytest.mark.parametrize("rows", [vectors()[:1], vectors()[:5], [vectors()[0]] * 40, [(k, [float(k // 4)] * 64, "x") for k in range(40)]])
def test_few_equal_and_tied(spark, rows):
    found = cluster_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, found), key=repr) == plain(rows)


def test_large_components_are_exact_until_a_long_is_full(spark):
    rows = vectors()[:40] + [(500 + k, [2.0**24 * (k + 1)] * 32 + [-(2.0**24)] * 32, "x") for k in range(5)] + [(600, [1e13] * 64, "x")]
    found = cluster_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, found), key=repr) == plain(rows)
    assert any(r.inertia > 2**53 for r in found)
    assert cluster_vectors(spark.createDataFrame([(1, [1e300] * 64, "x"), (2, [-1e300] * 64, "x"), (3, [0.0] * 64, "x")], SCHEMA)).count() == 3


def test_no_rows(spark):
    assert cluster_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    assert cluster_vectors(spark.createDataFrame([(1, None, "x"), (2, [1.0], "x")], SCHEMA)).collect() == []
