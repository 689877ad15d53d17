"""Both vector searches against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import types as T

from tidemark.llm import pivot_search, vantage
from tidemark.llm import vectors as vectors_
from tidemark.llm.pivot_search import top_k
from tidemark.llm.vantage import build_index, nearest

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.StringType())])


def vectors():
    draw = np.random.default_rng(3)
    rows = [(k, [float(np.float32(x)) for x in draw.normal(size=8)], "x") for k in range(1200)]
    rows[300] = (300, rows[0][1], "x")
    rows += [(2000, None, "x"), (2100, [], "x"), (2200, [1.0, None] + [0.0] * 6, "x"), (2300, [math.nan] * 8, "x"), (2400, [math.inf] * 8, "x"), (2500, [0.0] * 8, "x"), (2600, [1.0, 2.0], "x"), (2601, [2.0, 1.0], None), (None, [1.0] * 8, "x"), rows[700], rows[701]]
    return rows


def good(rows, zero=True):
    return [(i, np.array(v, np.float64)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and (zero or np.any(v))]


def small_cells(monkeypatch):
    """Several cells of several shards, as large tables have them."""
    for module in (pivot_search, vantage, vectors_):
        monkeypatch.setattr(module, "CELL_ROWS", 150)
    monkeypatch.setattr(vectors_, "SHARD_ROWS", 60)
    monkeypatch.setattr(vectors_, "QUERY_BLOCK", 3)


def split_small_cells(monkeypatch):
    """Few cells that all are cells of cells, as tables beyond MOST_CELLS cells have them."""
    for module in (pivot_search, vantage, vectors_):
        monkeypatch.setattr(module, "CELL_ROWS", 30)
        monkeypatch.setattr(module, "MOST_CELLS", 4)
    monkeypatch.setattr(vectors_, "SPLIT_ROWS", 60)
    monkeypatch.setattr(vectors_, "SHARD_ROWS", 20)
    monkeypatch.setattr(vectors_, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vectors_, "VISITS", 5)


CELLS = pytest.mark.parametrize("cells", [lambda monkeypatch: None, small_cells, split_small_cells], ids=["one", "several", "split"])


@CELLS
def test_top_k_is_exact(spark, monkeypatch, cells):
    cells(monkeypatch)
    rows = vectors()
    frame = spark.createDataFrame(rows, SCHEMA)
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in good(rows)]
    wanted = []
    for q, v in {i: v for i, v in sorted(whole, reverse=True) if i % 100 == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q and len(w) == len(v))
        wanted += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:10])]
    found = top_k(frame.filter("vec_id % 100 = 0"), frame).collect()
    assert sorted(map(tuple, found)) == sorted(wanted)


@CELLS
def test_nearest_recall_and_exact_factor(spark, monkeypatch, cells):
    cells(monkeypatch)
    rows = vectors()
    frame = spark.createDataFrame(rows, SCHEMA)
    index, known = build_index(frame), good(rows, zero=False)
    wanted = {}
    for q, v in {i: v for i, v in known if i % 50 == 0}.items():
        scored = sorted((-(v @ w) / (math.sqrt(v @ v) * math.sqrt(w @ w)), i) for i, w in known if i != q and len(w) == len(v))
        wanted[q] = [(round(-s, 9), i) for s, i in scored[:5]]
    exact = {}
    for r in nearest(frame.filter("vec_id % 50 = 0"), index, factor=1.0).collect():
        exact.setdefault(r.query_id, []).append((r["rank"], round(r.score, 9), r.vec_id))
    assert {q: [x[0] for x in w] for q, w in wanted.items() if w} == {q: [x[1] for x in sorted(w)] for q, w in exact.items()}
    found = {(r.query_id, r.vec_id) for r in nearest(frame.filter("vec_id % 50 = 0"), index).collect()}
    pairs = {(q, i) for q, w in wanted.items() for _, i in w}
    assert len(found & pairs) >= 0.9 * len(pairs)


@pytest.mark.parametrize("cells", [small_cells, split_small_cells], ids=["several", "split"])
def test_ties_beyond_k_go_to_the_smallest_ids(spark, monkeypatch, cells):
    cells(monkeypatch)
    draw = np.random.default_rng(5)
    one = draw.normal(size=8)
    rows = [(k, one.tolist() if k % 3 == 0 else (one * 2.0 ** (k % 7)).tolist() if k % 3 == 1 and k % 2 else draw.normal(size=8).tolist(), "x") for k in range(900)]
    frame = spark.createDataFrame(rows, T.StructType([SCHEMA[0], T.StructField("embedding", T.ArrayType(T.DoubleType())), SCHEMA[2]]))
    index, known = build_index(frame), good(rows)
    ids, points = np.array([i for i, _ in known]), np.array([v for _, v in known])
    for factor in (1.0, 1.5):
        found = {}
        for r in nearest(frame.filter("vec_id % 50 = 0"), index, factor=factor).collect():
            found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        for q, v in ((i, v) for i, v in known if i % 50 == 0):
            score = vantage.cosines(np.broadcast_to(v, points.shape), points)
            order = [k for k in np.lexsort((ids, -score)) if ids[k] != q][:5]
            if factor == 1.0 or q % 3 == 0:
                assert [(n + 1, int(ids[k]), score[k]) for n, k in enumerate(order)] == sorted(found[q])


@pytest.mark.parametrize("module", [pivot_search, vantage], ids=["top_k", "nearest"])
def test_shards_that_a_query_visits_do_not_grow_with_the_table(spark, monkeypatch, module):
    """Beyond the cap of cells: four cells of clusters, twice as many rows and clusters, as many shards for each query."""
    monkeypatch.setattr(module, "CELL_ROWS", 20)
    monkeypatch.setattr(module, "MOST_CELLS", 4)
    monkeypatch.setattr(vectors_, "CELL_ROWS", 20)
    monkeypatch.setattr(vectors_, "MOST_CELLS", 64)
    monkeypatch.setattr(vectors_, "SHARD_ROWS", 20)
    draw, seen = np.random.default_rng(8), []
    plain = vectors_.meetings

    def counted(going, rows, shards):
        left, right = plain(going, rows, shards)
        seen[-1] += left.count()
        return left, right

    monkeypatch.setattr(module, "meetings", counted)
    for split in (60, 10**9):
        monkeypatch.setattr(vectors_, "SPLIT_ROWS", split)
        for clusters in (40, 80):
            middles = draw.normal(size=(clusters, 8))
            middles *= 10 / np.sqrt((middles**2).sum(axis=1))[:, None]
            rows = [(k, (middles[k % clusters] + 0.02 * draw.normal(size=8)).tolist()) for k in range(40 * clusters)]
            frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
            queries = frame.filter(f"vec_id < {clusters}")
            seen.append(0)
            found = (top_k(queries, frame, k=3) if module is pivot_search else nearest(queries, build_index(frame), k=3, factor=1.0)).count()
            assert found == 3 * clusters
            seen[-1] /= clusters
    few, many, few_unsplit, many_unsplit = seen
    assert many < 1.5 * few and many < many_unsplit / 3 and many_unsplit > 1.6 * few_unsplit


def test_recall_on_the_given_embeddings(spark):
    """Against brute force over all rows of the table."""
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    known = good([(r.vec_id, r.embedding, None) for r in frame.collect()], zero=False)
    ids, points = np.array([i for i, _ in known]), np.array([v for _, v in known])
    found, hits, total = {(r.query_id, r.vec_id) for r in nearest(frame.filter("vec_id % 50 = 0"), build_index(frame)).collect()}, 0, 0
    for q, v in ((i, v) for i, v in known if i % 50 == 0):
        score = vantage.cosines(np.broadcast_to(v, points.shape), points)
        wanted = [int(ids[k]) for k in np.lexsort((ids, -score)) if ids[k] != q][:5]
        hits, total = hits + sum((q, i) in found for i in wanted), total + len(wanted)
    assert total and hits >= 0.95 * total


def test_top_k_beyond_doubles(spark):
    """Products over 2**53 stay exact."""
    rows = [(k, [float(2**19 + k), float(2**18 + 7 * k), 1.0 + k]) for k in range(250)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    wanted = []
    for q, v in whole[::100]:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q)
        wanted += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:10])]
    assert max(r[3] for r in wanted) > 2**53
    assert sorted(map(tuple, top_k(frame.filter("vec_id % 100 = 0"), frame).collect())) == sorted(wanted)


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert top_k(none, none).count() == 0
    assert nearest(none, build_index(none)).count() == 0
