"""Approximate nearest neighbours by cosine: one vantage-point tree per shard.

On unit vectors the largest cosine is the least distance, which is a metric. A subtree, or a whole cell of shards, is left
out when the triangle inequality's lower bound, times ``factor``, exceeds the k-th distance found: factor 1 is exact, ties
to the smaller vec_id included, larger ones prune more.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.llm.vectors import CELL_ROWS, KEYS, MOST_CELLS, asked_once, best, celled, meetings, several_cells, sharded, split_cells, spread_out, units, usable, visits, with_kth

LEAF = 48
FACTOR = 1.5
#: Slack of cosines and of the distances made of them: near 0 a distance is the root of a rounding error.
COSINE_SLACK, DISTANCE_SLACK = 1e-12, 1e-6


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosine of each pair of rows; equal rows give equal numbers."""
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


class Tree:
    """Rows in tree order: a node over [start, stop) has its vantage point first, then the nearer half, then the farther."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, radii: np.ndarray | None = None):
        self.ids, self.vectors = ids, vectors
        self.units = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
        self.radii = np.zeros(len(ids)) if radii is None else radii
        if radii is None:
            self._build()

    def _build(self) -> None:
        order, todo = np.argsort(self.ids, kind="stable"), [(0, len(self.ids))]
        while todo:
            start, stop = todo.pop()
            if stop - start <= LEAF:
                continue
            away = self._distance(self.units[order[start + 1 : stop]], self.units[order[start]])
            by = np.argsort(away, kind="stable")
            order[start + 1 : stop] = order[start + 1 : stop][by]
            middle = (start + 1 + stop) // 2
            self.radii[start] = (away[by[middle - start - 2]] + away[by[middle - start - 1]]) / 2
            todo += [(start + 1, middle), (middle, stop)]
        self.ids, self.vectors, self.units = self.ids[order], self.vectors[order], self.units[order]

    @staticmethod
    def _distance(points: np.ndarray, one: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * (points @ one)))

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, vectors=self.vectors, radii=self.radii)
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as kept:
            return cls(kept["ids"], kept["vectors"], kept["radii"])

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Per query the tree rows of its k nearest (-1: none), ties to the smaller id, and their cosines; all queries descend together."""
        asked = units(queries)
        rows, score = np.full((len(own), k), -1), np.full((len(own), k), -np.inf)
        ids = np.append(self.ids, np.iinfo(np.int64).max)

        def meet(who: np.ndarray, start: int, stop: int) -> np.ndarray:
            """Keeps what belongs to the k best so far; the cosines are computed on the vectors themselves where they can count."""
            about = asked[who] @ self.units[start:stop].T
            near = (about >= score[who, -1:] - COSINE_SLACK) & (self.ids[None, start:stop] != own[who, None])
            who_near, at = np.nonzero(near)
            exact = np.full(about.shape, -np.inf)
            exact[who_near, at] = cosines(queries[who[who_near]], self.vectors[start + at])
            every = np.concatenate([score[who], exact], axis=1)
            place = np.concatenate([rows[who], np.where(near, np.arange(start, stop)[None, :], -1)], axis=1)
            pick = np.lexsort((ids[place], -every), axis=1)[:, :k]
            score[who], rows[who] = np.take_along_axis(every, pick, 1), np.take_along_axis(place, pick, 1)
            return about

        def descend(who: np.ndarray, start: int, stop: int) -> None:
            """The leaf on each query's side gives a first k-th distance, which the real pass starts from."""
            if len(who) and stop - start <= LEAF:
                meet(who, start, stop)
                first[who] = score[who, -1]
            elif len(who):
                middle, inside = (start + 1 + stop) // 2, self._distance(asked[who], self.units[start]) < self.radii[start]
                descend(who[inside], start + 1, middle)
                descend(who[~inside], middle, stop)

        first = np.full(len(own), -np.inf)
        descend(np.arange(len(own)), 0, len(self.ids))
        rows[:], score[:] = -1, -np.inf
        todo = [(np.arange(len(own)), 0, len(self.ids))]
        while todo:
            who, start, stop = todo.pop()
            if not len(who) or stop <= start:
                continue
            if stop - start <= LEAF:
                meet(who, start, stop)
                continue
            d, middle = np.sqrt(np.maximum(0.0, 2 - 2 * meet(who, start, start + 1)[:, 0])), (start + 1 + stop) // 2
            limit = np.sqrt(np.maximum(0.0, 2 - 2 * np.maximum(first[who], score[who, -1]))) + DISTANCE_SLACK
            todo.append((who[(self.radii[start] - d) * factor <= limit], middle, stop))
            todo.append((who[(d - self.radii[start]) * factor <= limit], start + 1, middle))
        return rows, score


def build_index(vectors: DataFrame) -> DataFrame:
    """(dim, cell, shard, centre, radius, size, tree) over all usable rows of (vec_id, embedding); other columns are ignored.

    Zero vectors have no cosine and take no part. Rows that repeat are indexed each time. The centres of the cells come from
    bounded samples; they affect speed, and recall at factors over 1. An empty table gives no rows.
    """
    points = usable(vectors).filter(F.exists("v", lambda x: x != 0))
    cells = min(MOST_CELLS, max(1, -(-points.count() // CELL_ROWS)))
    centres = spread_out(points, cells, unit=True)
    first = written(celled(points, centres, unit=True), "points")
    finer, centres = split_cells(first, centres, unit=True)
    dealt, _ = sharded(first if finer is first else written(finer, "cells"))

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        dim, cell, _ = key
        centre = centres[dim][cell].tolist() if dim in centres else None
        tree = Tree(rows["vec_id"].to_numpy(), np.stack(rows["v"].to_numpy())).dumps()
        return pd.DataFrame([(*key, centre, rows["away"].max(), len(rows), tree)], columns=["dim", "cell", "shard", "centre", "radius", "size", "tree"])

    return written(dealt.groupBy("dim", "cell", "shard").applyInPandas(grow, "dim int, cell int, shard int, centre array<double>, radius double, size long, tree binary"), "trees")


def _promise(known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]], factor: float):
    """By length: cells, radii, numbers of rows and centres. A row of a cell is at least as far from a query as the centre less the radius; ``factor`` stretches that bound."""

    none = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), None)

    def promise(query: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        cells, radius, sizes, centre = known.get(dim, none)
        if centre is None:
            return cells, np.full(len(cells), np.inf), np.zeros(len(cells)), sizes
        away = np.sqrt(((centre - units(query)) ** 2).sum(axis=1))
        low = np.maximum(0.0, (away - radius) * factor - DISTANCE_SLACK)
        return cells, 1 - low * low / 2 + COSINE_SLACK, -away, sizes

    return promise


def nearest(queries: DataFrame, index: DataFrame, k: int = 5, factor: float = FACTOR) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest in the index by cosine, in double precision.

    Queries (vec_id, embedding; other columns are ignored) that are null, empty, zero or hold null or non-finite components,
    or have no id, take no part; vectors of different length do not meet. Rows with the query's own vec_id are not its
    candidates; ties go to the smaller vec_id. A row that is repeated in the index is found each time; a query id that
    repeats is asked once, with its least vector. Empty tables give no rows.
    """
    asked = written(asked_once(usable(queries).filter(F.exists("v", lambda x: x != 0)).withColumnRenamed("vec_id", "query_id")), "asked")
    cells = index.groupBy("dim", "cell").agg((F.max("shard") + 1).alias("shards"), F.max("radius").alias("radius"), F.sum("size").alias("size"), F.first("centre").alias("centre")).toArrow()
    shards = {(d, c): n for d, c, n in zip(*(cells.column(name).to_pylist() for name in ("dim", "cell", "shards")), strict=True)}
    known = {}
    for dim in {d for d, _ in shards}:
        of = cells.filter(pc.equal(cells.column("dim"), dim)).combine_chunks()
        centre = of.column("centre").combine_chunks()
        known[dim] = of.column("cell").to_numpy().astype(np.int64), of.column("radius").to_numpy(), of.column("size").to_numpy(), None if centre.null_count else centre.flatten().to_numpy().reshape(-1, dim)
    promise = _promise(known, factor)

    def search(asked: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        found: list[pd.DataFrame] = []
        for data in trees["tree"] if len(asked) else ():
            tree, own, q = Tree.loads(data), asked["query_id"].to_numpy(), np.stack(asked["v"].to_numpy())
            rows, score = tree.search(own, q, k, factor)
            who, slot = np.nonzero(rows >= 0)
            found.append(pd.DataFrame({"query_id": own[who], "vec_id": tree.ids[rows[who, slot]], "score": score[who, slot]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    def met(going: DataFrame) -> DataFrame:
        left, right = meetings(going, index.select("dim", "cell", "shard", "tree"), shards)
        return left.groupBy(*KEYS).cogroup(right.groupBy(*KEYS)).applyInPandas(search, "query_id long, vec_id long, score double")

    first = written(best(met(written(visits(asked, promise, first=True), "first")), k), "found")
    if not several_cells(shards):
        return first
    more = met(written(visits(with_kth(asked, first, k), promise, first=False), "more"))
    return best(first.select("query_id", "vec_id", "score").union(more), k)
