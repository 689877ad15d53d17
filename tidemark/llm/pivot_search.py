"""Exact top-k inner products by pivot-table elimination.

Every vector keeps its distances to some pivots. They bound a query's distance to a candidate from below, by the greatest
difference over the pivots, and so its inner product from above. Candidates are evaluated in the order of that bound,
until it falls below the k-th score found. Cells of candidates whose centre and radius cannot reach that score are not
read for a query at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.llm.vectors import CELL_ROWS, KEYS, MOST_CELLS, asked_once, best, celled, matrices, meetings, several_cells, sharded, split_cells, spread_out, usable, visits, with_kth

SCALE = 1024
PIVOTS = 24
STEP = 256


def pivot_table(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds to (vec_id, v, dim) the distances to the pivots of that dimension; none where there are no pivots."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list = [[]] * batch.num_rows
            for dim, at, points in matrices(batch.column(1)):
                if dim in pivots:
                    away = np.stack([np.sqrt(((points - pivot) ** 2).sum(axis=1)) for pivot in pivots[dim]], axis=1)
                    for row, distances in zip(at.tolist(), away, strict=True):
                        rows[row] = distances
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float64()))], ["vec_id", "v", "dim", "pivots"])

    return vectors.select("vec_id", "v", "dim").mapInArrow(measure, "vec_id long, v array<double>, dim int, pivots array<double>")


def search_shard(query: np.ndarray, near: np.ndarray, own: int, ids: np.ndarray, points: np.ndarray, squares: np.ndarray, table: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of the shard's k best for one query, and how many candidates were evaluated.

    Whole numbers below 2**53 are exact as doubles; where products may exceed that they are taken as 64-bit integers, exact
    as long as the score itself fits. Bounds get a slack for the rounding of roots and sums.
    """
    low = np.abs(table - near).max(axis=1, initial=0.0)
    low = np.maximum(0.0, low * (1 - 1e-9) - 1e-6)
    bound = (query @ query + squares - low * low) / 2 + 1e-6 * (1 + squares)
    bound[ids == own] = -np.inf
    order = np.argsort(-bound, kind="stable")
    order = order[: np.count_nonzero(bound > -np.inf)]
    if len(query) * np.abs(query).max() * np.abs(points).max(initial=0.0) >= 2.0**53:
        query, points = query.astype(np.int64), points.astype(np.int64)
    scores, at = np.empty(0, points.dtype), 0
    while at < len(order):
        if at >= k and bound[order[at]] < np.partition(scores, len(scores) - k)[len(scores) - k]:
            break
        scores = np.concatenate([scores, points[order[at : at + STEP]] @ query])
        at += STEP
    seen = order[: len(scores)]
    top = np.lexsort((ids[seen], -scores))[:k]
    return ids[seen[top]], scores[top], len(seen)


def _promise(centres: dict[int, np.ndarray], dealt: dict[tuple[int, int], tuple[int, float, int]]):
    """A query's inner product with a cell's rows is at most that with the centre and its length times the radius."""
    known, none = {}, (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), None)
    for dim in {dim for dim, _ in dealt}:
        cells = np.array(sorted(cell for d, cell in dealt if d == dim), np.int64)
        radius, sizes = (np.array([dealt[dim, int(c)][k] for c in cells]) for k in (1, 2))
        known[dim] = cells, radius, sizes, centres[dim][cells] if dim in centres else None

    def promise(query: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        cells, radius, sizes, centre = known.get(dim, none)
        if centre is None:
            return cells, np.full(len(cells), np.inf), np.zeros(len(cells)), sizes
        with_centre, reach = centre @ query, np.sqrt(query @ query) * radius
        slack = 1e-9 * (np.abs(centre) @ np.abs(query) + reach) + 1e-3
        return cells, with_centre + reach + slack, with_centre, sizes

    return promise


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest whole-number inner products among other rows.

    Inputs: (vec_id, embedding); other columns are ignored. A component x counts as floor(1024 x) in double precision.
    Vectors that are null or empty or hold null or non-finite components, and rows without id, take no part; vectors of
    different length do not meet. Ties go to the smaller vec_id. Rows with the query's own vec_id are not its candidates; a
    candidate row that repeats is found each time; a query id that repeats is asked once, with its least vector. Components
    and scores are exact as long as they fit 64-bit integers. Empty tables give no rows.
    """
    whole = F.transform("v", lambda x: F.floor(F.lit(SCALE) * x).cast("double"))
    points = usable(candidates).withColumn("v", whole)
    far = spread_out(points, max(pivots, MOST_CELLS))
    cells = min(MOST_CELLS, max(1, -(-points.count() // CELL_ROWS)))
    chosen, centres = {dim: v[:pivots] for dim, v in far.items()}, {dim: v[:cells] for dim, v in far.items()}
    dealt = written(celled(pivot_table(points, chosen), centres, unit=False), "pivots")
    finer, centres = split_cells(dealt, centres, unit=False)
    rows, known = sharded(dealt if finer is dealt else written(finer, "cells"))
    asked = written(asked_once(pivot_table(usable(queries).withColumn("v", whole), chosen).withColumnRenamed("vec_id", "query_id")), "asked")
    promise = _promise(centres, known)
    shards = {key: n for key, (n, *_) in known.items()}

    def search(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(rows) and len(asked):
            ids, points, table = rows["vec_id"].to_numpy(), np.stack(rows["v"].to_numpy()), np.stack(rows["pivots"].to_numpy())
            squares = (points * points).sum(axis=1)
            for own, query, near in zip(asked["query_id"], asked["v"], asked["pivots"], strict=True):
                ids_found, scores, _ = search_shard(np.asarray(query), np.asarray(near), own, ids, points, squares, table, k)
                found += zip([own] * len(scores), ids_found.tolist(), map(int, scores), strict=True)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    def met(going: DataFrame) -> DataFrame:
        left, right = meetings(going, rows.drop("away"), shards)
        return left.groupBy(*KEYS).cogroup(right.groupBy(*KEYS)).applyInPandas(search, "query_id long, vec_id long, score long")

    first = written(best(met(written(visits(asked, promise, first=True), "first")), k), "found")
    if not several_cells(known):
        return first
    more = met(written(visits(with_kth(asked, first, k), promise, first=False), "more"))
    return best(first.select("query_id", "vec_id", "score").union(more), k)
