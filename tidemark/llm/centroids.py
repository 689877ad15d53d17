"""Centroid clustering of whole-number vectors by scalar lookup tables.

A round needs the squared distance of every vector to every centroid. In each batch of rows the integers that occur in a
dimension are few, so their squared differences to the centroids are tabulated once, (integers x centroids) for each
dimension, and a distance is the sum of the rows gathered from these tables. No product of a vector is formed. Sums for the
next centroids are made per task, then per (cluster, dimension); what reaches the driver is one number for each of those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import table, written

CLUSTERS, ROUNDS, DIMENSIONS, SCALE = 16, 3, 64, 64
#: Components are cut off here, so that they fit a long and their sums a decimal of 38 digits.
LARGEST = 2**62
#: Up to here squared distances over 64 dimensions fit a long; beyond it tables hold Python's integers.
EXACT_IN_LONGS = 2**27
LONG = 2**63 - 1
#: Rows that are looked up at a time: tables and distances of a step stay within a few megabytes.
STEP_ROWS = 8192


def whole_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v as longs) of the vectors of exactly that many components, none null or non-finite."""
    usable = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    kept = kept.filter((F.size("x") == dimensions) & F.forall("x", usable))
    cut = lambda x: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), F.lit(float(scale)) * x)))
    return kept.select("vec_id", F.transform("x", cut).alias("v"))


def seeds(points: DataFrame, clusters: int = CLUSTERS, salt: str = "1") -> list[list[int]]:
    """The vectors whose ids draw the smallest hashes, in that order; rows without an id come last, equal ids by their vectors."""
    drawn = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = points.select(drawn.alias("drawn"), "v").orderBy(F.asc_nulls_last("drawn"), "v").limit(clusters).collect()
    return [list(r.v) for r in rows]


def _matrix(column: pa.ListArray) -> np.ndarray:
    """The lists of a batch, all of one length, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(points: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid, ties to the smaller number, and its squared distance, cut off at the largest long."""
    known = [x for centroid in centroids for x in (min(centroid), max(centroid))]
    small = max(map(abs, [*known, int(points.min(initial=0)), int(points.max(initial=0))])) <= EXACT_IN_LONGS
    kind = np.int64 if small else object
    ends = np.array(centroids, dtype=kind)
    away = np.zeros((len(points), len(ends)), dtype=kind)
    for d in range(points.shape[1]):
        values, at = np.unique(points[:, d], return_inverse=True)
        squared = (values.astype(kind)[:, None] - ends[None, :, d]) ** 2
        away += squared[at]
    first = away.argmin(axis=1)
    least = away[np.arange(len(points)), first]
    return first.astype(np.int32), least if small else np.minimum(least, LONG).astype(np.int64)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP_ROWS):
            yield batch.slice(at, STEP_ROWS)


def _moved(points: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: every one that has vectors becomes the floor of their exact mean, component by component."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [[0] * len(c) for c in centroids], [0] * len(centroids)
        for batch in _steps(batches):
            rows = _matrix(batch.column(0))
            cluster, _ = nearest(rows, centroids)
            wide = rows if max(-int(rows.min(initial=0)), int(rows.max(initial=0))) < LONG // STEP_ROWS else rows.astype(object)
            for c in np.unique(cluster).tolist():
                members = wide[cluster == c]
                counts[c] += len(members)
                sums[c] = [s + int(x) for s, x in zip(sums[c], members.sum(axis=0), strict=True)]
        used = [(c, d, Decimal(sums[c][d]), counts[c]) for c in range(len(centroids)) if counts[c] for d in range(len(centroids[c]))]
        kinds = [pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64()]
        columns = zip(*used, strict=True) if used else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["cluster", "at", "total", "n"])

    parts = points.select("v").mapInArrow(add_up, "cluster int, at int, total decimal(38,0), n long")
    moved = [list(c) for c in centroids]
    for r in parts.groupBy("cluster", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        moved[r.cluster][r.at] = int(r.total) // r.n
    return moved


def _as_long(total: Column) -> Column:
    return F.least(total, F.lit(LONG).cast("decimal(38,0)")).cast("long")


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """Per kept vector of (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    A component x counts as floor(scale x) in double precision. Vectors that are null, of another length, or hold null or
    non-finite components take no part; other columns are ignored. The first centroids are the vectors whose ids draw the
    smallest hashes: rows that repeat are vectors of their own, rows without an id are clustered but chosen last. With fewer
    vectors than clusters there are as many centroids as vectors. Equal distances go to the smaller number, so equal
    vectors share a cluster and a centroid that repeats an earlier one stays empty and where it is. Distances and their sums
    are exact as long as they fit a long, and are the largest long beyond. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    points = written(whole_vectors(vectors, dimensions, scale), "points")
    centroids = seeds(points, clusters)
    for _ in range(rounds if centroids else 0):
        centroids = _moved(points, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            cluster, distance = nearest(_matrix(batch.column(1)), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned, _ = table(points.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    sums = {r.cluster: r.total for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    every = sum(sums.values(), Decimal(0))
    # One row for each cluster that has vectors, so at most ``clusters`` rows.
    of = spark.createDataFrame([(c, sums[c], every, digests[c]) for c in sums], "of int, of_cluster decimal(38,0), of_all decimal(38,0), centroid_sha256 string")
    named = assigned.join(F.broadcast(of), F.col("cluster") == F.col("of"))
    return named.select("vec_id", "cluster", "distance", _as_long(F.col("of_cluster")).alias("cluster_inertia"), _as_long(F.col("of_all")).alias("inertia"), "centroid_sha256")
