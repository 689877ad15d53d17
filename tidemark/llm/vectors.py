"""What the two vector searches share: usable vectors, cells around centres, and the searches that a bound leaves over.

Rows are dealt to the cell of their nearest centre. Cells of more than SPLIT_ROWS rows are dealt again to centres of their
own, so that cells stay small while the table grows; a cell is dealt to shards of about SHARD_ROWS rows. A query first
searches the cells that promise most, as many as hold a shard's rows; then only those cells whose centre and radius still allow one of its k best. Queries
of a cell meet its shards in blocks. For each length of vectors there are at most MOST_CELLS cells and at most MOST_CELLS
cells in each, and their centres are at most about CENTRE_VALUES numbers; beyond that cells grow and have more shards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERY_BLOCK, SHARD_ROWS, CELL_ROWS, MOST_CELLS, SPLIT_ROWS = 2048, 1024, 4096, 256, 16_384
#: Vectors from which pivots and centres are chosen, of the table and of each cell that is split; the choice affects speed only.
SAMPLE_ROWS, CELL_SAMPLE = 2000, 512
#: Components of all centres of one length that are held at once: 32 MB.
CENTRE_VALUES = 1 << 22
#: Visits that a task passes on at once.
VISITS = 1 << 16
KEYS = ("dim", "cell", "shard", "block")


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v as doubles, dim) of rows with an id and a vector without null or non-finite components."""
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    v = F.col(vector_col).cast("array<double>")
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return kept.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", finite)).withColumn("dim", F.size("v"))


def spread_out(vectors: DataFrame, most: int, unit: bool = False, sample: int = SAMPLE_ROWS) -> dict[int, np.ndarray]:
    """By length: vectors (at length one if ``unit``) far from one another, out of a bounded sample in hashed order; the first of them are as far apart as fewer can be."""
    rows = vectors.select("vec_id", "v", "dim").orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).collect()
    found = {}
    for dim in {r.dim for r in rows}:
        points = np.array([r.v for r in rows if r.dim == dim], np.float64)
        found[dim] = far_apart(units(points) if unit else points, most)
    return found


def far_apart(points: np.ndarray, most: int) -> np.ndarray:
    """Points of which each is the farthest from those before it."""
    far, chosen = np.full(len(points), np.inf), [0]
    while len(chosen) < min(most, len(points)):
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(far.argmax()))
    return points[chosen]


def units(points: np.ndarray) -> np.ndarray:
    """The vectors at length one; a zero vector stays."""
    length = np.sqrt((points * points).sum(axis=-1, keepdims=True))
    return points / np.where(length > 0, length, 1.0)


def matrices(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By length: the rows of that length and their vectors as one matrix."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, starts = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        yield int(dim), rows, flat[starts[rows][:, None] + np.arange(dim)]


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and the distance to it."""
    near = ((centres**2).sum(axis=1)[None, :] - 2 * (x @ centres.T)).argmin(axis=1)
    return near, np.sqrt(((x - centres[near]) ** 2).sum(axis=1))


def celled(points: DataFrame, centres: dict[int, np.ndarray], unit: bool) -> DataFrame:
    """Adds ``cell``, the nearest centre, and ``away``, the distance to it; without centres of that length cell 0 at distance 0."""
    names, at = points.columns, points.columns.index("v")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, aways = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for dim, rows, x in matrices(batch.column(at)):
                if dim in centres:
                    cells[rows], aways[rows] = nearest_centre(units(x) if unit else x, centres[dim])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32()), pa.array(aways, pa.float64())], [*names, "cell", "away"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    return points.mapInArrow(deal, f"{fields}, cell int, away double")


def split_cells(rows: DataFrame, centres: dict[int, np.ndarray], unit: bool) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """Rows of written cells and their centres, cells of more than SPLIT_ROWS rows dealt again to centres out of their own rows.

    ``cell`` then counts through the cells of all cells of a length, and ``away`` is the distance to that centre. Without large
    cells both come back as they are. Rows that are all equal stay in one cell.
    """
    counts = rows.groupBy("dim", "cell").count().filter(F.col("count") > SPLIT_ROWS).collect()
    most = {(r.dim, r.cell): min(MOST_CELLS, -(-r["count"] // CELL_ROWS), CENTRE_VALUES // (r.dim * len(centres.get(r.dim, [0])))) for r in counts}
    most = {key: n for key, n in most.items() if n > 1}
    if not most:
        return rows, centres

    def choose(key: tuple, sample: pd.DataFrame) -> pd.DataFrame:
        points = np.stack(sample["v"].to_numpy())
        chosen = far_apart(units(points) if unit else points, most[key])
        return pd.DataFrame({"dim": key[0], "cell": key[1], "centre": list(chosen)})

    large = rows.sparkSession.createDataFrame(list(most), "dim int, cell int")
    order = W.partitionBy("dim", "cell").orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v")
    sample = rows.select("vec_id", "v", "dim", "cell").join(F.broadcast(large), ["dim", "cell"]).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= CELL_SAMPLE)
    chosen = sample.groupBy("dim", "cell").applyInPandas(choose, "dim int, cell int, centre array<double>").toArrow()
    within: dict[tuple[int, int], np.ndarray] = {}
    keys = np.stack([chosen.column(c).to_numpy() for c in ("dim", "cell")], axis=1)
    for _, at, points in matrices(chosen.column("centre").combine_chunks()):
        for key in np.unique(keys[at], axis=0):
            within[tuple(key.tolist())] = points[(keys[at] == key).all(axis=1)]

    start, flat = {}, {}
    for dim in centres.keys() | {dim for dim, _ in within}:
        parts = [within.get((dim, k), centres[dim][k : k + 1] if dim in centres else None) for k in range(len(centres.get(dim, [0])))]
        flat[dim] = np.concatenate(parts)
        start |= {(dim, k): int(n) for k, n in enumerate(np.cumsum([0, *map(len, parts[:-1])]))}
    names = rows.columns

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, aways = batch.column("cell").to_numpy().copy(), batch.column("away").to_numpy().copy()
            for dim, at, x in matrices(batch.column("v")):
                old = cells[at]
                for cell in np.unique(old).tolist():
                    here = np.flatnonzero(old == cell)
                    near = 0
                    if (dim, cell) in within:
                        near, aways[at[here]] = nearest_centre(units(x[here]) if unit else x[here], within[dim, cell])
                    cells[at[here]] = start.get((dim, cell), cell) + near
            new = {"cell": pa.array(cells, pa.int32()), "away": pa.array(aways, pa.float64())}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names)

    return rows.mapInArrow(deal, rows.schema), flat


def sharded(rows: DataFrame) -> tuple[DataFrame, dict[tuple[int, int], tuple[int, float, int]]]:
    """Adds ``shard`` to the rows of written cells; and by (dim, cell) the numbers of shards, the radius and the number of rows."""
    counts = rows.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
    known = counts.withColumn("shards", F.ceil(F.col("n") / SHARD_ROWS).cast("int"))
    kept = {(r.dim, r.cell): (r.shards, r.radius, r.n) for r in known.collect()}
    of = rows.sparkSession.createDataFrame([(*key, shards) for key, (shards, *_) in kept.items()], "of_dim int, of_cell int, shards int")
    shard = F.pmod(F.xxhash64("vec_id", "v"), F.col("shards")).cast("int")
    joined = rows.join(F.broadcast(of), (F.col("dim") == F.col("of_dim")) & (F.col("cell") == F.col("of_cell")))
    return joined.withColumn("shard", shard).drop("of_dim", "of_cell", "shards"), kept


def several_cells(known: dict[tuple[int, int], object]) -> bool:
    """Whether vectors of one length are dealt to several cells (dim, cell); else the first visit has seen everything."""
    return len({dim for dim, _ in known}) < len(known)


def asked_once(queries: DataFrame) -> DataFrame:
    """(query_id, dim, v, ...): a query_id that repeats is asked once, with its least vector."""
    rest = [c for c in queries.columns if c not in ("query_id", "dim")]
    return queries.groupBy("query_id", "dim").agg(F.min(F.struct("v", *(c for c in rest if c != "v"))).alias("_")).select("query_id", "dim", "_.*")


def visits(asked: DataFrame, promise: Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], first: bool) -> DataFrame:
    """Each query once per cell that it visits.

    promise(v, dim) gives the cells that exist, a bound on the scores of what each holds, how much it promises, and its rows.
    The first visit goes to the most promising cells, until they hold SHARD_ROWS rows; later ones (asked has kth, the k-th
    score so far, null if there are fewer) to all others whose bound reaches kth.
    """
    names, columns = [c for c in asked.columns if c != "kth"], asked.columns

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.select(names)

            def chosen(rows: list[int], cells: list[np.ndarray], kept: pa.RecordBatch = kept) -> pa.RecordBatch:
                of = np.repeat(np.array(rows, np.int64), [len(c) for c in cells])
                taken = kept.take(pa.array(of, pa.int64()))
                return pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.concatenate(cells), pa.int32())], [*names, "cell"])

            rows, cells, held = [], [], 0
            kth = batch.column(columns.index("kth")).to_pylist() if not first else [None] * batch.num_rows
            for row, (v, dim, least) in enumerate(zip(batch.column(columns.index("v")), batch.column(columns.index("dim")).to_pylist(), kth, strict=True)):
                known, bounds, likely, sizes = promise(v.values.to_numpy(), dim)
                order = np.argsort(-likely, kind="stable")
                early = order[: np.searchsorted(np.cumsum(sizes[order]), SHARD_ROWS) + 1]
                wanted = early if first else np.setdiff1d(np.flatnonzero(bounds >= (-np.inf if least is None else least)), early)
                rows.append(row)
                cells.append(known[wanted])
                held += len(cells[-1])
                if held >= VISITS:
                    yield chosen(rows, cells)
                    rows, cells, held = [], [], 0
            if held:
                yield chosen(rows, cells)

    fields = ", ".join(f"{asked.schema[c].name} {asked.schema[c].dataType.simpleString()}" for c in names)
    return asked.mapInArrow(choose, f"{fields}, cell int")


def meetings(going: DataFrame, rows: DataFrame, shards: dict[tuple[int, int], int]) -> tuple[DataFrame, DataFrame]:
    """Visiting queries and visited rows (dim, cell, shard, ...) under common KEYS: a query for each shard of its cell, a shard for each block."""
    counts = going.groupBy("dim", "cell").count().collect()
    plan = [(r.dim, r.cell, shards[r.dim, r.cell], -(-r["count"] // QUERY_BLOCK)) for r in counts]
    of = F.broadcast(going.sparkSession.createDataFrame(plan, "of_dim int, of_cell int, shards int, blocks int"))
    same = (F.col("dim") == F.col("of_dim")) & (F.col("cell") == F.col("of_cell"))
    left = going.join(of, same).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    right = rows.join(of, same).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return left.drop("of_dim", "of_cell", "shards", "blocks"), right.drop("of_dim", "of_cell", "shards", "blocks")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query: query_id, rank, vec_id, score; ties to the smaller vec_id."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def with_kth(asked: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Queries with their k-th score in ``found`` (query_id, rank, score), null where there are fewer."""
    kth = found.filter(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("score").cast("double").alias("kth"))
    return asked.join(kth, F.col("query_id") == F.col("of"), "left").drop("of")
