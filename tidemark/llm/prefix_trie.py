"""The trie of conversation prefixes: range minima over the sorted sequences' common prefixes.

A conversation is a path, one element of 20 bytes for each turn: a digest of role and text, and the text's length. Equal
paths are one row with a count. Distinct paths are sorted and dealt to shards by range, so a prefix owns an interval of
consecutive paths, and a prefix begins at the path whose common prefix with the one before is shorter. In a shard a sparse
table keeps the least common prefix of every run of 1, 2, 4, ... neighbours. Every candidate prefix then finds how far its
interval reaches to the left and to the right by binary search in that table, each on its own; no stack of open prefixes is
kept. What a node reports is a sum over its interval, so running sums give it, and a node whose interval goes on in the next
shard is put together from one row of each: sums are added, the least id is the least of all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: Bytes of an element: its digest, then the length of the text, most significant byte first.
DIGEST, LENGTH = 16, 4
WIDTH = DIGEST + LENGTH
#: Distinct paths that a shard holds on average: at most, and at least where there are partitions to spread them over.
SHARD_PATHS, FEWEST_PATHS = 20_000, 1_000
#: Characters of ids that are put together before they are hashed.
CHUNK = 1 << 20
NOBODY = hashlib.sha256(b"").hexdigest()


def turn_element(role: str = "role", text: str = "text") -> Column:
    """The element of a turn; null roles and texts are empty. The role's length keeps role and text apart."""
    role, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    return F.unhex(F.concat(digest, F.lpad(F.hex(F.octet_length(text)), 2 * LENGTH, "0")))


def conversation_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path) of every conversation: its turns in order of turn, nulls first, equal ones in order of their digests.

    Only digests are gathered, never texts: a conversation takes 20 bytes for each turn. Rows without conv_id are no conversation.
    """
    rows = turns.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", turn_element().alias("element"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("turn", "element"))), lambda x: F.hex(x["element"]))
    return rows.groupBy("conv_id").agg(ordered.alias("elements")).select("conv_id", F.unhex(F.array_join("elements", "")).alias("path"))


def with_borrowed_heads(paths: DataFrame, group: int = 5, modulus: int = 9) -> DataFrame:
    """Every conversation c rebuilt: the first h turns of conversation c - c % group, then its own after its first h; h = crc32(c) % modulus.

    A conversation that is not there lends nothing; at most ``group`` conversations borrow from one.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus
    lent = paths.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("lender"), F.substring("path", 1, WIDTH * (modulus - 1)).alias("head"))
    both = paths.withColumn("h", h.cast("int")).join(lent, F.col("conv_id") - F.col("conv_id") % group == F.col("lender"), "left")
    head = F.coalesce(F.col("head"), F.expr("X''"))
    return both.select("conv_id", F.concat(F.substring(head, F.lit(1), F.col("h") * WIDTH), F.substring("path", F.col("h") * WIDTH + 1, F.octet_length("path"))).alias("path"))


def ends_digests(members: DataFrame) -> DataFrame:
    """(key, ends): the SHA-256 of the ids (key, conv_id) of each key in numeric order, joined by commas.

    Ids are sorted in ranges over all tasks and put together in chunks there; a second pass feeds the chunks of a key in
    order to one digest, whose memory is a chunk. A digest is sequential, so the chunks of one key stay in one task.
    """

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size = None, None, [], 0

        def chunk() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([first], pa.int64()), pa.array([",".join(ids)], pa.string())], ["key", "first", "ids"])

        for batch in batches:
            for of, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (of != key or size > CHUNK):
                    yield chunk()
                    ids, size = [], 0
                if not ids:
                    key, first = of, conv_id
                ids.append(str(conv_id))
                size += len(ids[-1])
        if ids:
            yield chunk()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys, ends = [], []
            for of, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if of == key:
                    state.update(b",")
                else:
                    if key is not None:
                        keys.append(key)
                        ends.append(state.hexdigest())
                    key, state = of, hashlib.sha256()
                state.update(ids.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ends, pa.string())], ["key", "ends"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([state.hexdigest()], pa.string())], ["key", "ends"])

    chunks = members.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(put_together, "key string, first long, ids string")
    return chunks.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(digest, "key string, ends string")


def _common(x: bytes, y: bytes) -> int:
    """Elements at the front that two paths share."""
    n = min(len(x), len(y)) // WIDTH * WIDTH
    differ = np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n)
    return int(differ.argmax()) // WIDTH if differ.any() else n // WIDTH


def sparse_table(lcp: np.ndarray) -> list[np.ndarray]:
    """Level j holds at place i the least of lcp[i : i + 2**j]."""
    levels = [lcp]
    while 2 ** len(levels) <= len(lcp):
        half, last = 2 ** (len(levels) - 1), levels[-1]
        levels.append(np.minimum(last[: len(last) - half], last[half:]))
    return levels


def right_ends(levels: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The last row r that shares a prefix of ``depth`` with row ``at``: the least of lcp[at + 1 : r + 1] is not below depth."""
    end = at.copy()
    for j in range(len(levels) - 1, -1, -1):
        start = end + 1
        fits = start < len(levels[j])
        fits[fits] = levels[j][start[fits]] >= depth[fits]
        end[fits] += 2**j
    return end


def left_ends(levels: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The first row l that shares a prefix of ``depth`` with row ``at``: the least of lcp[l + 1 : at + 1] is not below depth."""
    end = at.copy()
    for j in range(len(levels) - 1, -1, -1):
        start = end - 2**j + 1
        fits = start >= 1
        fits[fits] = levels[j][start[fits]] >= depth[fits]
        end[fits] -= 2**j
    return end


NODE = pa.schema(
    [
        ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("key", pa.string()), ("parent_key", pa.string()),
    ]
)
#: Nodes that are worked out at a time in a shard.
BATCH_NODES = 50_000


def _prefix_keys(path: bytes, depth: int) -> np.ndarray:
    """The digests of the path's prefixes of 0 to ``depth`` turns, each made from the one before."""
    state, keys = hashlib.sha256(), []
    for d in range(depth + 1):
        keys.append(state.hexdigest())
        state.update(path[d * WIDTH : (d + 1) * WIDTH])
    return np.array(keys, dtype=object)


def _least(levels: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least of rows left to right, as the lesser of two runs of 2**j that cover them."""
    span, found = np.floor(np.log2(right - left + 1)).astype(np.int64), np.empty(len(left), np.int64)
    for j in np.unique(span).tolist():
        here = span == j
        found[here] = np.minimum(levels[j][left[here]], levels[j][right[here] - 2**j + 1])
    return found


class Shard:
    """Sorted distinct paths with their numbers of members, least ids and digests of ids; and the neighbours' nearest paths, None where there are none.

    The nodes are those whose prefixes occur here. A node that goes on in another shard has a key, and only this shard's
    share of the sums; a node whose parent does has the parent's key in place of its id.
    """

    def __init__(self, paths: list[bytes], n: np.ndarray, least: np.ndarray, ends: list[str], before: bytes | None, after: bytes | None):
        self.paths, self.ends, self.rows = paths, np.array(ends, dtype=object), len(paths)
        # The root goes on wherever there is a neighbour, so where there is none the common prefix counts as -1.
        inner = [_common(x, y) for x, y in zip(paths, paths[1:], strict=False)]
        self.lcp = np.array([-1 if before is None else _common(before, paths[0]), *inner, -1 if after is None else _common(paths[-1], after)], np.int64)
        self.length = np.array([len(p) // WIDTH for p in paths], np.int64)
        self.levels, self.smallest = sparse_table(self.lcp[:-1]), sparse_table(least)
        self.first_keys, self.last_keys = _prefix_keys(paths[0], int(self.lcp[0])), _prefix_keys(paths[-1], int(self.lcp[-1]))
        # Bytes of the first 0, 1, ... texts of each path, in one array; those of path i begin at place[i].
        self.place = np.concatenate([[0], np.cumsum(self.length + 1)])
        self.bytes_at = np.zeros(self.place[-1], np.int64)
        powers = 256 ** np.arange(LENGTH - 1, -1, -1, dtype=np.int64)
        for path, start, stop in zip(paths, self.place, self.place[1:], strict=False):
            self.bytes_at[start + 1 : stop] = np.cumsum(np.frombuffer(path, np.uint8).reshape(-1, WIDTH)[:, DIGEST:].astype(np.int64) @ powers)
        self.whole = self.bytes_at[self.place[1:] - 1]
        new = self.whole - self.bytes_at[self.place[:-1] + np.maximum(self.lcp[:-1], 0)]
        # Running sums over the rows: members, the bytes of their texts, rows without longer ones, and bytes of the nodes that begin at a row.
        self.members, self.weighed, self.leaves, self.new = (np.concatenate([[0], np.cumsum(x)]) for x in (n, n * self.whole, self.lcp[1:] < self.length, new))
        # Rows by common prefix, then place: those of one common prefix in an interval are a run.
        self.by_lcp = np.sort(self.lcp[:-1] * (self.rows + 1) + np.arange(self.rows))

    def _interval(self, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last row of each prefix, and whether it goes on in the shard before or after."""
        left, right = left_ends(self.levels, at, depth), right_ends(self.levels, at, depth)
        return left, right, (left == 0) & (depth <= self.lcp[0]), (right == self.rows - 1) & (depth <= self.lcp[-1])

    def _keys(self, depth: np.ndarray, comes: np.ndarray, goes: np.ndarray) -> np.ndarray:
        """Keys of prefixes that go on: they are prefixes of the first path or of the last."""
        keys = np.full(len(depth), None, dtype=object)
        keys[goes] = self.last_keys[depth[goes]]
        keys[comes] = self.first_keys[depth[comes]]
        return keys

    def _children(self, left: np.ndarray, right: np.ndarray, depth: np.ndarray, comes: np.ndarray) -> np.ndarray:
        """Children that begin here: one at each later row whose common prefix is just ``depth``, and one at the first row if it is longer and no such prefix came from before."""
        base = depth * (self.rows + 1)
        later = np.searchsorted(self.by_lcp, base + right, "right") - np.searchsorted(self.by_lcp, base + left, "right")
        return later + ((self.length[left] > depth) & (~comes | (self.lcp[0] == depth)))

    def nodes(self) -> Iterator[pa.RecordBatch]:
        """All nodes as NODE. Candidates are every prefix of row 0, and those prefixes of the other rows that begin there."""
        begin = np.concatenate([[0], self.lcp[1:-1] + 1])
        first = np.concatenate([[0], np.cumsum(self.length - begin + 1)])
        cuts = np.flatnonzero(np.diff(first[:-1] // BATCH_NODES)) + 1
        for low, high in zip([0, *cuts], [*cuts, self.rows], strict=True):
            at = np.repeat(np.arange(low, high), np.diff(first[low : high + 1]))
            depth = np.arange(first[low], first[high]) - first[at] + begin[at]
            above = np.maximum(depth - 1, 0)
            left, right, comes, goes = self._interval(at, depth)
            parent_left, parent_right, parent_comes, parent_goes = self._interval(at, above)
            has_parent = depth > 0
            begun, convs = self.bytes_at[self.place[at] + above], self.members[right + 1] - self.members[left]
            texts = self.weighed[right + 1] - self.weighed[left] - begun * convs
            once = self.new[right + 1] - self.new[left + 1] + np.where(comes, self.new[left + 1] - self.new[left], self.whole[left] - begun)
            ended = self.length[left] == depth
            columns = [
                pa.array(_least(self.smallest, left, right)),
                pa.array(depth),
                pa.array(_least(self.smallest, parent_left, parent_right), mask=parent_comes | parent_goes | ~has_parent),
                pa.array(convs),
                pa.array(self._children(left, right, depth, comes)),
                pa.array(self.leaves[right + 1] - self.leaves[left]),
                pa.array(texts - once),
                pa.array(np.where(ended, self.ends[left], None), pa.string()),
                pa.array(self._keys(depth, comes, goes), pa.string()),
                pa.array(self._keys(above, parent_comes & has_parent, parent_goes & has_parent), pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=NODE)


def _shards(spark: SparkSession, paths: int, shard_paths: int) -> int:
    """Shards of at most about ``shard_paths`` distinct paths; a small table is spread over the session's partitions."""
    return max(1, -(-paths // shard_paths), min(int(spark.conf.get("spark.sql.shuffle.partitions")), paths // FEWEST_PATHS))


def prefix_trie(members: DataFrame, shard_paths: int = SHARD_PATHS) -> DataFrame:
    """The nodes of the trie over (conv_id, path): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conv_id is the smallest member. Any number of conversations may have one path: they are counted before they are
    shuffled. A path may be empty: its conversation ends at the root. One conversation is one path, and a task holds a shard
    of about ``shard_paths`` distinct ones. An empty table gives no rows.
    """
    spark = members.sparkSession
    members = written(members.select("conv_id", "path"), "members")
    counted = written(members.groupBy("path").agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).withColumn("key", F.sha2("path", 256)), "counted")
    repeated = counted.filter("n > 1").select(F.col("key").alias("of"))
    several = written(members.withColumn("key", F.sha2("path", 256)).join(repeated, F.col("key") == F.col("of")).select("key", "conv_id"), "several")
    ends = ends_digests(several).select(F.col("key").alias("of"), "ends")
    dealt = written(counted.repartitionByRange(_shards(spark, counted.count(), shard_paths), "path").withColumn("shard", F.spark_partition_id()), "dealt")
    # One row for each shard: its ends, and the nearest paths of its neighbours.
    by = W.orderBy("shard")
    borders = dealt.groupBy("shard").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    borders = written(borders.select("shard", F.lag("high").over(by).alias("before"), F.lead("low").over(by).alias("after")), "borders")
    named = dealt.join(ends, F.col("key") == F.col("of"), "left").select("shard", "path", "n", "least", F.coalesce("ends", F.sha2(F.col("least").cast("string"), 256)).alias("ends"))

    def walk(shard: pa.Table, border: pa.Table) -> pa.Table:
        paths, side = shard.column("path").to_pylist(), border.to_pylist()[0]
        order = sorted(range(len(paths)), key=paths.__getitem__)
        rows = shard.take(order)
        made = Shard([paths[i] for i in order], rows.column("n").to_numpy(), rows.column("least").to_numpy(), rows.column("ends").to_pylist(), side["before"], side["after"])
        return pa.Table.from_batches(list(made.nodes()), schema=NODE)

    fields = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key string, parent_key string"
    nodes = written(named.groupBy("shard").cogroup(borders.groupBy("shard")).applyInArrow(walk, fields), "nodes")
    # Nodes that several shards share are prefixes of a shard's first or last path. The parent of such a node is one, too.
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    shared = nodes.filter(F.col("key").isNotNull()).groupBy("key")
    shared = shared.agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), *sums, F.max("ends_sha256").alias("ends_sha256"), F.min("parent_key").alias("parent_key"))
    shared = written(shared.withColumn("parent_conv_id", F.lit(None).cast("long")), "shared")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "parent_key"]
    # Written first, so that the children of one node, as of the root, are dealt directly under the join and can be split.
    whole = written(nodes.filter(F.col("key").isNull()).select(columns).union(shared.select(columns)), "whole")
    parents = shared.select(F.col("key").alias("of"), F.col("conv_id").alias("of_id"))
    joined = whole.join(parents, F.col("parent_key") == F.col("of"), "left")
    named = [F.coalesce("of_id", "parent_conv_id").alias("parent_conv_id"), F.coalesce("ends_sha256", F.lit(NOBODY)).alias("ends_sha256")]
    return joined.select("conv_id", "depth", named[0], "n_convs", "n_children", "n_leaves", "saved_tokens", named[1])
