"""Near-duplicates by min-max hashing: both ends of every permutation enter the banded signatures.

Candidates share a band; every link is confirmed on the full shingle sets. Equal sets are one class from the start, so
copies are never compared. Within a band bucket all members are first compared with one centre; what is then joined
needs no further comparison. Members that are still in different components of one bucket are the open ones. For them all
links that are left are found by their rarest shingles: two similar sets must share one early in the order of rarity, earlier the nearer
their sizes are, so sets with more than a seventh of shingles of their own (at 75 %) do not meet in sets of their size at all.
Sketches refute what meets: a sketch has a bit for the parity of the shingles that fall on it, so two sets differ in at
least as many shingles as their sketches differ in bits. A narrow one is compared in the join itself and suffices up to some
400 shingles; pairs of longer texts leave the join as ids and meet sketches whose width follows the size. Texts are moved
only for what is left, which is about as much as there are links. In a group about the threshold whose members differ by
fewer shingles of their own, or by shingles that many of them share, the pairs looked at still grow with its square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import Memo, drop, table
from tidemark.llm.components import components

WORDS = 5
BANDS, PERMUTATIONS_PER_BAND = 40, 2
#: Orders in which centres are chosen: an unlucky centre of one order is compensated by the others.
ORDERS = 8
#: Shingles that are hashed by all permutations at a time.
BLOCK = 2048
#: 64-bit words of the parity sketches that the join itself compares, and bits for each shingle of the wide ones.
SKETCH_WORDS, WIDE_BITS = 8, 4
#: Step of the size classes in which the larger of two sets meets smaller ones.
CLASS_STEP = 1.05
_draw = np.random.default_rng(20_240_501)
MULTIPLIERS = _draw.integers(0, 2**63, BANDS * PERMUTATIONS_PER_BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND_WEIGHTS = _draw.integers(0, 2**63, (BANDS, 2 * PERMUTATIONS_PER_BAND), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND_SALTS = _draw.integers(0, 2**63, BANDS, dtype=np.uint64)
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles of five words; the only place that knows what a word is."""

    def __init__(self):
        self.words = Memo(xxhash.xxh3_64_intdigest)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        codes = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        width = min(WORDS, len(codes))
        found = np.full(len(codes) - width + 1, np.uint64(width))
        for k in range(width):
            found = found * STEP + codes[k : len(codes) - width + 1 + k]
        return np.unique(_mixed(found))


def min_max_bands(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit key per band: each permutation is evaluated once and gives its minimum and its maximum."""
    low = np.full(len(MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(MULTIPLIERS), np.uint64)
    for at in range(0, len(shingles), BLOCK):
        permuted = shingles[at : at + BLOCK, None] * MULTIPLIERS
        np.minimum(low, permuted.min(axis=0), out=low)
        np.maximum(high, permuted.max(axis=0), out=high)
    ends = np.concatenate([low.reshape(BANDS, -1), high.reshape(BANDS, -1)], axis=1)
    return _mixed((_mixed(ends) * BAND_WEIGHTS).sum(axis=1, dtype=np.uint64) + BAND_SALTS).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """Per document doc_id, text_hash, n_shingles, node (a digest of its shingle set; null without words) and bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in batches:
            sizes, nodes, bands = [], [], []
            for text in batch.column(1):
                found = shingle(text.as_py())
                sizes.append(len(found))
                nodes.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                bands.append(min_max_bands(found) if len(found) else None)
            arrays = [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_hash", "n_shingles", "node", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(sign, f"doc_id {kind}, text_hash long, n_shingles long, node binary, bands array<long>")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes (node, doc_id); a doc_id that has several texts gives only the one that fits."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in batches:
            fits = [xxhash.xxh3_128_digest(shingle(text.as_py()).tobytes()) == node.as_py() for node, text in zip(batch.column(0), batch.column(1), strict=True)]
            yield batch.filter(pa.array(fits, pa.bool_()))

    right = wanted.select("node", F.col("doc_id").alias("wanted_id"))
    both = docs.select("doc_id", "text").join(right, F.col("doc_id").eqNullSafe(F.col("wanted_id"))).select("node", "text")
    return both.mapInArrow(fit, "node binary, text string")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in batches:
            keep, last, first = [], None, None
            for a, text_a, text_b in zip(batch.column(0), batch.column(2), batch.column(3), strict=True):
                if last != (node := a.as_py()):
                    last, first = node, shingle(text_a.as_py())
                second = shingle(text_b.as_py())
                shared = len(np.intersect1d(first, second, assume_unique=True))
                keep.append(100 * shared >= percent * (len(first) + len(second) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    of_b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    of_a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    both = pairs.select("a", "b").join(of_b, "b").join(of_a, "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(confirm, "a binary, b binary")


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """Bits that are set where an odd number of shingles falls on them."""
    odd = np.bincount((shingles % np.uint64(64 * SKETCH_WORDS)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_sketch(shingles: np.ndarray) -> np.ndarray:
    """As parity_sketch, with a power of two of at least WIDE_BITS bits for each shingle, so that no size fills it up."""
    bits = max(64 * SKETCH_WORDS, 1 << (WIDE_BITS * max(1, len(shingles)) - 1).bit_length())
    return np.packbits((np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def folded(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two wide sketches at the width of the narrower one: halves laid on each other keep parity."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return x, y


def _shredded(texts: DataFrame) -> DataFrame:
    """(node, shingles, wide, s0, s1, ...): the sets of the texts with their sketches."""
    sketch = [f"s{k}" for k in range(SKETCH_WORDS)]

    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in batches:
            for node, text in zip(batch.column(0), batch.column(1), strict=True):
                found = shingle(text.as_py())
                arrays = [pa.array([node.as_py()], pa.binary()), pa.array([found.view(np.int64)], pa.list_(pa.int64())), pa.array([wide_sketch(found).tobytes()], pa.binary()), *(pa.array([word]) for word in parity_sketch(found))]
                yield pa.RecordBatch.from_arrays(arrays, ["node", "shingles", "wide", *sketch])

    return texts.mapInArrow(shred, "node binary, shingles array<long>, wide binary, " + ", ".join(f"{c} long" for c in sketch))


def size_class(n: Column) -> Column:
    """Sizes in steps of CLASS_STEP."""
    return F.floor(F.log(n.cast("double")) / math.log(CLASS_STEP)).cast("int")


def _refuted(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, both) that their wide sketches leave; both is the sum of their sizes."""

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for both, of_a, of_b in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                differ = int(np.bitwise_count(np.bitwise_xor(*folded(np.frombuffer(of_a.as_py(), np.uint8), np.frombuffer(of_b.as_py(), np.uint8)))).sum())
                keep.append((100 + percent) * differ <= (100 - percent) * both)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    of_a = sketches.select(F.col("node").alias("a"), F.col("wide").alias("wide_a"))
    of_b = sketches.select(F.col("node").alias("b"), F.col("wide").alias("wide_b"))
    known = pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "both", "wide_a", "wide_b")
    return known.mapInArrow(leave, "a binary, b binary")


def _sides(early: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """What meets under (shingle, class): early rows of the smaller sets, and of the larger ones for each class of smaller sizes that they can still reach."""
    smaller = early.filter((100 + percent) * F.col("room") >= 2 * percent * F.col("n")).withColumn("class", size_class(F.col("n")))
    largest = F.least(F.col("n"), F.floor((100 + percent) * F.col("room") / percent) - F.col("n"))
    least = F.ceil(F.col("n") * percent / 100)
    larger = early.filter(largest >= least).withColumn("class", F.explode(F.sequence(size_class(least), size_class(largest))))
    columns = [c for c in early.columns if c != "shingle"]
    x = smaller.select("shingle", "class", *(F.col(c).alias(f"{c}_x") for c in columns))
    y = larger.select(F.col("shingle").alias("of"), F.col("class").alias("of_class"), *(F.col(c).alias(f"{c}_y") for c in columns))
    return x, y


def _open_pairs(nodes: DataFrame, texts: DataFrame, percent: int) -> tuple[DataFrame, list[str]]:
    """Pairs (a, b) of open nodes (node, n, part, minor) in different parts that can be similar; and scratch paths.

    Shingles are ordered by the number of open sets that hold them, and ``room`` is what a set has from a place on. Sets of
    m <= n shingles need an overlap of percent (m + n) / (100 + percent), so the first shingle that they share leaves both at
    least that much room. For the smaller set that is at least twice its own share, whatever the larger one is; the larger
    one meets, at each place, only those classes of smaller sizes for which its room suffices.
    """
    sketch = [f"s{k}" for k in range(SKETCH_WORDS)]
    shreds, shreds_path = table(_shredded(texts.join(nodes.select("node"), "node", "left_semi")), "shreds")
    common, common_path = table(shreds.select(F.explode("shingles").alias("of")).groupBy("of").agg(F.count("*").alias("holders")).filter("holders > 1"), "common")
    held = shreds.select("node", F.explode("shingles").alias("shingle")).join(common, F.col("shingle") == F.col("of")).select("node", "shingle", "holders")
    by_node = W.partitionBy("node")
    ranked = held.select("node", "shingle", F.row_number().over(by_node.orderBy("holders", "shingle")).alias("rank"), F.count("*").over(by_node).alias("shared"))
    known = nodes.join(shreds.select("node", *sketch), "node")
    placed = ranked.join(known, "node").withColumn("room", F.col("shared") - F.col("rank") + 1)
    early, early_path = table(placed.filter(100 * F.col("room") >= percent * F.col("n")).select("node", "n", "part", "minor", "shingle", "room", *sketch), "early")
    x, y = _sides(early, percent)
    both_sizes = F.col("n_x") + F.col("n_y")
    fits = (100 + percent) * F.least("room_x", "room_y") >= percent * both_sizes
    differ = reduce(add, (F.bit_count(F.col(f"{c}_x").bitwiseXOR(F.col(f"{c}_y"))) for c in sketch))
    near = (100 + percent) * differ <= (100 - percent) * both_sizes
    once = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("node_x") < F.col("node_y")))
    meet = (F.col("shingle") == F.col("of")) & (F.col("class") == F.col("of_class")) & (F.col("part_x") != F.col("part_y")) & once & fits & near
    # Two that are in the larger part of all their buckets are not open to each other, so one side is always in a smaller part.
    met = x.filter("minor_x").join(y, meet).union(x.filter("NOT minor_x").join(y.filter("minor_y"), meet))
    pairs = met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"), both_sizes.alias("both")).distinct()
    pairs, pairs_path = table(pairs, "open-pairs")
    return _refuted(pairs, shreds, percent), [shreds_path, common_path, early_path, pairs_path]


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Per document (columns doc_id, text; others are ignored): doc_id, n_shingles, component_id, kept, part, text_hash.

    Words are runs of anything but ASCII white space, A-Z in lower case. Texts that are null or hold no word have no
    shingles and are linked with nothing. component_id is the smallest doc_id reachable; it ignores null doc_ids, and is
    null if there are no others. kept is doc_id = component_id, so repeated rows of one doc_id are all kept or all not;
    null doc_ids are never kept unless their whole component has none. part names the component (null without words) also
    where doc_ids repeat or are null, and text_hash is xxhash64 of the text. An empty table gives no rows.
    """
    spark = docs.sparkSession
    signed, signed_path = table(signatures(docs), "signatures")
    classes, classes_path = table(
        signed.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes"
    )
    rows = classes.select("node", "n", F.posexplode("bands").alias("at", "band"))
    rows = rows.select("band", "node", "n", F.xxhash64("node", F.col("at") % ORDERS).alias("drawn"))
    # A bucket of any size is one count and one minimum, combined before the shuffle; the centre is the member that drew the least.
    shared = rows.groupBy(F.col("band").alias("of")).agg(F.count("*").alias("members"), F.min("drawn").alias("least")).filter("members > 1")
    shared, shared_path = table(shared.select("of", "least"), "shared")
    met, met_path = table(rows.join(shared, F.col("band") == F.col("of")).select("band", "node", "n", (F.col("drawn") == F.col("least")).alias("central")), "met")
    centres, centres_path = table(met.filter("central").select(F.col("band").alias("of"), F.col("node").alias("centre"), F.col("n").alias("n_centre")), "centres")
    sizes = lambda x, y: (100 * F.least(x, y)) >= percent * F.greatest(x, y)
    wanted = classes.select("node", "doc_id").join(met.select("node").distinct(), "node", "left_semi")
    texts, texts_path = table(_texts(docs, wanted), "texts")
    starred = met.filter(~F.col("central")).join(centres, F.col("band") == F.col("of")).filter(sizes(F.col("n"), F.col("n_centre")))
    starred, starred_path = table(starred.select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct(), "pairs")
    links, links_path = table(_confirmed(starred, texts, percent), "links")
    joined, joined_path = components(links)
    inside = met.join(joined.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("band", "node", "n", F.coalesce("label", "node").alias("part"))
    inside, inside_path = table(inside, "inside")
    counts = inside.groupBy("band", "part").count()
    mixed = counts.groupBy("band").agg(F.max(F.struct("count", "part")).getField("part").alias("major"), F.count("*").alias("parts")).filter("parts > 1")
    mixed, mixed_path = table(mixed.select("band", "major"), "mixed")
    open_rows = inside.join(mixed, "band").groupBy("node").agg(F.first("n").alias("n"), F.first("part").alias("part"), F.bool_or(F.col("part") != F.col("major")).alias("minor"))
    open_rows, open_path = table(open_rows, "open")
    rest, rest_paths = _open_pairs(open_rows, texts, percent)
    rest, rest_path = table(rest.join(starred, ["a", "b"], "left_anti"), "rest")
    more, more_path = table(_confirmed(rest, texts, percent), "more")
    drop(spark, shared_path, met_path, centres_path, starred_path, inside_path, mixed_path, open_path, rest_path, *rest_paths)
    if not more.isEmpty():
        drop(spark, joined_path)
        joined, joined_path = components(links.union(more))
    drop(spark, texts_path, links_path, more_path)
    parts = classes.select("node", "doc_id").join(joined.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("node", "doc_id", F.coalesce("label", "node").alias("part"))
    # Written first, so that a part that holds much of the corpus is dealt directly under the join and can be split.
    parts, parts_path = table(parts, "parts")
    least, least_path = table(parts.groupBy(F.col("part").alias("of_part")).agg(F.min("doc_id").alias("component_id")), "least")
    named, _ = table(parts.join(least, F.col("part") == F.col("of_part")).select(F.col("node").alias("of"), "component_id", "part"), "named")
    drop(spark, classes_path, joined_path, parts_path, least_path)
    found = signed.select("doc_id", "text_hash", "n_shingles", "node").join(named, F.col("node") == F.col("of"), "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.coalesce(F.col("doc_id") == component, component.isNull())
    return found.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "part", "text_hash")
