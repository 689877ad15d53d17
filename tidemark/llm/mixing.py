"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: ASCII white space separates words.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
BLOCK_WORDS = 64
SHARD_ROWS, MOST_SHARDS = 512, 65_536
#: A source has no more shards than give each this many blocks of its own words on average.
SHARD_BLOCKS = 16
#: Halvings of the span of divisors, to the last bit of a double.
HALVINGS = 60


def _drawn(*parts: Column) -> Column:
    """A seeded 32-bit number."""
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 8), 16, 10).cast("long")


def _seats(parts: DataFrame, within: list[str], share: str, seats: str, most: Column, order: list[str]) -> DataFrame:
    """Adds ``quota``: within each group ``seats`` go to the rows by their highest quotients share / (2 s + 1), at most ``most`` to a row.

    The divisor at which the rounded shares add up to the seats is found by halving on one array per group; only the quotients
    at that boundary are ranked.
    """
    group = W.partitionBy(*within) if within else W.partitionBy()
    known = parts.withColumn("most", most)

    def held(amount: Column, cap: Column, divisor: Column) -> Column:
        return F.least(cap, F.greatest(F.lit(0), F.ceil(amount / divisor - 0.5)).cast("long"))

    def halve(state: Column, _: Column) -> Column:
        middle = F.sqrt(state["low"] * state["high"])
        total = F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + held(x["share"], x["most"], middle))
        return F.when(total >= F.col("wanted"), F.struct(middle.alias("low"), state["high"].alias("high"))).otherwise(F.struct(state["low"].alias("low"), middle.alias("high")))

    one = F.struct(F.col(share).cast("double").alias("share"), F.col("most").alias("most"))
    filled = known.filter(F.col(share) > 0).groupBy(*within).agg(
        F.collect_list(one).alias("parts"), F.max(seats).alias("wanted"), F.max(F.col(share) * 2.0 + 1).alias("high"),
        F.least(F.sum(share) / (F.max(seats) + F.count("*")), F.min(F.col(share) / (F.col("most") + 1))).alias("low"),
    )
    start = F.struct(F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"))
    found = filled.select(*within, F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve).alias("divisor"))
    near = known.filter(F.col(share) > 0).join(found, within) if within else known.filter(F.col(share) > 0).crossJoin(found)
    near = near.withColumn("least", F.greatest(F.lit(0), held(F.col(share), F.col("most"), F.col("divisor.high")) - 1).cast("long"))
    near = near.withColumn("top", F.least(F.col("most"), held(F.col(share), F.col("most"), F.col("divisor.low")) + 1)).withColumn("open", F.col(seats) - F.sum("least").over(group))
    tried = near.select(*within, *order, "open", "least", F.col(share).alias("_share"), F.explode_outer(F.when(F.col("top") > F.col("least"), F.sequence("least", F.col("top") - 1))).alias("s"))
    ranked = tried.withColumn("rank", F.row_number().over(group.orderBy(F.desc_nulls_last(F.col("_share") / (2 * F.col("s") + 1)), *order)))
    given = ranked.groupBy(*within, *order).agg((F.max("least") + F.count_if(F.col("s").isNotNull() & (F.col("rank") <= F.col("open")))).alias("quota"))
    keys = [*within, *order]
    return known.join(given, keys, "left").withColumn("quota", F.coalesce("quota", F.lit(0))).drop("most")


def source_targets(sized: DataFrame) -> DataFrame:
    """Per source key: source_size, weight and target. One row per source, which fits one task."""
    sources = sized.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    every = W.partitionBy()
    ordered = sources.withColumn("at", F.row_number().over(every.orderBy(F.col("source_key") == "null", "source_key")) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("at") % len(WEIGHTS) + 1).cast("int"))
    weighed = ordered.withColumn("weight", weight.cast("long")).withColumn("cap", MOST_PASSES * F.col("source_size")).withColumn("total", F.sum("source_size").over(every))
    rising = every.orderBy(F.col("cap") / F.col("weight"), "at")
    capped = F.coalesce(F.sum("cap").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    uncapped = F.sum("weight").over(rising.rowsBetween(W.currentRow, W.unboundedFollowing))
    # With the sources in the order in which they reach their caps, the level rises up to the last capped one and falls from there.
    level = F.max("level").over(every)
    return weighed.withColumn("level", (F.col("total") - capped) / uncapped).withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight")))


def mix(docs: DataFrame, seed: str = "mix-1", carry: Sequence[str] = ()) -> DataFrame:
    """Per document (columns doc_id, text, source): doc_id, size, source_size, target, taken, then ``carry``.

    Sources in code point order, null last, weigh 5, 2, 1, repeating. Their targets share all words by weight; a target
    stops at three times its source's words and the excess is shared again. Blocks of BLOCK_WORDS words go to sources and
    then to their shards by highest quotients, to a shard at most three times its words. A shard is a seeded order of its documents read in a circle from a seeded
    block on, until its quota is met: ``taken`` counts the words read of a document, repeats too, at most three times its
    size. Null and empty texts have size 0 and taken 0. Repeated rows count each; rows that agree in doc_id and size are
    interchangeable. Columns of docs beyond these are ignored unless carried. An empty table gives no rows.
    """
    key = F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), "source"))
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    described = docs.select(F.col("doc_id"), key.alias("source_key"), size.alias("size"), drawn.alias("drawn"), *(F.col(c).alias(f"carry_{c}") for c in carry))
    sized = written(described.select("doc_id", "source_key", "size", "drawn"), "sized")
    most_shards = min(MOST_SHARDS, max(1, -(-sized.count() // SHARD_ROWS)))
    # Its own number of shards keeps a small source from having one short document a shard. Written, so that its size is known to the planner.
    own = F.greatest(F.lit(1), F.least(F.lit(most_shards), F.floor(F.col("source_size") / (BLOCK_WORDS * SHARD_BLOCKS)))).cast("long")
    targets = source_targets(sized).withColumn("blocks", F.round(F.col("total") / BLOCK_WORDS).cast("long")).withColumn("shards", own)
    by_source = _seats(targets, [], "target", "blocks", F.col("blocks"), ["source_key"])
    by_source = written(by_source.select("source_key", "source_size", "target", "shards", F.col("quota").alias("blocks")), "sources")
    dealt = F.conv(F.substring("drawn", 9, 8), 16, 10).cast("long")
    # Documents without words take no part; they are spread so that many of them make no large shard.
    shard = F.when(F.col("size") > 0, dealt % F.col("shards")).otherwise(-1 - dealt % most_shards)
    groups = sized.filter("size > 0").join(by_source, "source_key").groupBy("source_key", shard.alias("shard"), "blocks").agg(F.sum("size").alias("words"))
    quotas = _seats(groups, ["source_key"], "words", "blocks", F.floor(MOST_PASSES * F.col("words") / BLOCK_WORDS).cast("long"), ["shard"])
    # Blocks that no shard can hold whole fill the rests of the shards, a part of a block each.
    source = W.partitionBy("source_key")
    room = MOST_PASSES * F.col("words") - F.col("quota") * BLOCK_WORDS
    before = F.coalesce(F.sum("room").over(source.orderBy(F.desc(F.col("words") / (2 * F.col("quota") + 1)), "shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    quotas = quotas.withColumn("room", room).withColumn("left", (F.col("blocks") - F.sum("quota").over(source)) * BLOCK_WORDS - before)
    begin = (_drawn(F.lit(f"{seed}:"), F.col("source_key"), F.lit(":"), F.col("shard").cast("string")) % F.ceil(F.col("words") / BLOCK_WORDS)) * BLOCK_WORDS
    wanted = F.col("quota") * BLOCK_WORDS + F.greatest(F.lit(0), F.least("room", "left"))
    quotas = quotas.select("source_key", "shard", "words", F.floor(wanted / F.col("words")).cast("long").alias("passes"), (wanted % F.col("words")).alias("rest"), begin.alias("begin"))
    circle = W.partitionBy("source_key", "shard").orderBy("drawn", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = (described if carry else sized).join(by_source.drop("blocks"), "source_key").withColumn("shard", shard).withColumn("end", F.sum("size").over(circle))

    def overlap(low: Column, high: Column) -> Column:
        return F.greatest(F.lit(0), F.least("end", high) - F.greatest(F.col("end") - F.col("size"), low))

    stop = F.col("begin") + F.col("rest")
    taken = F.col("passes") * F.col("size") + overlap(F.col("begin"), F.least(stop, F.col("words"))) + overlap(F.lit(0), stop - F.col("words"))
    joined = placed.join(quotas, ["source_key", "shard"], "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"), *(F.col(f"carry_{c}").alias(f"carried_{c}" if c in ("doc_id", "size", "target", "taken", "source_size") else c) for c in carry))
