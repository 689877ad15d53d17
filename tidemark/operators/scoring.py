"""Scores from ratings, gates, quotas and the audit of what was dropped."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

POSITIVE = ["source_authority", "novelty", "technical_substance", "real_world_impact", "community_validation", "content_completeness"]
PENALTIES = ["marketing_penalty", "duplicate_penalty", "thin_content_penalty", "weak_relevance_penalty"]
BONUS_SOURCES, BONUS = 3, 1.0
EDGES = [3, 5, 7, 9]


def compose_score() -> Column:
    """The clamped sum of all ratings of a relevant item, else 0; missing ratings count 0."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in POSITIVE + PENALTIES), F.lit(0.0))
    return F.when(F.col("relevant"), F.greatest(F.lit(0.0), F.least(F.lit(10.0), total))).otherwise(F.lit(0.0))


def score_breakdown(score: Column) -> Column:
    return F.struct(score.alias("total"), *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in POSITIVE + PENALTIES))


def apply_ratings(items: DataFrame, responses: DataFrame) -> DataFrame:
    """items with the parsed response of the same id; an item without one is irrelevant, scores 0 and keeps its title as summary."""
    answered = responses.withColumn("answered", F.lit(True))
    joined = items.join(answered, "id", "left")
    score = F.when(F.col("answered"), compose_score()).otherwise(0.0)
    return joined.select(
        "id",
        F.coalesce(F.col("relevant"), F.lit(False)).alias("ai_relevant"),
        score.alias("ai_score"),
        F.when(F.col("answered"), F.coalesce("reason", F.lit(""))).otherwise("analysis failed").alias("ai_reason"),
        F.coalesce("summary", "title").alias("ai_summary"),
    )


def relevance_gate(items: DataFrame) -> DataFrame:
    return items.filter(F.col("ai_relevant").eqNullSafe(True))


def by_score(items: DataFrame) -> list[Column]:
    """Scores fall, ties keep the order of arrival."""
    return [F.coalesce("ai_score", F.lit(0.0)).desc(), F.col("pos").asc()]


def threshold_with_backfill(items: DataFrame, threshold: float, max_items: int | None) -> DataFrame:
    """All items from the threshold on; only if these are fewer than max_items, the best below fill up. Null and 0 never stay."""
    scored = items.filter(F.col("ai_score") != 0)
    above = scored.filter(F.col("ai_score") >= threshold)
    if max_items is None:
        return above
    below = scored.filter(F.col("ai_score") < threshold).orderBy(*by_score(items)).limit(max_items)
    numbered = below.withColumn("_n", F.row_number().over(W.orderBy(*by_score(items))))
    count = above.agg(F.count("*").alias("_above"))
    filled = numbered.crossJoin(F.broadcast(count)).filter(F.col("_n") <= max_items - F.col("_above")).drop("_n", "_above")
    return above.unionByName(filled)


def score_distribution(items: DataFrame) -> DataFrame:
    """Counts of the five buckets, empty ones too; a missing score counts 0."""
    score = F.coalesce("ai_score", F.lit(0.0))
    labels = ["0-3", "3-5", "5-7", "7-9", "9-10"]
    bucket = F.when(score < EDGES[0], labels[0])
    for edge, label in zip(EDGES[1:], labels[1:], strict=False):
        bucket = bucket.when(score < edge, label)
    counted = items.groupBy(bucket.otherwise(labels[-1]).alias("bucket")).count()
    every = items.sparkSession.createDataFrame([(b,) for b in labels], "bucket string")
    return every.join(counted, "bucket", "left").select("bucket", F.coalesce("count", F.lit(0)).alias("n"))


@dataclass(frozen=True)
class Group:
    categories: list[str]
    limit: int | None = None
    name: str | None = None


@dataclass(frozen=True)
class Quotas:
    groups: dict[str, Group] = field(default_factory=dict)
    default_group: str = "other"
    default_limit: int | None = None
    max_items: int | None = None

    def mapping(self) -> dict[str, str]:
        """Category to group; the first group in order wins."""
        found: dict[str, str] = {}
        for key, group in self.groups.items():
            for category in group.categories:
                found.setdefault(category, key)
        return found


def with_group(items: DataFrame, quotas: Quotas) -> DataFrame:
    mapped = F.create_map(*(F.lit(x) for pair in quotas.mapping().items() for x in pair)) if quotas.mapping() else None
    group = F.coalesce(mapped[F.col("category")], F.lit(quotas.default_group)) if mapped is not None else F.lit(quotas.default_group)
    return items.withColumn("group_key", group)


def balanced_digest(items: DataFrame, quotas: Quotas) -> DataFrame:
    """The best of each group up to its limit, then the best of all up to max_items; adds group_key. Without configuration all stay."""
    grouped = with_group(items, quotas)
    if not quotas.groups and quotas.max_items is None:
        return grouped
    limits = {key: group.limit for key, group in quotas.groups.items()}
    limits.setdefault(quotas.default_group, quotas.default_limit)
    limits = {key: n for key, n in limits.items() if n is not None}
    kept = grouped.filter(~F.col("group_key").isin(list(limits)))
    if limits:
        own = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))[F.col("group_key")]
        ranked = grouped.filter(F.col("group_key").isin(list(limits))).withColumn("_rank", F.row_number().over(W.partitionBy("group_key").orderBy(*by_score(items))))
        # The largest limit is a literal, so that each task keeps no more than that of a group before the shuffle.
        limited = ranked.filter(F.col("_rank") <= max(limits.values())).filter(F.col("_rank") <= own).drop("_rank")
        kept = kept.unionByName(limited)
    return kept.orderBy(*by_score(items)).limit(quotas.max_items) if quotas.max_items is not None else kept


def duplicate_categories(groups: DataFrame) -> DataFrame:
    """Categories that several groups of (category, group_key) claim."""
    return groups.groupBy("category").agg(F.countDistinct("group_key").alias("n_groups")).filter("n_groups > 1")


def drop_audit(items: DataFrame, relevant: DataFrame, scored: DataFrame, unique: DataFrame, final: DataFrame) -> DataFrame:
    """(id, drop_reason) of every item that is not final: the first stage that it failed. Ids are unique; all stages meet in one aggregate."""
    marks = [stage.select("id", F.lit(k).alias("stage")) for k, stage in enumerate((items, relevant, scored, unique, final))]
    reached = reduce(DataFrame.union, marks).groupBy("id").agg(*(F.bool_or(F.col("stage") == k).alias(f"s{k}") for k in range(5)))
    reason = F.when(~F.col("s1"), "relevance").when(~F.col("s2"), "score").when(~F.col("s3"), "topic_duplicate").when(~F.col("s4"), "category_quota")
    return reached.filter("s0").select("id", reason.alias("drop_reason")).filter("drop_reason IS NOT NULL")


def multi_source_bonus(items: DataFrame) -> DataFrame:
    """Items of three sources or more gain a point, up to 10; a missing score stays missing."""
    bonus = F.when(F.coalesce("source_count", F.lit(1)) >= BONUS_SOURCES, BONUS).otherwise(0.0)
    return items.withColumn("bonus", F.when(F.col("ai_score").isNotNull(), bonus)).withColumn("ai_score", F.when(F.col("ai_score").isNotNull(), F.least(F.lit(10.0), F.col("ai_score") + bonus)))


def first_n(items: DataFrame, n: int) -> DataFrame:
    """The first n by pos, each with the total and whether there are more."""
    total = items.agg(F.count("*").alias("total"))
    return items.orderBy("pos").limit(n).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > n)
