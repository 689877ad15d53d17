"""Counts of items by facet, kept per date and refreshed only for dates whose items have changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.sinks import SLOT, read_items, read_slots, replace_slots, slots

#: The facet that every item has once; its row of a date names the items' folder that the date was counted from.
EVERY = "*"
SCHEMA = "day string, facet string, value string, n long, scored long, score_sum decimal(38,6), score_max double, keys binary, built_from string"


def facet_parts(items: DataFrame, facets: dict[str, Column], day: str = "run_date", key: str = "id", score: str = "ai_score") -> DataFrame:
    """(day, facet, value, n, scored, score_sum, score_max, keys) of items: what can be added up over days, in one shuffle.

    A facet is a column, or an array whose distinct entries all count once; null values and entries are a value of their own.
    Sums are exact to six places; keys is a sketch of the distinct keys, for values whose items may be on several days.
    """
    kinds = items.select(*(c.alias(f"f{k}") for k, c in enumerate(facets.values()))).schema if facets else []
    entries = [F.array(F.struct(F.lit(EVERY).alias("facet"), F.lit(None).cast("string").alias("value")))]

    def listed(name: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("facet"), v.cast("string").alias("value")))

    for (name, column), field in zip(facets.items(), kinds, strict=True):
        several = field.dataType.typeName() == "array"
        entries.append(listed(name, F.coalesce(F.array_distinct(column), F.array().cast(field.dataType)) if several else F.array(column)))
    rows = items.select(F.col(day).cast("string").alias("day"), F.col(score).cast("double").alias("_s"), F.col(key).cast("string").alias("_k"), F.explode(F.concat(*entries)).alias("e"))
    return rows.groupBy("day", "e.facet", "e.value").agg(
        F.count("*").alias("n"), F.count("_s").alias("scored"), F.sum(F.col("_s").cast("decimal(18,6)")).cast("decimal(38,6)").alias("score_sum"), F.max("_s").alias("score_max"), F.hll_sketch_agg("_k").alias("keys"))


def refresh_facets(spark: SparkSession, items: str, schema: StructType | str, path: str, facets: dict[str, Column], score: str = "ai_score") -> set[str]:
    """Counts the dates of the ``items`` table of save_items anew whose folder is not the one they were counted from; gives those dates.

    Moved and deleted items change the folders of their dates, so nobody has to name what was touched, and a writer that died
    between the items and their facets is made up for by the next call. A date that has gone loses its facets. What comes to
    the driver is one row per date. ``facets`` must stay the same for a table.
    """
    live = slots(spark, items)[1]
    counted = read_slots(spark, path, SCHEMA).filter(F.col("facet") == EVERY).select("day", "built_from")
    known = {r.day: r.built_from for r in counted.collect()}
    stale = {day for day in live.keys() | known.keys() if live.get(day) != known.get(day)}
    if stale:
        folders = spark.createDataFrame([(day, live[day]) for day in stale if day in live], "day string, built_from string")
        parts = facet_parts(read_items(spark, items, schema, stale & live.keys()), facets, score=score).join(F.broadcast(folders), "day")
        columns = [name.split()[0] for name in SCHEMA.split(", ")]
        replace_slots(spark, path, parts.select(*columns, F.col("day").alias(SLOT)), stale)
    return stale


def facet_counts(spark: SparkSession, path: str, facet: str = EVERY, days: set[str] | None = None, least: int = 1) -> DataFrame:
    """(value, n, distinct, scored, avg_score, max_score) of a facet over all days, or those named; other days are not opened.

    n counts items and is exact; ``distinct`` estimates distinct keys. The mean is that of the scored items, to six places, null without one.
    """
    rows = read_slots(spark, path, SCHEMA, days).filter(F.col("facet") == facet)
    summed = rows.groupBy("value").agg(F.sum("n").alias("n"), F.sum("scored").alias("scored"), F.sum("score_sum").alias("_sum"), F.max("score_max").alias("max_score"), F.hll_union_agg("keys").alias("_keys"))
    mean = F.when(F.col("scored") > 0, F.round(F.col("_sum").cast("double") / F.col("scored"), 6))
    return summed.filter(F.col("n") >= least).select("value", "n", F.hll_sketch_estimate("_keys").alias("distinct"), "scored", mean.alias("avg_score"), "max_score")
