"""Structured Streaming jobs over landing files: the normalisers' logic, continuously."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from tidemark.functions.urls import normalize_url
from tidemark.operators.sinks import children, exists, remove


def landing(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_per_batch: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream of rows."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def unique_urls(items: DataFrame, hours: int = 24) -> DataFrame:
    """The first item of each URL key within the watermark; what comes later than that is dropped."""
    keyed = items.withColumn("url_key", normalize_url(F.col("url")))
    return keyed.withWatermark("published_at", f"{hours} hours").dropDuplicatesWithinWatermark(["url_key"])


def merged_urls(items: DataFrame, gap: str = "6 hours", late: str = "24 hours") -> DataFrame:
    """One row per URL key and visit of items (id, url, source_type, content, published_at), as a stream or a table.

    Items of a key that follow one another by less than ``gap`` are one visit; Spark's own sessions would also take one at exactly
    the gap, so they are told a microsecond less. Its row has url_key, began and ended (the last item's
    time plus ``gap``), the id and content of the primary (longest content, then the earliest, then the smallest id), n_items,
    and the distinct source types in order. A stream gives a visit once, when it has ended ``late`` before the newest item;
    its state, the longest content so far, then goes, and items that come later still are dropped. A table gives the same rows
    and those of the open visits. Items without a URL or time take no part; a null content counts as empty.
    """
    keyed = items.withColumn("url_key", normalize_url(F.col("url"))).filter("url_key IS NOT NULL AND published_at IS NOT NULL")
    keyed = keyed.withColumn("content", F.coalesce("content", F.lit("")))
    best = F.struct(F.length("content").alias("n"), (-F.unix_micros("published_at")).alias("at"), (-F.col("id")).alias("i"))
    visits = keyed.withWatermark("published_at", late).groupBy(F.session_window("published_at", f"{gap} -1 microseconds").alias("w"), "url_key")
    told = visits.agg(F.max_by(F.struct("id", "content"), best).alias("p"), F.count("*").alias("n_items"), F.array_sort(F.collect_set("source_type")).alias("sources"))
    return told.select("url_key", F.col("w.start").alias("began"), (F.col("w.end") + F.expr("INTERVAL 1 MICROSECOND")).alias("ended"), "p.id", "p.content", "n_items", "sources")


def hourly_counts(events: DataFrame, ts: str, kind: str, late_hours: int = 24) -> DataFrame:
    """Counts per tumbling hour and kind. Hours that ended ``late_hours`` before the newest event are closed: their state goes, later rows of them are dropped."""
    timely = events.withWatermark(ts, f"{late_hours} hours")
    return timely.groupBy(F.window(ts, "1 hour").alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), kind, "n")


def upsert_sink(stream: DataFrame, path: str, order: list[str], keys: list[str], policy: dict[str, str] | None = None, compact_every: int = 32) -> DataStreamWriter:
    """Each batch adds its last rows per key as a delta of its own; every so many batches all so far become one base.

    A batch that is repeated after a failure replaces its own delta, so numbers may have gaps and may come again; a base that is
    complete is never written again. The two newest bases stay, with the deltas after the older one. read_upserts gives the table.
    """

    def add(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in (*order, *keys)]
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order) if order else F.lit(0)).alias("r")).select(*keys, "r.*")
        last.write.mode("overwrite").parquet(f"{path}/delta-{number}")
        if number and number % compact_every == 0 and not exists(spark := batch.sparkSession, f"{path}/base-{number}/_SUCCESS"):
            read_upserts(spark, path, keys, policy).write.mode("overwrite").parquet(f"{path}/base-{number}")
            _forget(spark, path)

    return stream.writeStream.foreachBatch(add)


def _complete(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the complete tables of a kind, in order."""
    return sorted(int(name.split("-")[1]) for name in children(spark, path) if name.startswith(f"{kind}-") and exists(spark, f"{path}/{name}/_SUCCESS"))


def _forget(spark: SparkSession, path: str) -> None:
    """Removes what the two newest bases replace; a reader that has begun with the older one still finds its deltas."""
    bases = _complete(spark, path, "base")
    if len(bases) > 1:
        for kind, last in (("base", bases[-2] - 1), ("delta", bases[-2])):
            for number in _complete(spark, path, kind):
                if number <= last:
                    remove(spark, f"{path}/{kind}-{number}")


def read_upserts(spark: SparkSession, path: str, keys: list[str], policy: dict[str, str] | None = None) -> DataFrame:
    """The table of an upsert_sink: the newest complete base and the deltas after it, by key.

    Per column the policy is new (default: the last batch that has the key), fill (the last value that is not null) or keep
    (the first batch's).
    """
    base = max(_complete(spark, path, "base"), default=None)
    names = ([f"base-{base}"] if base is not None else []) + [f"delta-{n}" for n in _complete(spark, path, "delta") if base is None or n > base]
    if not names:
        raise FileNotFoundError(f"no batch has arrived at {path}")
    parts = [spark.read.parquet(f"{path}/{name}").withColumn("_at", F.lit(at)) for at, name in enumerate(names)]
    every = reduce(DataFrame.unionByName, parts)
    columns = []
    for c in parts[0].columns:
        if c in (*keys, "_at"):
            continue
        how, value = (policy or {}).get(c, "new"), F.struct(F.col(c).alias("x"))
        told = F.min_by(value, "_at") if how == "keep" else F.max_by(F.when(F.col(c).isNotNull(), value), F.when(F.col(c).isNotNull(), F.col("_at"))) if how == "fill" else F.max_by(value, "_at")
        columns.append(told["x"].alias(c))
    return every.groupBy(*keys).agg(*columns)
