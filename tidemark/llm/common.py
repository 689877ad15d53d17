"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that a per-task memo keeps before it starts afresh, so that its memory is bounded.
MEMO_ENTRIES = 300_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; on a local master a temporary one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended before the interpreter
        pass


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the interpreter ends."""
    path = f"{shared_dir(spark)}/tidemark-{label}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def drop(spark: SparkSession, *paths: str) -> None:
    """Removes scratch tables that no plan reads any more."""
    for path in paths:
        _forget(spark, path)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts the lineage and outlives lost executors."""
    return table(df, label)[0]


def table(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As ``written``, with the path, for tables that are dropped before the end."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remainder(column: str, by: int) -> Column:
    """crc32 of the value as text, modulo ``by``; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % by


class Memo(dict):
    """A dictionary that computes what it lacks and never holds more than MEMO_ENTRIES."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        self[key] = value = self.compute(key)
        return value
