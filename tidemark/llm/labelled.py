"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import remainder

#: Most labelled rows that a classifier is fitted on, in hashed order of doc_id.
SAMPLE_ROWS = 20_000


def held_out(modulus: int, rest: int):
    return remainder("doc_id", modulus) == rest


def sample(docs: DataFrame, labels: DataFrame, column: str, modulus: int, rest: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents that are not held out.

    Labels that are null do not count; of several for one doc_id the largest does. Of several texts of one doc_id one is
    taken, so that repeated rows do not exceed the bound. The ids are few enough to broadcast.
    """
    known = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(modulus, rest))
    ids = known.groupBy("doc_id").agg(F.max(column).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.join(F.broadcast(ids.withColumnRenamed("doc_id", "label_id")), F.col("doc_id") == F.col("label_id"))
    one = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("drawn"), "text", "label")).alias("one"))
    return one.select("doc_id", "one.text", "one.label")
