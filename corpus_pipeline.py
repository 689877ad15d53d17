"""From documents to packed training sequences: five stages, each a table that the next one reads."""

from __future__ import annotations

import os
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import mixing, neardup, packing, pii, toxicity
from tidemark.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC_FROM = 0.7
#: Where the secret key of the pseudonyms comes from: a setting of the session, else of the environment.
KEY_SETTING, KEY_VARIABLE = "spark.tidemark.piiKey", "TIDEMARK_PII_KEY"
#: Stages cannot be put as one SQL statement: the grammar is learned, signatures and pseudonyms are computed in Python.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC_FROM; the grammar learns from the labels of documents that are not held out.

    Null and empty texts have no match and stay; repeated rows go or stay together. An empty table stays empty.
    """
    lexicon = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, lexicon, COLUMNS).filter(F.col("toxicity_score") < TOXIC_FROM).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id.

    Documents without words, null and empty texts among them, all stay. Of rows that repeat one stays; a null doc_id stays
    only in a group that has no other. An empty table stays empty.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    keepers = neardup.near_duplicates(docs).filter(F.col("part").isNotNull()).groupBy("part").agg(first).select(F.col("first.doc_id").alias("keep_id"), F.col("first.text_hash").alias("keep_hash"))
    keepers = written(keepers, "keepers")
    has_words = F.coalesce(F.col("text").rlike(mixing.WORD), F.lit(False))
    hashed = docs.filter(has_words).withColumn("text_hash", F.xxhash64("text"))
    chosen = hashed.join(keepers, F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_hash") == F.col("keep_hash")), "left_semi")
    once = chosen.withColumn("turn", F.row_number().over(W.partitionBy("doc_id", "text_hash").orderBy("source", "lang", "n_chars"))).filter("turn = 1")
    return once.select(COLUMNS).union(docs.filter(~has_words).select(COLUMNS))


def pseudonym_key(spark: SparkSession) -> bytes:
    """The key set by KEY_SETTING or KEY_VARIABLE; else a new one, so that pseudonyms link within this run and nobody can invert them."""
    found = spark.conf.get(KEY_SETTING, None) or os.environ.get(KEY_VARIABLE)
    return found.encode() if found else secrets.token_bytes(32)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data; n_chars follows the text.

    Null and empty texts stay as they are, with their n_chars; repeated rows stay equal. An empty table stays empty.
    """
    return pii.pseudonymise(docs, pseudonym_key(spark)).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes its words, rounded to whole documents.

    Documents of which less than half is taken, and those without words, leave. Repeated rows are taken each on its own. An
    empty table stays empty.
    """
    mixed = mixing.mix(docs, carry=["text", "lang", "source", "n_chars"])
    times = F.floor(F.col("taken") / F.nullif(F.col("size"), F.lit(0)) + 0.5).cast("int")
    repeated = mixed.withColumn("times", F.coalesce(times, F.lit(0))).filter("times > 0")
    return repeated.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times")))).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens; null and empty texts are the end token alone, an empty table gives no rows."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("pseudonyms", pseudonymise),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = written(docs, f"stage{at + 1}")
    return docs
