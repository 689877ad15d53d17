"""Writers: snapshots by date, upserts by policy, stage tables and the export of static files."""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; none if it is missing."""
    files, at = _files(spark, path)
    return [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    try:
        files, at = _files(spark, path)
        files.delete(at, True)
    except Exception:  # the session may have ended before the interpreter
        pass


def workdir(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share, removed when the interpreter ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tidemark-{label}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


SLOT, MANIFEST = "_slot", "manifest-"


def _manifests(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(name.removeprefix(MANIFEST)) for name in children(spark, path) if name.startswith(MANIFEST))


def slots(spark: SparkSession, path: str, number: int | None = None) -> tuple[int, dict[str, str]]:
    """The number of a table's newest commit (or ``number``), and the folder that each of its slots lives in; (-1, {}) before the first."""
    there = _manifests(spark, path)
    if not there:
        return -1, {}
    number = there[-1] if number is None else number
    files, at = _files(spark, f"{path}/{MANIFEST}{number:012d}")
    stream = files.open(at)
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return number, json.loads(text)


def commit(spark: SparkSession, path: str, number: int, live: dict[str, str]) -> None:
    """Makes ``live`` the table, by one rename to a name that nobody else has taken; then drops what the two newest commits do not use.

    Readers see the old slots or the new ones. Of two writers that started from one commit, the second fails.
    """
    files, staged = _files(spark, f"{path}/staged-{uuid.uuid4().hex}")
    out = files.create(staged)
    out.write(bytearray(json.dumps(live).encode()))
    out.close()
    _, target = _files(spark, f"{path}/{MANIFEST}{number:012d}")
    if files.exists(target) or not files.rename(staged, target):
        files.delete(staged, False)
        raise RuntimeError(f"another writer has committed {path}")
    _sweep(spark, path)


def _sweep(spark: SparkSession, path: str) -> None:
    numbers = _manifests(spark, path)
    used = {folder.split("/")[0] for n in numbers[-2:] for folder in slots(spark, path, n)[1].values()}
    for n in numbers[:-2]:
        remove(spark, f"{path}/{MANIFEST}{n:012d}")
    for name in children(spark, f"{path}/data"):
        if name not in used and numbers and int(name.split("-")[0]) <= numbers[-1]:
            remove(spark, f"{path}/data/{name}")


def read_slots(spark: SparkSession, path: str, schema: StructType | str, wanted: set[str] | None = None) -> DataFrame:
    """The rows of a table as of its newest commit, of the wanted slots only if they are named; other folders are not opened."""
    live = slots(spark, path)[1]
    folders = [f"{path}/data/{folder}" for slot, folder in live.items() if wanted is None or slot in wanted]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def replace_slots(spark: SparkSession, path: str, rows: DataFrame, touched: set[str]) -> None:
    """Puts ``rows``, each with its slot in SLOT, in place of the touched slots; a touched slot without rows goes."""
    number, live = slots(spark, path)
    folder = f"{number + 1:012d}-{uuid.uuid4().hex}"
    rows.repartition(SLOT).write.partitionBy(SLOT).parquet(f"{path}/data/{folder}")
    made = {name.split("=", 1)[1]: f"{folder}/{name}" for name in children(spark, f"{path}/data/{folder}") if name.startswith(f"{SLOT}=")}
    commit(spark, path, number + 1, {slot: at for slot, at in live.items() if slot not in touched} | made)


def save_items(spark: SparkSession, path: str, new: DataFrame, run_date: str) -> None:
    """Replaces the snapshot of a date; an id that another date holds moves here. Only touched dates are rewritten.

    The dates' new folders become the table by one rename, so an id is never on two dates, whenever a writer dies. read_items
    gives the table. An empty snapshot takes the date away.
    """
    fresh = new.withColumn("run_date", F.lit(run_date).cast("date"))
    live = slots(spark, path)[1]
    elsewhere = read_slots(spark, path, fresh.schema, set(live) - {run_date})
    left = elsewhere.join(fresh.select("id"), "id", "left_semi").select("run_date").distinct()
    dates = {str(r[0]) for r in left.collect()}  # one value per touched date
    stay = read_slots(spark, path, fresh.schema, dates).join(fresh.select("id"), "id", "left_anti")
    replace_slots(spark, path, stay.unionByName(fresh).withColumn(SLOT, F.col("run_date").cast("string")), dates | {run_date})


def read_items(spark: SparkSession, path: str, schema: StructType | str, dates: set[str] | None = None) -> DataFrame:
    """The items of save_items, of the given dates only if they are named; ``schema`` is that of the saved rows."""
    fields = StructType([*(spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema).fields, StructField("run_date", DateType())])
    return read_slots(spark, path, fields, dates)


def upsert_table(spark: SparkSession, path: str, new: DataFrame, policy: dict[str, str], key: str = "id", buckets: int = 256) -> int:
    """Merges ``new`` (one row per key) into a table by ``upsert``; gives the number of buckets that were read and rewritten.

    Rows live in buckets of their key's hash, and only buckets with an arriving key are touched, so what is rewritten follows
    what arrives. ``buckets`` must stay the same for a table. The merge becomes visible by one rename; merging the same rows
    again changes nothing. Repeated keys and null keys in ``new`` are the caller's to resolve; null keys are left out.
    """
    bucket = lambda: F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string")
    fresh = new.filter(F.col(key).isNotNull())
    touched = {r[0] for r in fresh.select(bucket()).distinct().collect()}  # at most ``buckets`` values
    if touched:
        merged = upsert(read_slots(spark, path, fresh.schema, touched), fresh, policy, key)
        replace_slots(spark, path, merged.withColumn(SLOT, bucket()), touched)
    return len(touched)


def upsert(old: DataFrame, new: DataFrame, policy: dict[str, str], key: str = "id") -> DataFrame:
    """Old rows with new ones over them. Per column the policy is new (default), fill (new unless null) or keep (old unless there was none)."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    arrived, known = F.col(f"n.{key}").isNotNull(), F.col(f"o.{key}").isNotNull()
    columns = []
    for c in old.columns:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        how = policy.get(c, "new")
        value = F.coalesce(b, a) if how == "fill" else F.when(known, a).otherwise(b) if how == "keep" else F.when(arrived, b).otherwise(a)
        columns.append((F.coalesce(b, a) if c == key else value).alias(c))
    return both.select(columns)


def mark_selected(items: DataFrame, selected: DataFrame, reasons: DataFrame) -> DataFrame:
    """Resets and sets ``selected`` and ``drop_reason`` of a date's items."""
    s, r = selected.select("id", F.lit(True).alias("_s")), reasons.select("id", F.col("drop_reason").alias("_r"))
    joined = items.drop("selected", "drop_reason").join(s, "id", "left").join(r, "id", "left")
    return joined.withColumn("selected", F.coalesce("_s", F.lit(False))).withColumn("drop_reason", F.when(~F.col("selected"), F.col("_r"))).drop("_s", "_r")


def daily_runs(items: DataFrame) -> DataFrame:
    """Per date: items fetched, items selected and the languages, sorted."""
    return items.groupBy("day").agg(F.count("*").alias("total_fetched"), F.count_if("selected").alias("total_selected"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"))


def evolve_schema(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds missing columns as nulls and fills an empty category from the metadata once."""
    for name, kind in columns.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    if {"category", "metadata_json"} <= set(rows.columns):
        rows = rows.withColumn("category", F.coalesce("category", F.get_json_object("metadata_json", "$.category")))
    return rows


STAGES = ("raw", "scored", "filtered", "enriched")


def save_stage(spark: SparkSession, path: str, run_id: str, stage: str, items: DataFrame) -> None:
    items.withColumns({"run_id": F.lit(run_id), "stage": F.lit(stage)}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "stage").parquet(path)


def load_stage(spark: SparkSession, path: str, run_id: str, stage: str | None = None) -> DataFrame:
    """A stage of a run, the latest there is if none is named; other partitions are not read."""
    rows = spark.read.parquet(path).filter(F.col("run_id") == run_id)
    if stage is None:
        there = {r[0] for r in rows.select("stage").distinct().collect()}  # at most the four stages
        stage = next(s for s in reversed(STAGES) if s in there)
    return rows.filter(F.col("stage") == stage)


def list_runs(rows: DataFrame) -> DataFrame:
    """Runs by name, newest first, with the number of items of each stage (null where it is missing)."""
    return rows.groupBy("run_id").pivot("stage", list(STAGES)).agg(F.count("run_id")).orderBy(F.desc("run_id"))


def topics_per_date(topics: DataFrame, items: DataFrame, bridge: DataFrame) -> DataFrame:
    """(day, topic, name) of the topics that occur on each day."""
    used = bridge.join(items.select("id", "day"), "id").select("day", "topic").distinct()
    return used.join(topics.select("topic", "name"), "topic").select("day", "topic", "name")


def export_static(artefacts: dict[str, DataFrame], out: str, by_date: tuple[str, ...] = ()) -> None:
    """Each artefact as JSON lines under its name; those of ``by_date`` in a folder per day."""
    for name, rows in artefacts.items():
        writer = rows.write.mode("overwrite")
        (writer.partitionBy("day") if name in by_date else writer).json(f"{out}/{name}")


#: Columns of the artefacts that show items: an item with its page, and the light index without heavy fields.
ARTEFACT_COLUMNS = {"daily_detail": ("id", "title", "url", "day", "ai_score", "category"), "items_index": ("id", "title", "day", "ai_score")}
NEWEST_RUNS = 30


def site_artefacts(items: DataFrame, runs: DataFrame, topics: DataFrame, bridge: DataFrame, tags: DataFrame, papers: DataFrame, paper_topics: DataFrame, reports: DataFrame) -> dict[str, DataFrame]:
    """The thirteen tables of the static site, each a frame to be written by export_static.

    items (id, title, url, day, category, ai_score, selected), runs as of daily_runs, topics (topic, name, grp, is_active),
    bridge (id, topic), tags (id, tag), papers (id, title, source, sec), paper_topics (id, slug), reports (id, source,
    institution). Items that are not selected are on no page; inactive topics and topics of no selected item have no count.
    """
    chosen = items.filter("selected")
    active = topics.filter("is_active").select("topic", "name", "grp")
    named = bridge.join(active, "topic").join(chosen.select("id"), "id")
    of_item = named.groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("topics"))
    newest = runs.orderBy(F.desc("day")).limit(NEWEST_RUNS)
    return {
        "runs": newest,
        "runs_dates": items.select("day").distinct().orderBy(F.desc("day")).limit(NEWEST_RUNS),
        "daily": newest.select("day", "total_fetched", "total_selected", "languages"),
        "daily_detail": chosen.select(*ARTEFACT_COLUMNS["daily_detail"]).join(of_item, "id", "left"),
        "topics": active.join(named.groupBy("topic").agg(F.count("*").alias("n")), "topic", "left").select("topic", "name", "grp", F.coalesce("n", F.lit(0)).alias("n")),
        "items_index": chosen.select(*ARTEFACT_COLUMNS["items_index"]),
        "categories": chosen.groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count("*").alias("n")),
        "tags": tags.join(chosen.select("id"), "id").groupBy("tag").agg(F.count("*").alias("n")),
        "stats": items.agg(F.count("*").alias("total_items"), F.count_if("selected").alias("total_selected"), F.countDistinct("day").alias("total_days")),
        "papers": papers,
        "paper_topics": paper_topics.groupBy("slug").agg(F.countDistinct("id").alias("n")),
        "reports": reports,
        "report_institutions": reports.filter("institution IS NOT NULL").groupBy("source", "institution").agg(F.count("*").alias("n")),
    }
