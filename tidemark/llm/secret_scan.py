"""Secret scans by an incremental blob ledger.

A version of a file is one text at one path. Texts are addressed by their SHA-256, so a text that stands at many paths or
comes back later is one blob. The ledger is a folder of batches; a row says which rules, each at which version, have
scanned a blob and what they found. A scan reads only blobs for which a rule at its present version is missing, and runs
only the missing ones; findings are then joined back to every path of the blob. A batch counts once Spark has committed
it, so a scan that dies is as if it had not begun.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import written


@dataclass(frozen=True)
class Rule:
    """Spans of a pattern's leftmost matches that do not overlap; those whose measured part is shorter than ``least`` are dropped."""

    kind: str
    version: int
    pattern: str
    least: int = 1
    group: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: Patterns and lengths of the three base kinds.
BASE = (
    Rule("assign", 1, r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 20),
    Rule("hex", 1, r"[0-9a-f]+", 24),
)
#: Further kinds with signs of their own, which the base ones miss. No pattern can run over the same characters from many starts.
ADDED = (
    Rule("private", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("signed", 1, r"eyJ[A-Za-z0-9_-]{8,200}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("prefixed", 1, r"(?:gh[opsu]_|xox[abp]-|sk_live_)[A-Za-z0-9-]+", 20),
    Rule("address", 1, r"://[A-Za-z0-9_.-]+:([^\x20\x09-\x0D/@:]+)@", 6, 1),
)
RULES = BASE + ADDED
SPAN = "struct<rule: string, start: int, stop: int>"


def find(rule: Rule, text: str) -> list[tuple[int, int]]:
    """Start and end, exclusive, of the rule's spans, in code points."""
    return [m.span() for m in re.finditer(rule.pattern, text) if len(m[rule.group]) >= rule.least]


def blob_of(text: str = "text") -> Column:
    """The address of a text; null is the empty text."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


class Ledger:
    """Batches of (blob, rules, spans) in a folder of the shared store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def batches(self) -> list[str]:
        """Paths of the committed batches."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        at = hadoop.Path(self.path)
        store = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(at):
            return []
        found = sorted(f.getPath().toString() for f in store.listStatus(at))
        return [f for f in found if store.exists(hadoop.Path(f, "_SUCCESS"))]

    def rows(self) -> DataFrame:
        """(blob, rules, spans) of every committed batch; a blob has a row for each batch that scanned it."""
        fields, batches = f"blob binary, rules array<string>, spans array<{SPAN}>", self.batches()
        return self.spark.read.schema(fields).parquet(*batches) if batches else self.spark.createDataFrame([], fields)

    def add(self, rows: DataFrame) -> None:
        rows.select("blob", "rules", "spans").write.parquet(f"{self.path}/batch-{len(self.batches()):08d}-{uuid.uuid4().hex}")


def _unseen(blobs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, ..., missing): blobs for which present rules are missing in the ledger."""
    present = F.array(*(F.lit(r.name) for r in rules))
    if not ledger.batches():
        return blobs.withColumn("missing", present)
    seen = ledger.rows().groupBy(F.col("blob").alias("of")).agg(F.flatten(F.collect_list("rules")).alias("seen"))
    both = blobs.join(seen, F.col("blob") == F.col("of"), "left").withColumn("missing", F.array_except(present, F.coalesce("seen", F.array().cast("array<string>"))))
    return both.filter(F.size("missing") > 0).drop("of", "seen")


def _scanned(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rules, spans) of (blob, missing, text): each text meets the rules that are missing for it."""
    by_name = {r.name: r for r in rules}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            spans = []
            for missing, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                whole = text.as_py() or ""
                spans.append([(name, *span) for name in missing for span in find(by_name[name], whole)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind)], ["blob", "rules", "spans"])

    return texts.select("blob", "missing", "text").mapInArrow(scan, f"blob binary, rules array<string>, spans array<{SPAN}>")


def scan(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, path_col: str = "doc_id") -> DataFrame:
    """Brings the ledger up to date for all versions and returns (path_col, blob, spans) for each of them.

    versions has path_col and text; other columns are ignored. A path may have many versions, a text may stand at many
    paths; rows that repeat are returned each. Null texts are the empty text, a null path is a path. spans are those of
    ``rules`` at their present versions, by start, then in the order of ``rules``, in code points, with the end exclusive; a
    text without findings has none. Where no blob lacks a rule, no text is read and no batch added. An empty table gives no rows.
    """
    addressed = written(versions.select(F.col(path_col).alias("path"), blob_of().alias("blob")), "addressed")
    # One place to read each blob from; texts themselves are moved only to it.
    blobs = addressed.groupBy("blob").agg(F.min(F.struct("path")).alias("at")).select("blob", F.col("at.path").alias("of_path"))
    todo = written(_unseen(blobs, ledger, rules), "unseen").withColumnRenamed("blob", "of_blob")
    texts = versions.select(F.col(path_col).alias("path"), "text").withColumn("blob", blob_of())
    chosen = texts.join(todo, F.col("path").eqNullSafe(F.col("of_path")) & (F.col("blob") == F.col("of_blob"))).select("blob", "missing", "text")
    if not todo.isEmpty():
        ledger.add(_scanned(chosen, rules))
    # A blob at a path that has it twice, and blobs that two scans met at once, stand in the ledger twice.
    current = F.array(*(F.lit(r.name) for r in rules))
    order = F.create_map(*(x for k, r in enumerate(rules) for x in (F.lit(r.name), F.lit(k))))
    found = ledger.rows().filter(F.size("spans") > 0).select(F.col("blob").alias("of"), F.filter("spans", lambda s: F.array_contains(current, s["rule"])).alias("spans"))
    found = found.groupBy("of").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    ranked = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[s["rule"]].alias("at"), s["stop"].alias("stop"))))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    found = written(found.select("of", F.transform(ranked, lambda s: F.struct(kinds[s["at"]].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))).alias("spans")), "findings")
    none = F.array().cast("array<struct<kind: string, start: int, stop: int>>")
    joined = addressed.join(found, F.col("blob") == F.col("of"), "left")
    return joined.select(F.col("path").alias(path_col), "blob", F.coalesce("spans", none).alias("spans"))


def digests(found: DataFrame, path_col: str = "doc_id") -> DataFrame:
    """Per row of ``scan``: numbers of base spans by kind, the digest of all base spans, and all spans as one string."""
    base = [r.kind for r in BASE]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(path_col, *map(count, base), F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
