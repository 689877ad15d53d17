"""A data source of landed payloads: JSON lines in folders by source and date, read in batches or as a stream."""

from __future__ import annotations

import gzip
import io
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "source string, date date, file string, position long, payload string"
#: Bytes of a file that one task reads, and lines of one batch that it gives.
SPLIT_BYTES, BATCH_LINES = 128 << 20, 4096


@dataclass
class Split(InputPartition):
    """The lines of a file that begin in [start, stop); a stop of None is the end of the file."""

    source: str
    date: date
    path: str
    start: int = 0
    stop: int | None = None


@dataclass(frozen=True)
class Wanted:
    """The folders that a query can use: sources (None: all) and the range of dates, both ends included."""

    sources: frozenset[str] | None = None
    since: date = date.min
    until: date = date.max

    def has(self, source: str, day: date) -> bool:
        return (self.sources is None or source in self.sources) and self.since <= day <= self.until


def _folders(files: fs.FileSystem, path: str, label: str) -> Iterator[tuple[str, str]]:
    """(value, path) of the folders named label=value; other names are passed over."""
    for entry in files.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if entry.type == fs.FileType.Directory and entry.base_name.startswith(f"{label}="):
            yield unquote(entry.base_name.removeprefix(f"{label}=")), entry.path


def _listed(root: str, wanted: Wanted) -> Iterator[tuple[str, date, fs.FileInfo]]:
    """(source, date, file) of what has landed in the wanted folders; other folders are not opened, hidden files passed over."""
    files, base = fs.FileSystem.from_uri(root)
    for source, folder in _folders(files, base, "source"):
        if wanted.sources is not None and source not in wanted.sources:
            continue
        for day, inner in _folders(files, folder, "date"):
            if wanted.has(source, date.fromisoformat(day)):
                for entry in files.get_file_info(fs.FileSelector(inner)):
                    if entry.type == fs.FileType.File and not entry.base_name.startswith(("_", ".")):
                        yield source, date.fromisoformat(day), entry


def _splits(source: str, day: date, entry: fs.FileInfo, size: int) -> list[Split]:
    """A plain file in ranges of ``size`` bytes, a compressed one whole; an empty file has none."""
    if entry.path.endswith(".gz"):
        return [Split(source, day, entry.path)]
    return [Split(source, day, entry.path, at, at + size) for at in range(0, entry.size, size)]


def _lines(files: fs.FileSystem, split: Split) -> Iterator[tuple[int, bytes]]:
    """(position, line) of a split; a line belongs to the split in which it begins."""
    with files.open_input_file(split.path) as raw, gzip.open(raw) if split.path.endswith(".gz") else io.BufferedReader(raw, 1 << 20) as lines:
        at = split.start
        if at:
            # The line that began before this split is its predecessor's, unless it ended right here.
            lines.seek(at - 1)
            at += len(lines.readline()) - 1
        while split.stop is None or at < split.stop:
            line = lines.readline()
            if not line:
                return
            yield at, line.rstrip(b"\r\n")
            at += len(line)


def _batches(root: str, split: Split | None) -> Iterator[pa.RecordBatch]:
    if split is None:  # what a reader without partitions is given
        return
    files, _ = fs.FileSystem.from_uri(root)
    schema = pa.schema([("source", pa.string()), ("date", pa.date32()), ("file", pa.string()), ("position", pa.int64()), ("payload", pa.string())])
    rows: list[tuple[int, str]] = []

    def made() -> pa.RecordBatch:
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.array([split.source] * n), pa.array([split.date] * n, pa.date32()), pa.array([split.path] * n), pa.array([at for at, _ in rows], pa.int64()), pa.array([text for _, text in rows], pa.string())], schema=schema)

    for at, line in _lines(files, split):
        if line.strip():
            rows.append((at, line.decode("utf-8", "replace")))
        if len(rows) == BATCH_LINES:
            yield made()
            rows.clear()
    if rows:
        yield made()


class _Batch(DataSourceReader):
    def __init__(self, root: str, wanted: Wanted, size: int):
        self.root, self.wanted, self.size = root, wanted, size

    def partitions(self) -> list[Split]:
        return [s for source, day, entry in _listed(self.root, self.wanted) for s in _splits(source, day, entry, self.size)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return _batches(self.root, partition)


class _Stream(DataSourceStreamReader):
    """Files in order of the time at which they landed, then of their path; an offset is the last of them."""

    def __init__(self, root: str, wanted: Wanted, size: int, settle: float):
        self.root, self.wanted, self.size, self.settle = root, wanted, size, settle

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": 0, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        newest = time.time_ns() - int(self.settle * 1e9)
        there = [(e.mtime_ns, e.path) for _, _, e in _listed(self.root, self.wanted) if e.mtime_ns <= newest]
        at, path = max(there, default=(0, ""))
        return {"at": at, "path": path}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        first, last = ((o["at"], o["path"]) for o in (start, end))
        return [s for source, day, e in _listed(self.root, self.wanted) if first < (e.mtime_ns, e.path) <= last for s in _splits(source, day, e, self.size)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return _batches(self.root, partition)


class LandedPayloads(DataSource):
    """Format ``landed``: lines under <path>/source=<source>/date=<yyyy-mm-dd>/, one payload each, plain or .gz.

    Rows are (source, date, file, position, payload); position is the byte at which the line begins, so file and position name a
    row. Blank lines are no payloads; bytes that are no UTF-8 are replaced. Options: ``sources`` (a JSON list), ``since`` and
    ``until`` (dates, both ends included) choose the folders that are opened; ``split_bytes`` is what one task reads of a plain
    file; ``settle`` (seconds, 1) is the age from which a stream takes a file, so that files of one moment are not parted.
    Files must not be changed once they have landed.

    Folders are chosen by options and not by the filters that Spark offers to a reader: these are kept with the loaded
    relation, so a second query over one frame would read the folders of the first.
    """

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return SCHEMA

    def _arguments(self) -> tuple[str, Wanted, int]:
        day = lambda key, default: date.fromisoformat(self.options[key]) if key in self.options else default
        sources = frozenset(json.loads(self.options["sources"])) if "sources" in self.options else None
        return self.options["path"], Wanted(sources, day("since", date.min), day("until", date.max)), int(self.options.get("split_bytes", SPLIT_BYTES))

    def reader(self, schema) -> _Batch:
        return _Batch(*self._arguments())

    def streamReader(self, schema) -> _Stream:  # noqa: N802
        return _Stream(*self._arguments(), float(self.options.get("settle", 1)))


def _options(sources: list[str] | None, since: date | None, until: date | None, more: dict[str, str]) -> dict[str, str]:
    given = {"sources": None if sources is None else json.dumps(sources), "since": since and since.isoformat(), "until": until and until.isoformat()}
    return more | {k: v for k, v in given.items() if v is not None}


def read_landed(spark: SparkSession, path: str, sources: list[str] | None = None, since: date | None = None, until: date | None = None, **options: str) -> DataFrame:
    """What has landed below ``path`` from the sources (None: all) between two dates; other folders are not opened."""
    spark.dataSource.register(LandedPayloads)
    return spark.read.format("landed").options(**_options(sources, since, until, options)).load(path)


def stream_landed(spark: SparkSession, path: str, sources: list[str] | None = None, since: date | None = None, until: date | None = None, **options: str) -> DataFrame:
    """The same rows as a stream of new files."""
    spark.dataSource.register(LandedPayloads)
    return spark.readStream.format("landed").options(**_options(sources, since, until, options)).load(path)
