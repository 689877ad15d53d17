"""The data source of landed payloads: ranges, chosen folders and streams."""

import gzip
import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.sources import landed as L


@pytest.fixture()
def root(tmp_path):
    for source in ("a", "b:c"):
        for day in (1, 2, 3):
            folder = tmp_path / f"source={source.replace(':', '%3A')}" / f"date=2024-01-0{day}"
            folder.mkdir(parents=True)
            lines = [json.dumps({"k": f"{source}{day}-{n}", "é": "x" * (n % 7)}, ensure_ascii=False) for n in range(40)]
            (folder / "one.jsonl").write_bytes(("\n".join(lines[:20]) + "\r\n\n").encode())
            (folder / "two.jsonl.gz").write_bytes(gzip.compress("\n".join(lines[20:]).encode()))
            (folder / "_SUCCESS").write_text("not a payload")
            (folder / "empty.jsonl").write_text("")
    (tmp_path / "source=a" / "notes.txt").write_text("no folder of a date")
    return f"file://{tmp_path}"


def names(rows):
    return sorted(r[0] for r in rows.select(F.get_json_object("payload", "$.k")).collect())


@pytest.mark.parametrize("size", [50, 1 << 20])
def test_each_line_is_read_once_whatever_the_ranges(spark, root, size):
    rows = L.read_landed(spark, root, split_bytes=str(size))
    assert names(rows) == sorted(f"{s}{d}-{n}" for s in ("a", "b:c") for d in (1, 2, 3) for n in range(40))
    assert rows.select("file", "position").distinct().count() == 240


def test_ranges_at_every_byte(tmp_path):
    from pyarrow import fs

    text = b"one\n\nthree\r\n\xff\nlast"
    (tmp_path / "f").write_bytes(text)
    whole = list(L._lines(fs.LocalFileSystem(), L.Split("s", date.min, str(tmp_path / "f"))))
    assert [line for _, line in whole] == [b"one", b"", b"three", b"\xff", b"last"]
    for cut in range(1, len(text)):
        parts = [L.Split("s", date.min, str(tmp_path / "f"), 0, cut), L.Split("s", date.min, str(tmp_path / "f"), cut, len(text))]
        assert [x for p in parts for x in L._lines(fs.LocalFileSystem(), p)] == whole


def test_sources_and_dates_choose_the_folders_that_are_opened(spark, root):
    every, third = L.read_landed(spark, root), date(2024, 1, 3)
    assert every.rdd.getNumPartitions() == 12
    for chosen, files, rows in [({"since": third}, 4, 80), ({"until": date(2024, 1, 1), "sources": ["a"]}, 2, 40), ({"since": date(2024, 1, 2), "until": date(2024, 1, 2), "sources": ["b:c", "z"]}, 2, 40), ({"sources": ["z"]}, 0, 0), ({"since": third, "until": date(2024, 1, 2)}, 0, 0), ({"sources": []}, 0, 0)]:
        found = L.read_landed(spark, root, **chosen)
        # A reader without partitions is given one that reads nothing.
        assert (found.rdd.getNumPartitions(), found.count()) == (max(1, files), rows), chosen


def test_queries_over_one_frame_do_not_meet(spark, root):
    every = L.read_landed(spark, root)
    assert every.filter("source = 'z'").count() == 0 and every.filter("date < '2024-01-02' OR source = 'a'").count() == 160
    assert every.filter("source = 'a'").unionByName(every.filter("date >= '2024-01-03'")).count() == 200


def test_a_missing_folder_is_empty(spark, tmp_path):
    assert L.read_landed(spark, f"file://{tmp_path}/nothing").count() == 0


def test_stream_gives_each_file_once_and_goes_on_after_a_restart(spark, root, tmp_path):
    def drain():
        rows = L.stream_landed(spark, root, settle="0", sources=["a"])
        rows.writeStream.format("parquet").option("path", f"file://{tmp_path}/out/rows").option("checkpointLocation", f"file://{tmp_path}/out/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(L.SCHEMA).parquet(f"file://{tmp_path}/out/rows")

    assert names(drain()) == names(L.read_landed(spark, root, sources=["a"]))
    late = tmp_path / "source=a" / "date=2024-01-01" / "late.jsonl"
    late.write_text('{"k": "late"}\n')
    assert names(drain()) == names(L.read_landed(spark, root, sources=["a"]))
    assert "late" in names(drain()) and drain().count() == 121
