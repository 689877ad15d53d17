"""WARC: round trips of payloads, revisits, whole-stream gzip files and their members."""

import gzip
import hashlib
import json

import pytest
from pyspark.sql import types as T

from tidemark.llm.warc import archive_pages, inflated, normalise, read_records, split_records

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("payload", T.StringType())])


def test_round_trip(spark):
    long = "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 60
    rows = [(k, f"http://x.org/{k}\r\nEvil: 1", f"<html>{k}" + "x" * (k * 37 % 1500), "x") for k in range(40)]
    rows += [(100, None, long, "x"), (101, "u", long, "x"), (99, "u", long, None), (102, "u", None, "x"), (103, "u", "", "x"), (104, "u", "short", "x"), (105, "u", "short", "x"), (None, "u", long, "x"), (106, "u", "y" * 3_000_000, "x"), (107, "u", "z" * 1000, "x"), (107, "u", "z" * 1000, "x"), (None, "u", "w" * 1000, "x"), (None, "u", "w" * 1000, "x")]
    index = archive_pages(spark.createDataFrame(rows, SCHEMA))
    found = read_records(index).collect()
    assert len(found) == len(rows) and index.select("archive", "offset").distinct().count() == len(rows)
    newest = {long: 101, "z" * 1000: 107}
    wanted = sorted(((i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if h in newest and i != newest[h] else "response", newest[h] if h in newest and i != newest[h] else None) for i, _, h, _ in rows), key=str)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == wanted
    bodies = {i: (h or "").encode() for i, _, h, _ in rows}
    assert all(r.payload == bodies[r.page_id] for r in found if r.record_type == "response" and r.page_id is not None)
    assert archive_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def record(k, body):
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:{k}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_foreign_files(spark, tmp_path):
    records = [record(k, b"b" * (k * 70_000)) for k in range(30)]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records[:5])))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b""))
    names = spark.createDataFrame([(f"file://{tmp_path}/{n}.warc.gz",) for n in "abc"], "archive string")
    rows = normalise(names, f"file://{tmp_path}/out").collect()
    assert len(rows) == 35
    for r in rows:
        data = open(r.archive.removeprefix("file://"), "rb").read()[r.offset : r.offset + r.length]
        assert gzip.decompress(data) == records[int(r.record_id.rsplit(":", 1)[1])]
    assert [json.loads(x)[1] for x in open(tmp_path / "out/b.warc.gz.idx")] == sorted(r.offset for r in rows if r.archive.endswith("b.warc.gz"))
    (tmp_path / "d.warc.gz").write_bytes(gzip.compress(records[3][:-9]))
    with open(tmp_path / "d.warc.gz", "rb") as f, pytest.raises(ValueError, match="within a record"):
        list(split_records(inflated(f)))
