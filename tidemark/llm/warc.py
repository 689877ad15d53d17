"""WARC archives: writing them, and normalising files that were compressed as one gzip stream.

A monolithic file can only be read from its start. The normaliser inflates it once, in pieces, rewrites every record as a
gzip member of its own and writes a sidecar index of their offsets, so that any record can be read alone.
Archives lie in a folder that all executors share; a task writes to a name of its own and then renames, so a task that is
run again leaves the same files.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import scratch, table, written

DATE = "1970-01-01T00:00:00Z"
REVISIT_LEAST = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of payload after which a task begins another archive, and bytes that are inflated at a time.
ARCHIVE_BYTES, PIECE = 64 << 20, 1 << 20
RECORD = T.StructType([T.StructField("archive", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType())])


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _clean(value: str) -> str:
    """A header value on one line: white space and control characters are percent-encoded."""
    return quote(value, safe="".join(map(chr, range(33, 127))))


def record_bytes(page_id: int | None, number: str, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """A response record, or a revisit, which has the payload's digest and length but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'none-' + number if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {_clean(url)}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"] if is_revisit else []
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers_of(head: bytes) -> dict[str, str]:
    return {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def split_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of each record in a stream of bytes; holds one record at a time."""
    held = bytearray()
    need, head, body = 0, {}, 0
    for chunk in chunks:
        held += chunk
        while len(held) >= need:
            if not need:
                if (end := held.find(b"\r\n\r\n")) < 0:
                    break
                head, body = headers_of(bytes(held[:end])), end + 4
                need = body + int(head["content-length"]) + 4
                continue
            yield head, bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError("the archive ends within a record")


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in pieces of bounded size."""
    engine = zlib.decompressobj(31)
    while piece := stream.read(PIECE):
        while piece:
            yield engine.decompress(piece, PIECE)
            while engine.unconsumed_tail:
                yield engine.decompress(engine.unconsumed_tail, PIECE)
            piece = engine.unused_data
            if engine.eof:
                engine = zlib.decompressobj(31)
    yield engine.flush()


def write_monolithic(records: DataFrame, folder: str) -> DataFrame:
    """Writes (page_id, url, payload, payload_digest, refers_to, is_revisit) as whole-file gzip streams; returns (archive)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        names: list[str] = []
        out, size, engine = None, 0, None

        def close():
            out.write(engine.flush())
            out.close()

        for batch in batches:
            for columns in zip(*batch.columns, strict=True):
                page_id, url, payload, digest, refers_to, is_revisit = (c.as_py() for c in columns)
                if out is None or size >= ARCHIVE_BYTES:
                    if out is not None:
                        close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    store.create_dir(base, recursive=True)
                    out, size, engine = store.open_output_stream(f"{base}/{names[-1]}", compression=None), 0, zlib.compressobj(1, zlib.DEFLATED, 31)
                data = record_bytes(page_id, uuid.uuid4().hex, url, payload, digest, refers_to, is_revisit)
                out.write(engine.compress(data))
                size += len(data)
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n in names], pa.string())], ["archive"])

    return records.select("page_id", "url", "payload", "payload_digest", "refers_to", "is_revisit").mapInArrow(write, "archive string")


def normalise(archives: DataFrame, folder: str, level: int = 6, remove: bool = False) -> DataFrame:
    """Rewrites each gzip WARC file (column archive) with a member per record, beside it an index as JSON lines.

    Returns the index: archive, offset, length, record_id, record_type. With ``remove`` the old file goes once the new
    one is in place. A file without records gives none; one that ends within a record is an error.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():  # names end in .gz, so the store is told not to inflate by itself
                (store, old), (goal, base) = _store(archive), _store(folder)
                goal.create_dir(base, recursive=True)
                name = old.rsplit("/", 1)[-1]
                if remove and store.get_file_info(old).type == pa.fs.FileType.NotFound:
                    # An earlier run of this task had finished; its index says what it wrote.
                    with goal.open_input_stream(f"{base}/{name}.idx") as kept:
                        rows = [tuple(json.loads(line)) for line in kept.read().decode().splitlines()]
                else:
                    part, rows, offset = f"{base}/.{name}.{uuid.uuid4().hex}", [], 0
                    with store.open_input_stream(old, compression=None) as stream, goal.open_output_stream(part, compression=None) as out:
                        for head, data in split_records(inflated(stream)):
                            engine = zlib.compressobj(level, zlib.DEFLATED, 31)
                            member = engine.compress(data) + engine.flush()
                            out.write(member)
                            rows.append((f"{folder}/{name}", offset, len(member), head["warc-record-id"].strip("<>"), head["warc-type"]))
                            offset += len(member)
                    with goal.open_output_stream(f"{part}.idx") as index:
                        index.write("".join(json.dumps(row) + "\n" for row in rows).encode())
                    goal.move(part, f"{base}/{name}")
                    goal.move(f"{part}.idx", f"{base}/{name}.idx")
                    if remove:
                        store.delete_file(old)
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], RECORD.names)

    return archives.select("archive").mapInArrow(rewrite, RECORD)


def read_records(index: DataFrame) -> DataFrame:
    """Reads records by their index rows: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload.

    The digest of a response is that of the bytes read, and must agree with its header; a revisit gives what its headers say.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, object] = ("", None)
        page = lambda urn: None if "none-" in urn else int(urn.strip("<>").rsplit(":", 1)[1])
        for whole in batches:
            for batch in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                rows = []
                for archive, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    if opened[0] != archive:
                        store, path = _store(archive)
                        opened = (archive, store.open_input_file(path))
                    member = zlib.decompress(opened[1].read_at(length, offset), 31)
                    end = member.index(b"\r\n\r\n")
                    head = headers_of(member[:end])
                    block = member[end + 4 : end + 4 + int(head["content-length"])]
                    http = block.index(b"\r\n\r\n")
                    payload, digest = block[http + 4 :], head["warc-payload-digest"].removeprefix("sha1:")
                    revisit = head["warc-type"] == "revisit"
                    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{head['warc-record-id']}: the payload does not have its digest")
                    size = int(headers_of(block[:http])["content-length"])
                    rows.append((page(head["warc-record-id"]), size, digest, head["warc-type"], page(head["warc-refers-to"]) if revisit else None, head.get("warc-target-uri"), None if revisit else payload))
                columns = list(zip(*rows, strict=True)) or [()] * 7
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])

    return index.select("archive", "offset", "length").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def archive_pages(pages: DataFrame, least: int = REVISIT_LEAST) -> DataFrame:
    """Writes pages (page_id, url, html; others are ignored) as WARC records and returns their index (see normalise).

    A payload is the html in UTF-8, null as empty. Of records whose equal payloads have at least ``least`` bytes the one
    with the largest page_id is a response and the rest are revisits of it; rows that repeat that page_id are all
    responses, rows without page_id revisits unless none has one. A null url leaves its header out. No rows give no archive.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("payload_digest"))
    digests = rows.filter(F.length("payload") >= least).groupBy("payload_digest", F.length("payload").alias("bytes")).agg(F.max("page_id").alias("newest"), F.count("*").alias("copies"))
    repeated = written(digests.filter("copies > 1").select(F.col("payload_digest").alias("of_digest"), F.col("bytes").alias("of_bytes"), "newest"), "repeated")
    same = (F.col("payload_digest") == F.col("of_digest")) & (F.length("payload") == F.col("of_bytes"))
    older = F.coalesce(F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest")), F.lit(False))
    marked = rows.join(repeated, same, "left").withColumn("is_revisit", older).withColumn("refers_to", F.when(older, F.col("newest")))
    folder = scratch(spark, "warc")
    whole, _ = table(write_monolithic(marked, f"{folder}/whole"), "archives")
    count = max(1, whole.count())
    return table(normalise(whole.repartition(count, "archive"), f"{folder}/records", remove=True), "index")[0]
