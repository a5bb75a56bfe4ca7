"""WARC archives: write, normalise a monolithic gzip stream into one member per record, read back.

A crawler's archive may be one gzip stream over all its records, which nobody can seek in. The
normaliser inflates such a file once, front to back, rewrites every record as a gzip member of
its own and writes a sidecar index of (record, offset, length), so that any record can be read
alone. Tasks work on one archive each, in bounded memory; only names pass through Spark.

Files are written through ``pyarrow.fs`` to the shared folder under a fresh name for each task
attempt; a table lists the files of attempts that succeeded, so lost executors leave strays but no
wrong result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specimen_spark.functions.storage import new_path
from specimen_spark.llm.common import prepared, staged, table

#: Bytes of records after which a task begins the next archive.
ARCHIVE_BYTES = 16 << 20
READ_BYTES = 1 << 20
LEVEL = 3

# Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def page_of(name: str):
    value = name.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "none" else int(value)


def record(page_id, url, payload: bytes, kind: str, refers_to=None) -> bytes:
    """One WARC record. A revisit carries the full payload's digest and length, not the payload."""
    block = HTTP_HEAD + payload if kind == "response" else HTTP_HEAD
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", " ".join((url or "urn:none").split())),
        ("WARC-Payload-Digest", "sha1:" + digest(payload)),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if kind == "revisit":
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def parse_head(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if x)}


def records_in(chunks: Iterator[bytes]) -> Iterator[tuple[dict, bytes]]:
    """(header fields, whole record) of each record of a stream given in chunks."""
    held, need = bytearray(), 0
    fields = None
    for chunk in chunks:
        held += chunk
        while len(held) >= need:
            if fields is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                fields = parse_head(bytes(held[:end]))
                need = end + 4 + int(fields["content-length"]) + 4
            else:
                yield fields, bytes(held[:need])
                del held[:need]
                fields, need = None, 0
                if not held:
                    break
    if held.strip():
        raise ValueError("the stream ends inside a record")


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file, whether one member or many, read once."""
    inflate = zlib.decompressobj(31)
    while data := stream.read(READ_BYTES):
        while data:
            yield inflate.decompress(data)
            data = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
    tail = inflate.flush()
    if tail:
        yield tail


def _member(data: bytes) -> bytes:
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, html, kind, refers_to) rows as monolithic archives; their names."""

    def run(batches):
        out = pack = None
        name, held, made = "", 0, []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for page, url, html, kind, ref in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    data = record(page, url, (html or "").encode(), kind, ref)
                    if out is None:
                        place, base = fs.FileSystem.from_uri(folder)
                        name, held = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = place.open_output_stream(f"{base}/{name}", compression=None)
                        pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    out.write(pack.compress(data))
                    held += len(data)
                    if held >= ARCHIVE_BYTES:
                        out.write(pack.flush())
                        out.close()
                        out = None
                        made.append(name)
        if out is not None:
            out.write(pack.flush())
            out.close()
            made.append(name)
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["archive"])

    return pages.select("page_id", "url", "html", "kind", "refers_to").mapInArrow(run, "archive string")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive record by record, with a sidecar index; (archive, records, index)."""

    def run(batches):
        place, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                new = f"{uuid.uuid4().hex}.warc.gz"
                offset, count = 0, 0
                with (
                    place.open_input_stream(f"{base}/{name}", compression=None) as source,
                    place.open_output_stream(f"{base}/{new}", compression=None) as out,
                    place.open_output_stream(f"{base}/{new}.idx", compression=None) as index,
                ):
                    for fields, data in records_in(inflated(source)):
                        member = _member(data)
                        out.write(member)
                        line = [fields["warc-record-id"], fields["warc-type"], offset, len(member)]
                        index.write(json.dumps(line).encode() + b"\n")
                        offset += len(member)
                        count += 1
                yield pa.RecordBatch.from_pydict({"archive": [new], "index": [f"{new}.idx"], "records": [count]})

    return archives.mapInArrow(run, "archive string, index string, records long")


READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(archives: DataFrame, folder: str) -> DataFrame:
    """Read every record of normalised archives through its index, one member at a time.

    A response's length and digest are those of the payload read; a revisit's come from its
    header.
    """

    def run(batches):
        place, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with place.open_input_stream(f"{base}/{index}", compression=None) as f:
                    entries = [json.loads(x) for x in f.read().splitlines()]
                with place.open_input_file(f"{base}/{name}") as source:
                    for at in range(0, len(entries), 4096):
                        rows = [_row(source, e) for e in entries[at : at + 4096]]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(
                                zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))],
                            names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                        )

    return archives.select("archive", "index").mapInArrow(run, READ_SCHEMA)


def _row(source, entry):
    name, kind, offset, length = entry
    source.seek(offset)
    data = zlib.decompress(source.read(length), 31)
    end = data.index(b"\r\n\r\n")
    fields = parse_head(data[:end])
    if fields["warc-record-id"] != name:
        raise ValueError("the index does not fit its archive")
    if kind == "revisit":
        return (
            page_of(name), int(fields["x-payload-length"]),
            fields["warc-payload-digest"].removeprefix("sha1:"), kind, page_of(fields["warc-refers-to"]),
        )
    block = data[end + 4 : end + 4 + int(fields["content-length"])]
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    return page_of(name), len(payload), digest(payload), kind, None


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Add kind and refers_to: among equal payloads the largest page_id is the response.

    Payloads below ``min_bytes`` are all responses. Only digests that occur more than once are
    joined back; the join's sides are plain, so Spark can split a digest that holds most rows.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keyed = pages.withColumn("_digest", F.when(F.length(payload) >= min_bytes, F.unhex(F.sha1(payload))))
    repeated = staged(
        keyed.filter("_digest is not null").groupBy("_digest")
        .agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1").select(F.col("_digest").alias("_key"), "_first"),
        "repeated",
    )
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return keyed.join(repeated, F.col("_digest") == F.col("_key"), "left").select(
        "page_id", "url", "html",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("kind"),
        F.when(revisit, F.col("_first")).alias("refers_to"),
    )


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages as archives, normalise them, and read them back through their indexes.

    Null html is an empty payload. A null page_id is kept: it revisits the largest id among equal
    payloads, or is a response where there is none. Rows that repeat the largest page_id with
    its payload are responses too. Columns besides page_id, url and html are not read. An empty
    table gives no rows.
    """
    spark = prepared(pages.sparkSession)
    folder = new_path(spark, "warc")
    if folder.startswith("/"):
        folder = f"file://{folder}"
    place, base = fs.FileSystem.from_uri(folder)
    place.create_dir(base, recursive=True)
    source = with_revisits(pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")
    ), min_bytes)
    written = staged(write_archives(source, folder), "archives")
    spread = written.repartition(max(1, min(written.count(), 100_000)))
    normal = staged(normalise(spread, folder), "normalised")
    return read_records(normal.repartition(max(1, min(normal.count(), 100_000))), folder)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages."""
    return round_trip(table(spark, sf_dir, "pages"))
