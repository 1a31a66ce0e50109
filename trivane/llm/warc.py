"""WARC archives as seekable Zstandard bundles.

Writing. Payload digests are compared in Spark first: only (page_id, digest, length) is shuffled, with
map-side combined minima, so a payload shared by a third of all pages costs no more than another.
Each writing task then streams its rows into bundles of bounded size. A bundle is a sequence of
independent Zstandard frames of about ``FRAME_BYTES`` of records each, followed by a seek table in a
skippable frame (the public seekable format: magic 0x184D2A5E, per frame compressed and decompressed
size, footer with frame count, descriptor and magic 0x8F92EAB1). ``zstd -d`` can read it whole; a
reader can seek to one frame. The index maps record identifiers to (bundle, frame, offset in frame,
length); where a frame lies in its bundle is read from the bundle's own seek table.

Every attempt of a task writes under names of its own, and only files named by the index of the
attempt that Spark accepted are ever read, so lost executors and repeated attempts do no harm. Memory
is bounded by one frame, or by one record if that is larger.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, lean, scratch, written

MIN_REVISIT_BYTES = 100
FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 64 * 1024 * 1024
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
DATE = "2000-01-01T00:00:00Z"  # no clock: reruns give equal bytes

INDEX = "record_id string, page_id long, bundle string, frame int, offset long, length long"


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a bundle's address; s3a, as Hadoop names it, is s3 here."""
    uri = "s3" + uri[3:] if uri.startswith("s3a:") else uri
    return pafs.FileSystem.from_uri(uri) if ":" in uri else (pafs.LocalFileSystem(), uri)


def _clean(value: str) -> str:
    """Header values hold no line breaks."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if ("\r" in value or "\n" in value) else value


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url) if url else record_id(page_id)[1:-1]}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The record's headers, HTTP headers and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("record length does not fit")
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"headers": headers, "http": dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), "payload": payload}


class BundleWriter:
    """Writes one bundle: frames of records, then the seek table."""

    def __init__(self, uri: str):
        fs, path = _fs(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri, self.out, self.frames, self.at = uri, fs.open_output_stream(path, compression=None), [], 0
        self.zstd, self.buffer, self.entries, self.index = zstandard.ZstdCompressor(level=3, write_content_size=True), bytearray(), [], []

    def add(self, rid: str, page_id: int | None, data: bytes) -> None:
        if self.buffer and len(self.buffer) + len(data) > FRAME_BYTES:
            self.flush()
        self.entries.append((rid, page_id, len(self.buffer), len(data)))
        self.buffer += data

    def flush(self) -> None:
        if not self.buffer:
            return
        packed = self.zstd.compress(bytes(self.buffer))
        self.out.write(packed)
        self.index += [(rid, pid, self.uri, len(self.frames), offset, length) for rid, pid, offset, length in self.entries]
        self.frames.append((len(packed), len(self.buffer)))
        self.at += len(packed)
        self.buffer, self.entries = bytearray(), []

    def close(self) -> list[tuple]:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()
        return self.index


def frames_of(f: pa.NativeFile, uri: str) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame, from the bundle's footer."""
    f.seek(f.size() - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError(f"{uri} has no seek table")
    f.seek(f.size() - 9 - 8 * n)
    out, at = [], 0
    for packed, plain in struct.iter_unpack("<II", f.read(8 * n)):
        out.append((at, packed, plain))
        at += packed
    return out


def seek_table(uri: str) -> list[tuple[int, int, int]]:
    fs, path = _fs(uri)
    with fs.open_input_file(path) as f:
        return frames_of(f, uri)


def payload_roles(pages: DataFrame) -> DataFrame:
    """(page_id, digest, bytes, refers_to) of distinct pages; refers_to is null for responses."""
    body = F.coalesce("html", F.lit(""))
    keys = pages.select("page_id", F.sha2(body.cast("binary"), 256).alias("digest"), F.octet_length(body).cast("long").alias("bytes")).distinct()
    keys = written(keys, "warc-keys")
    first = keys.where(F.col("bytes") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    roles = keys.join(first, "digest", "left")
    return roles.select("page_id", "digest", "bytes", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_bundles(pages: DataFrame, folder: str) -> DataFrame:
    """Write all ``pages`` (page_id, url, html) as bundles below ``folder``; return the index.

    Records are named by page_id, so rows that share one share a name as well. A null html is an empty payload, a null url gives the record's own identifier as target. Pages
    with equal page_id and equal html play one role; a null page_id is never referred to. An empty
    table writes no bundle. Other columns are ignored.
    """
    roles = written(payload_roles(pages), "warc-roles").withColumnsRenamed({"page_id": "_p", "digest": "_d"})
    p = pages.select("page_id", "url", "html").withColumn("digest", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))
    # Equal payloads are spread by page_id, not gathered by digest.
    joined = p.join(roles, p.page_id.eqNullSafe(roles._p) & (p.digest == roles._d)).drop("_p", "_d")
    joined = joined.withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
        packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "html", "digest", "bytes", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, html, digest, size, refers = (c[i].as_py() for c in cols)
                writer = writer or BundleWriter(f"{folder}/{uuid.uuid4().hex}.warc.zst")
                writer.add(record_id(page_id), page_id, record(page_id, url, (html or "").encode(), size, digest, refers))
                if writer.at >= BUNDLE_BYTES:
                    yield packed(writer.close())
                    writer = None
        if writer:
            yield packed(writer.close())

    return joined.select("page_id", "url", "html", "digest", "bytes", "refers_to").mapInArrow(lean(write), INDEX)


def read_bundles(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Read records back by the index: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    payload is null for revisits, and for all without ``payloads``. Rows of one frame lie together in the index, so a frame is fetched and decompressed once; any
    subset of index rows can be read, a frame at a time. Digests are recomputed for responses and
    must equal the header's; a mismatch raises.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, at, file, table, frame, zstd = None, None, None, [], b"", zstandard.ZstdDecompressor()
        rows, held = [], 0
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        for batch in batches:
            for r in batch.to_pylist():
                if r["bundle"] != name:
                    fs, path = _fs(r["bundle"])
                    if file:
                        file.close()
                    name, at, file = r["bundle"], None, fs.open_input_file(path)
                    table = frames_of(file, name)
                if r["frame"] != at:
                    at = r["frame"]
                    begin, packed, _ = table[at]
                    file.seek(begin)
                    frame = zstd.decompress(file.read(packed))
                x = parse_record(frame[r["offset"] : r["offset"] + r["length"]])
                h, kind = x["headers"], x["headers"]["WARC-Type"]
                digest, size = h["WARC-Payload-Digest"].removeprefix("sha256:"), int(x["http"]["Content-Length"])
                if h["WARC-Record-ID"] != r["record_id"] or kind == "response" and (hashlib.sha256(x["payload"]).hexdigest(), len(x["payload"])) != (digest, size):
                    raise ValueError(f"record {r['record_id']} in {name} is damaged")
                refers = int(h["WARC-Refers-To"].removeprefix("<urn:page:").rstrip(">")) if kind == "revisit" else None
                rows.append((r["page_id"], h["WARC-Target-URI"], size, digest, kind, refers, x["payload"] if payloads and kind == "response" else None))
                held += len(x["payload"]) * payloads
                if held > 1 << 22 or len(rows) >= 2000:
                    yield out()
                    rows, held = [], 0
        if rows:
            yield out()
        if file:
            file.close()

    return index.mapInArrow(lean(read), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op10_warc_round_trip(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    with arrow_rows(spark, 256):
        index = written(write_bundles(pages, scratch(spark, "warc")), "warc-index")
    return read_bundles(index, payloads=False).drop("url", "payload")
