"""WARC archives as a Spark data source, read and written.

Reading plans partitions from file sizes. Filters on the record type and on header columns are pushed down; each record's
headers are parsed first, and the block of a record that they rule out, or whose payload no column asks for, is skipped: by
a seek in plain files, and by the member length that our gzip members carry in an extra field (other archives: inflated and
thrown away, never decoded).

Writing: a task writes files of its own, up to roll_bytes each; the driver lists the files of the tasks that
succeeded in a manifest, and readers take only those, so retries and lost executors leave no double records. Files are opened
through pyarrow's file systems, so any path that all executors reach will do.
"""

from __future__ import annotations

import base64
import json
import posixpath
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha1
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import maybe_broadcast, plain, shared_path, table, written

SCHEMA = "record_id string, record_type string, date string, target_uri string, content_type string, payload_digest string, payload_bytes long, page_id long, refers_to long, headers map<string,string>, http_headers string, payload binary"
#: Column: header. What is pushed down is judged by these alone.
HEADERS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "date": "warc-date", "target_uri": "warc-target-uri", "content_type": "content-type",
    "payload_digest": "warc-payload-digest", "page_id": "x-page-id", "refers_to": "x-refers-to-page-id",
}
MANIFEST = "_records.json"
SKIP_FIELD = b"sl"
#: Bytes read at a time.
CHUNK = 1 << 20


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def value_of(headers: dict[str, str], column: str) -> str | int | None:
    raw = headers.get(HEADERS[column])
    if raw is None:
        return None
    if column in ("page_id", "refers_to"):
        return int(raw)
    if column == "payload_digest":
        return raw.removeprefix("sha1:")
    return unquote(raw) if column == "target_uri" and headers.get("x-uri-quoted") else raw


def parse_headers(raw: bytes) -> dict[str, str]:
    """Lower-case names to values; folded lines continue the one before, and of equal names the last counts."""
    out: dict[str, str] = {}
    name = ""
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


class _Bytes:
    """A forward reader over one file: peeks, reads and skips."""

    def __init__(self, f: pa.NativeFile) -> None:
        self.f, self.buf = f, b""

    def fill(self, n: int) -> bytes:
        while len(self.buf) < n and (more := self.f.read(max(CHUNK, n - len(self.buf)))):
            self.buf += more
        return self.buf

    def take(self, n: int) -> bytes:
        out, self.buf = self.fill(n)[:n], self.buf[n:]
        return out

    def skip(self, n: int) -> None:
        if n <= len(self.buf):
            self.buf = self.buf[n:]
        else:
            self.f.seek(self.f.tell() + n - len(self.buf))
            self.buf = b""


def records(f: pa.NativeFile, wanted: Callable[[dict[str, str]], bool], need_block: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """The wanted records of an archive: headers, and the block or None if it isn't needed."""
    src = _Bytes(f)
    while True:
        head = src.fill(2)[:2]
        if not head:
            return
        if head == b"\x1f\x8b":
            yield from _gzip_member(src, wanted, need_block)
            continue
        while (at := src.buf.find(b"\r\n\r\n")) < 0:
            had = len(src.buf)
            if len(src.fill(had + CHUNK)) == had:
                return  # an unended header: the archive was cut
        headers = parse_headers(src.take(at + 4))
        size = int(headers.get("content-length", 0))
        if wanted(headers):
            if need_block:
                yield headers, src.take(size)
            else:
                src.skip(size)
                yield headers, None
        else:
            src.skip(size)
        src.skip(4)


def _gzip_member(src: _Bytes, wanted: Callable[[dict[str, str]], bool], need_block: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    start = src.fill(24)
    skip = struct.unpack("<I", start[16:20])[0] if len(start) >= 24 and start[3] & 4 and start[12:14] == SKIP_FIELD else None
    if skip is not None:
        whole = src.fill(skip)[:skip] if need_block else src.fill(min(skip, 4096))[: min(skip, 4096)]
        z = zlib.decompressobj(31)
        data, rest = z.decompress(whole, 4096), z.unconsumed_tail
        while (at := data.find(b"\r\n\r\n")) < 0 and not z.eof:
            if not rest:
                whole = src.fill(skip)[:skip]
                z, rest, data = zlib.decompressobj(31), whole, b""
            data += z.decompress(rest, 1 << 16)
            rest = z.unconsumed_tail
        headers = parse_headers(data[: at + 4])
        if wanted(headers):
            if need_block:
                if not z.eof:
                    data += z.decompress(rest) + z.flush()
                yield headers, data[at + 4 : at + 4 + int(headers.get("content-length", 0))]
            else:
                yield headers, None
        src.skip(skip)
        return
    z, data, headers, keep, at = zlib.decompressobj(31), b"", None, True, -1
    while not z.eof:
        piece = src.take(CHUNK)
        if not piece:
            return
        out = z.decompress(piece)
        if keep:
            data += out
        if headers is None and (at := data.find(b"\r\n\r\n")) >= 0:
            headers = parse_headers(data[: at + 4])
            keep = need_block and wanted(headers)
    src.buf = z.unused_data + src.buf
    if headers is not None and wanted(headers):
        yield headers, data[at + 4 : at + 4 + int(headers.get("content-length", 0))] if need_block else None


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.path = schema, options["path"]
        self.split_bytes = int(options.get("split_bytes", 64 << 20))
        self.verify = options.get("verify", "true").lower() == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        kinds = {EqualTo: "eq", In: "in", StringStartsWith: "starts", IsNotNull: "some", IsNull: "none"}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in kinds and column in HEADERS:
                self.tests.append((kinds[type(f)], column, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = open_fs(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.File:
            return [Files((root,))]
        manifest = posixpath.join(root, MANIFEST)
        if fs.get_file_info(manifest).type == pafs.FileType.File:
            found = [(posixpath.join(root, n), s) for n, s in json.loads(fs.open_input_stream(manifest).read())]
        else:
            found = [(x.path, x.size) for x in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if x.type == pafs.FileType.File and x.base_name.endswith((".warc", ".warc.gz"))]
        out, group, size = [], [], 0
        for path, n in sorted(found):
            if group and size + n > self.split_bytes:
                out.append(Files(tuple(group)))
                group, size = [], 0
            group.append(path)
            size += n
        return [*out, *([Files(tuple(group))] if group else [])] or [Files(())]

    def wanted(self, headers: dict[str, str]) -> bool:
        for kind, column, value in self.tests:
            own = value_of(headers, column)
            if not {"eq": lambda: own == value, "in": lambda: own in value, "starts": lambda: own is not None and own.startswith(value), "some": lambda: own is not None, "none": lambda: own is None}[kind]():  # noqa: B023
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in self.schema.fields]
        if unknown := set(names) - {*HEADERS, "headers", "http_headers", "payload", "payload_bytes"}:
            raise ValueError(f"a WARC record has no {sorted(unknown)}")
        need_payload = "payload" in names
        need_block = need_payload or "http_headers" in names or "payload_bytes" in names
        schema, rows, held = to_arrow_schema(self.schema), [], 0
        fs, _ = open_fs(self.path)
        for path in partition.paths:
            with fs.open_input_file(path) as f:
                for headers, block in records(f, self.wanted, need_block):
                    row = {c: value_of(headers, c) for c in names if c in HEADERS}
                    if "headers" in names:
                        row["headers"] = list(headers.items())
                    if need_block:
                        row |= self._payload(headers, block, need_payload)
                    rows.append(tuple(row.get(c) for c in names))
                    held += len(block or b"") if need_payload else 200
                    if held > 8 << 20 or len(rows) >= 4096:
                        yield _batch(rows, schema)
                        rows, held = [], 0
        if rows:
            yield _batch(rows, schema)

    def _payload(self, headers: dict[str, str], block: bytes, keep: bool) -> dict:
        http, payload = None, block
        if headers.get("content-type", "").startswith("application/http"):
            head, _, payload = block.partition(b"\r\n\r\n")
            http = head.decode("utf-8", "replace")
        if headers.get("warc-type") == "revisit":  # its payload is elsewhere; its HTTP header says how long it was
            size = int(parse_headers((http or "").encode()).get("content-length", 0))
            return {"http_headers": http, "payload_bytes": size, "payload": None}
        digest = headers.get("warc-payload-digest")
        if self.verify and digest and digest.startswith("sha1:") and base64.b32encode(sha1(payload).digest()).decode() != digest[5:]:
            raise ValueError(f"the payload of {headers.get('warc-record-id')} doesn't have its digest {digest}")
        return {"http_headers": http, "payload_bytes": len(payload), "payload": payload if keep else None}


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


@dataclass
class Wrote(WriterCommitMessage):
    files: tuple[tuple[str, int], ...]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.gzip = options.get("compression", "gzip") == "gzip"
        self.roll_bytes = int(options.get("roll_bytes", 1 << 30))
        self.date = options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        files: list[tuple[str, int]] = []
        out = None
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or out.tell() > self.roll_bytes:
                    if out is not None:
                        files[-1] = (files[-1][0], out.tell())
                        out.close()
                    name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip
                    out = fs.open_output_stream(posixpath.join(root, name), compression=None)
                    files.append((name, 0))
                record = warc_record(row, self.date)
                out.write(gzip_member(record) if self.gzip else record)
        if out is not None:
            files[-1] = (files[-1][0], out.tell())
            out.close()
        return Wrote(tuple(files))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        at = posixpath.join(root, MANIFEST)
        had = [] if self.overwrite or fs.get_file_info(at).type != pafs.FileType.File else json.loads(fs.open_input_stream(at).read())
        with fs.open_output_stream(at, compression=None) as f:
            f.write(json.dumps([*had, *(x for m in messages if m for x in m.files)]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = open_fs(self.path)
        for name, _ in (x for m in messages if m for x in m.files):
            fs.delete_file(posixpath.join(root, name))


def warc_record(row: dict, date: str) -> bytes:
    """A record of payload (or of payload_bytes and payload_digest, for a revisit)."""
    revisit, payload = row["record_type"] == "revisit", row.get("payload") or b""
    digest = row["payload_digest"]
    ident = lambda page: uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page}")
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<urn:uuid:{ident(row['page_id'])}>"), ("WARC-Date", date)]
    if row.get("url") is not None:
        uri = row["url"]
        odd = any(ord(c) < 33 or c == "\x7f" for c in uri)
        head += [("WARC-Target-URI", quote(uri, safe=":/?#[]@!$&'()*+,;=") if odd else uri), *([("X-URI-Quoted", "1")] if odd else [])]
    if row["page_id"] is not None:
        head.append(("X-Page-ID", row["page_id"]))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:uuid:{ident(row['refers_to'])}>"), ("X-Refers-To-Page-ID", row["refers_to"])]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode() + (b"" if revisit else payload)
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member with its own length in an extra field, so that readers can step over it."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    extra = SKIP_FIELD + struct.pack("<HII", 8, 24 + len(body) + 8, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class WarcSource(DataSource):
    """format("warc"). Options: path; reading: split_bytes (of files in a partition), verify (payload digests); writing:
    compression (gzip or none), roll_bytes, date. Ask for fewer columns with .schema(): a payload that isn't asked for
    isn't kept, and without payload, http_headers and payload_bytes blocks are skipped."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_warc(pages: DataFrame, path: str, *, revisit_min_bytes: int = 0, compression: str = "gzip") -> None:
    """Archive pages (page_id, url, html). Of pages with equal payloads of revisit_min_bytes at least, that with the smallest
    page_id is a response and the others revisit it.

    Null html: an empty payload. Null url: no target URI. Null page_id: after all others, and a response where all of a group
    are null. Rows with equal page_id and html that come first are all responses. No rows: an archive without records."""
    register(pages.sparkSession)
    p = plain(pages, page_id="page_id:long", url="url:string", html="html:string")
    p = p.withColumn("payload", F.encode(F.coalesce("html", F.lit("")), "UTF-8")).drop("html")
    p = p.withColumn("hex", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    # Only digests, lengths and ids are shuffled; of repeated payloads a row each is written and, by their counted number, broadcast.
    keys = p.where(F.col("payload_bytes") >= revisit_min_bytes).select("hex", "payload_bytes", "page_id")
    same = keys.groupBy(F.col("hex").alias("h"), F.col("payload_bytes").alias("n")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c"))
    same = written(same.where("c > 1 AND first IS NOT NULL").drop("c"), "warc-same")
    p = p.join(maybe_broadcast(same, same.count()), (F.col("hex") == F.col("h")) & (F.col("payload_bytes") == F.col("n")), "left")
    revisits = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    base32 = F.expr("array_join(transform(sequence(0, 31), i -> substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(conv(substring(bits, i * 5 + 1, 5), 2, 10) AS int) + 1, 1)), '')")
    bits = F.expr("array_join(transform(sequence(0, 3), i -> lpad(conv(substring(hex, i * 10 + 1, 10), 16, 2), 40, '0')), '')")
    p = p.withColumn("bits", bits).select(
        "page_id", "url", F.when(revisits, F.lit(None)).otherwise(F.col("payload")).alias("payload"), "payload_bytes", base32.alias("payload_digest"),
        F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, F.col("first")).alias("refers_to"),
    )
    p.write.format("warc").mode("append").option("compression", compression).save(path)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    columns = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return spark.read.format("warc").schema(columns).load(path)




OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || hex[(i // 4) * 5 + 1:(i // 4) * 5 + 5])::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1]), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p
"""
