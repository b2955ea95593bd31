"""WARC archives as a PySpark Python data source.

Writing: one gzip member a record, with its compressed length in the member's header, in files that
roll over at a size. Reading: files are packed into partitions of a target size; record-type and header
predicates are pushed down; of each member only the first bytes are inflated for the headers, and a record
that the predicates reject, or whose payload is not asked for, is passed over without decoding it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from graphloom.llm.common import BROADCAST_ROWS
from graphloom.session import reliable_checkpoint, shared_dir

SCHEMA = "page_id bigint, record_type string, target_uri string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"
_ARROW = pa.schema(
    [
        ("page_id", pa.int64()),
        ("record_type", pa.string()),
        ("target_uri", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload", pa.binary()),
    ]
)
#: Columns that are known from a record's headers.
_HEADER_COLUMNS = frozenset(_ARROW.names) - {"payload"}
_ROLL_BYTES = 64 << 20
_BATCH_BYTES = 4 << 20
_DATE = "2024-01-01T00:00:00Z"
_URN = "urn:graphloom:page:"
_ORIGINAL = "Graphloom-Original-URI"


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _member(data: bytes) -> bytes:
    """A gzip member that says its own compressed and full length ('sl' field, as the WARC guidelines have it)."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    length = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, length, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _clean(uri: str) -> str:
    """Control characters and outer white space cannot stand in a header; they are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]|^\s+|\s+$", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), uri)


def encode_record(page_id: int | None, kind: str, uri: str | None, refers_to: int | None, digest: str, length: int, payload: bytes | None) -> bytes:
    """One record; a revisit has the HTTP headers of what it revisits and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"") if kind == "response" else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{_URN}{page_id}>" if page_id is not None else f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {_DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
    ]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_clean(uri)}")
        if _clean(uri) != uri:
            # as it was, for our own reader; others pass over fields they do not know
            head.append(f"{_ORIGINAL}: {base64.b64encode(uri.encode('utf-8', 'surrogatepass')).decode()}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(rf"<?{_URN}(-?\d+)>?", urn or "")
    return int(m[1]) if m else None


def _hex(digest: str | None) -> str | None:
    """Lower-case hex of a sha1:... value in base 32 or hex; None for others."""
    kind, _, value = (digest or "").partition(":")
    if kind.lower() != "sha1":
        return None
    return value.lower() if re.fullmatch(r"[0-9a-fA-F]{40}", value) else base64.b32decode(value).hex()


class _Members:
    """The gzip members of a file: each is opened at its start, inflated as far as asked, and passed over."""

    def __init__(self, file, size: int):
        self.file, self.size, self.pos = file, size, 0

    def __iter__(self) -> Iterator[_Member]:
        while self.pos < self.size:
            m = _Member(self.file, self.pos)
            yield m
            self.pos = m.end()


class _Member:
    def __init__(self, file, start: int):
        self.file, self.start, self.length = file, start, None
        file.seek(start)
        first = file.read(4096)
        if first[:2] != b"\x1f\x8b":
            raise ValueError(f"no gzip member at byte {start}")
        if first[3] & 4:
            extra = first[12 : 12 + struct.unpack_from("<H", first, 10)[0]]
            while len(extra) >= 4:
                n = struct.unpack_from("<H", extra, 2)[0]
                if extra[:2] == b"sl" and n >= 4:
                    self.length = struct.unpack_from("<I", extra, 4)[0]
                extra = extra[4 + n :]
        self.z = zlib.decompressobj(31)
        self.read_to = start + len(first)
        self.out = self.z.decompress(first, 8192)

    def _more(self, limit: int) -> bool:
        if self.z.eof:
            return False
        data = self.z.unconsumed_tail
        if not data:
            self.file.seek(self.read_to)
            data = self.file.read(1 << 18)
            if not data:
                raise EOFError("a gzip member is cut off")
            self.read_to += len(data)
        self.out += self.z.decompress(data, limit)
        return True

    def head(self) -> tuple[dict[str, str], int]:
        """WARC headers and where the block begins."""
        while (i := self.out.find(b"\r\n\r\n")) < 0:
            if not self._more(8192):
                raise ValueError("a record without end of headers")
        return _headers(self.out[:i]), i + 4

    def upto(self, n: int) -> bytes:
        if len(self.out) < n:
            self.out = bytearray(self.out)
            while len(self.out) < n and self._more(1 << 20):
                pass
        return bytes(self.out[:n])

    def end(self) -> int:
        if self.length:
            return self.start + self.length
        while not self.z.eof:
            self.out = b""
            self._more(1 << 20)
        return self.read_to - len(self.z.unused_data)


@dataclass(frozen=True)
class _Files(InputPartition):
    paths: tuple[tuple[str, int], ...]


class WarcReader(DataSourceReader):
    """Options: path; payload (true or false: decode payloads); partitionBytes (files are packed up to so many bytes)."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.bytes = int(options.get("partitionbytes", 32 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list) -> Iterator:
        ops = {EqualTo: "eq", In: "in", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le"}
        for f in filters:
            if type(f) in ops and len(f.attribute) == 1 and f.attribute[0] in _HEADER_COLUMNS:
                self.tests.append((f.attribute[0], ops[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, path = _at(self.path)
        files = [x for x in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if x.type == pafs.FileType.File and re.search(r"\.warc(\.gz)?$", x.path)]
        out, group, total = [], [], 0
        for x in sorted(files, key=lambda x: x.path):
            if group and total + x.size > self.bytes:
                out.append(_Files(tuple(group)))
                group, total = [], 0
            group.append((x.path, x.size))
            total += x.size
        return [*out, _Files(tuple(group))] if group else out or [_Files(())]

    def _wanted(self, row: dict) -> bool:
        for name, op, value in self.tests:
            x = row[name]
            if x is None or not {"eq": lambda: x == value, "in": lambda: x in value, "gt": lambda: x > value, "ge": lambda: x >= value, "lt": lambda: x < value, "le": lambda: x <= value}[op]():
                return False
        return True

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _at(self.path)
        rows, held = [], 0
        for path, size in partition.paths:
            with fs.open_input_file(path) as file:
                for member in _Members(file, size):
                    row = self._record(member)
                    if row is None:
                        continue
                    rows.append(row)
                    held += 200 + len(row["payload"] or b"")
                    if held > _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    def _record(self, member: _Member) -> dict | None:
        head, begin = member.head()
        row = {
            "page_id": _page(head.get("warc-record-id")),
            "record_type": head.get("warc-type"),
            "target_uri": base64.b64decode(own).decode("utf-8", "surrogatepass") if (own := head.get(_ORIGINAL.lower())) else head.get("warc-target-uri"),
            "refers_to": _page(head.get("warc-refers-to")),
            "payload_digest": _hex(head.get("warc-payload-digest")),
            "payload_bytes": None,
            "payload": None,
        }
        # the payload's length stands in the block's HTTP headers, close behind; other predicates come first
        later = [t for t in self.tests if t[0] == "payload_bytes"]
        tests, self.tests = self.tests, [t for t in self.tests if t[0] != "payload_bytes"]
        try:
            if not self._wanted(row):
                return None
            size = int(head.get("content-length", 0))
            n = min(size, 2048)
            http = member.upto(begin + n)[begin:]
            i = http.find(b"\r\n\r\n") if "application/http" in head.get("content-type", "") else -4
            if i < 0 and i != -4 and size > n:
                http = member.upto(begin + size)[begin:]
                i = http.find(b"\r\n\r\n")
            inner = _headers(http[:i]) if i >= 0 else {}
            row["payload_bytes"] = int(inner["content-length"]) if inner.get("content-length", "").isdigit() else max(0, size - i - 4)
            self.tests = later
            if not self._wanted(row):
                return None
            if self.payload and row["record_type"] != "revisit":
                row["payload"] = member.upto(begin + size)[begin + i + 4 :]
            return row
        finally:
            self.tests = tests


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Tasks write under names of their own; the driver moves the files of committed tasks into place."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, path = _at(self.path)
        pending = f"{path}/_pending-{self.run}"
        files, out, size = [], None, 0
        for batch in iterator:
            for r in batch.to_pylist():
                if out is None:
                    fs.create_dir(pending, recursive=True)
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{pending}/{files[-1]}", compression=None), 0
                data = _member(encode_record(r["page_id"], r["record_type"], r["target_uri"], r["refers_to"], r["payload_digest"], r["payload_bytes"], r["payload"]))
                out.write(data)
                size += len(data)
                if size >= _ROLL_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return _Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, path = _at(self.path)
        fs.create_dir(path, recursive=True)
        if self.overwrite:
            for x in fs.get_file_info(pafs.FileSelector(path)):
                if x.type == pafs.FileType.File and x.path.endswith(".warc.gz"):
                    fs.delete_file(x.path)
        with ThreadPoolExecutor(32) as pool:
            files = [f for m in messages if m for f in m.files]
            list(pool.map(lambda f: fs.move(f"{path}/_pending-{self.run}/{f}", f"{path}/{f}"), files))
        self._clear(fs, path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_at(self.path))

    def _clear(self, fs: pafs.FileSystem, path: str) -> None:
        if fs.get_file_info(f"{path}/_pending-{self.run}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{path}/_pending-{self.run}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes format("warc") known and lets Spark hand predicates to Python readers."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def archive_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 1000) -> DataFrame:
    """The records to write, in the data source's columns.

    Of pages with equal payloads of at least min_bytes, those of the largest id are responses and the others
    revisit it; all others are responses. A null html is an empty payload; a page without an id revisits too,
    and if no page of its payload has an id, all are responses; repeated rows of the largest id are all responses.
    """
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload")).withColumns(
        {"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")}
    )
    # the first of each payload is found among narrow rows; the payloads themselves move only if there are many repeats
    lead = rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("lead"), F.count(F.lit(1)).alias("n"))
    lead = reliable_checkpoint(lead.filter("n > 1 AND lead IS NOT NULL").select(F.col("payload_digest").alias("lead_digest"), "lead"))
    many = lead.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS
    joined = rows.join(lead if many else F.broadcast(lead), F.col("payload_digest") == F.col("lead_digest"), "left")
    revisit = F.col("lead").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("lead"))
    return joined.select(
        "page_id",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        "target_uri",
        F.when(revisit, F.col("lead")).alias("refers_to"),
        "payload_digest",
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_warc(records: DataFrame, path: str) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").option("path", path).save()


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", path: str | None = None) -> DataFrame:
    """Archives ``pages`` and reads the archives back: (id, payload_bytes, payload_digest, record_type, refers_to, target_uri).

    A response's digest and length are computed from the payload as read; a revisit's are those its headers tell,
    and of revisits nothing but headers is decoded. Edge cases as in :func:`archive_records`.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(archive_records(pages, id_col, url_col, html_col), path)
    full = read_warc(spark, path).filter(F.col("record_type") == "response")
    full = full.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    bare = read_warc(spark, path, payload=False).filter(F.col("record_type") == "revisit")
    columns = [F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"]
    return full.select(*columns).union(bare.select(*columns))
