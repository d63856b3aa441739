"""WARC archives as a Spark data source: `spark.read.format("warc")` and `df.write.format("warc")`.

Reading plans partitions over the files: a compressed file, whose records are gzip members of their own, is cut into ranges
of SPLIT_BYTES, and a task reads the records that begin in its range; a plain file is read by one task, since only its headers tell a
record's start from a payload that looks like one. A record's WARC header is parsed first. Filters on the record type and
on headers are pushed down and decided there; what they reject is not inflated further and, where the member tells its own
length (the writer's do, in the gzip field "sl"), not even read. Payloads are only built if the option `payload` asks for them.

Writing: each task rolls files of FILE_BYTES; a commit lists the files of all tasks that ended well, and readers of a folder
with commits read what they list, so lost or repeated tasks leave nothing behind that counts. An overwriting commit hides the ones
before it. Folders without commits are read whole.

archive_pages() writes a record a page. Of pages with equal payloads of min_bytes or more, that with the smallest page_id is
the response and others revisit it; smaller ones are all responses. Payloads are compared by SHA-1, as archives do.

Null html is an empty payload. Null page_ids come after all others. Rows that repeat both page_id and payload tie for the smallest, and
all of them are responses. Null urls give records without a target. Control characters, blanks and non-ASCII characters of a header's
value are percent-encoded. Columns beyond page_id, url and html are not written. An empty table gives an archive without records.
Reading an archive that ends within a record, or a response whose payload differs from its digest, raises.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import time
import uuid
import zlib
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ARROW_BYTES, new_path, stored, tune

SPLIT_BYTES = 64 << 20
FILE_BYTES = 256 << 20
READ_BYTES = 1 << 20
#: Rows of one batch that the reader yields.
BATCH_ROWS = 1000

#: Header names and the revisit profile of WARC 1.1.
COLUMNS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "date": "WARC-Date",
    "target_uri": "WARC-Target-URI",
    "content_type": "Content-Type",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Columns that the writer takes.
WRITTEN = T.StructType().add("record_id", "string").add("record_type", "string").add("target_uri", "string").add("refers_to", "string").add("payload_digest", "string").add("payload_length", "long").add("payload", "binary")


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path if urlsplit(path).scheme else f"file://{path}")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _value(text: str) -> str:
    return quote(text, safe="%!#$&'()*+,/:;=?@[]~-._<>{}|^`\"\\")


def record_bytes(record: dict, date: str) -> bytes:
    """A record as one gzip member that tells its own length."""
    payload = record["payload"] or b""
    revisit = record["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {record['payload_length']}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {record['record_type']}", f"WARC-Record-ID: <{_value(record['record_id'])}>", f"WARC-Date: {date}"]
    if record["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_value(record['target_uri'])}")
    lines.append(f"WARC-Payload-Digest: sha1:{record['payload_digest']}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_value(record['refers_to'])}>"]
    block = http if revisit else http + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return member("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def member(data: bytes) -> bytes:
    """data as a gzip member whose extra field "sl" holds the lengths of the member and of the data (modulo 2**32)."""
    raw = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = raw.compress(data) + raw.flush()
    whole = 24 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, whole & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Range(D.InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Written(D.WriterCommitMessage):
    files: list[str]
    records: int


class _Plain:
    """Bytes of an open file from a place on; skipped bytes outside the buffer are not read."""

    def __init__(self, file, at: int):
        self.file, self.at, self.buffer = file, at, b""
        file.seek(at)

    def fill(self, n: int) -> bool:
        """At least n bytes in the buffer, if the file has them."""
        while len(self.buffer) < n:
            more = self.file.read(max(READ_BYTES, n - len(self.buffer)))
            if not more:
                return False
            self.buffer += more
        return True

    def take(self, n: int) -> bytes:
        self.fill(n)
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        self.at += len(out)
        return out

    def skip(self, n: int) -> None:
        self.at += n
        if n <= len(self.buffer):
            self.buffer = self.buffer[n:]
        else:
            self.buffer = b""
            self.file.seek(self.at)


class _Inflated:
    """The data of the gzip member at a stream's place."""

    def __init__(self, raw: _Plain):
        self.raw, self.begin, self.buffer = raw, raw.at, b""
        self.inflate = zlib.decompressobj(31)
        raw.fill(24)
        head = raw.buffer[:24]
        own = len(head) == 24 and head[3] == 4 and head[10:16] == b"\x0c\0sl\x08\0"
        self.length = struct.unpack("<I", head[16:20])[0] if own else 0

    def fill(self, n: int) -> bool:
        while len(self.buffer) < n and not self.inflate.eof:
            data = self.inflate.unconsumed_tail or self.raw.take(1 << 14)
            more = self.inflate.decompress(data, max(1 << 12, n - len(self.buffer)))  # without data: what it still holds
            if not data and not more and not self.inflate.eof:
                raise ValueError("the archive ends within a record")
            self.buffer += more
            if self.inflate.eof and self.inflate.unused_data:
                self.raw.buffer = self.inflate.unused_data + self.raw.buffer
                self.raw.at -= len(self.inflate.unused_data)
        return len(self.buffer) >= n

    def take(self, n: int) -> bytes:
        self.fill(n)
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        return out

    def skip(self, n: int) -> None:
        while n and self.fill(1):
            n -= len(self.take(min(n, len(self.buffer))))

    def leave(self) -> None:
        """Go behind the member; without inflating, if it tells its length."""
        if self.length and not self.inflate.eof:
            target = self.begin + self.length
            if target >= self.raw.at:
                self.raw.skip(target - self.raw.at)
            else:
                self.raw.at, self.raw.buffer = target, b""
                self.raw.file.seek(target)
            return
        while self.fill(1):
            self.buffer = b""


def _header(stream) -> dict[str, str] | None:
    """The WARC header at a stream's place, names in lower case; None at the end."""
    size = 1 << 12
    while (stream.fill(2) or stream.buffer) and stream.buffer[:1] in (b"\r", b"\n"):
        stream.take(1)
    if not stream.fill(1):
        return None
    while True:
        whole = stream.fill(size)
        if (end := re.search(rb"\r?\n\r?\n", stream.buffer)) or not whole:
            break
        size *= 2
    if not end or not stream.buffer.startswith(b"WARC/"):
        raise ValueError("no WARC record here, or the archive ends within one")
    lines = re.sub(r"\r?\n[ \t]+", " ", stream.take(end.end()).decode("utf-8", "replace")).splitlines()
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


class _Condition:
    """A pushed filter as a predicate on a record's columns: True, False, or None for unknown."""

    COMPARE = {
        D.EqualTo: lambda x, y: x == y,
        D.GreaterThan: lambda x, y: x > y,
        D.GreaterThanOrEqual: lambda x, y: x >= y,
        D.LessThan: lambda x, y: x < y,
        D.LessThanOrEqual: lambda x, y: x <= y,
        D.In: lambda x, y: x in y,
        D.StringStartsWith: lambda x, y: x.startswith(y),
        D.StringEndsWith: lambda x, y: x.endswith(y),
        D.StringContains: lambda x, y: y in x,
    }

    @classmethod
    def make(cls, f: D.Filter, known: set[str]) -> Callable[[dict], bool | None] | None:
        if isinstance(f, D.Not):
            inner = cls.make(f.child, known)
            return inner and (lambda r: None if (x := inner(r)) is None else not x)
        column = f.attribute[0]
        if len(f.attribute) != 1 or column not in known:
            return None
        if isinstance(f, D.IsNull):
            return lambda r: r[column] is None
        if isinstance(f, D.IsNotNull):
            return lambda r: r[column] is not None
        if isinstance(f, D.EqualNullSafe):
            return lambda r: r[column] == f.value
        # strings in Spark's order of bytes, which for UTF-8 is the order of code points
        compare = cls.COMPARE.get(type(f))
        return compare and (lambda r: None if r[column] is None else compare(r[column], f.value))


class WarcReader(D.DataSourceReader):
    def __init__(self, schema: T.StructType, options: Mapping[str, str]):
        self.schema, self.path = schema, options["path"]
        self.payload = options.get("payload", "true") == "true"
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.headers = _header_columns(options)
        self.filters: list[D.Filter] = []

    def _known(self) -> set[str]:
        return {*COLUMNS, *self.headers, "content_length"}

    def pushFilters(self, filters):
        for f in filters:
            if _Condition.make(f, self._known()):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        files = list(archive_files(self.path))
        out = []
        for path, size in files:
            step = self.split if path.endswith(".gz") else max(size, 1)
            out += [Range(path, at, min(at + step, size)) for at in range(0, size, step)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        conditions = [_Condition.make(f, self._known()) for f in self.filters]
        schema = _arrow_schema(self.schema)
        rows, held = [], 0
        for row in self._records(part, conditions):
            rows.append(row)
            held += len(row["payload"] or b"") + 500
            if len(rows) >= BATCH_ROWS or held >= ARROW_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def _records(self, part: Range, conditions: list) -> Iterator[dict]:
        system, path = _filesystem(part.path)
        with system.open_input_file(path) as file:
            raw = _Plain(file, part.start)
            packed = raw.fill(2) and (part.start > 0 or raw.buffer[:2] == b"\x1f\x8b")
            if part.start > 0 and not _seek_record(raw, part.end):
                return
            while raw.at < part.end and raw.fill(1):
                stream = _Inflated(raw) if packed else raw
                while (head := _header(stream)) is not None:
                    length = int(head["content-length"])
                    row = {c: head.get(n.lower()) for c, n in {**COLUMNS, **self.headers}.items()} | {"content_length": length}
                    if row["record_id"] is not None:
                        row["record_id"] = row["record_id"].strip("<>")
                    if row["refers_to"] is not None:
                        row["refers_to"] = row["refers_to"].strip("<>")
                    if row["payload_digest"] is not None:
                        row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
                    if all(c(row) is True for c in conditions):
                        yield row | self._block(stream, head, row, length)
                    elif packed and stream.length:
                        break
                    else:
                        stream.skip(length)
                if packed:
                    stream.leave()
                else:
                    return

    def _block(self, stream, head: dict, row: dict, length: int) -> dict:
        """payload_length and payload of the record whose header was read; the stream is behind its block afterwards."""
        http = (row["content_type"] or "").startswith("application/http")
        if not http:
            body = stream.take(length) if self.payload else stream.skip(length)
            return {"payload_length": length, "payload": body, "headers": head}
        size, end = 1 << 12, None
        while not end and size < 2 * max(length, 1 << 12):
            stream.fill(min(size, length))
            end = re.search(rb"\r?\n\r?\n", stream.buffer[:length])
            size *= 2
        top = stream.take(end.end() if end else length)
        stated = re.search(rb"(?im)^content-length:[ \t]*(\d+)", top)
        rest, body = length - len(top), None
        revisit = row["record_type"] == "revisit"
        if self.payload and not revisit:
            body = stream.take(rest)
            if len(body) < rest:
                raise ValueError("the archive ends within a record")
            if row["payload_digest"] and base32_sha1(body) != row["payload_digest"]:
                raise ValueError(f"payload of {row['record_id']} differs from its digest")
        else:
            stream.skip(rest)
        return {"payload_length": int(stated[1]) if revisit and stated else rest, "payload": body, "headers": head}


def _seek_record(raw: _Plain, end: int) -> bool:
    """Go to the first gzip member that begins before `end` and holds a WARC record."""
    while raw.at < end:
        if not raw.fill(1 << 12) and len(raw.buffer) < 18:
            return False
        at = raw.buffer.find(b"\x1f\x8b\x08")
        if at < 0:
            raw.skip(len(raw.buffer) - 2)
            continue
        raw.skip(at)
        raw.fill(1 << 12)
        try:
            if raw.at < end and zlib.decompressobj(31).decompress(raw.buffer[: 1 << 12], 8).startswith(b"WARC/"):
                return True
        except zlib.error:
            pass
        raw.skip(1)
    return False


def archive_files(path: str) -> Iterator[tuple[str, int]]:
    """(URI, size) of the archives at a path: one file, what a folder's commits list, or all of a folder without commits."""
    system, inner = _filesystem(path)
    base = path.rstrip("/")
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        yield path, info.size
        return
    found = {f.base_name: f.size for f in system.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File}
    commits = sorted(n for n in found if n.startswith("_commit-"))
    names = {n for n in found if re.search(r"\.warc(\.gz)?$", n)}
    if commits:
        listed: set[str] = set()
        for c in commits:
            with system.open_input_stream(f"{inner}/{c}") as f:
                commit = json.loads(f.read())
            listed = set(commit["files"]) | (set() if commit["overwrite"] else listed)
        if lost := listed - names:
            raise FileNotFoundError(f"{base}: committed archives are missing: {sorted(lost)[:3]}")
        names = listed
    for name in sorted(names):
        yield f"{base}/{name}", found[name]


class WarcWriter(D.DataSourceArrowWriter):
    def __init__(self, options: Mapping[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.file_bytes = int(options.get("fileBytes", FILE_BYTES))
        self.date = options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, inner = _filesystem(self.path)
        system.create_dir(inner, recursive=True)
        files, records, out, size = [], 0, None, 0
        try:
            for batch in iterator:
                for k in range(batch.num_rows):
                    if out is None or size >= self.file_bytes:
                        if out is not None:
                            out.close()
                        files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out = system.open_output_stream(f"{inner}/{files[-1]}", compression=None)
                        size = out.write(self._info(files[-1]))
                    size += out.write(record_bytes({c: batch.column(c)[k].as_py() for c in WRITTEN.names}, self.date))
                    records += 1
        finally:
            if out is not None:
                out.close()
        return Written(files, records)

    def _info(self, name: str) -> bytes:
        block = b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"
        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:{name}>\r\nWARC-Date: {self.date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
        return member(head.encode() + block + b"\r\n\r\n")

    def commit(self, messages) -> None:
        system, inner = _filesystem(self.path)
        system.create_dir(inner, recursive=True)
        files = [f for m in messages if m for f in m.files]
        # a name that holds no commit while it is written
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.json"
        with system.open_output_stream(f"{inner}/_new-{name}") as out:
            out.write(json.dumps({"overwrite": self.overwrite, "files": files, "records": sum(m.records for m in messages if m)}).encode())
        system.move(f"{inner}/_new-{name}", f"{inner}/_commit-{name}")

    def abort(self, messages) -> None:
        system, inner = _filesystem(self.path)
        for m in messages:
            for f in m.files if m else ():
                system.delete_file(f"{inner}/{f}")


def _header_columns(options: Mapping[str, str]) -> dict[str, str]:
    """Further headers as columns of their own: option headerColumns, names parted by commas; "-" becomes "_" in the column's name."""
    names = [n.strip() for n in options.get("headerColumns", "").split(",") if n.strip()]
    return {n.lower().replace("-", "_"): n for n in names}


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(f.name, kinds.get(f.dataType.typeName(), pa.map_(pa.string(), pa.string()))) for f in schema])


class WarcSource(D.DataSource):
    """Options: path, payload (true), splitBytes, headerColumns; for writing fileBytes and date."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        out = T.StructType()
        for c in (*COLUMNS, *_header_columns(self.options)):
            out.add(c, "string")
        return out.add("content_length", "long").add("payload_length", "long").add("payload", "binary").add("headers", T.MapType(T.StringType(), T.StringType()))

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let Spark push filters into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_archives(spark: SparkSession, path: str, payload: bool = True, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(payload=str(payload).lower(), **options).load(path)


def page_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The records of pages: page_id, url, payload (null for revisits), payload_length, sha1 (hex), record_type, first_id."""
    payload = F.coalesce(F.encode(F.col("html"), "utf-8"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"payload_length": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")})
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"))
    firsts = rows.filter(F.col("payload_length") >= min_bytes).groupBy("sha1").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = stored(firsts.filter("n > 1").select(F.col("sha1").alias("_sha1"), F.col("first.id").alias("first_id")), "repeated-payloads")
    met = rows.join(firsts, rows["sha1"] == firsts["_sha1"], "left").drop("_sha1")
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    return met.select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_length", "sha1", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("first_id")
    )


def _base32(sha1: Column) -> Column:
    """Bare upper-case base32 of a SHA-1 in hex: five hex digits are four letters."""
    part = lambda i: F.conv(F.substring(sha1, 5 * i + 1, 5), 16, 10).cast("int")
    letter = lambda n, k: F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.shiftright(n, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*(letter(part(i), k) for i in range(8) for k in range(4)))


def archive_pages(pages: DataFrame, path: str | None = None, min_bytes: int = 0, **options: str) -> str:
    """Write a record a page; the folder."""
    spark = tune(pages.sparkSession)
    path = path or new_path(spark, "warc")
    register(spark)
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows = page_records(pages, min_bytes)
    refers = F.when(F.col("record_type") == "revisit", urn("first_id"))
    out = rows.select(urn("page_id").alias("record_id"), "record_type", F.col("url").cast("string").alias("target_uri"), refers.alias("refers_to"), _base32(F.col("sha1")).alias("payload_digest"), "payload_length", "payload")
    out.write.format("warc").options(**options).mode("append").save(path)
    return path


def read_pages(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of archived pages. A response's length is that of the
    payload read, whose digest the reader has verified; a revisit has what its headers say of the payload it stands for."""
    rows = read_archives(spark, path).filter(F.col("record_type").isin("response", "revisit") & F.col("record_id").startswith("urn:page:"))
    own = lambda c: F.nullif(F.substring(F.col(c), len("urn:page:") + 1, 1 << 20), F.lit("")).cast(id_type)
    size = F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_length"))
    return rows.select(own("record_id").alias("page_id"), F.col("target_uri").alias("url"), "payload", size.alias("payload_bytes"), "payload_digest", "record_type", own("refers_to").alias("refers_to"))
