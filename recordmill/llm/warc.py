"""WARC archives as a Python data source, with revisit records for repeated payloads (operator 7).

Files hold one gzip member per record; the member's extra field ``sl`` tells its compressed and plain
length, so a reader can go from record to record without reading or inflating them. Members without it are inflated one by one. The reader plans one
partition per file (large tables have many files), takes over equality and membership tests on the
record type and other header columns, inflates the headers of a record first, and leaves its payload alone if the tests
fail or the option ``payload`` is ``false``.
"""

from __future__ import annotations

import base64
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage,
)

SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, date string, "
    "payload_digest string, payload_bytes bigint, payload binary"
)
#: Columns whose tests the reader takes over, and their header fields.
HEADERS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri",
    "refers_to": "warc-refers-to", "date": "warc-date",
}
_HEAD = struct.Struct("<4sIBBH2sHII")
_LEVEL = 4


def member(plain: bytes) -> bytes:
    """A gzip member that tells its own length."""
    deflate = zlib.compressobj(_LEVEL, zlib.DEFLATED, -15)
    body = deflate.compress(plain) + deflate.flush()
    size = _HEAD.size + len(body) + 8
    head = _HEAD.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, 12, b"sl", 8, size, len(plain) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def _field(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(kind: str, record_id: str, uri: str | None, date: str, digest: str, size: int, payload: bytes | None, refers_to: str | None) -> bytes:
    """One WARC record of an HTTP response; a revisit has the HTTP header but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_field(record_id)}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_field(uri)}")
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: <{_field(refers_to)}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs if k}


@dataclass
class _File(InputPartition):
    uri: str


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.with_payload = options["path"], options.get("payload", "true").lower() != "false"
        self.tests: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.tests.append((f.attribute[0], frozenset([f.value])))
            elif isinstance(f, In) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.tests.append((f.attribute[0], frozenset(f.value)))
            else:
                yield f

    def partitions(self) -> list[_File]:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        base = self.path[: len(self.path.rstrip("/")) - len(root.rstrip("/"))]
        found = fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True))
        return [_File(base + f.path) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".warc.gz")] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.uri:
            return
        fs, name = pyarrow.fs.FileSystem.from_uri(partition.uri)
        with fs.open_input_file(name) as source:
            size = source.size()
            while (at := source.tell()) < size:
                try:
                    row = self._next(source, at, size)
                except (zlib.error, struct.error, ValueError, KeyError, UnicodeDecodeError) as wrong:
                    raise ValueError(f"{partition.uri}: no whole record at byte {at}: {wrong}") from wrong
                if row is not None:
                    yield row

    def _next(self, source, at: int, size: int) -> tuple | None:
        """The record that begins at ``at``, or None if the tests rule it out; leaves ``source`` at the next one."""
        head = source.read(_HEAD.size)
        fixed = _HEAD.unpack(head) if len(head) == _HEAD.size else (b"",) * 9
        if fixed[0] == b"\x1f\x8b\x08\x04" and fixed[5:7] == (b"sl", 8):
            end = at + fixed[7]
            if end > size:
                raise ValueError("the file ends inside it")
            row = self._row(_Member(source, end, fixed[8]))
            source.seek(end)
            return row
        # a plain member ends where its data do, so it is inflated
        source.seek(at)
        inflate, out, rest = zlib.decompressobj(31), [], b""
        while not inflate.eof:
            rest = source.read(1 << 16)
            if not rest:
                raise ValueError("the file ends inside it")
            out.append(inflate.decompress(rest))
        source.seek(source.tell() - len(inflate.unused_data))
        return self._row(_Whole(b"".join(out)))

    def _row(self, member) -> tuple | None:
        cut = member.find(b"\r\n\r\n", 0)
        held = _headers(member.raw[:cut])
        row = {c: held[h].strip("<>") if h.endswith(("-id", "refers-to")) else held[h] for c, h in HEADERS.items() if h in held}
        if any(row.get(c) not in wanted for c, wanted in self.tests):
            return None
        length = int(held["content-length"])
        http = held.get("content-type", "").startswith("application/http") and length > 0
        end = member.find(b"\r\n\r\n", cut + 4) if http else cut
        fields = _headers(member.raw[cut + 4 : end]) if http else {}
        size = length - (end - cut) if http else length
        if row.get("record_type") == "revisit":
            size = int(fields.get("content-length", size))
        payload = None
        if self.with_payload and row.get("record_type") != "revisit":
            raw = member.whole()
            payload = raw[end + 4 : cut + 4 + length]
            if len(payload) != size:
                raise ValueError("its content is shorter than its header says")
        digest = held.get("warc-payload-digest", "").removeprefix("sha1:") or None
        return (*(row.get(c) for c in HEADERS), digest, size, payload)


class _Whole:
    """An inflated record."""

    def __init__(self, raw: bytes):
        self.raw = raw

    def find(self, what: bytes, start: int) -> int:
        at = self.raw.find(what, start)
        if at < 0:
            raise ValueError("it has no end of headers")
        return at

    def whole(self) -> bytes:
        return self.raw


class _Member(_Whole):
    """A record that is read and inflated as far as it is asked for."""

    STEP = 4096

    def __init__(self, source, end: int, size: int):
        super().__init__(b"")
        self.source, self.end, self.size, self.inflate, self.rest = source, end, size, zlib.decompressobj(-15), b""

    def _more(self) -> bool:
        """Inflate one step more; false at the end of the data."""
        while not self.inflate.eof:
            data = self.rest or self.source.read(min(self.STEP, self.end - 8 - self.source.tell()))
            if not data:
                return False
            out = self.inflate.decompress(data, self.STEP)
            self.rest = self.inflate.unconsumed_tail
            self.raw += out
            if out:
                return True
        return False

    def find(self, what: bytes, start: int) -> int:
        while (at := self.raw.find(what, start)) < 0:
            if not self._more():
                raise ValueError("it has no end of headers")
        return at

    def whole(self) -> bytes:
        parts = [self.raw, self.inflate.decompress(self.rest + self.source.read(self.end - 8 - self.source.tell()))]
        parts.append(self.inflate.flush())
        raw = b"".join(parts)
        crc, size = struct.unpack("<II", self.source.read(8))
        if not self.inflate.eof or zlib.crc32(raw) != crc or len(raw) & 0xFFFFFFFF != size:
            raise ValueError("its data do not agree with its checksum")
        return raw


@dataclass
class _Written(WriterCommitMessage):
    uri: str


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of ``SCHEMA``; ``payload`` is null for revisits, whose ``payload_bytes`` is given."""

    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        uri = f"{self.path.rstrip('/')}/{uuid.uuid4().hex}.warc.gz.part"
        fs, name = pyarrow.fs.FileSystem.from_uri(uri)
        fs.create_dir(name.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(name, compression=None, buffer_size=1 << 20) as out:
            for batch in iterator:
                for r in batch.to_pylist():
                    out.write(member(record(
                        r["record_type"], r["record_id"], r["target_uri"], r["date"], r["payload_digest"], r["payload_bytes"], r["payload"], r["refers_to"]
                    )))
        return _Written(uri)

    def commit(self, messages: list[_Written | None]) -> None:
        # files of attempts that did not succeed keep their name and are not read
        for m in messages:
            if m is not None:
                fs, name = pyarrow.fs.FileSystem.from_uri(m.uri)
                fs.move(name, name.removesuffix(".part"))

    def abort(self, messages: list[_Written | None]) -> None:
        pass


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the format ``warc`` known to the session, with filters handed to its reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def base32_digest(hex_digest: Column) -> Column:
    """Upper-case base32 of a hexadecimal SHA-1."""
    groups = [F.conv(F.substring(hex_digest, 1 + 5 * i, 5), 16, 10).cast("int") for i in range(8)]
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return F.concat(*[
        F.substring(letters, F.shiftright(g, 15 - 5 * k).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for g in groups for k in range(4)
    ])


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> None:
    """Archive every row below ``path``, payload the body in UTF-8 (null: empty).

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the largest id is a
    response and the others revisit it; all other rows are responses, also rows with a null id
    and rows that repeat the id of the response. Other columns are ignored.
    """
    body = F.coalesce(F.col(body_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), body.alias("body"),
        F.sha1(body.cast("binary")).alias("sha"), F.octet_length(body).cast("bigint").alias("size"),
    )
    slim = rows.select("id", "sha", "size")
    best = slim.where(F.col("size") >= min_bytes).groupBy("sha").agg(F.max("id").alias("best"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = slim.join(best, "sha").where("id <> best").select("id", "sha", "best").distinct()
    joined = rows.join(again, ["id", "sha"], "left")
    revisit = F.col("best").isNotNull()
    name = F.concat(F.lit("urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("none")))
    joined.select(
        name.alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(revisit, F.concat(F.lit("urn:page:"), F.col("best").cast("string"))).alias("refers_to"),
        F.lit(date).alias("date"),
        base32_digest(F.col("sha")).alias("payload_digest"),
        F.col("size").alias("payload_bytes"),
        F.when(~revisit, F.col("body").cast("binary")).alias("payload"),
    ).write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of all ``*.warc.gz`` files below ``path``, columns of ``SCHEMA``.

    ``payload`` is null for revisits, and everywhere if it is not asked for; then only headers are inflated. Files of
    other writers are read too, member by member. A damaged record is an error that names its file and byte. A folder
    without files gives no rows.
    """
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
