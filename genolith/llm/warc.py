"""Legacy archives to WARC.

ARC files begin with a version block (``filedesc:``), which says by which fields the header lines of all records are to be read. Each record is
taken by its header line and declared length; identifiers, timestamps, types and digests of WARC 1.1 are synthesised from it: identifiers from file and
offset, so that a conversion done again gives the same ones. Of records with equal payloads one is written in full, the others as
revisits of it.

Both formats are files that Spark's text source and sink read and write. Files are gzip, so one task reads a file from its start. The readers
join what the text source splits and take each record by its declared length, so payloads may hold any separators; what they do grows
in proportion to a file's length.

Cases of ``archived``: null html is an empty payload; null url is written as ``urn:page:<id>``; white space in urls is
percent-encoded; payloads of less than ``min_bytes`` bytes are all responses; rows that repeat the response's page_id
are responses too; a null page_id counts as least; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import broadcast_if_small, release, removed, shared_path, small_batches, until_exit, written

END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The fields of an ARC header line, by version, as version blocks name them.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length".split(),
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length".split(),
}
#: How archives are compressed: at this level of the archives' gzip, writing is not what takes most of the time.
GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
#: Namespace of the record ids.
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-record")


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_line(version: int, url: str, when: str, length: int, ip: str = "0.0.0.0", status: int = 200, checksum: str = "-", mime: str = "text/html", offset: int = 0, file: str = "pages.arc") -> bytes:
    """The header line of an ARC record."""
    middle = f"{status} {checksum} - {offset} {file} " if version == 2 else ""
    return f"{url} {ip} {when} {mime} {middle}{length}\n".encode()


def version_block(version: int, when: str, file: str = "pages.arc") -> bytes:
    """What an ARC file begins with."""
    block = f"{version} 0 genolith\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return arc_line(version, f"filedesc://{file}", when, len(block), mime="text/plain", file=file) + block + b"\n"


def arc_record(version: int, url: str, when: str, payload: bytes, key: int | None = None, offset: int = 0, file: str = "pages.arc") -> bytes:
    """An ARC record: header line, HTTP response (which names the page it is of, if ``key`` does), line feed."""
    page = "" if key is None else f"X-Page-Id: {key}\r\n"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n{page}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    return arc_line(version, url, when, len(block), checksum=sha1(payload), offset=offset, file=file) + block + b"\n"


@dataclass
class Record:
    """A record of an ARC file; block is the HTTP response, or the content itself."""

    offset: int
    url: str
    ip: str
    date: str
    mime: str
    block: bytes

    @property
    def http(self) -> bool:
        return self.block.startswith(b"HTTP/")

    @property
    def head(self) -> bytes:
        return self.block[: -len(self.payload) or None] if self.http else b""

    @property
    def payload(self) -> bytes:
        return self.block.partition(END)[2] if self.http else self.block

    @property
    def page(self) -> int | None:
        found = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", self.head)
        return int(found[1]) if found else None


class Reader:
    """Takes a file piece by piece and gives its records as soon as they are whole."""

    def __init__(self) -> None:
        self.buffer, self.offset, self.need, self.scanned = bytearray(), 0, 1, 0

    def line_end(self, mark: bytes) -> int:
        """Where ``mark`` stands in the buffer, or -1; what was looked at before isn't looked at again."""
        at = self.buffer.find(mark, max(0, self.scanned - len(mark)))
        self.scanned = len(self.buffer) if at < 0 else at
        return at

    def drop(self, n: int) -> None:
        del self.buffer[:n]
        self.offset, self.need, self.scanned = self.offset + n, 1, 0

    def close(self) -> None:
        """Ends a file. The text source doesn't tell whether a file ends in its separator, which may be left over."""
        if self.buffer.strip(b"\r\n"):
            raise ValueError(f"the archive is cut short at byte {self.offset}")
        self.__init__()


class ArcReader(Reader):
    """The records of ARC files of either version, without version blocks. Raises ValueError where a file has no version block, or a record no
    header line of its version."""

    def __init__(self) -> None:
        super().__init__()
        self.version: int | None = None

    def take(self, piece: bytes) -> Iterator[Record]:
        self.buffer += piece
        while len(self.buffer) >= self.need:
            if (end := self.line_end(b"\n")) < 0:
                return
            if not self.buffer[: end + 1].strip(b"\r\n"):  # the line feed that ends a record
                self.drop(end + 1)
                continue
            fields = self.buffer[:end].decode().split(" ")
            wanted = ARC_FIELDS.get(self.version or len(fields) // 5, [])
            if not re.fullmatch(r"\d+", fields[-1]) or len(fields) != len(wanted) or not re.fullmatch(r"\d{14}", fields[2]):
                raise ValueError(f"no ARC header line at byte {self.offset}")
            self.need = end + 1 + int(fields[-1])
            if len(self.buffer) < self.need:
                return
            record = Record(self.offset, fields[0], fields[1], fields[2], fields[3], bytes(self.buffer[end + 1 : self.need]))
            if self.version is None:
                self.version = self._version(record)
            elif not record.url.startswith("filedesc:"):
                yield record
            self.drop(self.need)

    def _version(self, record: Record) -> int:
        first, _, names = record.block.decode("ascii", "replace").partition("\n")
        version = int(first[:1]) if first[:1].isdigit() else 0
        if not record.url.startswith("filedesc:") or names.strip().split(" ") != ARC_FIELDS.get(version):
            raise ValueError("the archive doesn't begin with a version block of ARC 1 or 2")
        return version


def parse_arc(data: bytes) -> Iterator[Record]:
    """The records of an ARC file that is at hand as a whole."""
    reader = ArcReader()
    yield from reader.take(data)
    reader.close()


def record_id(file: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{file}#{offset}')}>"


def warc_date(arc_date: str) -> str:
    return datetime.strptime(arc_date, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def warc_record(r: Record, file: str, refers: tuple[str, int, str, str] | None = None) -> bytes:
    """The WARC record of an ARC record of ``file``, without its last CR LF CR LF. ``refers``: file, offset, url and ARC date of the record
    with the same payload that it revisits."""
    block = r.block if refers is None else r.head
    kind = "revisit" if refers is not None else "response" if r.http else "resource"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(file, r.offset)), ("WARC-Date", warc_date(r.date)), ("WARC-Target-URI", r.url), ("WARC-IP-Address", r.ip)]
    fields += [("WARC-Payload-Digest", f"sha1:{sha1(r.payload)}"), ("WARC-Block-Digest", f"sha1:{sha1(block)}")]
    if refers is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(*refers[:2])), ("WARC-Refers-To-Target-URI", refers[2]), ("WARC-Refers-To-Date", warc_date(refers[3]))]
    fields += [("Content-Type", "application/http; msgtype=response" if r.http else r.mime), ("Content-Length", len(block))]
    return ("WARC/1.1\r\n" + "\r\n".join(f"{k}: {v}" for k, v in fields)).encode() + END + block


class WarcReader(Reader):
    """(fields, block) of each record of WARC files."""

    def take(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.buffer += piece
        while len(self.buffer) >= self.need:
            if self.buffer[:2] == b"\r\n":  # the end of the record before
                self.drop(2)
                continue
            if (head := self.line_end(END)) < 0:
                return
            lines = self.buffer[:head].decode().split("\r\n")
            if not lines[0].startswith("WARC/1."):
                raise ValueError(f"no WARC record at byte {self.offset}")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            self.need = head + 4 + int(fields["Content-Length"])
            if len(self.buffer) < self.need:
                self.scanned = head
                return
            yield fields, bytes(self.buffer[head + 4 : self.need])
            self.drop(self.need)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): the files at ``path``, cut at END, which goes; the pieces of a file are in one partition and in order."""
    lines = spark.read.option("lineSep", END.decode()).schema("value string").text(path)
    return lines.select(F.input_file_name().alias("file"), F.col("value").cast("binary").alias("value"))


def _records(batches: Iterator[pa.RecordBatch], reader: ArcReader | WarcReader) -> Iterator[tuple[str, object]]:
    """(name of the file, record) of all pieces."""
    file = None
    for batch in batches:
        for name, piece in zip(batch.column(0).to_pylist(), batch.column(1)):
            if name != file:
                reader.close()
                file = name
            for record in reader.take(piece.as_py() + END):
                yield name.rsplit("/", 1)[-1], record
    reader.close()


def _batches(rows: Iterator[dict], schema: pa.Schema, size: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """``rows`` in batches of about ``most`` bytes of their column ``size``."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += 256 + len(row[size] or b"")
        if n >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def write_legacy(pages: DataFrame, path: str) -> None:
    """ARC files of all pages (page_id, url, html) in the folder ``path``, one for each partition, of version 1 or 2 by turns. Dates follow
    the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, file = 1 + part % 2, f"pages-{part:05d}.arc"
        first = version_block(version, "20000101000000", file)
        offset, out = len(first), [first[:-1]]
        for batch in batches:
            for key, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                when = (datetime(2000, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=(key or 0) % (20 * 365 * 86400))).strftime("%Y%m%d%H%M%S")
                target = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), url) if url else f"urn:page:{key}"
                record = arc_record(version, target, when, (html or "").encode(), key, offset, file)
                offset += len(record)
                out.append(record[:-1])  # the sink ends lines
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
            out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
        release()

    rows = pages.select(F.col("page_id").cast("long").alias("id"), "url", "html")
    with small_batches(pages.sparkSession):
        rows.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.options(lineSep="\n", **GZIP).text(path)


_ARC_ROW = {"file": pa.string(), "at": pa.int64(), "page_id": pa.int64(), "url": pa.string(), "ip": pa.string(), "date": pa.string(), "mime": pa.string(), "http": pa.bool_(), "digest": pa.string(), "bytes": pa.int64(), "block": pa.binary()}


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    """The records of the ARC files at ``path``: file, at (the offset), page_id (of responses that name it), url, ip, date, mime, http (is the block an HTTP
    response), digest and bytes of the payload, block."""
    schema = pa.schema(list(_ARC_ROW.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ({"file": f, "at": r.offset, "page_id": r.page, "url": r.url, "ip": r.ip, "date": r.date, "mime": r.mime, "http": r.http, "digest": sha1(r.payload), "bytes": len(r.payload), "block": r.block} for f, r in _records(batches, ArcReader()))
        yield from _batches(rows, schema, "block")
        release()

    return _pieces(spark, path).mapInArrow(run, "file string, at long, page_id long, url string, ip string, date string, mime string, http boolean, digest string, bytes long, block binary")


def convert(spark: SparkSession, legacy: str, path: str, min_bytes: int = 0) -> None:
    """WARC files, in the folder ``path``, of all records of the ARC files in ``legacy``: of responses with equal payloads of at least ``min_bytes``
    bytes those of the largest page_id stay responses (null is least; if all are null, all stay), the others revisit one of them."""
    staged = shared_path(spark, "records")
    with small_batches(spark):
        read_legacy(spark, legacy).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", 1).parquet(staged)
    every = spark.read.parquet(staged)
    narrow = every.filter(F.col("http") & (F.col("bytes") >= min_bytes)).select("file", "at", "page_id", "digest", "url", "date")
    first = narrow.groupBy("digest").agg(F.max_by(F.struct("page_id", F.struct("file", "at", "url", "date").alias("refers")), F.struct("page_id", "file", "at")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first.page_id is not null").select("digest", "first")
    later = narrow.select("file", "at", "page_id", "digest").join(broadcast_if_small(written(first, "firsts")), "digest").filter("page_id is null or page_id < first.page_id")
    later = broadcast_if_small(written(later.select("file", "at", "first.refers"), "later"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [warc_record(Record(x["at"], x["url"], x["ip"], x["date"], x["mime"], x["block"]), x["file"], tuple(x["refers"].values()) if x["refers"] else None) for x in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["value"])
        release()

    typed = every.select("file", "at", "url", "ip", "date", "mime", "block").join(later, ["file", "at"], "left")
    with small_batches(spark):
        typed.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.options(lineSep=END.decode(), **GZIP).text(path)
    removed(spark, staged)


_WARC_ROW = {"record": pa.string(), "page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers": pa.string()}


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record of the WARC files at ``path``, from its fields and block;
    digests of blocks and payloads are verified. What a revisit refers to is found by its record id."""
    schema = pa.schema(list(_WARC_ROW.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((_row(*r) for _, r in _records(batches, WarcReader())), schema, "refers")

    found = _pieces(spark, path).mapInArrow(run, "record string, page_id long, payload_bytes long, payload_digest string, record_type string, refers string")
    found = written(found, "records")
    first = broadcast_if_small(written(found.filter("refers is null").select(F.col("record").alias("refers"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("whole")).join(found.select("refers").distinct(), "refers"), "referred"))
    return found.join(first, "refers", "left").select("page_id", F.coalesce("whole", "payload_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def _row(fields: dict[str, str], block: bytes) -> dict[str, object]:
    r = Record(0, "", "", "", "", block)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if fields["WARC-Block-Digest"] != f"sha1:{sha1(block)}" or not revisit and sha1(r.payload) != digest:
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {"record": fields["WARC-Record-ID"], "page_id": r.page, "payload_bytes": None if revisit else len(r.payload), "payload_digest": digest, "record_type": fields["WARC-Type"], "refers": fields.get("WARC-Refers-To")}


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to legacy archives in the shared folder, convert these to WARC files, and read them."""
    spark = pages.sparkSession
    legacy, path = shared_path(spark, "arc"), shared_path(spark, "warc")
    write_legacy(pages, legacy)
    convert(spark, legacy, path, min_bytes)
    removed(spark, legacy)
    until_exit(spark, path)
    return read_archives(spark, path)
