"""BAM files in splits: a Python data source whose partitions are ranges of a file's bytes.

A BAM file is a run of small compressed blocks. A partition owns the blocks that begin in its range, and the records that begin in these blocks; it reads on into the next
partition's first blocks to finish its last record. Where the first record of a range begins is found by trying places until a chain of records follows, each of whose fields fit
together and with the file's references. A file that isn't made of such blocks (plain gzip) is read by one partition.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import stores

ROW = "sample string, chr string, qname string, dup boolean, rev boolean, pos long, mapq int, cigar string, isize int, seq string, qual string, bx string"
HEADER = "file string, sample string, nth int, chr string, length long"
_BASES, _OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_PAIRS = [_BASES[b >> 4] + _BASES[b & 15] for b in range(256)]
_FIXED = struct.Struct("<iiiBBHHHiiii")
#: Bytes of a partition, and before it from which on its first record is looked for; records of a batch; bytes read at once; records that must follow a place for it to begin one.
SPLIT, BEFORE, TOGETHER, CHUNK, CHAIN = 64 << 20, 1 << 17, 4096, 1 << 20, 12

def block_size(data: bytes | memoryview, at: int) -> int | None:
    """The size of the block that begins at ``at`` of ``data``; None if none does, or its header isn't there as a whole."""
    if len(data) < at + 18 or bytes(data[at : at + 4]) != b"\x1f\x8b\x08\x04":
        return None
    extra, place = struct.unpack_from("<H", data, at + 10)[0], at + 12
    while place + 4 <= min(at + 12 + extra, len(data)):
        kind, size = bytes(data[place : place + 2]), struct.unpack_from("<H", data, place + 2)[0]
        if kind == b"BC" and size == 2 and place + 6 <= len(data):
            return struct.unpack_from("<H", data, place + 4)[0] + 1
        place += 4 + size
    return None


def first_block(data: bytes, whole: bool) -> int | None:
    """Where the first block of ``data`` begins: another one, or (if ``data`` is ``whole``, i.e. ends with the file) the end must follow it."""
    at = data.find(b"\x1f\x8b\x08\x04")
    while at >= 0:
        size = block_size(data, at)
        if size is not None and (block_size(data, at + size) is not None or whole and at + size == len(data)):
            return at
        at = data.find(b"\x1f\x8b\x08\x04", at + 1)
    return None


def blocks(file, start: int, length: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the blocks from the first that begins at ``start`` or after it; a plain gzip file is one block after another of no offset but 0."""
    file.seek(0)
    if block_size(file.read(64), 0) is None:
        if start == 0:
            yield from _plain(file)
        return
    if start:  # a block has at most 64 KiB, so one begins within as many bytes, and the next one within as many more
        file.seek(start)
        data = file.read(3 << 16)
        found = first_block(data, start + len(data) == length)
        if found is None:
            return
        start += found
    at, held = start, b""
    file.seek(start)
    while True:
        size = block_size(held, 0)
        while size is None or len(held) < size:
            more = file.read(CHUNK)
            if not more:
                if held:
                    raise ValueError(f"a block at {at} is cut off")
                return
            held += more
            size = block_size(held, 0)
            if size is None and len(held) >= 1 << 16:
                raise ValueError(f"no block at {at}")
        begin = 12 + struct.unpack_from("<H", held, 10)[0]
        yield at, zlib.decompress(held[begin : size - 8], -15)
        at, held = at + size, held[size:]


def _plain(file) -> Iterator[tuple[int, bytes]]:
    file.seek(0)
    left, machine = b"", zlib.decompressobj(31)
    while data := left or file.read(CHUNK):
        yield 0, machine.decompress(data)
        left = machine.unused_data
        if machine.eof:
            machine = zlib.decompressobj(31)
        elif left:
            raise ValueError("not a BAM file")


@dataclass
class Header:
    sample: str
    names: list[str]
    lengths: list[int]
    text: str
    size: int  # bytes before the first record, uncompressed


def parse_header(path: str, parts: Iterator[tuple[int, bytes]]) -> tuple[Header, int, int]:
    """(header, offset of the block in which records begin, their place in it); raises ValueError if the file is no BAM, or not of one sample."""
    raw, starts = b"", []

    def need(n: int) -> None:
        nonlocal raw
        while len(raw) < n:
            at, part = next(parts, (None, b""))
            if at is None:
                raise ValueError(f"{path} is not a BAM file")
            starts.append((len(raw), at))
            raw += part

    need(8)
    if raw[:4] != b"BAM\1":
        raise ValueError(f"{path} is not a BAM file")
    (size,) = struct.unpack_from("<i", raw, 4)
    need(12 + size)
    text, at = raw[8 : 8 + size].decode().rstrip("\0"), 8 + size
    (n,) = struct.unpack_from("<i", raw, at)
    names, lengths, at = [], [], at + 4
    for _ in range(n):
        need(at + 4)
        (size,) = struct.unpack_from("<i", raw, at)
        need(at + 8 + size)
        names.append(raw[at + 4 : at + 3 + size].decode())
        lengths.append(struct.unpack_from("<i", raw, at + 4 + size)[0])
        at += 8 + size
    found = {x[3:] for line in text.split("\n") if line.startswith("@RG") for x in line.split("\t") if x.startswith("SM:")}
    if len(found) != 1:
        raise ValueError(f"not one sample in the header of {path}")
    own = max((s for s in starts if s[0] <= at), key=lambda s: s[0])
    return Header(next(iter(found)), names, lengths, text, at), own[1], at - own[0]


def fits(raw: bytes, at: int, header: Header) -> int | None:
    """The end of the record at ``at`` if its fields fit together, else None; 0 if ``raw`` ends before that can be told."""
    if len(raw) < at + 36:
        return 0
    size = struct.unpack_from("<i", raw, at)[0]
    ref, pos, l_name, _, _, n_ops, _, l_seq, mate, mate_pos, _ = _FIXED.unpack_from(raw, at)[1:]
    sound = l_name >= 1 and l_seq >= 0 and all(-1 <= r < len(header.names) and -1 <= p <= (header.lengths[r] if r >= 0 else 1 << 31) for r, p in ((ref, pos), (mate, mate_pos)))
    if not sound or size < 32 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq:
        return None
    if len(raw) < at + 36 + l_name + 4 * n_ops:
        return 0
    name, ops = raw[at + 36 : at + 36 + l_name], struct.unpack_from(f"<{n_ops}I", raw, at + 36 + l_name)
    if name[-1] or not all(33 <= c <= 126 for c in name[:-1]) or any(o & 15 > 8 for o in ops):
        return None
    read = sum(o >> 4 for o in ops if o & 15 in (0, 1, 4, 7, 8))
    return at + 4 + size if not ops or not l_seq or read == l_seq else None


def first_record(raw: bytes, header: Header, done: bool) -> int | None:
    """The first place of ``raw`` at which a chain of records begins: CHAIN of them, or, if ``done``, all until the end. None if there is none, -1 if more bytes are needed."""
    for at in range(len(raw) + 1):
        place, n = at, 0
        while n < CHAIN and place < len(raw):
            end = fits(raw, place, header)
            if end is None:
                break
            if end == 0 or end > len(raw):
                if done:
                    break
                return -1
            place, n = end, n + 1
        else:
            if n == CHAIN or done and place == len(raw) and (n or at == len(raw)):
                return at if at < len(raw) else None
            if not done:
                return -1
    return None


#: Bytes of a tag's value, by type.
_SIZES = {b"A": 1, b"c": 1, b"C": 1, b"s": 2, b"S": 2, b"i": 4, b"I": 4, b"f": 4}


def text_tag(tags: bytes, wanted: bytes) -> str:
    """The text of a tag, or an empty one."""
    at = 0
    while at + 3 <= len(tags):
        name, kind, at = tags[at : at + 2], tags[at + 2 : at + 3], at + 3
        if kind in (b"Z", b"H"):
            end = tags.index(b"\0", at)
            if name == wanted:
                return tags[at:end].decode()
            at = end + 1
        elif kind == b"B":
            at += 5 + _SIZES[tags[at : at + 1]] * struct.unpack_from("<i", tags, at + 1)[0]
        else:
            at += _SIZES[kind]
    return ""


def record(raw: bytes, at: int, end: int, header: Header) -> tuple:
    """The fields of the record at ``at``, as of ROW without sample."""
    _, ref, pos, l_name, mapq, _, n_ops, flag, l_seq, _, _, isize = _FIXED.unpack_from(raw, at)
    at += 36
    name, at = raw[at : at + l_name - 1].decode(), at + l_name
    ops = struct.unpack_from(f"<{n_ops}I", raw, at)
    at += 4 * n_ops
    seq, at = "".join([_PAIRS[b] for b in raw[at : at + (l_seq + 1) // 2]])[:l_seq], at + (l_seq + 1) // 2
    scores = raw[at : at + l_seq]
    qual = "*" if l_seq and scores[0] == 0xFF else bytes(q + 33 for q in scores).decode()
    bx = text_tag(raw[at + l_seq : end], b"BX")
    return header.names[ref] if ref >= 0 else "*", name, bool(flag & 1024), bool(flag & 16), pos + 1, mapq, "".join(f"{o >> 4}{_OPS[o & 15]}" for o in ops) or "*", isize, seq, qual, bx


def _reach(raw: bytes, at: int) -> tuple[int, int, int]:
    """(reference, first base, last base) of the record at ``at``, from 1."""
    _, ref, pos, l_name, _, _, n_ops, *_ = _FIXED.unpack_from(raw, at)
    ops = struct.unpack_from(f"<{n_ops}I", raw, at + 36 + l_name)
    return ref, pos + 1, pos + max(1, sum(o >> 4 for o in ops if o & 15 in (0, 2, 3, 7, 8)))


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int
    length: int


def whole(path: str, content: bytes, region: tuple[str, int, int] | None = None) -> list[tuple]:
    """All records of a file's bytes."""
    return list(records(Split(path, 0, len(content), len(content)), region, pa.BufferReader(content)))


def records(split: Split, region: tuple[str, int, int] | None = None, opened=None) -> Iterator[tuple]:
    """The records that begin in the split's blocks (and overlap the region), as of ROW."""
    with opened or stores.open_input(split.path) as file:
        header, block, place = parse_header(split.path, blocks(file, 0, split.length))
        wanted = header.names.index(region[0]) if region and region[0] in header.names else None
        if region and wanted is None:
            return
        sorted_by_place = "\tSO:coordinate" in header.text.split("\n", 1)[0]
        plain = _is_plain(file)
        if plain and split.start or not plain and split.end <= block:
            return
        known = plain or split.start - BEFORE <= block
        parts = blocks(file, 0 if plain else block if known else split.start - BEFORE, split.length)
        raw, at = b"", (header.size if plain else place) if known else None
        begin = edge = None  # where the split's own blocks begin in ``raw``, and where those of the next split
        while True:
            offset, part = next(parts, (None, b""))
            if offset is not None and begin is None and offset >= (0 if split.start <= block else split.start):
                begin = len(raw)
            if offset is not None and not plain and offset >= split.end and edge is None:
                edge = len(raw)
            raw += part
            if at is None:  # the first record is still to be found
                at = first_record(raw, header, offset is None)
                if at == -1:
                    at = None
                    continue
                if at is None:
                    return
            while len(raw) >= at + 4 and (edge is None or at < edge):
                end = at + 4 + struct.unpack_from("<i", raw, at)[0]
                if end > len(raw):
                    break
                if begin is None or at < begin:
                    pass  # the split before this one has it
                elif region is None:
                    yield (header.sample, *record(raw, at, end, header))
                else:
                    ref, low, high = _reach(raw, at)
                    if ref == wanted and low <= region[2] and high >= region[1]:
                        yield (header.sample, *record(raw, at, end, header))
                    elif sorted_by_place and (ref > wanted or ref < 0 or ref == wanted and low > region[2]):
                        return
                at = end
            if edge is not None and at >= edge:
                return
            if offset is None:
                if at < len(raw):
                    raise ValueError(f"{split.path} ends within a record")
                return
            if at > CHUNK:
                begin, edge = (None if x is None else x - at for x in (begin, edge))
                raw, at = raw[at:], 0


def _is_plain(file) -> bool:
    file.seek(0)
    return block_size(file.read(64), 0) is None


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.split = json.loads(options["files"]), int(options.get("split", SPLIT))
        self.region = json.loads(options["region"]) if "region" in options else None
        self.headers = options.get("headers") == "true"

    def partitions(self) -> list[Split]:
        if self.headers:
            return [Split(path, 0, 1, n) for path, n in self.files]
        return [Split(path, start, min(n, start + self.split), n) for path, n in self.files for start in range(0, max(n, 1), self.split)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in (HEADER if self.headers else ROW).split(", ")])

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        if self.headers:
            with stores.open_input(partition.path) as file:
                header, _, _ = parse_header(partition.path, blocks(file, 0, partition.length))
            if header.names:
                yield batch([(partition.path, header.sample, i, n, size) for i, (n, size) in enumerate(zip(header.names, header.lengths))])
            return
        held: list[tuple] = []
        for row in records(partition, self.region):
            held.append(row)
            if len(held) == TOGETHER:
                yield batch(held)
                held = []
        if held:
            yield batch(held)


class BamSource(DataSource):
    """Options: files (JSON of [path, bytes] pairs), split (bytes), region (JSON of [chr, first, last]), headers (true for references in place of records)."""

    @classmethod
    def name(cls) -> str:
        return "genolith_bam"

    def schema(self) -> str:
        return HEADER if self.options.get("headers") == "true" else ROW

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def _files(spark: SparkSession, paths: str | list[str]) -> list[tuple[str, int]]:
    """(path, bytes) of the files; their contents aren't read."""
    found = [(r.path, r.length) for r in spark.read.format("binaryFile").load(paths).select("path", "length").orderBy("path").collect()]
    other = [path for path, _ in found if not stores.known(path)]
    if other:
        raise ValueError(f"workers can't read ranges of {other[0]}")
    return found


def read_splits(spark: SparkSession, paths: str | list[str], split: int = SPLIT, region: tuple[str, int, int] | None = None) -> DataFrame:
    """Alignments (sample, chr, qname, dup, rev, pos, ...) of BAM files, of one sample each, by partitions of ``split`` bytes of a file; with ``region`` (chr, first, last), those that overlap
    it. Of a file that its header says is sorted by coordinate, what lies behind a region isn't read."""
    spark.dataSource.register(BamSource)
    reader = spark.read.format("genolith_bam").option("files", json.dumps(_files(spark, paths))).option("split", str(split))
    return (reader if region is None else reader.option("region", json.dumps(region))).load()


def references(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, sample, nth, chr, length): the references of the files' headers."""
    spark.dataSource.register(BamSource)
    return spark.read.format("genolith_bam").option("files", json.dumps(_files(spark, paths))).option("headers", "true").load()


def chromosome_lengths(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(chr, length): the greatest length that a file's header states."""
    return references(spark, paths).groupBy("chr").agg(F.max("length").alias("length"))
