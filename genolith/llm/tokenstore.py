"""Token ids as a content-addressed store: chunks, recipes and Merkle manifests.

* Texts are encoded with the ``tokenizers`` library. Where its rules encode each word by itself, distinct
  words are encoded once and remembered (see ``Encoder``); tests hold that against whole texts.
* A document's ids (little-endian, as wide as the vocabulary asks: ``uint16`` up to 65,536 ids) are cut where a rolling
  hash of the last WINDOW ids hits a mask, within least and most lengths. Chunks are named by SHA-256; each is stored
  once.
* A recipe lists a content's chunks in order; its manifest is the Merkle root of their names. Equal documents share the
  recipe. The documents table holds, in ascending doc_id order, each document's root, length and start.

Tables of a store: ``format`` (width, end_id), ``chunks`` (name, ids), ``recipes`` (root, part, name, n, offset) and
``documents`` (doc_id, root, n_tokens, start). They are Parquet files with binary ids, written by Spark, so that any store that Spark reaches will do.
Reading verifies each chunk's name, each recipe's root and each length, and fails on any mismatch.

Cases: null or empty text has the end id alone. Rows that repeat a doc_id are documents of their own, ordered by root.
A null doc_id sorts first. Extra columns are left out of the store.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import bounded, broadcast_if_small, release, removed, shared_path, small_batches, until_exit, written

WINDOW, LEAST, MOST, MASK_BITS = 16, 64, 4096, 9
#: Words that an encoder remembers; then it forgets them all.
MEMORY = 500_000


def _gear() -> np.ndarray:
    """65,536 pseudorandom 32-bit numbers, one for each 16-bit value."""
    return np.random.default_rng(20240101).integers(0, 1 << 32, 1 << 16, dtype=np.uint32)


class _Numbers(dict):
    """Numbers keys in the order in which they are first asked for; ``new`` lists those not yet learned."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


#: Fixed value: the split pattern of the word tokenizers for which ``Encoder`` splits texts itself.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The characters up to here, and general punctuation, are split here; Unicode's versions agree on them.
LATIN = 0x17F
_LETTERS, _NUMBERS = ("".join(c for c in map(chr, range(LATIN + 1)) if kind(c)) for kind in (str.isalpha, str.isnumeric))
#: WORD_PATTERN for such characters, in terms of ``re``.
LATIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+"
#: Pieces with these go to the whole tokenizer: characters beyond, white space to Python alone, begins of special tokens.
BEYOND = re.compile("[^\x00-\x1b\x20-\u017f\u2010-\u2027]|<\\|")
#: What the byte-level step of the library writes for each byte: the byte's own character if printable, else the next free.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
_BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_BYTE_TEXT = str.maketrans({b: c for b, c in _BYTES.items()})


class Encoder:
    """Encodes texts with one tokenizer; made once on each Python worker.

    A tokenizer that lower-cases, splits by WORD_PATTERN and drops white space (``by_words``) encodes each word by itself.
    So texts are cut at white space, the distinct pieces of a batch are split into words by that pattern here, and the
    library's model encodes each distinct word once. Pieces that hold anything of BEYOND go to the whole tokenizer, as
    all texts do with other tokenizers.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            rules = json.load(f)
        split = ((rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        steps = [x.get("type") for x in (rules.get("normalizer") or {}).get("normalizers") or []]
        self.by_words = steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": WORD_PATTERN} and split.get("behavior") == "Removed"
        self.model = Tokenizer(self.tokenizer.model)  # the same one, without normalisation and splitting
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.split = re.compile(f"{LATIN_PATTERN}| ").findall
        self._forget()

    def _forget(self) -> None:
        self.known = _Numbers()
        self.known[" "] = 0  # parts pieces; no ids
        self.flat, self.ends = np.empty(1 << 16, self.kind), np.zeros(1 << 12, np.int64)

    def encode_whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[list[int]]:
        shown = [w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_TEXT) for w in words]
        return [e.ids for e in self.model.encode_batch_fast(shown, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        n = len(self.known) - len(new)
        at, ids = int(self.ends[n]), self._encode_words(new)
        ends = at + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        while n + len(new) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while new and ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        if new:
            self.flat[at : ends[-1]] = np.fromiter(chain.from_iterable(ids), self.kind, int(ends[-1]) - at)
            self.ends[n + 1 : n + 1 + len(new)] = ends

    def _gathered(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all words in order, and where each word's end."""
        first, lens = self.ends[numbers], self.ends[numbers + 1] - self.ends[numbers]
        ends = np.cumsum(lens)
        return self.flat[_runs(first, lens, ends)], ends

    def _encode_pieces(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of pieces without white space; what one call asks for is kept whole, MEMORY bounds the rest."""
        if len(self.known) > MEMORY:
            self._forget()
        pieces = distinct.to_pylist()
        fine = pc.and_not(pc.and_(pc.string_is_ascii(distinct), pc.ascii_is_printable(distinct)), pc.match_substring(distinct, "<|"))
        odd = [i for i in np.flatnonzero(~fine.to_numpy(zero_copy_only=False)).tolist() if BEYOND.search(pieces[i])]
        plain = pieces.copy()
        for i in odd:
            plain[i] = ""
        words = self.split(" ".join(plain).lower())
        numbers = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        new, self.known.new = self.known.new, []
        self._learn(new)
        ids, word_ends = self._gathered(numbers)
        ends = np.append(word_ends[numbers == 0], len(ids)) if pieces else np.zeros(0, np.int64)
        if odd:  # their ids go between those of the others
            parts, past, more = [], 0, np.zeros(len(pieces), np.int64)
            for i, own in zip(odd, self.encode_whole([pieces[i] for i in odd])):
                parts += [ids[past : ends[i]], np.array(own, self.kind)]
                past, more[i] = int(ends[i]), len(own)
            ids, ends = np.concatenate([*parts, ids[past:]]), ends + np.cumsum(more)
        return ids, ends

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string array without nulls."""
        if not self.by_words:
            return [np.array(ids, self.kind) for ids in self.encode_whole(texts.to_pylist())]
        lists = pc.ascii_split_whitespace(texts)
        cuts = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        ids, ends = self._encode_pieces(coded.dictionary)
        at = coded.indices.to_numpy()
        lens = np.diff(ends, prepend=0)
        first, n = (ends - lens)[at], lens[at]
        last = np.cumsum(n)
        every = ids[_runs(first, n, last)]
        bounds = np.concatenate([[0], last])[cuts - cuts[0]]
        return [every[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def _runs(first: np.ndarray, lens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers first[0] .. first[0] + lens[0] - 1, then those from first[1], and so on; ``ends`` are the sums of ``lens``."""
    kind = np.int32 if not len(ends) or max(int(ends[-1]), int((first + lens).max())) < 1 << 31 else np.int64
    out = np.repeat((first - (ends - lens)).astype(kind), lens)
    out += np.arange(len(out), dtype=kind)
    return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This Python worker's encoder for ``path``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def marks(ids: np.ndarray, gear: np.ndarray) -> list[int]:
    """Where chunks may end: after the ids at which a hash of the last WINDOW ids has MASK_BITS zeros. ``ids`` may hold many documents one after
    another: what a window sees of the one before concerns its first WINDOW ids alone, and no chunk is as short as that (LEAST)."""
    rolled = gear[ids & 0xFFFF]
    np.cumsum(rolled, dtype=np.uint32, out=rolled)
    rolled[WINDOW:] -= rolled[:-WINDOW].copy()  # the sum over the last WINDOW ids, modulo 2^32
    rolled *= np.uint32(0x9E3779B1)
    return (np.flatnonzero(rolled < 1 << (32 - MASK_BITS)) + 1).tolist()


def cut(found: list[int], start: int, stop: int) -> list[int]:
    """The ends of the chunks of the document from ``start`` to ``stop``: content-defined, LEAST to MOST ids long, but for the last."""
    ends = []
    while stop - start > LEAST:
        i = bisect_left(found, start + LEAST)
        start = min(found[i] if i < len(found) else stop, start + MOST, stop)
        ends.append(start)
    if start < stop:
        ends.append(stop)
    return ends


def merkle_root(names: list[bytes]) -> bytes:
    """SHA-256 tree over chunk names: leaves and nodes are told apart by their first byte; an odd node moves up."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in names]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _slices(batch: pa.RecordBatch, rows: int = 4096, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of at most ``rows`` rows and about ``most`` bytes of its second column, or of one row."""
    sizes = pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
    at, size = 0, 0
    for i, x in enumerate(sizes):
        if i > at and (i - at >= rows or size + x > most):
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += x
    if at < batch.num_rows:
        yield batch.slice(at)


def _width(path: str, end_id: int) -> str:
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(path).get_vocab_size()
    release()
    return "<u2" if max(size, end_id + 1) <= 1 << 16 else "<u4"


def _gathered(batches: Iterator[pa.RecordBatch], together: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of about ``together`` bytes of texts (second column), or of one row."""
    held, size = [], 0
    for whole in batches:
        for batch in _slices(whole, most=together):
            held.append(batch)
            size += batch.column(1).nbytes
            if size >= together:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def write_store(docs: DataFrame, tokenizer: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text", together: int = 8_000_000) -> None:
    """Encode all rows of ``docs`` and write a store to ``path``. Texts of about ``together`` bytes are encoded at a time: more saves time
    (distinct words) and takes memory.

    Chunks are staged as they come. Which of equal chunks stays is found by names alone; the others are left out when the staged ids are
    copied to ``chunks``, and the staged ones go.
    """
    kind = _width(tokenizer, end_id)
    width = int(kind[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder, gear = encoder(tokenizer), _gear()
        for batch in _gathered(batches, together):
            roots, counts, parts, names, offsets, pieces = [], [], [0], [], [], []
            end = np.array([end_id], kind)
            coded = own_encoder.encode(batch.column(1).fill_null(""))
            every = np.concatenate([x for ids in coded for x in (ids, end)]).astype(kind, copy=False)
            found, data, first = marks(every, gear), memoryview(every).cast("B"), 0
            for ids in coded:
                start, last = first, first + len(ids) + 1
                for stop in cut(found, first, last):
                    piece = bytes(data[width * start : width * stop])
                    names.append(hashlib.sha256(piece).digest())
                    offsets.append(start - first)
                    pieces.append(piece)
                    start = stop
                roots.append(merkle_root(names[parts[-1] :]))
                counts.append(last - first)
                parts.append(len(names))
                first = last
            lengths = [len(x) // width for x in pieces]
            fields = [pa.array(names, pa.binary()), pa.array(lengths, pa.int32()), pa.array(offsets, pa.int64()), pa.array(pieces, pa.binary())]
            chunks = pa.ListArray.from_arrays(pa.array(parts, pa.int32()), pa.StructArray.from_arrays(fields, ["name", "n", "offset", "ids"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(roots, pa.binary()), pa.array(counts, pa.int64()), chunks], ["doc_id", "root", "n_tokens", "chunks"])
        release()

    spark = docs.sparkSession
    spark.createDataFrame([(width, end_id)], "width int, end_id int").coalesce(1).write.parquet(f"{path}/format")
    encoded = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, root binary, n_tokens long, chunks array<struct<name:binary,n:int,offset:bigint,ids:binary>>")
    with small_batches(spark):
        encoded.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", 1).parquet(f"{path}/staged")
    staged = spark.read.parquet(f"{path}/staged").withColumn("place", F.struct(F.xxhash64("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at")))
    parts = staged.select("place", "root", F.posexplode("chunks").alias("part", "c"))
    names = written(parts.select("place", "root", "part", "c.name", "c.n", "c.offset"), "names")
    several = names.groupBy("name").agg(F.min(F.struct("place", "part")).alias("first"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("name", "first")
    later = written(names.join(several, "name").filter(F.struct("place", "part") != F.col("first")).select("place", "part"), "later")
    once = parts.select("place", "part", "c.name", "c.ids").join(broadcast_if_small(later), ["place", "part"], "left_anti").select("name", "ids")
    once.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", 1).parquet(f"{path}/chunks")
    names.select("root", "part", "name", "n", "offset").distinct().write.parquet(f"{path}/recipes")
    _started(staged.select("doc_id", "root", "n_tokens")).write.parquet(f"{path}/documents")
    removed(spark, f"{path}/staged")


def _started(rows: DataFrame) -> DataFrame:
    """``rows`` with start, in ascending (doc_id, root) order: sums inside ranges, then over the ranges. The ranges are written once, so
    that both sums see the same."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(ranges, "doc_id", "root").withColumn("range", F.spark_partition_id()), "ranged")
    inside = Window.partitionBy("range").orderBy("doc_id", "root").rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("in", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    base = ranged.groupBy("range").agg(F.sum("n_tokens").alias("all")).withColumn("base", F.sum("all").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("all"))  # a row for each range
    return summed.join(F.broadcast(base), "range").select("doc_id", "root", "n_tokens", (F.col("in") + F.col("base")).alias("start"))


def read_contents(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(root, ids) of each content of the store, rebuilt from its chunks and verified; ids as binary."""
    chunks, recipes = spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/recipes")
    rebuilt = recipes.join(chunks, "name").groupBy("root").agg(F.array_sort(F.collect_list(F.struct("part", "name", "n", "ids"))).alias("chunks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 64) for i in range(0, whole.num_rows, 64)):
                roots, every = batch.column(0).to_pylist(), []
                for root, own in zip(roots, batch.column(1).to_pylist()):
                    for c in own:
                        _check(hashlib.sha256(c["ids"]).digest() == c["name"] and len(c["ids"]) == c["n"] * width, c["name"])
                    _check([c["part"] for c in own] == list(range(len(own))) and merkle_root([c["name"] for c in own]) == root, root)
                    every.append(b"".join(c["ids"] for c in own))
                yield pa.RecordBatch.from_arrays([pa.array(roots, pa.binary()), pa.array(every, pa.binary())], ["root", "ids"])

    return bounded(rebuilt).mapInArrow(run, "root binary, ids binary")


def _check(right: bool, name: bytes) -> None:
    if not right:
        raise ValueError(f"{name.hex()} of the token store is damaged")


#: The reflected polynomial of CRC-32 (fixed value).
POLYNOMIAL = np.uint64(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo POLYNOMIAL, x^0 at bit 31."""
    out, b = np.zeros_like(b), b.copy()
    one = np.uint64(1)
    for i in range(31, -1, -1):
        out ^= b * ((a >> np.uint64(i)) & one)
        b = (b >> one) ^ POLYNOMIAL * (b & one)
    return out


def crc32_shifted(crcs: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What each crc32 adds (by xor) to that of a concatenation in which ``after`` bytes follow its part."""
    out, power, bits = crcs.astype(np.uint64), np.array([1 << 30], np.uint64), after.astype(np.int64) * 8
    while bits.any():
        odd = (bits & 1).astype(bool)
        if odd.any():
            out[odd] = _times(np.broadcast_to(power, int(odd.sum())), out[odd])
        power, bits = _times(power, power), bits >> 1
    return out


def read_digests(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(root, n, ids_crc32) of each content, from the chunk files: every chunk is read and verified where it lies, and
    only its length and crc32 (of its ids as 32-bit integers) travel to its recipes, where they are put together."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, ns, crcs = batch.column(0).to_pylist(), [], []
            for name, ids in zip(names, batch.column(1)):
                ids = ids.as_py()
                _check(hashlib.sha256(ids).digest() == name, name)
                data = np.frombuffer(ids, f"<u{width}").astype("<u4")
                ns.append(len(data))
                crcs.append(zlib.crc32(data.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(ns, pa.int32()), pa.array(crcs, pa.int64())], ["name", "found", "crc"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots, own = batch.column(0).to_pylist(), batch.column(1)
            if not roots:
                continue
            counts = np.diff(own.offsets.to_numpy())
            flat = own.flatten()
            part, name, n, found, crc = (flat.field(i) for i in range(5))
            n, content, name = found.to_numpy().astype(np.int64), np.repeat(np.arange(len(roots)), counts), name.to_pylist()
            ends = np.cumsum(counts)
            starts = ends - counts
            _check(bool((flat.field(2).to_numpy() == n).all()) and bool((part.to_numpy() == np.arange(len(n)) - starts[content]).all()), roots[0])
            for root, a, b in zip(roots, starts, ends):
                _check(merkle_root(name[a:b]) == root, root)
            total = np.add.reduceat(n, starts)
            past = np.cumsum(n)
            shifted = crc32_shifted(crc.to_numpy().astype(np.uint64), 4 * (past[ends - 1][content] - past))
            yield pa.RecordBatch.from_arrays([pa.array(roots, pa.binary()), pa.array(total, pa.int64()), pa.array(np.bitwise_xor.reduceat(shifted, starts).astype(np.int64))], ["root", "n", "ids_crc32"])

    chunks = written(spark.read.parquet(f"{path}/chunks").select("name", "ids").mapInArrow(digest, "name binary, found int, crc long"), "digests")
    lists = spark.read.parquet(f"{path}/recipes").join(chunks, "name").groupBy("root").agg(F.array_sort(F.collect_list(F.struct("part", "name", "n", "found", "crc"))).alias("chunks"))
    return lists.mapInArrow(join, "root binary, n long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for each document of the store, verified."""
    docs, width = spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/format").first().width
    wrong = F.raise_error(F.lit("a document's length is not its content's")).cast("long")
    n = F.when(F.col("n") == F.col("n_tokens"), F.col("n_tokens")).otherwise(wrong)
    return docs.join(read_digests(spark, path, width), "root").select("doc_id", "start", n.alias("n_tokens"), "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): the ids as binary, ``width`` (see the format table) bytes each, little-endian."""
    width = spark.read.parquet(f"{path}/format").first().width
    return spark.read.parquet(f"{path}/documents").join(read_contents(spark, path, width), "root").select("doc_id", "start", "ids")


def stored(docs: DataFrame, tokenizer: str, end_id: int = 2, **memory: int) -> DataFrame:
    """Write ``docs`` to a fresh store in the shared folder, which goes when the driver ends, and read its documents back."""
    path = shared_path(docs.sparkSession, "tokens")
    write_store(docs, tokenizer, end_id, path, **memory)
    until_exit(docs.sparkSession, path)
    return read_documents(docs.sparkSession, path)
