"""BGEN files, layout 2 with zlib, unphased diploid genotypes of two alleles.

Variant blocks are made and read by Spark, one row each; ``assemble`` streams them in order into one file, as the format asks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import stores

#: Bytes a probability takes, by bits.
WIDTHS = {8: 1, 16: 2, 24: 3, 32: 4}


def pack(gp: np.ndarray, bits: int) -> bytes:
    """Posteriors [sample, 3] as integers of ``bits`` bits: two a sample, the third is what is left of 1."""
    top, width = (1 << bits) - 1, WIDTHS[bits]
    share = gp / gp.sum(axis=1, keepdims=True) * top
    low = np.floor(share).astype(np.int64)
    for _ in range(2):  # at most two units are left; they go to the largest remainders
        short = low.sum(axis=1) < top
        rest = share - low
        low[short, rest[short].argmax(axis=1)] += 1
    raw = np.ascontiguousarray(low[:, :2].astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
    return raw.tobytes()


def unpack(data: bytes, bits: int) -> np.ndarray:
    width = WIDTHS[bits]
    raw = np.zeros((len(data) // width, 8), np.uint8)
    raw[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    two = raw.view("<u8").reshape(-1, 2).astype(float) / ((1 << bits) - 1)
    return np.column_stack([two, 1 - two.sum(axis=1)])


def variant_block(chrom: str, pos: int, ref: str, alt: str, gp: np.ndarray, bits: int = 16) -> bytes:
    text = lambda x, form: struct.pack(form, len(x.encode())) + x.encode()
    name = f"{chrom}:{pos}:{ref}:{alt}"
    n = len(gp)
    body = struct.pack("<IHBB", n, 2, 2, 2) + bytes([2]) * n + bytes([0, bits]) + pack(gp, bits)
    squeezed = zlib.compress(body)
    return text(name, "<H") + text(name, "<H") + text(chrom, "<H") + struct.pack("<IH", pos, 2) + text(ref, "<I") + text(alt, "<I") + struct.pack("<II", len(squeezed) + 4, len(body)) + squeezed


def header(samples: list[str], variants: int) -> bytes:
    names = b"".join(struct.pack("<H", len(s.encode())) + s.encode() for s in samples)
    block = struct.pack("<II", 8 + len(names), len(samples)) + names
    head = struct.pack("<III", 20, variants, len(samples)) + b"bgen" + struct.pack("<I", 1 | 2 << 2 | 1 << 31)
    return struct.pack("<I", len(head) + len(block)) + head + block


def blocks(post: DataFrame, sites: DataFrame, samples: list[str], bits: int = 16) -> DataFrame:
    """(chr, pos, block) of posteriors (sample, snp, g0, g1, g2); samples without posteriors at a site get a flat prior."""
    if bits not in WIDTHS:
        raise ValueError("bits must be 8, 16, 24 or 32")
    place = {s: i for i, s in enumerate(samples)}
    rows = post.groupBy("snp").agg(F.collect_list(F.struct(F.col("sample").cast("string").alias("s"), "g0", "g1", "g2")).alias("gp")).join(sites, "snp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for chrom, pos, ref, alt, own in zip(pdf["chr"], pdf["pos"], pdf["ref"], pdf["alt"], pdf["gp"]):
                gp = np.full((len(place), 3), 1 / 3)
                for x in own:
                    gp[place[x["s"]]] = x["g0"], x["g1"], x["g2"]
                out.append((chrom, pos, variant_block(chrom, pos, ref, alt, gp, bits)))
            yield pd.DataFrame(out, columns=["chr", "pos", "block"])

    return rows.select("chr", "pos", "ref", "alt", "gp").mapInPandas(run, "chr string, pos long, block binary")


def assemble(made: DataFrame, samples: list[str], path: str) -> None:
    """One file at ``path``, in any store that can be opened; the driver holds a partition's blocks at a time."""
    made = made.repartitionByRange("chr", "pos").sortWithinPartitions("chr", "pos").persist()
    with stores.open_output(path) as out:
        out.write(header(samples, made.count()))
        for row in made.select("block").toLocalIterator():
            out.write(row.block)
    made.unpersist()


def parse(data: bytes) -> tuple[list[str], Iterator[tuple[str, int, str, str, np.ndarray]]]:
    """(samples, variants) of a file's bytes."""
    (first,) = struct.unpack_from("<I", data, 0)
    size, variants, n = struct.unpack_from("<III", data, 4)
    (flags,) = struct.unpack_from("<I", data, size)
    if data[16:20] not in (b"bgen", b"\0\0\0\0") or flags & 3 != 1 or flags >> 2 & 15 != 2:
        raise ValueError("not a zlib-compressed BGEN file of layout 2")
    at, samples = 4 + size + 8, []
    if flags >> 31:
        for _ in range(n):
            (k,) = struct.unpack_from("<H", data, at)
            samples.append(data[at + 2 : at + 2 + k].decode())
            at += 2 + k

    def each() -> Iterator[tuple[str, int, str, str, np.ndarray]]:
        at = 4 + first
        for _ in range(variants):
            texts = []
            for _ in range(3):
                (k,) = struct.unpack_from("<H", data, at)
                texts.append(data[at + 2 : at + 2 + k].decode())
                at += 2 + k
            pos, alleles = struct.unpack_from("<IH", data, at)
            at += 6
            for _ in range(alleles):
                (k,) = struct.unpack_from("<I", data, at)
                texts.append(data[at + 4 : at + 4 + k].decode())
                at += 4 + k
            size, _ = struct.unpack_from("<II", data, at)
            body = zlib.decompress(data[at + 8 : at + 4 + size])
            at += 4 + size
            (count,) = struct.unpack_from("<I", body, 0)
            yield texts[2], pos, texts[3], texts[4], unpack(body[10 + count :], body[9 + count])

    return samples, each()


def read_bgen(spark: SparkSession, path: str) -> DataFrame:
    """(sample, chr, pos, ref, alt, g0, g1, g2, ds) of BGEN files; a file is one task's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                samples, variants = parse(content)
                for chrom, pos, ref, alt, gp in variants:
                    yield pd.DataFrame({"sample": samples or [str(i) for i in range(len(gp))], "chr": chrom, "pos": pos, "ref": ref, "alt": alt, "g0": gp[:, 0], "g1": gp[:, 1], "g2": gp[:, 2], "ds": gp[:, 1] + 2 * gp[:, 2]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "sample string, chr string, pos long, ref string, alt string, g0 double, g1 double, g2 double, ds double")
