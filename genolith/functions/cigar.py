"""CIGAR strings, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Operations that move along the reference; those that move along the read.
ON_REFERENCE, ON_READ = ("M", "D", "N", "=", "X"), ("M", "I", "S", "=", "X")


def parsed(cigar: Column) -> Column:
    """array<struct<len, op>>; * and null give an empty array."""
    pattern = r"(\d+)([MIDNSHP=X])"
    lens, ops = (F.regexp_extract_all(cigar, F.lit(pattern), i) for i in (1, 2))
    pairs = F.arrays_zip(lens.alias("len"), ops.alias("op"))
    return F.coalesce(F.transform(pairs, lambda x: F.struct(x["len"].cast("int").alias("len"), x["op"].alias("op"))), F.array().cast("array<struct<len:int,op:string>>"))


def span(cigar: Column) -> Column:
    """Bases of the reference that an alignment covers."""
    return F.aggregate(parsed(cigar), F.lit(0), lambda s, x: s + F.when(x["op"].isin(*ON_REFERENCE), x["len"]).otherwise(0))


def blocks(cigar: Column, start: Column) -> Column:
    """array<struct<ref, read, len>>: the aligned blocks, with places on the reference and (from 0) in the read."""
    zero = F.struct(start.cast("int").alias("ref"), F.lit(0).alias("read"), F.array().cast("array<struct<ref:int,read:int,len:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        aligned = x["op"].isin("M", "=", "X")
        block = F.struct(s["ref"].alias("ref"), s["read"].alias("read"), x["len"].alias("len"))
        return F.struct(
            (s["ref"] + F.when(x["op"].isin(*ON_REFERENCE), x["len"]).otherwise(0)).alias("ref"),
            (s["read"] + F.when(x["op"].isin(*ON_READ), x["len"]).otherwise(0)).alias("read"),
            F.when(aligned, F.concat(s["out"], F.array(block))).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(parsed(cigar), zero, step, lambda s: s["out"])


def clip(cigar: Column, pos: Column, seq: Column, qual: Column, use: bool) -> dict[str, Column]:
    """cigar, pos, seq and qual with soft clips taken as matches (``use``) or cut off at the head and dropped."""
    head = F.coalesce(F.nullif(F.regexp_extract(cigar, r"^(?:\d+H)?(\d+)S", 1), F.lit("")).cast("int"), F.lit(0))
    if use:
        return {"cigar": F.regexp_replace(cigar, "S", "M"), "pos": pos - head, "seq": seq, "qual": qual}
    rest = lambda x: F.substring(x, head + 1, F.char_length(x))
    return {"cigar": F.regexp_replace(cigar, r"\d+S", ""), "pos": pos, "seq": rest(seq), "qual": rest(qual)}
