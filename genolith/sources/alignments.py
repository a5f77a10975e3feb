"""Readers of alignments: SAM text and BAM."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bam, stores



def sample_names(headers: DataFrame) -> DataFrame:
    """(file, sample) of header lines (file, value): the SM of the @RG lines, of which a file must have just one."""
    sm = F.regexp_extract("value", r"\tSM:([^\t]+)", 1)
    names = headers.filter(F.col("value").startswith("@RG")).groupBy("file").agg(F.collect_set(F.nullif(sm, F.lit(""))).alias("s"))
    wrong = F.raise_error(F.concat(F.lit("not one sample in the header of "), F.col("file")))
    return names.select("file", F.when(F.size("s") == 1, F.get("s", F.lit(0))).otherwise(wrong).alias("sample"))


def read_sam(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Alignments (sample, chr, qname, dup, rev, pos, ...) of SAM text, one sample a file."""
    text = spark.read.text(paths).select(F.input_file_name().alias("file"), "value")
    f = lambda i: F.get("f", F.lit(i))
    body = text.filter(~F.col("value").startswith("@")).select("file", F.split("value", "\t").alias("f"), F.regexp_extract("value", r"\tBX:Z:([^\t]+)", 1).alias("bx"))
    flag = f(1).cast("int")
    rows = body.select(
        "file", f(2).alias("chr"), f(0).alias("qname"), (flag.bitwiseAND(F.lit(1024)) != 0).alias("dup"), (flag.bitwiseAND(F.lit(16)) != 0).alias("rev"),
        f(3).cast("long").alias("pos"), f(4).cast("int").alias("mapq"), f(5).alias("cigar"), f(8).cast("int").alias("isize"), f(9).alias("seq"), f(10).alias("qual"), "bx",
    )
    return rows.join(sample_names(text.filter(F.col("value").startswith("@"))), "file").drop("file")


def read_bam(spark: SparkSession, paths: str | list[str], split: int = bam.SPLIT, region: tuple[str, int, int] | None = None) -> DataFrame:
    """As ``read_sam``, of BAM files, by ranges of their bytes; of stores that workers can't read ranges of, a file is one task's. ``region`` (chr, first, last): those that overlap it."""
    found = [r.path for r in spark.read.format("binaryFile").load(paths).select("path").collect()]
    if all(stores.known(path) for path in found):
        return bam.read_splits(spark, found, split, region)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in bam.ROW.split(", ")]
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame(bam.whole(path, content, region), columns=columns)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, bam.ROW)


def bam_samples(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(sample) of BAM files, by their headers alone where workers can read ranges."""
    found = [r.path for r in spark.read.format("binaryFile").load(paths).select("path").collect()]
    return (bam.references if all(stores.known(path) for path in found) else read_bam)(spark, found).select("sample").distinct()
