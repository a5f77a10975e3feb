"""Genotyping arrays: reports and manifests to calls (sample, chr, pos, ref, alt, g) for comparison with dosages.

A call g counts the second allele of a probe; it is null where the array made none. Positions move between assemblies by blocks of a chain, as a join of ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.reads import range_join


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(sample, probe, a1, a2, score) of a final report: tab-separated rows under a header that names its columns, which follows some lines about the file."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("c"))
    header = lines.filter(F.array_contains("c", "SNP Name") & F.array_contains("c", "Sample ID")).limit(2).collect()
    if len(header) != 1:
        raise ValueError(f"{path} has no one header with SNP Name and Sample ID")
    place = {name: i for i, name in enumerate(header[0].c)}
    cell = lambda name: F.get("c", F.lit(place[name]))
    rows = lines.filter((F.size("c") == len(place)) & (cell("SNP Name") != "SNP Name"))
    return rows.select(cell("Sample ID").alias("sample"), cell("SNP Name").alias("probe"), cell("Allele1 - AB").alias("a1"), cell("Allele2 - AB").alias("a2"), cell("GC Score").cast("double").alias("score"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(nth, probe, chr, pos, ref, alt) of a tab-separated list of probes, whose SNP column holds both alleles as [A/G]; nth is the order in the file."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.select(F.col("Index").cast("long").alias("nth"), F.col("Name").alias("probe"), F.col("Chromosome").alias("chr"), F.col("Position").cast("long").alias("pos"), F.substring("SNP", 2, 1).alias("ref"), F.substring("SNP", 4, 1).alias("alt"))


def lift(probes: DataFrame, chain: DataFrame) -> DataFrame:
    """``probes`` (chr, pos, ...) at their places in another assembly; those outside the blocks of ``chain`` (chr, start, end, to_chr, to_start, forward; both ends inclusive) go. In a block
    that isn't forward, places run from its end on."""
    columns = [c for c in probes.columns if c not in ("chr", "pos")]
    met = range_join(chain, probes, "start", "end", "pos", ("chr",), width=1 << 16)
    along = F.when(F.col("forward"), F.col("pos") - F.col("start")).otherwise(F.col("end") - F.col("pos"))
    return met.select(*columns, F.col("to_chr").alias("chr"), (F.col("to_start") + along).alias("pos"))


def first_of_position(probes: DataFrame) -> DataFrame:
    """The first probe (by nth) of each position."""
    nth = F.row_number().over(Window.partitionBy("chr", "pos").orderBy("nth", "probe"))
    return probes.withColumn("__n", nth).filter("__n = 1").drop("__n")


def report_calls(report: DataFrame, probes: DataFrame, least_score: float = 0.15, without: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """Calls of a report: how many of the two alleles are B, null below ``least_score``. ``without`` (sample): samples that go, by their final names; ``names`` (sample, name): new names."""
    found = report.join(first_of_position(probes), "probe")
    g = F.when(F.col("score") >= least_score, (F.col("a1") == "B").cast("int") + (F.col("a2") == "B").cast("int"))
    return _named(found.withColumn("g", g), without, names)


def _named(found: DataFrame, without: DataFrame | None, names: DataFrame | None) -> DataFrame:
    if names is not None:
        found = found.join(names, "sample", "left").withColumn("sample", F.coalesce("name", "sample"))
    if without is not None:
        found = found.join(without.select("sample").distinct(), "sample", "left_anti")
    return found.select("sample", "chr", "pos", "ref", "alt", "g")


def _cells(wide: DataFrame, id_col: str, samples: list[str]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(s).alias("sample"), F.col(f"`{s}`").cast("int").alias("g")) for s in samples]))


def probe_calls(wide: DataFrame, annotation: DataFrame, id_col: str = "probeset_id", names: DataFrame | None = None) -> DataFrame:
    """Calls of a table with a column for each sample (0, 1, 2; less: none) at the probes of ``annotation`` (probe, chr, pos, ref, alt) whose alleles are single bases. With ``names`` (sample, name),
    of the samples that have one alone."""
    samples = [c for c in wide.columns if c != id_col]
    single = annotation.filter((F.length("ref") == 1) & (F.length("alt") == 1))
    each = wide.select(F.col(id_col).alias("probe"), _cells(wide, id_col, samples).alias("x")).select("probe", "x.sample", F.when(F.col("x.g") >= 0, F.col("x.g")).alias("g"))
    if names is not None:
        each = each.join(names.select("sample"), "sample", "left_semi")
    return _named(each.join(single, "probe"), None, names)
