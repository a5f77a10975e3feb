"""Readers of tab- and space-separated inputs: sites, truth, maps, names, panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): the lines of one file, numbered from 0. Lines are numbered within their partitions, which are counted first: no task sees all."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("id"), "value")
    part, within = F.call_function("shiftright", F.col("id"), F.lit(33)), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(lines.groupBy(part.alias("part")).count().collect())  # a row for each partition
    past, offsets = 0, []
    for r in counts:
        offsets.append((r[0], past))
        past += r[1]
    if not offsets:
        return lines.select(F.col("id").alias("n"), "value")
    begins = F.broadcast(spark.createDataFrame(offsets, "part long, past long"))  # as many rows
    return lines.withColumn("part", part).join(begins, "part").select((F.col("past") + within).alias("n"), "value")


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """(snp, chr, pos, ref, alt) of a posfile without header; snp numbers positions from 0."""
    raw = spark.read.csv(path, sep="\t", schema="chr string, pos long, ref string, alt string")
    return raw.select((F.row_number().over(Window.partitionBy("chr").orderBy("pos")) - 1).cast("long").alias("snp"), "*")


def check_sites(sites: DataFrame) -> DataFrame:
    """``sites`` if they keep to the rules, else ValueError: one chromosome, distinct positions, two different bases of ACGT."""
    n = sites.agg(
        F.count_distinct("chr").alias("chromosomes"), (F.count(F.lit(1)) - F.count_distinct("pos")).alias("repeated"),
        F.count_if(~F.col("ref").isin(*"ACGT") | ~F.col("alt").isin(*"ACGT")).alias("bases"), F.count_if(F.col("ref") == F.col("alt")).alias("same"),
    ).first()
    if n.chromosomes != 1 or n.repeated or n.bases or n.same:
        raise ValueError(f"sites break the rules: {n.asDict()}")
    return sites


def _wide(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """Sample names of the header, and (snp, line) of the rows below, numbered by their place in the file."""
    numbered = numbered_lines(spark, path).select("n", F.split("value", "\t").alias("cells"))
    names = list(numbered.filter("n = 0").first().cells)
    if all(x in ("0", "1", "2", "NA") or "|" in x for x in names):
        raise ValueError(f"{path} has no header of sample names")
    return names, numbered.filter("n > 0").select((F.col("n") - 1).alias("snp"), "cells")


def read_genotypes(spark: SparkSession, path: str) -> DataFrame:
    """(snp, sample, g) of a genfile: a column per sample, 0, 1, 2 or NA (null)."""
    names, rows = _wide(spark, path)
    each = rows.select("snp", F.posexplode("cells").alias("c", "x")).select("snp", F.get(F.array(*map(F.lit, names)), F.col("c")).alias("sample"), "x")
    wrong = F.raise_error(F.concat(F.lit("not a genotype: "), F.col("x"))).cast("int")
    return each.select("snp", "sample", F.when(F.col("x").isin("0", "1", "2"), F.col("x").cast("int")).when(F.col("x") != "NA", wrong).alias("g"))


def read_phase(spark: SparkSession, path: str) -> DataFrame:
    """(snp, sample, h1, h2) of a phasefile with cells a|b."""
    names, rows = _wide(spark, path)
    each = rows.select("snp", F.posexplode("cells").alias("c", "x")).select("snp", F.get(F.array(*map(F.lit, names)), F.col("c")).alias("sample"), F.split("x", r"\|").alias("h"))
    wrong = F.raise_error(F.concat(F.lit("not a phased genotype: "), F.array_join("h", "|"))).cast("int")
    cell = F.array_join("h", "|")
    part = lambda i: F.when(F.rlike(cell, F.lit(r"^[01]\|[01]$")), F.get("h", F.lit(i)).cast("int")).when(~cell.isin("NA", "NA|NA"), wrong)
    return each.select("snp", "sample", part(0).alias("h1"), part(1).alias("h2"))


def read_genetic_map(spark: SparkSession, path: str) -> DataFrame:
    """(position, rate, cm) of a map with header: position, cM/Mb, cM; space-separated, also gzip."""
    raw = spark.read.csv(path, sep=" ", header=True)
    return raw.select(*[F.col(c).cast(t).alias(n) for c, t, n in zip(raw.columns, ("long", "double", "double"), ("position", "rate", "cm"))])


def check_genetic_map(gmap: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """``gmap`` if its cM agree with its rates, else ValueError."""
    w = Window.orderBy("position")
    off = F.abs(F.lead("cm").over(w) - F.col("cm") - F.col("rate") * (F.lead("position").over(w) - F.col("position")) / 1e6)
    worst = gmap.select(off.alias("off")).agg(F.max("off")).first()[0]
    if worst is not None and worst > tolerance:
        raise ValueError(f"the map's cM and rates differ by {worst}")
    return gmap


def check_panel(spark: SparkSession, haps: str, legend: str, samples: str | None = None) -> None:
    """Raises ValueError if a panel's files don't fit together: the legend has columns id, position, a0, a1 and different positions in order; there is a row of
    haplotypes, of 0, 1 or -, for each of its rows; the sample file has columns ID, POP, GROUP, SEX and a row for each two haplotypes."""

    def need(right: bool, message: str) -> None:
        if not right:
            raise ValueError(message)

    lines = spark.read.text(legend).select(F.split("value", " ").alias("c"))
    need(lines.filter(F.col("c") == F.array(*map(F.lit, ("id", "position", "a0", "a1")))).count() == 1, f"{legend} has no header id position a0 a1")
    rows = lines.filter(F.get("c", F.lit(0)) != "id").select(F.expr("try_cast(get(c, 1) as long)").alias("pos"), F.get("c", F.lit(2)).alias("a0"), F.get("c", F.lit(3)).alias("a1"))
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pos").alias("positions"), F.count_if(F.col("a0").isNull() | F.col("a1").isNull()).alias("short")).first()
    need(n.n == n.positions, f"{legend} repeats positions, or some are no numbers")
    need(not n.short, f"{legend} has rows without alleles")
    cells = spark.read.text(haps).select(F.split("value", " ").alias("a"))
    h = cells.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("a")).alias("least"), F.max(F.size("a")).alias("most"), F.count_if(F.exists("a", lambda x: ~x.isin("0", "1", "-"))).alias("odd")).first()
    need(h.n == n.n, f"{haps} has {h.n} rows for {n.n} sites")
    need(h.least == h.most and h.most % 2 == 0, f"{haps} has rows of {h.least} to {h.most} haplotypes")
    need(not h.odd, f"{haps} holds other than 0, 1 and -")
    if samples is not None:
        people = spark.read.text(samples).select(F.split("value", " ").alias("s"))
        need(people.filter(F.col("s") == F.array(*map(F.lit, ("ID", "POP", "GROUP", "SEX")))).count() == 1, f"{samples} has no header ID POP GROUP SEX")
        k = people.count() - 1
        need(2 * k == h.most, f"{samples} has {k} samples for {h.most} haplotypes")


def read_panel(spark: SparkSession, haps: str, legend: str, samples: str | None = None, populations: list[str] | None = None, region: tuple[int, int] | None = None) -> DataFrame:
    """(hap, pos, ref, alt, allele) of a panel in three files; with ``populations``, of their samples alone, with ``region``, of the positions within. The - of a
    haploid male's second copy is left out."""
    site = F.split("value", " ")
    sites = numbered_lines(spark, legend).filter("n > 0").select((F.col("n") - 1).alias("n"), F.get(site, F.lit(1)).try_cast("long").alias("pos"), F.get(site, F.lit(2)).alias("ref"), F.get(site, F.lit(3)).alias("alt"))
    if region is not None:
        sites = sites.filter(F.col("pos").between(*region))
    each = numbered_lines(spark, haps).join(sites, "n").select(F.posexplode(F.split("value", " ")).alias("hap", "x"), "pos", "ref", "alt")
    if populations is not None:
        if samples is None:
            raise ValueError("populations need a sample file")
        people = numbered_lines(spark, samples).filter("n > 0").filter(F.get(F.split("value", " "), F.lit(1)).isin(*populations))
        kept = people.select(F.explode(F.array((2 * F.col("n") - 2).cast("int"), (2 * F.col("n") - 1).cast("int"))).alias("hap"))
        each = each.join(kept, "hap", "left_semi")
    return each.filter("x in ('0', '1')").select("hap", "pos", "ref", "alt", F.col("x").cast("int").alias("allele"))


def write_genetic_map(gmap: DataFrame, path: str) -> None:
    """A map (position, rate, cm) as ``read_genetic_map`` reads it, in parts by position, each with its header."""
    rows = gmap.select("position", F.col("rate").alias("COMBINED_rate(cM/Mb)"), F.col("cm").alias("Genetic_Map(cM)"))
    rows.repartitionByRange("position").sortWithinPartitions("position").write.csv(path, sep=" ", header=True)
