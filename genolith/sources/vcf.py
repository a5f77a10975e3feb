"""VCF text: panels, dosages, and the engine's outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def _lines(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """Sample names, and (chr, pos, id, ref, alt, info, format, cells) of the rows."""
    text = spark.read.text(path)
    head = text.filter(F.col("value").startswith("#CHROM")).first()
    if head is None:
        raise ValueError(f"{path} has no #CHROM line")
    f = F.split("value", "\t")
    rows = text.filter(~F.col("value").startswith("#")).select(f.alias("f"))
    get = lambda i: F.get("f", F.lit(i))
    return head.value.split("\t")[9:], rows.select(get(0).alias("chr"), get(1).cast("long").alias("pos"), get(2).alias("id"), get(3).alias("ref"), get(4).alias("alt"), get(7).alias("info"), F.split(get(8), ":").alias("format"), F.slice("f", 10, 1 << 30).alias("cells"))


def _field(name: str) -> Column:
    """A field of a cell x, by its place in the row's format; null if absent."""
    at = F.array_position("format", F.lit(name))
    return F.when(at > 0, F.get(F.split("x", ":"), (at - 1).cast("int")))


def read_dosages(spark: SparkSession, path: str) -> DataFrame:
    """(sample, chr, pos, ref, alt, ds): DS, else from GP, else from GT."""
    names, rows = _lines(spark, path)
    each = rows.select("chr", "pos", "ref", "alt", "format", F.posexplode("cells").alias("c", "x"))
    gp, gt = F.split(_field("GP"), ","), F.split(_field("GT"), r"[/|]")
    from_gp = F.get(gp, F.lit(1)).cast("double") + 2 * F.get(gp, F.lit(2)).cast("double")
    from_gt = F.when(~F.contains(_field("GT"), F.lit(".")), F.get(gt, F.lit(0)).cast("double") + F.get(gt, F.lit(1)).cast("double"))
    return each.select(F.get(F.array(*map(F.lit, names)), F.col("c")).alias("sample"), "chr", "pos", "ref", "alt", F.coalesce(_field("DS").cast("double"), from_gp, from_gt).alias("ds"))


def read_panel(spark: SparkSession, path: str, region: tuple[str, int, int] | None = None, samples: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """(hap, pos, ref, alt, allele) of a phased VCF, of a region (chr, first, last) if one is given, and of ``samples`` or all but those of ``without``; haplotypes are numbered by the columns
    of the file. Rows that aren't single-base, phased and complete, or repeat a position, are left out. ValueError for a sample that the file lacks."""
    names, rows = _lines(spark, path)
    odd = [s for s in [*(samples or []), *(without or [])] if s not in names]
    if odd:
        raise ValueError(f"{path} has no sample {odd[0]}")
    if region is not None:
        rows = rows.filter((F.col("chr") == region[0]) & F.col("pos").between(*region[1:]))
    kept = [i for i, s in enumerate(names) if (samples is None or s in samples) and s not in (without or [])]
    if len(kept) < len(names):
        rows = rows.withColumn("cells", F.array(*[F.get("cells", F.lit(i)) for i in kept]))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("chr", "pos").orderBy("ref", "alt"))).filter("n = 1")
    good = first.filter((F.length("ref") == 1) & (F.length("alt") == 1) & F.forall("cells", lambda x: F.rlike(x, F.lit(r"^[01]\|[01]"))))
    columns = F.array(*[F.lit(i) for i in kept]).cast("array<int>")
    each = good.select("pos", "ref", "alt", F.posexplode("cells").alias("c", "x")).withColumn("c", F.get(columns, F.col("c")))
    alleles = each.select("pos", "ref", "alt", "c", F.posexplode(F.array(F.substring("x", 1, 1), F.substring("x", 3, 1))).alias("h", "a"))
    return alleles.select((2 * F.col("c") + F.col("h")).alias("hap"), "pos", "ref", "alt", F.col("a").cast("int").alias("allele"))


def read_positions(spark: SparkSession, path: str, region: tuple[str, int, int] | None = None) -> DataFrame:
    """(chr, pos, ref, alt) of all rows of a VCF (of a region)."""
    rows = _lines(spark, path)[1].select("chr", "pos", "ref", "alt")
    return rows if region is None else rows.filter((F.col("chr") == region[0]) & F.col("pos").between(*region[1:]))


def info_value(info: Column, key: str) -> Column:
    return F.nullif(F.regexp_extract(info, rf"(?:^|;){key}=([^;]*)", 1), F.lit(""))


def header(samples: list[str], info: dict[str, str], cell: dict[str, str]) -> list[str]:
    lines = ["##fileformat=VCFv4.0"]
    lines += [f'##INFO=<ID={k},Number=.,Type=Float,Description="{v}">' for k, v in info.items()]
    lines += [f'##FORMAT=<ID={k},Number=.,Type=String,Description="{v}">' for k, v in cell.items()]
    return [*lines, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]


def write_vcf(cells: DataFrame, sites: DataFrame, info: DataFrame, form: str, path: str, descriptions: tuple[dict[str, str], dict[str, str]] = ({}, {}), missing: str = "./.") -> None:
    """A folder of text parts in order of position, with the header as a part of its own before them.

    ``cells`` is (sample, snp, cell), ``info`` is (snp, info). A site's cells are put in the order of samples by
    one aggregation; samples without a cell at a site get ``missing``.
    """
    spark = cells.sparkSession
    names = [r.sample for r in cells.select("sample").distinct().orderBy("sample").collect()]  # the header itself
    places = F.broadcast(spark.createDataFrame([(n, i) for i, n in enumerate(names)], f"sample {dict(cells.dtypes)['sample']}, i int"))
    row = cells.join(places, "sample").groupBy("snp").agg(F.array_sort(F.collect_list(F.struct("i", "cell"))).alias("c"))
    # Cells by place; gaps between them, before the first and after the last are filled with ``missing``.
    gap = lambda n: F.array_repeat(F.lit(missing), n)
    at = F.transform("c", lambda x, j: F.struct((x["i"] - F.when(j == 0, -1).otherwise(F.get(F.col("c.i"), j - 1)) - 1).alias("n"), x["cell"].alias("cell")))
    filled = F.concat(F.flatten(F.transform(at, lambda x: F.array_append(gap(x["n"]), x["cell"]))), gap(len(names) - 1 - F.element_at("c.i", -1)))
    line = F.array_join(filled, "\t")
    text = sites.join(row, "snp").join(info, "snp").select("chr", "pos", F.concat_ws("\t", "chr", F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("."), F.lit("PASS"), "info", F.lit(form), line).alias("value"))
    text.repartitionByRange("chr", "pos").sortWithinPartitions("chr", "pos").select("value").write.option("compression", "gzip").text(f"{path}/rows")
    spark.createDataFrame([(x,) for x in header([str(n) for n in names], *descriptions)], "value string").coalesce(1).write.option("compression", "gzip").text(f"{path}/header")


def write_site_statistics(stats: DataFrame, path: str) -> None:
    """One row a site, tab-separated, gzip."""
    stats.write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)
