"""Haplotypes packed into 32-bit words, bit i of a word for site 32 * word + i."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

WORD = 32
#: Sites that are numbered together.
RANGE = 1 << 16


def pack(panel: DataFrame, hap: str = "hap", snp: str = "snp", allele: str = "allele") -> DataFrame:
    """(hap, block, bits) of a long panel; bits is a signed 32-bit integer."""
    bit = F.col(allele) * F.pow(F.lit(2.0), F.col(snp) % WORD).cast("long")
    return panel.groupBy(hap, F.floor(F.col(snp) / WORD).cast("int").alias("block")).agg(F.sum(bit).alias("__w")).select(hap, "block", signed("__w").alias("bits"))


def signed(word: str) -> Column:
    return F.when(F.col(word) >= 1 << 31, F.col(word) - (1 << 32)).otherwise(F.col(word)).cast("int")


def unpack(packed: DataFrame, n_sites: int | None, hap: str = "hap") -> DataFrame:
    """(hap, snp, allele) of packed words, of the first ``n_sites`` sites if given."""
    each = packed.select(hap, "block", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.bit_get(F.col("bits"), i).cast("int"))).alias("i", "allele"))
    sites = each.select(hap, (F.col("block") * WORD + F.col("i")).alias("snp"), "allele")
    return sites if n_sites is None else sites.filter(F.col("snp") < n_sites)


def distances(packed: DataFrame, other: DataFrame, hap: str = "hap") -> DataFrame:
    """(hap, distance): sites at which each packed haplotype differs from ``other`` (block, bits), a single haplotype; a word that either
    lacks is 0."""
    ones = lambda c: F.bit_count(F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)))
    theirs = other.select("block", F.col("bits").alias("__o"))
    total = theirs.agg(F.coalesce(F.sum(ones("__o")), F.lit(0)).alias("__t"))
    both = packed.join(theirs, "block", "left").select(hap, ones("bits").alias("__a"), F.coalesce(F.bit_count(F.col("bits").bitwiseAND(F.col("__o")).bitwiseAND(F.lit(0xFFFFFFFF))), F.lit(0)).alias("__b"))
    return both.groupBy(hap).agg((F.sum("__a") - 2 * F.sum("__b")).alias("__d")).crossJoin(F.broadcast(total)).select(hap, (F.col("__d") + F.col("__t")).cast("long").alias("distance"))  # one row


def dictionary(packed: DataFrame, most: int) -> DataFrame:
    """(hap, block, code): words by rank of their number of haplotypes in a block (ties: lesser word first), from 1;
    0 for words beyond the ``most`` commonest, which are to be stored as exceptions."""
    counts = packed.groupBy("block", "bits").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("code", F.row_number().over(Window.partitionBy("block").orderBy(F.desc("n"), "bits"))).filter(F.col("code") <= most)
    return packed.join(ranked.select("block", "bits", "code"), ["block", "bits"], "left").select("hap", "block", F.coalesce("code", F.lit(0)).alias("code"))


def coverage(haplotypes: int) -> float:
    """The share of words that a dictionary should hold, for a panel of so many haplotypes."""
    return 0.9999 if haplotypes > 50_000 else 0.9995 if haplotypes > 10_000 else 0.999 if haplotypes > 1000 else 0.99


def symbols(packed: DataFrame) -> DataFrame:
    """(block, bits, code, n): the words of each block, numbered from 1 in the order of their last site, then the one before, and so on: as unsigned numbers."""
    counts = packed.groupBy("block", "bits").agg(F.count(F.lit(1)).alias("n"))
    unsigned = F.col("bits").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    return counts.select("block", "bits", F.row_number().over(Window.partitionBy("block").orderBy(unsigned)).alias("code"), "n")


def dictionary_size(numbered: DataFrame, haplotypes: int, least: int = 15, most: int = 1023) -> int:
    """How many ``symbols`` of a block to keep: the fewest codes that cover enough of all words of all blocks, within ``least``..``most``."""
    by_code = numbered.groupBy("code").agg(F.sum("n").alias("n"))
    total = by_code.agg(F.sum("n")).first()[0] or 0
    past, counts = 0, by_code.filter(F.col("code") <= most).orderBy("code").collect()  # ``most`` rows
    for r in counts:
        past += r.n
        if past > coverage(haplotypes) * total:
            return min(max(least, r.code), most)
    return min(max(least, len(counts)), most)


def encoded(packed: DataFrame, numbered: DataFrame, size: int) -> DataFrame:
    """(hap, block, code, exception): code 0 stands for a word that the dictionary lacks, which is kept as it is."""
    known = numbered.filter(F.col("code") <= size).select("block", "bits", "code")
    both = packed.join(known, ["block", "bits"], "left")
    return both.select("hap", "block", F.coalesce("code", F.lit(0)).alias("code"), F.when(F.col("code").isNull(), F.col("bits")).alias("exception"))


def decoded(codes: DataFrame, numbered: DataFrame) -> DataFrame:
    """(hap, block, bits) of ``encoded`` rows."""
    both = codes.join(numbered.select("block", "code", "bits"), ["block", "code"], "left")
    return both.select("hap", "block", F.coalesce("exception", "bits").alias("bits"))


def symbol_counts(numbered: DataFrame, size: int) -> DataFrame:
    """(block, code, bits, n): the dictionary of each block; where it lacks words, one entry more with the first word and the number of those lacking."""
    kept = numbered.filter(F.col("code") <= size).select("block", "code", "bits", "n")
    first = numbered.filter("code = 1").select("block", F.col("bits").alias("first"))
    rest = numbered.filter(F.col("code") > size).groupBy("block").agg(F.sum("n").alias("n")).join(first, "block")
    return kept.unionByName(rest.select("block", F.lit(size + 1).alias("code"), F.col("first").alias("bits"), "n"))


def site_counts(panel: DataFrame, cutoff: float) -> DataFrame:
    """(snp, alt, n, af, common, i) of a long panel (hap, snp, allele): i numbers the common sites (af of ``cutoff`` or more), and is null at rare ones."""
    counts = panel.groupBy("snp").agg(F.sum("allele").cast("long").alias("alt"), F.count(F.lit(1)).alias("n"))
    whole = counts.select("snp", "alt", "n", (F.col("alt") / F.col("n")).alias("af")).withColumn("common", F.col("af") >= cutoff)
    # Numbers within a range of sites, and how many common ones are in the ranges before: a row for each range.
    ranged = whole.withColumn("__range", F.floor(F.col("snp") / RANGE))
    ranges = ranged.groupBy("__range").agg(F.sum(F.col("common").cast("long")).alias("__own"))
    before = ranges.select("__range", (F.sum("__own").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__own")).alias("__before"))
    past = F.sum(F.col("common").cast("long")).over(Window.partitionBy("__range").orderBy("snp").rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("__past", past).join(before, "__range").select("snp", "alt", "n", "af", "common", F.when(F.col("common"), F.col("__before") + F.col("__past") - 1).alias("i"))


def split_panel(panel: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(common, rare): packed words (hap, block, bits) of the common ``sites`` (as of ``site_counts``) by their number, and for each haplotype the rare sites (hap, snps) whose
    alternative allele it carries."""
    both = panel.join(sites.select("snp", "common", "i"), "snp")
    common = pack(both.filter("common").select("hap", F.col("i").alias("snp"), "allele"))
    rare = both.filter(~F.col("common") & (F.col("allele") == 1)).groupBy("hap").agg(F.array_sort(F.collect_list("snp")).alias("snps"))
    return common, rare


def joined_panel(common: DataFrame, rare: DataFrame, sites: DataFrame, haps: DataFrame) -> DataFrame:
    """(hap, snp, allele): the long panel of all ``haps`` at all ``sites``, from its two parts."""
    of_common = unpack(common, None).withColumnRenamed("snp", "i").join(sites.filter("common").select("snp", "i"), "i").select("hap", "snp", "allele")
    carried = rare.select("hap", F.explode("snps").alias("snp"), F.lit(1).alias("carried"))
    at_rare = haps.select("hap").crossJoin(sites.filter(~F.col("common")).select("snp")).join(carried, ["hap", "snp"], "left")  # the panel itself has a row for each
    return of_common.unionByName(at_rare.select("hap", "snp", F.coalesce("carried", F.lit(0)).alias("allele")))
