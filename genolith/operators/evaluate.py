"""Accuracy against truth: correlations, allele flips, concordance by frequency, phase switches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hwe import hwe_p

#: Upper bounds of the frequency bins.
BINS = (0.01, 0.05, 0.1, 0.2, 0.5)


def correlation(x: Column, y: Column) -> Column:
    """The correlation of pairs without nulls; null where either doesn't vary. (``F.corr`` divides by zero there, also inside a condition that asks first.)"""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def squared_correlation(pairs: DataFrame, *by: str) -> DataFrame:
    """r2 of g (truth) and ds (dosage) by the given columns; null with fewer than two distinct values of either."""
    spread = (F.min("g") != F.max("g")) & (F.min("ds") != F.max("ds"))
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(spread, F.pow(correlation(F.col("g"), F.col("ds")), 2)).alias("r2"))


def flip_join(truth: DataFrame, dosages: DataFrame) -> DataFrame:
    """Truth (sample, pos, ref, alt, g) with dosages (sample, pos, ref, alt, ds); where only the swapped alleles match, the
    truth counts the other allele. (sample, pos, g, ds, flipped)"""
    same = dosages.select("sample", "pos", F.col("ref").alias("r"), F.col("alt").alias("a"), "ds")
    both = truth.join(same, ["sample", "pos"]).withColumn("flipped", (F.col("ref") == F.col("a")) & (F.col("alt") == F.col("r")))
    right = both.filter(F.col("flipped") | ((F.col("ref") == F.col("r")) & (F.col("alt") == F.col("a"))))
    return right.select("sample", "pos", F.when(F.col("flipped"), 2 - F.col("g")).otherwise(F.col("g")).alias("g"), "ds", "flipped")


def by_frequency(pairs: DataFrame) -> DataFrame:
    """(bin, n, concordance, r2) of pairs (g, ds, maf): bin is the upper bound of the minor allele frequency."""
    upper = F.lit(None).cast("double")
    for b in reversed(BINS):
        upper = F.when(F.col("maf") <= b, F.lit(b)).otherwise(upper)
    binned = pairs.withColumn("bin", upper)
    own = squared_correlation(binned, "bin")
    agree = binned.groupBy("bin").agg(F.avg((F.bround("ds", 0) == F.col("g")).cast("double")).alias("concordance"))
    return own.join(agree, "bin").select("bin", "n", "concordance", "r2")


def phase_switches(phases: DataFrame) -> DataFrame:
    """(sample, sites, switches, error) of phases (sample, pos, t1, t2, h1): sites heterozygous in truth, ordered; a switch is
    a change of whether the first haplotype agrees with truth."""
    het = phases.filter(F.col("t1") + F.col("t2") == 1).withColumn("off", (F.col("h1") != F.col("t1")).cast("int"))
    w = Window.partitionBy("sample").orderBy("pos")
    changed = het.withColumn("c", (F.col("off") != F.lag("off").over(w)).cast("int"))
    sums = changed.groupBy("sample").agg(F.count(F.lit(1)).alias("sites"), F.coalesce(F.sum("c"), F.lit(0)).alias("switches"))
    return sums.select("sample", "sites", "switches", F.when(F.col("sites") > 1, F.col("switches") / (F.col("sites") - 1)).alias("error"))


def usable_calls(calls: DataFrame, missing: float = 0.05, least_hwe: float | None = None) -> DataFrame:
    """Sites (snp, n) of calls (snp, g) of which at most a share of ``missing`` is null and whose genotypes are, by the exact test, no less likely than ``least_hwe``."""
    counts = [F.count_if(F.col("g") == i).alias(f"n{i}") for i in range(3)]
    sites = calls.groupBy("snp").agg(F.avg(F.col("g").isNull().cast("double")).alias("m"), F.count(F.lit(1)).alias("n"), *counts).filter(F.col("m") <= missing)
    if least_hwe is not None:
        sites = sites.filter(hwe_p("n0", "n1", "n2") >= least_hwe)
    return sites.select("snp", "n")


def phase_switches_without_doubles(phases: DataFrame) -> DataFrame:
    """(sample, sites, switches, discordant): as ``phase_switches``, but a single site that is off between two that agree with each other counts as
    discordant and not as two switches."""
    het = phases.filter(F.col("t1") + F.col("t2") == 1).withColumn("off", (F.col("h1") != F.col("t1")).cast("int"))
    w = Window.partitionBy("sample").orderBy("pos")
    alone = (F.lag("off").over(w) == F.lead("off").over(w)) & (F.col("off") != F.lag("off").over(w))
    marked = het.withColumn("alone", F.coalesce(alone, F.lit(False)))
    # Of alternating runs, each second site stands for the discordant ones.
    run = marked.withColumn("odd", F.col("alone") & ~F.coalesce(F.lag("alone").over(w), F.lit(False)))
    kept = run.filter("not odd").withColumn("c", (F.col("off") != F.lag("off").over(w)).cast("int"))
    switches = kept.groupBy("sample").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("switches"))
    return run.groupBy("sample").agg(F.count(F.lit(1)).alias("sites"), F.count_if("odd").alias("discordant")).join(switches, "sample").select("sample", "sites", "switches", "discordant")


def panel_agreement(counts: DataFrame, panel: DataFrame) -> DataFrame:
    """One row: correlations of the pileup's allele frequencies (snp, af) with those of a panel (hap, snp, allele): over all sites of both (r), those with
    a pileup frequency from 5 to 95 % (common), and the others (rare)."""
    both = counts.select("snp", "af").join(panel.groupBy("snp").agg(F.avg("allele").alias("ref")), "snp")
    inside = (F.col("af") > 0.05) & (F.col("af") < 0.95)
    outside = (F.col("af") < 0.05) | (F.col("af") > 0.95)
    r = lambda where: F.when(F.count_if(where) > 1, correlation(F.when(where, F.col("af")), F.when(where, F.col("ref"))))
    return both.agg(F.count(F.lit(1)).alias("n"), correlation(F.col("af"), F.col("ref")).alias("r"), r(inside).alias("common"), r(outside).alias("rare"))
