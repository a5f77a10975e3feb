"""Aggregates over observations: allele counts, genotype likelihoods, summaries of posteriors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.phred import alt_prob, best_call, posteriors, ref_prob
from .spread import meeting


def with_probs(observations: DataFrame) -> DataFrame:
    return observations.select("*", ref_prob(F.col("bq")).alias("pr"), alt_prob(F.col("bq")).alias("pa"))


def allele_counts(observations: DataFrame, sites: DataFrame) -> DataFrame:
    """(snp, alt, total, af) of each site: weight of the alternative allele, of both, and their ratio (0 without reads)."""
    sums = with_probs(observations).groupBy("snp").agg(F.sum("pa").alias("alt"), F.sum(F.col("pa") + F.col("pr")).alias("total"))
    return sites.select("snp").join(sums, "snp", "left").select("snp", F.coalesce("alt", F.lit(0.0)).alias("alt"), F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce(F.col("alt") / F.col("total"), F.lit(0.0)).alias("af"))


def likelihoods(observations: DataFrame) -> DataFrame:
    """(sample, snp, l0, l1, l2, ad0, ad1): log likelihoods of 0, 1, 2 alternative alleles, depths of both alleles."""
    p = with_probs(observations)
    return p.groupBy("sample", "snp").agg(
        F.sum(F.log("pr")).alias("l0"), F.sum(F.log((F.col("pr") + F.col("pa")) / 2)).alias("l1"), F.sum(F.log("pa")).alias("l2"),
        F.count_if(F.col("bq") < 0).alias("ad0"), F.count_if(F.col("bq") > 0).alias("ad1"),
    )


def posterior_table(observations: DataFrame) -> DataFrame:
    """(sample, snp, ad0, ad1, g0, g1, g2) under a flat prior."""
    gp = posteriors([F.col(f"l{i}") for i in range(3)])
    return likelihoods(observations).select("sample", "snp", "ad0", "ad1", *[g.alias(f"g{i}") for i, g in enumerate(gp)])


def site_summary(post: DataFrame) -> DataFrame:
    """(snp, n, eaf, info, hom_ref, het, hom_alt): allele frequency and information of posteriors, hard calls.

    Information is 1 - sum(f - e^2) / (2 n t (1 - t)) with dosages e and second moments f rounded to 3 digits half to
    even, t = mean dosage / 2; 1 where t rounds to 0 or 1, at least 0.
    """
    e, f = F.bround(F.col("g1") + 2 * F.col("g2"), 3), F.bround(F.col("g1") + 4 * F.col("g2"), 3)
    call = best_call([F.col("g0"), F.col("g1"), F.col("g2")])
    sums = post.groupBy("snp").agg(
        F.count(F.lit(1)).alias("n"), F.sum(e).alias("e"), F.sum(f - e * e).alias("v"),
        *[F.count_if(call == i).alias(x) for i, x in enumerate(("hom_ref", "het", "hom_alt"))],
    )
    return of_sums(sums)


def of_sums(sums: DataFrame) -> DataFrame:
    """The columns of ``site_summary`` from its sums (snp, n, e, v, hom_ref, het, hom_alt)."""
    t = F.col("e") / (2 * F.col("n"))
    info = F.when(F.bround(t, 2).isin(0.0, 1.0), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("v") / (2 * F.col("n") * t * (1 - t))))
    return sums.select("snp", "n", t.alias("eaf"), info.alias("info"), "hom_ref", "het", "hom_alt")


def read_emissions(observations: DataFrame, founders: DataFrame, floor: float = 1000.0, parts: int | None = None) -> DataFrame:
    """(sample, read, k, e): likelihood of a read under each founder (k, snp, p), over the greatest, at least 1/floor. Sites and then reads are dealt over ``parts``
    partitions, if these are given."""
    from pyspark.sql import Window

    each = meeting(with_probs(observations), founders, parts, "snp", "sample", "read").groupBy("sample", "read", "k").agg(F.sum(F.log(F.col("p") * F.col("pa") + (1 - F.col("p")) * F.col("pr"))).alias("l"))
    top = F.max("l").over(Window.partitionBy("sample", "read"))
    return each.select("sample", "read", "k", F.greatest(F.exp(F.col("l") - top), F.lit(1 / floor)).alias("e"))


def diploid_emissions(read_emission: DataFrame, central: DataFrame, floor: float = 1e10) -> DataFrame:
    """(sample, snp, k1, k2, e): product over a site's reads of the mean emission of two founders, scaled likewise."""
    from pyspark.sql import Window

    # A read's founders are one array, which has the partitioning of its emissions; pairs come from that.
    own = read_emission.groupBy("sample", "read").agg(F.collect_list(F.struct("k", "e")).alias("x"))
    pairs = F.flatten(F.transform("x", lambda a: F.transform("x", lambda b: F.struct(a["k"].alias("k1"), b["k"].alias("k2"), F.log((a["e"] + b["e"]) / 2).alias("l")))))
    placed = own.join(central.select("sample", "read", F.col("central").alias("snp")), ["sample", "read"])
    each = placed.select("sample", "snp", F.explode(pairs).alias("p")).groupBy("sample", "snp", "p.k1", "p.k2").agg(F.sum("p.l").alias("l"))
    top = F.max("l").over(Window.partitionBy("sample", "snp"))
    return each.select("sample", "snp", "k1", "k2", F.greatest(F.exp(F.col("l") - top), F.lit(1 / floor)).alias("e"))


def read_proportions(observations: DataFrame, read_emission: DataFrame) -> DataFrame:
    """(snp, k, ref, alt): expected numbers of reads of each founder at each site, by allele; a read is shared among founders by
    its likelihoods."""
    from pyspark.sql import Window

    share = F.col("e") / F.sum("e").over(Window.partitionBy("sample", "read"))
    shared = read_emission.select("sample", "read", "k", share.alias("w"))
    return observations.join(shared, ["sample", "read"]).groupBy("snp", "k").agg(F.sum(F.when(F.col("bq") < 0, F.col("w")).otherwise(0.0)).alias("ref"), F.sum(F.when(F.col("bq") > 0, F.col("w")).otherwise(0.0)).alias("alt"))
