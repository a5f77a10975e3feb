"""Splitting of reads that recombine between founders, and cuts of reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .pileup import with_probs


def between(reads: DataFrame, first: int, last: int) -> DataFrame:
    """Reads (snp, bq arrays) cut to their sites number ``first`` to ``last``, from 0; those without any go."""
    cut = lambda c: F.slice(c, first + 1, last - first + 1)
    return reads.filter(F.size("snp") > first).withColumns({"snp": cut("snp"), "bq": cut("bq")})


def _seen(p: Column) -> Column:
    """The likelihood of an observation of a founder that carries the alternative allele with probability ``p``."""
    return p * F.col("pa") + (1 - p) * F.col("pr")


def suspects(observations: DataFrame, founders: DataFrame, least: int = 4) -> DataFrame:
    """(sample, read) of reads of at least ``least`` observations that are likelier if all alleles are even than under any founder (k, snp, p)."""
    each = with_probs(observations)
    even = each.groupBy("sample", "read").agg(F.count(F.lit(1)).alias("n"), F.sum(F.log((F.col("pa") + F.col("pr")) / 2)).alias("even"))
    own = each.join(founders, "snp").groupBy("sample", "read", "k").agg(F.sum(F.log(_seen(F.col("p")))).alias("l")).groupBy("sample", "read").agg(F.max("l").alias("best"))
    return even.filter(F.col("n") >= least).join(own, ["sample", "read"]).filter("even > best").select("sample", "read")


def split_places(observations: DataFrame, founders: DataFrame, centred: DataFrame, posteriors: DataFrame, reach: int = 10) -> DataFrame:
    """(sample, read, left): how many observations of each suspect read, in the order of sites, are left of its split. The first and last reads of
    a sample stay whole.

    ``centred`` (sample, read, central, grid) are all reads, ``posteriors`` (sample, grid, gamma) the founders' by grid. The founder left of the split is the
    one that loses most between the reads ``reach`` before and ``reach`` after, that on the right the one that gains most; the split is
    where the likelihoods of the observations, summed, are greatest.
    """
    w = Window.partitionBy("sample").orderBy("central", "read")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = centred.select(
        "sample", "read", F.row_number().over(w).alias("i"), F.count(F.lit(1)).over(whole).alias("n"),
        F.coalesce(F.lag("grid", reach).over(w), F.first("grid").over(whole)).alias("before"), F.coalesce(F.lead("grid", reach).over(w), F.last("grid").over(whole)).alias("after"),
    )
    asked = near.filter("i > 1 and i < n").join(suspects(observations, founders), ["sample", "read"])
    at = lambda name: posteriors.select("sample", F.col("grid").alias(name), F.col("gamma").alias(f"{name}_gamma"))
    moved = F.zip_with("after_gamma", "before_gamma", lambda a, b: a - b)
    both = asked.join(at("before"), ["sample", "before"]).join(at("after"), ["sample", "after"]).withColumn("moved", moved)
    place = lambda extreme: (F.array_position("moved", extreme("moved")) - 1).cast("int")
    turned = both.select("sample", "read", place(F.array_min).alias("from"), place(F.array_max).alias("to"))
    of = lambda name: founders.select("snp", F.col("k").alias(name), F.col("p").alias(f"p_{name}"))
    each = with_probs(observations).join(turned, ["sample", "read"]).join(of("from"), ["snp", "from"]).join(of("to"), ["snp", "to"])
    order = Window.partitionBy("sample", "read").orderBy("snp", "bq")
    past, every = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("sample", "read")
    right = _seen(F.col("p_to"))
    z = F.sum(_seen(F.col("p_from"))).over(past) + F.sum(right).over(every) - F.sum(right).over(past)
    tried = each.select("sample", "read", F.row_number().over(order).alias("left"), F.count(F.lit(1)).over(every).alias("all"), F.bround(z, 9).alias("z")).filter("left < all")
    return tried.groupBy("sample", "read").agg(F.max_by("left", F.struct("z", -F.col("left"))).cast("long").alias("left"))


def split_reads(observations: DataFrame, places: DataFrame) -> DataFrame:
    """``observations`` with the right parts of split reads as reads of their own."""
    order = Window.partitionBy("sample", "read").orderBy("snp", "bq")
    numbered = observations.withColumn("__i", F.row_number().over(order)).join(places, ["sample", "read"], "left")
    own = F.when(F.col("__i") > F.col("left"), F.xxhash64("read", F.lit("right"))).otherwise(F.col("read"))
    return numbered.withColumn("read", own).select(*observations.columns)
