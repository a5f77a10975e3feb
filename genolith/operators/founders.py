"""Repair of founders as tables: stretches in which a founder is hardly used get another's alleles.

Usage is (k, grid, v), grids are (grid, pos). All windows are by founder or by stretch: a founder has a row for each bin of some
thousand bases, and a stretch one for each founder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.draws import uniform


def binned_usage(usage: DataFrame, grids: DataFrame, width: int = 5000) -> DataFrame:
    """(k, i, bin, first, last, mean): mean usage over the grids first..last of each bin of ``width`` bases that holds any; i numbers bins from 1."""
    placed = grids.select("grid", F.floor(F.col("pos") / width).cast("long").alias("bin"))
    per = usage.join(placed, "grid").groupBy("k", "bin").agg(F.min("grid").alias("first"), F.max("grid").alias("last"), F.avg("v").alias("mean"))
    return per.select("k", F.row_number().over(Window.partitionBy("k").orderBy("bin")).alias("i"), "bin", "first", "last", "mean")


def weak_runs(binned: DataFrame, least: Column | float) -> DataFrame:
    """(k, a, b, first, last): stretches of neighbouring bins a..b, grids first..last, in which founder k is used less than ``least``."""
    weak = binned.filter(F.col("mean") < least)
    island = F.col("i") - F.row_number().over(Window.partitionBy("k").orderBy("i"))
    runs = weak.withColumn("island", island).groupBy("k", "island")
    return runs.agg(F.min("i").alias("a"), F.max("i").alias("b"), F.min("first").alias("first"), F.max("last").alias("last")).drop("island")


def donors(binned: DataFrame, runs: DataFrame, seed: int = 0) -> DataFrame:
    """``runs`` with donor: another founder, drawn in proportion to its usage over the run (the bins' means, summed). Runs in which no other is used have none, and go.

    Sums over a run are differences of running sums at its ends, so that a run meets a founder's rows twice, however long it is.
    """
    past = binned.select(F.col("k").alias("j"), "i", F.sum("mean").over(Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).alias("past"))
    ends = runs.join(past.withColumnRenamed("i", "b"), "b").filter("j != k")
    starts = past.select("j", (F.col("i") + 1).alias("a"), F.col("past").alias("before"))
    weighed = ends.join(starts, ["j", "a"], "left").withColumn("w", F.greatest(F.col("past") - F.coalesce("before", F.lit(0.0)), F.lit(0.0)))
    own = Window.partitionBy("k", "a")
    reached = F.sum("w").over(own.orderBy("j").rowsBetween(Window.unboundedPreceding, 0))
    asked = weighed.select("*", reached.alias("reached"), (uniform(seed, "k", "a") * F.sum("w").over(own)).alias("point"))
    return asked.filter("w > 0 and reached > point").groupBy("k", "a", "b", "first", "last").agg(F.min("j").alias("donor"))


def refilled(alleles: DataFrame, plan: DataFrame) -> DataFrame:
    """``alleles`` (k, snp, grid, p) in which the stretches of ``plan`` (k, first, last, donor) hold the donors' p, as it was before."""
    spots = plan.select("k", F.explode(F.sequence("first", "last")).alias("grid"), "donor")
    given = alleles.select(F.col("k").alias("donor"), "snp", F.col("p").alias("given"))
    changed = alleles.join(spots, ["k", "grid"], "left").join(given, ["donor", "snp"], "left")
    return changed.select("k", "snp", "grid", F.coalesce("given", "p").alias("p"))


def refill_plan(usage: DataFrame, grids: DataFrame, samples: int, founders: int, width: int = 5000, seed: int = 0) -> DataFrame:
    """(k, first, last, donor) for stretches in which a founder has less than a tenth of an even share, and less than a hundredth of all samples."""
    binned = binned_usage(usage, grids, width)
    return donors(binned, weak_runs(binned, samples * min(1 / (10 * founders), 1 / 100)), seed).select("k", "first", "last", "donor")
