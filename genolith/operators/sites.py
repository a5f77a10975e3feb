"""Ordered operators over sites: regions, grids, genetic maps, smoothing, output blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .chains import cut, next_above, picked, reached


def _by(order: Column | str):
    """Sites of one chromosome are ordered together; chromosomes are apart."""
    return Window.partitionBy("chr").orderBy(order)


def region(sites: DataFrame, start: int, end: int, buffer: int) -> DataFrame:
    """Sites within ``buffer`` of start..end, numbered anew (i, from 0), with central (in the region itself)."""
    near = sites.filter(F.col("pos").between(start - buffer, end + buffer))
    return near.select("*", (F.row_number().over(_by("pos")) - 1).alias("i"), F.col("pos").between(start, end).alias("central"))


def validate(sites: DataFrame) -> DataFrame:
    """One row: n, chromosomes, and how many sites break a rule: unordered, bad_base, same_base."""
    step = F.col("pos") - F.lag("pos").over(_by("snp"))
    return sites.withColumn("__d", step).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("chr").alias("chromosomes"), F.count_if(F.col("__d") <= 0).alias("unordered"),
        F.count_if(~F.col("ref").isin(*"ACGT") | ~F.col("alt").isin(*"ACGT")).alias("bad_base"), F.count_if(F.col("ref") == F.col("alt")).alias("same_base"),
    )


def grid(sites: DataFrame, width: int) -> DataFrame:
    """(chr, snp, pos, grid, centre): windows of ``width`` bases that hold sites, numbered from 0."""
    cell = F.ceil(F.col("pos") / width)
    return sites.select("chr", "snp", "pos", (F.dense_rank().over(_by(cell)) - 1).cast("long").alias("grid"), (width * (cell - 0.5)).alias("centre"))


def grid_meta(gridded: DataFrame) -> DataFrame:
    """(chr, grid, centre, first, last, dist_next) of each grid."""
    g = gridded.groupBy("chr", "grid", "centre").agg(F.min("snp").alias("first"), F.max("snp").alias("last"))
    return g.withColumn("dist_next", F.lead("centre").over(_by("grid")) - F.col("centre"))


def cumulate(gmap: DataFrame) -> DataFrame:
    """A map (chr, position, rate in cM/Mb) with cm: the running sum of rate times distance, first 0."""
    w = _by("position")
    step = F.coalesce(F.lag("rate").over(w) * (F.col("position") - F.lag("position").over(w)) / 1e6, F.lit(0.0))
    return gmap.withColumn("__d", step).withColumn("cm", F.sum("__d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__d")


def interpolate(gmap: DataFrame, sites: DataFrame, rate: float = 0.5) -> DataFrame:
    """(chr, snp, pos, cm): the map (chr, position, cm) at the sites, linear between its points, ``rate`` beyond its ends."""
    every = sites.select("chr", "snp", "pos", F.lit(None).cast("double").alias("cm")).unionByName(gmap.select("chr", F.lit(None).cast("long").alias("snp"), F.col("position").alias("pos"), "cm"))
    up = Window.partitionBy("chr").orderBy("pos", F.col("snp").asc_nulls_first())
    down = Window.partitionBy("chr").orderBy(F.desc("pos"), F.col("snp").desc_nulls_last())
    known = F.when(F.col("cm").isNotNull(), F.struct("pos", "cm"))
    # Both look back, one in each order: a running value, where a look ahead would begin anew at each row.
    last = lambda w: F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    filled = every.withColumn("a", last(up)).withColumn("b", last(down))
    between = F.col("a.cm") + (F.col("b.cm") - F.col("a.cm")) * (F.col("pos") - F.col("a.pos")) / (F.col("b.pos") - F.col("a.pos"))
    cm = F.when(F.col("a").isNull(), F.col("b.cm") - rate * (F.col("b.pos") - F.col("pos")) / 1e6).when(F.col("b").isNull(), F.col("a.cm") + rate * (F.col("pos") - F.col("a.pos")) / 1e6).when(F.col("a.pos") == F.col("pos"), F.col("a.cm")).otherwise(between)
    return filled.filter("snp is not null").select("chr", "snp", "pos", cm.alias("cm"))


def no_switch(cm_step: Column, n_gen: float) -> Column:
    """P(no recombination) over a step of the map in cM."""
    return F.exp(-n_gen * cm_step / 100)


def map_rates(gmap: DataFrame) -> DataFrame:
    """A map (chr, position, cm) with rate in cM/Mb to the next point, 0 at the last."""
    w = _by("position")
    step = (F.lead("cm").over(w) - F.col("cm")) / ((F.lead("position").over(w) - F.col("position")) / 1e6)
    return gmap.withColumn("rate", F.coalesce(step, F.lit(0.0)))


def constant_map(sites: DataFrame, rate: float) -> DataFrame:
    """(chr, position, rate, cm) of a map of one rate at the sites."""
    w = _by("pos")
    last = F.lead("pos").over(w).isNull()
    return sites.select("chr", F.col("pos").alias("position"), F.when(last, 0.0).otherwise(rate).alias("rate"), (rate * (F.col("pos") - F.min("pos").over(Window.partitionBy("chr"))) / 1e6).alias("cm"))


def adaptive_grid(mapped: DataFrame, most: float) -> DataFrame:
    """(chr, snp, grid) of sites (chr, snp, pos, cm): a grid begins where more than ``most`` cM have passed since its own
    begin. Each begin depends on the one before: they are found by following the chain of next begins."""
    w = _by("pos")
    placed = mapped.select("chr", "snp", "pos", "cm", F.row_number().over(w).cast("long").alias("i"))
    placed = cut(placed)
    begins = reached(next_above(placed, "cm", F.col("cm") + most, "i", strictly=True), placed.filter("i = 1").select("chr", F.col("i").alias("node")))
    flagged = placed.join(begins.select("chr", F.col("node").alias("i"), F.lit(1).alias("begins")), ["chr", "i"], "left")
    return flagged.select("chr", "snp", (F.count("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long").alias("grid"))


def sigma(mapped: DataFrame, n_gen: float) -> DataFrame:
    """(chr, snp, sigma, t0, t1, t2): P(no switch) to the next site, and the diploid chances of 0, 1, 2 switches."""
    step = F.lead("cm").over(_by("pos")) - F.col("cm")
    x = mapped.withColumn("sigma", no_switch(step, n_gen)).filter("sigma is not null")
    s = F.col("sigma")
    return x.select("chr", "snp", s, (s * s).alias("t0"), (s * (1 - s)).alias("t1"), ((1 - s) * (1 - s)).alias("t2"))


#: Bases of a stretch whose sites are ordered together where no more than the neighbours of a site are asked for.
STRETCH = 1 << 20


def with_next(sites: DataFrame, name: str) -> DataFrame:
    """``sites`` with the position of the one after (null at a chromosome's last) as ``name``. Sites are ordered within stretches; at the end of one, the first position of the
    next that has any is looked up."""
    placed = sites.withColumn("__s", F.floor(F.col("pos") / STRETCH))
    firsts = placed.groupBy("chr", "__s").agg(F.min("pos").alias("__first"))
    after = firsts.select("chr", "__s", F.lead("__first").over(_by("__s")).alias("__after"))
    inside = F.lead("pos").over(Window.partitionBy("chr", "__s").orderBy("pos"))
    return placed.withColumn("__in", inside).join(after, ["chr", "__s"]).select(*sites.columns, F.coalesce("__in", "__after").alias(name))


def smooth(steps: DataFrame, radius: int) -> DataFrame:
    """(chr, mid, smoothed) of steps (chr, start, end, rate): around each step's middle (integer), the mean rate
    within ``radius``, weighted by overlap. Ranges meet on bins as wide as twice the radius."""
    mid = F.floor((F.col("start") + F.col("end")) / 2).cast("long")
    around = steps.select("chr", mid.alias("mid")).select("*", (F.col("mid") - radius).alias("lo"), (F.col("mid") + radius).alias("hi"))
    width = 2 * radius
    a = around.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    b = steps.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    shared = F.least("hi", "end") - F.greatest("lo", "start")
    # A pair may meet in several bins; it counts in the first that both have.
    pairs = a.join(b, ["chr", "__bin"]).withColumn("o", shared).filter((F.col("o") > 0) & (F.col("__bin") == F.floor(F.greatest("lo", "start") / width)))
    return pairs.groupBy("chr", "mid").agg((F.sum(F.col("o") * F.col("rate")) / F.sum("o")).alias("smoothed"))


def peaks(smoothed: DataFrame, radius: int) -> DataFrame:
    """(chr, mid, smoothed): local maxima picked greedily, highest first, more than twice the radius apart; all of them, however many a chromosome has."""
    w = _by("mid")
    top = smoothed.withColumn("__l", F.lag("smoothed").over(w)).withColumn("__r", F.lead("smoothed").over(w)).filter("(__l is null or smoothed >= __l) and (__r is null or smoothed >= __r)")
    return picked(top.select("chr", "mid", "smoothed"), "mid", "smoothed", 2 * radius)


def block_begins(first: np.ndarray, last: int, grid: np.ndarray, size: int) -> list[int]:
    """Which of a model's grids (numbers ``grid``, first sites ``first``; the last site is ``last``) begin output blocks, as of ``output_blocks``, by bisection."""
    may = len(grid) - int(first[-1] == last)  # grids that a block may begin with
    begins = [0]
    while True:
        at = begins[-1]
        # The first block counts its first site, later ones don't.
        enough = np.searchsorted(first[:may], first[at] + size + (at > 0))
        begin = int(max(enough, np.searchsorted(grid[:may], grid[at] + 2), at + 1))
        if begin >= may:
            break
        begins.append(begin)
    if len(begins) > 1 and begins[-1] == len(grid) - 1:
        begins.pop()
    return begins


def output_blocks(gridded: DataFrame, size: int) -> DataFrame:
    """(chr, block, snp_start, snp_end, grid_start, grid_end): blocks of more than ``size`` sites that begin at a new
    grid and hold two grids at least; a last block of one grid joins the one before.

    A block may begin at the first site of any grid but at a chromosome's last site. Where it does begin follows from the block before: the first grid that is far enough both by sites and by
    grids, which are two look-ups for each grid; the chain of begins is then followed.
    """
    numbered = gridded.select("chr", "snp", "grid", (F.row_number().over(_by("snp")) - 1).alias("i"))
    grids = numbered.groupBy("chr", "grid").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.min("snp").alias("snp_first"), F.max("snp").alias("snp_last"))
    every = Window.partitionBy("chr")
    placed = cut(grids.select("*", (F.row_number().over(_by("grid")) - 1).cast("long").alias("n"), F.max("last").over(every).alias("end"), F.max("grid").over(every).alias("last_grid")))
    # The first block counts its first site, later ones don't.
    by_sites = next_above(placed, "first", F.col("first") + size + (F.col("n") > 0).cast("int"), "n")
    by_grids = next_above(placed, "grid", F.col("grid") + 2, "n")
    nexts = by_sites.join(by_grids.withColumnRenamed("next", "other"), ["chr", "node"]).filter("next is not null and other is not null").select("chr", "node", F.greatest("next", "other").alias("next"))
    may = placed.filter("first < end or n = 0").select("chr", F.col("n").alias("next"))
    found = reached(nexts.join(may, ["chr", "next"]).select("chr", "node", "next"), placed.filter("n = 0").select("chr", F.col("n").alias("node")))
    w = Window.partitionBy("chr").orderBy("n")
    begins = placed.join(found.withColumnRenamed("node", "n"), ["chr", "n"]).filter("n = 0 or grid < last_grid")  # the last grid alone is no block
    blocks = begins.select("chr", (F.row_number().over(w) - 1).cast("long").alias("block"), F.col("snp_first").alias("snp_start"), F.col("grid").alias("grid_start"), F.coalesce(F.lead("n").over(w) - 1, F.lit(-1).cast("long")).alias("n"))
    ends = placed.select("chr", F.when(F.col("grid") == F.col("last_grid"), F.lit(-1).cast("long")).otherwise(F.col("n")).alias("n"), F.col("snp_last").alias("snp_end"), F.col("grid").alias("grid_end"))
    return blocks.join(ends, ["chr", "n"]).select("chr", "block", "snp_start", "snp_end", "grid_start", "grid_end")


def subset(observations: DataFrame, kept: DataFrame) -> DataFrame:
    return observations.join(kept.select("snp"), "snp", "left_semi")


def match_panel(sites: DataFrame, legend: DataFrame) -> DataFrame:
    """One row: how many (pos, ref, alt) are in both, only in the sites, only in the legend."""
    key = ["pos", "ref", "alt"]
    both = sites.select(*key, F.lit(1).alias("s")).join(legend.select(*key, F.lit(1).alias("l")), key, "full_outer")
    return both.agg(F.count_if(F.col("s").isNotNull() & F.col("l").isNotNull()).alias("both"), F.count_if(F.col("l").isNull()).alias("only_sites"), F.count_if(F.col("s").isNull()).alias("only_legend"))


__all__ = ["adaptive_grid", "constant_map", "cumulate", "grid", "grid_meta", "interpolate", "map_rates", "match_panel", "no_switch", "output_blocks", "peaks", "region", "sigma", "smooth", "subset", "validate"]
