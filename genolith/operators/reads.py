"""From alignments to reads: range join with sites, molecules, central sites, depth limits."""

from __future__ import annotations

from itertools import groupby
from math import ceil
from operator import itemgetter

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.cigar import blocks, span
from ..functions.draws import uniform

#: Width of the bins on which range joins meet.
BIN = 4096


def range_join(left: DataFrame, points: DataFrame, start: str, end: str, pos: str, on: tuple[str, ...] = (), width: int = BIN) -> DataFrame:
    """Rows of ``left`` with each of ``points`` whose ``pos`` lies in start..end (both inclusive): an equi-join on bins.
    An interval goes to each bin that it touches; a point lies in one, so no pair comes twice."""
    bins = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))
    a = left.filter(F.col(start) <= F.col(end)).withColumn("__bin", F.explode(bins))
    b = points.withColumn("__bin", F.floor(F.col(pos) / width))
    return a.join(b, ["__bin", *on]).filter(F.col(pos).between(F.col(start), F.col(end))).drop("__bin")


def scan(alignments: DataFrame, sites: DataFrame, bq_filter: int = 17, insert_limit: int = 600) -> DataFrame:
    """(sample, qname, bx, rev, start, end, snp, bq): signed scores of reads at sites, negative for the reference base; start and end are those of the alignment.

    Duplicates, poor mapping, wide inserts and alignments without CIGAR go; a score is at most the mapping quality and
    must reach ``bq_filter``; a quality of * counts as 10; a score of 0 says nothing and goes.
    """
    good = alignments.filter(~F.col("dup") & (F.col("mapq") >= bq_filter) & (F.abs("isize") <= insert_limit) & ~F.col("cigar").isin("", "*"))
    each = good.withColumn("__last", F.col("pos") + span(F.col("cigar")) - 1).withColumn("__b", F.explode(blocks(F.col("cigar"), F.col("pos")))).select("*", F.col("__b.ref").alias("__s"), (F.col("__b.ref") + F.col("__b.len") - 1).alias("__e"), F.col("__b.read").alias("__r")).drop("__b")
    at = F.col("__site_pos") - F.col("__s") + F.col("__r") + 1
    hit = range_join(each, sites.select("chr", "snp", F.col("pos").alias("__site_pos"), "ref", "alt"), "__s", "__e", "__site_pos", ("chr",))
    base = F.substring("seq", at.cast("int"), F.lit(1))
    score = F.least(F.when(F.col("qual") == "*", 10).otherwise(F.ascii(F.substring("qual", at.cast("int"), F.lit(1))) - 33), "mapq")
    seen = F.when(base == F.col("ref"), -score).when(base == F.col("alt"), score)
    return hit.withColumn("bq", seen.cast("int")).filter((F.abs("bq") >= bq_filter) & (F.col("bq") != 0)).select("sample", "qname", "bx", "rev", F.col("pos").alias("start"), F.col("__last").alias("end"), "snp", "bq")


def nested(observations: DataFrame) -> DataFrame:
    """(sample, read, j, bq, snp): one row a read, arrays by site; j is the number of sites less one."""
    pairs = F.array_sort(F.collect_list(F.struct("snp", "bq")))
    return observations.groupBy("sample", "read").agg(pairs.alias("__x")).select("sample", "read", (F.size("__x") - 1).alias("j"), F.col("__x.bq").alias("bq"), F.col("__x.snp").alias("snp"))


def split(reads: DataFrame) -> DataFrame:
    """Every site of a read as a read of its own: (sample, read, i, snp, bq)."""
    return reads.select("sample", "read", F.posexplode(F.arrays_zip("snp", "bq")).alias("i", "x")).select("sample", "read", "i", "x.snp", "x.bq")


def merge_molecules(fragments: DataFrame, insert_limit: int) -> DataFrame:
    """(sample, qname, n, start, end) of names whose fragments, by start, never end more than ``insert_limit`` after the
    start of the one before."""
    w = Window.partitionBy("sample", "qname").orderBy("start", "end")
    far = F.lead("end").over(w) - F.col("start") > insert_limit
    return fragments.withColumn("__far", F.coalesce(far, F.lit(False))).groupBy("sample", "qname").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("start"), F.max("end").alias("end"), F.max("__far").alias("__any")).filter(~F.col("__any")).drop("__any")


def rescue_tags(fragments: DataFrame) -> DataFrame:
    """``fragments`` with tag (null if bad): tags with 00 are bad, a name with two good tags has none, a single good tag
    holds for all fragments of its name."""
    good = F.when(~F.contains("bx", F.lit("00")) & (F.col("bx") != ""), F.col("bx"))
    tags = fragments.groupBy("sample", "qname").agg(F.collect_set(good).alias("__t")).select("sample", "qname", F.when(F.size("__t") == 1, F.get("__t", F.lit(0))).alias("tag"))
    return fragments.join(tags, ["sample", "qname"])


def sessions(fragments: DataFrame, gap: int) -> DataFrame:
    """(sample, tag, session, n, names, start, end): runs of a tag's fragments, by start, less than or at ``gap`` apart from end to start;
    rows without tag are left to ``merge_molecules``."""
    tagged = fragments.filter("tag is not null")
    w = Window.partitionBy("sample", "tag").orderBy("start", "end", "qname")
    new = F.when(F.col("start") - F.lag("end").over(w) > gap, 1).otherwise(0)
    run = tagged.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("sample", "tag", "session").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("qname").alias("names"), F.min("start").alias("start"), F.max("end").alias("end"))


def nearest(x: str) -> Column:
    """Of an array of structs (pos, snp, ...), that nearest to their mean position, ties to the first."""
    mean = F.aggregate(x, F.lit(0).cast("double"), lambda s, v: s + v["pos"]) / F.size(x)
    return F.array_min(F.transform(x, lambda v: F.struct(F.abs(v["pos"] - mean).alias("d"), v.alias("v"))))["v"]


def central(observations: DataFrame, sites: DataFrame) -> DataFrame:
    """(sample, read, n, central): the site nearest to the mean position of a read's sites, ties to the first."""
    at = observations.join(sites.select("snp", "pos"), "snp").groupBy("sample", "read").agg(F.collect_list(F.struct("pos", "snp")).alias("x"))
    return at.select("sample", "read", F.size("x").cast("long").alias("n"), nearest("x")["snp"].alias("central"))


def cap_depth(reads: DataFrame, most: int, *by: str) -> DataFrame:
    """At most ``most`` rows for each value of ``by``: the least of an arithmetic hash of (read, snp)."""
    order = (F.pmod("read", F.lit(1000003)) * 7919 + F.pmod("snp", F.lit(1000003)) * 104729) % 1000003
    w = Window.partitionBy(*by).orderBy(order, "read", "snp", "bq")
    return reads.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).drop("__n")


def deep_stretches(reads: DataFrame, most: float) -> DataFrame:
    """(sample, stretch, snp, read, times) of the observations that lie in stretches with a site deeper than ``most``. A stretch is a run of a sample's reads
    each of which begins before all before it have ended, so what is done in one doesn't touch another."""
    ends = reads.filter(F.size("snp") > 0).select("sample", "read", "snp", F.array_min("snp").alias("lo"), F.array_max("snp").alias("hi"))
    order = Window.partitionBy("sample").orderBy("lo", "hi", "read")
    new = F.coalesce(F.col("lo") > F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    placed = ends.withColumn("new", new.cast("long")).withColumn("stretch", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    seen = placed.select("sample", "stretch", "read", F.explode("snp").alias("snp")).groupBy("sample", "stretch", "snp", "read").agg(F.count(F.lit(1)).alias("times"))
    deep = seen.groupBy("sample", "stretch", "snp").agg(F.sum("times").alias("depth")).filter(F.col("depth") > most).select("sample", "stretch").distinct()
    return seen.join(deep, ["sample", "stretch"], "left_semi")


def cap_depth_greedy(reads: DataFrame, most: float, seed: int = 0) -> DataFrame:
    """Whole reads (sample, read, snp[]) thinned until no site of a sample is deeper than ``most``; every observation counts. Each read has a rank, drawn
    by (seed, sample, read). At a site that what is left covers too often, from left to right, reads that cover it more than once go, and then those of the greatest ranks, until it isn't
    too deep. Stretches without a deep site are left alone; each other one is a group of its own."""
    seen = deep_stretches(reads, most).withColumn("rank", uniform(seed, "sample", "read"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        gone: set = set()
        listed = pdf.sort_values(["snp", "rank", "read"])
        for _, here in groupby(zip(listed["snp"], listed["read"], listed["times"]), key=itemgetter(0)):
            left = [(read, times) for _, read, times in here if read not in gone]
            over = sum(times for _, times in left) - most
            if over > 0:
                twice = {read: times for read, times in left if times > 1}
                once = [read for read, times in left if times == 1]
                gone |= twice.keys()
                gone.update(once[len(once) - max(0, ceil(over - sum(twice.values()))) :])
        return pdf.loc[pdf["read"].isin(gone), ["sample", "read"]].drop_duplicates()

    kinds = dict(reads.dtypes)
    gone = seen.groupBy("sample", "stretch").applyInPandas(run, f"sample {kinds['sample']}, read {kinds['read']}")
    return reads.join(gone, ["sample", "read"], "left_anti").select(*reads.columns)


def thin(reads: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """A share of each sample's reads, each drawn by itself, and the first read of a sample that would lose all."""
    kept = uniform(seed, "sample", "read") < fraction
    w = Window.partitionBy("sample")
    marked = reads.withColumn("__kept", kept)
    none = ~F.max("__kept").over(w)
    return marked.withColumn("__k", F.col("__kept") | (none & (F.col("read") == F.min("read").over(w)))).filter("__k").drop("__k", "__kept")


def inside(reads: DataFrame, first: int, last: int) -> DataFrame:
    """Reads (snp array) with all sites in first..last, renumbered from 0."""
    return reads.filter((F.size("snp") > 0) & F.forall("snp", lambda x: x.between(first, last))).withColumn("snp", F.transform("snp", lambda x: x - first))


def reads_of_blocks(centred: DataFrame, blocks: DataFrame) -> DataFrame:
    """(sample, block, first, last, n): which of a sample's reads (sample, read, central), numbered by central site, feed each output block
    (block, snp_start, snp_end)."""
    w = Window.partitionBy("sample").orderBy("central", "read")
    numbered = centred.withColumn("i", F.row_number().over(w) - 1)
    found = range_join(blocks, numbered, "snp_start", "snp_end", "central", width=256)
    return found.groupBy("sample", "block").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count(F.lit(1)).alias("n"))


def choose_samples(samples: DataFrame, keep: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` samples: those of ``keep`` first, then others by draws."""
    kept = samples.join(keep.select("sample", F.lit(1).alias("__k")).distinct(), "sample", "left")
    return kept.orderBy(F.col("__k").isNull(), uniform(seed, "sample"), "sample").limit(n).select("sample")
