"""Haploid forward and backward passes over two founders, in Spark's array functions alone.

For any number of founders and for diploids see ``hmm``. Here a sample's emissions are an ordered array (pos, e0, e1), and each
pass is one fold over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_STATE = "array<struct<x0:double,x1:double>>"


def emissions(observed: DataFrame) -> DataFrame:
    """(sample, es) of (sample, snp, e0, e1)."""
    return observed.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("snp", "e0", "e1"))).alias("es"))


def _scaled(a: Column, b: Column) -> Column:
    return F.struct((a / (a + b)).alias("x0"), (b / (a + b)).alias("x1"))


def forward(es: DataFrame, stay: float) -> DataFrame:
    """(sample, n, alpha0, loglik): the scaled forward pass from equal priors; ``stay`` is P(no switch) a step."""

    def step(s: Column, e: Column) -> Column:
        move = (1 - stay) / 2
        a, b = e["e0"] * (stay * s["x0"] + move), e["e1"] * (stay * s["x1"] + move)
        return F.struct((a / (a + b)).alias("x0"), (b / (a + b)).alias("x1"), (s["l"] + F.log(a + b)).alias("l"))

    last = F.aggregate("es", F.struct(F.lit(0.5).alias("x0"), F.lit(0.5).alias("x1"), F.lit(0.0).alias("l")), step)
    return es.select("sample", F.size("es").cast("long").alias("n"), last.alias("s")).select("sample", "n", F.col("s.x0").alias("alpha0"), F.col("s.l").alias("loglik"))


def posterior(es: DataFrame, stay: float) -> DataFrame:
    """(sample, snp, gamma0): the posterior of the first founder at each site."""
    move = (1 - stay) / 2
    none = F.array().cast(_STATE)

    def on(s: Column, e: Column) -> Column:
        p = F.when(F.size(s) == 0, F.struct(F.lit(0.5).alias("x0"), F.lit(0.5).alias("x1"))).otherwise(F.element_at(s, -1))
        return F.array_append(s, _scaled(e["e0"] * (stay * p["x0"] + move), e["e1"] * (stay * p["x1"] + move)))

    def back(s: Column, e: Column) -> Column:
        p = F.element_at(s, -1)
        m = move * (e["e0"] * p["x0"] + e["e1"] * p["x1"])
        return F.array_append(s, _scaled(stay * e["e0"] * p["x0"] + m, stay * e["e1"] * p["x1"] + m))

    start = F.array(F.struct(F.lit(0.5).alias("x0"), F.lit(0.5).alias("x1"))).cast(_STATE)
    both = es.select("sample", "es", F.aggregate("es", none, on).alias("a"), F.reverse(F.aggregate(F.reverse(F.slice("es", 2, F.greatest(F.size("es") - 1, F.lit(0)))), start, back)).alias("b"))
    each = both.select("sample", F.explode(F.arrays_zip(F.col("es.snp").alias("snp"), "a", "b")).alias("z"))
    g0, g1 = F.col("z.a.x0") * F.col("z.b.x0"), F.col("z.a.x1") * F.col("z.b.x1")
    return each.select("sample", F.col("z.snp").alias("snp"), (g0 / (g0 + g1)).alias("gamma0"))


def mstep(counts: DataFrame, threshold: float = 1e-4) -> DataFrame:
    """(k, snp, p) of expected counts (k, snp, alt, total, af): their ratio, the pileup's frequency where nothing was counted, within
    threshold..1 - threshold."""
    p = F.when(F.col("total") > 0, F.col("alt") / F.col("total")).otherwise(F.col("af"))
    return counts.select("k", "snp", F.least(F.greatest(p, F.lit(threshold)), F.lit(1 - threshold)).alias("p"))


def normalise_switches(sums: DataFrame, floor: float = 1e-4) -> DataFrame:
    """(snp, k, p) of expected switches (snp, k, v): shares of a site's, floored, again shares."""
    from pyspark.sql import Window

    w = Window.partitionBy("snp")
    n = F.count(F.lit(1)).over(w)
    share = sums.select("snp", "k", F.greatest(F.coalesce(F.col("v") / F.nullif(F.sum("v").over(w), F.lit(0.0)), 1 / n), F.lit(floor)).alias("s"))
    return share.select("snp", "k", (F.col("s") / F.sum("s").over(w)).alias("p"))
