"""Choosing founders from a haplotype panel."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F

#: Directions that a haplotype's alleles are projected on.
DIRECTIONS = 64


def sketches(panel: DataFrame, seed: int = 0) -> DataFrame:
    """(hap, x): all alleles of a haplotype, less their sites' frequencies, projected on DIRECTIONS random directions, whose distances
    stand for those of the haplotypes. Each cell adds its signs to sums that are made before they are shuffled."""
    centred = panel.join(panel.groupBy("snp").agg(F.avg("allele").alias("f")), "snp").select("hap", (F.col("allele") - F.col("f")).alias("v"), F.xxhash64("snp", F.lit(seed)).alias("h"))
    sums = [F.sum(F.when(F.bit_get("h", F.lit(i)) == 1, F.col("v")).otherwise(-F.col("v"))) for i in range(DIRECTIONS)]
    return centred.groupBy("hap").agg(F.array(*sums).alias("x"))


def choose_founders(panel: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(k, hap): ``k`` haplotypes of a panel (hap, snp, allele), one from each cluster of their sketches, drawn by hash; if clusters
    are fewer, the rest are other haplotypes by hash. All haplotypes and sites take part."""
    points = sketches(panel, seed).select("hap", "x", array_to_vector("x").alias("features")).persist()
    clusters = min(k, points.select("x").distinct().count())
    own = KMeans(k=clusters, seed=seed, maxIter=50).fit(points).transform(points) if clusters > 1 else points.withColumn("prediction", F.lit(0))
    draw = F.xxhash64("hap", F.lit(seed))
    nth = own.withColumn("nth", F.row_number().over(Window.partitionBy("prediction").orderBy(draw, "hap")))
    chosen = nth.orderBy(F.col("nth") > 1, F.when(F.col("nth") > 1, draw), "prediction").limit(k).select("hap").collect()  # k rows
    points.unpersist()
    return points.sparkSession.createDataFrame([(i, int(r.hap)) for i, r in enumerate(chosen)], "k int, hap int")
