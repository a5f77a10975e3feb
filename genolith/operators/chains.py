"""Chains along an order, where each begin follows from the one before: by look-ups of the next one and doubling jumps."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def _checkpoints(spark: SparkSession) -> None:
    """Sets the folder of checkpoints: the cluster's shared one; a temporary one where none is named and all runs on one machine, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        path = context.getConf().get("spark.checkpoint.dir")
        if path is None:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("spark.checkpoint.dir is not set: this cluster names no folder that driver and executors share")
            path = tempfile.mkdtemp(prefix="genolith-")
        context.setCheckpointDir(path)


def cut(df: DataFrame) -> DataFrame:
    """``df``, made and kept in the folder of checkpoints: plans of a loop don't grow, and survive lost executors."""
    _checkpoints(df.sparkSession)
    return df.checkpoint()


def next_above(rows: DataFrame, value: str, asked: Column, node: str, by: str = "chr", strictly: bool = False) -> DataFrame:
    """(by, node, next): for each row the first node whose ``value``, which doesn't fall from node to node, is at least (``strictly``: more than) ``asked`` of the row; null if there is none. One sort of both together, in which
    each asked value looks back at the last node that it passed."""
    nodes = rows.select(by, F.col(value).cast("double").alias("v"), F.lit(0).alias("asks"), F.col(node).alias("node"))
    questions = rows.select(by, asked.cast("double").alias("v"), F.lit(1).alias("asks"), F.col(node).alias("node"))
    order = Window.partitionBy(by).orderBy(F.desc("v"), F.desc("asks") if strictly else F.asc("asks"), F.desc("node"))
    seen = F.last(F.when(F.col("asks") == 0, F.col("node")), True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return nodes.unionByName(questions).withColumn("next", seen).filter("asks = 1").select(by, "node", "next")


def reached(nexts: DataFrame, starts: DataFrame, by: str = "chr") -> DataFrame:
    """(by, node): all nodes that the chains of ``nexts`` (by, node, next) reach from ``starts`` (by, node), which begin one chain each. Jumps double: after t rounds the first 2^t nodes of a chain are
    known, and each jump skips as many, so there are as many rounds as the logarithm of the longest chain."""
    found, jumps = cut(starts.select(by, "node")), cut(nexts.filter("next is not null").select(by, "node", "next"))
    while not jumps.isEmpty():
        further = found.join(jumps, [by, "node"]).select(by, F.col("next").alias("node"))
        second = jumps.select(by, F.col("node").alias("next"), F.col("next").alias("beyond"))
        found, jumps = cut(found.unionByName(further)), cut(jumps.join(second, [by, "next"]).select(by, "node", F.col("beyond").alias("next")))
    return found


def picked(items: DataFrame, place: str, height: str, apart: float, by: str = "chr") -> DataFrame:
    """The rows of ``items`` that are kept if the highest come first (ties: the first place) and each takes all within ``apart`` of it out. In each round all that are the highest within reach are
    kept, and their neighbours go: no order decides between those that are far from each other."""
    names = items.columns
    rank = F.struct(F.col(height).alias("h"), (-F.col(place)).alias("p"))
    near = Window.partitionBy(by).orderBy(place).rangeBetween(-apart, apart)
    left, kept = cut(items), None
    while not left.isEmpty():
        marked = left.withColumn("__top", rank == F.max(rank).over(near))
        judged = cut(marked.withColumn("__near", F.max("__top").over(near)))
        top = judged.filter("__top").select(*names)
        kept = top if kept is None else kept.unionByName(top)
        left = judged.filter("not __near").select(*names)
    return items.limit(0) if kept is None else kept
