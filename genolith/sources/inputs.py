"""Saved inputs: observations of a run, to be used again without alignments, at fewer sites or on another grid.

Observations lie in Parquet by bucket of samples, under the positions and alleles of their sites, so that ids and grids are a later run's own. Beside them are the sites, the
samples (number, name) and a manifest of the settings that decided which observations there are.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

def save(observations: DataFrame, sites: DataFrame, names: DataFrame, path: str, made_by: dict, buckets: int = 64) -> None:
    """Write observations (sample, read, snp, bq) of the samples ``names`` (number, name), whose numbers they hold, at ``sites``. A folder that exists is an error."""
    spark, key = observations.sparkSession, F.pmod(F.xxhash64("sample"), F.lit(buckets)).cast("int")
    placed = observations.join(sites.select("snp", "chr", "pos", "ref", "alt"), "snp").select("sample", "read", "chr", "pos", "ref", "alt", "bq", key.alias("bucket"))
    placed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "sample", "read", "pos").write.partitionBy("bucket").parquet(f"{path}/observations")
    sites.select("chr", "pos", "ref", "alt").write.parquet(f"{path}/sites")
    names.select("number", "name").write.parquet(f"{path}/samples")
    spark.createDataFrame([(json.dumps(made_by, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")  # last: what has one is whole


def load(spark: SparkSession, path: str, sites: DataFrame, made_by: dict) -> tuple[DataFrame, DataFrame]:
    """((sample, read, snp, bq), (number, name)) at ``sites``, which must all have been among those saved. Of reads that also saw others, none is kept, as they would be shorter than they
    were. Raises ValueError if the settings were others."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
    if manifest != json.loads(json.dumps(made_by)):
        raise ValueError(f"{path} was made with {manifest}")
    key = ["chr", "pos", "ref", "alt"]
    lacking = sites.join(spark.read.parquet(f"{path}/sites"), key, "left_anti").count()
    if lacking:
        raise ValueError(f"{lacking} sites are not in {path}")
    placed = spark.read.parquet(f"{path}/observations").drop("bucket").join(sites.select("snp", *key), key, "left")
    cut = placed.filter("snp is null").select("sample", "read").distinct()
    return placed.join(cut, ["sample", "read"], "left_anti").select("sample", "read", "snp", "bq"), spark.read.parquet(f"{path}/samples")
