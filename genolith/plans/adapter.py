"""The engine's tables (sites, observations, fragments, truth, map, panel) derived from star-schema tables.

Used to run every operator, at any scale, against data that a SQL engine can check. ``SQL`` holds the same derivations as
common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.spread import parts_for, spread

CHROMOSOME = "chr1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _base(i):
    return F.element_at(F.array(*map(F.lit, "ACGT")), (i % 4 + 1).cast("int"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(k.alias("snp"), F.lit(CHROMOSOME).alias("chr"), (1 + 100 * k + F.col("p_size")).cast("long").alias("pos"), _base(k).alias("ref"), _base(k + 1).alias("alt"))


def parts(spark: SparkSession, sf_dir: str) -> int | None:
    """Over how many partitions what comes of all observations is dealt (``spread``)."""
    return parts_for(table(spark, sf_dir, "lineitem"))


def _ordered(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Line items (``columns``) with their orders' customers. Both sides are dealt by order, so what is grouped by order afterwards moves no more."""
    n = parts(spark, sf_dir)
    lines = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", *columns), n, "l_orderkey")
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), n, "o_orderkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    bq = F.when(F.col("l_returnflag") == "R", 1).otherwise(-1) * (17 + F.col("l_quantity").cast("int") % 23)
    return _ordered(spark, sf_dir, "l_partkey", "l_returnflag", "l_quantity").select(F.col("o_custkey").alias("sample"), F.col("l_orderkey").alias("read"), F.col("l_partkey").alias("snp"), bq.cast("int").alias("bq"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample"))


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned fragments of molecules: qname, sample, bx (tag), start, end; qname fragments may lie far apart."""
    start = (F.col("l_partkey") * 100 + F.col("l_linenumber")).cast("long")
    tag = F.when(F.col("l_suppkey") % 7 == 0, F.lit("A00B")).otherwise(F.concat(F.lit("T"), (F.col("l_suppkey") % 5).cast("string")))
    return _ordered(spark, sf_dir, "l_partkey", "l_suppkey", "l_linenumber", "l_quantity").select(F.col("o_custkey").alias("sample"), F.col("l_orderkey").alias("qname"), tag.alias("bx"), start.alias("start"), (start + 50 + F.col("l_quantity").cast("int")).alias("end"))


def genetic_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").filter("p_partkey % 10 = 5")
    return p.select((1 + 100 * F.col("p_partkey") + F.col("p_size")).cast("long").alias("position"), (F.col("p_retailprice") / 1000).alias("rate"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Haplotypes in long form: suppliers, at the sites whose parts they delivered; alleles by rule."""
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("int").alias("hap"), F.col("l_partkey").cast("int").alias("snp")).distinct()
    return cells.select("hap", "snp", ((F.col("hap") * 31 + F.col("snp") * 17 + (F.col("hap") % 7) * (F.col("snp") % 5)) % 2).cast("int").alias("allele"))


_BASE = "substr('ACGT', CAST(({}) % 4 AS INT) + 1, 1)"

#: The same tables as common table expressions.
SQL = {
    "sites": f"SELECT p_partkey AS snp, '{CHROMOSOME}' AS chr, CAST(1 + 100 * p_partkey + p_size AS BIGINT) AS pos, {_BASE.format('p_partkey')} AS ref, {_BASE.format('p_partkey + 1')} AS alt FROM part",
    "obs": "SELECT o_custkey AS sample, l_orderkey AS read, l_partkey AS snp, (CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END) * (17 + CAST(floor(l_quantity) AS INT) % 23) AS bq FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "prob": "SELECT *, CASE WHEN bq > 0 THEN 1 - pow(10.0, -abs(bq) / 10.0) ELSE pow(10.0, -abs(bq) / 10.0) / 3 END AS pa, CASE WHEN bq < 0 THEN 1 - pow(10.0, -abs(bq) / 10.0) ELSE pow(10.0, -abs(bq) / 10.0) / 3 END AS pr FROM obs",
    "samples": "SELECT c_custkey AS sample FROM customer",
    "frags": "SELECT o_custkey AS sample, l_orderkey AS qname, CASE WHEN l_suppkey % 7 = 0 THEN 'A00B' ELSE concat('T', l_suppkey % 5) END AS bx, CAST(l_partkey * 100 + l_linenumber AS BIGINT) AS start, CAST(l_partkey * 100 + l_linenumber + 50 + floor(l_quantity) AS BIGINT) AS \"end\" FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "gmap": "SELECT CAST(1 + 100 * p_partkey + p_size AS BIGINT) AS position, p_retailprice / 1000 AS rate FROM part WHERE p_partkey % 10 = 5",
    "panel": "SELECT DISTINCT CAST(l_suppkey AS INT) AS hap, CAST(l_partkey AS INT) AS snp, CAST((l_suppkey * 31 + l_partkey * 17 + (l_suppkey % 7) * (l_partkey % 5)) % 2 AS INT) AS allele FROM lineitem",
    "lik": "SELECT sample, snp, sum(ln(pr)) AS l0, sum(ln((pr + pa) / 2)) AS l1, sum(ln(pa)) AS l2, count(*) FILTER (bq < 0) AS ad0, count(*) FILTER (bq > 0) AS ad1 FROM prob GROUP BY sample, snp",
    "post": "SELECT sample, snp, ad0, ad1, e0 / (e0 + e1 + e2) AS g0, e1 / (e0 + e1 + e2) AS g1, e2 / (e0 + e1 + e2) AS g2 FROM (SELECT *, exp(l0 - greatest(l0, l1, l2)) AS e0, exp(l1 - greatest(l0, l1, l2)) AS e1, exp(l2 - greatest(l0, l1, l2)) AS e2 FROM lik)",
}
_NEEDS = {"prob": ["obs"], "lik": ["prob"], "post": ["lik"]}


def with_tables(*names: str, recursive: bool = False) -> str:
    """A WITH clause of the named tables and what they need."""
    found: list[str] = []

    def add(name: str) -> None:
        for x in _NEEDS.get(name, []):
            add(x)
        if name not in found:
            found.append(name)

    for name in names:
        add(name)
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(f"{n} AS ({SQL[n]})" for n in found)
