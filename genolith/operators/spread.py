"""Over how many partitions large tables are dealt, so that a task's share of rows doesn't grow with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a partition, about. Tables of fewer than LARGE rows are left to Spark's settings.
ROWS, LARGE = 1 << 19, 1 << 21


def parts_for(df: DataFrame) -> int | None:
    """As many partitions as ``df``, whose rows are counted (of a Parquet table: from footers), asks for; None if it is small."""
    rows = df.count()
    return max(-(-rows // ROWS), df.sparkSession.sparkContext.defaultParallelism) if rows >= LARGE else None


def spread(df: DataFrame, parts: int | None, *by: str) -> DataFrame:
    """``df`` dealt by columns over ``parts`` partitions, if these are given. Joins, groups and windows by these columns, or more, then move nothing."""
    return df if parts is None else df.repartition(parts, *by)


def meeting(left: DataFrame, right: DataFrame, parts: int | None, on: str, *by: str) -> DataFrame:
    """``left`` joined with ``right`` by the column ``on``, then dealt by ``by``. If ``parts`` are given both are dealt by ``on`` first: none is broadcast
    at one size and sorted in the session's few partitions at a greater one."""
    if parts is None:
        return left.join(right, on)
    met = spread(left, parts, on).join(spread(right, parts, on).hint("merge"), on)
    return spread(met, parts, *by) if by else met
