"""Unions, de-duplication and pivots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(frames) -> DataFrame:
    """``unionByName`` with missing columns filled with NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dedup_rows(df: DataFrame, subset=None) -> DataFrame:
    return df.dropDuplicates(list(subset) if subset else None)


def count_duplicates(df: DataFrame, subset=None) -> DataFrame:
    """Rows beyond the first of each identical group."""
    cols = list(subset or df.columns)
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def pivot_year_month(df: DataFrame, date_col: str, value: str) -> DataFrame:
    """Rows = year, columns ``1``…``12`` = monthly sum (explicit pivot values)."""
    d = F.col(date_col)
    return (df.select(F.year(d).alias("year"), F.month(d).alias("month"), F.col(value).alias("v"))
            .groupBy("year").pivot("month", list(range(1, 13))).agg(F.sum("v")))


def pivot_group_month(df: DataFrame, date_col: str, group: str, value: str, n: int = 10,
                      fill: float = 0.0) -> DataFrame:
    """Rows = month (``yyyy-MM``), one column per group of the ``n`` most frequent
    groups, missing = ``fill``. The rows are read once (see
    ``topk.aggregate_top_groups``); ranking and pivot run on the small
    (month, group) table."""
    from .topk import aggregate_top_groups
    fine, groups = aggregate_top_groups(df, F.date_format(F.col(date_col), "yyyy-MM"), group, value, n, "count")
    return (fine.groupBy(F.col("_key").alias("month")).pivot(group, groups).agg(F.sum("_v"))
            .na.fill(fill, subset=groups))
