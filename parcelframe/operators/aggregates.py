"""Global (single-row) and scoped aggregates: KPIs and headline numbers.

Every operator accepts ``by``: a list of grouping columns. With ``by=None``
the result is one row; with ``by=["depot_region"]`` the same numbers come
out for every region in **one** aggregation (partial aggregation on the map
side, one shuffle of at most #groups rows per task), instead of one query
per region.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import LATE_THRESHOLD_DAYS

MONEY = "decimal(38,3)"
MONEY2 = "decimal(38,2)"


def _agg(df: DataFrame, cols: list[Column], by=None) -> DataFrame:
    return df.groupBy(*by).agg(*cols) if by else df.agg(*cols)


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def money_sum(c: str) -> Column:
    """``coalesce(sum(c), 0)`` kept exact as decimal."""
    return F.coalesce(F.sum(c), F.lit(0)).cast(MONEY)


def avg_sane_interval() -> Column:
    """Mean interval over delivered rows with a non-negative interval."""
    return F.avg(F.when(F.col("is_delivered") & (F.col("interval_days") >= 0),
                        F.col("interval_days").cast("double")))


def total_shipments(df: DataFrame, by=None) -> DataFrame:
    return _agg(df, [F.count(F.lit(1)).alias("total_shipments")], by)


def total_revenue(df: DataFrame, by=None) -> DataFrame:
    return _agg(df, [money_sum("revenue_ca").alias("total_revenue")], by)


def total_crbt_amount(df: DataFrame, by=None) -> DataFrame:
    return _agg(df, [money_sum("crbt_amount").alias("total_crbt_amount")], by)


def crbt_count(df: DataFrame, by=None) -> DataFrame:
    return _agg(df, [count_if(F.col("is_crbt")).alias("crbt_count")], by)


def delivered_count(df: DataFrame, by=None) -> DataFrame:
    return _agg(df, [count_if(F.col("is_delivered")).alias("delivered_count")], by)


def average_interval(df: DataFrame, by=None) -> DataFrame:
    return _agg(df, [F.bround(avg_sane_interval(), 2).alias("avg_interval_days")], by)


def late_count(df: DataFrame, threshold: int = LATE_THRESHOLD_DAYS, by=None) -> DataFrame:
    return _agg(df, [count_if(F.col("interval_days") > threshold).alias("late_deliveries")], by)


def delivery_status_totals(df: DataFrame, by=None) -> DataFrame:
    d = count_if(F.col("is_delivered"))
    t = F.count(F.lit(1))
    return _agg(df, [d.alias("delivered"), (t - d).alias("failed"), t.alias("total")], by)


def weight_stats(df: DataFrame, by=None) -> DataFrame:
    w = F.col("weight_kg")
    return _agg(df, [F.bround(F.avg(w), 2).alias("avg_weight"), F.min(w).alias("min_weight"),
                     F.max(w).alias("max_weight"),
                     F.bround(F.coalesce(F.sum(w), F.lit(0.0)), 1).alias("total_weight")], by)


def kpi_summary(df: DataFrame, by=None, late_threshold: int = LATE_THRESHOLD_DAYS) -> DataFrame:
    """The ten headline KPIs in one aggregation.

    ``delivery_rate`` = 100·delivered/total to one decimal, ties to even, 0 when
    there are no rows.
    Apply ``filters.filter_combined`` first for region / next-region /
    category scoping.
    """
    total = F.count(F.lit(1))
    delivered = count_if(F.col("is_delivered"))
    out = _agg(df, [
        total.alias("total_shipments"),
        F.coalesce(F.sum("revenue_ca"), F.lit(0)).alias("_rev"),
        count_if(F.col("is_crbt")).alias("total_crbt_count"),
        F.coalesce(F.sum("crbt_amount"), F.lit(0)).alias("_crbt"),
        delivered.alias("delivered"),
        avg_sane_interval().alias("_avg"),
        count_if(F.col("interval_days") > late_threshold).alias("late_deliveries"),
    ], by)
    keys = list(by or [])
    return out.select(
        *keys,
        "total_shipments",
        F.round(F.col("_rev"), 2).cast(MONEY2).alias("total_revenue"),
        "total_crbt_count",
        F.round(F.col("_crbt"), 2).cast(MONEY2).alias("total_crbt_amount"),
        "delivered",
        (F.col("total_shipments") - F.col("delivered")).alias("failed"),
        F.coalesce(F.bround(F.try_divide(F.col("delivered") * F.lit(100.0), F.col("total_shipments")), 1),
                   F.lit(0.0)).alias("delivery_rate"),
        F.bround(F.col("_avg"), 2).alias("avg_interval_days"),
        "late_deliveries",
        F.lit(late_threshold).alias("late_threshold"),
    )


def vw_kpi_national(df: DataFrame) -> DataFrame:
    """View variant: NULL rate when empty, rate as DECIMAL(5,1) half-up."""
    total = F.count(F.lit(1))
    delivered = count_if(F.col("is_delivered"))
    return df.agg(
        total.alias("total_shipments"),
        delivered.alias("delivered"),
        count_if(~F.col("is_delivered")).alias("failed"),
        F.try_divide(delivered.cast("decimal(20,0)") * F.lit(100), total)
         .cast("decimal(5,1)").alias("delivery_rate_pct"),
        count_if(F.col("is_crbt")).alias("crbt_count"),
        F.sum("crbt_amount").cast(MONEY).alias("crbt_amount_total"),
        F.sum("revenue_ca").cast(MONEY).alias("revenue_total"),
        F.round(avg_sane_interval(), 6).alias("avg_interval_days"),
        count_if(F.col("interval_days") > 3).alias("late_deliveries"),
    )


def has_data(df: DataFrame) -> DataFrame:
    """One row, ``has_data`` true when any row exists (reads at most one row)."""
    return df.limit(1).agg((F.count(F.lit(1)) > 0).alias("has_data"))
