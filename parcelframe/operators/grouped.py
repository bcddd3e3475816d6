"""Grouped aggregations of the dashboard, BI views and feature tables.

Display rule of the dashboard: a NULL or empty group key is shown as ``—``
*after* grouping (NULL and ``""`` stay separate groups).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import month_start, strip_ws
from ..functions.formatting import WEIGHT_BANDS, delivery_status_label, display_key, unknown_label, weight_band
from ..functions.temporal import year_month_label
from .aggregates import MONEY, avg_sane_interval, count_if



def _show(c: str):
    return display_key(c)


def count_by_depot_region(df: DataFrame) -> DataFrame:
    """Count per depot region, largest first."""
    g = df.groupBy("depot_region").agg(F.count(F.lit(1)).alias("shipments"))
    return g.select(_show("depot_region").alias("depot_region"), "shipments") \
        .orderBy(F.desc("shipments"), "depot_region")


def count_by_depot_office(df: DataFrame, limit: int = 15) -> DataFrame:
    """Top offices by shipment count (top-k report; ties broken by name)."""
    g = df.groupBy("depot_office").agg(F.count(F.lit(1)).alias("shipments"))
    top = g.orderBy(F.desc("shipments"), F.asc_nulls_first("depot_office")).limit(limit)
    return top.select(_show("depot_office").alias("depot_office"), "shipments")


def revenue_by_region(df: DataFrame) -> DataFrame:
    g = df.groupBy("depot_region").agg(F.coalesce(F.sum("revenue_ca"), F.lit(0)).cast(MONEY).alias("revenue"))
    return g.select(_show("depot_region").alias("depot_region"), "revenue") \
        .orderBy(F.desc("revenue"), "depot_region")


def failure_causes(df: DataFrame, limit: int = 12) -> DataFrame:
    """Last event of undelivered rows, most frequent first (top-k)."""
    g = (df.filter(~F.col("is_delivered")).groupBy("last_event")
         .agg(F.count(F.lit(1)).alias("shipments")))
    top = g.orderBy(F.desc("shipments"), F.asc_nulls_first("last_event")).limit(limit)
    return top.select(_show("last_event").alias("last_event"), "shipments")


def monthly_evolution(df: DataFrame) -> DataFrame:
    """Count, revenue and delivered per (year, month); rows with both parts NULL dropped."""
    g = df.groupBy("deposit_year", "deposit_month").agg(
        F.count(F.lit(1)).alias("shipments"),
        F.coalesce(F.sum("revenue_ca"), F.lit(0)).cast(MONEY).alias("revenue"),
        count_if(F.col("is_delivered")).alias("delivered"))
    g = g.filter(F.col("deposit_year").isNotNull() | F.col("deposit_month").isNotNull())
    return g.select("deposit_year", "deposit_month",
                    year_month_label("deposit_year", "deposit_month").alias("label"),
                    "shipments", "revenue", "delivered") \
        .orderBy("deposit_year", "deposit_month")


def weight_buckets(df: DataFrame) -> DataFrame:
    """Rows per weight band in one pass; empty bands listed with 0.

    Every band is a conditional count of the same aggregation (map-side
    partial counts, one tiny shuffle); ``stack`` turns the single result row
    into one row per band, so no band list has to be joined back.
    """
    band = weight_band("weight_kg")
    counts = df.agg(*[count_if(band == F.lit(lbl)).alias(f"b{i}") for i, (_, _, lbl) in enumerate(WEIGHT_BANDS)])
    stack = ", ".join(f"{i}, '{lbl}', b{i}" for i, (_, _, lbl) in enumerate(WEIGHT_BANDS))
    return counts.selectExpr(f"stack({len(WEIGHT_BANDS)}, {stack}) AS (band_order, band, shipments)") \
        .orderBy("band_order")


def distinct_regions(df: DataFrame) -> DataFrame:
    return (df.select("depot_region").filter(F.col("depot_region").isNotNull() & (F.col("depot_region") != ""))
            .distinct().orderBy("depot_region"))


def distinct_next_regions(df: DataFrame) -> DataFrame:
    """Sorted distinct trimmed values; ``(VIDE)`` first when any blank exists."""
    s = strip_ws("next_region")
    flagged = df.select(F.when(F.coalesce(s, F.lit("")) == "", F.lit("(VIDE)")).otherwise(s).alias("next_region"))
    d = flagged.distinct()
    return d.orderBy((F.col("next_region") != "(VIDE)"), "next_region")


# ── BI views ──────────────────────────────────────────────────────────────────

def vw_national_shipments_clean(df: DataFrame) -> DataFrame:
    """Flat report-ready projection with month start and status label."""
    return df.select(
        "mailitm_fid", "weight_kg", "crbt_amount", "shipment_type", "is_crbt", "revenue_ca",
        "deposit_date", "deposit_year", "deposit_month",
        month_start("deposit_year", "deposit_month").alias("deposit_month_start"),
        "depot_office", "depot_region", "last_event", "last_event_date", "last_event_office",
        "last_event_region", "next_region", "interval_days", "is_delivered",
        delivery_status_label("is_delivered").alias("delivery_status"))


def vw_shipments_by_region(df: DataFrame) -> DataFrame:
    return df.groupBy("depot_region").agg(
        F.count(F.lit(1)).alias("total_shipments"),
        count_if(F.col("is_delivered")).alias("delivered"),
        F.sum("revenue_ca").cast(MONEY).alias("revenue_total"),
        count_if(F.col("is_crbt")).alias("crbt_count"),
        F.round(avg_sane_interval(), 6).alias("avg_interval_days"))


def vw_shipments_by_month(df: DataFrame, drop_either_null: bool = True) -> DataFrame:
    """Month rows; by default a row with either part NULL is dropped (view rule),
    ``drop_either_null=False`` drops only rows with both parts NULL."""
    y, m = F.col("deposit_year"), F.col("deposit_month")
    keep = (y.isNotNull() & m.isNotNull()) if drop_either_null else (y.isNotNull() | m.isNotNull())
    return (df.filter(keep).groupBy("deposit_year", "deposit_month").agg(
        F.count(F.lit(1)).alias("total_shipments"),
        count_if(F.col("is_delivered")).alias("delivered"),
        F.sum("revenue_ca").cast(MONEY).alias("revenue_total"))
        .withColumn("month_start", month_start("deposit_year", "deposit_month")))


def vw_delivery_status(df: DataFrame) -> DataFrame:
    return df.groupBy(delivery_status_label("is_delivered").alias("delivery_status")).agg(
        F.count(F.lit(1)).alias("shipments"), F.sum("revenue_ca").cast(MONEY).alias("revenue_total"))


def vw_failure_causes(df: DataFrame) -> DataFrame:
    return (df.filter(~F.col("is_delivered"))
            .groupBy(unknown_label("last_event").alias("failure_event"), "last_event_region")
            .agg(F.count(F.lit(1)).alias("shipments")))
