"""The dashboard from one cube.

``dashboard_cube`` reads the shipments once and keeps mergeable numbers (counts,
sums, extremes) at the finest grain that any part or filter of the dashboard
asks for. All ten parts roll up from it, under any filter, and cubes of
several loads merge into one without their rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formatting import WEIGHT_BANDS, display_key, weight_band
from ..functions.temporal import year_month_label
from ..session import materialize
from .aggregates import MONEY, MONEY2, count_if
from .filters import LATE_THRESHOLD_DAYS, filter_combined
from .grouped import distinct_regions

DIMENSIONS = ["depot_region", "depot_office", "next_region", "deposit_year", "deposit_month", "last_event", "is_delivered", "weight_band"]
#: Numbers of the cube and how those of two cubes merge.
MEASURES = {"n": "sum", "revenue": "sum", "crbt_n": "sum", "crbt_amount": "sum", "late_n": "sum", "interval_n": "sum", "interval_days": "sum",
            "weight_n": "sum", "weight_sum": "sum", "weight_min": "min", "weight_max": "max"}


def dashboard_cube(df: DataFrame, late_threshold: int = LATE_THRESHOLD_DAYS) -> DataFrame:
    """One row for each combination of ``DIMENSIONS`` that occurs, with ``MEASURES``."""
    w, days = F.col("weight_kg").cast("double"), F.col("interval_days")
    sane = F.when(F.col("is_delivered") & (days >= 0), days)
    return df.withColumn("weight_band", weight_band("weight_kg")).groupBy(*DIMENSIONS).agg(
        F.count(F.lit(1)).alias("n"), F.sum("revenue_ca").alias("revenue"), count_if(F.col("is_crbt")).alias("crbt_n"),
        F.sum("crbt_amount").alias("crbt_amount"), count_if(days > late_threshold).alias("late_n"),
        F.count(sane).alias("interval_n"), F.sum(sane.cast("bigint")).alias("interval_days"),
        F.count(w).alias("weight_n"), F.sum(w).alias("weight_sum"), F.min(w).alias("weight_min"), F.max(w).alias("weight_max"))


def merge_cubes(cubes: list[DataFrame]) -> DataFrame:
    """The cube of all rows, from cubes of their parts."""
    merged = reduce(DataFrame.unionByName, cubes).groupBy(*DIMENSIONS)
    return merged.agg(*[getattr(F, how)(c).alias(c) for c, how in MEASURES.items()])


def _n(cond=None):
    """Rows of the cube's cells, as a count."""
    own = F.col("n") if cond is None else F.when(cond, F.col("n"))
    return F.coalesce(F.sum(own), F.lit(0))


def kpis(cube: DataFrame, late_threshold: int = LATE_THRESHOLD_DAYS) -> DataFrame:
    """``aggregates.kpi_summary`` from the cube (which counts late rows beyond its own threshold)."""
    total, delivered = _n(), _n(F.col("is_delivered"))
    money = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0)), 2).cast(MONEY2)
    return cube.agg(
        total.alias("total_shipments"), money("revenue").alias("total_revenue"), F.coalesce(F.sum("crbt_n"), F.lit(0)).alias("total_crbt_count"),
        money("crbt_amount").alias("total_crbt_amount"), delivered.alias("delivered"), (total - delivered).alias("failed"),
        F.coalesce(F.bround(F.try_divide(delivered * F.lit(100.0), total), 1), F.lit(0.0)).alias("delivery_rate"),
        F.bround(F.try_divide(F.sum("interval_days").cast("double"), F.sum("interval_n")), 2).alias("avg_interval_days"),
        F.coalesce(F.sum("late_n"), F.lit(0)).alias("late_deliveries"), F.lit(late_threshold).alias("late_threshold"))


def _counted(cube: DataFrame, key: str) -> DataFrame:
    return cube.groupBy(key).agg(_n().alias("shipments"))


def _most(cube: DataFrame, key: str, limit: int) -> DataFrame:
    top = _counted(cube, key).orderBy(F.desc("shipments"), F.asc_nulls_first(key)).limit(limit)
    return top.select(display_key(key).alias(key), "shipments")


def monthly(cube: DataFrame) -> DataFrame:
    g = cube.filter(F.col("deposit_year").isNotNull() | F.col("deposit_month").isNotNull()).groupBy("deposit_year", "deposit_month").agg(
        _n().alias("shipments"), F.coalesce(F.sum("revenue"), F.lit(0)).cast(MONEY).alias("revenue"), _n(F.col("is_delivered")).alias("delivered"))
    return g.select("deposit_year", "deposit_month", year_month_label("deposit_year", "deposit_month").alias("label"), "shipments", "revenue",
                    "delivered").orderBy("deposit_year", "deposit_month")


def weights(cube: DataFrame) -> DataFrame:
    total = F.sum("weight_sum")
    return cube.agg(F.bround(F.try_divide(total, F.sum("weight_n")), 2).alias("avg_weight"), F.min("weight_min").alias("min_weight"),
                    F.max("weight_max").alias("max_weight"), F.bround(F.coalesce(total, F.lit(0.0)), 1).alias("total_weight"))


def weight_bands(cube: DataFrame) -> DataFrame:
    counts = cube.agg(*[_n(F.col("weight_band") == lbl).alias(f"b{i}") for i, (_, _, lbl) in enumerate(WEIGHT_BANDS)])
    stack = ", ".join(f"{i}, '{lbl}', b{i}" for i, (_, _, lbl) in enumerate(WEIGHT_BANDS))
    return counts.selectExpr(f"stack({len(WEIGHT_BANDS)}, {stack}) AS (band_order, band, shipments)").orderBy("band_order")


def dashboard_from(cube: DataFrame, region=None, next_regions=None, categories=None, offices: int = 15, causes: int = 12) -> dict[str, DataFrame]:
    """All ten parts from a cube and one filter set; the two region group-bys ignore the region filter."""
    scoped = filter_combined(cube, region, next_regions, categories)
    unscoped = filter_combined(cube, None, next_regions, categories)
    delivered, total = _n(F.col("is_delivered")), _n()
    revenue = unscoped.groupBy("depot_region").agg(F.coalesce(F.sum("revenue"), F.lit(0)).cast(MONEY).alias("revenue"))
    return {
        "regions": distinct_regions(cube), "kpis": kpis(scoped),
        "by_region": _counted(unscoped, "depot_region").select(display_key("depot_region").alias("depot_region"), "shipments")
        .orderBy(F.desc("shipments"), "depot_region"),
        "by_office": _most(scoped, "depot_office", offices),
        "delivery_status": scoped.agg(delivered.alias("delivered"), (total - delivered).alias("failed"), total.alias("total")),
        "failure_causes": _most(scoped.filter(~F.col("is_delivered")), "last_event", causes),
        "monthly": monthly(scoped), "weight_stats": weights(scoped), "weight_buckets": weight_bands(scoped),
        "revenue_by_region": revenue.select(display_key("depot_region").alias("depot_region"), "revenue").orderBy(F.desc("revenue"), "depot_region"),
    }


def dashboard_bundle(df: DataFrame, region=None, next_regions=None, categories=None) -> dict[str, DataFrame]:
    """Every dashboard series from one filter set and one pass over the shipments: the cube is written
    once, and all parts are computed from it."""
    return dashboard_from(materialize(dashboard_cube(df)), region, next_regions, categories)
