"""Report tables over any date range, from prefix sums by day.

``day_prefixes`` reads the rows once. For each (region, office, event) and day it
holds the sums over all days up to that one, and the next day that changes
them; rows without a date have sums of their own. A range's sums are then
one row's less another's, for every key, plus the undated row: a second range
reads no shipment row.

Weights are summed as decimals of nine places, so that the difference of two
long sums loses nothing.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .aggregates import count_if
from .report import _is_crbt, _scope, delivery_pivot, depot_totals

KEYS = ["region", "office", "event"]
SUMS = {"n": "bigint", "n_crbt": "bigint", "ca_sum": "decimal(38,3)", "poids_sum": "decimal(38,9)"}


def day_prefixes(df: DataFrame, keys: dict) -> DataFrame:
    """(region, office, event, from_day, to_day, sums): sums of all days up to ``from_day``, which hold
    before ``to_day`` (NULL: from then on). One row a key has the sums of undated rows, its ``from_day`` NULL.

    ``keys`` names region, office and date column (``report.DEPOT``, ``report.LIVRAISON``). A window
    holds the days of one key, as many as the calendar has, never shipment rows."""
    rows = _scope(df, keys, None).withColumn("event", F.col("last_event")).withColumn("day", F.col(keys["date"]).cast("date"))
    daily = rows.groupBy(*KEYS, "day").agg(
        F.count(F.lit(1)).alias("n"), count_if(_is_crbt()).alias("n_crbt"),
        F.sum(F.coalesce("revenue_ca", F.lit(0))).cast(SUMS["ca_sum"]).alias("ca_sum"),
        F.sum(F.coalesce(F.col("weight_kg").cast("decimal(28,9)"), F.lit(0))).cast(SUMS["poids_sum"]).alias("poids_sum"))
    days = W.partitionBy(*KEYS, F.col("day").isNull()).orderBy("day")
    upto = days.rowsBetween(W.unboundedPreceding, W.currentRow)
    return daily.select(*KEYS, F.col("day").alias("from_day"), F.lead("day").over(days).alias("to_day"),
                        *[F.sum(c).over(upto).cast(t).alias(c) for c, t in SUMS.items()])


def write_prefixes(df: DataFrame, keys: dict, path: str) -> None:
    """``day_prefixes`` as a table at ``path``, ordered by key in each file so that a region's rows lie together."""
    day_prefixes(df, keys).sortWithinPartitions(*KEYS, "from_day").write.mode("overwrite").parquet(path)


def _date(x) -> dt.date | None:
    return x if x is None or (isinstance(x, dt.date) and not isinstance(x, dt.datetime)) else dt.date.fromisoformat(str(x)[:10])


def between(prefixes: DataFrame, lo=None, hi=None, region: str | None = None, categories=None) -> DataFrame:
    """(region, office, event, sums) of the rows without a date or with one inside [lo, hi]; a bound may be open."""
    from ..functions.cleaning import bureau_category

    lo, hi = _date(lo), _date(hi)
    rows = prefixes if not region else prefixes.filter(F.col("region") == F.lit(region))
    if categories:
        rows = rows.filter(bureau_category(F.col("office")).isin(*categories))

    def holds(day: dt.date | None):
        """The row whose sums hold on ``day`` (None: at the end)."""
        if day is None:
            return F.col("from_day").isNotNull() & F.col("to_day").isNull()
        return (F.col("from_day") <= F.lit(day)) & (F.col("to_day").isNull() | (F.col("to_day") > F.lit(day)))

    undated = F.col("from_day").isNull()
    if lo is not None and hi is not None and lo > hi:
        upto = before = F.lit(False)
    else:
        upto = holds(hi)
        before = holds(lo - dt.timedelta(days=1)) if lo is not None else F.lit(False)
    rows = rows.filter(undated | upto | before)
    sign = F.when(undated, 1).otherwise(F.when(upto, 1).otherwise(0) - F.when(before, 1).otherwise(0))
    sums = [F.sum(F.when(sign == 1, F.col(c)).when(sign == -1, -F.col(c))).alias(c) for c in SUMS]
    return rows.groupBy(*KEYS).agg(*sums).filter(F.col("n") > 0).withColumn("poids_sum", F.col("poids_sum").cast("double"))


def depot_window(prefixes: DataFrame, lo=None, hi=None, region: str | None = None, categories=None) -> DataFrame:
    """``report.depot_table`` over a date range, from ``day_prefixes`` by depot."""
    fine = between(prefixes, lo, hi, region, categories)
    return depot_totals(fine.select("region", "office", F.col("n_crbt").alias("crbt"), F.col("ca_sum").alias("ca"),
                                    F.col("poids_sum").alias("poids"), F.col("n").alias("nb_ids")))


def livraison_window(prefixes: DataFrame, lo=None, hi=None, region: str | None = None, categories=None, events=None) -> DataFrame:
    """``report.livraison_table`` over a date range, from ``day_prefixes`` by delivery office."""
    return delivery_pivot(between(prefixes, lo, hi, region, categories), events)
