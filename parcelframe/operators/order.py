"""Positions and running counts in a global order, without gathering the rows in one task.

Rows are sorted by range partitions and written; a row's position is its place
in its partition plus the sizes of the partitions before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .quantiles import exact_quantiles  # noqa: F401

BUCKETS = 200


def with_position(df: DataFrame, order, out: str = "position") -> DataFrame:
    """Rows with their 0-based position in the order of ``order`` (names or sort columns)."""
    tagged = materialize(df.orderBy(*order)).withColumn("_id", F.monotonically_increasing_id())
    tagged = tagged.withColumn("_p", F.shiftright("_id", 33)).withColumn("_k", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = tagged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    before = sizes.select("_p", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_before"))
    return tagged.join(before, "_p").withColumn(out, F.col("_before") + F.col("_k")).drop("_p", "_k", "_id", "_before")


def running_counts(df: DataFrame, value: Column, by=()) -> DataFrame:
    """(by…, v, n, lo, total): for each distinct value of each group its rows, the rows with smaller
    values, and all rows. NULL and NaN are left out.

    Distinct values are dealt into ranges by approximate quantiles; a running
    sum covers one range, and offsets of ranges are sums over at most
    ``BUCKETS`` rows a group.
    """
    by = list(by)
    counts = materialize(df.select(*by, value.cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
                         .groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n")))
    bounds = sorted(set(counts.approxQuantile("v", [i / BUCKETS for i in range(1, BUCKETS)], 0.002)))
    edges = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<double>")
    dealt = counts.withColumn("_r", F.size(F.filter(edges, lambda b: b < F.col("v"))))
    keys = [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]
    group = [f"_by{i}" for i in range(len(by))]
    sums = dealt.groupBy(*by, "_r").agg(F.sum("n").alias("_s")).select(*keys, F.col("_r").alias("_range"), "_s")
    offsets = sums.select(*group, "_range", (F.sum("_s").over(W.partitionBy(*group).orderBy("_range")) - F.col("_s")).alias("_off"),
                          F.sum("_s").over(W.partitionBy(*group)).alias("total"))
    inside = dealt.withColumn("_before", F.sum("n").over(W.partitionBy(*by, "_r").orderBy("v")) - F.col("n"))
    same = F.col("_r") == F.col("_range")
    for c, g in zip(by, group):
        same = same & F.col(c).eqNullSafe(F.col(g))
    return inside.join(offsets, same).select(*by, "v", "n", (F.col("_off") + F.col("_before")).alias("lo"), "total")
