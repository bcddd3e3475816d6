"""Exploratory statistics as aggregations.

Exact quantiles (linear interpolation, as pandas) come from brackets
(``quantiles``), so no group's values are ordered or meet in one task.
Scalar statistics needed as parameters (min/max for bin edges) are single
numbers fetched with one small aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.formatting import WEIGHT_CLASSES, weight_class
from .order import running_counts
from .quantiles import exact_quantiles


def missing_profile(df: DataFrame, columns=None) -> DataFrame:
    """Missing count and percentage per column (only columns with some), most first."""
    cols = list(columns or df.columns)
    total = F.count(F.lit(1))
    wide = df.agg(total.alias("_n"), *[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"m{i}")
                                       for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c}', m{i}" for i, c in enumerate(cols))
    long = wide.selectExpr("_n", f"stack({len(cols)}, {stack}) AS (column_name, missing)")
    return (long.filter(F.col("missing") > 0)
            .select("column_name", "missing",
                    F.round(F.col("missing") * F.lit(100.0) / F.col("_n"), 2).alias("missing_pct"))
            .orderBy(F.desc("missing"), "column_name"))


def describe(df: DataFrame, column: str, by=None, exact: bool = True) -> DataFrame:
    """count, mean, std (sample), min, 25/50/75 % (interpolated), max.

    Exact quantiles come from brackets (``quantiles.exact_quantiles``), whose first
    pass gives the other numbers too; ``exact=False`` takes Spark's sketch instead."""
    by, x = list(by or []), F.col("_x")
    cols = [F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")]
    ps = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    if exact:
        stats = exact_quantiles(df, F.col(column), ps, by, cols)
    else:
        rows = df.select(*by, F.col(column).cast("double").alias("_x"))
        cols += [F.percentile_approx(x, p, 100000).alias(n) for n, p in ps.items()]
        stats = rows.groupBy(*by).agg(*cols) if by else rows.agg(*cols)
    return stats.select(*by, "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def _minmax(df: DataFrame, x: Column) -> tuple[float | None, float | None]:
    r = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    return r["lo"], r["hi"]


def histogram(df: DataFrame, column: str, bins: int = 60, log10: bool = False) -> DataFrame:
    """Equal-width histogram over [min, max] (numpy rule: last bin closed);
    ``log10`` bins log10(x) over x > 0. Empty bins are listed with 0."""
    x = F.col(column).cast("double")
    src = df.filter(x > 0).select(F.log10(x).alias("v")) if log10 else df.select(x.alias("v"))
    src = src.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    lo, hi = _minmax(src, F.col("v"))
    spark = df.sparkSession
    edges = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    if lo is None:
        return edges.select("bin", F.lit(None).cast("double").alias("lower"),
                            F.lit(None).cast("double").alias("upper"), F.lit(0).cast("bigint").alias("n"))
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    counts = src.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return (edges.join(counts, "bin", "left")
            .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def weight_class_share(df: DataFrame, column: str = "weight_kg") -> DataFrame:
    """Rows and share per weight class (fixed class list, empty classes kept),
    counted in one aggregation and unpivoted with ``stack``."""
    cls = weight_class(column)
    counts = df.agg(*[F.count(F.when(cls == F.lit(lbl), 1)).alias(f"c{i}")
                      for i, (_, _, lbl) in enumerate(WEIGHT_CLASSES)])
    stack = ", ".join(f"{i}, '{lbl}', c{i}" for i, (_, _, lbl) in enumerate(WEIGHT_CLASSES))
    long = counts.selectExpr(f"stack({len(WEIGHT_CLASSES)}, {stack}) AS (class_order, weight_class, n)")
    total = F.sum("n").over(W.partitionBy())  # over the fixed class rows only
    return long.select("class_order", "weight_class", "n", F.round(F.col("n") * F.lit(100.0) / total, 4).alias("share_pct"))


def corr_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("corr"))


def corr_matrix(df: DataFrame, columns) -> DataFrame:
    """Pearson correlation for every pair, pairwise-complete, in one aggregation."""
    cols = list(columns)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{k}")
                    for k, (a, b) in enumerate(pairs)])
    stack = ", ".join(f"'{a}', '{b}', c{k}" for k, (a, b) in enumerate(pairs))
    return wide.selectExpr(f"stack({len(pairs)}, {stack}) AS (col_a, col_b, corr)")


def ols_trend(df: DataFrame, y: str, x: str) -> DataFrame:
    yy, xx = F.col(y).cast("double"), F.col(x).cast("double")
    return df.agg(F.regr_slope(yy, xx).alias("slope"), F.regr_intercept(yy, xx).alias("intercept"),
                  F.regr_r2(yy, xx).alias("r2"), F.regr_count(yy, xx).alias("n"))


def box_by_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles and 1.5·IQR whiskers (most extreme values inside the fences) per group: the quartiles
    by brackets, then one aggregation against each group's fences."""
    q = exact_quantiles(df, F.col(value), {"q1": 0.25, "median": 0.5, "q3": 0.75}, [group]).select(F.col(group).alias("_g"), "q1", "median", "q3")
    v = F.col(value).cast("double")
    rows = df.select(group, v.alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    iqr = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    inside = F.col("_v").between(F.col("q1") - iqr, F.col("q3") + iqr)
    joined = rows.join(q, F.col(group).eqNullSafe(F.col("_g")))
    return joined.groupBy(group, "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"), F.count(F.when(~inside, 1)).alias("outliers"))


def ecdf(df: DataFrame, column: str) -> DataFrame:
    """Empirical CDF at each distinct value: share of rows ≤ value.

    Rows are first reduced to (value, count) — a distributed group-by — and
    the running sums go by ranges of values."""
    runs = running_counts(df, F.col(column))
    kind = df.schema[column].dataType
    return runs.select(F.col("v").cast(kind).alias(column), "n", ((F.col("lo") + F.col("n")) / F.col("total")).alias("ecdf"))


def period_span(df: DataFrame, column: str) -> DataFrame:
    d = F.to_date(F.col(column))
    return df.agg(F.min(d).alias("first_day"), F.max(d).alias("last_day"),
                  (F.datediff(F.max(d), F.min(d)) + 1).alias("span_days"),
                  F.countDistinct(d).alias("distinct_days"))
