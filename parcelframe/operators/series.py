"""Daily business-day series: panels, calendar fill, lag/rolling features, splits.

Scale note: every window here runs on *daily aggregated* series, partitioned
by series id, so one window partition holds one series' days (bounded by the
calendar, thousands of rows), never raw shipment rows. Global scalars (first
date) are fetched as one number; calendars are generated from the min/max row
with ``sequence`` (bounded by the date span).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.temporal import calendar_parts, cyclic_parts
from .order import with_position

UNKNOWN_GROUP = "INCONNU"


def _clip0(c: Column) -> Column:
    return F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0))


def daily_panel(df: DataFrame, group: str, date_col: str = "deposit_date", weight: str = "weight_kg",
                revenue: str | None = "revenue_ca", id_col: str = "mailitm_fid") -> DataFrame:
    """Per (business day, group): summed weight and revenue (negatives and NULL
    count as 0) and the number of shipments. NULL group → ``INCONNU``."""
    ds = F.to_date(F.col(date_col))
    base = df.filter(ds.isNotNull() & (F.weekday(ds) < 5))
    aggs = [F.sum(_clip0(F.col(weight))).alias("poids")]
    if revenue:
        aggs.append(F.sum(_clip0(F.col(revenue))).alias("CA"))
    aggs.append(F.count(F.col(id_col)).alias("nb_envois"))
    return base.groupBy(ds.alias("ds"), F.coalesce(F.col(group).cast("string"), F.lit(UNKNOWN_GROUP))
                        .alias("unique_id")).agg(*aggs)


def daily_total(panel: DataFrame, targets=("poids", "CA", "nb_envois")) -> DataFrame:
    return panel.groupBy("ds").agg(*[F.sum(t).alias(t) for t in targets if t in panel.columns])


def calendar_fill(daily: DataFrame, value_cols, ds: str = "ds", business_days_only: bool = True,
                  key: str | None = None) -> DataFrame:
    """Reindex onto every (business) day between the first and last date, of each series where ``key``
    names one; missing → 0."""
    keys = [key] if key else []
    span = daily.groupBy(*keys).agg(F.min(ds).alias("lo"), F.max(ds).alias("hi"))
    cal = span.where("lo IS NOT NULL").select(*keys, F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias(ds))
    if business_days_only:
        cal = cal.filter(F.weekday(ds) < 5)
    out = cal.join(daily, [*keys, ds], "left")
    return out.select(*keys, ds, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in value_cols])


def daily_series(df: DataFrame, date_col: str = "deposit_date", weight: str = "weight_kg",
                 revenue: str = "revenue_ca", dedup_cols=None) -> DataFrame:
    """Single national series: drop rows without date/weight, drop duplicate rows,
    sum weight and revenue per day, calendar-fill business days with 0."""
    base = df.filter(F.col(date_col).isNotNull() & F.col(weight).isNotNull())
    if dedup_cols:
        base = base.dropDuplicates(list(dedup_cols))
    daily = base.groupBy(F.to_date(date_col).alias("ds")).agg(
        F.sum(F.col(weight).cast("double")).alias("poids"),
        F.sum(F.col(revenue).cast("double")).alias("CA"))
    return calendar_fill(daily, ["poids", "CA"])


def to_long_series(panel: DataFrame, target: str, min_obs: int = 20) -> DataFrame:
    """(unique_id, ds, y): NULL targets dropped, y clipped at 0, series with fewer
    than ``min_obs`` observations removed (group-by counts + left-semi join)."""
    long = (panel.filter(F.col(target).isNotNull())
            .select("unique_id", "ds", F.greatest(F.col(target).cast("double"), F.lit(0.0)).alias("y")))
    keep = long.groupBy("unique_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_obs)
    return long.join(keep.select("unique_id"), "unique_id", "left_semi")


def _w(key: str | None, ds: str) -> W:
    return (W.partitionBy(key) if key else W.partitionBy()).orderBy(ds)


def lag_features(df: DataFrame, lags, key: str | None = "unique_id", ds: str = "ds", y: str = "y") -> DataFrame:
    w = _w(key, ds)
    return df.select("*", *[F.lag(y, k).over(w).alias(f"lag_{k}") for k in lags])


def rolling_features(df: DataFrame, windows, key: str | None = "unique_id", ds: str = "ds", y: str = "y",
                     full: bool = False, with_max: bool = True) -> DataFrame:
    """Statistics over the ``w`` rows *before* the current one.

    ``full=False`` (min_periods = 1): mean, std, max; a missing std is 0 (also
    on a series' first row, where mean and max are still missing).
    ``full=True``: mean and std only once ``w`` values exist, else NULL.
    """
    base = _w(key, ds)
    cols = []
    for w in windows:
        frame = base.rowsBetween(-w, -1)
        mean, std, mx = F.avg(y).over(frame), F.stddev_samp(y).over(frame), F.max(y).over(frame)
        if full:
            enough = F.count(y).over(frame) == w
            cols += [F.when(enough, mean).alias(f"roll_mean_{w}"), F.when(enough, std).alias(f"roll_std_{w}")]
        else:
            cols += [mean.alias(f"roll_mean_{w}"), F.coalesce(std, F.lit(0.0)).alias(f"roll_std_{w}")]
            if with_max:
                cols.append(mx.alias(f"roll_max_{w}"))
    return df.select("*", *cols)


def moving_average(df: DataFrame, w: int, key: str | None = None, ds: str = "ds", y: str = "y") -> DataFrame:
    """Trailing mean including the current row; NULL until ``w`` values exist."""
    frame = _w(key, ds).rowsBetween(-(w - 1), 0)
    return df.withColumn(f"ma_{w}", F.when(F.count(y).over(frame) == w, F.avg(y).over(frame)))


def week_over_week(df: DataFrame, key: str | None = "unique_id", ds: str = "ds", y: str = "y",
                   lag: int = 5) -> DataFrame:
    """``wow_lag`` = y five rows back; ``wow_ratio`` = y / wow_lag (NULL when 0)."""
    prev = F.lag(y, lag).over(_w(key, ds))
    return df.withColumn("wow_lag", prev).withColumn(
        "wow_ratio", F.col(y) / F.nullif(F.col("wow_lag"), F.lit(0.0)))


def first_date(df: DataFrame, ds: str = "ds"):
    return df.agg(F.min(ds).alias("m")).first()["m"]


def trend_days(df: DataFrame, ds: str = "ds", origin=None) -> DataFrame:
    """Days since the first date of the whole frame (one scalar)."""
    origin = origin if origin is not None else first_date(df, ds)
    return df.withColumn("trend", F.datediff(F.col(ds), F.lit(origin)))


def label_encode(df: DataFrame, col: str, out: str = "uid_enc") -> DataFrame:
    """0-based code in sorted order of the distinct values, by range partitions of the distinct list."""
    codes = with_position(df.select(col).where(F.col(col).isNotNull()).distinct(), [col], out)
    return df.join(codes.withColumn(out, F.col(out).cast("int")), col, "left")


def add_features(long: DataFrame, lags=(1, 2, 3, 5, 10, 22), windows=(5, 10, 22)) -> DataFrame:
    """Panel features: calendar, cyclic, trend, lags, rolling (min_periods=1),
    week-over-week, series code; rows without the longest lag are dropped."""
    df = long
    cal = calendar_parts("ds")
    df = df.select("*", cal["dayofweek"].alias("dayofweek"), cal["day"].alias("dayofmonth"),
                   cal["month"].alias("month"), cal["quarter"].alias("quarter"), cal["year"].alias("year"),
                   *[c.alias(n) for n, c in cyclic_parts("ds").items()])
    df = trend_days(df)
    df = lag_features(df, lags)
    df = rolling_features(df, windows)
    df = week_over_week(df)
    df = label_encode(df, "unique_id")
    return df.filter(F.col(f"lag_{max(lags)}").isNotNull())


def add_features_single(series: DataFrame, target: str, lags=(1, 2, 3, 5, 10, 20),
                        windows=(5, 10, 20)) -> DataFrame:
    """Single-series features (full windows); rows with any missing feature dropped."""
    df = series.select("ds", F.col(target).alias("y"))
    cal = calendar_parts("ds")
    df = df.select("*", *[cal[k].alias(k) for k in ("dayofweek", "day", "month", "quarter", "weekofyear",
                                                     "is_month_start", "is_month_end")])
    df = lag_features(df, lags, key=None)
    df = rolling_features(df, windows, key=None, full=True, with_max=False)
    return df.dropna()


def train_test_cutoff(long: DataFrame, horizon: int = 30, by=()) -> DataFrame:
    """Split at the h-th last distinct date, ``h = min(horizon, max(5, n − 20))``;
    with ``by``, of each group of series.

    The ranking runs over the distinct dates only (bounded by the calendar).
    """
    by = list(by)
    dates = long.select(*by, "ds").distinct()
    ranked = dates.select(*by, "ds", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("ds"))).alias("_r"),
                          F.count(F.lit(1)).over(W.partitionBy(*by)).alias("_n"))
    h = F.least(F.lit(horizon), F.greatest(F.lit(5), F.col("_n") - 20))
    cut = ranked.filter(F.col("_r") == h).select(*by, F.col("ds").alias("_cut"))
    if by:
        long = long.join(cut, by, "left")  # fewer distinct dates than h: everything is training data
        return long.withColumn("split", F.when(F.col("ds") >= F.col("_cut"), "test").otherwise("train")).drop("_cut")
    row = cut.first()
    if row is None:
        return long.withColumn("split", F.lit("train"))
    return long.withColumn("split", F.when(F.col("ds") < F.lit(row["_cut"]), F.lit("train"))
                           .otherwise(F.lit("test")))


def tail_split(long: DataFrame, h: int, key: str | None = "unique_id", ds: str = "ds") -> DataFrame:
    """Last ``h`` rows of each series are test."""
    w = (W.partitionBy(key) if key else W.partitionBy()).orderBy(F.desc(ds))
    return long.withColumn("split", F.when(F.row_number().over(w) <= h, F.lit("test")).otherwise(F.lit("train")))


def chrono_split(df: DataFrame, train_ratio: float = 0.75, val_ratio: float = 0.15, min_obs: int = 20,
                 key: str | None = None, ds: str = "ds") -> DataFrame:
    """Positional train / validation / test split of each series:
    ``train_end = max(min_obs, ⌊n·tr⌋)``, ``val_end = min(n−1, max(train_end+1, ⌊n·(tr+va)⌋))``."""
    part = W.partitionBy(key) if key else W.partitionBy()
    pos = F.row_number().over(part.orderBy(ds)) - 1
    n = F.count(F.lit(1)).over(part)
    train_end = F.greatest(F.lit(min_obs), F.floor(n * F.lit(train_ratio)))
    val_end = F.least(n - 1, F.greatest(train_end + 1, F.floor(n * F.lit(train_ratio + val_ratio))))
    out = df.withColumn("_pos", pos).withColumn("_te", train_end).withColumn("_ve", val_end)
    return out.withColumn("split", F.when(F.col("_pos") < F.col("_te"), F.lit("train"))
                          .when(F.col("_pos") < F.col("_ve"), F.lit("validation"))
                          .otherwise(F.lit("test"))).drop("_pos", "_te", "_ve")


def future_business_days(long: DataFrame, h: int, key: str = "unique_id", ds: str = "ds") -> DataFrame:
    """The next ``h`` weekdays after each series' last date."""
    last = long.groupBy(key).agg(F.max(ds).alias("_last"))
    span = h // 5 * 7 + 7
    days = last.select(key, F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", span)))
                       .alias(ds)).filter(F.weekday(ds) < 5)
    w = W.partitionBy(key).orderBy(ds)
    return days.withColumn("step", F.row_number().over(w)).filter(F.col("step") <= h)


def history_tail(long: DataFrame, n: int, key: str | None = "unique_id", ds: str = "ds") -> DataFrame:
    w = (W.partitionBy(key) if key else W.partitionBy()).orderBy(F.desc(ds))
    return long.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
