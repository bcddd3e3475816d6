"""A choice among theta models for each series ``(unique_id, ds, y)``.

A theta model forecasts the smoothed level plus a share of the line's slope; the
shares ``1 - 1/theta`` run from none (theta 1, plain smoothing) to 4/5 (theta 5). The
choice among them, and of the smoothing constant, goes by one-step errors at rolling
origins: at each day the line is the regression over the days before it (a running
window), the level is what smoothing has reached, and the errors of all shares add
up in one fold over the series, one for each constant.

The season (weekday factors over the whole history) is removed only where an
autocorrelation test of the series as it is finds one: |r5| above 1.645 standard errors,
with 10 days or more.

Defined results: a series of fewer than three days has no error to choose by and takes
the first setting (smallest constant, no slope); a constant series forecasts itself;
ties go to the smaller constant, then the smaller share. Work is in arrays and windows
of one series' days (bounded by the calendar).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .forecast import SES_ALPHAS

THETAS = (1.0, 1.5, 2.0, 3.0, 5.0)
#: Share of the slope of each theta.
SHARES = [1 - 1 / t for t in THETAS]
SEASON, LEAST_DAYS, Z = 5, 10, 1.645


def _seasonal(train: DataFrame) -> DataFrame:
    """The days with their position ``t``, their weekday's factor and the deseasonalised value ``ya``."""
    order, own, all_ = W.partitionBy("unique_id").orderBy("ds"), W.partitionBy("unique_id", "dow"), W.partitionBy("unique_id")
    days = train.select("unique_id", "ds", F.col("y").cast("double").alias("y"), F.weekday("ds").alias("dow"))
    days = days.select("*", F.row_number().over(order).alias("t"), F.count(F.lit(1)).over(all_).alias("n"), F.avg("y").over(all_).alias("m"),
                       F.avg("y").over(own).alias("md"))
    off = F.col("y") - F.col("m")
    days = days.select("*", *[(off * F.lag(off, k).over(order)).alias(f"p{k}") for k in range(1, SEASON + 1)])
    square = F.nullif(F.sum(off * off).over(all_), F.lit(0.0))
    r = [F.coalesce(F.sum(f"p{k}").over(all_) / square, F.lit(0.0)) for k in range(1, SEASON + 1)]
    error = F.sqrt((F.lit(1.0) + F.lit(2.0) * sum((x * x for x in r[1:-1]), r[0] * r[0])) / F.col("n"))
    days = days.withColumn("seasonal", (F.col("n") >= LEAST_DAYS) & (F.abs(r[-1]) > F.lit(Z) * error))
    factor = F.when(F.col("seasonal") & (F.col("m") > 0) & (F.col("md") > 0), F.col("md") / F.col("m")).otherwise(1.0)
    days = days.withColumn("factor", factor)
    return days.select("unique_id", "ds", "dow", "t", "n", "seasonal", "factor", (F.col("y") / F.col("factor")).alias("ya"))


def _fold(alpha: float) -> Column:
    """(level, (1 - alpha)^(n - 1), sum of squared errors of each share) after the days in ``pts``."""
    keep = 1 - alpha

    def step(s: Column, x: Column) -> Column:
        drift = x["b"] * (F.lit(1.0) + F.lit(keep / alpha) * (F.lit(1.0) - s["q"]))
        miss = [x["ya"] - s["level"] - F.lit(w) * drift for w in SHARES]
        return F.struct((F.lit(alpha) * x["ya"] + F.lit(keep) * s["level"]).alias("level"), (s["q"] * F.lit(keep)).alias("q"),
                        *[(s[f"e{k}"] + F.coalesce(m * m, F.lit(0.0))).alias(f"e{k}") for k, m in enumerate(miss)])

    first = F.struct(F.col("pts")[0]["ya"].alias("level"), F.lit(1.0).alias("q"), *[F.lit(0.0).alias(f"e{k}") for k in range(len(SHARES))])
    return F.aggregate(F.slice("pts", 2, F.greatest(F.size("pts") - 1, F.lit(0))), first, step)


def auto_theta_fit(train: DataFrame) -> DataFrame:
    """One row a series: last date, n, slope b, weekday factors, whether seasonal, and the chosen constant, share, level and error."""
    days = _seasonal(train)
    before = W.partitionBy("unique_id").orderBy("t").rowsBetween(W.unboundedPreceding, -1)
    days = days.withColumn("b", F.when(F.col("t") > 2, F.regr_slope("ya", "t").over(before)))
    state = days.groupBy("unique_id").agg(
        F.max("ds").alias("last_ds"), F.count(F.lit(1)).alias("n"), F.coalesce(F.regr_slope("ya", "t"), F.lit(0.0)).alias("slope"),
        F.first("seasonal").alias("seasonal"), F.map_from_entries(F.collect_set(F.struct("dow", "factor"))).alias("factors"),
        F.sort_array(F.collect_list(F.struct("t", "ya", "b"))).alias("pts"))
    state = state.withColumn("fits", F.array(*[F.struct(F.lit(a).alias("alpha"), _fold(a).alias("f")) for a in SES_ALPHAS]))
    each = F.flatten(F.transform("fits", lambda s: F.array(*[
        F.struct(s["f"][f"e{k}"].alias("sse"), s["alpha"].alias("alpha"), F.lit(w).alias("share"), s["f"]["level"].alias("level"), s["f"]["q"].alias("q"))
        for k, w in enumerate(SHARES)])))
    best = state.select("unique_id", "last_ds", "n", "slope", "seasonal", "factors", F.array_min(each).alias("best"))
    return best.select("unique_id", "last_ds", "n", "slope", "seasonal", "factors", "best.alpha", "best.share", "best.level", "best.q",
                       F.sqrt(F.col("best.sse") / F.greatest(F.col("n") - 2, F.lit(1))).alias("error"))


def auto_theta_forecast(train: DataFrame, h: int) -> DataFrame:
    """``h`` business-day forecasts of each series by its chosen model, clipped at 0, with the residual
    scale ``sigma`` (it grows with the step as for ``theta_forecast``) and the choice."""
    state = auto_theta_fit(train)
    days = F.filter(F.sequence(F.date_add("last_ds", 1), F.date_add("last_ds", h // 5 * 7 + 7)), lambda d: F.weekday(d) < 5)
    fut = state.select("*", F.posexplode(F.slice(days, 1, h)).alias("k", "ds"))
    step, alpha = F.col("k") + 1, F.col("alpha")
    factor = F.coalesce(F.col("factors")[F.weekday("ds")], F.lit(1.0))
    y = F.col("level") + F.col("share") * F.col("slope") * (step + (F.lit(1.0) - alpha) / alpha * (F.lit(1.0) - F.col("q")))
    return fut.select("unique_id", "ds", step.alias("step"), F.greatest(y * factor, F.lit(0.0)).alias("y_hat"),
                      (F.col("error") * F.sqrt(F.lit(1.0) + (step - 1) * alpha * alpha) * factor).alias("sigma"),
                      (F.lit(1.0) / (F.lit(1.0) - F.col("share"))).alias("theta"), "alpha", "seasonal")
