"""Forecasting and evaluation on long series ``(unique_id, ds, y)``.

* ``metrics`` — MAE, RMSE, SMAPE (0–200, zero denominator → 0), R² in one aggregation.
* Baselines — naive (last value) and seasonal naive (same weekday slot).
* ``theta_forecast`` — classical Theta: mean of the linear-trend line and the
  SES forecast of the θ=2 line, on weekday-deseasonalised data. Trend comes
  from ``regr_slope``/``regr_intercept`` per series; SES runs as an
  ``aggregate`` fold over each series' date-sorted array of daily values
  (bounded by the number of days in the series, not by raw rows), with the
  smoothing constant chosen per series from a fixed grid by in-sample SSE.
* ``gbt_forecast`` / ``tune_gbt`` / ``feature_importance`` — one global
  ``pyspark.ml`` GBTRegressor on lag/rolling features (stands in for the
  three boosting libraries), successive halving on a chronological validation split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.series import future_business_days

# Two-sided normal quantiles for the 80 % and 95 % bands.
Z_SCORES = {80: 1.2815515655446004, 95: 1.959963984540054}
# Smoothing constants tried for the SES step of Theta.
SES_ALPHAS = [round(0.05 * i, 2) for i in range(1, 20)]


def metrics(df: DataFrame, y: str = "y", yhat: str = "y_hat", by=None) -> DataFrame:
    t, p = F.col(y).cast("double"), F.col(yhat).cast("double")
    denom = (F.abs(t) + F.abs(p)) / 2
    sm = F.when(denom == 0, F.lit(0.0)).otherwise(F.abs(t - p) / denom)
    cols = [F.avg(F.abs(t - p)).alias("MAE"), F.sqrt(F.avg((t - p) * (t - p))).alias("RMSE"),
            (F.avg(sm) * 100).alias("SMAPE"),
            (F.lit(1.0) - F.sum((t - p) * (t - p)) / F.nullif(F.var_pop(t) * F.count(t), F.lit(0.0))).alias("R2")]
    return df.groupBy(*by).agg(*cols) if by else df.agg(*cols)


def naive_forecast(train: DataFrame, h: int) -> DataFrame:
    """Last observed value repeated over the next ``h`` business days."""
    last = train.withColumn("_r", F.row_number().over(W.partitionBy("unique_id").orderBy(F.desc("ds")))) \
        .filter(F.col("_r") == 1).select("unique_id", F.col("y").alias("y_hat"))
    return future_business_days(train, h).join(last, "unique_id").select("unique_id", "ds", "y_hat")


def seasonal_naive_forecast(train: DataFrame, h: int, season: int = 5) -> DataFrame:
    """Value of the same slot in the last full season: step k uses the
    ``season - ((k-1) mod season)``-th last observation."""
    tail = train.withColumn("_back", F.row_number().over(W.partitionBy("unique_id").orderBy(F.desc("ds")))) \
        .filter(F.col("_back") <= season).select("unique_id", "_back", F.col("y").alias("y_hat"))
    fut = future_business_days(train, h).withColumn("_back", F.lit(season) - F.pmod(F.col("step") - 1, F.lit(season)))
    return fut.join(tail, ["unique_id", "_back"]).select("unique_id", "ds", "y_hat")


def theta_fit(train: DataFrame, season_by_weekday: bool = True) -> DataFrame:
    """One row per series: last date, n, trend (a, b), SES level, alpha and one-step error, weekday factors (a map).

    A series' days are one array (bounded by the calendar); weekday means,
    trend and smoothing run on it in one pass over one group-by.
    """
    points = train.groupBy("unique_id").agg(
        F.sort_array(F.collect_list(F.struct("ds", F.col("y").cast("double").alias("y")))).alias("days"))
    days = points.select("unique_id", F.posexplode("days").alias("t", "p")).select(
        "unique_id", (F.col("t") + 1).alias("t"), "p.ds", "p.y", F.weekday("p.ds").alias("dow"))
    day_mean = F.avg("y").over(W.partitionBy("unique_id", "dow"))
    mean = F.avg("y").over(W.partitionBy("unique_id"))
    factor = F.when((mean > 0) & (day_mean > 0), day_mean / mean).otherwise(1.0) if season_by_weekday else F.lit(1.0)
    flat = days.select("unique_id", "t", "ds", "dow", factor.alias("factor"), (F.col("y") / factor).alias("ya"))
    state = flat.groupBy("unique_id").agg(
        F.max("ds").alias("last_ds"), F.count(F.lit(1)).alias("n"), F.regr_intercept("ya", "t").alias("a"),
        F.regr_slope("ya", "t").alias("b"), F.sort_array(F.collect_list(F.struct("t", "ya"))).alias("pts"),
        F.map_from_entries(F.collect_set(F.struct("dow", "factor"))).alias("factors"))
    z = F.transform("pts", lambda p: F.lit(2.0) * p["ya"] - (F.col("a") + F.col("b") * p["t"]))
    state = state.withColumn("z", z)
    fold = F.transform(F.array(*[F.lit(x) for x in SES_ALPHAS]), lambda al: F.aggregate(
        "z",
        F.struct(F.lit(0.0).alias("sse"), al.alias("alpha"), F.col("z")[0].alias("level")),
        lambda acc, x: F.struct(
            (acc["sse"] + (x - acc["level"]) * (x - acc["level"])).alias("sse"),
            acc["alpha"].alias("alpha"),
            (acc["alpha"] * x + (F.lit(1.0) - acc["alpha"]) * acc["level"]).alias("level"))))
    best = state.select("unique_id", "last_ds", "n", "a", "b", "factors", F.array_min(fold).alias("best"))
    return best.select("unique_id", "last_ds", "n", "a", "b", "factors", F.col("best.alpha").alias("alpha"), F.col("best.level").alias("level"),
                       F.sqrt(F.col("best.sse") / F.greatest(F.col("n") - 1, F.lit(1))).alias("sigma_z"))


def theta_forecast(train: DataFrame, h: int, season_by_weekday: bool = True) -> DataFrame:
    """``h`` business-day Theta forecasts per series, clipped at 0, with the
    residual scale ``sigma``: the error of the smoothed line at weight ½, which
    grows with the step as its level drifts (variance times 1 + (step − 1)·α²)."""
    state = theta_fit(train, season_by_weekday)
    span = h // 5 * 7 + 7
    days = F.filter(F.sequence(F.date_add("last_ds", 1), F.date_add("last_ds", span)), lambda d: F.weekday(d) < 5)
    fut = state.select("*", F.posexplode(F.slice(days, 1, h)).alias("k", "ds"))
    step = F.col("k") + 1
    factor = F.coalesce(F.col("factors")[F.weekday("ds")], F.lit(1.0))
    trend = F.col("a") + F.col("b") * (F.col("n") + step)
    f = (F.lit(0.5) * trend + F.lit(0.5) * F.col("level")) * factor
    grown = F.sqrt(F.lit(1.0) + (step - 1) * F.col("alpha") * F.col("alpha"))
    return fut.select("unique_id", "ds", step.alias("step"), F.greatest(f, F.lit(0.0)).alias("y_hat"),
                      (F.lit(0.5) * F.col("sigma_z") * grown * factor).alias("sigma"))


def forecast_intervals(fc: DataFrame, levels=(80, 95), sigma: str = "sigma") -> DataFrame:
    """Lower/upper bands ``y_hat ∓ z·sigma``, all clipped at 0."""
    out = fc
    for lv in levels:
        z = F.lit(Z_SCORES[lv])
        out = (out.withColumn(f"lo_{lv}", F.greatest(F.col("y_hat") - z * F.col(sigma), F.lit(0.0)))
               .withColumn(f"hi_{lv}", F.greatest(F.col("y_hat") + z * F.col(sigma), F.lit(0.0))))
    return out


def naive_sigma(train: DataFrame) -> DataFrame:
    """Std of one-step naive errors per series (residual scale of the naive model)."""
    d = F.col("y") - F.lag("y", 1).over(W.partitionBy("unique_id").orderBy("ds"))
    return train.select("unique_id", d.alias("_e")).groupBy("unique_id").agg(F.stddev_samp("_e").alias("sigma"))


def join_forecast_actual(test: DataFrame, fc: DataFrame) -> DataFrame:
    return test.join(fc, ["unique_id", "ds"], "inner")


def forecast_metrics_by_model(test: DataFrame, forecasts: dict[str, DataFrame]) -> DataFrame:
    """Inner-join each model's forecasts to the test rows; metrics per model."""
    parts = [join_forecast_actual(test.select("unique_id", "ds", "y"), f.select("unique_id", "ds", "y_hat"))
             .withColumn("model", F.lit(name)) for name, f in forecasts.items()]
    return metrics(reduce(DataFrame.unionByName, parts), by=["model"])


def model_comparison(frames: list[DataFrame]) -> DataFrame:
    """All metric rows, sorted by dataset, target, SMAPE."""
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return u.orderBy("dataset", "target", "SMAPE", "model")


def best_model(cmp: DataFrame) -> DataFrame:
    w = W.partitionBy("dataset", "target").orderBy("SMAPE", "model")
    return cmp.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


def relative_best(cmp: DataFrame, cols=("MAE", "RMSE", "SMAPE")) -> DataFrame:
    """Per metric ``min over target / value``, then the mean per model."""
    w = W.partitionBy("target")
    rel = cmp.select("model", *[(F.min(c).over(w) / F.nullif(F.col(c), F.lit(0.0))).alias(c) for c in cols])
    return rel.groupBy("model").agg(*[F.avg(c).alias(f"rel_{c}") for c in cols])


def minmax_norm(cmp: DataFrame, cols=("MAE", "RMSE", "SMAPE", "R2")) -> DataFrame:
    """(x − min)/(max − min + 1e-10) per (dataset, target); R² inverted so lower is better."""
    w = W.partitionBy("dataset", "target")
    out = []
    for c in cols:
        x = F.col(c)
        norm = (x - F.min(x).over(w)) / (F.max(x).over(w) - F.min(x).over(w) + F.lit(1e-10))
        out.append((F.lit(1.0) - norm if c == "R2" else norm).alias(f"norm_{c}"))
    return cmp.select("dataset", "target", "model", *out)


def union_forecasts(parts: list[DataFrame]) -> DataFrame:
    """Forecast rows of several datasets, targets or models, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def global_forecast(history: DataFrame, fc: DataFrame, by=()) -> DataFrame:
    """History and forecast summed over series per date (and ``by``), labelled by kind."""
    h = history.groupBy(*by, "ds").agg(F.sum("y").alias("value")).withColumn("kind", F.lit("history"))
    f = fc.groupBy(*by, "ds").agg(F.sum("y_hat").alias("value")).withColumn("kind", F.lit("forecast"))
    return h.unionByName(f)


# ── gradient-boosted trees ───────────────────────────────────────────────────

EXCLUDED_FEATURES = {"unique_id", "ds", "y", "split", "wow_ratio", "is_validation"}
# Fixed value: boosting rounds at most.
MAX_ROUNDS = 800


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric model inputs; ``wow_ratio`` divides the current target (leakage) and is excluded."""
    num = ("int", "bigint", "double", "float", "smallint", "tinyint")
    return [c for c, t in df.dtypes if t in num and c not in EXCLUDED_FEATURES]


def _assemble(df: DataFrame, feats: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep").transform(df)


def with_validation(df: DataFrame, val_days: int = 20) -> DataFrame:
    """Mark the rows of the last ``val_days`` distinct dates: the chronological validation part."""
    last = df.select("ds").distinct().orderBy(F.desc("ds")).limit(val_days).agg(F.min("ds").alias("c")).first()["c"]
    return df.withColumn("is_validation", F.col("ds") >= F.lit(last))


def gbt_fit(train: DataFrame, feats: list[str], max_depth: int = 6, step_size: float = 0.05,
            max_iter: int = MAX_ROUNDS, seed: int = 42, val_days: int = 20, tol: float = 0.01):
    """One boosted-tree model of up to ``max_iter`` rounds; boosting stops once the
    error on the last ``val_days`` dates no longer improves by ``tol``."""
    from pyspark.ml.regression import GBTRegressor
    gbt = GBTRegressor(featuresCol="features", labelCol="y", maxDepth=max_depth, stepSize=step_size,
                       maxIter=max_iter, seed=seed, validationIndicatorCol="is_validation", validationTol=tol)
    return gbt.fit(_assemble(with_validation(train, val_days), feats))


def gbt_forecast(train: DataFrame, test: DataFrame, max_depth: int = 6, step_size: float = 0.05,
                 max_iter: int = MAX_ROUNDS):
    """Fit one global model on the training rows; predictions on ``test`` clipped at 0."""
    feats = feature_columns(train)
    model = gbt_fit(train, feats, max_depth, step_size, max_iter)
    pred = model.transform(_assemble(test, feats))
    return pred.select("unique_id", "ds", "y", F.greatest(F.col("prediction"), F.lit(0.0)).alias("y_hat")), \
        model, feats


#: The settings tried by default.
GRID = [{"max_depth": d, "step_size": s} for d in (3, 4, 5, 6, 7) for s in (0.03, 0.05, 0.1)]


#: Boosting rounds of each rung of the search, and what share of the settings goes on to the next (one in two).
RUNGS, KEEP = (9, 18, 36, 72), 2


def survivors(scored: list[tuple[float, int]], last: bool, keep: int = KEEP) -> list[int]:
    """The settings that go on from a rung: one in ``keep`` (rounded up) by error, ties to the first; the best one of the last rung."""
    return [i for _, i in sorted(scored)][:1 if last else -(-len(scored) // keep)]


def tune_gbt(frames: dict[tuple[str, str], DataFrame], grid: list[dict] | None = None, rungs: tuple[int, ...] = RUNGS, val_days: int = 20,
             threads: int = 8) -> list[tuple]:
    """Successive halving over ``grid`` for each dataset and target of ``frames`` (feature rows of the training part).

    Every setting gets the first rung's rounds; one in ``KEEP`` goes on, with as many times the rounds. A
    setting's error is the least mean absolute error, over its rounds so far, on the last ``val_days``
    dates, which no fit reads. Fits of a rung run side by side as Spark jobs, ``threads`` at a time.
    Rows: (dataset, target, config, max_depth, step_size, rung, rounds, best_round, val_mae, kept).
    A pair without rows on both sides of the split has no row."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target
    from pyspark.ml.regression import GBTRegressor

    grid, parts, held = grid or GRID, {}, []
    for pair, train in frames.items():
        if train.isEmpty():
            continue
        marked = _assemble(with_validation(train, val_days), feature_columns(train)).select("features", "y", "is_validation").cache()
        held.append(marked)
        fit, val = marked.where("NOT is_validation"), marked.where("is_validation")
        if not fit.isEmpty() and not val.isEmpty():
            parts[pair] = fit, val

    def error(pair: tuple[str, str], i: int, rounds: int) -> tuple[float, int]:
        fit, val = parts[pair]
        model = GBTRegressor(featuresCol="features", labelCol="y", maxDepth=grid[i]["max_depth"], stepSize=grid[i]["step_size"],
                             maxIter=rounds, seed=42).fit(fit)
        return min((float(e), k + 1) for k, e in enumerate(model.evaluateEachIteration(val, "absolute")))

    rows, alive = [], {pair: list(range(len(grid))) for pair in parts}
    with ThreadPoolExecutor(threads) as pool:
        for rung, rounds in enumerate(rungs):
            todo = [(pair, i) for pair, open_ in alive.items() for i in open_]
            # the deepest trees take longest and go first
            todo.sort(key=lambda t: -grid[t[1]]["max_depth"])
            run = [pool.submit(inheritable_thread_target(error), pair, i, rounds) for pair, i in todo]
            found = {t: r.result() for t, r in zip(todo, run)}
            for pair, open_ in alive.items():
                alive[pair] = survivors([(found[pair, i][0], i) for i in open_], rung == len(rungs) - 1)
                rows += [(*pair, i, grid[i]["max_depth"], float(grid[i]["step_size"]), rung, rounds, found[pair, i][1], found[pair, i][0], i in alive[pair])
                         for i in open_]
    for marked in held:
        marked.unpersist()
    return rows


def feature_importance(model, feats: list[str], spark) -> DataFrame:
    """Model feature importances, largest first (a vector of #features values)."""
    imp = model.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(feats, [float(v) for v in imp])), "feature string, importance double") \
        .orderBy(F.desc("importance"), "feature")
