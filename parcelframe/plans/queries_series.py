"""Registered queries: daily panels, calendar, window features, splits,
baseline and Theta forecasts, metrics and model comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import eda, series, topk
from ..session import materialize
from ..sources.fixtures import national, shipments
from . import autotheta as at
from . import forecast as fc
from .queries_eda import r6

LAGS = (1, 2, 3, 5, 10, 22)
WINDOWS = (5, 10, 22)
H = 30


# ── Spark side helpers ───────────────────────────────────────────────────────

def panel(spark, sf) -> DataFrame:
    """Daily panel by depot region, checkpointed: it is small (days × regions)
    and feeds several branches of every series query."""
    return materialize(series.daily_panel(national(spark, sf), "depot_region"))


def long_series(spark, sf, target: str = "poids") -> DataFrame:
    return materialize(series.to_long_series(panel(spark, sf), target, 20))


def split(spark, sf, target: str = "poids"):
    s = series.train_test_cutoff(long_series(spark, sf, target), H)
    return s.filter(F.col("split") == "train").drop("split"), s.filter(F.col("split") == "test").drop("split")


def single_series(spark, sf) -> DataFrame:
    nat = national(spark, sf)
    return materialize(series.daily_series(nat, dedup_cols=nat.columns))


# ── SQL side helpers ─────────────────────────────────────────────────────────

PANEL = ("panel AS (SELECT deposit_date AS ds, coalesce(CAST(depot_region AS VARCHAR), 'INCONNU') AS unique_id, "
         "sum(greatest(coalesce(CAST(weight_kg AS DOUBLE), 0), 0)) AS poids, "
         "sum(greatest(coalesce(CAST(revenue_ca AS DOUBLE), 0), 0)) AS CA, CAST(count(mailitm_fid) AS BIGINT) "
         "AS nb_envois FROM national WHERE deposit_date IS NOT NULL AND isodow(deposit_date) <= 5 GROUP BY 1, 2)")


def LONG(t: str = "poids") -> str:  # noqa: N802
    return (f"long AS (SELECT unique_id, ds, greatest(CAST({t} AS DOUBLE), 0) AS y FROM panel WHERE {t} IS NOT NULL "
            f"AND unique_id IN (SELECT unique_id FROM panel WHERE {t} IS NOT NULL GROUP BY 1 HAVING count(*) >= 20))")


SPLIT = ("dd AS (SELECT DISTINCT ds FROM long), rk AS (SELECT ds, row_number() OVER (ORDER BY ds DESC) AS r, "
         f"count(*) OVER () AS n FROM dd), cut AS (SELECT ds AS cutoff FROM rk WHERE r = least({H}, greatest(5, n - 20))), "
         "train AS (SELECT long.* FROM long, cut WHERE ds < cutoff), test AS (SELECT long.* FROM long, cut WHERE ds >= cutoff)")


def FUTURE(src: str, h: int) -> str:  # noqa: N802
    span = h // 5 * 7 + 7
    return (f"lastd AS (SELECT unique_id, max(ds) AS last_ds, arg_max(y, ds) AS last_y FROM {src} GROUP BY 1), "
            f"fut AS (SELECT unique_id, ds, step FROM (SELECT unique_id, ds, row_number() OVER (PARTITION BY unique_id "
            f"ORDER BY ds) AS step FROM (SELECT unique_id, CAST(unnest(generate_series(last_ds + INTERVAL 1 DAY, "
            f"last_ds + INTERVAL {span} DAY, INTERVAL 1 DAY)) AS DATE) AS ds FROM lastd) WHERE isodow(ds) <= 5) "
            f"WHERE step <= {h})")


NAIVE = "naive AS (SELECT f.unique_id, f.ds, l.last_y AS y_hat FROM fut f JOIN lastd l USING (unique_id))"
SNAIVE = ("tail5 AS (SELECT unique_id, y, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS back "
          "FROM train), snaive AS (SELECT f.unique_id, f.ds, t.y AS y_hat FROM fut f JOIN tail5 t ON "
          "t.unique_id = f.unique_id AND t.back = 5 - ((f.step - 1) % 5))")


def METRICS(src: str, by: str = "") -> str:  # noqa: N802
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return (f"SELECT {keys}round(avg(abs(y - y_hat)), 6) AS MAE, round(sqrt(avg((y - y_hat) * (y - y_hat))), 6) AS RMSE, "
            "round(avg(CASE WHEN (abs(y) + abs(y_hat)) / 2 = 0 THEN 0.0 ELSE abs(y - y_hat) / ((abs(y) + abs(y_hat)) / 2) "
            "END) * 100, 6) AS SMAPE, round(1.0 - sum((y - y_hat) * (y - y_hat)) / nullif(var_pop(y) * count(y), 0), 6) "
            f"AS R2 FROM {src}{group}")


def _r6_sql(cols) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


# ── panels and calendar ──────────────────────────────────────────────────────

@register("daily_panel", f"WITH {PANEL} SELECT ds, unique_id, round(poids, 6) AS poids, round(CA, 6) AS CA, "
          "nb_envois FROM panel")
def q_daily_panel(spark, sf):
    return r6(panel(spark, sf))


@register("daily_total", f"WITH {PANEL} SELECT ds, round(sum(poids), 6) AS poids, round(sum(CA), 6) AS CA, "
          "CAST(sum(nb_envois) AS BIGINT) AS nb_envois FROM panel GROUP BY ds")
def q_daily_total(spark, sf):
    return r6(series.daily_total(panel(spark, sf)))


_SINGLE = ("dedup AS (SELECT DISTINCT * FROM national), "
           "daily AS (SELECT deposit_date AS ds, sum(CAST(weight_kg AS DOUBLE)) AS poids, "
           "sum(CAST(revenue_ca AS DOUBLE)) AS CA FROM dedup WHERE deposit_date IS NOT NULL AND weight_kg IS NOT NULL "
           "GROUP BY 1), cal AS (SELECT CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds "
           "FROM daily), single AS (SELECT c.ds, coalesce(d.poids, 0) AS poids, coalesce(d.CA, 0) AS CA FROM cal c "
           "LEFT JOIN daily d USING (ds) WHERE isodow(c.ds) <= 5)")


@register("daily_series", f"WITH {_SINGLE} SELECT ds, round(poids, 6) AS poids, round(CA, 6) AS CA FROM single")
def q_daily_series(spark, sf):
    """National daily series: dedup, sum per day, business-day calendar with zero fill."""
    return r6(single_series(spark, sf))


@register("calendar_fill",
          f"WITH {PANEL}, cal AS (SELECT unique_id, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds "
          "FROM panel GROUP BY unique_id) SELECT c.unique_id, c.ds, CAST(coalesce(t.nb_envois, 0) AS BIGINT) AS n FROM cal c "
          "LEFT JOIN panel t USING (unique_id, ds) WHERE isodow(c.ds) <= 5")
def q_calendar_fill(spark, sf):
    """Every series on all business days of its span."""
    p = panel(spark, sf).select("unique_id", "ds", F.col("nb_envois").alias("n"))
    return series.calendar_fill(p, ["n"], key="unique_id").withColumn("n", F.col("n").cast("bigint"))


@register("filter_business_days",
          "SELECT DISTINCT deposit_date AS ds FROM national WHERE deposit_date IS NOT NULL AND isodow(deposit_date) <= 5")
def q_filter_business_days(spark, sf):
    from ..operators.filters import filter_business_days
    d = national(spark, sf).select(F.col("deposit_date").alias("ds")).filter(F.col("ds").isNotNull()).distinct()
    return filter_business_days(d, "ds")


@register("to_long_series", f"WITH {PANEL}, {LONG()} SELECT unique_id, ds, round(y, 6) AS y FROM long")
def q_to_long_series(spark, sf):
    return r6(long_series(spark, sf))


# ── window features ──────────────────────────────────────────────────────────

def _lag_sql(key: str = "PARTITION BY unique_id ") -> str:
    return ", ".join(f"round(lag(y, {k}) OVER (PARTITION BY unique_id ORDER BY ds), 6) AS lag_{k}" for k in LAGS)


@register("lag_features", f"WITH {PANEL}, {LONG()} SELECT unique_id, ds, round(y, 6) AS y, {_lag_sql()} FROM long")
def q_lag_features(spark, sf):
    return r6(series.lag_features(long_series(spark, sf), LAGS))


def _roll_sql(windows, full: bool, with_max: bool, part: str = "PARTITION BY unique_id") -> str:
    cols = []
    for w in windows:
        fr = f"OVER ({part} ORDER BY ds ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
        if full:
            cols.append(f"round(CASE WHEN count(y) {fr} = {w} THEN avg(y) {fr} END, 6) AS roll_mean_{w}")
            cols.append(f"round(CASE WHEN count(y) {fr} = {w} THEN stddev_samp(y) {fr} END, 6) AS roll_std_{w}")
        else:
            cols.append(f"round(avg(y) {fr}, 6) AS roll_mean_{w}")
            cols.append(f"round(coalesce(stddev_samp(y) {fr}, 0), 6) AS roll_std_{w}")
            if with_max:
                cols.append(f"round(max(y) {fr}, 6) AS roll_max_{w}")
    return ", ".join(cols)


@register("rolling_features",
          f"WITH {PANEL}, {LONG()} SELECT unique_id, ds, round(y, 6) AS y, {_roll_sql(WINDOWS, False, True)} FROM long")
def q_rolling_features(spark, sf):
    return r6(series.rolling_features(long_series(spark, sf), WINDOWS))


@register("rolling_features_full",
          f"WITH {_SINGLE} SELECT ds, round(poids, 6) AS y, "
          + _roll_sql((5, 10, 20), True, False, part="").replace("( ORDER", "(ORDER") + " FROM single")
def q_rolling_features_full(spark, sf):
    s = single_series(spark, sf).select("ds", F.col("poids").alias("y"))
    return r6(series.rolling_features(s, (5, 10, 20), key=None, full=True, with_max=False))


@register("moving_average",
          f"WITH {_SINGLE} SELECT ds, round(poids, 6) AS y, round(CASE WHEN count(poids) OVER w = 7 THEN avg(poids) OVER w "
          "END, 6) AS ma_7, round(CASE WHEN count(poids) OVER w20 = 20 THEN avg(poids) OVER w20 END, 6) AS ma_20 "
          "FROM single WINDOW w AS (ORDER BY ds ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), "
          "w20 AS (ORDER BY ds ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def q_moving_average(spark, sf):
    s = single_series(spark, sf).select("ds", F.col("poids").alias("y"))
    return r6(series.moving_average(series.moving_average(s, 7), 20))


@register("week_over_week",
          f"WITH {PANEL}, {LONG('nb_envois')} SELECT unique_id, ds, round(y, 6) AS y, "
          "round(lag(y, 5) OVER (PARTITION BY unique_id ORDER BY ds), 6) AS wow_lag, "
          "round(y / nullif(lag(y, 5) OVER (PARTITION BY unique_id ORDER BY ds), 0), 6) AS wow_ratio FROM long")
def q_week_over_week(spark, sf):
    return r6(series.week_over_week(long_series(spark, sf, "nb_envois")))


_FEAT_SQL = (
    f"WITH {PANEL}, {LONG()}, mind AS (SELECT min(ds) AS m FROM long), "
    "codes AS (SELECT unique_id, CAST(dense_rank() OVER (ORDER BY unique_id) - 1 AS INTEGER) AS uid_enc FROM (SELECT DISTINCT unique_id "
    "FROM long)), f AS (SELECT long.unique_id, ds, y, CAST(isodow(ds) - 1 AS INTEGER) AS dayofweek, "
    "CAST(day(ds) AS INTEGER) AS dayofmonth, CAST(month(ds) AS INTEGER) AS month, CAST(quarter(ds) AS INTEGER) AS quarter, "
    "CAST(year(ds) AS INTEGER) AS year, "
    "(round(sin(2 * pi() * (isodow(ds) - 1) / 5), 6) + 0.0) AS dow_sin, (round(cos(2 * pi() * (isodow(ds) - 1) / 5), 6) + 0.0) AS dow_cos, "
    "(round(sin(2 * pi() * month(ds) / 12), 6) + 0.0) AS month_sin, (round(cos(2 * pi() * month(ds) / 12), 6) + 0.0) AS month_cos, "
    "CAST(datediff('day', (SELECT m FROM mind), ds) AS INTEGER) AS trend, "
    + ", ".join(f"lag(y, {k}) OVER (PARTITION BY long.unique_id ORDER BY ds) AS lag_{k}" for k in LAGS) + ", "
    + _roll_sql(WINDOWS, False, True, part="PARTITION BY long.unique_id").replace("round(", "(").replace(", 6)", ")")
    + ", lag(y, 5) OVER (PARTITION BY long.unique_id ORDER BY ds) AS wow_lag, "
    "y / nullif(lag(y, 5) OVER (PARTITION BY long.unique_id ORDER BY ds), 0) AS wow_ratio, codes.uid_enc "
    "FROM long JOIN codes USING (unique_id)) SELECT * FROM f WHERE lag_22 IS NOT NULL")


def _r6_all_sql(sql: str, cols) -> str:
    return f"SELECT {', '.join(f'round({c}, 6) AS {c}' if c.startswith(('lag', 'roll', 'wow', 'y')) else c for c in cols)} FROM ({sql})"


_FEAT_COLS = (["unique_id", "ds", "y", "dayofweek", "dayofmonth", "month", "quarter", "year", "dow_sin", "dow_cos",
               "month_sin", "month_cos", "trend"] + [f"lag_{k}" for k in LAGS]
              + [f"roll_{s}_{w}" for w in WINDOWS for s in ("mean", "std", "max")] + ["wow_lag", "wow_ratio", "uid_enc"])


@register("add_features", _FEAT_SQL)
def q_add_features(spark, sf):
    """Panel feature table; rows without the 22-day lag are cut (feature_cutoff)."""
    return r6(series.add_features(long_series(spark, sf), LAGS, WINDOWS))


@register("add_features_single",
          f"WITH {_SINGLE}, f AS (SELECT ds, poids AS y, CAST(isodow(ds) - 1 AS INTEGER) AS dayofweek, CAST(day(ds) AS INTEGER) AS day, "
          "CAST(month(ds) AS INTEGER) AS month, CAST(quarter(ds) AS INTEGER) AS quarter, CAST(weekofyear(ds) AS INTEGER) AS weekofyear, "
          "CAST(day(ds) = 1 AS INTEGER) AS is_month_start, CAST(last_day(ds) = ds AS INTEGER) AS is_month_end, "
          "lag(poids, 1) OVER (ORDER BY ds) AS lag_1, lag(poids, 2) OVER (ORDER BY ds) AS lag_2, lag(poids, 3) OVER (ORDER BY ds) AS lag_3, lag(poids, 5) OVER (ORDER BY ds) AS lag_5, lag(poids, 10) OVER (ORDER BY ds) AS lag_10, lag(poids, 20) OVER (ORDER BY ds) AS lag_20, "
          "CASE WHEN count(poids) OVER w5 = 5 THEN avg(poids) OVER w5 END AS roll_mean_5, CASE WHEN count(poids) OVER w5 = 5 THEN stddev_samp(poids) OVER w5 END AS roll_std_5, CASE WHEN count(poids) OVER w10 = 10 THEN avg(poids) OVER w10 END AS roll_mean_10, CASE WHEN count(poids) OVER w10 = 10 THEN stddev_samp(poids) OVER w10 END AS roll_std_10, CASE WHEN count(poids) OVER w20 = 20 THEN avg(poids) OVER w20 END AS roll_mean_20, CASE WHEN count(poids) OVER w20 = 20 THEN stddev_samp(poids) OVER w20 END AS roll_std_20 "
          "FROM single WINDOW w5 AS (ORDER BY ds ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), w10 AS (ORDER BY ds ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), w20 AS (ORDER BY ds ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) "
          "SELECT ds, round(y, 6) AS y, dayofweek, day, month, quarter, weekofyear, is_month_start, is_month_end, "
          "round(lag_1, 6) AS lag_1, round(lag_2, 6) AS lag_2, round(lag_3, 6) AS lag_3, round(lag_5, 6) AS lag_5, round(lag_10, 6) AS lag_10, round(lag_20, 6) AS lag_20, round(roll_mean_5, 6) AS roll_mean_5, round(roll_std_5, 6) AS roll_std_5, round(roll_mean_10, 6) AS roll_mean_10, round(roll_std_10, 6) AS roll_std_10, round(roll_mean_20, 6) AS roll_mean_20, round(roll_std_20, 6) AS roll_std_20 FROM f WHERE "
          "lag_1 IS NOT NULL AND lag_2 IS NOT NULL AND lag_3 IS NOT NULL AND lag_5 IS NOT NULL AND lag_10 IS NOT NULL AND lag_20 IS NOT NULL AND roll_mean_5 IS NOT NULL AND roll_std_5 IS NOT NULL AND roll_mean_10 IS NOT NULL AND roll_std_10 IS NOT NULL AND roll_mean_20 IS NOT NULL AND roll_std_20 IS NOT NULL")
def q_add_features_single(spark, sf):
    """Single-series features (full windows, rows with a missing feature dropped)."""
    return r6(series.add_features_single(single_series(spark, sf), "poids"))


@register("label_encode",
          "SELECT depot_office, CAST(dense_rank() OVER (ORDER BY depot_office) - 1 AS INTEGER) AS uid_enc "
          "FROM (SELECT DISTINCT depot_office FROM national)")
def q_label_encode(spark, sf):
    d = national(spark, sf).select("depot_office").distinct()
    return series.label_encode(d, "depot_office")


@register("trend_days",
          f"WITH {PANEL}, t AS (SELECT ds, sum(nb_envois) AS n FROM panel GROUP BY ds) "
          "SELECT ds, CAST(datediff('day', (SELECT min(ds) FROM t), ds) AS INTEGER) AS trend FROM t")
def q_trend_days(spark, sf):
    t = series.daily_total(panel(spark, sf)).select("ds")
    return series.trend_days(t)


@register("calendar_parts",
          "SELECT ds, CAST(isodow(ds) - 1 AS INTEGER) AS dayofweek, CAST(day(ds) AS INTEGER) AS day, "
          "CAST(month(ds) AS INTEGER) AS month, CAST(quarter(ds) AS INTEGER) AS quarter, "
          "CAST(year(ds) AS INTEGER) AS year, CAST(weekofyear(ds) AS INTEGER) AS weekofyear, CAST(day(ds) = 1 AS INTEGER) AS is_month_start, "
          "CAST(last_day(ds) = ds AS INTEGER) AS is_month_end, "
          "(round(sin(2 * pi() * (isodow(ds) - 1) / 5), 6) + 0.0) AS dow_sin, (round(cos(2 * pi() * month(ds) / 12), 6) + 0.0) "
          "AS month_cos, ['Lundi', 'Mardi', 'Mercredi', 'Jeudi', 'Vendredi', 'Samedi', 'Dimanche'][isodow(ds)] "
          "AS weekday_name FROM (SELECT DISTINCT deposit_date AS ds FROM national WHERE deposit_date IS NOT NULL)")
def q_calendar_parts(spark, sf):
    from ..functions.temporal import calendar_parts, cyclic_parts, weekday_name_fr
    d = national(spark, sf).select(F.col("deposit_date").alias("ds")).filter(F.col("ds").isNotNull()).distinct()
    cal, cyc = calendar_parts("ds"), cyclic_parts("ds")
    return r6(d.select("ds", *[c.alias(n) for n, c in cal.items()], cyc["dow_sin"].alias("dow_sin"),
                       cyc["month_cos"].alias("month_cos"), weekday_name_fr("ds").alias("weekday_name")))


# ── splits ───────────────────────────────────────────────────────────────────

@register("train_test_cutoff",
          f"WITH {PANEL}, {LONG()}, {SPLIT} SELECT unique_id, ds, round(y, 6) AS y, "
          "CASE WHEN ds < cutoff THEN 'train' ELSE 'test' END AS split FROM long, cut")
def q_train_test_cutoff(spark, sf):
    return r6(series.train_test_cutoff(long_series(spark, sf), H))


@register("tail_split",
          f"WITH {PANEL}, {LONG()} SELECT unique_id, ds, round(y, 6) AS y, CASE WHEN row_number() OVER "
          f"(PARTITION BY unique_id ORDER BY ds DESC) <= {H} THEN 'test' ELSE 'train' END AS split FROM long")
def q_tail_split(spark, sf):
    return r6(series.tail_split(long_series(spark, sf), H))


@register("chrono_split",
          f"WITH {_SINGLE}, p AS (SELECT ds, poids, row_number() OVER (ORDER BY ds) - 1 AS pos, count(*) OVER () AS n "
          "FROM single), b AS (SELECT *, greatest(20, floor(n * 0.75)) AS te FROM p), "
          "c AS (SELECT *, least(n - 1, greatest(te + 1, floor(n * 0.9))) AS ve FROM b) "
          "SELECT ds, round(poids, 6) AS poids, CASE WHEN pos < te THEN 'train' WHEN pos < ve THEN 'validation' "
          "ELSE 'test' END AS split FROM c")
def q_chrono_split(spark, sf):
    return r6(series.chrono_split(single_series(spark, sf).select("ds", "poids"), 0.75, 0.15, 20))


@register("future_business_days", f"WITH {PANEL}, {LONG()}, {FUTURE('long', 60)} SELECT unique_id, ds, step FROM fut")
def q_future_business_days(spark, sf):
    return series.future_business_days(long_series(spark, sf), 60).select(
        "unique_id", "ds", F.col("step").cast("bigint").alias("step"))


@register("history_tail",
          f"WITH {PANEL}, {LONG()} SELECT unique_id, ds, round(y, 6) AS y FROM (SELECT *, row_number() OVER "
          "(PARTITION BY unique_id ORDER BY ds DESC) AS r FROM long) WHERE r <= 90")
def q_history_tail(spark, sf):
    return r6(series.history_tail(long_series(spark, sf), 90))


# ── forecasts and evaluation ─────────────────────────────────────────────────

_BASE = f"WITH {PANEL}, {LONG()}, {SPLIT}, {FUTURE('train', H)}, {NAIVE}, {SNAIVE}"


@register("naive_forecast", f"{_BASE} SELECT unique_id, ds, round(y_hat, 6) AS y_hat FROM naive")
def q_naive_forecast(spark, sf):
    train, _ = split(spark, sf)
    return r6(fc.naive_forecast(train, H))


@register("seasonal_naive_forecast", f"{_BASE} SELECT unique_id, ds, round(y_hat, 6) AS y_hat FROM snaive")
def q_seasonal_naive_forecast(spark, sf):
    train, _ = split(spark, sf)
    return r6(fc.seasonal_naive_forecast(train, H))


@register("join_forecast_actual",
          f"{_BASE} SELECT t.unique_id, t.ds, round(t.y, 6) AS y, round(n.y_hat, 6) AS y_hat FROM test t "
          "JOIN naive n ON t.unique_id = n.unique_id AND t.ds = n.ds")
def q_join_forecast_actual(spark, sf):
    train, test = split(spark, sf)
    return r6(fc.join_forecast_actual(test, fc.naive_forecast(train, H)))


@register("metrics_by_series",
          f"{_BASE}, j AS (SELECT unique_id, t.y, n.y_hat FROM test t JOIN naive n USING (unique_id, ds)) "
          + METRICS("j", "unique_id"))
def q_metrics_by_series(spark, sf):
    """MAE / RMSE / SMAPE / R² of the naive model per series."""
    train, test = split(spark, sf)
    return r6(fc.metrics(fc.join_forecast_actual(test, fc.naive_forecast(train, H)), by=["unique_id"]))


# ── all datasets and targets ────────────────────────────────────────────────

# The series of a dataset and target are named dataset|target|region, so one
# pass fits them all. Imports carry no revenue.
COMBOS = [("national", "poids"), ("national", "CA"), ("export", "poids"), ("export", "CA"), ("import", "poids")]
FUTURE_DAYS = 60


def all_long(spark, sf) -> DataFrame:
    """Long series of every dataset and target: dataset, target, unique_id, ds, y."""
    s = shipments(spark, sf).withColumn("_g", F.concat_ws("|", "source", F.coalesce("depot_region", F.lit("INCONNU"))))
    p = materialize(series.daily_panel(s, "_g"))
    parts = []
    for target in ("poids", "CA"):
        part = series.to_long_series(p, target, 20)
        dataset = F.split_part(F.col("unique_id"), F.lit("|"), F.lit(1))
        region = F.split_part(F.col("unique_id"), F.lit("|"), F.lit(2))
        part = part.where(dataset.isin(*[d for d, t in COMBOS if t == target]))
        parts.append(part.select(dataset.alias("dataset"), F.lit(target).alias("target"),
                                 F.concat_ws("|", dataset, F.lit(target), region).alias("unique_id"), "ds", "y"))
    return materialize(fc.union_forecasts(parts))


def named(df: DataFrame) -> DataFrame:
    """dataset, target and region of the series' name in front of its other columns."""
    part = lambda k: F.split_part(F.col("unique_id"), F.lit("|"), F.lit(k))
    return df.select(part(1).alias("dataset"), part(2).alias("target"), part(3).alias("region"), *[c for c in df.columns if c != "unique_id"])


def all_split(spark, sf):
    s = materialize(series.train_test_cutoff(all_long(spark, sf), H, by=("dataset", "target")))
    return s.filter("split = 'train'").drop("split"), s.filter("split = 'test'").drop("split")


def r3(df: DataFrame) -> DataFrame:
    """Doubles at 3 decimals, half-even (long recursions differ in the last digits between engines)."""
    return df.select(*[F.bround(F.col(c), 3).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


ALL = ("apanel AS (SELECT source AS dataset, deposit_date AS ds, coalesce(CAST(depot_region AS VARCHAR), 'INCONNU') AS region, "
       "sum(greatest(coalesce(CAST(weight_kg AS DOUBLE), 0), 0)) AS poids, sum(greatest(coalesce(CAST(revenue_ca AS DOUBLE), 0), 0)) AS CA "
       "FROM shipments WHERE deposit_date IS NOT NULL AND isodow(deposit_date) <= 5 GROUP BY 1, 2, 3), "
       "aall AS (SELECT dataset, 'poids' AS target, region, ds, poids AS y FROM apanel UNION ALL "
       "SELECT dataset, 'CA', region, ds, CA FROM apanel WHERE dataset <> 'import'), "
       "along AS (SELECT dataset, target, dataset || '|' || target || '|' || region AS unique_id, ds, y FROM aall "
       "QUALIFY count(*) OVER (PARTITION BY dataset, target, region) >= 20)")

ASPLIT = ("adays AS (SELECT DISTINCT dataset, target, ds FROM along), arank AS (SELECT *, row_number() OVER (PARTITION BY dataset, target "
          "ORDER BY ds DESC) AS r, count(*) OVER (PARTITION BY dataset, target) AS n FROM adays), "
          f"acut AS (SELECT dataset, target, ds AS cutoff FROM arank WHERE r = least({H}, greatest(5, n - 20))), "
          "train AS (SELECT unique_id, ds, y FROM along JOIN acut USING (dataset, target) WHERE ds < cutoff), "
          "test AS (SELECT unique_id, ds, y FROM along JOIN acut USING (dataset, target) WHERE ds >= cutoff)")


def THETA(src: str, h: int) -> str:  # noqa: N802
    """The Theta forecast of every series of ``src`` over the dates in ``fut``: table theta."""
    alphas = ", ".join(str(a) for a in fc.SES_ALPHAS)
    return (
        f"th_base AS (SELECT unique_id, ds, y, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS t, isodow(ds) AS dow FROM {src}), "
        "th_mean AS (SELECT *, avg(y) OVER (PARTITION BY unique_id) AS m, avg(y) OVER (PARTITION BY unique_id, dow) AS md FROM th_base), "
        "th_flat AS (SELECT unique_id, t, dow, CASE WHEN m > 0 AND md > 0 THEN md / m ELSE 1.0 END AS factor, "
        "y / CASE WHEN m > 0 AND md > 0 THEN md / m ELSE 1.0 END AS ya FROM th_mean), "
        "th_line AS (SELECT unique_id, count(*) AS n, regr_intercept(ya, t) AS a, regr_slope(ya, t) AS b FROM th_flat GROUP BY 1), "
        "th_z AS (SELECT unique_id, n, a, b, list(2.0 * ya - (a + b * t) ORDER BY t) AS z FROM th_flat JOIN th_line USING (unique_id) GROUP BY ALL), "
        f"th_ses AS (SELECT unique_id, n, a, b, alpha, list_reduce(list_transform(z, lambda v: {{'sse': 0.0::DOUBLE, 'level': v, 'z': v}}), "
        "lambda s, x: {'sse': s.sse + (x.z - s.level) * (x.z - s.level), 'level': alpha * x.z + (1.0 - alpha) * s.level, 'z': x.z}) AS f "
        f"FROM th_z, (SELECT CAST(unnest([{alphas}]) AS DOUBLE) AS alpha)), "
        "th_best AS (SELECT unique_id, n, a, b, alpha, f.level AS level, sqrt(f.sse / greatest(n - 1, 1)) AS sigma_z FROM th_ses "
        "QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY f.sse, alpha) = 1), "
        "th_factor AS (SELECT DISTINCT unique_id, dow, factor FROM th_flat), "
        "theta AS (SELECT u.unique_id, u.ds, u.step, greatest((0.5 * (a + b * (n + step)) + 0.5 * level) * coalesce(factor, 1.0), 0) AS y_hat, "
        "0.5 * sigma_z * sqrt(1.0 + (step - 1) * alpha * alpha) * coalesce(factor, 1.0) AS sigma FROM fut u JOIN th_best USING (unique_id) "
        "LEFT JOIN th_factor c ON c.unique_id = u.unique_id AND c.dow = isodow(u.ds))")


def AUTO_THETA(src: str) -> str:  # noqa: N802
    """The chosen theta model's forecast of every series of ``src`` over the dates in ``fut``: table auto_theta."""
    alphas, lags = ", ".join(str(a) for a in fc.SES_ALPHAS), range(1, at.SEASON + 1)
    shares = list(enumerate(at.SHARES))
    r2 = " + ".join(f"r{k} * r{k}" for k in lags if k < at.SEASON)
    drift = "x.b * (1.0 + (1.0 - alpha) / alpha * (1.0 - s.q))"
    return (
        "au_base AS (SELECT unique_id, ds, y, isodow(ds) AS dow, row_number() OVER w AS t, count(*) OVER a AS n, avg(y) OVER a AS m, "
        f"avg(y) OVER (PARTITION BY unique_id, isodow(ds)) AS md FROM {src} WINDOW w AS (PARTITION BY unique_id ORDER BY ds), a AS (PARTITION BY unique_id)), "
        "au_lag AS (SELECT *, " + ", ".join(f"(y - m) * lag(y - m, {k}) OVER (PARTITION BY unique_id ORDER BY t) AS p{k}" for k in lags) + " FROM au_base), "
        "au_acf AS (SELECT unique_id, count(*) AS n, " + ", ".join(f"coalesce(sum(p{k}) / nullif(sum((y - m) * (y - m)), 0), 0) AS r{k}" for k in lags)
        + " FROM au_lag GROUP BY unique_id), "
        f"au_test AS (SELECT unique_id, n >= {at.LEAST_DAYS} AND abs(r{at.SEASON}) > {at.Z} * sqrt((1.0 + 2.0 * ({r2})) / n) AS seasonal FROM au_acf), "
        "au_f AS (SELECT unique_id, t, dow, y, seasonal, CASE WHEN seasonal AND m > 0 AND md > 0 THEN md / m ELSE 1.0 END AS factor FROM au_base JOIN au_test USING (unique_id)), "
        "au_flat AS (SELECT unique_id, t, y / factor AS ya, CASE WHEN t > 2 THEN regr_slope(y / factor, t) OVER (PARTITION BY unique_id ORDER BY t "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS b FROM au_f), "
        "au_pts AS (SELECT unique_id, count(*) AS n, coalesce(regr_slope(ya, t), 0) AS slope, list({'ya': ya, 'b': b} ORDER BY t) AS pts FROM au_flat GROUP BY 1), "
        "au_fold AS (SELECT unique_id, n, slope, alpha, list_reduce(list_transform(pts, lambda p: {'level': p.ya, 'q': 1.0::DOUBLE, 'b': p.b, 'ya': p.ya, "
        + ", ".join(f"'e{k}': 0.0::DOUBLE" for k, _ in shares) + "}), lambda s, x: {'level': alpha * x.ya + (1.0 - alpha) * s.level, 'q': s.q * (1.0 - alpha), 'b': x.b, 'ya': x.ya, "
        + ", ".join(f"'e{k}': s.e{k} + coalesce(power(x.ya - s.level - {w} * {drift}, 2), 0.0)" for k, w in shares)
        + f"}}) AS f FROM au_pts, (SELECT CAST(unnest([{alphas}]) AS DOUBLE) AS alpha)), "
        "au_each AS (" + " UNION ALL ".join(f"SELECT unique_id, n, slope, alpha, CAST({w} AS DOUBLE) AS share, f.level AS level, f.q AS q, f.e{k} AS sse FROM au_fold" for k, w in shares) + "), "
        "au_best AS (SELECT *, sqrt(sse / greatest(n - 2, 1)) AS error FROM au_each QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY sse, alpha, share) = 1), "
        "au_factor AS (SELECT DISTINCT unique_id, dow, factor FROM au_f), "
        "auto_theta AS (SELECT u.unique_id, u.ds, u.step, greatest((level + share * slope * (step + (1.0 - alpha) / alpha * (1.0 - q))) * coalesce(factor, 1.0), 0) AS y_hat, "
        "error * sqrt(1.0 + (step - 1) * alpha * alpha) * coalesce(factor, 1.0) AS sigma, 1.0 / (1.0 - share) AS theta, alpha, seasonal "
        "FROM fut u JOIN au_best USING (unique_id) JOIN au_test USING (unique_id) LEFT JOIN au_factor c ON c.unique_id = u.unique_id AND c.dow = isodow(u.ds))")


BANDS = ", ".join(f"round(greatest(y_hat {s} {z} * sigma, 0), 3) AS {n}_{lv}" for lv, z in fc.Z_SCORES.items() for n, s in (("lo", "-"), ("hi", "+")))
_NAME = "split_part(unique_id, '|', 1) AS dataset, split_part(unique_id, '|', 2) AS target, split_part(unique_id, '|', 3) AS region"


@register("theta_forecast", f"WITH {PANEL}, {LONG()}, {SPLIT}, {FUTURE('train', H)}, {THETA('train', H)} SELECT unique_id, ds, "
          f"CAST(step AS INTEGER) AS step, round(y_hat, 3) AS y_hat, round(sigma, 3) AS sigma, {BANDS} FROM theta")
def q_theta_forecast(spark, sf):
    """Theta forecasts (30 business days) per region series with 80/95 % bands."""
    train, _ = split(spark, sf)
    return r3(fc.forecast_intervals(fc.theta_forecast(train, H)))


@register("auto_theta_forecast", f"WITH {PANEL}, {LONG()}, {SPLIT}, {FUTURE('train', H)}, {AUTO_THETA('train')} SELECT unique_id, ds, "
          f"CAST(step AS INTEGER) AS step, round(y_hat, 3) AS y_hat, round(sigma, 3) AS sigma, round(theta, 3) AS theta, round(alpha, 3) AS alpha, seasonal, {BANDS} FROM auto_theta")
def q_auto_theta_forecast(spark, sf):
    """Each region's theta model, chosen by its one-step errors at rolling origins, with 80/95 % bands."""
    train, _ = split(spark, sf)
    return r3(fc.forecast_intervals(at.auto_theta_forecast(train, H)))


@register("forecast_metrics_by_model",
          f"{_BASE}, {THETA('train', H)}, {AUTO_THETA('train')}, j AS (SELECT 'naive' AS model, t.y, n.y_hat FROM test t JOIN naive n USING (unique_id, ds) "
          "UNION ALL SELECT 'seasonal_naive' AS model, t.y, s.y_hat FROM test t JOIN snaive s USING (unique_id, ds) "
          "UNION ALL SELECT 'theta' AS model, t.y, f.y_hat FROM test t JOIN theta f USING (unique_id, ds) "
          "UNION ALL SELECT 'auto_theta' AS model, t.y, f.y_hat FROM test t JOIN auto_theta f USING (unique_id, ds)) "
          + METRICS("j", "model").replace(", 6)", ", 3)"))
def q_forecast_metrics_by_model(spark, sf):
    """Errors of Theta, the chosen theta models and both naive models over all regions' test windows."""
    train, test = split(spark, sf)
    return r3(fc.forecast_metrics_by_model(test, model_forecasts(train)))


_ABASE = f"WITH {ALL}, {ASPLIT}, {FUTURE('train', H)}, {NAIVE}, {SNAIVE}, {THETA('train', H)}, {AUTO_THETA('train')}"
_SCORED = ", j AS (" + " UNION ALL ".join(
    f"SELECT split_part(unique_id, '|', 1) AS dataset, split_part(unique_id, '|', 2) AS target, '{m}' AS model, t.y, f.y_hat "
    f"FROM test t JOIN {src} f USING (unique_id, ds)" for m, src in (("theta", "theta"), ("auto_theta", "auto_theta"), ("naive", "naive"), ("seasonal_naive", "snaive"))) + ")"
_CMP = _ABASE + _SCORED + ", cmp AS (" + METRICS("j", "dataset, target, model").replace(", 6)", ", 3)") + ") "


def model_forecasts(train: DataFrame) -> dict[str, DataFrame]:
    """The statistical models' forecasts of the test window."""
    return {"theta": fc.theta_forecast(train, H), "auto_theta": at.auto_theta_forecast(train, H), "naive": fc.naive_forecast(train, H), "seasonal_naive": fc.seasonal_naive_forecast(train, H)}


def _scored(test: DataFrame, forecasts: dict[str, DataFrame]) -> DataFrame:
    parts = [fc.join_forecast_actual(test.select("unique_id", "ds", "y"), f.select("unique_id", "ds", "y_hat")).withColumn("model", F.lit(m))
             for m, f in forecasts.items()]
    return fc.metrics(named(fc.union_forecasts(parts)), by=["dataset", "target", "model"])


def _cmp_spark(spark, sf) -> DataFrame:
    train, test = all_split(spark, sf)
    return materialize(r3(fc.model_comparison([_scored(test, model_forecasts(train))])))


@register("theta_metrics", _CMP + "SELECT * FROM cmp WHERE model = 'theta'")
def q_theta_metrics(spark, sf):
    """Theta's errors on the test window, per dataset and target."""
    train, test = all_split(spark, sf)
    return r3(_scored(test, {"theta": fc.theta_forecast(train, H)}))


@register("model_comparison", _CMP + "SELECT * FROM cmp")
def q_model_comparison(spark, sf):
    """Metric rows of every (dataset, target, model), sorted by dataset, target, SMAPE."""
    return _cmp_spark(spark, sf)


@register("union_metrics", _CMP + "SELECT dataset, target, model, MAE, RMSE, SMAPE, R2 FROM cmp")
def q_union_metrics(spark, sf):
    """One table of metric rows out of one per model."""
    train, test = all_split(spark, sf)
    return r3(fc.union_forecasts([_scored(test, {m: f}) for m, f in model_forecasts(train).items()]))


@register("best_model",
          _CMP + "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY dataset, target "
          "ORDER BY SMAPE, model) AS r FROM cmp) WHERE r = 1")
def q_best_model(spark, sf):
    return fc.best_model(_cmp_spark(spark, sf))


@register("relative_best",
          _CMP + "SELECT model, " + ", ".join(
              f"round(avg(r_{c}), 6) AS rel_{c}" for c in ("MAE", "RMSE", "SMAPE"))
          + " FROM (SELECT model, " + ", ".join(
              f"min({c}) OVER (PARTITION BY target) / nullif({c}, 0) AS r_{c}" for c in ("MAE", "RMSE", "SMAPE"))
          + " FROM cmp) GROUP BY model")
def q_relative_best(spark, sf):
    return r6(fc.relative_best(_cmp_spark(spark, sf)))


@register("minmax_norm",
          _CMP + "SELECT dataset, target, model, " + ", ".join(
              (f"round(1.0 - ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w + 1e-10), 6) AS norm_{c}"
               if c == "R2" else
               f"round(({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w + 1e-10), 6) AS norm_{c}")
              for c in ("MAE", "RMSE", "SMAPE", "R2"))
          + " FROM cmp WINDOW w AS (PARTITION BY dataset, target)")
def q_minmax_norm(spark, sf):
    return r6(fc.minmax_norm(_cmp_spark(spark, sf)))


@register("sort_comparison",
          _CMP + "SELECT dataset, target, model, SMAPE, CAST(row_number() OVER (PARTITION BY dataset, target ORDER BY SMAPE, model) AS INTEGER) "
          "AS position FROM cmp")
def q_sort_comparison(spark, sf):
    """Comparison rows with their position within their dataset and target."""
    order = W.partitionBy("dataset", "target").orderBy("SMAPE", "model")
    return _cmp_spark(spark, sf).select("dataset", "target", "model", "SMAPE", F.row_number().over(order).alias("position"))


_AFUTURE = f"WITH {ALL}, {FUTURE('along', FUTURE_DAYS)}, {THETA('along', FUTURE_DAYS)}"


def future_forecasts(spark, sf) -> DataFrame:
    """Theta fitted on the whole history of every series: the next 60 business days."""
    return fc.theta_forecast(all_long(spark, sf), FUTURE_DAYS)


@register("forecast_intervals", _AFUTURE + f" SELECT {_NAME}, ds, CAST(step AS INTEGER) AS step, round(y_hat, 3) AS y_hat, round(sigma, 3) AS sigma, {BANDS} FROM theta")
def q_forecast_intervals(spark, sf):
    """60-day forecasts of all datasets and targets with bands that widen with the step."""
    return r3(named(fc.forecast_intervals(future_forecasts(spark, sf))))


@register("union_forecasts", _AFUTURE + f" SELECT 'theta' AS model, {_NAME}, ds, round(y_hat, 3) AS y_hat FROM theta "
          f"UNION ALL SELECT 'naive', {_NAME}, f.ds, round(l.last_y, 3) FROM fut f JOIN lastd l USING (unique_id)")
def q_union_forecasts(spark, sf):
    """60-day forecasts of two models over all datasets and targets in one table."""
    long = all_long(spark, sf)
    models = {"theta": fc.theta_forecast(long, FUTURE_DAYS), "naive": fc.naive_forecast(long, FUTURE_DAYS)}
    return r3(fc.union_forecasts([named(f.select("unique_id", "ds", "y_hat")).withColumn("model", F.lit(m)) for m, f in models.items()]))


@register("global_forecast",
          _AFUTURE + f", both_kinds AS (SELECT {_NAME}, ds, y AS v, 'history' AS kind FROM along UNION ALL SELECT {_NAME}, ds, y_hat, 'forecast' "
          "FROM theta) SELECT dataset, target, ds, round(sum(v), 3) AS value, kind FROM both_kinds GROUP BY dataset, target, ds, kind")
def q_global_forecast(spark, sf):
    """History and 60-day forecast summed over regions, per dataset and target."""
    by = ("dataset", "target")
    return r3(fc.global_forecast(all_long(spark, sf), named(future_forecasts(spark, sf)), by))


@register("join_forecast_left",
          f"WITH {_SINGLE}, s AS (SELECT 'national' AS unique_id, ds, poids AS y, row_number() OVER "
          f"(ORDER BY ds DESC) AS r FROM single), train AS (SELECT unique_id, ds, y FROM s WHERE r > {H}), "
          f"test AS (SELECT ds, y FROM s WHERE r <= {H}), {FUTURE('train', H)}, {NAIVE} "
          "SELECT t.ds, round(t.y, 6) AS y, round(n.y_hat, 6) AS y_hat FROM test t LEFT JOIN naive n ON t.ds = n.ds")
def q_join_forecast_left(spark, sf):
    """Single national series: test window left-joined to the naive forecast on date."""
    s = series.tail_split(single_series(spark, sf).select(F.lit("national").alias("unique_id"), "ds",
                                                          F.col("poids").alias("y")), H)
    train, test = s.filter(F.col("split") == "train"), s.filter(F.col("split") == "test")
    f = fc.naive_forecast(train.drop("split"), H)
    return r6(test.select("ds", "y").join(f.select("ds", "y_hat"), "ds", "left"))


@register("corr_between_series",
          "WITH top AS (SELECT depot_office FROM national WHERE depot_office IS NOT NULL GROUP BY 1 "
          "ORDER BY sum(weight_kg) DESC, depot_office LIMIT 5), d AS (SELECT deposit_date AS ds, depot_office, "
          "sum(weight_kg) AS y FROM national WHERE depot_office IN (SELECT * FROM top) GROUP BY 1, 2) "
          "SELECT a.depot_office AS col_a, b.depot_office AS col_b, round(corr(a.y, b.y), 6) AS corr "
          "FROM d a JOIN d b ON a.ds = b.ds AND a.depot_office < b.depot_office GROUP BY 1, 2")
def q_corr_between_series(spark, sf):
    """Daily weight of the 5 heaviest offices pivoted wide (5 columns), then all pairwise
    correlations in one aggregation (no pair rows are generated)."""
    fine, top = topk.aggregate_top_groups(national(spark, sf), F.col("deposit_date"), "depot_office",
                                          "weight_kg", 5, "sum")
    top = sorted(top)
    wide = fine.groupBy(F.col("_key").alias("ds")).pivot("depot_office", top).agg(F.sum("_v"))
    return r6(eda.corr_matrix(wide, top))
