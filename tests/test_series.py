"""Series preparation, Theta against a NumPy brute force, split invariants."""

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from parcelframe.operators import series as S
from parcelframe.plans import forecast as FC


def _business_days(start, n):
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(days=1)
    return out


def _series(spark, n=60):
    days = _business_days(dt.date(2024, 1, 1), n)
    rows = []
    for uid, scale in (("A", 1.0), ("B", 3.0)):
        for i, d in enumerate(days):
            y = scale * (50 + 0.8 * i + 10 * (d.weekday() == 0) + 4 * math.sin(i / 3.0))
            rows.append((uid, d, float(y)))
    return spark.createDataFrame(rows, "unique_id string, ds date, y double"), rows


def _theta_numpy(pts, h, alphas):
    ds = [p[0] for p in pts]
    y = np.array([p[1] for p in pts])
    n = len(y)
    dow = np.array([d.weekday() for d in ds])
    m = y.mean()
    fac = {w: (y[dow == w].mean() / m if m > 0 and y[dow == w].mean() > 0 else 1.0) for w in set(dow)}
    ya = y / np.array([fac[w] for w in dow])
    t = np.arange(1, n + 1, dtype=float)
    b = ((t - t.mean()) * (ya - ya.mean())).sum() / ((t - t.mean()) ** 2).sum()
    a = ya.mean() - b * t.mean()
    z = 2 * ya - (a + b * t)
    best = None
    for al in alphas:
        lvl, sse = z[0], 0.0
        for v in z:
            sse += (v - lvl) ** 2
            lvl = al * v + (1 - al) * lvl
        if best is None or (sse, al) < best[:2]:
            best = (sse, al, lvl)
    fut = _business_days(ds[-1] + dt.timedelta(days=1), h)
    return {d: max(0.0, (0.5 * (a + b * (n + k + 1)) + 0.5 * best[2]) * fac.get(d.weekday(), 1.0))
            for k, d in enumerate(fut)}


def test_theta_matches_numpy(spark):
    df, rows = _series(spark)
    got = {(r["unique_id"], r["ds"]): r["y_hat"] for r in FC.theta_forecast(df, 10).collect()}
    for uid in ("A", "B"):
        pts = [(d, y) for u, d, y in rows if u == uid]
        exp = _theta_numpy(pts, 10, FC.SES_ALPHAS)
        for d, v in exp.items():
            assert abs(got[(uid, d)] - v) < 1e-6 * max(1.0, abs(v))


def test_future_business_days(spark):
    df, _ = _series(spark)
    fut = S.future_business_days(df, 42).collect()
    for uid in ("A", "B"):
        days = [r["ds"] for r in fut if r["unique_id"] == uid]
        assert len(days) == 42 and all(d.weekday() < 5 for d in days)


def test_forecasts_non_negative_and_bands(spark):
    df, _ = _series(spark)
    f = FC.forecast_intervals(FC.theta_forecast(df, 5)).collect()
    assert all(r["y_hat"] >= 0 and r["lo_95"] <= r["lo_80"] <= r["y_hat"] <= r["hi_80"] <= r["hi_95"] for r in f)


def test_metrics_closed_form(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (0.0, 0.0)], "y double, y_hat double")
    m = FC.metrics(df).first()
    assert abs(m["MAE"] - 1 / 3) < 1e-12 and abs(m["RMSE"] - math.sqrt(1 / 3)) < 1e-12
    assert abs(m["SMAPE"] - (0.4 / 3) * 100) < 1e-9


def test_splits(spark):
    df, _ = _series(spark)
    s = S.train_test_cutoff(df, 30).groupBy("split").agg(F.countDistinct("ds").alias("d")).collect()
    assert {r["split"]: r["d"] for r in s} == {"train": 30, "test": 30}
    one = df.filter(F.col("unique_id") == "A")
    c = {r["split"]: r["count"] for r in S.chrono_split(one).groupBy("split").count().collect()}
    assert c == {"train": 45, "validation": 9, "test": 6}


def test_rolling_min_periods(spark):
    df, rows = _series(spark)
    r = S.rolling_features(df.filter(F.col("unique_id") == "A"), [5]).orderBy("ds").collect()
    assert r[0]["roll_mean_5"] is None and r[0]["roll_std_5"] == 0.0 and r[1]["roll_std_5"] == 0.0
    assert abs(r[1]["roll_mean_5"] - r[0]["y"]) < 1e-12


def test_calendar_fill(spark):
    d = spark.createDataFrame([(dt.date(2026, 12, 4), 1), (dt.date(2026, 12, 9), 2)], "ds date, n int")
    out = S.calendar_fill(d, ["n"]).orderBy("ds").collect()
    assert [r["n"] for r in out] == [1, 0, 0, 2]  # Fri, Mon, Tue, Wed
