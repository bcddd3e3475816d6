"""The choice among theta models, against a plain version that refits at every origin."""

import datetime as dt

import numpy as np
import pytest

from parcelframe.plans import autotheta as A
from parcelframe.plans.forecast import SES_ALPHAS


def _days(n):
    out, d = [], dt.date(2024, 1, 1)
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(1)
    return out


def _plain(y, days, h):
    """(forecasts, theta, alpha, seasonal) of one series."""
    n, m = len(y), y.mean()
    off = y - m
    r = [(off[k:] * off[:-k]).sum() / (off ** 2).sum() for k in range(1, 6)]
    seasonal = n >= 10 and abs(r[4]) > 1.645 * np.sqrt((1 + 2 * sum(x * x for x in r[:4])) / n)
    factor = {w: y[[d.weekday() == w for d in days]].mean() / m if seasonal else 1.0 for w in range(5)}
    ya = np.array([v / factor[d.weekday()] for v, d in zip(y, days)])

    def forecast(part, alpha, theta, steps):
        t = np.arange(1, len(part) + 1)
        b, a = np.polyfit(t, part, 1)
        z = theta * part + (1 - theta) * (a + b * t)  # the theta line, smoothed from its first value
        level = z[0]
        for v in z[1:]:
            level = alpha * v + (1 - alpha) * level
        return level / theta + (1 - 1 / theta) * (a + b * (len(part) + steps))

    best = min(((sum((ya[t] - forecast(ya[:t], al, th, 1)) ** 2 for t in range(2, n)), al, th) for al in SES_ALPHAS for th in A.THETAS))
    return forecast(ya, best[1], best[2], np.arange(1, h + 1)), factor, best[2], best[1], seasonal


@pytest.mark.parametrize("kind", ["level", "trend", "weekly"])
def test_as_by_refitting(spark, kind):
    rng, days = np.random.default_rng(len(kind)), _days(45)
    y = {"level": 100 + rng.normal(0, 10, 45), "trend": 50 + 3 * np.arange(45) + rng.normal(0, 2, 45),
         "weekly": 100 + 30 * np.array([d.weekday() for d in days]) + rng.normal(0, 5, 45)}[kind]
    train = spark.createDataFrame([("a", d, float(v)) for d, v in zip(days, y)], "unique_id string, ds date, y double")
    got = A.auto_theta_forecast(train, 10).orderBy("ds").collect()
    want, factor, theta, alpha, seasonal = _plain(y, days, 10)
    # the test reads the series as it is, so a strong trend correlates at every lag
    assert bool(seasonal) == got[0].seasonal == (kind != "level")
    assert got[0].theta == pytest.approx(theta) and got[0].alpha == alpha and len(got) == 10
    assert [r.y_hat for r in got] == pytest.approx([max(v * factor[r.ds.weekday()], 0) for v, r in zip(want, got)])
    assert [r.sigma for r in got][-1] >= got[0].sigma * 0.2 and all(r.sigma > 0 for r in got)


def test_defined_results(spark):
    days = _days(30)
    rows = [("flat", d, 7.0) for d in days] + [("one", days[0], 3.0)] + [("two", d, v) for d, v in zip(days, (3.0, 5.0))] + [("zero", d, 0.0) for d in days[:12]]
    train = spark.createDataFrame(rows, "unique_id string, ds date, y double")
    got = {}
    for r in A.auto_theta_forecast(train, 5).collect():
        got.setdefault(r.unique_id, []).append(r)
    assert {k: len(v) for k, v in got.items()} == {"flat": 5, "one": 5, "two": 5, "zero": 5}
    assert all(r.y_hat == pytest.approx(7.0) and not r.seasonal for r in got["flat"])
    assert all(r.y_hat == pytest.approx(3.0) for r in got["one"]) and all(r.y_hat == 0 for r in got["zero"])
    assert got["two"][0].alpha == SES_ALPHAS[0] and got["two"][0].theta == 1.0 and got["two"][0].sigma == 0
    assert A.auto_theta_forecast(train.limit(0), 5).count() == 0
