"""k-means restarts that share their scans, against plain versions."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from parcelframe.plans import restarts as R


def _frame(spark, x, parts=3):
    return spark.createDataFrame([(row.tolist(),) for row in x], "v array<double>").repartition(parts).cache()


def _blobs(seed, n=600, k=4, dim=3):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(c, 0.6, (n // k, dim)) for c in rng.normal(0, 4, (k, dim))])


def test_one_round_as_by_brute_force(spark):
    x = _blobs(1)
    centres = {r: np.random.default_rng(r).choice(x, 4 + r) for r in range(3)}
    for few in (0, 32):  # summed by Spark, and by the driver
        old, R.FEW = R.FEW, few
        try:
            got = R._scanned(_frame(spark, x), centres, 3)
        finally:
            R.FEW = old
        for r, c in centres.items():
            d = ((x[:, None] - c[None]) ** 2).sum(2)
            near = d.argmin(1)
            assert got[r][0].tolist() == np.bincount(near, minlength=len(c)).tolist()
            assert got[r][2] == pytest.approx(d.min(1).sum())
            assert np.allclose(got[r][1], [x[near == k].sum(0) for k in range(len(c))])


def test_fits_are_settled_and_no_worse_than_one_by_one(spark):
    x = _blobs(2)
    df = _frame(spark, x).withColumn("features", array_to_vector("v")).cache()
    fit = R.kmeans_restarts(df, 4, 10, 42)
    alone = min(KMeans(k=4, seed=42 + i, featuresCol="features").fit(df).summary.trainingCost for i in range(10))
    assert min(fit.costs) <= alone * (1 + 1e-6)
    for c, cost in zip(fit.centres, fit.costs):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        assert cost == pytest.approx(d.min(1).sum())
    best = fit.best
    near = ((x[:, None] - best[None]) ** 2).sum(2).argmin(1)
    assert np.allclose(best, [x[near == k].mean(0) for k in range(4)], atol=1e-3)
    again = R.kmeans_restarts(df, 4, 10, 42)
    assert all(np.allclose(a, b) for a, b in zip(fit.centres, again.centres))
    rows = df.select("v", R.nearest(best, F.col("v")).alias("c")).collect()
    assert [r.c for r in rows] == [int(((np.array(r.v) - best) ** 2).sum(1).argmin()) for r in rows]


def test_scans_grow_with_rounds_not_restarts(spark):
    df, rounds = _frame(spark, np.random.default_rng(3).uniform(size=(500, 2))), []  # no clusters: many rounds
    fit = R.kmeans_restarts(df, 4, 10, 7, F.col("v"), observe=lambda n, costs: rounds.append(costs))
    assert fit.scans == 2 + R.STEPS + len(rounds) and len(rounds) <= R.ROUNDS + 1
    assert len(rounds[0]) == 10 and sum(map(len, rounds)) < 10 * len(rounds)  # settled restarts drop out
    for r in range(10):
        costs = [c[r] for c in rounds if r in c]
        assert all(a >= b * (1 - 1e-9) for a, b in zip(costs, costs[1:]))


def test_sample_is_weighted_by_distance(spark):
    x = np.array([[0.0]] * 500 + [[1.0]] * 400 + [[10.0]] * 20)
    df = _frame(spark, x)
    picks = R._sampled(df, {r: np.array([[0.0]]) for r in range(200)}, 200, 1, 5, 1)
    share = np.mean([p[0][0] == 10.0 for p in picks.values()])
    assert 0.7 < share < 0.95  # 2000 of 2400
    assert all(len(p) == 1 and p[0][0] != 0.0 for p in picks.values())


@pytest.mark.parametrize("x", [np.zeros((0, 2)), np.zeros((5, 2)), np.array([[1.0, 2.0]]), np.array([[0.0, 0.0]] * 9 + [[1.0, 1.0]])])
def test_few_or_equal_rows(spark, x):
    fit = R.kmeans_restarts(_frame(spark, x, 2) if len(x) else spark.createDataFrame([], "v array<double>"), 3, 4, 1, F.col("v"))
    assert all(c == pytest.approx(0) for c in fit.costs) and len(fit.centres) == 4
