"""The exact Euclidean silhouette, against a plain version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelframe.plans.silhouette import silhouette


def _plain(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i, c in enumerate(labels):
        own = labels == c
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == o].mean() for o in set(labels) - {c})
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


def _frame(spark, x, labels):
    return spark.createDataFrame([(int(c), row.tolist()) for c, row in zip(labels, x)], "cluster int, v array<double>")


@pytest.mark.parametrize("tile", [7, 64, 2048])
def test_as_by_brute_force(spark, tile):
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 4, 180)
    labels[0] = 9  # alone in its cluster
    x = rng.normal(0, 1, (180, 3)) + labels[:, None]
    x[20:60], labels[20:60] = x[20], labels[20]  # repeated rows
    x[60:64] = x[60]  # equal rows of several clusters
    got = silhouette(_frame(spark, x, labels), F.col("v"), tile)
    assert got == pytest.approx(_plain(x, labels), abs=1e-12)


def test_defined_results(spark):
    one = np.zeros((5, 2))
    assert silhouette(_frame(spark, one, [0] * 5), F.col("v")) is None
    assert silhouette(_frame(spark, one, range(5)), F.col("v")) is None
    assert silhouette(_frame(spark, one, [0, 0, 0, 1, 1]), F.col("v")) == 0.0
    assert silhouette(_frame(spark, one, [0] * 5).limit(0), F.col("v")) is None
    far = np.array([[0.0], [0.0], [9.0], [9.0]])
    gaps = _frame(spark, far, [0, 0, 1, 1]).unionByName(spark.createDataFrame([(None, [1.0]), (1, None)], "cluster int, v array<double>"))
    assert silhouette(gaps, F.col("v")) == 1.0
