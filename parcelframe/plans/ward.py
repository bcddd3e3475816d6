"""Ward's agglomerative clustering over a bounded summary.

Each group of equal vectors is a clustering feature (count and mean). Up to
``BOUND`` of them, Ward merges run on exactly these, so the result is that of
plain Ward. Beyond, ``BOUND`` vectors are sampled (two scans), a third adds all rows to the
nearest of them, and those counts and means are merged: features add up, so
the summary costs three scans at any size and the driver holds ``BOUND`` rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .restarts import _sampled, _scanned, nearest

BOUND = 1000


def merged(count: np.ndarray, mean: np.ndarray, k: int) -> np.ndarray:
    """The cluster (0 to k-1, in the order of their first members) of each feature: the pair whose merge adds least
    to the squared distances within clusters goes first, ties to the first members."""
    m = len(count)
    n = count.astype(float)
    cost = n[:, None] * n[None] / (n[:, None] + n[None]) * ((mean[:, None] - mean[None]) ** 2).sum(2)
    cost[np.tril_indices(m)] = np.inf
    label = np.arange(m)
    for _ in range(m - k):
        i, j = divmod(int(cost.argmin()), m)
        row = lambda a: np.where(np.arange(m) < a, cost[:, a], cost[a])  # noqa: B023, E731
        di, dj, dij = row(i), row(j), cost[i, j]
        with np.errstate(invalid="ignore"):
            new = ((n[i] + n) * di + (n[j] + n) * dj - n * dij) / (n[i] + n[j] + n)
        n[i] += n[j]
        label[label == j] = i
        live = np.isfinite(new) & (np.arange(m) != i)
        for a in np.flatnonzero(live):
            cost[min(a, i), max(a, i)] = new[a]
        cost[j], cost[:, j] = np.inf, np.inf
    return np.unique(label, return_inverse=True)[1]


def features(vectors: DataFrame, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points, counts, means): at most ``BOUND`` clustering features of the rows ``v``, each that of the rows nearest to its point."""
    distinct = vectors.groupBy("v").agg(F.count(F.lit(1)).alias("n")).limit(BOUND + 1).collect()
    if len(distinct) <= BOUND:
        rows = sorted((tuple(r.v), r.n) for r in distinct)
        points = np.array([v for v, _ in rows])
        return points, np.array([n for _, n in rows]), points
    # half alike, half by squared distance to those, so that a small group far from the rest is represented
    some = _sampled(vectors, None, 1, BOUND // 2, seed, 0)[0]
    far = _sampled(vectors, {0: np.array(some)}, 1, BOUND - len(some), seed, 1)[0]
    points = np.unique(np.array(some + far), axis=0)
    count, sums, _ = _scanned(vectors, {0: points}, points.shape[1])[0]
    held = count > 0
    return points[held], count[held], sums[held] / count[held, None]


def ward(df: DataFrame, k: int, vector: Column | None = None) -> DataFrame:
    """Rows with their cluster (``raw``) of Ward's ``k``."""
    from pyspark.ml.functions import vector_to_array

    ship(df.sparkSession)
    vector = vector_to_array("features") if vector is None else vector
    points, count, mean = features(df.select(vector.alias("v")))
    label = merged(count, mean, min(k, len(count)))
    return df.withColumn("raw", F.element_at(F.array(*[F.lit(int(x)) for x in label]), nearest(points, vector) + 1))
