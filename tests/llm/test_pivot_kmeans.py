"""Exact k-means against plain Python integers."""

import hashlib
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from parcelframe.llm import pivot_kmeans as K

from .conftest import clash


def plain(rows, k=8, rounds=10, dimension=64):
    """rows: (vec_id, components); sorted result rows."""
    fine = [(i, [math.floor(1024 * Fraction(c)) for c in v]) for i, v in rows
            if v is not None and len(v) == dimension and all(c is not None and math.isfinite(c) for c in v)]
    ranked = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in fine if i is not None)
    centroids = [v for _, v in ranked[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds if centroids else 0):
        own = {}
        for _, v in fine:
            own.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(own[n]) for x in zip(*own[n])] if n in own else c for n, c in enumerate(centroids)]
    if not centroids:
        return []
    found = [(i, *near(v)) for i, v in fine]
    total = sum(d for _, d, _ in found)
    by = {n: sum(d for _, d, m in found if m == n) for n in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, by[n], total, sha[n]) for i, d, n in found), key=str)


def frame(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def got(df, **how):
    return sorted((tuple(r) for r in K.kmeans(df, **how).collect()), key=str)


@pytest.mark.parametrize("seed,scale,dimension", [(1, 1.0, 64), (2, 0.002, 64), (3, 300.0, 5), (4, 0.004, 2)])
def test_as_by_brute_force(spark, seed, scale, dimension):
    rng = random.Random(seed)  # small scales make many ties and empty clusters
    rows = [(i, [rng.gauss(0, scale) for _ in range(dimension)]) for i in range(220)]
    rows += rows[:9] + [(None, rows[3][1]), (-7, rows[4][1])]
    rows += [(900, None), (901, []), (902, rows[0][1][:-1]), (903, [None] + rows[0][1][1:]), (904, [float("nan")] + rows[0][1][1:]), (905, [float("-inf")] + rows[0][1][1:])]
    spent = []
    assert got(clash(frame(spark, rows)).repartition(4), dimension=dimension, spent=spent) == plain(rows, dimension=dimension)
    n = 231
    assert len(spent) == 10 and all(n <= s <= 8 * n for s in spent)


def test_bounds_save_distances(spark):
    rng = random.Random(5)
    middle = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(8)]
    rows = [(i, [c + rng.gauss(0, 0.01) for c in middle[i % 8]]) for i in range(400)]
    spent = []
    assert got(frame(spark, rows, "float"), spent=spent) == plain([(r.vec_id, r.embedding) for r in frame(spark, rows, "float").collect()])
    assert spent[-1] < 400 * 4


def test_large_components_stay_exact(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([-1, 1]) * 10 ** rng.uniform(-3, 4) for _ in range(4)]) for i in range(60)]
    rows += [(100 + i, [1e6 + rng.randint(0, 9), -2e6, 3.5, 0.001 * i]) for i in range(20)]
    assert got(frame(spark, rows), dimension=4) == plain(rows, dimension=4)
    # a distance beyond a long is an error; vectors of any size at a centroid are not
    same = [(i, [1e30, -1e300, 1.0, 0.0]) for i in range(20)]
    assert got(frame(spark, same), dimension=4) == plain(same, dimension=4)
    with pytest.raises(Exception, match="doesn't fit a long"):
        got(frame(spark, same + [(50, [0.0] * 4)]), dimension=4, k=1)


def test_few_vectors_and_empty_table(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)]
    assert got(frame(spark, rows)) == plain(rows)
    assert got(frame(spark, rows[:1] * 5)) == plain(rows[:1] * 5)
    empty = K.kmeans(frame(spark, []))
    assert empty.count() == 0 and [f.name for f in empty.schema] == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert got(frame(spark, [(None, [1.0] * 64)])) == []


@pytest.mark.parametrize("n", [0, 1, -1, 2 ** 40 - 1, -(2 ** 40), 2 ** 40, 3 ** 90, -(3 ** 90), -(2 ** 80) + 5])
def test_limbs(n):
    parts = list(K.limbs(n))
    assert sum(v << (K.LIMB * k) for k, v in parts) == n and all(abs(v) < 2 ** 41 for _, v in parts)


def test_tasks_get_no_more_than_pivots_and_centroids(spark):
    rows = frame(spark, [(i, [float(i % 7), 1.0]) for i in range(50)]).withColumn("extra", F.lit(1))
    plan = K.kmeans(rows, dimension=2)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
