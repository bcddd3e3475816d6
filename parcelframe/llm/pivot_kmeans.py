"""Exact k-means over integer vectors with a LAESA pivot table.

The index holds every vector's distances to ``PIVOTS`` fixed pivots, computed
and stored once. In each round the centroids' distances to the same pivots are
taken; by the triangle inequality |d(x, p) - d(c, p)| never exceeds d(x, c), so
the largest such difference bounds every centroid from below. A vector visits
centroids in the order of their bounds and stops where no bound can reach the
best distance found. Centroids that survive get exact integer distances;
bounds are lowered by more than floating point can err, so ties are never lost.

A round is one scan of the index. Each task adds up its vectors by cluster and
component; the sums, cut into 40-bit limbs so that they're exact at any size,
are reduced by Spark and the driver gets at most k * dimension * limbs numbers.
Pivots and centroids (k + PIVOTS vectors) are the only values sent to tasks.

Defined results: a vector takes part if it has exactly ``dimension`` components,
none null or NaN or infinite, however large: beyond 2^27 its distances are
computed with Python's integers, and a distance or an inertia that a long can't
hold is an OverflowError, never a wrong number. The first centroids are the
``k`` vectors of the smallest hashes (fewer, if there are fewer vectors); rows of
one id and hash come in the order of their components. A null vec_id gets a
cluster, but is never a first centroid. Repeated rows count each. Ties go to the
smaller cluster number. An empty table, or one without fitting vectors, gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

PIVOTS, SAMPLE, STEP = 16, 2048, 8192
#: Up to here, sums of squares of differences fit 64 bits in any dimension up to 512.
SMALL = 1 << 26
LIMB = 40
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def integers(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x): as int64 where all are small, else as Python integers."""
    x = x.astype(np.float64)
    if x.size == 0 or np.abs(x).max() * 1024 <= SMALL:
        return np.floor(x * 1024).astype(np.int64)
    exact = [int(c) * 1024 if abs(c) >= 2.0 ** 53 else int(np.floor(c * 1024)) for c in x.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(x.shape)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to rows of c, as int64 or Python integers."""
    if x.dtype != object and c.dtype != object:
        y = x - c
        return np.einsum("ij,ij->i", y, y)
    y = x.astype(object) - c.astype(object)
    return (y * y).sum(1)


def roots(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances as doubles, of every row to every point."""
    x, points = x.astype(np.float64), points.astype(np.float64)
    out = np.empty((len(x), len(points)))
    with np.errstate(over="ignore", invalid="ignore"):
        for k, p in enumerate(points):
            y = x - p
            out[:, k] = np.sqrt(np.einsum("ij,ij->i", y, y))
    return out


def nearest(x: np.ndarray, d: np.ndarray, centroids: np.ndarray, c_d: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, exact squared distance, exact distances computed) of each row; ``d`` and ``c_d`` are pivot distances."""
    n, k = len(x), len(centroids)
    low = np.zeros((n, k))
    with np.errstate(over="ignore", invalid="ignore"):
        for p in range(d.shape[1]):
            a, b = d[:, p, None], c_d[None, :, p]
            # less what rounding can add, as the roots are right to a few units in the last place
            np.maximum(low, np.nan_to_num(np.abs(a - b) - 1e-9 * (a + b) - 1e-6, nan=0.0, posinf=0.0, neginf=0.0), out=low)
        low = low * low * (1 - 1e-9)
    low[~np.isfinite(low)] = 0
    order = np.argsort(low, 1, kind="stable")
    wide = x.dtype == object or centroids.dtype == object
    best, cluster = np.zeros(n, object if wide else np.int64), np.full(n, k, np.int64)
    rows, spent = np.arange(n), 0
    for r in range(k):
        c = order[rows, r]
        if r:
            live = low[rows, c] <= best[rows].astype(np.float64) * (1 + 1e-12) + 1e-6
            rows, c = rows[live], c[live]  # bounds only grow from here, so a row that stops has ended
            if not len(rows):
                break
        found = squared(x[rows], centroids[c])
        spent += len(rows)
        if r:
            better = (found < best[rows]) | ((found == best[rows]) & (c < cluster[rows]))
            better = better.astype(bool)
        else:
            better = np.ones(len(rows), bool)
        best[rows[better]], cluster[rows[better]] = found[better], c[better]
    return cluster, best, spent


def fitting(vectors: DataFrame, dimension: int) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where((F.size("embedding") == dimension) & fine)


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors of the smallest hex sha256 of ``salt:<vec_id>``."""
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id IS NOT NULL").withColumn("h", name).orderBy("h", "embedding").limit(k).collect()
    return integers(np.array([r.embedding for r in rows], np.float64)) if rows else np.zeros((0, 0), np.int64)


def fixed_pivots(vectors: DataFrame, count: int) -> np.ndarray:
    """Pivots amid the vectors: means of ``count`` groups of a sample of at most ``SAMPLE`` vectors (the first by a
    hash of the id). A centroid near a pivot p has nearly the bound d(x, p), which nearly is its distance; a pivot far
    from all centroids would bound none of them well."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "embedding").limit(SAMPLE).collect()
    x = integers(np.array([r.embedding for r in rows], np.float64)).astype(np.float64)
    if not len(x):
        return x
    pivots = np.unique(x, axis=0)
    pivots = pivots[np.random.default_rng(7).permutation(len(pivots))[:count]]
    with np.errstate(over="ignore", invalid="ignore"):
        for _ in range(10):
            near = np.nan_to_num(roots(x, pivots), nan=np.inf).argmin(1)
            for p in np.unique(near):
                pivots[p] = x[near == p].mean(0)
    return pivots[np.isfinite(pivots).all(1)]


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def pivot_table(vectors: DataFrame, pivots: Broadcast) -> DataFrame:
    """(vec_id, embedding, d): every vector with its distances to all pivots."""
    kind = vectors.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("embedding"))
            d = roots(integers(x), pivots.value) if len(x) else np.zeros((0, len(pivots.value)))
            edge = pa.array(np.arange(0, d.size + 1, max(1, d.shape[1])), pa.int32())
            yield pa.record_batch([b.column("vec_id"), b.column("embedding"), pa.ListArray.from_arrays(edge[:len(x) + 1], pa.array(d.ravel()))], ["vec_id", "embedding", "d"])

    return vectors.mapInArrow(run, f"vec_id long, embedding {kind}, d array<double>")


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, pivots: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(vec_id, integer vectors, cluster, distance, exact distances computed) of slices of a partition."""
    c_d = roots(centroids, pivots)
    for whole in batches:
        for at in range(0, whole.num_rows, STEP):
            b = whole.slice(at, STEP)
            x = integers(_matrix(b.column("embedding")))
            yield b.column("vec_id"), x, *nearest(x, _matrix(b.column("d")), centroids, c_d)


def limbs(n: int) -> Iterator[tuple[int, int]]:
    """(position, limb) with n = sum of limb * 2^(LIMB * position); the last limb carries the sign."""
    k = 0
    while n:
        rest = n & ((1 << LIMB) - 1)
        if -(1 << LIMB) < n < 0:
            rest = n
        yield k, rest
        n, k = (n - rest) >> LIMB, k + 1


def cluster_sums(index: DataFrame, centroids: np.ndarray, pivots: Broadcast) -> tuple[dict[int, int], dict[tuple[int, int], int], int]:
    """One scan: vectors of each cluster, sum of each (cluster, component), and exact distances computed."""
    held = index.sparkSession.sparkContext.broadcast(centroids)  # k vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dimension = held.value.shape
        count, total, spent = [0] * k, np.zeros((k, dimension), object), 0
        for _, x, cluster, _, n in _assigned(batches, held.value, pivots.value):
            spent += n
            for c in np.unique(cluster).tolist():
                own = x[cluster == c]
                count[c] += len(own)
                total[c] += own.sum(0).astype(object)  # at most STEP small integers: exact
        out = [(c, -1, 0, n) for c, n in enumerate(count) if n] + [(-1, -1, 0, spent)]
        out += [(c, i, p, v) for c in range(k) for i in range(dimension) for p, v in limbs(int(total[c, i]))]
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["cluster", "component", "limb", "value"])

    found = index.mapInArrow(run, "cluster int, component int, limb int, value long")
    rows = found.groupBy("cluster", "component", "limb").agg(F.sum("value").alias("value")).collect()
    count, total, spent = {}, {}, 0
    for r in rows:
        if r.cluster < 0:
            spent = r.value
        elif r.component < 0:
            count[r.cluster] = r.value
        else:
            total[r.cluster, r.component] = total.get((r.cluster, r.component), 0) + (r.value << (LIMB * r.limb))
    return count, total, spent


def moved(centroids: np.ndarray, count: dict[int, int], total: dict[tuple[int, int], int]) -> np.ndarray:
    """Centroids after a round: floor(sum / count) of each component; empty clusters stay."""
    out = centroids.astype(object)
    for c, n in count.items():
        out[c] = [total.get((c, i), 0) // n for i in range(out.shape[1])]
    return out.astype(np.int64) if all(abs(v) <= SMALL for v in out.ravel()) else out


def kmeans(vectors: DataFrame, k: int = 8, rounds: int = 10, dimension: int = 64, salt: str = "3", spent: list[int] | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part.

    ``spent``, if given, gets the number of exact distances of each round (vectors * k without bounds)."""
    spark = vectors.sparkSession
    whole = fitting(vectors, dimension)
    centroids = first_centroids(whole, k, salt)
    pivots = spark.sparkContext.broadcast(fixed_pivots(whole, PIVOTS))  # PIVOTS vectors
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    index = stored(pivot_table(whole, pivots), "pivot-table")
    for _ in range(rounds):
        count, total, n = cluster_sums(index, centroids, pivots)
        centroids = moved(centroids, count, total)
        if spent is not None:
            spent.append(n)
    held = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, cluster, distance, _ in _assigned(batches, held.value, pivots.value):
            if distance.dtype == object and any(v >= 1 << 63 for v in distance):
                raise OverflowError("a squared distance doesn't fit a long")
            yield pa.record_batch([ids, pa.array(cluster.astype(np.int32)), pa.array([int(v) for v in distance], pa.int64())], ["vec_id", "cluster", "distance"])

    final = stored(index.mapInArrow(run, "vec_id long, cluster int, distance long"), "clusters")
    names = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    sums = {r.cluster: int(r.s) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    inertia = sum(sums.values())
    if inertia >= 1 << 63:
        raise OverflowError("the inertia doesn't fit a long")
    named = spark.createDataFrame([(c, s, inertia, names[c][1]) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(rounds: int = 10) -> str:
    """The rounds written out: plain distances to all centroids."""
    dist = "list_sum(list_transform(generate_series(1, 64), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i])))"
    out = ["""WITH vecs AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS k, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM vecs WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT 8))"""]
    for n in range(rounds + 1):
        out.append(f"""a{n} AS MATERIALIZED (SELECT r, vec_id, v, k, CAST(d AS BIGINT) AS d FROM (SELECT v.r, v.vec_id, v.v, c.k, {dist} AS d FROM vecs v, c{n} c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)""")
        if n < rounds:
            out.append(f"""m{n} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{n}) GROUP BY k, i),
c{n + 1} AS MATERIALIZED (SELECT c{n}.k, coalesce(f.v, c{n}.v) AS v FROM c{n} LEFT JOIN (SELECT k, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS v FROM m{n} GROUP BY k) f USING (k))""")
    return ",\n".join(out) + f"""
SELECT vec_id, k AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (k)"""


ORACLE = _oracle()
