"""k-means with many restarts that advance together.

Every round is one scan of the vectors, whatever the number of restarts: tasks
take all restarts' centres, assign their rows to the nearest centre of each, and
add up count, sum and cost by (restart, cluster); Spark reduces those sums, and
the driver gets restarts x k rows. Restarts that have settled drop out.

Seeding is k-means||, also one scan a step: each task keeps, per restart, the
``2k`` rows of the smallest keys -ln(u) / d^2 (an exponential race: a sample
without replacement weighted by squared distance), and the smallest of all tasks
become candidates. A last scan weighs the candidates by the rows nearest to
them; weighted k-means++ picks k of those at most 1 + 2k * steps rows on the driver.

Draws depend on the seed, the restart, the step and the rows' place in their
partitions, so a frame that is written or persisted gives the same fit again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship

STEPS, ROUNDS, TOLERANCE = 2, 20, 1e-4
#: Rows that a task takes at a time; tasks up to which the driver adds up their sums.
CHUNK, FEW = 8192, 32


@dataclass
class Fit:
    """The centres and costs of all restarts, and how many scans they took."""

    centres: list[np.ndarray]
    costs: list[float]
    scans: int

    @property
    def best(self) -> np.ndarray:
        return self.centres[min(range(len(self.costs)), key=lambda r: (self.costs[r], r))]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """A partition's vectors, some thousand at a time."""
    for b in batches:
        lists = b.column("v")
        x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))
        for at in range(0, len(x), CHUNK):
            yield x[at:at + CHUNK]


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres."""
    out = np.zeros((len(x), len(centres)))
    for j in range(x.shape[1]):
        out += (x[:, j, None] - centres[None, :, j]) ** 2
    return out


def _sampled(vectors: DataFrame, centres: dict[int, np.ndarray] | None, restarts: int, take: int, seed: int, step: int) -> dict[int, list[np.ndarray]]:
    """One scan: for each restart ``take`` different rows, weighted by their squared distance to its centres (alike without centres)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rng = [np.random.default_rng([seed + r, step, part]) for r in range(restarts)]
        best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * restarts
        for x in _rows(batches):
            for r in range(restarts):
                d = squared(x, centres[r]).min(1) if centres else np.ones(len(x))
                with np.errstate(divide="ignore"):
                    key = np.where(d > 0, rng[r].exponential(size=len(x)) / d, np.inf)
                keep = np.argsort(key, kind="stable")[:take]
                keep = keep[np.isfinite(key[keep])]
                key, rows = key[keep], x[keep]
                if best[r] is not None:
                    key, rows = np.concatenate([best[r][0], key]), np.concatenate([best[r][1], rows])
                    order = np.argsort(key, kind="stable")[:take]
                    key, rows = key[order], rows[order]
                best[r] = key, rows
        out = [(r, float(k), row) for r, found in enumerate(best) if found for k, row in zip(*found)]
        yield pa.record_batch([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.float64()),
                               pa.array([o[2] for o in out], pa.list_(pa.float64()))], ["restart", "key", "v"])

    found = vectors.mapInArrow(run, "restart int, key double, v array<double>")
    order = W.partitionBy("restart").orderBy("key", "v")
    rows = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= take).collect()  # restarts x take
    out: dict[int, list[np.ndarray]] = {r: [] for r in range(restarts)}
    for r in sorted(rows, key=lambda r: (r.restart, r["rank"])):
        out[r.restart].append(np.array(r.v))
    return out


def _scanned(vectors: DataFrame, centres: dict[int, np.ndarray], dim: int) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """One scan: (rows of each cluster, their sums, cost) of every restart."""
    names = [f"s{j}" for j in range(dim)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {r: np.zeros((len(c), dim + 2)) for r, c in centres.items()}  # count, cost, sums
        for x in _rows(batches):
            for r, c in centres.items():
                d = squared(x, c)
                near = d.argmin(1)
                own = np.column_stack([np.ones(len(x)), d[np.arange(len(x)), near], x])
                for j in range(dim + 2):
                    sums[r][:, j] += np.bincount(near, own[:, j], len(c))
        rows = [(r, n, *s) for r, all_ in sums.items() for n, s in enumerate(all_.tolist()) if s[0]]
        kinds = [pa.int32(), pa.int32(), *[pa.float64()] * (dim + 2)]
        yield pa.record_batch([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], ["restart", "cluster", "n", "cost", *names])

    ddl = "restart int, cluster int, n double, cost double, " + ", ".join(f"{n} double" for n in names)
    found = vectors.mapInArrow(run, ddl)
    if vectors.rdd.getNumPartitions() > FEW:  # of few tasks, the driver adds up the sums itself
        found = found.groupBy("restart", "cluster").agg(*[F.sum(c).alias(c) for c in ("n", "cost", *names)])
    out = {r: (np.zeros(len(c)), np.zeros((len(c), dim)), [0.0] * len(c)) for r, c in centres.items()}
    for row in found.collect():  # restarts x clusters
        count, sums, cost = out[row.restart]
        count[row.cluster] += row.n
        sums[row.cluster] += [row[n] for n in names]
        cost[row.cluster] += row.cost
    return {r: (count, sums, float(sum(cost))) for r, (count, sums, cost) in out.items()}


def _plus_plus(points: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 30) -> np.ndarray:
    """Weighted k-means++ and some Lloyd rounds over the candidates (fewer than k, if there are fewer)."""
    points, at = np.unique(points, axis=0, return_inverse=True)
    weight = np.bincount(at.ravel(), weight, len(points))
    if len(points) <= k:
        return points
    chosen = [points[rng.choice(len(points), p=weight / weight.sum())]]
    while len(chosen) < k:
        d = squared(points, np.array(chosen)).min(1) * weight
        if not d.sum() > 0:  # candidates without rows
            d = squared(points, np.array(chosen)).min(1)
        chosen.append(points[rng.choice(len(points), p=d / d.sum())])
    centres = np.array(chosen)
    for _ in range(rounds):
        near = squared(points, centres).argmin(1)
        new = centres.copy()
        for c in range(k):
            own = near == c
            if weight[own].sum() > 0:
                new[c] = np.average(points[own], axis=0, weights=weight[own])
        if np.array_equal(new, centres):
            break
        centres = new
    return centres


def kmeans_restarts(df: DataFrame, k: int, restarts: int, seed: int, vector: Column | None = None,
                    observe: Callable[[int, dict[int, float]], None] | None = None) -> Fit:
    """Fits ``restarts`` k-means models (at most ``ROUNDS`` rounds each) over the vectors of ``df``.

    ``vector`` is an array<double> (by default the ML vector column ``features``); ``observe`` gets each
    round's costs."""
    from pyspark.ml.functions import vector_to_array

    ship(df.sparkSession)
    vectors = df.select((vector_to_array("features") if vector is None else vector).alias("v"))
    first = _sampled(vectors, None, restarts, 1, seed, 0)
    scans, found = 1, {r: rows for r, rows in first.items() if rows}
    if not found:
        return Fit([np.zeros((0, 0))] * restarts, [0.0] * restarts, scans)
    dim = len(found[0][0])
    for step in range(1, STEPS + 1):
        more = _sampled(vectors, {r: np.array(rows) for r, rows in found.items()}, restarts, 2 * k, seed, step)
        found = {r: rows + more[r] for r, rows in found.items()}
        scans += 1
    candidates = {r: np.array(rows) for r, rows in found.items()}
    weights = _scanned(vectors, candidates, dim)
    scans += 1
    centres = {r: _plus_plus(c, weights[r][0], k, np.random.default_rng([seed + r, STEPS + 1])) for r, c in candidates.items()}
    costs, open_, n = {}, dict(centres), 0
    while open_:
        now = _scanned(vectors, open_, dim)
        scans += 1
        if observe:
            observe(n, {r: cost for r, (_, _, cost) in now.items()})
        for r, (count, sums, cost) in now.items():
            costs[r] = cost  # of the centres as they stand
            full = count > 0
            new = centres[r].copy()
            new[full] = sums[full] / count[full, None]
            if n == ROUNDS or ((new - centres[r]) ** 2).sum(1).max() <= TOLERANCE ** 2:
                del open_[r]
            else:
                centres[r] = open_[r] = new
        n += 1
    return Fit([centres[r] for r in range(restarts)], [costs[r] for r in range(restarts)], scans)


def nearest(centres: np.ndarray, vector: Column) -> Column:
    """The number of the nearest centre, the smallest of equally near ones."""
    lists = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centres])
    d = F.transform(lists, lambda c: F.aggregate(F.zip_with(vector, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    return F.array_position(d, F.array_min(d)).cast("int") - 1
