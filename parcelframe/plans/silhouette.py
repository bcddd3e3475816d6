"""The exact mean silhouette (Euclidean) of a clustering.

Equal vectors of a cluster are counted once. The different ones are dealt by hash
into tiles of about ``TILE`` rows, each tile one row of a written table. A task
takes two tiles and adds up, for every row of either, the distances to the other's
rows by cluster; it emits one line a row, never a pair. Spark sums those lines over
the tiles, and each row's value follows from its k sums. Memory is two tiles a task;
the work is quadratic in the number of *different* rows, as the index itself is, so
it suits feature tables (offices, regions, days), not a row a parcel.

NULL below two clusters, and where every row is a cluster of its own; a row alone in
its cluster counts 0; rows without a cluster or vector take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship
from .restarts import squared

TILE = 2048
#: Rows of a tile whose distances are held at a time.
STEP = 256


def _tile(rows: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(clusters, counts, vectors) of a tile."""
    v = rows.values
    n = len(v)
    return (v.field("c").to_numpy(zero_copy_only=False), v.field("n").to_numpy(zero_copy_only=False),
            np.array(v.field("v").flatten().to_numpy(zero_copy_only=False)).reshape(n, -1))


def _sums(x: np.ndarray, y: np.ndarray, own: np.ndarray) -> np.ndarray:
    """rows of x by clusters: the distances to the rows of y, added up by ``own`` (rows of y by clusters)."""
    return np.concatenate([np.sqrt(squared(x[a:a + STEP], y)) @ own for a in range(0, len(x), STEP)])


def silhouette(assigned: DataFrame, vector: Column | None = None, tile: int = TILE) -> float | None:
    """Mean silhouette of the rows of ``assigned`` by their ``cluster``; ``vector`` is an
    array<double> (by default the ML vector column ``features``)."""
    from pyspark.ml.functions import vector_to_array

    ship(assigned.sparkSession)
    v = vector_to_array("features") if vector is None else vector
    rows = assigned.select(F.col("cluster").cast("long").alias("c"), v.alias("v")).where("c IS NOT NULL AND v IS NOT NULL")
    rows = materialize(rows.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")))
    size = {r.c: (r.n, r.m) for r in rows.groupBy("c").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m")).collect()}  # k rows
    total, different = sum(n for n, _ in size.values()), sum(m for _, m in size.values())
    if not 2 <= len(size) < total:
        return None
    ids = {c: k for k, c in enumerate(sorted(size))}
    k, tiles = len(ids), -(-different // tile)

    place = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])  # k entries
    packed = materialize(rows.groupBy(F.pmod(F.xxhash64("c", "v"), F.lit(tiles)).cast("int").alias("i")).agg(
        F.sort_array(F.collect_list(F.struct(place[F.col("c")].alias("c"), "v", "n"))).alias("left")))
    pairs = packed.withColumn("j", F.explode(F.sequence("i", F.lit(tiles - 1)))).join(
        packed.select(F.col("i").alias("j"), F.col("left").alias("right")), "j")
    names = [f"s{c}" for c in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                i, j = b.column("i")[at].as_py(), b.column("j")[at].as_py()
                both = [_tile(b.column("left")[at]), _tile(b.column("right")[at])]
                own = [np.eye(k)[c] * n[:, None] for c, n, _ in both]
                for t, me, it in ((i, 0, 1), (j, 1, 0))[:1 if i == j else 2]:
                    s = _sums(both[me][2], both[it][2], own[it])
                    m = len(s)
                    yield pa.record_batch([pa.array(np.full(m, t), pa.int32()), pa.array(np.arange(m), pa.int32()), pa.array(both[me][0], pa.int32()),
                                           pa.array(both[me][1], pa.int64()), *[pa.array(s[:, c], pa.float64()) for c in range(k)]],
                                          ["tile", "pos", "c", "n", *names])

    sums = pairs.select("i", "j", "left", "right").mapInArrow(run, "tile int, pos int, c int, n long, " + ", ".join(f"{n} double" for n in names))
    rows = sums.groupBy("tile", "pos", "c", "n").agg(*[F.sum(s).alias(s) for s in names])
    sizes = [size[c][0] for c in sorted(size)]
    mine = reduce(lambda rest, p: F.when(F.col("c") == p, F.col(names[p]) / max(sizes[p] - 1, 1)).otherwise(rest), range(k), F.lit(None).cast("double"))
    single = F.col("c").isin([p for p in range(k) if sizes[p] == 1])
    other = F.least(*[F.when(F.col("c") != p, F.col(names[p]) / sizes[p]) for p in range(k)])
    top = F.greatest("a", "b")
    value = rows.select("n", "c", mine.alias("a"), other.alias("b")).select(
        "n", F.when(single | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / top).alias("s"))
    return value.agg(F.sum(F.col("n") * F.col("s")) / F.sum("n")).first()[0]
