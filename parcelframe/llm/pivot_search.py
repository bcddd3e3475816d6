"""Exact top-k inner products by a pivot table.

Vectors are integers (floor of 1024 times each component). As |q - x|^2 =
|q|^2 + |x|^2 - 2 q.x, an upper bound on the inner product is a lower bound on
the distance, and every pivot p gives one: |d(q, p) - d(x, p)|. The index keeps,
for every row, its distances to ``PIVOTS`` pivots. A query reads the table,
takes the largest lower bound of each candidate, evaluates candidates in the
order of their bounds and stops where the next bound can't reach the k-th best
score found: exactly, with slack for rounding, so ties are never lost.

The pivots come from a bounded sample by farthest-first choice; every row is
indexed. Queries go in blocks of ``BLOCK`` vectors, broadcast to the index's
partitions; each partition returns its own top k for a query, and a second
stage ranks those. A block's result is written before the next begins, so the
driver holds one block whatever their number. No task holds more than a batch
of candidates.

Components of any finite size take part: scores are computed in doubles where
those are exact, in 64-bit integers where they fit, and in Python's integers
beyond. Scores that no long can hold are ranked like all others; only if one of
them is among a query's results, the query fails with an error that says so.

Defined results: vectors that are null, empty or hold null or non-finite components
take no part, nor does a null vec_id; vectors of another length than a
query's are no candidates for it; a row never meets rows of its own vec_id; a
repeated query id is answered once for each different vector, repeated
candidates each count; ties go to the smaller vec_id; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path, stored

PIVOTS, SAMPLE, BLOCK, STEP = 32, 2048, 4096, 4096
#: Integers up to here are small: products of two of them fit 64 bits in vectors of up to 512 components.
SMALL = 2.0 ** 26
INDEX = "vec_id long, v array<double>, norm double, d array<double>"
RESULT = "query_no int, vec_id long, over int, score long, wide binary"
ANSWER = "query_id long, rank int, vec_id long, score long"


def finite_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the rows that take part, with their components as doubles."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return (vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine & (F.size("embedding") > 0))
            .select("vec_id", F.transform("embedding", lambda c: c.cast("double")).alias("v")))


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x) as doubles: each is that integer exactly, or infinite where no double can hold it."""
    with np.errstate(over="ignore"):
        return np.floor(x * 1024)


def integers(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x) as Python's integers, of any size."""
    out = [int(c) * 1024 if abs(c) >= 2.0 ** 53 else int(np.floor(c * 1024)) for c in x.ravel().tolist()]
    return np.array(out, dtype=object).reshape(x.shape)


def sort_key(n: int) -> bytes:
    """Bytes that compare as the integers do."""
    size = (n.bit_length() + 7) // 8
    head = (1 << 31) + (size if n >= 0 else -size)
    return head.to_bytes(4, "big") + (n if n >= 0 else (1 << 8 * size) + n).to_bytes(size, "big")


def pivots_of(vectors: DataFrame, count: int = PIVOTS) -> dict[int, np.ndarray]:
    """Pivots by vector length: farthest-first in a sample of at most ``SAMPLE`` rows."""
    sample = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).collect()
    by: dict[int, list] = {}
    for r in sample:
        by.setdefault(len(r.v), []).append(r.v)
    out = {}
    for n, rows in by.items():
        x = quantised(np.array(rows, float))
        with np.errstate(over="ignore", invalid="ignore"):
            away = lambda p: np.nan_to_num(((x - p) ** 2).sum(1))  # noqa: B023, E731
            far, chosen = away(x.mean(0)), []
            for _ in range(min(count, len(x))):
                k = int(far.argmax())
                chosen.append(x[k])
                far = away(x[k]) if len(chosen) == 1 else np.minimum(far, away(x[k]))
        out[n] = np.array(chosen)
    return out


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(p)))
    with np.errstate(over="ignore", invalid="ignore"):
        for k, row in enumerate(p):
            y = x - row
            out[:, k] = np.sqrt(np.einsum("ij,ij->i", y, y))
    return out


def _norms(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.einsum("ij,ij->i", x, x)


def build_index(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """The pivot table: vector, squared length and distances to all pivots of every row."""
    held = vectors.sparkSession.sparkContext.broadcast(pivots)  # at most PIVOTS vectors of each length in the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            size = np.diff(v.offsets.to_numpy()) if len(v) else np.zeros(0, int)
            norm, d = np.zeros(len(v)), [[] for _ in range(len(v))]
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                x = quantised(v.take(pa.array(at)).flatten().to_numpy().reshape(len(at), n))
                norm[at] = _norms(x)
                table = _distances(x, held.value[n]) if n in held.value else np.zeros((len(at), 0))
                for k, i in enumerate(at):
                    d[i] = table[k]
            yield pa.record_batch([b.column("vec_id"), v, pa.array(norm), pa.array(d, pa.list_(pa.float64()))], ["vec_id", "v", "norm", "d"])

    return vectors.mapInArrow(run, INDEX)


class _Best:
    """The k best (score, vec_id) of one query so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def worst(self) -> float:
        if len(self.scores) < self.k:
            return -np.inf
        try:
            return float(self.scores[-1])
        except OverflowError:
            return np.inf if self.scores[-1] > 0 else -np.inf

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        if scores.dtype == object:
            keep = np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:self.k], np.int64)
        else:
            keep = np.lexsort((ids, -scores))[:self.k]
        self.ids, self.scores = ids[keep], scores[keep]

    def rows(self, no: int) -> list[tuple]:
        """(query_no, vec_id, over, score, wide): a score beyond a long has its sign in ``over`` and its sort key in ``wide``."""
        out = []
        for i, n in zip(self.ids.tolist(), map(int, self.scores)):
            over = (n >= 1 << 63) - (n < -(1 << 63))
            out.append((no, i, over, None if over else n, sort_key(n) if over else None))
        return out


def _scores(x: np.ndarray, fx: np.ndarray, q: np.ndarray, fq: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of rows with one query; ``most`` bounds their size."""
    if most < 2.0 ** 52:
        return (fx @ fq).astype(np.int64)
    if most < 2.0 ** 62:
        return fx.astype(np.int64) @ fq.astype(np.int64)
    return (integers(x) * integers(q)[None]).sum(1)


def search(index: DataFrame, queries: list[tuple[int, list[float]]], pivots: dict[int, np.ndarray], k: int) -> DataFrame:
    """(query_no, vec_id, over, score, wide): each partition's top ``k`` for each query of one block."""
    sc = index.sparkSession.sparkContext
    held, table = sc.broadcast(queries), sc.broadcast(pivots)  # at most BLOCK vectors
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[int]] = {}
        for no, (_, v) in enumerate(held.value):
            by.setdefault(len(v), []).append(no)
        groups = {}
        for n, nos in by.items():
            q = np.array([held.value[no][1] for no in nos], float)
            fq = quantised(q)
            groups[n] = (nos, q, fq, np.abs(fq).max(1), _norms(fq), _distances(fq, table.value[n]) if n in table.value else np.zeros((len(nos), 0)))
        best = [_Best(k) for _ in held.value]

        def meet(n: int, ids: np.ndarray, x: np.ndarray, fx: np.ndarray, norm: np.ndarray, d: np.ndarray) -> None:
            nos, q, fq, q_top, q_norm, q_d = groups[n]
            top = float(np.abs(fx).max(initial=0))
            for r, no in enumerate(nos):
                with np.errstate(over="ignore", invalid="ignore"):
                    low = np.abs(d - q_d[r]).max(1) if d.shape[1] else np.zeros(len(ids))
                    low = np.maximum(low * (1 - 1e-9) - 1e-3, 0)
                    bound = (q_norm[r] + norm - low * low) / 2
                    bound += 1e-9 * (q_norm[r] + norm) + 1
                    most = top * q_top[r] * n if top and q_top[r] else 0.0
                bound[~np.isfinite(bound)] = np.inf  # too large for doubles: always evaluated
                bound[ids == held.value[no][0]] = -np.inf
                kept = best[no]
                live = np.flatnonzero(bound >= kept.worst()) if kept.worst() > -np.inf else np.flatnonzero(bound > -np.inf)
                order, done, width = live[np.argsort(-bound[live], kind="stable")], 0, max(2 * k, 32)
                while done < len(order) and bound[order[done]] >= kept.worst():
                    some = order[done:done + width]
                    kept.add(ids[some], _scores(x[some], fx[some], q[r], fq[r], most))
                    done, width = done + len(some), 2 * width

        for b in batches:
            size = np.diff(b.column("v").offsets.to_numpy()) if b.num_rows else np.zeros(0, int)
            for n in groups:
                rows = np.flatnonzero(size == n)
                for at in range(0, len(rows), STEP):
                    own = pa.array(rows[at:at + STEP])
                    ids = b.column("vec_id").take(own).to_numpy()
                    x = b.column("v").take(own).flatten().to_numpy().reshape(len(ids), n)
                    norm = b.column("norm").take(own).to_numpy()
                    d = b.column("d").take(own).flatten().to_numpy().reshape(len(ids), -1)
                    fx = quantised(x)
                    small = np.abs(fx).max(1) <= SMALL  # large vectors apart, so that they don't slow the others
                    for part in (small, ~small):
                        if part.any():
                            meet(n, ids[part], x[part], fx[part], norm[part], d[part])
        out = [row for no, found in enumerate(best) for row in found.rows(no)]
        yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["query_no", "vec_id", "over", "score", "wide"])

    return index.mapInArrow(run, RESULT)


def top_k(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest scores among all other rows."""
    spark = vectors.sparkSession
    whole = finite_vectors(vectors)
    pivots = pivots_of(whole)
    index = stored(build_index(whole, pivots), "pivot-index")
    asked = stored(index.where(F.col("vec_id") % every == 0).select("vec_id", "v").distinct(), "queries")
    n = asked.count()
    blocks = max(1, -(-n // BLOCK))
    placed = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)))
    path = scratch_path(spark, "answers")
    order = Window.partitionBy("query_no").orderBy(F.desc("over"), F.desc("score"), F.desc("wide"), "vec_id")
    fits = F.when(F.col("over") == 0, F.col("score")).otherwise(F.raise_error(F.lit("a score among the results doesn't fit a long")).cast("long"))
    for block in range(blocks):  # one block on the driver at a time; its answers are written before the next
        rows = sorted((r.vec_id, r.v) for r in placed.where(F.col("block") == block).select("vec_id", "v").collect())
        names = spark.createDataFrame([(no, i) for no, (i, _) in enumerate(rows)], "query_no int, query_id long")
        found = search(index, rows, pivots, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        answer = found.join(F.broadcast(names), "query_no").select("query_id", "rank", "vec_id", fits.alias("score"))
        answer.write.mode("append").parquet(path)
    return spark.read.schema(ANSWER).parquet(path)


ORACLE = """
WITH vecs AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
              WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (SELECT q.vec_id AS query_id, x.vec_id AS vec_id,
           CAST(list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * x.v[i])) AS BIGINT) AS score
           FROM vecs q JOIN vecs x ON q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id AND len(q.v) = len(x.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
"""
