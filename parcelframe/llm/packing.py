"""Mixture-controlled packing: source queues feed windows in target proportions.

Every source is a queue of tokens (its documents in stored order, each ended by
id 0). A window takes from every queue its share; what a share's fraction
leaves over is the queue's deficit, which later windows repay (largest deficit
first). So after any number of windows each queue has given its exact share to
within one token, and every window holds the target mixture.

The deficits after w windows follow from w alone: the tokens a queue has given
are floor(w * share), plus one for the queues with the largest fractions. A
task therefore places any stretch of any queue without replaying the windows
before it: deficits cross partitions as a number, not as a scan. Steps:

1. encode: ids of all texts, written as 16-bit values with each document's
   position within its task's part of the queue (one pass, no shuffle);
2. totals of (part, queue), prefix sums over parts, and from the queue totals
   the plan: phases of constant shares until a queue runs dry (a handful of
   numbers: at most 1024 queues, see ``queues_of``);
3. place: cut documents where their queue changes window, with crc32s.

Skew: a hot source is many parts of one queue, handled by as many tasks.

Defined results: null and empty texts are the single id 0; a null source is a
queue of its own; sources smaller than one token in a window share a queue;
repeated rows are packed each; an empty table gives no pieces. Only the last
window may fall short of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as W

from . import bpe
from .common import stored

LENGTH = 1024
_DENOMINATOR = 1 << 26
OUTPUT = ("doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


@dataclass
class Phase:
    """``windows`` windows of constant shares. weight: of each queue, summing to
    ``_DENOMINATOR``; with ``exact`` set, one window of just these numbers of tokens."""

    first: int
    windows: int
    taken: np.ndarray   # tokens each queue has given before
    weight: np.ndarray
    exact: np.ndarray | None = None

    def given(self, w: np.ndarray, length: int) -> np.ndarray:
        """(windows x queues) tokens given after w windows of this phase."""
        w = np.asarray(w, np.int64)[:, None]
        if self.exact is not None:
            return self.taken + w * self.exact
        whole, part = np.divmod(length * self.weight, _DENOMINATOR)
        more, owed = np.divmod(w * part, _DENOMINATOR)
        given = w * whole + more
        # the deficits: the largest are paid first, ties by queue
        short = w[:, 0] * length - given.sum(1)
        rank = np.argsort(np.argsort(-owed, axis=1, kind="stable"), axis=1, kind="stable")
        return self.taken + given + (rank < short[:, None])


def _weights(share: np.ndarray) -> np.ndarray:
    """Integers in proportion to ``share``, summing to the denominator."""
    w = np.floor(share / share.sum() * _DENOMINATOR).astype(np.int64)
    w[np.argmax(w)] += _DENOMINATOR - w.sum()
    return w


def plan_windows(totals: np.ndarray, targets: np.ndarray, length: int = LENGTH) -> list[Phase]:
    """Phases that empty all queues: shares follow ``targets`` over the queues that still hold
    tokens; when one is short of its share, one window takes its rest and goes on without it."""
    left, taken, first, phases = totals.astype(np.int64).copy(), np.zeros(len(totals), np.int64), 0, []
    while left.sum() >= length:
        live = left > 0
        weight = np.zeros(len(left), np.int64)
        weight[live] = _weights(np.where(targets[live] > 0, targets[live], targets[targets > 0].min() if (targets > 0).any() else 1))
        most = -(-length * weight // _DENOMINATOR)  # a window's share, rounded up
        ok = live & (weight > 0)
        n = int(((left[ok] - 1) * _DENOMINATOR // np.maximum(length * weight[ok], 1)).min()) if ok.any() else 0
        if n > 0 and (length * weight[ok] >= _DENOMINATOR).all():
            phase = Phase(first, n, taken.copy(), weight)
            gone = phase.given(np.array([n]), length)[0] - taken
        else:  # one window: each queue's share or its rest, the others filling up in proportion
            gone = np.minimum(left, np.maximum(most, 1) * live)
            while gone.sum() < length:
                room = left - gone
                add = np.minimum(room, np.maximum(1, (length - gone.sum()) * room // room.sum()))
                add = np.where(np.cumsum(add) <= length - gone.sum(), add, np.maximum(0, np.minimum(add, length - gone.sum() - (np.cumsum(add) - add))))
                gone = gone + add
            over = gone.sum() - length
            for k in np.argsort(-gone, kind="stable"):
                cut = min(over, max(0, gone[k] - 1))
                gone[k], over = gone[k] - cut, over - cut
            n, phase = 1, Phase(first, 1, taken.copy(), weight, gone.copy())
        phases.append(phase)
        taken, left, first = taken + gone, left - gone, first + n
    if left.sum():
        phases.append(Phase(first, 1, taken.copy(), np.zeros(len(left), np.int64), left.copy()))
    return phases


def queues_of(totals: list[tuple[str | None, int]], length: int = LENGTH) -> dict[str | None, int]:
    """Queue number of each source: its own if it fills a token of every window, else the shared last
    one (or the smallest own one, if the shared one would be too small). At most ``length`` queues."""
    order = sorted(totals, key=lambda x: (-x[1], x[0] is not None, x[0] or ""))
    every = sum(n for _, n in order)
    own = [s for s, n in order if n * length >= every] or [s for s, _ in order[:1]]
    rest = [(s, n) for s, n in order if s not in set(own)]
    number = {s: k for k, s in enumerate(own)}
    shared = len(own) if sum(n for _, n in rest) * length >= every else len(own) - 1
    return number | {s: shared for s, _ in rest}


def encode(docs: DataFrame, name: str) -> DataFrame:
    """One row for each document: part (of one task), position of its first token among the part's
    tokens of its source, and its ids as 16-bit values (32-bit for larger vocabularies) ended by 0."""
    schema = W.StructType([W.StructField("doc_id", W.LongType()), W.StructField("source", W.StringType()),
                           W.StructField("part", W.IntegerType()), W.StructField("at", W.LongType()),
                           W.StructField("n", W.LongType()), W.StructField("wide", W.BooleanType()),
                           W.StructField("ids", W.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e, part, count = bpe.encoder(bpe.vocabulary(name)), TaskContext.get().partitionId(), {}
        for b in batches:
            at, n, wide, blobs = [], [], [], []
            sources = b.column("source").to_pylist()
            for s, ids in zip(sources, e.ids(b.column("text").to_pylist())):
                big = bool(len(ids)) and int(ids.max()) >= 1 << 16
                blobs.append(ids.astype("<u4" if big else "<u2").tobytes() + bytes(4 if big else 2))
                wide.append(big)
                at.append(count.get(s, 0))
                n.append(len(ids) + 1)
                count[s] = at[-1] + n[-1]
            yield pa.record_batch([b.column("doc_id"), b.column("source"), pa.array([part] * b.num_rows, pa.int32()),
                                   pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(wide, pa.bool_()),
                                   pa.array(blobs, pa.binary())], schema.names)

    return docs.select("doc_id", F.col("source").cast("string").alias("source"), "text").mapInArrow(run, schema)


def _place(queue: np.ndarray, begin: np.ndarray, n: np.ndarray, phases: list[Phase], length: int,
           ) -> tuple[np.ndarray, ...]:
    """Pieces of documents at [begin, begin + n) of their queues: (document, start, length, window, offset)."""
    out = []
    for p in phases:
        last = p.given(np.array([p.windows]), length)[0]
        lo, hi = np.maximum(begin, p.taken[queue]), np.minimum(begin + n, last[queue])
        live = np.flatnonzero(lo < hi)
        if not len(live):
            continue
        if p.exact is None:  # the windows' numbers, from the shares, widened by one at either side
            share = length * p.weight / _DENOMINATOR
            w0 = np.maximum(0, ((lo - p.taken[queue])[live] / share[queue[live]]).astype(np.int64) - 2)
            w1 = np.minimum(p.windows, ((hi - p.taken[queue])[live] / share[queue[live]]).astype(np.int64) + 3)
        else:
            w0, w1 = np.zeros(len(live), np.int64), np.ones(len(live), np.int64)
        for chunk in np.array_split(np.argsort(w0, kind="stable"), max(1, int((w1 - w0).sum()) // 200_000)):
            if not len(chunk):
                continue
            d, a, b = live[chunk], w0[chunk], w1[chunk]
            per = b - a
            doc = np.repeat(d, per)
            w = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(a, per)
            used, inv = np.unique(np.concatenate([w, w + 1]), return_inverse=True)
            table = np.empty((len(used), len(p.taken)), np.int64)
            for k in range(0, len(used), 65_536):
                table[k:k + 65_536] = p.given(used[k:k + 65_536], length)
            left, right = inv[:len(w)], inv[len(w):]
            q = queue[doc]
            s, e = np.maximum(begin[doc], table[left, q]), np.minimum((begin + n)[doc], table[right, q])
            some = s < e
            share_before = np.cumsum(table, axis=1) - table  # tokens that earlier queues have given
            offset = share_before[right, q] - share_before[left, q] + s - table[left, q]
            out.append((doc[some], (s - begin[doc])[some], (e - s)[some], (w + p.first)[some], offset[some]))
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(5))


def pack(docs: DataFrame, name: str = "byte_bpe_50k.json", length: int = LENGTH,
         targets: dict[str | None, float] | None = None) -> DataFrame:
    """Pieces of all documents. ``targets``: wanted share of tokens by source; by default each
    source's share of the corpus, with which all queues run dry together."""
    tokens = stored(encode(docs, name), "tokens")
    parts = stored(tokens.groupBy("part", "source").agg(F.sum("n").alias("n")), "parts")
    totals = [(r.source, r.n) for r in parts.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "source").collect()]
    number = queues_of(totals, length)
    size = np.zeros(max(number.values(), default=-1) + 1, np.int64)
    share = np.zeros(len(size))
    for s, n in totals:
        size[number[s]] += n
        share[number[s]] += (targets or {}).get(s, 0) if targets is not None else n
    phases = plan_windows(size, share, length)
    spark = docs.sparkSession
    plan = spark.sparkContext.broadcast(phases)  # at most 1024 queues, and a few phases for each
    # a source's documents follow each other by part; sources that share a queue follow each other by name
    shift, base = {}, np.zeros(len(size), np.int64)
    for s, n in totals:
        shift[s], base[number[s]] = int(base[number[s]]), base[number[s]] + n
    known = spark.createDataFrame([(s, number[s], shift[s]) for s, _ in totals], "source string, queue int, shift long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # written, so that its size is known: Spark broadcasts it where it is small and shuffles by (part, source) where it isn't
    starts = stored(parts.select("part", "source", before.alias("before"))
                    .join(known.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
                    .select(F.col("part").alias("p"), F.col("source").alias("s"), "queue", (F.col("before") + F.col("shift")).alias("first")), "starts")
    placed = (tokens.join(starts, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
              .select("doc_id", "source", "queue", (F.col("first") + F.col("at")).alias("begin"), "n", "wide", "ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for row in range(0, whole.num_rows, 512):
                b = whole.slice(row, 512)
                n = b.column("n").to_numpy()
                doc, start, size_, window, offset = _place(b.column("queue").to_numpy(), b.column("begin").to_numpy(), n, plan.value, length)
                order = np.lexsort((start, doc))
                doc, start, size_, window, offset = doc[order], start[order], size_[order], window[order], offset[order]
                edge = np.searchsorted(doc, np.arange(b.num_rows + 1))
                crc = np.empty(len(doc), np.int64)
                for i in range(b.num_rows):
                    ids = np.frombuffer(b.column("ids")[i].as_buffer(), "<u4" if b.column("wide")[i].as_py() else "<u2").astype("<u4")
                    view = memoryview(ids).cast("B")
                    for k in range(edge[i], edge[i + 1]):
                        crc[k] = zlib.crc32(view[4 * start[k]:4 * (start[k] + size_[k])])
                take = pa.array(doc, pa.int64())
                yield pa.record_batch([b.column("doc_id").take(take), b.column("source").take(take), pa.array(start, pa.int64()),
                                       pa.array(size_, pa.int64()), pa.array(crc, pa.int64()), pa.array(n[doc], pa.int64()),
                                       pa.array(window, pa.int64()), pa.array(offset, pa.int64())],
                                      ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return placed.mapInArrow(run, OUTPUT)
