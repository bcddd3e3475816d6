"""Quality scores from attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` words. Each passage is described by
shares of byte kinds, word lengths and repetition, then encoded by a tanh
layer. Gated attention (a tanh and a sigmoid branch, multiplied) weighs the
passages; the logistic layer reads the weighted sum. Only documents have
labels: the attention learns from those which passages count. Training is
numpy on a bounded sample; scoring runs in Arrow batches over whole texts.

Defined results: a null or empty text is a bag of one passage without words;
without a labelled row of both classes every score is 1.0 (nothing tells a
document from a good one). A text beyond a megabyte is read in pieces that end
between passages and depend on that text alone; its repetition is counted by piece.
Repeated rows are scored each, ties need no order; an empty table gives no row;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as T
from .common import fold, labelled_sample, within

MODULUS, HELD = 3, 1
PASSAGE = 80  # words

#: Kinds of bytes: letter, digit, white space, sentence marks, brackets and
#: quotes, bars and rules, other symbols, non-ASCII.
_KIND = np.full(256, 6, np.uint8)
_KIND[0x61:0x7B] = 0
_KIND[0x30:0x3A] = 1
_KIND[[0x20, *range(0x09, 0x0E)]] = 2
_KIND[[ord(c) for c in ".,;:?-"]] = 3
_KIND[[ord(c) for c in "()[]{}\"'"]] = 4
_KIND[[ord(c) for c in "|_=~<>/\\"]] = 5
_KIND[0x80:] = 7
_KIND[ord("!")] = 8
KINDS = 10  # 9: upper-case letter, counted from the original bytes
FEATURES = KINDS + 7


def passages(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each slice: (passages x FEATURES, text of each passage). Every text gives a passage at least."""
    for original, data, cuts, doc in T.text_slices(texts, T.NONSPACE, PASSAGE):
        starts, ends, count = T.words(data, cuts, T.NONSPACE)
        n = np.maximum(1, -(-count // PASSAGE))
        piece_of = np.repeat(np.arange(len(doc)), n)
        first_passage = np.concatenate([[0], np.cumsum(n)])
        rank = np.arange(len(starts)) - np.repeat(np.cumsum(count) - count, count)
        passage_of_word = np.repeat(first_passage[:-1], count) + rank // PASSAGE
        total = int(n.sum())
        # a passage runs to the next one's first word; a piece's first passage begins with the piece
        edge = cuts[piece_of].copy()
        heads = np.flatnonzero(rank % PASSAGE == 0)
        later = heads[rank[heads] > 0]
        edge[passage_of_word[later]] = starts[later]
        size = np.diff(np.append(edge, len(data)))
        kind = _KIND[data]
        kind[(original != data)] = 9
        by = np.bincount(np.repeat(np.arange(total), size) * KINDS + kind, minlength=total * KINDS).reshape(total, KINDS)
        words = np.bincount(passage_of_word, minlength=total)
        x = np.zeros((total, FEATURES), np.float32)
        x[:, :KINDS] = by / np.maximum(size, 1)[:, None]
        some = np.maximum(words, 1)
        length = ends - starts
        x[:, KINDS] = np.bincount(passage_of_word, length, total) / some / 10
        x[:, KINDS + 1] = np.minimum(words, PASSAGE) / PASSAGE
        h = T.hashes(data, starts, ends)[0] if len(starts) else np.zeros(0, np.uint64)
        same = np.zeros(len(h), bool)
        if len(h) > 1:
            same[1:] = (h[1:] == h[:-1]) & (rank[1:] > 0)
        x[:, KINDS + 2] = np.bincount(passage_of_word, same, total) / some
        for k, (group, span) in enumerate(((passage_of_word, 1), (np.repeat(np.arange(len(doc)), count), 3))):
            x[:, KINDS + 3 + k] = np.bincount(passage_of_word, _repeated(h, group, span), total) / some
        marked = _KIND[data[ends - 1]] if len(ends) else np.zeros(0, np.uint8)
        x[:, KINDS + 5] = np.bincount(passage_of_word, marked >= 4, total) / some
        x[:, KINDS + 6] = np.bincount(passage_of_word, length == 1, total) / some
        yield x, doc[piece_of]


def _repeated(h: np.ndarray, group: np.ndarray, span: int) -> np.ndarray:
    """Whether each word begins a ``span`` of words that came before in its group."""
    out = np.zeros(len(h), bool)
    if len(h) < span + 1:
        return out
    key = h[:len(h) - span + 1].copy()
    for k in range(1, span):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - span + 1 + k]
    whole = group[:len(key)] == group[span - 1:]
    key = T.mix(key + group[:len(key)].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    out[:len(key)] = again & whole
    return out


@dataclass
class Shape:
    """Sizes of the network and bounds of its training."""

    hidden: int = 16
    gate: int = 8
    per_class: int = 2000      # labelled rows of each class, at most
    row_bytes: int = 1 << 22    # of one training text: longer ones aren't trained on
    class_bytes: int = 1 << 24  # of all training texts of a class: rows beyond aren't trained on
    epochs: int = 25
    batch: int = 64
    rate: float = 0.01
    seed: int = 11


@dataclass
class Attention:
    centre: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bag: np.ndarray, bags: int) -> tuple[np.ndarray, ...]:
        """Logit of each bag; bag: bag of each passage, in order. Softmax by bag."""
        p = self.p
        h = np.tanh(((x - self.centre) / self.scale) @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        e = np.exp(np.clip((t * g) @ p["w"], -20, 20))  # bounded, so sums over any number of passages are exact enough
        total = np.bincount(bag, e, bags)
        a = e / total[bag]
        z = np.stack([np.bincount(bag, a * h[:, k], bags) for k in range(h.shape[1])], 1)
        return z @ p["c"] + p["d"][0], h, t, g, a, z

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Score of each whole text; sums of the weighted representation run over its slices."""
        p, n = self.p, len(texts)
        top, total = np.zeros((n, len(p["c"]))), np.zeros(n)
        for x, doc in passages(texts):
            h = np.tanh(((x - self.centre) / self.scale) @ p["W"] + p["b"])
            e = np.exp(np.clip((np.tanh(h @ p["V"]) / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))) @ p["w"], -20, 20))
            total += np.bincount(doc, e, n)
            for k in range(h.shape[1]):
                top[:, k] += np.bincount(doc, e * h[:, k], n)
        logit = (top / np.maximum(total, 1e-300)[:, None]) @ p["c"] + p["d"][0]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def train(rows: list[tuple[np.ndarray, int]], shape: Shape) -> Attention | None:
    """Fit on (passages x FEATURES, label) bags; None unless both labels occur."""
    y = np.array([r[1] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(shape.seed)
    every = np.concatenate([r[0] for r in rows])
    centre, scale = every.mean(0), every.std(0) + 1e-2
    n, hid, gate = FEATURES, shape.hidden, shape.gate
    p = {"W": rng.normal(0, n ** -0.5, (n, hid)), "b": np.zeros(hid), "V": rng.normal(0, hid ** -0.5, (hid, gate)),
         "U": rng.normal(0, hid ** -0.5, (hid, gate)), "w": rng.normal(0, 0.1, gate), "c": rng.normal(0, 0.1, hid), "d": np.zeros(1)}
    net = Attention(centre, scale, p)
    m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    step = 0
    for epoch in range(shape.epochs):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // shape.batch)):
            step += 1
            x = np.concatenate([rows[i][0] for i in part])
            bag = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            s, h, t, g, a, z = net.forward(x, bag, len(part))
            ds = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y[part]) * weight[part] / len(part)
            d = {"c": z.T @ ds, "d": np.array([ds.sum()])}
            dz = np.outer(ds, p["c"])[bag]
            da = (dz * h).sum(1)
            de = a * (da - np.bincount(bag, a * da, len(part))[bag])
            dh = a[:, None] * dz
            d["w"] = (t * g).T @ de
            dt, dg = np.outer(de, p["w"]) * g * (1 - t * t), np.outer(de, p["w"]) * t * g * (1 - g)
            d["V"], d["U"] = h.T @ dt, h.T @ dg
            dh += dt @ p["V"].T + dg @ p["U"].T
            du = dh * (1 - h * h)
            d["W"], d["b"] = ((x - centre) / scale).T @ du, du.sum(0)
            for k, v in d.items():
                v = v + 1e-4 * p[k]
                m[k][0] = 0.9 * m[k][0] + 0.1 * v
                m[k][1] = 0.99 * m[k][1] + 0.01 * v * v
                p[k] -= shape.rate * (m[k][0] / (1 - 0.9 ** step)) / (np.sqrt(m[k][1] / (1 - 0.99 ** step)) + 1e-8)
    return net


def fit_quality(docs: DataFrame, labels: DataFrame, shape: Shape = Shape()) -> Attention | None:
    """Train on at most ``2 * shape.per_class`` labelled rows outside the held-out
    fold, all passages of each. Rows, never passages, are left out beyond ``shape.class_bytes``
    of text a class: what reaches the driver is bounded."""
    sample = labelled_sample(docs, labels, "quality", MODULUS, HELD, shape.per_class, shape.row_bytes)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts: list[list[np.ndarray]] = [[] for _ in range(b.num_rows)]
            for x, doc in passages(b.column("text")):
                for d in np.unique(doc):
                    parts[d].append(x[doc == d])
            blobs = [np.concatenate(q).astype("<f4").tobytes() for q in parts]
            yield pa.record_batch([b.column("doc_id"), b.column("y"), pc.fill_null(pc.binary_length(b.column("text")), 0).cast(pa.int64()),
                                   pa.array(blobs, pa.binary())], ["doc_id", "y", "size", "x"])

    got = sample.mapInArrow(bags, "doc_id long, y int, size long, x binary")
    once = got.groupBy("doc_id").agg(F.min(F.struct("y", "size", "x")).alias("r")).select("doc_id", "r.*")
    rows = within(once, shape.class_bytes).select("doc_id", "y", "x").orderBy("doc_id").collect()
    return train([(np.frombuffer(r.x, "<f4").reshape(-1, FEATURES).astype(np.float64), r.y) for r in rows], shape)


def score_quality(docs: DataFrame, net: Attention | None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = docs.sparkSession.sparkContext.broadcast(net)  # a few hundred numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.ones(b.num_rows) if model.value is None else model.value.scores(b.column("text"))
            yield pa.record_batch([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), MODULUS) == HELD).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_poor(docs: DataFrame, net: Attention | None) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more, with their columns."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.ones(b.num_rows) if model.value is None else model.value.scores(b.column("text"))
            yield b.filter(pa.array(s >= 0.5))

    return docs.mapInArrow(keep, docs.schema)
