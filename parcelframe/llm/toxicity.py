"""Toxicity scores from a convolutional text classifier.

A word is the sum of hashed embeddings: the whole word and its first 4, 5 and
6 bytes (so compounds of one stem share weights). Filters of several widths run over
the words, each keeps its maximum over the whole text, and a logistic layer
reads the maxima. The network is trained with numpy on a bounded sample of
labelled rows; scoring runs in Arrow batches on the executors, over whole
texts in slices, so memory does not follow the longest text. A slice of a long
text carries the last words of the one before, so no filter misses a phrase.

Thresholds are calibrated for each language, guessed from function words of
the text itself (the ``lang`` column is never read): a score is shifted on the
logit scale so that 0.5 is the best cut for texts of that language.

Defined results: a null or empty text is a text without words and gets the
network's bias as score; without a labelled row of both classes every score is
0.0. A text's score depends on that text alone, however long it is. Repeated
rows are scored each, ties of words or scores need no order; an empty table gives
no row; extra columns are ignored.
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

MODULUS, HELD = 5, 0
PREFIXES = (4, 5, 6)

#: Function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that for with was this from are it be by on as at",
    "de": "der die und das ist von mit zu den ein eine nicht auf für im dem sich auch",
    "fr": "le les des et est pour dans une qui par sur au avec pas du ce elle il",
    "es": "el los las del una para con por su al y lo como más pero sus esta",
}
LANGUAGES = (*FUNCTION_WORDS, "other")


@dataclass
class Shape:
    """Sizes of the network and bounds of its training."""

    buckets: int = 1 << 15
    dim: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 6
    per_class: int = 2000       # labelled rows of each class, at most
    row_bytes: int = 1 << 22    # of one training text: longer ones aren't trained on
    class_bytes: int = 1 << 24  # of all training texts of a class: rows beyond aren't trained on
    chunk: int = 1 << 18        # words whose activations training holds at a time, or one text's
    epochs: int = 3
    batch: int = 32
    rate: float = 0.01
    seed: int = 7


def _language_table() -> tuple[np.ndarray, np.ndarray]:
    pairs = {}
    for k, listed in enumerate(FUNCTION_WORDS.values()):
        for w in listed.split():
            pairs.setdefault(T.word_hash(w), k)
    keys = np.array(sorted(pairs), np.uint64)
    return keys, np.array([pairs[int(x)] for x in keys])


def encode(texts: pa.Array, buckets: int, carried: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """For each slice of texts: bucket ids (words x 4), words per piece, text of each piece,
    function words of each language per piece, and how many of the first words are the last
    ones (``carried`` at most) of the same text's slice before."""
    keys, lang = _language_table()
    last, tail = -1, np.zeros((0, 1 + len(PREFIXES)), np.int32)
    for _, data, cuts, doc in T.text_slices(texts, T.LETTERS):
        starts, ends, count = T.words(data, cuts, T.LETTERS)
        found = T.hashes(data, starts, ends, PREFIXES)
        ids = np.stack([(h % np.uint64(buckets)).astype(np.int32) for h in found], 1)
        at = np.minimum(np.searchsorted(keys, found[0]), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == found[0])
        piece = np.repeat(np.arange(len(doc)), count)
        votes = np.bincount(piece[hit] * len(FUNCTION_WORDS) + lang[at[hit]],
                            minlength=len(doc) * len(FUNCTION_WORDS)).reshape(len(doc), -1)
        again = 0
        if int(doc[0]) == last and len(tail):
            again = len(tail)
            ids = np.concatenate([tail, ids])
            count[0] += again
        last, tail = int(doc[-1]), ids[len(ids) - min(carried, int(count[-1])):]
        yield ids, count, doc, votes, again


@dataclass
class Network:
    shape: Shape
    table: np.ndarray    # buckets x dim
    kernel: np.ndarray   # dim x (sum of widths * filters): for each width, each offset
    bias: np.ndarray     # one for each filter of each width
    out: np.ndarray
    out_bias: float
    cuts: dict[int, float]   # by language: the logit of its threshold

    @property
    def features(self) -> int:
        return len(self.shape.widths) * self.shape.filters

    def activations(self, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """words x features: each filter at each word (-inf where it would leave the piece)."""
        s = self.shape
        x = self.table[ids[:, 0]]
        for k in range(1, ids.shape[1]):
            x = x + self.table[ids[:, k]]
        y = x @ self.kernel
        left = np.repeat(np.cumsum(count), count) - np.arange(len(ids))  # words to the end of the piece
        a = np.empty((len(ids), self.features), np.float32)
        col = 0
        for k, w in enumerate(s.widths):
            part = y[:, col:col + s.filters].copy()
            for o in range(1, w):
                part[:-o] += y[o:, col + o * s.filters:col + (o + 1) * s.filters]
            part += self.bias[k * s.filters:(k + 1) * s.filters]
            part[left < w] = -np.inf
            a[:, k * s.filters:(k + 1) * s.filters] = part
            col += w * s.filters
        return a

    def pooled(self, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """pieces x features: maximum of each filter, 0 at least."""
        out = np.zeros((len(count), self.features), np.float32)
        full = np.flatnonzero(count)
        if len(full):
            first = np.concatenate([[0], np.cumsum(count)])[full]
            out[full] = np.maximum(np.maximum.reduceat(self.activations(ids, count), first, axis=0), 0)
        return out

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(logit, language index) of each whole text."""
        pooled = np.zeros((len(texts), self.features), np.float32)
        votes = np.zeros((len(texts), len(FUNCTION_WORDS)), np.int64)
        for ids, count, doc, v, _ in encode(texts, self.shape.buckets, max(self.shape.widths) - 1):
            np.maximum.at(pooled, doc, self.pooled(ids, count))
            np.add.at(votes, doc, v)
        lang = np.where(votes.max(1) > 0, votes.argmax(1), len(FUNCTION_WORDS)) if len(texts) else np.zeros(0, int)
        return pooled @ self.out + self.out_bias, lang

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, lang = self.logits(texts)
        shift = np.array([self.cuts.get(k, 0.0) for k in range(len(LANGUAGES))])
        return 1 / (1 + np.exp(-np.clip(raw - shift[lang], -30, 30))), lang


def _chunks(count: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of ``most`` words together, or one longer text."""
    at, n = 0, 0
    for i, c in enumerate(count):
        if i > at and n + c > most:
            yield at, i
            at, n = i, 0
        n += int(c)
    if at < len(count):
        yield at, len(count)


def train(rows: list[tuple[np.ndarray, int, int]], shape: Shape) -> Network | None:
    """Fit on (bucket ids of a text, label, language) rows; None unless both labels occur."""
    y = np.array([r[1] for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        return None
    s, rng = shape, np.random.default_rng(shape.seed)
    # one row in five sets thresholds only (every fifth of each class)
    rank = np.empty(len(y), int)
    for c in (0, 1):
        rank[y == c] = np.arange((y == c).sum())
    tune = (rank % 5 == 4)
    if len(set(y[~tune])) < 2 or len(set(y[tune])) < 2:
        tune[:] = False
    fit = np.flatnonzero(~tune)
    # the first embedding component starts at each bucket's smoothed log-odds
    seen = np.zeros((2, s.buckets))
    for i in fit:
        seen[int(y[i])][np.unique(rows[i][0])] += 1
    total = np.array([(y[fit] == c).sum() for c in (0, 1)])[:, None]
    rate = np.log((seen + 3) / (total + 6))
    table = rng.normal(0, 0.02, (s.buckets, s.dim)).astype(np.float32)
    table[:, 0] = np.clip(rate[1] - rate[0] - np.median(rate[1] - rate[0]), -2, 6) / 4
    kernel = rng.normal(0, 0.1, (s.dim, sum(s.widths) * s.filters)).astype(np.float32)
    col = 0
    for w in s.widths:
        for o in range(w):
            kernel[0, col:col + s.filters] += 1 / w
            col += s.filters
    net = Network(s, table, kernel, np.full(len(s.widths) * s.filters, -0.2, np.float32),
                  np.full(len(s.widths) * s.filters, 0.3, np.float32), -1.0, {})
    weight = np.where(y == 1, len(fit) / (2 * (y[fit] == 1).sum()), len(fit) / (2 * (y[fit] == 0).sum()))
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in (("kernel", net.kernel), ("bias", net.bias), ("out", net.out))}
    bias_m = [0.0, 0.0]
    squared = np.full(s.buckets, 1e-3, np.float32)
    step = 0

    def adam(name: str, grad: np.ndarray) -> np.ndarray:
        m = moments[name]
        m[0] = 0.9 * m[0] + 0.1 * grad
        m[1] = 0.99 * m[1] + 0.01 * grad * grad
        return s.rate * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.99 ** step)) + 1e-7)

    for _ in range(s.epochs):
        for part in np.array_split(rng.permutation(fit), max(1, len(fit) // s.batch)):
            step += 1
            count = np.array([len(rows[i][0]) for i in part])
            full = np.flatnonzero(count)
            ids = np.concatenate([rows[i][0] for i in part]) if len(full) else np.zeros((0, 1 + len(PREFIXES)), np.int32)
            pooled, first = np.zeros((len(part), net.features), np.float32), np.concatenate([[0], np.cumsum(count)])
            where = np.zeros((len(part), net.features), int)
            for lo, hi in _chunks(count, s.chunk):
                a = net.activations(ids[first[lo]:first[hi]], count[lo:hi])
                for d in full[(full >= lo) & (full < hi)]:
                    own = a[first[d] - first[lo]:first[d + 1] - first[lo]]
                    k = own.argmax(0)
                    where[d], pooled[d] = first[d] + k, np.maximum(own[k, np.arange(net.features)], 0)
            p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.out_bias, -30, 30)))
            g = ((p - y[part]) * weight[part] / len(part)).astype(np.float32)
            g_pool = np.outer(g, net.out) * (pooled > 0)
            g_out, g_bias = pooled.T @ g, float(g.sum())
            g_kernel = np.zeros_like(net.kernel)
            touched: list[np.ndarray] = []
            pulls: list[np.ndarray] = []
            col = 0
            for k, w in enumerate(s.widths):
                for o in range(w):
                    for f in range(s.filters):
                        j = k * s.filters + f
                        live = np.flatnonzero(g_pool[:, j])
                        if len(live):
                            words = ids[where[live, j] + o]
                            x = net.table[words].sum(1)
                            g_kernel[:, col + f] += x.T @ g_pool[live, j]
                            pull = np.outer(g_pool[live, j], net.kernel[:, col + f])
                            touched += [words[:, c] for c in range(words.shape[1])]
                            pulls += [pull] * words.shape[1]
                    col += s.filters
            net.kernel -= adam("kernel", g_kernel + 1e-4 * net.kernel)
            net.bias -= adam("bias", g_pool.sum(0))
            net.out -= adam("out", g_out + 1e-3 * net.out)
            bias_m = [0.9 * bias_m[0] + 0.1 * g_bias, 0.99 * bias_m[1] + 0.01 * g_bias ** 2]
            net.out_bias -= s.rate * (bias_m[0] / (1 - 0.9 ** step)) / (np.sqrt(bias_m[1] / (1 - 0.99 ** step)) + 1e-7)
            if touched:
                b, rows_of = np.unique(np.concatenate(touched), return_inverse=True)
                grad = np.zeros((len(b), s.dim), np.float32)
                np.add.at(grad, rows_of, np.concatenate(pulls))
                squared[b] += (grad ** 2).mean(1)
                net.table[b] -= s.rate * grad / np.sqrt(squared[b])[:, None]
    net.cuts = calibrate(net, [rows[i] for i in (np.flatnonzero(tune) if tune.any() else fit)])
    return net


def calibrate(net: Network, rows: list[tuple[np.ndarray, int, int]]) -> dict[int, float]:
    """The logit cut of each language: midway in the gap of fewest weighted errors, drawn to the
    overall cut in proportion to how few rows of either class the language has."""
    count = np.array([len(r[0]) for r in rows])
    raw = np.concatenate([net.pooled(np.concatenate([r[0] for r in rows[lo:hi]]), count[lo:hi])
                          for lo, hi in _chunks(count, net.shape.chunk)]) @ net.out + net.out_bias
    y, lang = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])

    def best(mask: np.ndarray) -> float | None:
        v, t = raw[mask], y[mask]
        if not len(t) or t.min() == t.max():
            return None
        order = np.argsort(v, kind="stable")
        v, t = v[order], t[order]
        below = np.concatenate([[0], np.cumsum(t)]) / t.sum()  # positives under a cut
        above = 1 - np.concatenate([[0], np.cumsum(1 - t)]) / (1 - t).sum()  # negatives over it
        wrong = below + above
        k = np.flatnonzero(np.isclose(wrong, wrong.min()))
        inner = k[(k > 0) & (k < len(v))]
        if not len(inner):
            return None
        gaps = v[inner] - v[inner - 1]
        j = inner[gaps.argmax()]
        return float((v[j] + v[j - 1]) / 2)

    overall = best(np.ones(len(y), bool)) or 0.0
    cuts = {}
    for k in range(len(LANGUAGES)):
        own, few = best(lang == k), min(((lang == k) & (y == c)).sum() for c in (0, 1))
        cuts[k] = overall if own is None else (few * own + 10 * overall) / (few + 10)
    return cuts


def fit_toxicity(docs: DataFrame, labels: DataFrame, shape: Shape = Shape()) -> Network | None:
    """Train on at most ``2 * shape.per_class`` labelled rows outside the held-out fold.

    Executors turn whole sampled texts into bucket ids. Rows, never parts of them, are
    left out beyond ``shape.class_bytes`` of text a class, so what reaches the driver is
    bounded (8 bytes a word of that text) and thresholds are set on whole texts.
    """
    sample = labelled_sample(docs, labels, "toxic", MODULUS, HELD, shape.per_class, shape.row_bytes)

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts: list[list[np.ndarray]] = [[] for _ in range(b.num_rows)]
            votes = np.zeros((b.num_rows, len(FUNCTION_WORDS)), np.int64)
            for ids, count, doc, v, _ in encode(b.column("text"), shape.buckets, 0):
                np.add.at(votes, doc, v)
                first = np.concatenate([[0], np.cumsum(count)])
                for k, d in enumerate(doc):
                    parts[d].append(ids[first[k]:first[k + 1]])
            lang = np.where(votes.max(1) > 0, votes.argmax(1), len(FUNCTION_WORDS))
            blobs = [np.concatenate(p).astype("<u2").tobytes() if p else b"" for p in parts]
            yield pa.record_batch([b.column("doc_id"), b.column("y"), pa.array(lang, pa.int32()), pc.fill_null(pc.binary_length(b.column("text")), 0).cast(pa.int64()),
                                   pa.array(blobs, pa.binary())], ["doc_id", "y", "lang", "size", "ids"])

    assert shape.buckets <= 1 << 16
    got = sample.mapInArrow(ids_of, "doc_id long, y int, lang int, size long, ids binary")
    # a repeated doc_id counts once
    once = got.groupBy("doc_id").agg(F.min(F.struct("y", "lang", "size", "ids")).alias("r")).select("doc_id", "r.*")
    rows = [(np.frombuffer(r.ids, "<u2").reshape(-1, 1 + len(PREFIXES)).astype(np.int32), r.y, r.lang)
            for r in within(once, shape.class_bytes).select("doc_id", "y", "lang", "ids").orderBy("doc_id").collect()]
    return train(rows, shape)


def score_toxicity(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, score, predicted, language of every row."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(net)  # a few MB: buckets x dim

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if model.value is None:
                s, lang = np.zeros(b.num_rows), np.full(b.num_rows, len(LANGUAGES) - 1)
            else:
                s, lang = model.value.scores(b.column("text"))
            yield pa.record_batch([b.column("doc_id"), pa.array(s.astype(float), pa.float64()),
                                   pa.array([LANGUAGES[k] for k in lang], pa.string())], ["doc_id", "score", "language"])

    scored = docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double, language string")
    return scored.select("doc_id", (fold(F.col("doc_id"), MODULUS) == HELD).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "language")


def drop_toxic(docs: DataFrame, net: Network | None) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with their columns."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.zeros(b.num_rows) if model.value is None else model.value.scores(b.column("text"))[0]
            yield b.filter(pa.array(s < 0.5))

    return docs.mapInArrow(keep, docs.schema)
