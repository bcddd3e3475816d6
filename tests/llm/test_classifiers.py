"""Held-out accuracy and defined results of the two classifiers."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parcelframe.llm import quality, textarrays as T, toxicity
from parcelframe.llm.common import labelled_sample, within
from parcelframe.llm.queries import QUERIES

from .conftest import clash, docs_of

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("query,label,least", [("op1_toxicity_cnn", "toxic", 0.95), ("op5_quality_attention", "quality", 0.97)])
def test_held_out_accuracy(spark, query, label, least):
    got = QUERIES[query](spark, SF)
    assert got.count() == 1000
    held = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    right = held.select(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
    assert right >= least
    bad = got.where("score < 0 OR score > 1 OR predicted != IF(score >= 0.5, 1, 0)").count()
    assert bad == 0


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("fit,score,drop,free", [
    (toxicity.fit_toxicity, toxicity.score_toxicity, toxicity.drop_toxic, 0.0),
    (quality.fit_quality, quality.score_quality, quality.drop_poor, 1.0)])
def test_defined_results(spark, words, fit, score, drop, free):
    good, bad = " ".join(words[:60]), "IDIOT!! %%% " * 40
    texts = [None, "", " ", "x" * 200_000, *([good] * 20), *([bad] * 20), "word " * 50_000]
    docs = clash(docs_of(spark, texts, ids=[None, 1, 1, *range(3, len(texts))]))
    labels = _labels(spark, [(i, int(i < 24), int(i >= 24)) for i in range(3, 44)] + [(5, 1, 0), (6, 0, 1), (None, 1, 1), (99, 1, 0)])
    net = fit(docs, labels)
    rows = score(docs, net).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.predicted for r in rows}
    assert by[10] != by[30]
    kept = drop(docs, net)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {10} and 30 not in {r.doc_id for r in kept.collect()}
    nothing = fit(docs, labels.where("doc_id = 10"))
    assert nothing is None and {r.score for r in score(docs, nothing).collect()} == {free}
    assert drop(docs, None).count() == docs.count()
    empty = docs.limit(0)
    assert score(empty, fit(empty, labels.limit(0))).count() == 0 and score(empty, net).count() == 0


def test_scores_dont_read_other_columns(spark, words):
    docs = docs_of(spark, [" ".join(words[:50]), "scum idiot " * 20] * 30)
    labels = _labels(spark, [(i, 1 - i % 2, i % 2) for i in range(60)])
    net = toxicity.fit_toxicity(docs, labels)
    one = [r.score for r in toxicity.score_toxicity(docs, net).orderBy("doc_id").collect()]
    other = docs.withColumn("lang", F.lit("de")).withColumn("source", F.lit("x"))
    assert one == [r.score for r in toxicity.score_toxicity(other, net).orderBy("doc_id").collect()]


def test_attention_weighs_passages(words):
    """One poor passage of many is enough where the labels say so."""
    rng = np.random.default_rng(1)
    rows = []
    for k in range(300):
        x = rng.normal(0, 1, (rng.integers(2, 9), quality.FEATURES))
        if k % 2:
            x[rng.integers(len(x)), 0] += 6
        rows.append((x, k % 2))
    net = quality.train(rows[:200], quality.Shape(epochs=60))
    right = [(net.forward(x, np.zeros(len(x), int), 1)[0][0] > 0) == y for x, y in rows[200:]]
    assert np.mean(right) > 0.9


def _long(words, n, seed, planted):
    """A text of about ``n`` bytes with some phrases in it."""
    rng = random.Random(seed)
    out, size = [], 0
    while size < n:
        line = " ".join(rng.choice(words) for _ in range(40)) + (". " + rng.choice(planted) if rng.random() < 0.001 else ".")
        out.append(line)
        size += len(line) + 1
    return "\n".join(out)


def test_scores_depend_on_the_text_alone(spark, words):
    good, bad = " ".join(words[:60]), "scum idiot!! %%% " * 40
    docs = docs_of(spark, [good, bad] * 40)
    labels = _labels(spark, [(i, 1 - i % 2, i % 2) for i in range(80)])
    text, other = _long(words, 4_000_000, 1, ["idiot scum idiot"]), _long(words, 340_000, 2, [bad])
    nets = [toxicity.fit_toxicity(docs, labels), quality.fit_quality(docs, labels)]
    for net, score in zip(nets, (lambda n, t: n.scores(t)[0], lambda n, t: n.scores(t))):
        alone = score(net, pa.array([text]))[0]
        for before in ([other], ["", None, other, other], [text]):
            assert score(net, pa.array([*before, text, "x"]))[len(before)] == pytest.approx(alone, abs=1e-6)
    two = docs_of(spark, [other, text, None, good])
    for net, score in zip(nets, (toxicity.score_toxicity, quality.score_quality)):
        one, eight = ([r.score for r in score(two.repartition(n), net).orderBy("doc_id").collect()] for n in (1, 8))
        assert one == pytest.approx(eight, abs=1e-6)


def test_convolution_as_by_plain_loops(spark, words, monkeypatch):
    """Each filter at each word of the whole text, also where the text is read in many slices."""
    docs = docs_of(spark, [" ".join(words[:60]), "scum idiot " * 20] * 40)
    net = toxicity.fit_toxicity(docs, _labels(spark, [(i, 1 - i % 2, i % 2) for i in range(80)]))
    s = net.shape
    texts = [" ".join(random.Random(k).choices([*words, "scum", "Idiot", "the", "und"], k=n)) for k, n in enumerate((1, 2, 3, 50, 700))] + ["", None, "12 ;"]
    want = []
    for t in texts:
        found = re.findall(r"[a-z\x80-\U0010ffff]+", (t or "").lower())
        x = [sum(net.table[T.word_hash(w) % s.buckets if k is None else int(T.hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]), (k,))[1][0]) % s.buckets]
                 for k in (None, *toxicity.PREFIXES)) for w in found]
        pooled, col = [], 0
        for k, width in enumerate(s.widths):
            for f in range(s.filters):
                values = [0.0]
                for at in range(len(x) - width + 1):
                    values.append(float(net.bias[k * s.filters + f]) + sum(float(x[at + o] @ net.kernel[:, col + o * s.filters + f]) for o in range(width)))
                pooled.append(max(values))
            col += width * s.filters
        want.append(float(np.array(pooled) @ net.out) + net.out_bias)
    whole = T.text_slices
    for size in (1 << 20, 64):
        monkeypatch.setattr(T, "text_slices", lambda *a, size=size: whole(*a[:2], *a[2:3], size=size))
        assert net.logits(pa.array(texts))[0] == pytest.approx(want, abs=1e-3)


def test_attention_as_by_plain_loops(spark, words):
    docs = docs_of(spark, [" ".join(words[:60]), "scum idiot!! %%% " * 40] * 40)
    net = quality.fit_quality(docs, _labels(spark, [(i, 1 - i % 2, i % 2) for i in range(80)]))
    texts = [_long(words, n, n, ["!! %%% $$"]) for n in (100, 900, 30_000)] + ["", None]
    p = net.p
    for text, got in zip(texts, net.scores(pa.array(texts))):
        top, total = np.zeros(len(p["c"])), 0.0
        for row in np.concatenate([x for x, _ in quality.passages(pa.array([text], pa.string()))]):
            h = np.tanh(((row - net.centre) / net.scale) @ p["W"] + p["b"])
            e = math.exp(sum(math.tanh(h @ p["V"][:, g]) / (1 + math.exp(-(h @ p["U"][:, g]))) * p["w"][g] for g in range(len(p["w"]))))
            top, total = top + e * h, total + e
        assert got == pytest.approx(1 / (1 + math.exp(-float(top / total @ p["c"] + p["d"][0]))), abs=1e-6)


def test_passages_of_a_long_text_run_on(words):
    """Passages don't restart where a text is read in pieces: all but repetition is as in one piece."""
    text = _long(words, 60_000, 4, ["!! %%%"])
    one = np.concatenate([x for x, _ in quality.passages(pa.array([text]))])
    old = T.text_slices
    try:
        T.text_slices = lambda t, keep, every: old(t, keep, every, size=5_000)
        cut = np.concatenate([x for x, _ in quality.passages(pa.array(["a b", text, ""]))])
    finally:
        T.text_slices = old
    free = [k for k in range(quality.FEATURES) if k not in (quality.KINDS + 2, quality.KINDS + 4)]
    assert len(cut) == len(one) + 2 and np.array_equal(cut[1:-1][:, free], one[:, free])


def test_training_rows_are_whole_or_left_out(spark, words):
    docs = docs_of(spark, [" ".join(words[:300])] * 30 + ["scum idiot " * 20] * 30)
    labels = _labels(spark, [(i, int(i < 30), int(i >= 30)) for i in range(60)])
    size = len(" ".join(words[:300]))
    few = labelled_sample(docs, labels, "toxic", 5, 0, 2000, 1000)
    assert size > 1000 and {r.y for r in few.collect()} == {1}
    rows = labelled_sample(docs, labels, "toxic", 5, 0, 2000, 1 << 20).select("doc_id", "y", F.octet_length("text").cast("long").alias("size"))
    got = within(rows, 5 * size).groupBy("y").agg(F.count("*").alias("n")).collect()
    assert {r.y: r.n for r in got} == {0: 5, 1: rows.where("y = 1").count()}
