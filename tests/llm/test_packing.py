"""Mixture packing: plan, pieces, shares."""

import zlib

import numpy as np
import pytest

from parcelframe.llm import bpe, packing

from .conftest import clash, docs_of


@pytest.mark.parametrize("seed", range(40))
def test_plan_empties_all_queues(seed):
    rng = np.random.default_rng(seed)
    q, length = int(rng.integers(1, 8)), int(rng.choice([8, 64, 1024]))
    totals = rng.integers(0, 5000, q)
    targets = rng.random(q) * (rng.random(q) < 0.6) if seed % 2 else totals.astype(float)
    given, first = np.zeros(q, int), 0
    phases = packing.plan_windows(totals, targets, length)
    for p in phases:
        assert p.first == first
        steps = p.given(np.arange(p.windows + 1), length)
        each = np.diff(steps, axis=0)
        assert (steps[0] == given).all() and (each >= 0).all() and (each.sum(1)[:-1] == length).all()
        assert each.sum(1)[-1] == length or p is phases[-1]
        given, first = steps[-1], first + p.windows
    assert (given == totals).all()


def test_shares_follow_targets_while_all_queues_hold_tokens():
    phase = packing.plan_windows(np.array([10_000, 10_000, 50_000]), np.array([1.0, 1.0, 2.0]), 100)[0]
    each = np.diff(phase.given(np.arange(phase.windows + 1), 100), axis=0)
    assert abs(each - np.array([25, 25, 50])).max() <= 1 and phase.windows > 390


def _check(docs, pieces, length=1024):
    e = bpe.encoder(bpe.vocabulary())
    rows = docs.select("doc_id", "text").collect()
    ids = {r.doc_id: np.append(x, 0).astype("<u4") for r, x in zip(rows, e.ids([r.text for r in rows]))}
    by_doc, by_window = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_window.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(ids)
    for d, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[d]) and zlib.crc32(ids[d][p.start:p.start + p.length].tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids[d])
    assert sorted(by_window) == list(range(len(by_window)))
    for w, own in by_window.items():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == length or w == len(by_window) - 1 and at < length


def test_pieces_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pieces = packing.pack(docs).collect()
    _check(docs, pieces)
    total = sum(p.length for p in pieces)
    share, windows = {}, {}
    for p in pieces:
        share[p.source] = share.get(p.source, 0) + p.length
        windows.setdefault(p.sequence_id, {}).setdefault(p.source, 0)
        windows[p.sequence_id][p.source] += p.length
    for w in list(windows)[:-1]:
        if w != max(windows):
            assert all(abs(windows[w].get(s, 0) - n / total * 1024) < 2 for s, n in share.items())


def test_defined_results(spark, words):
    texts = [None, "", "<|endoftext|> ok", " ".join(words) * 12, "tiny", "tiny", "日本語 😀"]
    docs = clash(docs_of(spark, texts, sources=["hot", "hot", "hot", None, "rare"]).repartition(3))
    _check(docs, packing.pack(docs).collect())
    _check(docs, packing.pack(docs, length=64, targets={"hot": 0.5, None: 0.5}).collect(), 64)
    assert packing.pack(docs.limit(0)).count() == 0


def test_repeated_rows_are_packed_each(spark):
    docs = docs_of(spark, ["same text"] * 5, ids=[7] * 5)
    pieces = packing.pack(docs).collect()
    assert sum(p.length for p in pieces) == 5 * pieces[0].doc_tokens
