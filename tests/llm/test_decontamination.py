"""Positional index against brute force."""

import hashlib
import re

import pytest

from parcelframe.llm import decontamination as D

from .conftest import clash, docs_of


def _words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def _brute(texts, items):
    windows = {}
    for k, t in items:
        w = _words(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i:i + 10]), set()).add(str(k))
    out = []
    for t in texts:
        w, hit, found = _words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def _case(words):
    line = lambda a, n: " ".join(words[a:a + n])
    items = [(1, line(0, 40)), (2, line(30, 25)), (3, "One-Two three"), (10, "single"), (4, None), (5, "!!"), (6, line(0, 40)), (7, "ab " * 15)]
    texts = [line(0, 40), "pre " + line(5, 12) + " mid " + line(30, 10).upper() + " post", line(5, 9), "one two, three one two three", "a single word",
             None, "", "ab " * 11, line(100, 50), (line(100, 200) + " ") * 300 + line(2, 10), line(35, 10) + " x " + line(35, 10),
             " ".join(reversed(words[:12])), line(100, 5)]
    return texts, items


@pytest.mark.parametrize("most,shard", [(1 << 16, 2 << 20), (7, 400)])
def test_hits_as_by_brute_force(spark, words, monkeypatch, most, shard):
    monkeypatch.setattr(D, "MOST_WINDOWS", most)  # several blocks of windows
    monkeypatch.setattr(D, "SHARD", shard)
    texts, items = _case(words)
    docs = clash(docs_of(spark, texts).repartition(3))
    got = {r.doc_id: r for r in D.contamination(docs, clash(spark.createDataFrame(items, "item_id long, text string"))).collect()}
    for i, want in enumerate(_brute(texts, items)):
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want, i
    assert got[11].n_near_items >= 1 and got[11].n_items == 0  # all words within the slop, in another order


def test_no_items_no_rows(spark, words):
    texts, items = _case(words)
    docs, bench = docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    assert D.contamination(docs, bench.limit(0)).where("contaminated OR n_items > 0").count() == 0
    assert D.contamination(docs.limit(0), bench).count() == 0


def test_drop_contaminated(spark, words):
    texts, items = _case(words)
    docs = clash(docs_of(spark, texts + texts[:1], ids=[*range(len(texts)), 8]))  # id 8 is clean once, contaminated once
    kept = D.drop_contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    clean = [(i, t) for i, (t, w) in enumerate(zip(texts, _brute(texts, items))) if not w[4]]
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted((i, t or "") for i, t in clean)


def test_words_across_documents_are_no_phrase(spark, words):
    half = [" ".join(words[:5]), " ".join(words[5:10])]
    item = spark.createDataFrame([(1, " ".join(words[:10]))], "item_id long, text string")
    got = D.contamination(docs_of(spark, half).coalesce(1), item).collect()
    assert all(r.n_hit == 0 and r.n_near_items == 0 for r in got)
