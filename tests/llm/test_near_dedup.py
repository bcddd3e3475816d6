"""Chosen-path join against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelframe.llm import near_dedup as N

from .conftest import clash, docs_of


def _sets(texts):
    out = []
    for t in texts:
        w = [x for x in (t or "").translate({c: c + 32 for c in range(65, 91)}).translate({c: 32 for c in range(9, 14)}).split(" ") if x]
        out.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def _brute(texts, ids):
    sets, top = _sets(texts), list(range(len(texts)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * len(sets[i] | sets[j]):
            top[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((str(d), len(s), str(least.get(root(i)))) for i, (d, s) in enumerate(zip(ids, sets)))


def _edited(rng, words, text, share):
    w = text.split(" ")
    for _ in range(max(1, int(len(w) * share))):
        w[rng.randrange(len(w))] = rng.choice(words)
    return " ".join(w)


def _corpus(words, seed=3, groups=25, copies=6):
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = " ".join(rng.choices(words, k=rng.randint(30, 160)))
        texts.append(base)
        for _ in range(rng.randint(0, copies)):
            texts.append(rng.choice([base, _edited(rng, words, base, 0.02), _edited(rng, words, base, 0.05), base.upper() + "\n"]))
    texts += [None, "", " \t\n", "a b", "a  b", "A B", "a b c d e", "c", " ".join(words) * 30, " ".join(words) * 30 + " end"]
    rng.shuffle(texts)
    return texts


def test_groups_as_by_brute_force(spark, words):
    texts = _corpus(words)
    ids = list(range(len(texts)))
    docs = clash(docs_of(spark, texts, ids=ids).repartition(4))
    got = N.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == _brute(texts, ids)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_repeated_rows_and_null_ids(spark, words):
    base = " ".join(words[:80])
    texts = [base, base, base + " x", "other text of five words here", None, None, base]
    ids = [5, 5, 3, 5, None, 9, None]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in N.near_duplicates(docs_of(spark, texts, ids=ids)).collect())
    assert got == _brute(texts[:4] + [None, None, base], [5, 5, 3, 5, None, 9, None])


@pytest.mark.parametrize("cheap", [500, 10 ** 9])
def test_large_nodes_branch_and_stay_exact(spark, words, monkeypatch, cheap):
    """A cluster far beyond the leaf size, and clusters near the threshold inside one large node."""
    rng = random.Random(8)
    base = " ".join(rng.choices(words, k=120))
    texts = [_edited(rng, words, base, 0.02) for _ in range(150)]
    for _ in range(6):  # further versions that are near some, not all
        version = _edited(rng, words, base, 0.06)
        texts += [version] + [_edited(rng, words, version, 0.01) for _ in range(6)]
    ids = list(range(len(texts)))
    monkeypatch.setattr(N, "LEAF", 16)
    monkeypatch.setattr(N, "CHEAP", cheap)
    monkeypatch.setattr(N, "LEVELS", 2)
    got = N.near_duplicates(docs_of(spark, texts, ids=ids)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == _brute(texts, ids)


def test_deep_nodes_keep_sparse_pairs(spark, monkeypatch):
    """Pairs at 0.75 to 0.78 among documents of one template, in nodes that are large down to the last level."""
    rng = np.random.default_rng(12)
    pairs = 1500
    template = rng.integers(-2 ** 31, 2 ** 31, N.TOKENS)
    tokens = rng.integers(-2 ** 31, 2 ** 31, (2 * pairs, N.TOKENS))
    tokens[pairs:] = np.where(rng.random((pairs, N.TOKENS)) < rng.uniform(0.75, 0.78, (pairs, 1)), tokens[:pairs], tokens[pairs:])
    both = (tokens[:pairs] == tokens[pairs:]) & (rng.random((pairs, N.TOKENS)) < 0.9)  # most of what they share is the template
    tokens[:pairs][both] = tokens[pairs:][both] = np.broadcast_to(template, both.shape)[both]
    classes = spark.createDataFrame([(bytearray(b"%d" % (i % pairs) + b"ab"[i // pairs:][:1]), t) for i, t in enumerate(tokens.tolist())],
                                    "set binary, tokens array<int>")
    monkeypatch.setattr(N, "LEAF", 32)
    rows, leaves = N.roots(classes), []
    for level in range(1, N.DEPTH + 1):
        leaves.append(rows.where(F.col("n") <= N.LEAF) if level < N.DEPTH else rows)
        if level < N.DEPTH:
            rows = N.stored(N.branches(rows.where(F.col("n") > N.LEAF)), "nodes")
    met = None
    for x in leaves:
        x = x.select("node", F.decode("set", "utf-8").alias("s"))
        x = x.groupBy("node", F.expr("left(s, length(s) - 1)").alias("pair")).count().where("count = 2").select("pair")
        met = x if met is None else met.union(x)
    assert rows.agg(F.max("n")).first()[0] > N.LEAF
    assert pairs - met.distinct().count() <= 1


def test_no_rows(spark):
    assert N.near_duplicates(docs_of(spark, ["x"]).limit(0)).count() == 0
    assert N.keep_one(docs_of(spark, ["x"]).limit(0)).count() == 0


def test_keep_one_keeps_columns_and_one_row(spark, words):
    base = " ".join(words[:80])
    texts = [base, base, base + " x", "alone in the world of texts", None, ""]
    docs = clash(docs_of(spark, texts, ids=[4, 4, 6, 8, 9, None]))
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect() if r.text) == [("4", base), ("8", texts[3])]
    assert kept.count() == 4  # the rows without shingles stay


def test_keep_one_where_ids_dont_tell_documents_apart(spark, words):
    null, same = " ".join(words[:80]), " ".join(words[100:180])
    texts = [null, null + " x", null + " y", null, same, same + " x", same + " x", same + " y", None, "", ""]
    ids = [None, None, None, None, 7, 7, 7, 9, None, 3, 4]
    kept = N.keep_one(clash(docs_of(spark, texts, ids=ids))).collect()
    assert [r.doc_id for r in kept if (r.text or "").startswith(null)] == [None]
    assert [r.doc_id for r in kept if (r.text or "").startswith(same)] == [7]
    assert sorted(str(r.doc_id) for r in kept if not r.text) == ["3", "4", "None"]  # each its own group
    mixed = N.keep_one(docs_of(spark, [null, null + " x", null + " y"], ids=[None, 12, None])).collect()
    assert [r.doc_id for r in mixed] == [12]


def test_estimates_hold_the_similarity(words, monkeypatch):
    import pyarrow as pa
    rng = random.Random(4)
    base = rng.choices(words, k=900)
    texts = [base, base[:860] + rng.choices(words, k=40), base[:500] + rng.choices(words, k=400), rng.choices(words, k=900), base[:40], base[:42]]
    s, n = N.shingles(pa.array([" ".join(t) for t in texts]))
    edge = np.concatenate([[0], np.cumsum(n)])
    sets = [set(s[a:b].tolist()) for a, b in zip(edge, edge[1:])]
    low = [(s[a:b][:N.LOW] >> np.uint64(32)).astype(np.int64) for a, b in zip(edge, edge[1:])]
    got, least = N.estimates(low, n)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            true = len(a & b) / len(a | b)
            assert i == j or abs(got[i, j] - true) < 0.11 and (true < 0.75 or got[i, j] >= least[i, j])
    assert got[4, 5] == len(sets[4] & sets[5]) / len(sets[4] | sets[5])  # small sets: exact
    assert got[0, 3] < least[0, 3]


def test_only_classes_that_share_enough_tokens_enter_trees(spark):
    x = list(range(N.TOKENS))
    y = x[:N.ENOUGH] + [100 + t for t in x[N.ENOUGH:]]
    z = [200 + t for t in x[:-N.ENOUGH + 1]] + x[-N.ENOUGH + 1:]
    classes = spark.createDataFrame([(bytearray(k), t) for k, t in ((b"x", x), (b"y", y), (b"z", z))], "set binary, tokens array<int>")
    assert sorted(bytes(r.set) for r in N.sharing(classes).collect()) == [b"x", b"y"]


def test_nodes_of_one_group_dont_branch(spark, words, monkeypatch):
    rng = random.Random(9)
    base = " ".join(rng.choices(words, k=120))
    texts = [_edited(rng, words, base, 0.01) for _ in range(60)] + [" ".join(rng.choices(words, k=60)) for _ in range(20)]
    branched, branches = [], N.branches
    monkeypatch.setattr(N, "LEAF", 16)
    monkeypatch.setattr(N, "branches", lambda large: branched.append(large.count()) or branches(large))
    got = N.near_duplicates(docs_of(spark, texts)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == _brute(texts, list(range(len(texts))))
    assert not branched
