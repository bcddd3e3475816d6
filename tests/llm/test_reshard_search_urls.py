"""Resharding, pivot-table search and url rules against brute force."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelframe.llm import pivot_search as S, reshard as R, url_filter as U

from .conftest import clash, docs_of


@pytest.mark.parametrize("seed", range(30))
def test_flow_moves_the_fewest_bytes(seed):
    rng = random.Random(seed)
    n, m = rng.randint(1, 6), rng.randint(1, 6)
    supply = [rng.randint(0, 50) for _ in range(n)]
    total, cuts = sum(supply), sorted(rng.randint(0, sum(supply)) for _ in range(m - 1))
    capacity = [b - a for a, b in zip([0, *cuts], [*cuts, total])]
    flow = R.min_cost_flow(supply, capacity)
    assert all(sum(v for (i, _), v in flow.items() if i == k) == s for k, s in enumerate(supply))
    assert all(sum(v for (_, j), v in flow.items() if j == k) == c for k, c in enumerate(capacity))
    assert sum(v for (i, j), v in flow.items() if i != j) == total - sum(min(a, b) for a, b in zip(supply, capacity))


def _size(t):
    return len((t or "").encode()) + 1


@pytest.mark.parametrize("files,shards", [(1, 16), (5, 16), (20, 16), (3, 2)])
def test_rows_in_their_new_shards(spark, tmp_path, words, files, shards):
    rng = random.Random(files)
    texts = [None, "", "é" * 30] + [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(600)]
    clash(docs_of(spark, texts)).repartition(files).write.parquet(str(tmp_path / "docs.parquet"))
    got = R.reshard_files(spark, str(tmp_path / "docs.parquet"), shards).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i, _size(t), zlib.crc32((t or "").encode())) for i, t in enumerate(texts))
    by = {}
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(shards))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    sizes = [sum(r.size for r in own) for own in by.values()]
    assert max(sizes) - min(sizes) <= 2 * files * max(map(_size, texts)) // 2 + max(map(_size, texts))


def test_unchanged_shards_keep_their_files(spark, tmp_path, words):
    docs = docs_of(spark, [" ".join(words[:5])] * 40).repartitionByRange(4, "doc_id")
    docs.write.parquet(str(tmp_path / "docs.parquet"))
    rows, files = R.old_layout(spark, str(tmp_path / "docs.parquet"))
    n = [r["count"] for r in rows.groupBy("old").count().orderBy("old").collect()]
    size = _size(" ".join(words[:5]))
    plan = R.plan(rows, 4, 4, [n[0] * size, n[1] * size, (n[2] + 2) * size, (n[3] - 2) * size])
    assert sum(s.rows for s in plan if s.old != s.shard) == 2
    out = R.reshard(rows, plan, str(tmp_path / "new"))
    assert out.count() == 40
    assert {r.shard for r in spark.read.parquet(str(tmp_path / "new")).select("shard").distinct().collect()} == {2, 3}


def test_reshard_of_no_rows(spark, tmp_path):
    docs_of(spark, ["x"]).limit(0).write.parquet(str(tmp_path / "docs.parquet"))
    assert R.reshard_files(spark, str(tmp_path / "docs.parquet")).count() == 0


def _vectors(spark, rows):
    return clash(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))


def _brute(rows, every, k):
    ok = [(i, [math.floor(1024 * c) for c in v]) for i, v, _ in rows
          if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in ok if i % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, x)), i) for i, x in ok if i != q and len(x) == len(v))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1])
def test_top_k_as_by_brute_force(spark, monkeypatch, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (6, 12))
    rows = [(int(i), (centres[rng.integers(6)] + rng.normal(0, 0.1, 12)).tolist(), 0) for i in range(500)]
    rows += [(501, None, 0), (502, [None] * 12, 0), (503, [math.nan] * 12, 0), (504, [math.inf] + [0.0] * 11, 0), (None, [0.5] * 12, 0),
             (510, [1.0, 2.0], 0), (520, [3.0, 1.0], 0), (530, [], 0), (540, [0.0] * 12, 0), (7, rows[7][1], 0), (20, rows[20][1], 0)]
    rows += [(600 + i, rows[3][1], 0) for i in range(15)]  # ties
    monkeypatch.setattr(S, "BLOCK", 17)
    got = sorted(tuple(r) for r in S.top_k(_vectors(spark, rows), every=10, k=10).select("query_id", "rank", "vec_id", "score").collect())
    assert got == _brute(rows, 10, 10)


def test_top_k_of_few_rows(spark):
    one = _vectors(spark, [(0, [1.0], 0), (3, [2.0], 0)])
    assert [tuple(r) for r in S.top_k(one).collect()] == [(0, 1, 3, 2 * 1024 * 1024)]
    assert S.top_k(one.limit(0)).count() == 0


def test_stops_before_all_candidates(spark, monkeypatch):
    """Bounds prune: far clusters are never evaluated."""
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 3, (20, 8))
    x = np.floor(1024 * np.concatenate([c + rng.normal(0, 0.01, (100, 8)) for c in centres])).astype(int)
    pivots = S._distances(x[::100].astype(float), x[::100].astype(float))
    assert pivots.shape == (20, 20)
    d = S._distances(x.astype(float), x[::100].astype(float))
    q = 5
    low = np.abs(d - d[q]).max(1)
    norm = (x.astype(float) ** 2).sum(1)
    bound, score = (norm[q] + norm - low ** 2) / 2, x @ x[q]
    assert (score <= bound + 1e-6 * norm).all()


URLS = ["http://net/", "http://NET", "https://a.b.example.net/en/x?y#z", "http://example.net/en", "ftp://example.net/de/", "http://example.com/de/",
        "http://notexample.com/de/x", "http://x.example.com/de/x", "http://example.com/fr/", "http://w.org/fr/a", "http://org/fr", "http://é.NET/Ü",
        "no scheme.net/", None, "", "://", "://net/", "http://net:80/", "http://a..net/", "http://net./", "http://x.net?/en/", "http://x.net#/",
        "a://b://c.net/", "http://u@e.org/fr/", "http://" + "a." * 3000 + "net/" + "x" * 50_000]


def _judge(url, rules):
    rest = url[url.index("://") + 3:] if url is not None and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else None
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("rules", [U.RULES, U.RULES + [("b.example.net", "/en/x", "block"), ("a.b.example.net", "", "allow"), ("net", "", "allow")], []])
def test_rules_as_by_brute_force(spark, rules):
    pages = clash(spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS + URLS[:2])], "page_id long, url string, host string, path string"))
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = U.judge(pages, listed).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == _judge((URLS + URLS[:2])[r.page_id], rules), r.page_id
    assert U.judge(pages.limit(0), listed).count() == 0


def test_no_python_on_the_path(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    plan = U.judge(pages, spark.createDataFrame(U.RULES, "host string, path string, verdict string"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", text)


def test_false_positives_never_reach_the_result(spark):
    """One block for many keys lets nearly everything through; the join still decides."""
    from parcelframe.llm import bloom
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    held = bloom.build(keys, "key", 1)
    assert bloom.may_hold(keys, F.col("key"), held, 1).count() == 4000
    wide = bloom.build(keys, "key", bloom.blocks_for(4000))
    other = spark.range(20_000).select(F.concat(F.lit("other"), "id").alias("key"))
    assert bloom.may_hold(keys, F.col("key"), wide, bloom.blocks_for(4000)).count() == 4000
    assert bloom.may_hold(other, F.col("key"), wide, bloom.blocks_for(4000)).count() < 600


def test_top_k_of_components_of_any_size(spark, monkeypatch):
    """From 1e-3 to 1e9 and beyond: rows with large components answer, and are answers, exactly."""
    rng = np.random.default_rng(4)
    rows = [(int(i), (rng.choice([-1, 1], 6) * 10 ** rng.uniform(-3, 3, 6)).tolist(), 0) for i in range(200)]
    rows += [(200 + i, (rng.choice([-1, 1], 6) * 10 ** rng.uniform(-3, 6, 6)).tolist(), 0) for i in range(60)]
    rows += [(300 + 10 * i, [10.0 ** (3 * i), 0.0, 0.25, 0.0, 0.0, 0.0], 0) for i in range(3)] + [(400, [0.0] * 5 + [1e-3], 0)]
    # scores of these go far below any long, but never among the ten highest
    rows = [(i, [v[0], abs(v[1]) + 1, *v[2:]], 0) for i, v, _ in rows]
    rows += [(501, [0.0, -1e9, 0.0, 0.0, 0.0, 0.0], 0), (510, [0.0, 1.0, 0.0, 0.0, 0.0, 0.0], 0)]
    monkeypatch.setattr(S, "BLOCK", 8)
    monkeypatch.setattr(S, "STEP", 64)
    got = sorted(tuple(r) for r in S.top_k(_vectors(spark, rows).repartition(3), every=10, k=10).select("query_id", "rank", "vec_id", "score").collect())
    assert got == _brute(rows, 10, 10)
    assert max(abs(r[3]) for r in got) > 2 ** 53


def test_only_a_returned_score_beyond_a_long_fails(spark):
    high = [(0, [1.048e6] * 16, 0), (1, [1.048e6] * 16, 0)] + [(i, [1.0] * 16, 0) for i in range(2, 20)]
    with pytest.raises(Exception, match="doesn't fit a long"):
        S.top_k(_vectors(spark, high)).collect()
    low = [(0, [1e30] * 16, 0), (1, [-1e30] * 16, 0)] + [(i, [0.0] * 16, 0) for i in range(2, 20)]
    got = S.top_k(_vectors(spark, low)).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(k, k + 1, 0) for k in range(1, 11)]


@pytest.mark.parametrize("a,b", [(0, 1), (-1, 0), (255, 256), (-256, -255), (2 ** 64, 2 ** 65), (-(2 ** 65), -(2 ** 64)), (-(2 ** 63) - 1, 5)])
def test_sort_keys(a, b):
    assert S.sort_key(a) < S.sort_key(b)
