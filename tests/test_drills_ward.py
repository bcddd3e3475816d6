"""Clustered drill tables and Ward's clustering against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelframe.operators import drills as D
from parcelframe.plans import ward as W

ENTRY = "region string, office string, subkey string, id string, ca string"


def _drill(spark, offices, hot=6000):
    rows = [(f"R{o % 3}", f"o{o:04d}", k, f"id{i}", "1") for o in range(offices) for i in range(40) for k in ("__all__", "CRBT")]
    rows += [("R1", "o0003", "__all__", f"hot{i % (hot // 2)}", "2") for i in range(hot)] + [(None, "o0003", "CRBT", "x", "")] * 3
    return spark.createDataFrame(rows, ENTRY)


def test_a_lookup_reads_the_files_of_its_cell(spark, tmp_path):
    read = {}
    for offices in (20, 200):
        path, drill = str(tmp_path / str(offices)), _drill(spark, offices)
        D.write_drill(drill, path, file_rows=1000)
        for office, subkey in (("o0005", "CRBT"), ("o0003", "__all__")):
            got = D.lookup(spark, path, office, subkey)
            want = drill.where((F.col("office") == office) & (F.col("subkey") == subkey))
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
            read[offices, office] = len(got.inputFiles())
        assert len(spark.read.parquet(f"{path}/entries").inputFiles()) >= offices // 20
        assert D.lookup(spark, path, "o0003", "CRBT", region="R1").count() == 0 and D.lookup(spark, path, "nowhere").count() == 0
    for office in ("o0005", "o0003"):
        assert abs(read[20, office] - read[200, office]) <= 1
    assert read[200, "o0005"] <= 2 and 4 <= read[200, "o0003"] <= 9  # the hot cell lies in several files
    assert spark.read.parquet(str(tmp_path / "200" / "entries")).groupBy(F.col("_metadata.file_path")).count().agg(F.max("count")).first()[0] < 2500


def test_pages_hold_every_entry(spark, tmp_path):
    path, drill = str(tmp_path / "d"), _drill(spark, 6)
    D.write_drill(drill, path, file_rows=1000)
    rows = D.pages(spark, path, page_size=100).collect()
    assert all(len(r.entries) <= 100 for r in rows)
    cells = {}
    for r in rows:
        cells.setdefault((r.region, r.office, r.subkey), []).append(r)
    for own in cells.values():
        assert sorted(r.page for r in own) == list(range(len(own)))
    got = {(*cell, e.id, e.ca): e.times for cell, own in cells.items() for r in own for e in r.entries}
    want = {(r.region, r.office, r.subkey, r.id, r.ca): r["count"] for r in drill.groupBy(*drill.columns).count().collect()}
    assert got == want and max(want.values()) == 3


def _plain_ward(x, k):
    """Clusters as sets of rows, merged by the least growth of the sum of squares."""
    groups = [[i] for i in range(len(x))]
    inner = lambda g: ((x[g] - x[g].mean(0)) ** 2).sum()
    while len(groups) > k:
        _, i, j = min((inner(a + b) - inner(a) - inner(b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


def _clusters(df, k):
    found = {}
    for r in W.ward(df, k, F.col("v")).collect():
        found.setdefault(r.raw, set()).add(r.i)
    return {frozenset(g) for g in found.values()}


@pytest.mark.parametrize("seed,k", [(0, 3), (1, 5), (2, 1)])
def test_ward_as_by_brute_force(spark, seed, k):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(36, 3))
    x = np.concatenate([x, x[:5]])  # equal rows
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "i int, v array<double>")
    assert _clusters(df, k) == _plain_ward(x, k)


def test_ward_over_a_bounded_summary(spark, monkeypatch):
    monkeypatch.setattr(W, "BOUND", 60)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.3, (n, 2)) for c, n in (((0, 0), 700), ((6, 0), 300), ((0, 6), 40))])
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "i int, v array<double>").repartition(4).cache()
    points, count, mean = W.features(df.select("v"))
    assert len(points) <= 60 and count.sum() == 1040 and np.allclose((mean * count[:, None]).sum(0), x.sum(0))
    assert _clusters(df, 3) == {frozenset(range(700)), frozenset(range(700, 1000)), frozenset(range(1000, 1040))}
    assert W.ward(df, 90, F.col("v")).select("raw").distinct().count() <= 60
