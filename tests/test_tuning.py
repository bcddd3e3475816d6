"""Successive halving over the trees' settings."""

from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from parcelframe import catalog
from parcelframe.plans import forecast as fc

SF = "/root/testdata/sf0.01"


def test_survivors():
    assert fc.survivors([(3.0, 0), (1.0, 1), (1.0, 2), (2.0, 3)], False) == [1, 2]
    assert fc.survivors([(1.0, 4), (1.0, 2)], True) == [2] and fc.survivors([], False) == []


def test_rungs_against_the_full_grid(spark):
    """Every rung keeps its best half; the survivor is held against the best of all settings with all rounds."""
    catalog.queries()
    from parcelframe.plans.queries_ml import _gbt_frames, all_long

    long = all_long(spark, SF).where("dataset = 'national' AND target = 'poids'").select("unique_id", "ds", "y")
    train = _gbt_frames(long)[0]
    rows = fc.tune_gbt({("national", "poids"): train, ("none", "poids"): train.limit(0), ("short", "poids"): train.where(F.col("ds") == train.agg(F.max("ds")).first()[0])})
    assert {r[0] for r in rows} == {"national"}
    assert [sum(r[5] == k for r in rows) for k in range(4)] == [15, 8, 4, 2] and [r[6] for r in rows if r[9]] == [9] * 8 + [18] * 4 + [36] * 2 + [72]
    for k in range(4):
        own = sorted((r[8], r[2]) for r in rows if r[5] == k)
        assert {i for _, i in own[:(8, 4, 2, 1)[k]]} == {r[2] for r in rows if r[5] == k and r[9]}
    # halving may lose the setting that only gets ahead late; what it finds is close to the best of all
    full = fc.tune_gbt({("national", "poids"): train}, rungs=(fc.RUNGS[-1],))
    best, found = min((r[8], r[2]) for r in full), next((r[8], r[2]) for r in rows if r[5] == 3 and r[9])
    assert best[0] <= found[0] <= 1.05 * best[0]
    # a setting's error is that of a plain fit of as many rounds as it says
    _, _, _, depth, step, _, _, best, mae, _ = next(r for r in rows if r[5] == 0)
    feats = fc.feature_columns(train)
    marked = fc._assemble(fc.with_validation(train), feats)
    model = GBTRegressor(featuresCol="features", labelCol="y", maxDepth=depth, stepSize=step, maxIter=best, seed=42).fit(marked.where("NOT is_validation"))
    got = model.transform(marked.where("is_validation")).agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0]
    assert abs(got - mae) < 1e-6 * mae
