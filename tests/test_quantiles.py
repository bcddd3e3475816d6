"""Exact quantiles by brackets against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelframe.operators import eda, quantiles as Q

PS = {"a": 0.0, "q1": 0.25, "m": 0.5, "q3": 0.75, "h": 0.99, "z": 1.0}


def _kinds(rng, n):
    return {"normal": rng.normal(size=n), "ties": rng.integers(0, 5, n).astype(float), "hot": np.where(rng.random(n) < 0.6, 3.0, rng.normal(size=n) * 9),
            "long": rng.pareto(0.7, n), "one": np.full(n, -2.5), "edges": np.where(rng.random(n) < 0.5, -1e300, 1e300)}


@pytest.mark.parametrize("accuracy,held,groups", [(2000, 200_000, 10_000), (200, 150, 10_000), (100, 40, 3)])
def test_as_numpy(spark, monkeypatch, accuracy, held, groups):
    """Small limits force brackets, several narrowings, and the join beyond the broadcast."""
    for name, v in (("ACCURACY", accuracy), ("HELD", held), ("GROUPS", groups)):
        monkeypatch.setattr(Q, name, v)
    rng = np.random.default_rng(accuracy)
    data = _kinds(rng, 4000) | {"few": rng.normal(size=3), "single": np.array([7.0])}
    rows = [(g, float(x)) for g, xs in data.items() for x in xs] + [("none", None), ("few", float("nan")), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r.g: r for r in Q.exact_quantiles(df, F.col("x"), PS, ["g"], [F.count("_x").alias("n")]).collect()}
    assert set(got) == {*data, "none", None} and all(got["none"][p] is None for p in PS) and got["none"].n == 0
    for g, xs in [*data.items(), (None, np.array([1.0, 2.0]))]:
        assert [got[g][p] for p in PS] == pytest.approx(np.quantile(xs, list(PS.values())).tolist(), rel=1e-12), g
    assert got["few"].n == 4
    whole = Q.exact_quantiles(df, F.col("x"), PS).first()
    every = np.array([x for _, x in rows if x is not None and x == x])
    assert [whole[p] for p in PS] == pytest.approx(np.quantile(every, list(PS.values())).tolist(), rel=1e-12)


def test_empty(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert Q.exact_quantiles(df, F.col("x"), {"m": 0.5}).first()["m"] is None
    assert Q.exact_quantiles(df, F.col("x"), {"m": 0.5}, ["g"]).count() == 0
    assert eda.describe(df, "x").first()["count"] == 0 and eda.box_by_group(df, "g", "x").count() == 0


def test_only_values_in_brackets_are_shuffled(spark, monkeypatch):
    """A million rows of as many values: the tally's shuffle gets the brackets' values, not all."""
    monkeypatch.setattr(Q, "GROUPS", 10)
    df = spark.range(1_000_000).select((F.xxhash64("id") % 10 ** 12).cast("double").alias("x"))
    values = df.select(F.col("x").alias("_v"))
    heads = Q._settled(Q._sketched(df.select(F.col("x").alias("_x"), F.col("x").alias("_v")), [], [0.25, 0.5, 0.75], []))
    tally = Q._tallied(values, heads, [], [0.25, 0.5, 0.75])
    assert tally.where("_in").count() < 3 * 1_000_000 * 3 * (Q.MARGIN + 1) / Q.ACCURACY
    assert tally.agg(F.sum("_c")).first()[0] == 1_000_000 and heads.held < Q.HELD
    plan = Q.exact_quantiles(df, F.col("x"), {"m": 0.5})._jdf.queryExecution().toString()
    assert "ExistingRDD" not in plan  # nothing was checkpointed


def test_box_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(Q, "ACCURACY", 100)
    rng = np.random.default_rng(3)
    data = {"a": rng.normal(size=3000), "b": rng.standard_cauchy(2000)}
    df = spark.createDataFrame([(g, float(x)) for g, xs in data.items() for x in xs], "g string, x double")
    for r in eda.box_by_group(df, "g", "x").collect():
        xs = data[r.g]
        q1, m, q3 = np.quantile(xs, [0.25, 0.5, 0.75])
        inside = xs[(xs >= q1 - 1.5 * (q3 - q1)) & (xs <= q3 + 1.5 * (q3 - q1))]
        assert (r.q1, r.median, r.q3) == pytest.approx((q1, m, q3)) and r.n == len(xs)
        assert (r.whisker_low, r.whisker_high, r.outliers) == (inside.min(), inside.max(), len(xs) - len(inside))
