"""Plan and skew properties that matter at scale."""

import io
import contextlib

from pyspark.sql import functions as F

import __spark_entry__ as entry
from parcelframe.operators import report as R

from .conftest import SF001


def _formatted_plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_national_query_prunes_partitions_and_columns(spark):
    plan = _formatted_plan(entry.queries()["vw_shipments_by_region"](spark, SF001))
    assert "PartitionFilters" in plan and "national" in plan
    read = [ln for ln in plan.splitlines() if ln.startswith("ReadSchema")]
    assert read and all("mailitm_fid" not in ln and "last_event_office" not in ln for ln in read)


def test_drill_pages_bounded_under_a_hot_office(spark):
    rows = [(f"id{i}", "HOT" if i % 3 else f"o{i % 50}") for i in range(6000)]  # two thirds in one office
    df = spark.createDataFrame(rows, "mailitm_fid string, depot_office string") \
        .withColumn("depot_region", F.lit("R")).withColumn("shipment_type", F.lit("Ordinaire")) \
        .withColumn("revenue_ca", F.lit(1).cast("decimal(18,3)"))
    drill = R.depot_drill(df)
    pages = R.drill_pages(drill, page_size=200).select("office", F.size("entries").alias("n")).collect()
    hot = [r["n"] for r in pages if r["office"] == "HOT"]
    assert sum(hot) == 4000 and len(hot) == 20 and max(hot) < 2 * 200
    assert sum(r["n"] for r in pages) == drill.count()


def test_top_k_semi_join_is_broadcast(spark):
    plan = _formatted_plan(entry.queries()["semi_top_n"](spark, SF001))
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_region_filter_reaches_the_scan(spark):
    plan = _formatted_plan(entry.queries()["depot_table_region"](spark, SF001))
    assert any("EqualTo(depot_region,ASIA)" in ln for ln in plan.splitlines() if "PushedFilters" in ln)


def test_no_row_is_expanded(spark):
    """Grouping sets run over aggregated rows: an Expand stands above an Aggregate, never right above the scan."""
    for name in ("depot_table", "depot_kpis", "livraison_kpis", "livraison_table_long"):
        df = entry.queries()[name](spark, SF001)
        lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        at = next(i for i, ln in enumerate(lines) if "Expand" in ln)
        assert any("Aggregate" in ln for ln in lines[at + 1:]), name


def test_quantiles_and_positions_by_ranges(spark):
    """Against numpy, with ties, one hot value, NULLs and a group of one row."""
    import numpy as np
    from parcelframe.operators import order
    rng = np.random.default_rng(0)
    rows = [("a", float(x)) for x in rng.integers(0, 50, 3000)] + [("b", 7.0)] * 2000 + [("c", 1.5), (None, 2.0), (None, 4.0), ("d", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r for r in order.exact_quantiles(df, F.col("x"), {"q": 0.25, "m": 0.5, "h": 0.9}, ["g"]).collect()}
    for g in ("a", "b", "c", None):
        want = np.quantile([x for k, x in rows if k == g and x is not None and x == x], [0.25, 0.5, 0.9])
        assert np.allclose([got[g]["q"], got[g]["m"], got[g]["h"]], want)
    assert "d" not in got
    words = spark.createDataFrame([(f"w{i:04d}",) for i in rng.permutation(900)], "w string").repartition(7)
    placed = order.with_position(words, ["w"]).collect()
    assert sorted(r["position"] for r in placed) == list(range(900)) and all(r["w"] == f"w{r['position']:04d}" for r in placed)
    assert order.exact_quantiles(df.limit(0), F.col("x"), {"q": 0.5}).first()["q"] is None
