"""KPIs, filters and dashboard group-bys on the three seed rows."""

from pyspark.sql import functions as F

from parcelframe.operators import aggregates as A
from parcelframe.operators import filters as FL
from parcelframe.operators import grouped as G


def test_kpi_summary(seed):
    k = A.kpi_summary(seed).first().asDict()
    assert k["total_shipments"] == 3 and k["delivered"] == 2 and k["failed"] == 1
    assert k["delivery_rate"] == 66.7
    assert k["total_crbt_count"] == 1 and k["late_deliveries"] == 1
    assert float(k["total_revenue"]) == 18.0 and float(k["total_crbt_amount"]) == 50.0
    assert k["avg_interval_days"] == 1.5  # delivered rows with interval >= 0: (2 + 1) / 2


def test_kpi_by_region_in_one_pass(seed):
    rows = {r["depot_region"]: r for r in A.kpi_summary(seed, by=["depot_region"]).collect()}
    assert rows["SFAX"]["total_shipments"] == 2 and rows["TUNIS"]["total_shipments"] == 1
    assert rows["SFAX"]["delivery_rate"] == 50.0


def test_empty_kpis(seed):
    k = A.kpi_summary(seed.filter(F.lit(False))).first()
    assert k["total_shipments"] == 0 and k["delivery_rate"] == 0.0 and k["avg_interval_days"] is None


def test_filters(seed):
    assert FL.filter_category(seed, ["agences"]).count() == 2
    assert FL.filter_category(seed, ["bureaux"]).count() == 1
    assert FL.filter_next_region(seed, ["(VIDE)"]).count() == 3
    assert FL.filter_next_region(seed, ["SFAX"]).count() == 0
    assert FL.filter_combined(seed, region="SFAX", categories=["agences"]).count() == 2


def test_group_bys(seed):
    by_region = {r[0]: r[1] for r in G.count_by_depot_region(seed).collect()}
    assert by_region == {"SFAX": 2, "TUNIS": 1}
    b = {r["band"]: r["shipments"] for r in G.weight_buckets(seed).collect()}
    assert b == {"0–2": 1, "2–5": 0, "5–10": 1, "10–20": 1, "20+": 0}
    assert [r[0] for r in G.distinct_next_regions(seed).collect()] == ["(VIDE)"]
    st = A.delivery_status_totals(seed).first()
    assert st["delivered"] + st["failed"] == st["total"]
