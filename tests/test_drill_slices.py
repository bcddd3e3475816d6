"""Drill pages of entries that stand once: what they shuffle, and the same pages as the long form's."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from parcelframe.operators import report as R

from .conftest import SF001

FIELDS = ("id", "event", "type", "ca", "interval", "poids")


def _shuffled(plan) -> int:
    """Rows that the exchanges of an executed plan wrote, reused ones left out."""
    kind = plan.getClass().getSimpleName()
    if kind == "ReusedExchangeExec":
        return 0
    if kind == "AdaptiveSparkPlanExec":
        return _shuffled(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _shuffled(plan.plan())
    own = plan.metrics().get("shuffleRecordsWritten").get().value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(_shuffled(plan.children().apply(i)) for i in range(plan.children().size()))


def test_entries_are_not_shuffled_under_each_subkey(spark):
    """Once to be counted and once to their pages; the long form's rows were shuffled before."""
    pages = entry.queries()["drill_pages"](spark, SF001)
    long = sum(len(p["entries"]) for p in pages.collect())
    assert long > 5000 and _shuffled(pages._jdf.queryExecution().executedPlan()) < 0.9 * long


def _odd_rows(spark):
    """Events called as sub-keys are, blank ones, types in any case, equal rows, no region, a hot office, many small cells."""
    events = ["Envoi Livré", "Tenir", "", None, "CRBT", "Ordinaire", "__all__"]
    types = ["CRBT", "crbt", "Crbt", "Ordinaire", None, ""]
    rows = [(f"id{i % 1900}", events[i * 7 % 11 % 7] if i % 9 else f"rare {i % 60}", types[i % 1900 % 6], (i % 1900) % 5,
             "HOT" if i % 3 else f"o{i % 1900 % 4}", ("N", "S", None)[i % 1900 % 3 if i % 3 == 0 else 0]) for i in range(4000)]
    return spark.createDataFrame(rows, "mailitm_fid string, last_event string, shipment_type string, interval_days int, last_event_office string, last_event_region string") \
        .withColumn("revenue_ca", F.lit(1).cast("decimal(18,3)")).withColumn("weight_kg", F.lit(2.0))


@pytest.mark.parametrize("broadcast", [True, False])
def test_pages_are_those_of_the_long_form(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(R, "CELLS_SENT", 0)
    monkeypatch.setattr(R, "SLICE_PAGES", 20)
    df = _odd_rows(spark).cache()
    long = R.livraison_drill(df)
    got = R.drill_pages(R.livraison_drill(df, long=False), 5, R.livraison_subkeys()).collect()
    at = {(p["region"], p["office"], p["subkey"], p["page"]): p["entries"] for p in got}
    assert len(at) == len(got)  # a page comes in one piece
    want = Counter((r["region"], r["office"], r["subkey"], *[r[f] for f in FIELDS]) for r in long.collect())
    found = Counter()
    for (region, office, subkey, _), entries in at.items():
        for e in entries:
            found[(region, office, subkey, *[e[f] for f in FIELDS])] += e["times"]
    assert found == want and max(want.values()) > 1
    assert sum(len(p["entries"]) for p in got) == len(want)  # equal entries meet in one page
    sizes = Counter(k[:3] for k in want)
    assert all(k[3] < -(-sizes[k[:3]] // 5) for k in at) and max(len(e) for e in at.values()) < 20
    assert at == {(p["region"], p["office"], p["subkey"], p["page"]): p["entries"] for p in R.drill_pages(long, 5).collect()}
    df.unpersist()


def test_no_entries(spark):
    none = R.livraison_drill(_odd_rows(spark).limit(0), long=False)
    assert R.drill_pages(none, 5, R.livraison_subkeys()).collect() == []
