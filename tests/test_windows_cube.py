"""Date ranges from sums by day, and the dashboard from one cube."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from parcelframe.operators import aggregates as A, cube as C, filters as FL, grouped as G, report as R, windows as W

from .conftest import SEED_SCHEMA

DAY = dt.date(2026, 1, 1)


def _rows(n=600, seed=1):
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)
    day = lambda: None if rng.random() < 0.1 else DAY + dt.timedelta(days=rng.randint(0, 90))
    return [(f"A{k}", pick("SFAX", "TUNIS", None), pick("Agence A", "Bureau B", "Centre C", "", None), pick("Envoi Livré", "Tenir", "x.y", "", None),
             rng.random() < 0.5, pick("CRBT", "Ordinaire", None), rng.random() < 0.3, pick(None, Decimal("1.125")), pick(None, Decimal("2.500"), Decimal("7.001")),
             pick(None, 0.125, 0.25, 12.5, 40.0), pick(None, -1, 0, 2, 9), pick(None, 2025, 2026), pick(None, 1, 2), pick(None, "SFAX", " ", "SOUSSE"), day(),
             pick("SFAX", "TUNIS", None), pick("Bureau S", "Agence T", "", None), day(), "national") for k in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(_rows(), SEED_SCHEMA).cache()
    yield df
    df.unpersist()


def _table(df):
    money = lambda v: round(float(v), 6) if isinstance(v, (float, Decimal)) else v
    return sorted((tuple((c, money(r[c])) for c in sorted(df.columns)) for r in df.collect()), key=str)


def _plain_depot(rows, lo, hi):
    """(region, office) → (crbt, ca, poids, ids), from the rows one by one."""
    out = {}
    for r in rows:
        if not r.depot_office or (r.deposit_date is not None and ((lo and r.deposit_date < lo) or (hi and r.deposit_date > hi))):
            continue
        for key in ((r.depot_region, r.depot_office, False), (r.depot_region, "TOTAL", True)):
            s = out.setdefault(key, [0, Decimal(0), 0.0, 0])
            s[0] += r.shipment_type == "CRBT"
            s[1] += r.revenue_ca or 0
            s[2] += r.weight_kg or 0
            s[3] += 1
    return out


def test_two_hundred_ranges(spark, rows, tmp_path):
    """All in one table of sums; each range equals the same sums over the rows themselves."""
    W.write_prefixes(rows, R.DEPOT, str(tmp_path / "days"))
    days, plain, rng = spark.read.parquet(str(tmp_path / "days")), rows.collect(), random.Random(2)
    ranges = [(None, None), (None, DAY), (DAY, None), (DAY + dt.timedelta(days=9), DAY), (DAY, DAY + dt.timedelta(days=900))]
    ranges += [tuple(sorted(DAY + dt.timedelta(days=rng.randint(-5, 95)) for _ in range(2))) for _ in range(195)]
    fine = [W.between(days, lo, hi).select(F.lit(k).alias("k"), "*") for k, (lo, hi) in enumerate(ranges)]
    got = {}
    for at in range(0, len(fine), 50):
        union = fine[at]
        for f in fine[at + 1:at + 50]:
            union = union.unionByName(f)
        for r in union.collect():
            for office, total in ((r.office, False), ("TOTAL", True)):
                s = got.setdefault(r.k, {}).setdefault((r.region, office, total), [0, Decimal(0), 0.0, 0])
                s[0] += r.n_crbt
                s[1] += r.ca_sum
                s[2] += r.poids_sum
                s[3] += r.n
    for k, (lo, hi) in enumerate(ranges):
        want = _plain_depot(plain, lo, hi) if not (lo and hi and lo > hi) else _plain_depot([r for r in plain if r.deposit_date is None], None, None)
        assert got.get(k, {}).keys() == want.keys()
        for key, s in want.items():
            assert got[k][key] == pytest.approx(s), (lo, hi, key)


@pytest.mark.parametrize("lo,hi,region,cats", [("2026-01-10", "2026-02-20", None, None), (None, "2026-01-31", "SFAX", None), ("2026-03-01", None, None, ["agences", "centres"])])
def test_window_tables_equal_those_of_the_rows(spark, rows, tmp_path, lo, hi, region, cats):
    for keys, new, old in ((R.DEPOT, W.depot_window, R.depot_table_window), (R.LIVRAISON, W.livraison_window, R.livraison_table_window)):
        path = str(tmp_path / keys["date"])
        W.write_prefixes(rows, keys, path)
        days = spark.read.parquet(path)
        got = new(days, lo, hi, region, cats)
        assert _table(got) == _table(old(rows, lo, hi, region, cats)) and got.columns == old(rows, lo, hi, region, cats).columns
        assert all(path in f for f in W.between(days, lo, hi).inputFiles())  # no shipment file


def test_empty_days(spark, rows):
    days = W.day_prefixes(rows.limit(0), R.DEPOT)
    assert W.depot_window(days, "2026-01-01", None).count() == 0
    assert R.livraison_table(rows.limit(0)).count() == 0


def test_delivery_table_of_many_events(spark, rows):
    many = rows.withColumn("last_event", F.concat(F.lit("event "), F.pmod(F.xxhash64("mailitm_fid"), F.lit(400)))).cache()
    wide = R.livraison_table(many)
    events = [c for c in wide.columns if c.startswith("event ")]
    assert len(events) == many.where(F.col("last_event_office") != "").select("last_event").distinct().count() > 200
    long = {(r.region, r.office, r.event): r.n for r in R.livraison_table_long(many).collect()}
    for r in wide.collect():
        assert {e: r[e] for e in events if r[e]} == {e: n for (region, office, e), n in long.items() if (region, office) == (r.region, r.office)}


FILTERS = [(None, None, None), ("SFAX", None, None), (None, ["(VIDE)", "SFAX"], None), ("TUNIS", ["SOUSSE"], ["agences", "bureaux"]), ("NOWHERE", None, None)]


@pytest.mark.parametrize("region,nexts,cats", FILTERS)
def test_all_parts_of_the_dashboard(spark, rows, region, nexts, cats):
    scoped, unscoped = FL.filter_combined(rows, region, nexts, cats), FL.filter_combined(rows, None, nexts, cats)
    want = {"regions": G.distinct_regions(rows), "kpis": A.kpi_summary(scoped), "by_region": G.count_by_depot_region(unscoped),
            "by_office": G.count_by_depot_office(scoped, 15), "delivery_status": A.delivery_status_totals(scoped), "failure_causes": G.failure_causes(scoped, 12),
            "monthly": G.monthly_evolution(scoped), "weight_stats": A.weight_stats(scoped), "weight_buckets": G.weight_buckets(scoped),
            "revenue_by_region": G.revenue_by_region(unscoped)}
    # one cube for every filter, merged from those of two loads
    halves = [C.dashboard_cube(rows.where(F.xxhash64("mailitm_fid") % 2 == k)) for k in (0, 1, -1)]
    got = C.dashboard_from(C.merge_cubes(halves), region, nexts, cats)
    assert got.keys() == want.keys()
    for part in want:
        assert got[part].columns == want[part].columns and _table(got[part]) == _table(want[part]), part


def test_dashboard_reads_the_rows_once(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "rows"))
    parts = C.dashboard_bundle(spark.read.parquet(str(tmp_path / "rows")), "SFAX")
    assert all("FileScan" not in p._jdf.queryExecution().toString() and not p.inputFiles() for p in parts.values())  # only the written cube
    assert C.dashboard_cube(rows)._jdf.queryExecution().toString().count("Exchange") <= 2
