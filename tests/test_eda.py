"""Exploration statistics on the seed rows, checked by hand."""

from parcelframe.operators import eda as E
from parcelframe.operators import reshape as RS
from parcelframe.operators import topk as TK


def test_missing_profile(seed):
    rows = {r["column_name"]: (r["missing"], r["missing_pct"])
            for r in E.missing_profile(seed, ["crbt_amount", "next_region", "weight_kg"]).collect()}
    assert rows == {"next_region": (3, 100.0), "crbt_amount": (2, 66.67)}


def test_histogram_edges(seed):
    h = E.histogram(seed, "weight_kg", bins=2).orderBy("bin").collect()  # weights 5, 12, 1
    assert [r["n"] for r in h] == [2, 1]
    assert h[0]["lower"] == 1.0 and h[1]["upper"] == 12.0


def test_describe_exact_and_approx(seed):
    d = E.describe(seed, "weight_kg").first()
    assert (d["count"], d["min"], d["q50"], d["max"]) == (3, 1.0, 5.0, 12.0)
    assert d["q25"] == 3.0 and d["q75"] == 8.5  # linear interpolation, as pandas
    a = E.describe(seed, "weight_kg", exact=False).first()
    assert a["q50"] == 5.0


def test_ecdf_and_duplicates(seed):
    e = {r["interval_days"]: r["ecdf"] for r in E.ecdf(seed, "interval_days").collect()}
    assert e[1] == 1 / 3 and e[9] == 1.0
    assert RS.count_duplicates(seed.select("depot_office")).first()["duplicates"] == 1
    top = TK.top_n_groups_by_count(seed, "depot_region", 1).first()
    assert (top["depot_region"], top["n"]) == ("SFAX", 2)


def test_aggregate_top_groups_and_month_pivot(spark):
    import datetime as dt
    from pyspark.sql import functions as F
    rows = [("A", dt.date(2026, 1, 5), 1.0), ("A", dt.date(2026, 1, 6), 1.0), ("B", dt.date(2026, 2, 2), 10.0),
            ("C", dt.date(2026, 1, 7), 1.0), ("C", dt.date(2026, 2, 3), 1.0), ("D", dt.date(2026, 2, 4), 0.5)]
    df = spark.createDataFrame(rows, "g string, d date, w double")
    _, by_count = TK.aggregate_top_groups(df, F.date_format("d", "yyyy-MM"), "g", "w", 2, "count")
    _, by_sum = TK.aggregate_top_groups(df, F.date_format("d", "yyyy-MM"), "g", "w", 2, "sum")
    assert by_count == ["A", "C"]  # 2 rows each, tie broken by name; B has 1
    assert by_sum == ["B", "A"]  # 10.0, then A and C tie at 2.0 → A
    p = {r["month"]: (r["A"], r["C"]) for r in RS.pivot_group_month(df, "d", "g", "w", 2).collect()}
    assert p == {"2026-01": (2.0, 1.0), "2026-02": (0.0, 1.0)}  # months without A filled with 0
