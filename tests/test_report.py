"""Report tables and drills: literal cases and invariants."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from parcelframe.operators import report as R

DRILL_SCHEMA = ("mailitm_fid string, last_event_region string, last_event_office string, last_event string, "
                "interval_days int, weight_kg double, depot_region string, depot_office string, "
                "shipment_type string, revenue_ca decimal(18,3)")


def test_import_drill_keeps_repeated_ids(spark):
    rows = [("A", "ARIANA", "KA", "Envoi Livré", 3, 3.4, None, None, None, None),
            ("B", "ARIANA", "KA", "Envoi Livré", 5, 5.0, None, None, None, None),
            ("A", "ARIANA", "KA", "Tenir", 1, 1.0, None, None, None, None)]
    d = R.import_drill(spark.createDataFrame(rows, DRILL_SCHEMA), "ARIANA")
    all_ = d.filter(F.col("subkey") == "__all__").collect()
    assert len(all_) == 3 and sorted(r["id"] for r in all_) == ["A", "A", "B"]
    assert d.filter(F.col("subkey") == "Tenir").count() == 1
    assert set(d.columns) == {"region", "office", "subkey", "id", "event", "interval", "poids"}


def test_export_drill_subkeys(spark):
    rows = [("X", None, None, None, None, 3.4, "ARIANA", "AG", "CRBT", Decimal(7)),
            ("Y", None, None, None, None, 2.0, "ARIANA", "AG", "Ordinaire", Decimal(5))]
    d = R.export_drill(spark.createDataFrame(rows, DRILL_SCHEMA), "ARIANA")
    keys = {(r["subkey"], r["id"]) for r in d.collect()}
    assert keys == {("__all__", "X"), ("__all__", "Y"), ("CRBT", "X"), ("Ordinaire", "Y")}


def test_depot_table_total_row(seed):
    t = R.depot_table(seed)
    for region in ("SFAX", "TUNIS"):
        rows = t.filter(F.col("region") == region).collect()
        total = [r for r in rows if r["is_total"]][0]
        body = [r for r in rows if not r["is_total"]]
        assert total["office"] == "TOTAL"
        assert total["nb_ids"] == sum(r["nb_ids"] for r in body)
        assert total["ca"] == sum(r["ca"] for r in body)


def test_livraison_pivot_and_drill(seed):
    t = R.livraison_table(seed)
    assert t.columns[3] == "Envoi Livré"  # 'envoi liv…' first
    tot = t.filter((F.col("region") == "SFAX") & F.col("is_total")).first()
    assert tot["total_ids"] == 2 and tot["crbt"] == 1 and tot["ordinaire"] == 1
    d = R.livraison_drill(seed, "SFAX")
    assert d.filter(F.col("subkey") == "CRBT").count() == 1
    assert d.filter(F.col("subkey") == "Ordinaire").count() == 1


def test_drill_pages_bounded(spark):
    """Page sizes, also where 3,000 entries of one office are equal and a third of all rows."""
    rows = [("same" if i < 3000 else f"id{i}", "HOT" if i < 6000 else f"o{i % 50}") for i in range(9000)]
    df = spark.createDataFrame(rows, "mailitm_fid string, depot_office string") \
        .withColumn("depot_region", F.lit("R")).withColumn("shipment_type", F.lit("Ordinaire")) \
        .withColumn("revenue_ca", F.lit(1).cast("decimal(18,3)"))
    d = R.depot_drill(df)
    pages = R.drill_pages(d, page_size=200).collect()
    assert max(len(p["entries"]) for p in pages) < 400
    assert sum(e["times"] for p in pages for e in p["entries"]) == d.count() == 9000
    assert [e["times"] for p in pages for e in p["entries"] if e["id"] == "same"] == [3000]


def test_raw_rows_are_stripped_once(spark):
    rows = [(" A ", " R", "X\t", "CRBT ", Decimal(7), 1.0), ("B", "R", " ", "CRBT", Decimal(1), 1.0)]
    raw = spark.createDataFrame(rows, "mailitm_fid string, depot_region string, depot_office string, shipment_type string, "
                                      "revenue_ca decimal(18,3), weight_kg double")
    t = {r["office"]: r for r in R.depot_table(R.stripped(raw), "R").collect()}
    assert set(t) == {"X", "TOTAL"} and t["X"]["crbt"] == t["TOTAL"]["nb_ids"] == 1


def test_report_parts_and_scopes(spark, seed):
    rows = seed.unionByName(seed.withColumn("source", F.lit("export"))).unionByName(seed.withColumn("source", F.lit("import")))
    parts = R.region_report(rows, "SFAX")
    assert len(parts) == 13 and parts["report_kpis"].first()["total"] == 2
    assert {r["office"] for r in parts["export_table"].collect()} == {"Agence Sfax", "TOTAL"}
    assert set(R.region_report(rows, include_depot=False)) & {"depot_table", "export_drill"} == set()
    assert set(R.region_report(rows, include_livraison=False)) & {"livraison_table", "import_drill"} == set()
    only = R.region_report(rows, None, ["(VIDE)"], cat_depot=["bureaux"])
    assert {r["office"] for r in only["depot_table"].where("not is_total").collect()} == {"Bureau Tunis"}
    assert R.region_report(rows, None, ["nowhere"])["depot_drill"].count() == 0


def test_empty_input(seed):
    none = seed.limit(0)
    for part in R.region_report(none).values():
        assert part.where("region IS NOT NULL").count() == 0
    assert R.drill_pages(R.depot_drill(none)).count() == 0 and R.event_order(none).count() == 0


def test_many_events(spark, seed):
    many = seed.crossJoin(spark.range(300)).withColumn("last_event", F.concat(F.lit("e"), "id"))
    assert len([c for c in R.livraison_table(many).columns if c.startswith("e")]) == 300
    assert R.livraison_table_long(many).where("is_total").count() >= 300


def test_scoped_kpis(spark, seed):
    exp = seed.withColumn("source", F.lit("export"))
    k = R.depot_kpis(seed.unionByName(exp), "SFAX")
    rows = {r["scope"]: r for r in k.collect()}
    assert rows["global"]["total"] == rows["national"]["total"] + rows["export"]["total"] == 4
    lk = {r["scope"]: r for r in R.livraison_kpis(seed, "SFAX").collect()}
    assert lk["national"]["taux"] == 50.0 and lk["global"]["avg_intervalle"] is None
