"""The entries of the drill pages are shuffled once for their cells' sizes and for the pages."""

from pyspark.sql import functions as F

from parcelframe.operators import report as R


def test_sizes_and_pages_share_the_shuffled_entries(spark):
    rows = [(f"id{i % 900}", f"o{i % 7}") for i in range(2000)]
    df = spark.createDataFrame(rows, "mailitm_fid string, depot_office string").withColumn("depot_region", F.lit("R")) \
        .withColumn("shipment_type", F.lit("Ordinaire")).withColumn("revenue_ca", F.lit(1).cast("decimal(18,3)"))
    pages = R.drill_pages(R.depot_drill(df), page_size=50)
    got = pages.collect()
    assert sum(e["times"] for p in got for e in p["entries"]) == 2000
    assert "ReusedExchange" in pages._jdf.queryExecution().executedPlan().toString()
