"""Grouped operators on a file stream give the batch result."""

import os
import tempfile

from parcelframe.operators import aggregates as A
from parcelframe.streaming.incremental import read_shipment_stream, start_grouped


def test_stream_kpis_match_batch(spark, seed):
    d = tempfile.mkdtemp(prefix="pf-stream-")
    path = os.path.join(d, "in")
    seed.write.parquet(path)
    q = start_grouped(lambda df: A.kpi_summary(df, by=["depot_region"]), read_shipment_stream(spark, path),
                      "kpi_stream_test", checkpoint=os.path.join(d, "ckpt"))
    try:
        q.processAllAvailable()
        got = {r["depot_region"]: r["total_shipments"] for r in spark.sql("SELECT * FROM kpi_stream_test").collect()}
    finally:
        q.stop()
    assert got == {"SFAX": 2, "TUNIS": 1}
