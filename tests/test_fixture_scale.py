"""Tasks of the fact's derivation hold a bounded number of lines."""

import contextlib
import io
import re

from parcelframe.sources import fixtures

from .conftest import SF001


def test_partitions_of_the_order_join_follow_the_lines(spark, monkeypatch):
    want = sorted(map(tuple, fixtures.derive_shipments(spark, SF001).select("mailitm_fid", "depot_office", "last_event_office", "source").collect()))
    lines = fixtures.read_table(spark, SF001, "lineitem").count()
    monkeypatch.setattr(fixtures, "ROWS_A_TASK", 100)
    fine = fixtures.derive_shipments(spark, SF001)
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        fine.explain()
    assert f", {-(-lines // 100)}), REPARTITION_BY_NUM" in out.getvalue()
    assert sorted(map(tuple, fine.select("mailitm_fid", "depot_office", "last_event_office", "source").collect())) == want and len(want) == lines


def test_lines_are_shuffled_narrow_only(spark):
    """Where suppliers are too many to broadcast, no exchange holds lines together with what their orders or nations add."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            fixtures.derive_shipments(spark, SF001).explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    blocks = [b for b in out.getvalue().split("\n\n") if re.match(r"\s*\(\d+\) Exchange", b)]
    lines = [b for b in blocks if "l_quantity" in b]
    assert lines and all("o_totalprice" not in b and "n_name" not in b and "_nation#" not in b for b in lines)
    assert len(lines) == 2  # by supplier and by order


def test_the_written_fact_comes_from_bounded_tasks_whatever_is_broadcast(spark, monkeypatch):
    """The tasks that write the fact are as many as its lines ask for, also where suppliers are shuffled."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(fixtures, "ROWS_A_TASK", 400)
    try:
        lines = fixtures.read_table(spark, SF001, "lineitem").count()
        assert fixtures.derive_shipments(spark, SF001).rdd.getNumPartitions() == -(-lines // 400)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
