"""Rules of the raw extracts: layouts, blanks, headers, reloads, audit."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from parcelframe.functions import cleaning as C
from parcelframe.operators import aggregates, filters
from parcelframe.schema import COLUMN_MAP, fold_header
from parcelframe.sources import ingest as ing

T = dt.datetime


@pytest.mark.parametrize("text,want", [
    ("2026-02-11 11:05:33.500", T(2026, 2, 11, 11, 5, 33, 500000)), ("2026-02-11T11:05:33Z", T(2026, 2, 11, 11, 5, 33)),
    ("2026-02-11T11:05:33+02:00", T(2026, 2, 11, 9, 5, 33)), ("11/02/2026 11:05:33", T(2026, 11, 2, 11, 5, 33)),
    ("11-02-2026", T(2026, 11, 2)), ("25/12/2026", T(2026, 12, 25)), ("2026/02/11", T(2026, 2, 11)),
    ("Feb 11 2026 11:05:33", T(2026, 2, 11, 11, 5, 33)), ("Feb 11 2026 11:05AM", T(2026, 2, 11, 11, 5)),
    ("Feb 11 2026 11:05 pm", T(2026, 2, 11, 23, 5)), ("11 Feb 2026", T(2026, 2, 11)), ("February 11, 2026", T(2026, 2, 11)),
    ("2026-13-45", None), ("20260211", None), ("nan", None), ("", None), (None, None)])
def test_date_layouts(spark, text, want):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(C.to_datetime("s")).first()[0] == want


def test_rate_ties_go_to_even(spark, seed):
    sixteen = spark.range(16).select((F.col("id") == 0).alias("is_delivered"), F.lit(1).alias("interval_days"), F.lit(False).alias("is_crbt"),
                                     F.lit(1).cast("decimal(18,3)").alias("revenue_ca"), F.lit(1).cast("decimal(18,3)").alias("crbt_amount"))
    assert aggregates.kpi_summary(sixteen).first().delivery_rate == 6.2


def _raw(spark, rows):
    return spark.createDataFrame(rows, "MAILITM_FID string, `Bureau depot` string")


def test_empty_reload_leaves_no_old_rows(spark, tmp_path):
    path, audit = str(tmp_path / "t"), str(tmp_path / "audit")
    ing.import_all(spark, {"export": _raw(spark, [("1", "a"), ("2", "b")]), "import": _raw(spark, [("3", "c")])}, path, audit_path=audit)
    empty = _raw(spark, [("x", "y")]).limit(0)
    got = ing.import_all(spark, {"export": empty, "bad": spark.createDataFrame([("z",)], "other string")}, path, audit_path=audit).collect()
    assert [r.mailitm_fid for r in ing.read_table(spark, path).collect()] == ["3"]
    assert [(r.status, r.rows_read, r.rows_inserted) for r in got] == [("success", 0, 0), ("failed", 1, 0)]
    assert spark.read.parquet(audit).count() == 4


def test_json_numbers_keep_their_spelling(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"poids": 1.10, "CA": 100000000.0, "x": true}\n{"poids": "2,5"}\n')
    for columns in (None, ["poids", "CA"]):
        rows = ing.scan_shipments(spark, str(tmp_path / "a.json"), "json", columns=columns).select("poids", "CA").collect()
        assert sorted((r.poids, r.CA) for r in rows) == [("1.10", "100000000.0"), ("2,5", None)]


def test_quoted_line_break_is_one_record(spark, tmp_path):
    (tmp_path / "a.csv").write_text('MAILITM_FID,Exp_adresse\n1,"a\nb"\n2,c\n')
    got = ing.scan_shipments(spark, str(tmp_path / "a.csv"), options={"multiLine": True}).collect()
    assert sorted((r.MAILITM_FID, r.Exp_adresse) for r in got) == [("1", "a\nb"), ("2", "c")]


@pytest.mark.parametrize("header_row,title", [(0, ""), (1, "title,\n")])
def test_file_of_another_column_order_fails(spark, tmp_path, header_row, title):
    (tmp_path / "a.csv").write_text(title + "MAILITM_FID,Bureau depot\n1,x\n")
    (tmp_path / "b.csv").write_text(title + "Bureau depot,MAILITM_FID\ny,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        ing.scan_shipments(spark, str(tmp_path), header_row=header_row).collect()


def test_headers_fold_to_letters_and_digits():
    assert fold_header(" Exp_CITÉ ") == fold_header("exp cite") == "expcite" and fold_header("n°2-ﬁ") == "n2fi"
    names = ing.header_lookup(["région_next", "MAILITM FID", "unknown"])
    assert names == {"next_region": "région_next", "mailitm_fid": "MAILITM FID"} and len(COLUMN_MAP) == 33


def test_office_categories(spark):
    df = spark.createDataFrame([("Agence X",), ("CDC agence",), ("Centre",), ("Bureau",), (None,)], "depot_office string")
    names = lambda cats: [r[0] for r in filters.filter_category(df, cats).collect()]
    assert names(["agences"]) == ["Agence X", "CDC agence"] and names(["centres"]) == ["CDC agence", "Centre"]
    assert names(["bureaux"]) == ["Bureau"] and names(["bureaux", "agences"]) == ["Agence X", "CDC agence", "Bureau"]
    assert len(names([])) == len(names(["other"])) == 5
    region = spark.createDataFrame([("A",), ("",), (None,), ("B",)], "next_region string")
    picks = lambda x: [r[0] for r in filters.filter_next_region(region, x).collect()]
    assert picks(["(VIDE)"]) == ["", None] and picks(["A", "(VIDE)"]) == ["A", "", None] and picks(["B"]) == ["B"] and len(picks([])) == 4


@pytest.mark.parametrize("text,want", [
    ("2/3/2026", T(2026, 2, 3)), ("13/2/2026", T(2026, 2, 13)), ("2/13/2026 5:06", T(2026, 2, 13, 5, 6)), ("31.12.2026", T(2026, 12, 31)),
    ("12/31/2026 12:05 AM", T(2026, 12, 31, 0, 5)), ("12/31/2026 12:05:09 p.m.", T(2026, 12, 31, 12, 5, 9)), ("2/30/2026", None), ("13/13/2026", None),
    ("2026.2.3 04:05:06.123456789", T(2026, 2, 3, 4, 5, 6, 123456)), ("2026-2-3T04:05", T(2026, 2, 3, 4, 5)), ("2026/12/03T04:05:06+0130", T(2026, 12, 3, 2, 35, 6)),
    ("2026-02", None), ("2026", None), ("2026-02-11 25:00", None), ("2026-02-11 x", None), ("1/2/26", None), ("Sept. 5, 2026 3:04 pm", T(2026, 9, 5, 15, 4)),
    ("3-Mar-2026", T(2026, 3, 3)), ("03 march, 2026 23:59:59", T(2026, 3, 3, 23, 59, 59)), ("Foo 3 2026", None), ("3 Anf 2026", None), ("may", None),
    ("12:30", None), ("-5", None), ("now", None), ("2026-02-11 11:05 pm", None), ("1.5", None), ("é", None), ("1/2/2026 13:00 pm", None), ("9", None), ("M", None)])
def test_more_date_layouts(spark, text, want):
    df = spark.createDataFrame([(text,), (f" {text} ",)], "s string")
    assert [r[0] for r in df.select(C.to_datetime("s")).collect()] == [want, want]


def test_strip_is_that_of_python(spark):
    texts = [a + b + c for a in ("", " ", "\t", " ", " 　", "\x1f") for b in ("", "x", "é", "a b", "​q​", "日本") for c in ("", "\n", "  ", "~")]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "s string")
    got = [tuple(r) for r in df.select("s", C.strip_ws("s")).collect()]
    assert got == [(t, t.strip()) for t in texts] + [(None, None)]


def test_another_spelling_of_the_header_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("title,\nMAILITM_FID,Bureau depot\n1,x\n")
    (tmp_path / "b.csv").write_text("title,\nBureau depot,mailïtm fid\nSFAX,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        ing.scan_shipments(spark, str(tmp_path), header_row=1).collect()
