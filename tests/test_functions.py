"""Literal vectors for the cleaning functions (source system's cleaner tests)."""

import datetime as dt

from pyspark.sql import functions as F

from parcelframe.functions import cleaning as C
from parcelframe.functions import formatting as FM
from parcelframe.functions import temporal as TM


def _eval(spark, expr, values, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_to_float(spark):
    # Inside a number only ASCII spaces are dropped (as the source system does);
    # a narrow no-break space there makes the value unparseable. Edges are stripped.
    assert _eval(spark, C.to_float, ["4,3", "1 234,5", " ", "_", "7", "12d", "NaN", "1 000,25", "1\u202f000,25",
                                     "\u00a012,5\t"]) == \
        [4.3, 1234.5, None, None, 7.0, None, None, 1000.25, None, 12.5]


def test_to_int(spark):
    assert _eval(spark, C.to_int, ["3", "3,0", "nan", "2,5", "3,5"]) == [3, 3, None, 2, 4]


def test_to_datetime(spark):
    out = _eval(spark, C.to_datetime, ["Feb 11 2026 11:05", "X", None, "2026-02-11", "45123", "13/02/2026"])
    assert out[0] == dt.datetime(2026, 2, 11, 11, 5)
    assert out[1] is None and out[2] is None
    assert out[3] == dt.datetime(2026, 2, 11)
    assert out[4] is None  # bare numbers are not dates
    assert out[5] == dt.datetime(2026, 2, 13)  # day-first fallback


def test_clean_str(spark):
    assert _eval(spark, C.clean_str, [" ", "SFAX", "  x\t", "(VIDE)", "_", "NaN"]) == [None, "SFAX", "x", None, None, None]
    assert _eval(spark, C.clean_str_verbatim, ["X", "_", " ", "null"]) == ["X", "_", None, None]


def test_flags(spark):
    assert _eval(spark, C.is_delivered, ["Envoi Livré", "Recevoir envoi", None, "  envoi livre  "]) == \
        [True, False, False, True]
    df = spark.createDataFrame([("CRBT", None), ("Ordinaire", 0.0), (None, 12.0), (" crbt ", None)],
                               "t string, a double")
    assert [r[0] for r in df.select(C.is_crbt("t", "a")).collect()] == [True, False, True, True]


def test_guards_and_labels(spark):
    df = spark.createDataFrame([(2026, 2), (2026, 13), (None, 5), (1700, 1)], "y int, m int")
    out = [r[0] for r in df.select(C.month_start("y", "m")).collect()]
    assert out == [dt.date(2026, 2, 1), None, None, None]
    df = spark.createDataFrame([("Agence Centre",), ("CDC Sud",), ("Bureau X",), ("centre ville",)], "o string")
    assert [r[0] for r in df.select(C.bureau_category("o")).collect()] == ["agences", "centres", "bureaux", "centres"]
    assert _eval(spark, C.capitalize_type, ["CRBT", "ordinaire"]) == ["Crbt", "Ordinaire"]
    assert _eval(spark, lambda c: FM.fr_thousands(c), [1234567.5, 0.0, 2.5], "double") == ["1 234 568", "", "2"]
    assert _eval(spark, FM.safe_name, ["BEN AROUS", None, "a/b"]) == ["BEN_AROUS", "national", "a_b"]


def test_calendar(spark):
    df = spark.createDataFrame([(dt.date(2026, 12, 7),), (dt.date(2026, 12, 6),)], "d date")
    assert [r[0] for r in df.select(TM.weekday0("d")).collect()] == [0, 6]
    assert [r[0] for r in df.select(TM.weekday_name_fr("d")).collect()] == ["Lundi", "Dimanche"]
    df = spark.createDataFrame([(2026, 3), (None, 3), (2026, 0)], "y int, m int")
    assert [r[0] for r in df.select(TM.year_month_label("y", "m")).collect()] == ["2026-03", "—", "—"]
