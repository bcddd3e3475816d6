"""The cleaning runs as compiled code whatever the session's settings."""

import contextlib
import io
import re

from parcelframe.plans.queries_ingest import DATE_STYLES, raw_extract
from parcelframe.sources import ingest as ing

from .conftest import SF001


def test_no_method_of_the_cleaning_is_beyond_what_the_jvm_compiles(spark):
    """8,000 bytes are the JVM's limit; Spark's own default keeps generated methods up to 65,535."""
    old = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    try:
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            ing.clean_shipments(ing.map_headers(raw_extract(spark, SF001))).explain("codegen")
    finally:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", old)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())]
    assert sizes and max(sizes) < 8000


def test_every_row_has_a_date_style(spark):
    raw = raw_extract(spark, SF001)
    assert "_style" not in raw.columns
    shapes = {re.sub("[A-Za-z]", "a", re.sub("[0-9]+", "9", r[0])) for r in raw.select("Date depot").collect()}
    assert len(shapes) >= len(DATE_STYLES) - 2
