"""Labels, bands and display formats as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weight bands of the dashboard, (low, high, label), [low, high).
WEIGHT_BANDS = [(0, 2, "0–2"), (2, 5, "2–5"), (5, 10, "5–10"), (10, 20, "10–20"), (20, 9999, "20+")]

# Weight classes of the exploration notebook, [low, high).
WEIGHT_CLASSES = [(0, 1, "<1 kg"), (1, 5, "1-5 kg"), (5, 10, "5-10 kg"), (10, 30, "10-30 kg"),
                  (30, 70, "30-70 kg"), (70, None, ">70 kg")]

# Status labels.
DELIVERED_LABEL = "Livré"
NOT_DELIVERED_LABEL = "Non livré"
UNKNOWN_LABEL = "(inconnu)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def delivery_status_label(is_delivered) -> Column:
    return F.when(_col(is_delivered), F.lit(DELIVERED_LABEL)).otherwise(F.lit(NOT_DELIVERED_LABEL))


def unknown_label(c) -> Column:
    return F.coalesce(_col(c), F.lit(UNKNOWN_LABEL))


def weight_band(c) -> Column:
    """Band label; NULL, negative and >= 9999 fall in no band."""
    x = _col(c)
    expr = None
    for lo, hi, label in WEIGHT_BANDS:
        cond = (x >= lo) & (x < hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def weight_class(c) -> Column:
    x = _col(c)
    expr = None
    for lo, hi, label in WEIGHT_CLASSES:
        cond = (x >= lo) if hi is None else ((x >= lo) & (x < hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def fr_thousands(c, zero: str = "") -> Column:
    """0 decimals, half-even, space as thousands separator; zero shown as ``zero``."""
    x = _col(c).cast("double")
    txt = F.regexp_replace(F.format_number(F.bround(x, 0), 0), ",", " ")
    return F.when(F.coalesce(x, F.lit(0.0)) == 0, F.lit(zero)).otherwise(txt)


def safe_name(c) -> Column:
    """File-system safe name: non ``[A-Za-z0-9_-]`` become ``_``; NULL is 'national'."""
    return F.coalesce(F.regexp_replace(_col(c), r"[^A-Za-z0-9_-]", "_"), F.lit("national"))


def display_key(c) -> Column:
    """Group key as shown: NULL or empty becomes ``—``."""
    return F.coalesce(F.nullif(_col(c), F.lit("")), F.lit("—"))
