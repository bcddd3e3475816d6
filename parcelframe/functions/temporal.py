"""Calendar and date Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# French weekday names, Monday first.
WEEKDAY_NAMES_FR = ["Lundi", "Mardi", "Mercredi", "Jeudi", "Vendredi", "Samedi", "Dimanche"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def weekday0(c) -> Column:
    """Day of week with Monday = 0 … Sunday = 6."""
    return F.weekday(_col(c))


def is_business_day(c) -> Column:
    return F.weekday(_col(c)) < 5


def date_day(c) -> Column:
    return F.to_date(_col(c))


def date_label(c) -> Column:
    """``YYYY-MM-DD`` text, or ``""`` when the value is missing or bad."""
    return F.coalesce(F.date_format(F.to_date(_col(c)), "yyyy-MM-dd"), F.lit(""))


def year_month_label(year, month) -> Column:
    """``YYYY-MM`` when both parts are present and non-zero, else ``—``."""
    y, m = _col(year), _col(month)
    ok = y.isNotNull() & m.isNotNull() & (y != 0) & (m != 0)
    return F.when(ok, F.format_string("%d-%02d", y, m)).otherwise(F.lit("—"))


def weekday_name_fr(c) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in WEEKDAY_NAMES_FR]), F.weekday(_col(c)) + 1)


def delay_days(start, end) -> Column:
    """Whole days from ``start`` to ``end``."""
    return F.datediff(F.to_date(_col(end)), F.to_date(_col(start)))


def calendar_parts(ds: str = "ds") -> dict[str, Column]:
    """Calendar features of a date column."""
    d = F.col(ds)
    return {
        "dayofweek": F.weekday(d),
        "day": F.dayofmonth(d),
        "month": F.month(d),
        "quarter": F.quarter(d),
        "year": F.year(d),
        "weekofyear": F.weekofyear(d),
        "is_month_start": (F.dayofmonth(d) == 1).cast("int"),
        "is_month_end": (F.last_day(d) == d).cast("int"),
    }


def cyclic_parts(ds: str = "ds") -> dict[str, Column]:
    """sin/cos encodings of weekday (period 5) and month (period 12)."""
    d = F.col(ds)
    two_pi = 2 * math.pi
    return {
        "dow_sin": F.sin(F.lit(two_pi) * F.weekday(d) / 5),
        "dow_cos": F.cos(F.lit(two_pi) * F.weekday(d) / 5),
        "month_sin": F.sin(F.lit(two_pi) * F.month(d) / 12),
        "month_cos": F.cos(F.lit(two_pi) * F.month(d) / 12),
    }
