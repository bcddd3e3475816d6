"""Row filters. All are plain predicates, so Catalyst pushes them through
the joins of the shipment derivation and into the Parquet scan where the
column comes straight from a file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import strip_ws
from ..schema import CATEGORY_WORDS, REST_CATEGORY, VIDE

LATE_THRESHOLD_DAYS = 3


def region_condition(region: str | None, column: str = "depot_region") -> Column | None:
    return None if not region else (F.col(column) == F.lit(region))


def any_of(conditions) -> Column | None:
    """One condition that holds where any does; None for none."""
    found = list(conditions)
    return reduce(Column.__or__, found) if found else None


def next_region_condition(next_regions, column: str = "next_region") -> Column | None:
    """Membership in a list where ``(VIDE)`` stands for a missing value, NULL or empty; no list, no filter."""
    wanted = {"" if r == VIDE else r for r in next_regions or ()}
    if not wanted:
        return None
    member = F.col(column).isin(*sorted(wanted))
    return member | F.col(column).isNull() if VIDE in next_regions else member


def category_predicates(column: str = "depot_office") -> dict[str, Column]:
    """What makes an office one of each category (case-insensitive substrings).

    The rest are offices with none of the words; a NULL office is in no category."""
    name = F.lower(F.col(column))
    named = {key: any_of(name.contains(w) for w in words) for key, words in CATEGORY_WORDS.items()}
    return named | {REST_CATEGORY: ~any_of(named.values())}


def category_condition(categories, column: str = "depot_office") -> Column | None:
    """Offices of any of the given categories; unknown ones count for nothing."""
    return any_of(p for key, p in category_predicates(column).items() if key in set(categories or ()))


def combine(*conds: Column | None) -> Column | None:
    real = [c for c in conds if c is not None]
    return reduce(lambda a, b: a & b, real) if real else None


def apply(df: DataFrame, cond: Column | None) -> DataFrame:
    return df if cond is None else df.filter(cond)


def filter_region(df: DataFrame, region: str | None, column: str = "depot_region") -> DataFrame:
    return apply(df, region_condition(region, column))


def filter_region_stripped(df: DataFrame, region: str | None, column: str = "depot_region") -> DataFrame:
    """``strip(region) = r``; ``None`` keeps every region."""
    if not region:
        return df
    return df.filter(strip_ws(column) == F.lit(region))


def filter_next_region(df: DataFrame, next_regions, column: str = "next_region") -> DataFrame:
    return apply(df, next_region_condition(next_regions, column))


def filter_category(df: DataFrame, categories, column: str = "depot_office") -> DataFrame:
    return apply(df, category_condition(categories, column))


def filter_combined(df: DataFrame, region=None, next_regions=None, categories=None) -> DataFrame:
    return apply(df, combine(region_condition(region), next_region_condition(next_regions),
                             category_condition(categories)))


def filter_late(df: DataFrame, threshold: int = LATE_THRESHOLD_DAYS) -> DataFrame:
    return df.filter(F.col("interval_days") > threshold)


def filter_sane_interval(df: DataFrame) -> DataFrame:
    return df.filter(F.col("is_delivered") & (F.col("interval_days") >= 0))


def filter_business_days(df: DataFrame, ds: str = "ds") -> DataFrame:
    return df.filter(F.weekday(F.col(ds)) < 5)


def filter_date_range(df: DataFrame, column: str, lo=None, hi=None) -> DataFrame:
    """Keep rows with no date, or a date inside ``[lo, hi]`` (open bound = data min/max).

    An open bound needs no scan: a missing bound is simply not tested,
    which equals testing against the data's own min or max.
    """
    d = F.col(column)
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (d >= F.lit(lo).cast("date"))
    if hi is not None:
        cond = cond & (d <= F.lit(hi).cast("date"))
    return df.filter(d.isNull() | cond)


def filter_delay_bounds(df: DataFrame, column: str = "delay_days", lo: int = 0, hi: int = 30) -> DataFrame:
    return df.filter(F.col(column).between(lo, hi))


def filter_has_key(df: DataFrame, id_col: str = "mailitm_fid", office_col: str = "depot_office") -> DataFrame:
    """Non-empty trimmed id and office."""
    return df.filter((F.coalesce(strip_ws(id_col), F.lit("")) != "")
                     & (F.coalesce(strip_ws(office_col), F.lit("")) != ""))


def drop_na(df: DataFrame, subset) -> DataFrame:
    return df.dropna(how="any", subset=list(subset))


def drop_all_na(df: DataFrame, subset=None) -> DataFrame:
    return df.dropna(how="all", subset=list(subset) if subset else None)


def select_numeric(df: DataFrame) -> DataFrame:
    numeric = ("int", "bigint", "smallint", "tinyint", "double", "float")
    return df.select([c for c, t in df.dtypes if t in numeric or t.startswith("decimal")])


# Clean column → French label of the report frame.
FRENCH_LABELS = [
    ("mailitm_fid", "MAILITM_FID"), ("weight_kg", "poids"), ("crbt_amount", "CRBT"),
    ("shipment_type", "CRBT/ORD"), ("revenue_ca", "CA"), ("deposit_date", "Date depot"),
    ("depot_office", "Bureau depot"), ("depot_region", "Region Depot"), ("last_event", "Dernier E"),
    ("last_event_date", "Date dernier E"), ("last_event_office", "Bureau dernier E"),
    ("last_event_region", "Region dernier E"), ("next_region", "Region Next"),
    ("interval_days", "Intervalle en jours"),
]


def project_french(df: DataFrame) -> DataFrame:
    """Typed 14-column projection with French labels (types are kept)."""
    return df.select([F.col(c).alias(lbl) for c, lbl in FRENCH_LABELS])


def scan_report_columns(df: DataFrame, next_regions=None) -> DataFrame:
    """The report frame: next-region filter, then the 14 report columns."""
    return project_french(filter_next_region(df, next_regions))


ML_COLUMNS = ["depot_office", "depot_region", "last_event_office", "last_event_region",
              "is_delivered", "interval_days", "revenue_ca", "crbt_amount", "is_crbt",
              "weight_kg", "deposit_date", "shipment_type"]


def scan_ml_columns(df: DataFrame, columns=None, limit: int | None = None) -> DataFrame:
    out = df.select(list(columns or ML_COLUMNS))
    return out.limit(limit) if limit else out
