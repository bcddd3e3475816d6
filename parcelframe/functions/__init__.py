"""Scalar Column functions: cleaning, calendar, labels and formats."""

from .cleaning import (bureau_category, capitalize_type, clean_str, clean_str_verbatim,  # noqa: F401
                       clip_lower_0, crbt_flag, is_crbt, is_delivered, month_start,
                       parse_amount_or_zero, strip_ws, to_datetime, to_decimal, to_float, to_int,
                       to_numeric_coerce, valid_month, valid_year)
from .formatting import (delivery_status_label, display_key, fr_thousands, safe_name,  # noqa: F401
                         unknown_label, weight_band, weight_class)
from .temporal import (calendar_parts, cyclic_parts, date_day, date_label, delay_days,  # noqa: F401
                       is_business_day, weekday0, weekday_name_fr, year_month_label)
