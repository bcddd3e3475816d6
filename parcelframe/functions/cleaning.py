"""Value cleaning as Column expressions (JVM-side, codegen-friendly).

Each function maps Column(s) to a Column; none uses a Python UDF.
ANSI mode stays on: every conversion is a ``try_*`` behind a shape check.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BLANK_TOKENS, CATEGORY_WORDS, REST_CATEGORY, VERBATIM_BLANK_TOKENS

# Every character Python's ``str.strip()`` removes (``str.isspace``), built
# from that rule; a character-set trim is far cheaper than a Unicode regex.
WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
# A plain decimal number after spaces are removed and ',' became '.'.
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# A time of day behind a date: minutes at least, fractions up to nanoseconds; or by the half of the day.
_TIME = r"([0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:[.][0-9]{1,9})?)?)"
_HALF_DAY = r"^(.*[ ,-])(1[0-2]|0?[1-9])(:[0-9]{2}(?::[0-9]{2})?) *(?i:(a)|p)[.]?(?i:m)[.]?$"
_ZONE = r" *(Z|[+-][0-9]{2}:?[0-9]{2})"
_MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"
# Date layouts. Each has the date's pattern, its rewriting as year-month-day (# for a
# month's name) and what stands between date and time.
ISO = (r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})", "$1-$2-$3", "[ T]")
DAY_FIRST = (r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})", "$3-$2-$1", " ")
MONTH_FIRST = (r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})", "$3-$1-$2", " ")
MONTH_NAME_FIRST = (r"^[A-Za-z]{3}[a-z]*[.]?[ ,-]+([0-9]{1,2})[ ,-]+([0-9]{4})", "$2-#-$1", "[ ,-]+")
DAY_THEN_NAME = (r"^([0-9]{1,2})[ -]+[A-Za-z]{3}[a-z]*[.]?[ ,-]+([0-9]{4})", "$2-#-$1", "[ ,-]+")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Remove leading/trailing Unicode whitespace (tabs, NBSP, ...), not just spaces.

    Text that begins and ends with a visible ASCII character, as most does, has none."""
    s = _col(c).cast("string")
    visible = lambda x: (x > " ") & (x <= "~")
    return F.when(visible(F.substring(s, 1, 1)) & visible(F.substring(s, -1, 1)), s).otherwise(F.trim(s, F.lit(WHITESPACE)))


_MAX_TOKEN_BYTES = max(len(t.encode("utf-8")) for t in BLANK_TOKENS)


def is_blank_token(s: Column, tokens=BLANK_TOKENS) -> Column:
    """Case-insensitive membership in ``tokens``; only short strings are
    lower-cased (an O(1) byte-length test guards the allocation)."""
    return (F.octet_length(s) <= _MAX_TOKEN_BYTES) & F.lower(s).isin(*tokens)


def clean_text(s: Column, tokens=BLANK_TOKENS) -> Column:
    """``clean_str`` on text that is already stripped."""
    return F.when(is_blank_token(s, tokens), F.lit(None).cast("string")).otherwise(s)


def clean_str(c) -> Column:
    """Trimmed text; blank tokens (any case) become NULL."""
    return clean_text(strip_ws(c))


def clean_str_verbatim(c) -> Column:
    """Like ``clean_str`` but only true blanks become NULL (keeps 'X', '_')."""
    return clean_text(strip_ws(c), VERBATIM_BLANK_TOKENS)


def parse_float(s: Column) -> Column:
    """``to_float`` on text that is already stripped."""
    t = F.replace(F.replace(s, F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
    # The number pattern already rejects every blank token (none has a digit).
    return F.when(t.rlike(_NUMBER), t.try_cast("double"))


def to_float(c) -> Column:
    """Text to double: spaces removed, decimal comma accepted, junk to NULL."""
    return parse_float(strip_ws(c))


def to_int(c) -> Column:
    """Half-even rounding of ``to_float`` (Python ``round``), as int."""
    return F.bround(to_float(c), 0).try_cast("int")


def to_decimal(c, precision: int = 18, scale: int = 3) -> Column:
    return to_float(c).try_cast(f"decimal({precision},{scale})")


def _month_number(name: Column) -> Column:
    """1–12 as text for a month's first three letters; NULL for any other."""
    at = F.instr(F.lit(_MONTHS), F.upper(name))
    return F.when((at > 0) & (at % 3 == 1), ((at + 2) / 3).cast("int").cast("string"))


def day_hours(s: Column) -> Column:
    """A date's text with the time by the half of the day (3:04 pm) turned into hours of the day (15:04)."""
    # 12 stands for 0, and the afternoon comes 12 hours later
    hour = F.regexp_extract(s, _HALF_DAY, 2).try_cast("int") % 12 + F.when(F.regexp_extract(s, _HALF_DAY, 4) == "", 12).otherwise(0)
    year_first = F.substring(s, 2, 1).between("0", "9") & F.substring(s, 3, 1).between("0", "9")
    named = F.substring(s, -1, 1).isin("m", "M", ".") & ~year_first & s.rlike(_HALF_DAY)
    return F.when(named, F.concat(F.regexp_extract(s, _HALF_DAY, 1), hour.cast("string"), F.regexp_extract(s, _HALF_DAY, 3))).otherwise(s)


def _rewritten(s: Column, layout: tuple[str, str, str]) -> Column:
    """Text of one layout as ``yyyy-M-d[ H:mm[:ss[.f]]]``; other text stays as it is."""
    date, parts, gap = layout
    return F.regexp_replace(s, f"{date}(?:{gap}{_TIME})?$", f"{parts} ${parts.count('$') + 1}")


def canonical_date(s: Column) -> Column:
    """A date's text (with hours of the day) as ``yyyy-M-d[ H:mm[:ss[.f]]]``, where it has a known layout.

    Characters at fixed places choose the one layout that can fit, and one
    replacement rewrites it, so a value is never tried twice. 13 and above can
    only be a day. What fits no layout stays, or comes out without a part, and
    is no timestamp then. A zone (``Z`` or an offset) moves the value to UTC."""
    at = lambda k, n=1: F.substring(s, k, n)
    is_digit = lambda k: at(k).between("0", "9")
    plain_iso = s.rlike(f"{ISO[0]}(?:{ISO[2]}{_TIME})?$")
    zoned = f"{ISO[0]}{ISO[2]}{_TIME}{_ZONE}$"
    moved = F.to_utc_timestamp(F.regexp_replace(s, zoned, f"{ISO[1]} $4$5").try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz").cast("string")
    iso = F.when(plain_iso, F.when(at(5) == "-", s).otherwise(F.regexp_replace(s, f"{ISO[0]}T?", ISO[1]))).when(s.rlike(zoned), moved)
    after = F.when(is_digit(2), at(3)).otherwise(at(2))
    letter = F.when(is_digit(2), at(4)).otherwise(at(3)) >= "A"
    name_first = at(1) > "9"
    month = _month_number(F.when(name_first, at(1, 3)).otherwise(F.regexp_extract(s, "([A-Za-z]{3})", 1)))
    named = F.when(name_first, _rewritten(s, MONTH_NAME_FIRST)).otherwise(_rewritten(s, DAY_THEN_NAME))
    number = F.when((at(1, 2) >= "13") & is_digit(2), _rewritten(s, DAY_FIRST)).otherwise(_rewritten(s, MONTH_FIRST))
    return F.rtrim(F.when(is_digit(1) & is_digit(2) & is_digit(3), iso)
                   .when((name_first & (at(1) <= "z")) | (is_digit(1) & ((after == " ") | ((after == "-") & letter))), F.replace(named, F.lit("#"), month))
                   .when(is_digit(1) & after.isin("-", "/", "."), number))


def parse_datetime(s: Column) -> Column:
    """``to_datetime`` on text that is already stripped, in one expression (``ingest`` takes its steps in
    projections of their own). Bare numbers and blank tokens fit no layout and stay NULL."""
    step = lambda c, fn: F.element_at(F.transform(F.array(c), fn), 1)  # noqa: E731 — each step's text is made once
    return step(day_hours(s), canonical_date).try_cast("timestamp_ntz")


def to_datetime(c) -> Column:
    """Text to timestamp over a fixed ordered layout list; bare numbers are NULL."""
    return parse_datetime(strip_ws(c))


def is_delivered(last_event) -> Column:
    """Last event, trimmed and lower-cased, starts with 'envoi liv'; NULL is False."""
    return F.coalesce(F.lower(strip_ws(last_event)).startswith("envoi liv"), F.lit(False))


def crbt_flag(shipment_type) -> Column:
    """Type text equals CRBT after trim and upper-case; NULL is False."""
    return F.coalesce(F.upper(strip_ws(shipment_type)) == "CRBT", F.lit(False))


def is_crbt(shipment_type, crbt_amount) -> Column:
    return crbt_flag(shipment_type) | F.coalesce(_col(crbt_amount) > 0, F.lit(False))


def valid_month(c) -> Column:
    return F.when(_col(c).between(1, 12), _col(c))


def valid_year(c) -> Column:
    return F.when(_col(c).between(1900, 9999), _col(c))


def month_start(year, month) -> Column:
    """First day of the month from guarded parts; any invalid part gives NULL."""
    y = F.when(_col(year).between(1753, 9999), _col(year))
    m = F.when(_col(month).between(1, 12), _col(month))
    return F.make_date(y, m, F.lit(1))


def bureau_category(office) -> Column:
    """The first category with a word in the office's name, else the rest."""
    name = F.lower(_col(office))
    words = [(w, key) for key, listed in CATEGORY_WORDS.items() for w in listed]
    return F.coalesce(*[F.when(name.contains(w), F.lit(key)) for w, key in words], F.lit(REST_CATEGORY))


def capitalize_type(c) -> Column:
    """First letter upper, rest lower (Python ``str.capitalize``)."""
    s = strip_ws(c)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30)))


def parse_amount_or_zero(c, scale: int = 2) -> Column:
    """Comma/space tolerant number, failures count as 0, rounded half-even."""
    return F.bround(F.coalesce(to_float(c), F.lit(0.0)), scale)


def to_numeric_coerce(c) -> Column:
    """Any column to double through its text form (``to_float``); bad values become NULL."""
    return to_float(c)


def clip_lower_0(c) -> Column:
    return F.when(_col(c).isNull(), None).otherwise(F.greatest(_col(c), F.lit(0)))
