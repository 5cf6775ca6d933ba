"""Calendar days written in many notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Day number of 9999-12-31, the end of an interval without one.
FOREVER = 2932896

# Digits as they occur in written days.
_WIDE = "０１２３４５６７８９〇零一二三四五六七八九"
_DIGITS = "012345678900123456789"

_SEPARATED = r"^([0-9]{4})\s*[-/.年－／．]\s*([0-9十]{1,3})\s*[-/.月－／．]\s*([0-9十]{1,3})\s*[日号]?(?:[T\s].*)?$"
_COMPACT = r"^([0-9]{4})([0-9]{2})([0-9]{2})(?:[T\s].*)?$"
_BLANK = r"^[\s\u3000\u00a0\ufeff]+|[\s\u3000\u00a0\ufeff]+$"


def _number(part: Column) -> Column:
    """A month or day number in which 十 may stand for ten."""
    part = F.regexp_replace(part, "^十$", "10")
    part = F.regexp_replace(part, "^十([0-9])$", "1$1")
    part = F.regexp_replace(part, "^([0-9])十$", "$10")
    return F.lpad(F.regexp_replace(part, "十", ""), 2, "0")


def parse_day(text: Column) -> Column:
    """Day number (days since 1970-01-01) of a day written year, month, day.

    Separators ``- / .`` and 年月日, compact digits, full-width and Chinese digits,
    surrounding blanks and a trailing time of day are understood.  Null, blank and
    anything that is no calendar day (30 February, month 13, year 0) gives null.
    """
    plain = F.translate(F.regexp_replace(text, _BLANK, ""), _WIDE, _DIGITS)
    year, month, day = (F.regexp_extract(plain, _COMPACT, i) for i in (1, 2, 3))
    y2, m2, d2 = (F.regexp_extract(plain, _SEPARATED, i) for i in (1, 2, 3))
    compact = plain.rlike(_COMPACT)
    written = F.when(compact, F.concat_ws("-", year, month, day)).otherwise(F.concat_ws("-", y2, _number(m2), _number(d2)))
    return F.unix_date(F.try_to_date(F.when(written.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), written), "yyyy-MM-dd"))


def day_text(number: Column) -> Column:
    """``YYYY-MM-DD`` of a day number."""
    return F.date_format(F.date_from_unix_date(number.cast("int")), "yyyy-MM-dd")
