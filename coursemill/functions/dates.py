"""Date expressions. Every clinical date is kept at day grain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = r"^\s*(\d{1,2}/\d{1,2}/\d{4})"
_TIMED = {
    "none": _DAY,
    "minute": _DAY + r" \s*\d{1,2}:\d{1,2}",
    "second": _DAY + r" \s*\d{1,2}:\d{1,2}:\d{1,2}",
}


def parse_date(text: Column, time_part: str = "none") -> Column:
    """``month/day/year`` text to a date; anything unreadable becomes null.

    Trailing text is ignored. With ``time_part`` set to ``minute`` or ``second`` the clock part
    must be there as well, or the value is null.
    """
    day = F.regexp_extract(text, _TIMED[time_part], 1)
    return F.try_to_date(F.nullif(day, F.lit("")), "M/d/yyyy")


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days from ``earlier`` to ``later``."""
    return F.datediff(later, earlier)


def day_number(day: Column) -> Column:
    """Days since 1970-01-01, the integer axis used by range frames and time buckets."""
    return F.unix_date(day)


def age_years(at: Column, born: Column) -> Column:
    return F.datediff(at, born) / F.lit(365.25)
