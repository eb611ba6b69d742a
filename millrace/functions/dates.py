"""Dates in mixed notations, and coarse periods, as column expressions.

Three tokens with optional ``-`` and ``/`` between: year first when the first
token has four digits, else month first. A month may be a three-letter name as
the second token when the year is first. Days up to 31 run over into the next
month (February 31 is March 3).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The notation's tokens and month names.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
DATE = r"(\d{1,4})-?/?(" + "|".join(MONTHS) + r"|\d{1,2})-?/?(\d{1,4})"
TIME = r"[T-]?\s?(\d{1,2})?[:.]?(\d{1,2})?[:.]?(\d{1,2})?[.,]?(\d+)?\s?([+-])?(\d{1,2})?[:.]?(\d{1,2})?"


def parse_date(text: Column, strict: bool = False) -> Column:
    """A date, or null where the text (8 characters at least) holds none."""
    up = F.upper(text)
    pattern = f"^{DATE}$" if strict else DATE
    a, b, c = (F.regexp_extract(up, pattern, k) for k in (1, 2, 3))
    year_first = F.length(a) == 4
    number = lambda x: x.try_cast("int")
    month_token = F.when(year_first, b).otherwise(a)
    name = F.array_position(F.array(*(F.lit(m) for m in MONTHS)), month_token)
    month = F.when(name > 0, name.cast("int")).otherwise(number(month_token))
    year, day = number(F.when(year_first, a).otherwise(c)), number(F.when(year_first, c).otherwise(b))
    good = (F.length(text) >= 8) & F.length(a).between(1, 4) & year.between(1, 9999) & month.between(1, 12) & day.between(1, 31)
    return F.when(good, F.date_add(F.make_date(year, month, F.lit(1)), day - 1))


def parse_datetime(text: Column) -> Column:
    """A timestamp in UTC, or null: a date, then optional hour, minute, second, fraction and offset."""
    up = F.upper(text)
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(up, DATE + TIME, k), F.lit("")).try_cast("int"), F.lit(0))
    fraction = F.rpad(F.regexp_extract(up, DATE + TIME, 7), 6, "0").try_cast("long")
    sign = F.when(F.regexp_extract(up, DATE + TIME, 8) == "-", F.lit(-1)).otherwise(F.lit(1))
    seconds = part(4) * 3600 + part(5) * 60 + part(6) - sign * (part(9) * 3600 + part(10) * 60)
    day = F.unix_micros(parse_date(text).cast("timestamp"))
    return F.timestamp_micros(day + seconds.cast("long") * 1_000_000 + F.coalesce(fraction, F.lit(0)))


def month_period(day: Column) -> Column:
    return (F.year(day) - 1970) * 12 + F.month(day)


def _days(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def week_period(day: Column) -> Column:
    return F.floor(_days(day) / 7).cast("int") + 1


def day_period(day: Column, compat: bool = False) -> Column:
    """Days since 1970 plus one; ``compat`` divides seconds by 84400 as the rules' own function does."""
    return (F.floor(_days(day).cast("long") * 86400 / 84400) + 1).cast("int") if compat else _days(day) + 1


def distance_months(a: Column, b: Column) -> Column:
    """Months from ``a`` to ``b``; days don't count."""
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def age(born: Column, at: Column) -> Column:
    return F.year(at) - F.year(born) - F.when(F.dayofyear(at) < F.dayofyear(born), 1).otherwise(0)


def age_months(born: Column, at: Column) -> Column:
    """Whole calendar months; days don't count."""
    return distance_months(born, at)
