"""Wall-clock time features. All inputs and outputs are ``timestamp_ntz`` so the
session time zone never shifts an hour, weekday or month."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference:
# incident date/time pattern "MM/dd/yyyy HH:mm" (date and time joined by one space),
# scoring request pattern "yyyy-MM-dd HH:mm:ss",
# day periods: Night 0 (hour >= 22 or hour < 6), Morning 1 (< 12), Afternoon 2 (< 18), Evening 3.
INCIDENT_TS_PATTERN = "MM/dd/yyyy HH:mm"
REQUEST_TS_PATTERN = "yyyy-MM-dd HH:mm:ss"
NIGHT, MORNING, AFTERNOON, EVENING = 0, 1, 2, 3


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_ts(text: Column | str, pattern: str = INCIDENT_TS_PATTERN, lenient: bool = False) -> Column:
    """String → timestamp_ntz. Strict mode raises on a bad value (ANSI); lenient gives NULL.

    Spark's parser is not lenient like ``SimpleDateFormat``: month 13 or day 45
    do not roll over, they are errors (strict) or NULL (lenient). Lenient mode
    only uses ``try_to_timestamp`` to decide validity; the value itself is
    parsed without a zone, so a wall clock inside a DST gap of the session zone
    is kept as written.
    """
    t = _c(text)
    exact = F.to_timestamp_ntz(t, F.lit(pattern))
    if lenient:
        return F.when(F.try_to_timestamp(t, F.lit(pattern)).isNotNull(), exact)
    return exact


_TOKENS = {"yyyy": (F.year, 4), "MM": (F.month, 2), "dd": (F.dayofmonth, 2), "HH": (F.hour, 2),
           "mm": (F.minute, 2), "ss": (F.second, 2)}


def format_ntz(ts: Column | str, pattern: str) -> Column:
    """Format a timestamp_ntz with the numeric tokens yyyy MM dd HH mm ss (anything
    else is literal), from its fields: unlike ``date_format`` nothing passes
    through the session zone, so no wall clock shifts across a DST gap."""
    t = _c(ts)
    parts, i = [], 0
    while i < len(pattern):
        for tok, (fn, width) in _TOKENS.items():
            if pattern.startswith(tok, i):
                parts.append(F.lpad(fn(t).cast("string"), width, "0"))
                i += len(tok)
                break
        else:
            parts.append(F.lit(pattern[i]))
            i += 1
    return F.concat(*parts)


def ntz_literal(value) -> Column:
    """A Python datetime as a timestamp_ntz literal, built from its fields (a plain
    ``lit(datetime)`` goes through the Python process's and the session's zones)."""
    secs = value.second + value.microsecond / 1_000_000
    return F.make_timestamp_ntz(F.lit(value.year), F.lit(value.month), F.lit(value.day), F.lit(value.hour),
                                F.lit(value.minute), F.lit(secs).cast("decimal(16,6)"))


def parse_date_time(date: Column | str, time: Column | str, lenient: bool = False) -> Column:
    return parse_ts(F.concat_ws(" ", _c(date), _c(time)), INCIDENT_TS_PATTERN, lenient)


def hour_of(ts: Column | str) -> Column:
    return F.hour(_c(ts))


def day_period(hour: Column | str) -> Column:
    h = _c(hour)
    return (F.when((h >= 22) | (h < 6), F.lit(NIGHT))
            .when(h < 12, F.lit(MORNING))
            .when(h < 18, F.lit(AFTERNOON))
            .otherwise(F.lit(EVENING)))


def dow_num(ts: Column | str) -> Column:
    """ISO weekday number, 1 = Monday .. 7 = Sunday."""
    return F.weekday(_c(ts)) + F.lit(1)


def dow_name(ts: Column | str) -> Column:
    """English weekday name, from the (zone-free) calendar date."""
    return F.date_format(F.to_date(_c(ts)), "EEEE")


def month0(ts: Column | str) -> Column:
    """Month 0..11."""
    return F.month(_c(ts)) - F.lit(1)


def calendar_date(ts: Column | str) -> Column:
    return F.to_date(_c(ts))


def compat_date(ts: Column | str) -> Column:
    """The date the reference stores: a date built from (weekday, month, year)
    passed as (year, month, day), rolled over leniently.

    Year = 1900 + weekday (0 = Sunday), month unchanged, day = year - 1900, so
    2015-05-29 (a Friday) becomes 1905-08-23. The value is a one-to-one code of
    (weekday, month, year); grouping by it groups by those three fields.
    """
    t = _c(ts)
    first = F.make_date(F.dayofweek(t) + F.lit(1899), F.month(t), F.lit(1))
    return F.date_add(first, F.year(t) - F.lit(1901))


def time_features(ts: Column | str) -> dict[str, Column]:
    """The four derived slot columns for a timestamp, by output name."""
    t = _c(ts)
    h = hour_of(t)
    return {"Hour": h, "DayPeriod": day_period(h), "DayOfWeekNum": dow_num(t), "Month": month0(t)}
