"""Calendar and clock functions (F1-F11, F20) as Spark column expressions.

All of them are built-in expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from slate.constants import EASTERN_TZ, WEEKDAY_NAMES


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clock_to_24h(text: str | Column) -> Column:
    """``7:30p`` -> ``19:30``, ``12:00p`` -> ``12:00``, ``12:15a`` -> ``00:15``.

    Text that does not end in ``a``/``p`` (headers, already 24-hour clocks)
    passes through unchanged; NULL stays NULL.
    """
    t = _col(text)
    m = F.regexp_extract(t, r"^\s*(\d{1,2}):(\d{2})\s*([ap])\s*$", 0)
    hour = F.regexp_extract(t, r"^\s*(\d{1,2}):(\d{2})\s*([ap])\s*$", 1).cast("int")
    minute = F.regexp_extract(t, r"^\s*(\d{1,2}):(\d{2})\s*([ap])\s*$", 2)
    pm = F.regexp_extract(t, r"^\s*(\d{1,2}):(\d{2})\s*([ap])\s*$", 3) == F.lit("p")
    hour24 = (hour % 12) + F.when(pm, F.lit(12)).otherwise(F.lit(0))
    converted = F.concat(F.lpad(hour24.cast("string"), 2, "0"), F.lit(":"), minute)
    return F.when(m != F.lit(""), converted).otherwise(t)


def clock_to_12h(hour: str | Column, minute: str | Column) -> Column:
    """Render hour/minute as the schedule pages' 12-hour text (``7:05p``)."""
    h, m = _col(hour), _col(minute)
    h12 = ((h + F.lit(11)) % 12) + F.lit(1)
    suffix = F.when(h >= 12, F.lit("p")).otherwise(F.lit("a"))
    return F.concat(h12.cast("string"), F.lit(":"), F.lpad(m.cast("string"), 2, "0"), suffix)


def parse_page_date(text: str | Column) -> Column:
    """``Tue, Oct 24, 2023`` -> DATE; headers and junk -> NULL.

    The weekday prefix is dropped first.  Text without the date's shape
    (header rows, junk) is set to NULL by a cheap pattern test before the
    parser sees it: ``try_to_date`` never raises under ANSI mode, but each
    failed parse costs an exception inside the task.
    """
    t = F.trim(_col(text))
    body = F.regexp_replace(t, r"^[A-Za-z]{3},\s*", "")
    shaped = body.rlike(r"^[A-Za-z]{3} \d{1,2}, \d{4}$")
    return F.when(shaped, F.try_to_date(body, "MMM d, yyyy"))


def combine_date_time(date: str | Column, time_24h: str | Column) -> Column:
    """date + ``HH:MM`` text -> TIMESTAMP_NTZ (NULL when either part is bad)."""
    d, t = _col(date), _col(time_24h)
    text = F.concat_ws(" ", F.date_format(d, "yyyy-MM-dd"), t)
    ok = d.isNotNull() & t.rlike(r"^\d{2}:\d{2}$")
    return F.when(ok, F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm"))).cast("timestamp_ntz")


def iso_week(date: str | Column) -> Column:
    """ISO-8601 week number (2023-12-31 -> 52, 2024-01-01 -> 1)."""
    return F.weekofyear(_col(date)).cast("int")


def day_of_year(date: str | Column) -> Column:
    """day of the year, 1-366."""
    return F.dayofyear(_col(date)).cast("int")


def day_of_week(date: str | Column) -> Column:
    """weekday with Monday = 0 ... Sunday = 6."""
    return F.weekday(_col(date)).cast("int")


def weekday_name(day: str | Column) -> Column:
    """weekday number (Monday = 0) -> English name; out of range -> NULL."""
    names = F.array(*[F.lit(n) for n in WEEKDAY_NAMES])
    return F.try_element_at(names, _col(day) + F.lit(1))


def to_day(ts: str | Column) -> Column:
    """F8: timestamp -> DATE (start of day)."""
    return F.to_date(_col(ts))


def calendar_columns(date_col: str = "date") -> dict[str, Column]:
    """F5-F7 for a date column, ready for ``withColumns``."""
    return {
        "week": iso_week(date_col),
        "day_of_year": day_of_year(date_col),
        "day_of_week": day_of_week(date_col),
    }


def ntz_literal(value: dt.date | dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal built from text, so it does not depend on the
    session or process time zone (a Python ``datetime`` literal would)."""
    if not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def to_eastern(ts_utc: str | Column, tz: str = EASTERN_TZ) -> Column:
    """a UTC wall-clock timestamp (TIMESTAMP_NTZ) rendered as US/Eastern wall clock.

    ``convert_timezone`` works on wall clocks, so the result does not depend on
    the session time zone.
    """
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), _col(ts_utc).cast("timestamp_ntz"))


def as_of_date(as_of: dt.date | str | None = None, tz: str = EASTERN_TZ) -> Column:
    """the report's "today" as a DATE column.

    A fixed ``as_of`` makes a report reproducible; ``None`` means the current
    day in US/Eastern, as the interactive reports use.
    """
    if as_of is None:
        return F.to_date(F.from_utc_timestamp(F.current_timestamp(), tz))
    if isinstance(as_of, str):
        as_of = dt.date.fromisoformat(as_of)
    return F.lit(as_of)


def pretty_timestamp(ts: str | Column) -> Column:
    """F20 display text: ``Thursday, January 01, 07:05`` (12-hour clock)."""
    return F.date_format(_col(ts), "EEEE, MMMM dd, hh:mm")
