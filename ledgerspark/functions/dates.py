"""Date parsing, calendar windows and age texts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ISO forms a rule's time stamps come in.
ISO_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
)


def parse_date(text: Column, formats: tuple[str, ...]) -> Column:
    """The first format that fits wins; null when none does.

    Read as UTC and counted from 1970, so that no session's summer time moves it.
    """
    at_utc = F.concat(F.trim(text), F.lit(" Z"))
    moments = F.coalesce(*[F.try_to_timestamp(at_utc, F.lit(f"{f} XXX")) for f in formats])
    seconds = (F.unix_micros(moments).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def parse_iso(text: Column) -> Column:
    """ISO date or date-time text as a timestamp; null when it is neither."""
    return parse_date(text, ISO_FORMATS)


def as_datetime(as_of: dt.datetime | dt.date | str) -> dt.datetime:
    """The point in time that stands in for the clock."""
    if isinstance(as_of, dt.datetime):
        return as_of
    return dt.datetime.fromisoformat(as_of if isinstance(as_of, str) else as_of.isoformat())


def moment(as_of) -> Column:
    """A point in time as a constant that filters can push down."""
    return F.lit(as_datetime(as_of).isoformat(sep=" ")).cast("timestamp_ntz")


def days_before(as_of, days: int) -> dt.datetime:
    return as_datetime(as_of) - dt.timedelta(days=days)


def year_start(as_of, years_back: int = 0) -> dt.datetime:
    """1 January of the year of ``as_of``, or of an earlier year."""
    return dt.datetime(as_datetime(as_of).year - years_back, 1, 1)


def age_text(created: Column, as_of) -> Column:
    """``3 days ago``, ``5 hours ago`` (above one hour) or ``7 minutes ago``.

    Whole days are rounded down, also for moments after ``as_of``; the rest of
    the day then decides, as it does with a signed day plus seconds interval.
    """
    seconds = F.unix_micros(moment(as_of).cast("timestamp")) - F.unix_micros(created.cast("timestamp"))
    seconds = F.floor(seconds / F.lit(1_000_000))
    days = F.floor(seconds / F.lit(86_400))
    rest = seconds - days * F.lit(86_400)
    return (
        F.when(days > 0, F.concat(days.cast("string"), F.lit(" days ago")))
        .when(rest > 3600, F.concat(F.floor(rest / F.lit(3600)).cast("string"), F.lit(" hours ago")))
        .when(rest.isNotNull(), F.concat(F.floor(rest / F.lit(60)).cast("string"), F.lit(" minutes ago")))
    )
