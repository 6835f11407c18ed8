"""Market-day windows, availability guards, naming eras and name dates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _lit_date(d: date) -> Column:
    return F.lit(d.isoformat()).cast("date")


def market_day_instant(ts: Column | str) -> Column:
    """Market day of an instant reading: day D covers ``[D 04:00, D+1 04:00)``."""
    return F.to_date(_c(ts) - F.expr(f"INTERVAL {K.DAY_START_HOUR} HOURS"))


def market_day_interval_end(ts: Column | str) -> Column:
    """Market day of an interval-end stamp: day D covers ``(D 04:00, D+1 04:00]``."""
    return F.to_date(
        _c(ts) - F.expr(f"INTERVAL {K.DAY_START_HOUR} HOURS") - F.expr("INTERVAL 1 MICROSECOND")
    )


def available(day: Column | str, start: date, as_of: Column | str | date) -> Column:
    """Availability guard: ``start <= day < as_of`` (as_of = 'today' of the run)."""
    if isinstance(as_of, date):
        as_of = _lit_date(as_of)
    return (_c(day) >= _lit_date(start)) & (_c(day) < _c(as_of))


def earliest_allowed(scada_selected: Column | str) -> Column:
    """Earliest date a request may ask for: SCADA start if SCADA is chosen."""
    return F.when(_c(scada_selected), _lit_date(K.SCADA_START_DATE)).otherwise(
        _lit_date(K.DISPATCH_START_DATE)
    )


def yyyymmdd(d: Column | str) -> Column:
    return F.date_format(_c(d), "yyyyMMdd")


def era(d: Column | str) -> Column:
    """Naming era of a settlement date: 1, 2 or 3."""
    d = _c(d)
    return (
        F.when(d < _lit_date(K.ERA2_START), F.lit(1))
        .when(d < _lit_date(K.ERA3_START), F.lit(2))
        .otherwise(F.lit(3))
    )


def scada_search_keys(d: Column | str) -> Column:
    """Dates (``yyyyMMdd``) whose files cover settlement date D.

    Era 1 names carry the data date: D and D+1. Later eras carry the
    publication date: D+1.
    """
    d = _c(d)
    return F.when(era(d) == 1, F.array(yyyymmdd(d), yyyymmdd(F.date_add(d, 1)))).otherwise(
        F.array(yyyymmdd(F.date_add(d, 1)))
    )


def dispatch_search_keys(d: Column | str) -> Column:
    return F.array(yyyymmdd(d))


def day_warnings(d: Column | str) -> Column:
    """ARRAY<STRING> of data-availability warnings of a settlement date."""
    d = _c(d)
    partial = (d >= _lit_date(K.PARTIAL_DAY_FIRST)) & (d <= _lit_date(K.PARTIAL_DAY_LAST))
    return F.when(partial, F.array(F.lit(K.PARTIAL_DAY_WARNING))).otherwise(
        F.array().cast("array<string>")
    )


def join_warnings(warnings: Column | str) -> Column:
    return F.array_join(_c(warnings), "; ")


def scada_source_class(d: Column | str) -> Column:
    """Request class of a SCADA date: 'current' on/after the cutover, else 'archive'."""
    return F.when(_c(d) >= _lit_date(K.SCADA_CURRENT_CUTOVER), F.lit("current")).otherwise(
        F.lit("archive")
    )


def name_date(name: Column | str) -> Column:
    """Date embedded in a file name after ``_``; no match or invalid → NULL."""
    s = F.regexp_extract(_c(name), K.NAME_DATE_PATTERN, 1)
    return F.when(s != "", F.try_to_date(s, "yyyyMMdd"))


def basename(path: Column | str) -> Column:
    """Last path element (``href`` tail), trailing slashes ignored."""
    return F.element_at(F.split(F.regexp_replace(_c(path), "/+$", ""), "/"), -1)


def trunc_ntz(ts: Column | str, unit: str) -> Column:
    """Truncate a TIMESTAMP_NTZ to the second or minute without passing
    through the session time zone (``date_trunc`` returns a zoned timestamp)."""
    t = _c(ts)
    secs = F.second(t) if unit == "second" else F.lit(0)
    if unit not in ("second", "minute"):
        raise ValueError(unit)
    return F.make_timestamp_ntz(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.minute(t), secs)


def ntz_micros(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 00:00 of a TIMESTAMP_NTZ (zone-free)."""
    t = _c(ts)
    return (
        F.unix_date(F.to_date(t)).cast("bigint") * 86_400_000_000
        + F.hour(t).cast("bigint") * 3_600_000_000
        + F.minute(t).cast("bigint") * 60_000_000
        + (F.date_part(F.lit("SECOND"), t) * 1_000_000).cast("bigint")
    )
