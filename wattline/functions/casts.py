"""Non-strict casts of feed text (ANSI-safe: bad text gives NULL, never an error)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


_FEED_TS_SHAPE = r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}$"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def unquote(col: Column | str) -> Column:
    """Strip one pair of surrounding double quotes (plain string functions)."""
    c = _c(col)
    quoted = c.startswith('"') & c.endswith('"') & (F.length(c) >= 2)
    return F.when(quoted, F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(c)


def feed_timestamp(col: Column | str) -> Column:
    """``YYYY/MM/DD HH:MM:SS`` text → TIMESTAMP_NTZ; any other text → NULL."""
    c = _c(col)
    ts = F.replace(c, F.lit("/"), F.lit("-")).try_cast("timestamp_ntz")
    return F.when(c.rlike(_FEED_TS_SHAPE), ts)


def to_double(col: Column | str) -> Column:
    """Float text → DOUBLE; accepts NaN; '' and junk → NULL."""
    return _c(col).try_cast("double")


def to_int(col: Column | str) -> Column:
    """Integer text, also written as a float ('2.0') → INT, truncating."""
    return _c(col).try_cast("double").try_cast("int")


def nan_to_null(col: Column | str) -> Column:
    """NaN → NULL, other values unchanged (summaries and JSON ignore NaN)."""
    c = _c(col)
    return F.when(~F.isnan(c), c)


def format_time(col: Column | str) -> Column:
    """Timestamp → ``YYYY-MM-DD HH:MM:SS`` text (CSV/JSON output form).

    Written from the wall-clock value (``date_format`` would pass a
    TIMESTAMP_NTZ through the session zone and move times inside a
    daylight-saving gap)."""
    return F.substring(_c(col).cast("timestamp_ntz").cast("string"), 1, 19)


def render_feed_time(col: Column | str) -> Column:
    """Timestamp → feed text ``YYYY/MM/DD HH:MM:SS`` (zone-free, as above)."""
    return F.replace(format_time(col), F.lit("-"), F.lit("/"))
