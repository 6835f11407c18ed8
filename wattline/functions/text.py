"""Text helpers: feed field splitting, registry cells, labels and display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

# a comma outside double quotes
_COMMA_OUTSIDE_QUOTES = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
# a quoted field that holds a comma: only then the slow split is needed
_QUOTED_COMMA = r'(^|,)"[^"]*,[^"]*"(,|$)'


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def split_fields(line: Column | str) -> Column:
    """Split a feed line on commas outside quotes.

    Lines without a quoted comma take the plain (fast) split; the result is
    the same either way.
    """
    v = _c(line)
    # the search for a quote is much cheaper than the pattern and spares most lines it
    return F.when(v.contains('"') & v.rlike(_QUOTED_COMMA), F.split(v, _COMMA_OUTSIDE_QUOTES)).otherwise(
        F.split(v, ",")
    )


def clean_cell(col: Column | str) -> Column:
    """Trimmed text cell; NULL → ''."""
    return F.coalesce(F.trim(_c(col).cast("string")), F.lit(""))


def js_number(x: Column | str) -> Column:
    """Number as a browser prints it: no trailing ``.0`` on whole values."""
    return F.regexp_replace(_c(x).cast("string"), r"\.0$", "")


def unit_label(duid: Column | str, name: Column | str, mw: Column | str, mwh: Column | str) -> Column:
    """``DUID (name) (x MW / y MWh)`` with ``?`` for unknown capacities."""
    return F.concat(
        _c(duid), F.lit(" ("), _c(name), F.lit(") ("),
        F.coalesce(js_number(mw), F.lit("?")), F.lit(" MW / "),
        F.coalesce(js_number(mwh), F.lit("?")), F.lit(" MWh)"),
    )


def estimate_text(seconds: Column | str, is_default: Column | str, sample_count: Column | str) -> Column:
    """Wait-time sentence for an estimate row."""
    sec = F.coalesce(F.nullif(_c(seconds), F.lit(0)), F.lit(60))
    bucket = None
    for bound, text in K.ESTIMATE_BUCKETS:
        if bound is None:
            bucket = bucket.otherwise(F.lit(text))
        elif bucket is None:
            bucket = F.when(sec < bound, F.lit(text))
        else:
            bucket = bucket.when(sec < bound, F.lit(text))
    n = _c(sample_count)
    suffix = F.when(
        _c(is_default), F.lit("")
    ).otherwise(
        F.concat(
            F.lit(" (based on "), n.cast("string"), F.lit(" recent request"),
            F.when(n == 1, F.lit("")).otherwise(F.lit("s")), F.lit(")"),
        )
    )
    return F.concat(F.lit("this typically takes "), bucket, suffix)


def client_address(forwarded: Column | str, peer: Column | str) -> Column:
    """First address of a forwarded-for list, else the peer, else 'unknown'."""
    fwd = _c(forwarded)
    return F.when(
        fwd.isNotNull() & (fwd != ""), F.trim(F.split(fwd, ",").getItem(0))
    ).otherwise(F.coalesce(_c(peer), F.lit("unknown")))


def display_fixed(x: Column | str, decimals: int) -> Column:
    """Fixed-decimals display text with thousands separators; NULL → an em
    dash. Rounds the exact binary value (half-even), as a browser does."""
    return F.coalesce(F.format_number(_c(x), decimals), F.lit("—"))


def display_count(x: Column | str) -> Column:
    """Whole number with thousands separators; NULL → an em dash."""
    return F.coalesce(F.format_number(_c(x), 0), F.lit("—"))
