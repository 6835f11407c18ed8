"""4-second SCADA series: lines → typed, windowed, de-duplicated series.

Many units × many market days in one job; the reference's single call is
``units=[duid], days=[D]``.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.casts import feed_timestamp, to_double, to_int
from ..functions.dates import market_day_instant
from ..operators.dedup import keep_first
from ..operators.segments import ParsedFeed, parse_segments
from ..session import broadcast_if_small

SERIES_COLUMNS = [
    "duid",
    "market_day",
    "interval_datetime",
    "measurement_datetime",
    "measured_mw",
    "mw_quality_flag",
]


def parse_scada(lines: DataFrame, units: list[str] | None = None, **kw) -> ParsedFeed:
    """Header attachment for SCADA feeds (required columns checked per file)."""
    return parse_segments(
        lines,
        K.SCADA_COLUMNS + K.SCADA_UNIT_COLUMNS,
        contains=units,
        require=K.SCADA_COLUMNS,
        require_any=K.SCADA_UNIT_COLUMNS,
        time_column="MEASUREMENT_DATETIME",
        **kw,
    )


def cast_scada(rows: DataFrame) -> DataFrame:
    """String fields → typed columns; the unit id is FPP_UNITID, else DUID."""
    extra = [c for c in rows.columns if c not in ("file", "line_key", "segment_key", *K.SCADA_COLUMNS + K.SCADA_UNIT_COLUMNS)]
    return rows.select(
        "file",
        "line_key",
        *extra,
        F.coalesce(F.col("FPP_UNITID"), F.col("DUID")).alias("duid"),
        feed_timestamp("INTERVAL_DATETIME").alias("interval_datetime"),
        feed_timestamp("MEASUREMENT_DATETIME").alias("measurement_datetime"),
        to_double("MEASURED_MW").alias("measured_mw"),
        to_int("MW_QUALITY_FLAG").alias("mw_quality_flag"),
    )


def _day_filter(df: DataFrame, days) -> DataFrame:
    if days is None:
        return df
    if isinstance(days, DataFrame):
        # requested (duid, market_day) pairs, broadcast after a count so the
        # readings are not shuffled for the filter
        req, _ = broadcast_if_small(days.select("duid", "market_day").distinct())
        return df.join(req, ["duid", "market_day"], "left_semi")
    return df.where(F.col("market_day").isin([d.isoformat() if isinstance(d, date) else d for d in days]))


def per_day_served(typed: DataFrame, served: DataFrame) -> DataFrame:
    """``typed`` (with ``entry``) once per day that its entry serves (``served``:
    entry, target_date, entry_order), with ``target_date`` and ``file_order``."""
    # one row per (entry, day): broadcast while that table is small
    served, _ = broadcast_if_small(served)
    # "first" = candidate order, then the CSV within an inner archive, then the line
    out = typed.join(served, "entry", "inner")
    return out.withColumn("file_order", F.struct("entry_order", "file")).drop("entry", "entry_order")


def scada_series(
    lines: DataFrame,
    *,
    units: list[str] | None = None,
    days=None,
    file_order: Column | str | None = None,
    target_col: str | None = None,
    served: DataFrame | None = None,
    **kw,
) -> DataFrame:
    """Typed 4-second series keyed by ``(duid, measurement_datetime)``.

    Rows outside every market day (NULL measurement time) vanish, copies of
    a reading in overlapping files keep the first by (file order, line).
    ``served``: the days for which each line's ``entry`` was chosen, with their
    order, instead of the two columns (see :func:`per_day_served`).
    """
    parsed = parse_scada(lines, units=units, **kw)
    typed = cast_scada(parsed.rows)
    if units:
        typed = typed.where(F.col("duid").isin(units))
    if days is not None:
        # a day request prunes before the shuffle
        typed = _day_filter(typed.withColumn("market_day", market_day_instant("measurement_datetime")), days)
        typed = typed.drop("market_day")
    if served is not None:
        typed, file_order, target_col = per_day_served(typed, served), "file_order", "target_date"
    if target_col is not None:
        # lines carry the day their file was chosen for: a file serves only
        # that day, so its rows of other market days are not used
        typed = typed.where(market_day_instant("measurement_datetime") == F.col(target_col)).drop(target_col)
    order = F.col("file") if file_order is None else (F.col(file_order) if isinstance(file_order, str) else file_order)
    typed = typed.withColumn("_file_order", order)
    deduped = keep_first(
        typed.select("duid", "measurement_datetime", "_file_order", "line_key", "interval_datetime", "measured_mw", "mw_quality_flag"),
        ["duid", "measurement_datetime"],
        ["_file_order", "line_key"],
    )
    # readings without a valid time belong to no market day; testing the
    # de-duplicated column (not the parse expression) keeps the parse single
    out = deduped.where(F.col("measurement_datetime").isNotNull()).withColumn(
        "market_day", market_day_instant("measurement_datetime")
    )
    return out.select(*SERIES_COLUMNS)
