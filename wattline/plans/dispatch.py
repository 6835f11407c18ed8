"""5-minute dispatch series: one table of a multi-table feed → typed series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.casts import feed_timestamp, to_double
from ..functions.dates import market_day_interval_end
from ..operators.dedup import keep_first
from ..operators.segments import ParsedFeed, parse_segments
from .scada import _day_filter, per_day_served

SERIES_COLUMNS = [
    "duid",
    "market_day",
    "settlementdate",
    "initialmw",
    "initial_energy_storage",
    "energy_storage",
]


def parse_dispatch(lines: DataFrame, units: list[str] | None = None, table: str = K.DISPATCH_TABLE, **kw) -> ParsedFeed:
    return parse_segments(
        lines,
        K.DISPATCH_COLUMNS + [K.DISPATCH_UNIT_COLUMN],
        table=table,
        contains=units,
        require=[K.DISPATCH_UNIT_COLUMN, "SETTLEMENTDATE"],
        time_column="SETTLEMENTDATE",
        **kw,
    )


def cast_dispatch(rows: DataFrame) -> DataFrame:
    """Absent optional columns are NULL columns (fixed schema)."""
    extra = [c for c in rows.columns if c not in ("file", "line_key", "segment_key", *K.DISPATCH_COLUMNS + [K.DISPATCH_UNIT_COLUMN])]
    return rows.select(
        "file",
        "line_key",
        *extra,
        F.col("DUID").alias("duid"),
        feed_timestamp("SETTLEMENTDATE").alias("settlementdate"),
        to_double("INITIALMW").alias("initialmw"),
        to_double("INITIAL_ENERGY_STORAGE").alias("initial_energy_storage"),
        to_double("ENERGY_STORAGE").alias("energy_storage"),
    )


def dispatch_series(
    lines: DataFrame,
    *,
    units: list[str] | None = None,
    days=None,
    file_order: Column | str | None = None,
    target_col: str | None = None,
    served: DataFrame | None = None,
    table: str = K.DISPATCH_TABLE,
    **kw,
) -> DataFrame:
    """Typed series keyed by ``(duid, settlementdate)``, interval-end market days."""
    parsed = parse_dispatch(lines, units=units, table=table, **kw)
    typed = cast_dispatch(parsed.rows)
    if units:
        typed = typed.where(F.col("duid").isin(units))
    if days is not None:
        typed = _day_filter(typed.withColumn("market_day", market_day_interval_end("settlementdate")), days)
        typed = typed.drop("market_day")
    if served is not None:
        typed, file_order, target_col = per_day_served(typed, served), "file_order", "target_date"
    if target_col is not None:
        # lines carry the day their file was chosen for: a file serves only
        # that day, so its rows of other market days are not used
        typed = typed.where(market_day_interval_end("settlementdate") == F.col(target_col)).drop(target_col)
    order = F.col("file") if file_order is None else (F.col(file_order) if isinstance(file_order, str) else file_order)
    typed = typed.withColumn("_file_order", order)
    deduped = keep_first(
        typed.select("duid", "settlementdate", "_file_order", "line_key", "initialmw", "initial_energy_storage", "energy_storage"),
        ["duid", "settlementdate"],
        ["_file_order", "line_key"],
    )
    out = deduped.where(F.col("settlementdate").isNotNull()).withColumn(
        "market_day", market_day_interval_end("settlementdate")
    )
    return out.select(*SERIES_COLUMNS)
