"""Endpoint-shaped entry points.

Each function answers what one request of the reference answered, but the
work is the table-level operator: a single (unit, day) is just a filter on
the many-unit, many-day result. Return values are DataFrames (no collect).
"""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import constants as K
from .functions.dates import day_warnings, join_warnings, scada_source_class
from .operators.logstats import log_counts, recent, timing_estimates, top_counts
from .operators.series import head_per_group, json_records
from .operators.summary import dispatch_summary, flag_breakdown, scada_summary
from .plans.dispatch import dispatch_series
from .plans.scada import scada_series
from .session import land_clustered

_DATE_PARAM = re.compile(r"^\d{4}-\d{2}-\d{2}$")


def parse_request_date(text: str) -> date:
    """Strict ``YYYY-MM-DD`` request parameter (driver-side argument check)."""
    if not isinstance(text, str) or not _DATE_PARAM.match(text):
        raise ValueError(f"not a calendar date in the form 2025-06-30: {text!r}")
    try:
        return datetime.strptime(text, "%Y-%m-%d").date()
    except ValueError as exc:
        raise ValueError(f"not a calendar date in the form 2025-06-30: {text!r}") from exc


def default_request_date(as_of: date) -> date:
    """The day offered by default: the day before ``as_of``."""
    return as_of - timedelta(days=1)


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Raise ``LookupError(message)`` when ``df`` is empty (a one-row probe)."""
    if df.isEmpty():
        raise LookupError(message)
    return df


def check_request_date(day: date, scada: bool, as_of: date) -> date:
    """A requested day must not lie before the first day that the chosen data
    sets have, nor be ``as_of`` or later."""
    first = K.SCADA_START_DATE if scada else K.DISPATCH_START_DATE
    if not first <= day < as_of:
        raise ValueError(f"{day} is outside {first} to {as_of - timedelta(days=1)}")
    return day


def units_of_state(units: DataFrame, state: str) -> DataFrame:
    return units.where(F.col("state") == state).orderBy("duid")


def _one(series: DataFrame, duid: str | None, day: date | None) -> DataFrame:
    if duid is not None:
        series = series.where(F.col("duid") == duid)
    if day is not None:
        series = series.where(F.col("market_day") == F.lit(day.isoformat()).cast("date"))
    return series


def scada_view(lines: DataFrame, duid: str | None = None, day: date | None = None,
               cap: int | None = None, strict: bool = False) -> dict[str, DataFrame]:
    """SCADA data view: series, summary, row counts before/after the display
    cap, flag breakdown, display records (the first ``cap`` per unit-day; all
    if None) and per-day warnings. The feed is parsed once: the series is
    written by unit-day and every output reads it back without a shuffle."""
    series = _one(scada_series(lines, units=[duid] if duid else None, days=[day] if day else None), duid, day)
    series = land_clustered(series, "scada_view", ("duid", "market_day"), ("measurement_datetime",))
    if strict:
        require_rows(series, f"unit {duid}: no readings on market day {day}")
    head = series if cap is None else head_per_group(series, n=cap)
    shown = F.col("total_rows") if cap is None else F.least(F.col("total_rows"), F.lit(cap))
    days = series.select("market_day").distinct()
    summary = scada_summary(series)
    return {
        "series": series,
        "summary": summary,
        # rows before and after the display cap, per unit-day
        "counts": summary.select("duid", "market_day", "total_rows",
                                 shown.alias("displayed_rows")),
        "flag_breakdown": flag_breakdown(series),
        "records": json_records(head, ["interval_datetime", "measurement_datetime"],
                                keep=["interval_datetime", "measurement_datetime", "measured_mw", "mw_quality_flag"]),
        "warnings": days.select("market_day", join_warnings(day_warnings("market_day")).alias("warnings"),
                                scada_source_class("market_day").alias("source_type")),
    }


def energy_view(lines: DataFrame, duid: str | None = None, day: date | None = None,
                strict: bool = False) -> dict[str, DataFrame]:
    """Dispatch energy view: series, summary and records (no cap); the feed is
    parsed once."""
    series = _one(dispatch_series(lines, units=[duid] if duid else None, days=[day] if day else None), duid, day)
    series = land_clustered(series, "energy_view", ("duid", "market_day"), ("settlementdate",))
    if strict:
        require_rows(series, f"unit {duid}: no dispatch intervals on market day {day}")
    return {
        "series": series,
        "summary": dispatch_summary(series),
        "records": json_records(series, ["settlementdate"],
                                keep=["settlementdate", "initialmw", "initial_energy_storage", "energy_storage"]),
    }


def log_stats(log: DataFrame) -> dict[str, DataFrame]:
    """Analytics view: total and per-action counts, top units, top clients,
    recent requests."""
    counts = log_counts(log).orderBy(F.desc("cnt"), "action")
    return {
        "by_action": counts,
        "by_duid": top_counts(log, "duid", K.LOG_TOP_UNITS),
        "by_ip": top_counts(log, "ip", K.LOG_TOP_CLIENTS),
        "recent": recent(log, K.LOG_RECENT),
        "total_requests": log.agg(F.count(F.lit(1)).alias("total_requests")),
    }


def info(log: DataFrame) -> dict:
    """App metadata plus the wait estimates table."""
    return {
        "data_start_date": K.SCADA_START_DATE.isoformat(),
        "dispatch_start_date": K.DISPATCH_START_DATE.isoformat(),
        "cutover_date": K.SCADA_CURRENT_CUTOVER.isoformat(),
        "max_days_per_request": None,  # many days per job: no per-request cap
        "estimates": timing_estimates(log),
    }
