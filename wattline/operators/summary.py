"""Per-group summaries of the two series (all partial aggregates).

Groups are ``(unit, market_day)`` by default: the reference summarises one
unit-day per call, here every unit-day is summarised in one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.casts import nan_to_null

DEFAULT_BY = ("duid", "market_day")
MEAN_SCALE = 10


def exact_mean(col, decimals: int):
    """Mean over DECIMAL: exact, so independent of partitioning and summing
    order (a DOUBLE sum can land either side of a rounding tie). A group that
    holds a value beyond ±1e17 (or an infinity) has the mean of its doubles
    instead; it stops neither the job nor another group's exact mean."""
    fits = F.abs(col) < 1e17
    exact = F.round(F.avg(F.when(fits, col).try_cast(f"decimal(38,{MEAN_SCALE})")), decimals).cast("double")
    return F.when(F.bool_and(fits), exact).otherwise(F.round(F.avg(col), decimals))


def scada_summary(series: DataFrame, by=DEFAULT_BY, mw: str = "measured_mw") -> DataFrame:
    """Rows, min/max/mean/sample std of MW ignoring NULL and NaN, 3 decimals."""
    m = nan_to_null(F.col(mw))
    return series.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.round(F.min(m), 3).alias("min_mw"),
        F.round(F.max(m), 3).alias("max_mw"),
        exact_mean(m, 3).alias("mean_mw"),
        F.round(F.stddev_samp(m), 3).alias("std_mw"),
    )


def flag_breakdown(series: DataFrame, by=DEFAULT_BY, flag: str = "mw_quality_flag") -> DataFrame:
    """Count per flag (NULL is its own key) and share of the group, 1 decimal."""
    counts = series.groupBy(*by, flag).agg(F.count(F.lit(1)).alias("count"))
    # the window runs over the aggregated rows: a handful of flags per group
    total = F.sum("count").over(Window.partitionBy(*by))
    return counts.withColumn(
        "pct", F.coalesce(F.round(F.try_divide(F.col("count") * 100.0, total), 1), F.lit(0.0))
    )


def flag_breakdown_map(breakdown: DataFrame, by=DEFAULT_BY, flag: str = "mw_quality_flag") -> DataFrame:
    """Nested form: one row per group, ``MAP<flag text, STRUCT<count, pct>>``.

    The map holds one entry per distinct flag code (a handful), so the
    collected list is bounded by the flag domain, not by the data.
    """
    key = F.coalesce(F.col(flag).cast("string"), F.lit("None"))
    return breakdown.groupBy(*by).agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct(key.alias("k"), F.struct("count", "pct").alias("v"))))
        ).alias("flag_breakdown")
    )


_DISPATCH_MEASURES = [
    ("initialmw", "mw"),
    ("initial_energy_storage", "init_mwh"),
    ("energy_storage", "end_mwh"),
]


def dispatch_summary(series: DataFrame, by=DEFAULT_BY) -> DataFrame:
    """Rows and min/max/mean of the three dispatch measures, 2 decimals.

    A measure absent from the feed is an all-NULL column, so its statistics
    are NULL (the reference omits the keys).
    """
    aggs = [F.count(F.lit(1)).alias("total_rows")]
    for col, suffix in _DISPATCH_MEASURES:
        m = nan_to_null(F.col(col))
        aggs += [
            F.round(F.min(m), 2).alias(f"min_{suffix}"),
            F.round(F.max(m), 2).alias(f"max_{suffix}"),
            exact_mean(m, 2).alias(f"mean_{suffix}"),
        ]
    return series.groupBy(*by).agg(*aggs)
