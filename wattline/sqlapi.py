"""The endpoint views as SQL table functions.

``register`` makes temporary views of the given tables and, over them, table
functions that answer what one request of the reference answered::

    SELECT * FROM scada_view('U7', DATE '2025-06-01')
    SELECT k.duid, s.* FROM my_days k, LATERAL scada_summary_of(k.duid, k.market_day) s

A call with constants is a filter that reaches the table; a call under LATERAL
answers all rows of a table of requests in one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as K
from .functions.dates import day_warnings, join_warnings, scada_source_class
from .functions.text import unit_label
from .operators.logstats import log_counts, timing_estimates, top_counts
from .operators.series import energy_series, flag_series, head_per_group, json_records, quality_flags, quality_strip, stat_cards
from .operators.summary import dispatch_summary, flag_breakdown, scada_summary

UNIT_DAY = "unit STRING, day DATE"
OF_UNIT_DAY = "duid = {f}.unit AND market_day = {f}.day"


def _function(spark: SparkSession, name: str, parameters: str, view: DataFrame, where: str | None = None) -> None:
    """Function ``name`` over the temporary view of ``view``; it returns the
    view's columns but for those that the parameters fix."""
    view.createOrReplaceTempView(f"_{name}")
    fixed = {"duid", "market_day"} if parameters == UNIT_DAY else {"state"} if where else set()
    columns = [(c, t) for c, t in view.dtypes if c not in fixed]
    returned = ", ".join(f"`{c}` {t}" for c, t in columns)
    chosen = ", ".join(f"`{c}`" for c, _ in columns)
    condition = f" WHERE {where.format(f=name)}" if where else ""
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({returned})"
        f" RETURN SELECT {chosen} FROM _{name}{condition}"
    )


def register(
    spark: SparkSession,
    scada: DataFrame | None = None,
    dispatch: DataFrame | None = None,
    units: DataFrame | None = None,
    log: DataFrame | None = None,
    cap: int = K.JSON_ROW_CAP,
) -> list[str]:
    """Register the functions of the tables that are given; returns their names.

    SCADA series: ``scada_view``, ``scada_summary_of``, ``scada_cards``,
    ``flag_breakdown_of``, ``flag_series_of``, ``quality_strip_of``,
    ``scada_records`` (at most ``cap`` a unit-day) and ``day_notes(unit, day)``
    (warnings and source). Dispatch series: ``energy_view``,
    ``energy_summary_of``, ``energy_cards``, ``energy_chart``, ``energy_records``.
    Registry: ``units_of(state)``. Log: ``log_by_action``, ``log_by_unit``,
    ``log_by_client``, ``wait_estimates``. Always: ``quality_flag_list``,
    ``app_info``.

    Series that are landed by unit-day (``session.land_clustered``) are
    answered without a shuffle."""
    found: dict[str, tuple] = {}
    flags = quality_flags(spark)
    if scada is not None:
        summary, breakdown = scada_summary(scada), flag_breakdown(scada)
        records = json_records(
            head_per_group(scada, cap), ["interval_datetime", "measurement_datetime"],
            keep=["interval_datetime", "measurement_datetime", "measured_mw", "mw_quality_flag"],
        )
        notes = scada.select("duid", "market_day").distinct().select(
            "*", join_warnings(day_warnings("market_day")).alias("warning"), scada_source_class("market_day").alias("source_type")
        )
        for name, view in {
            "scada_view": scada, "scada_summary_of": summary, "scada_cards": stat_cards(summary), "flag_breakdown_of": breakdown,
            "flag_series_of": flag_series(scada, flags), "quality_strip_of": quality_strip(breakdown, flags),
            "scada_records": records, "day_notes": notes,
        }.items():
            found[name] = (UNIT_DAY, view, OF_UNIT_DAY)
    if dispatch is not None:
        summary = dispatch_summary(dispatch)
        records = json_records(
            dispatch, ["settlementdate"], keep=["settlementdate", "initialmw", "initial_energy_storage", "energy_storage"]
        )
        for name, view in {
            "energy_view": dispatch, "energy_summary_of": summary, "energy_cards": stat_cards(summary, kind="dispatch"),
            "energy_chart": energy_series(dispatch), "energy_records": records,
        }.items():
            found[name] = (UNIT_DAY, view, OF_UNIT_DAY)
    if units is not None:
        labelled = units.withColumn("label", unit_label("duid", "name", "capacity_mw", "capacity_mwh"))
        found["units_of"] = ("wanted STRING", labelled, "state = {f}.wanted")
    if log is not None:
        found["log_by_action"] = ("", log_counts(log), None)
        found["log_by_unit"] = ("", top_counts(log, "duid", K.LOG_TOP_UNITS), None)
        found["log_by_client"] = ("", top_counts(log, "ip", K.LOG_TOP_CLIENTS), None)
        found["wait_estimates"] = ("", timing_estimates(log), None)
    found["quality_flag_list"] = ("", flags, None)
    dates = {
        "data_start_date": K.SCADA_START_DATE, "dispatch_start_date": K.DISPATCH_START_DATE, "cutover_date": K.SCADA_CURRENT_CUTOVER,
    }
    info = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("item"), F.lit(v.isoformat()).alias("value")) for k, v in dates.items()
    ])))
    found["app_info"] = ("", info, None)
    for name, (parameters, view, where) in found.items():
        _function(spark, name, parameters, view, where)
    return list(found)
