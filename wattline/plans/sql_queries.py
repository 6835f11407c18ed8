"""Registered queries through the SQL table functions, from series landed by
unit-day, and over the registry's map form."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sqlapi
from ..api import units_of_state
from ..operators.dedup import keep_first
from ..operators.series import head_per_group
from ..operators.summary import flag_breakdown, flag_breakdown_map, scada_summary
from ..session import land_clustered, scratch_path
from ..sources.registry import first_readable, read_quality_flags, read_registry_json, registry_json_rejects, write_registry_map
from .feeds_from_tables import events_as_log, events_as_scada, lineitem_as_dispatch, scada_feed_lines, table
from .scada import scada_series
from .table_queries import (
    _SQL_DISPATCH,
    _SQL_LOG,
    _SQL_SCADA_EVENTS,
    _SQL_SCADA_SERIES,
    _SQL_UNITS,
    ORACLE,
    _sql_dispatch_summary,
    _units,
    register,
)

BY_DAY = ("duid", "market_day")


def _scada(spark: SparkSession, sf_dir: str) -> DataFrame:
    return land_clustered(scada_series(scada_feed_lines(table(spark, sf_dir, "events"))), "scada", BY_DAY, ("measurement_datetime",))


# E1 — every unit-day's answer by the table functions
@register("sql_scada_view", f"SELECT duid, market_day, interval_datetime, measurement_datetime, measured_mw, mw_quality_flag FROM ({_SQL_SCADA_SERIES}) s")
def q_sql_scada_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    sqlapi.register(spark, scada=_scada(spark, sf_dir))
    return spark.sql(
        "SELECT k.duid, k.market_day, v.* FROM (SELECT DISTINCT duid, market_day FROM _scada_view) k,"
        " LATERAL scada_view(k.duid, k.market_day) v"
    )


@register("sql_scada_summary", ORACLE["scada_day_summary"])
def q_sql_scada_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    sqlapi.register(spark, scada=_scada(spark, sf_dir))
    return spark.sql(
        "SELECT k.duid, k.market_day, v.* FROM (SELECT DISTINCT duid, market_day FROM _scada_view) k,"
        " LATERAL scada_summary_of(k.duid, k.market_day) v"
    )


# E2 — one unit's summary of every day: the filter reaches the table
@register("sql_energy_summary", _sql_dispatch_summary(_SQL_DISPATCH))
def q_sql_energy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    dispatch = land_clustered(lineitem_as_dispatch(table(spark, sf_dir, "lineitem")), "dispatch", BY_DAY, ("settlementdate",))
    sqlapi.register(spark, dispatch=dispatch)
    return spark.sql(
        "SELECT k.duid, k.market_day, v.* FROM (SELECT DISTINCT duid, market_day FROM _energy_view) k,"
        " LATERAL energy_summary_of(k.duid, k.market_day) v"
    )


# E5, F17 — units of each state; E7, E8 — analytics and info
@register(
    "sql_units_of",
    f"""SELECT s.state, duid, name, capacity_mw, capacity_mwh, region FROM ({_SQL_UNITS}) u
JOIN (VALUES ('QLD'), ('SA')) s(state) ON s.state = u.state""",
)
def q_sql_units_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    sqlapi.register(spark, units=_units(spark, sf_dir))
    return spark.sql(
        "SELECT s.state, u.duid, u.name, u.capacity_mw, u.capacity_mwh, u.region"
        " FROM VALUES ('QLD'), ('SA') AS s(state), LATERAL units_of(s.state) u"
    )


@register("units_of_one_state", f"SELECT * FROM ({_SQL_UNITS}) u WHERE state = 'NSW'")
def q_units_of_one_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units_of_state(_units(spark, sf_dir), "NSW")


@register(
    "sql_log_and_info",
    f"""SELECT 'action' AS part, action AS item, CAST(count(*) AS VARCHAR) AS value FROM ({_SQL_LOG}) l GROUP BY action
UNION ALL SELECT 'info', 'data_start_date', '2025-02-28' UNION ALL SELECT 'info', 'dispatch_start_date', '2025-02-11'
UNION ALL SELECT 'info', 'cutover_date', '2026-01-11'""",
)
def q_sql_log_and_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    sqlapi.register(spark, log=events_as_log(table(spark, sf_dir, "events")))
    return spark.sql(
        "SELECT 'action' AS part, action AS item, string(cnt) AS value FROM log_by_action()"
        " UNION ALL SELECT 'info', item, value FROM app_info()"
    )


# A1, A2, D1, D4 — summary, breakdown and head from one table landed by unit-day
@register(
    "clustered_day_report",
    f"""WITH s AS ({ORACLE['scada_day_summary']}),
     b AS (SELECT duid, market_day, '{{' || string_agg('"' || k || '":' || count::VARCHAR, ',' ORDER BY k) || '}}' AS flags
           FROM (SELECT duid, market_day, coalesce(CAST(mw_quality_flag AS VARCHAR), 'None') AS k, count(*) AS count
                 FROM ({_SQL_SCADA_SERIES}) x GROUP BY ALL) y GROUP BY duid, market_day),
     h AS (SELECT duid, market_day, max(measurement_datetime) AS tenth FROM (
             SELECT *, row_number() OVER (PARTITION BY duid, market_day ORDER BY measurement_datetime) AS n
             FROM ({_SQL_SCADA_SERIES}) z) WHERE n <= 10 GROUP BY duid, market_day)
SELECT s.duid, s.market_day, total_rows, mean_mw, flags, tenth FROM s JOIN b USING (duid, market_day) JOIN h USING (duid, market_day)""",
)
def q_clustered_day_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered_day_report(_scada(spark, sf_dir))


def clustered_day_report(series: DataFrame) -> DataFrame:
    """Of a series landed by unit-day, deduplicated once more: summary, counts by
    flag and the last of the first ten times. Nothing is shuffled."""
    one = keep_first(series, [*BY_DAY, "measurement_datetime"], ["interval_datetime"])
    counts = flag_breakdown_map(flag_breakdown(one)).select(
        *BY_DAY, F.to_json(F.transform_values("flag_breakdown", lambda _, v: v["count"])).alias("flags")
    )
    head = head_per_group(one, 10).groupBy(*BY_DAY).agg(F.max("measurement_datetime").alias("tenth"))
    report = scada_summary(one).select(*BY_DAY, "total_rows", "mean_mw")
    return report.join(counts.hint("merge"), list(BY_DAY)).join(head.hint("merge"), list(BY_DAY))


# S12, S15 — the registry's map form, written from customer and read back state by state
@register("registry_map_written", f"SELECT state, duid, name, capacity_mw, capacity_mwh, region FROM ({_SQL_UNITS}) u WHERE state <> 'SA'")
def q_registry_map_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One state's lists are spoilt: the others are read all the same."""
    path = scratch_path(spark, f"registry-{uuid.uuid4().hex}")
    write_registry_map(_units(spark, sf_dir), f"{path}/good")
    spoilt = F.regexp_replace("value", r'^\{"SA":\[.*$', '{"SA":"no list"}')
    spark.read.text(f"{path}/good").select(spoilt.alias("value")).write.text(f"{path}/stale")
    missing = lambda: read_registry_json(spark, f"{path}/fresh", wholetext=False)
    return first_readable([missing, lambda: read_registry_json(spark, f"{path}/stale", wholetext=False)])


@register(
    "registry_map_rejects",
    f"""SELECT DISTINCT state, 'not a list of units' AS reason FROM ({_SQL_UNITS}) u WHERE state = 'SA'""",
)
def q_registry_map_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, f"registry-{uuid.uuid4().hex}")
    write_registry_map(_units(spark, sf_dir), f"{path}/good")
    spoilt = F.regexp_replace("value", r'^\{"SA":\[\{.*$', '{"SA":"no list"}')
    spark.read.text(f"{path}/good").select(spoilt.alias("value")).write.text(f"{path}/stale")
    return registry_json_rejects(spark, f"{path}/stale", wholetext=False).select("state", "reason").distinct()


# S13 — flag descriptions by code, from JSON made of the codes that occur
@register(
    "quality_flags_written",
    f"""SELECT DISTINCT mw_quality_flag AS flag, 'Flag ' || CAST(mw_quality_flag AS VARCHAR) AS label,
       'code ' || CAST(mw_quality_flag AS VARCHAR) AS description, '#94a3b8' AS color
FROM ({_SQL_SCADA_EVENTS}) s WHERE mw_quality_flag IS NOT NULL""",
)
def q_quality_flags_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, f"flags-{uuid.uuid4().hex}")
    codes = events_as_scada(table(spark, sf_dir, "events")).select(F.col("mw_quality_flag").cast("string").alias("code")).distinct()
    info = F.struct(
        F.concat(F.lit("Flag "), "code").alias("label"), F.concat(F.lit("code "), "code").alias("description"),
        F.lit("#94a3b8").alias("color"),
    )
    # one object a file: the flag codes are a handful
    whole = codes.where(F.col("code").isNotNull()).agg(F.map_from_entries(F.collect_list(F.struct("code", info))).alias("m"))
    whole.select(F.to_json("m").alias("value")).coalesce(1).write.text(path)
    return read_quality_flags(spark, path)
