"""Registered queries over the driver tables, with their DuckDB oracle SQL.

Each query is ``fn(spark, sf_dir) -> DataFrame`` and runs the library's
operators over whole tables. ``ORACLE`` holds the equivalent SQL over the
same tables; column names are aliased identically on both sides.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..constants import JSON_ROW_CAP
from ..functions.casts import feed_timestamp, format_time, nan_to_null
from ..functions.dates import (
    available,
    day_warnings,
    earliest_allowed,
    era,
    join_warnings,
    market_day_instant,
    market_day_interval_end,
    scada_search_keys,
    scada_source_class,
)
from ..functions.text import client_address, unit_label
from ..operators.catalog_ops import bundle_candidates, fallthrough, latest_daily, match_daily
from ..operators.dedup import keep_first
from ..operators.logstats import combined_estimate, log_counts, recent, timing_estimates, top_counts
from ..operators.segments import ingest_report
from ..operators.series import (
    energy_series,
    flag_series,
    head_per_group,
    json_records,
    quality_flags,
    quality_strip,
    stat_cards,
)
from ..operators.summary import dispatch_summary, flag_breakdown, flag_breakdown_map, scada_summary
from ..plans.dispatch import cast_dispatch, dispatch_series, parse_dispatch
from ..plans.scada import cast_scada, parse_scada, scada_series
from ..session import persist_counted, scratch_path
from ..sinks.writers import read_csv, write_csv, write_parquet
from ..sources.catalog import parse_catalog
from ..sources.registry import (
    in_state_order,
    read_registry_rows,
    registry_from_lines,
    registry_from_sheet,
    units_by_state,
    units_from_registry,
    write_registry_json,
)
from ..sources.requestlog import append_log, read_log
from .feeds_from_tables import (
    customer_registry_lines,
    customer_registry_sheet,
    dispatch_feed_lines,
    events_as_log,
    events_as_scada,
    events_forwarded,
    lineitem_as_dispatch,
    lineitem_settlement,
    order_targets,
    orders_catalog_paths,
    scada_feed_lines,
    table,
)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


# ---------------------------------------------------------------------------
# SQL building blocks for the oracle (same rules as feeds_from_tables)
# ---------------------------------------------------------------------------
_SQL_FLAG = """CASE WHEN event_type = 'click' THEN 0 WHEN event_type = 'view' THEN 1
  WHEN event_type = 'purchase' THEN 2 WHEN event_type = 'signup' THEN -1
  WHEN event_id % 2 = 0 THEN 3 ELSE NULL END"""
_SQL_MW = """CASE WHEN event_id % 17 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 19 = 0 THEN NULL
  WHEN event_id % 23 = 0 THEN NULL ELSE value END"""
_SQL_SCADA_EVENTS = f"""
SELECT 'U' || CAST(user_id AS VARCHAR) AS duid,
       date_trunc('minute', ts) AS interval_datetime,
       date_trunc('second', ts) AS measurement_datetime,
       {_SQL_MW} AS measured_mw,
       {_SQL_FLAG} AS mw_quality_flag,
       CAST(date_trunc('second', ts) - INTERVAL 4 HOUR AS DATE) AS market_day,
       event_id, ts
FROM events"""
# rows as parsed back from the rendered feed text
_SQL_SCADA_PARSED = f"""
SELECT 'scada/FEED_' || strftime(ts, '%Y%m%d') || '.CSV' AS file,
       'U' || CAST(user_id AS VARCHAR) AS duid,
       date_trunc('minute', ts) AS interval_datetime,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE date_trunc('second', ts) END AS measurement_datetime,
       {_SQL_MW} AS measured_mw,
       CASE WHEN event_id % 29 = 0 THEN NULL ELSE {_SQL_FLAG} END AS mw_quality_flag,
       event_id, ts
FROM events"""
_SQL_SCADA_SERIES = f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT duid, CAST(measurement_datetime - INTERVAL 4 HOUR AS DATE) AS market_day,
         interval_datetime, measurement_datetime, measured_mw, mw_quality_flag,
         row_number() OVER (PARTITION BY duid, measurement_datetime ORDER BY file, ts) AS rn
  FROM ({_SQL_SCADA_PARSED}) p
  WHERE measurement_datetime IS NOT NULL
) WHERE rn = 1"""
_SQL_SETTLE = "(l_shipdate + to_hours(l_linenumber))"


# ---------------------------------------------------------------------------
# S1, S3, X1-X4, J1, U1 — multi-segment parse
# ---------------------------------------------------------------------------
@register(
    "segment_parse",
    f"""SELECT file, duid, interval_datetime, measurement_datetime, measured_mw, mw_quality_flag
FROM ({_SQL_SCADA_PARSED}) p""",
)
def q_segment_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = scada_feed_lines(table(spark, sf_dir, "events"))
    typed = cast_scada(parse_scada(lines).rows)
    return typed.select("file", "duid", "interval_datetime", "measurement_datetime", "measured_mw", "mw_quality_flag")


# F1, F2 — raw-line pre-filter then exact unit filter
@register(
    "unit_prefilter",
    f"""SELECT file, duid, measurement_datetime, measured_mw
FROM ({_SQL_SCADA_PARSED}) p WHERE duid = 'U7'""",
)
def q_unit_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = scada_feed_lines(table(spark, sf_dir, "events"))
    typed = cast_scada(parse_scada(lines, units=["U7"]).rows).where(F.col("duid") == "U7")
    return typed.select("file", "duid", "measurement_datetime", "measured_mw")


# F4 — unit column FPP_UNITID in one layout, DUID in the other
@register(
    "unit_column_coalesce",
    """SELECT 'U' || CAST(user_id AS VARCHAR) AS duid,
       count(*) AS n_rows,
       count(*) FILTER (WHERE hour(ts) < 12) AS n_first_layout
FROM events GROUP BY 1""",
)
def q_unit_column_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = scada_feed_lines(table(spark, sf_dir, "events"))
    rows = parse_scada(lines).rows
    return rows.groupBy(F.coalesce("FPP_UNITID", "DUID").alias("duid")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("FPP_UNITID").alias("n_first_layout"),
    )


# A11, A14 — ingest report per file (rows, segments, schema difference, parse rate)
@register(
    "parse_rate",
    """SELECT 'scada/FEED_' || strftime(ts, '%Y%m%d') || '.CSV' AS file,
       count(*) AS n_rows,
       count(DISTINCT hour(ts) < 12) AS n_segments,
       count(*) FILTER (WHERE event_id % 13 <> 0) AS n_time_parsed,
       count(DISTINCT hour(ts) < 12) > 1 AS schemas_differ,
       round(100.0 * count(*) FILTER (WHERE event_id % 13 <> 0) / count(*), 3)::DOUBLE AS parse_rate
FROM events GROUP BY 1""",
)
def q_parse_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = scada_feed_lines(table(spark, sf_dir, "events"))
    parsed = parse_scada(lines)
    parsed.rows = parsed.rows.withColumn("_t", feed_timestamp("MEASUREMENT_DATETIME"))
    rep = ingest_report(parsed, time_parsed="_t")
    return rep.where(F.col("n_rows") > 0).select(
        "file", "n_rows", "n_segments", "n_time_parsed", F.coalesce("schemas_differ", F.lit(False)).alias("schemas_differ"), "parse_rate"
    )


# S2, L1 — one table of a multi-table feed
@register(
    "table_scoped_parse",
    f"""SELECT 'dispatch/DISPATCH_' || strftime(l_shipdate, '%Y%m') || '.CSV' AS file,
       'S' || CAST(l_suppkey AS VARCHAR) AS duid,
       {_SQL_SETTLE} AS settlementdate,
       l_quantity AS initialmw, l_extendedprice AS initial_energy_storage, l_tax AS energy_storage
FROM lineitem""",
)
def q_table_scoped_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = dispatch_feed_lines(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))
    typed = cast_dispatch(parse_dispatch(lines).rows)
    return typed.select("file", "duid", "settlementdate", "initialmw", "initial_energy_storage", "energy_storage")


# ---------------------------------------------------------------------------
# F9, F10 — market-day windows
# ---------------------------------------------------------------------------
@register(
    "market_day_instant",
    """SELECT event_id, ts, CAST(ts - INTERVAL 4 HOUR AS DATE) AS market_day FROM events""",
)
def q_market_day_instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", "ts", market_day_instant("ts").alias("market_day"))


@register(
    "market_day_interval_end",
    f"""SELECT CAST({_SQL_SETTLE} - INTERVAL 4 HOUR - INTERVAL 1 MICROSECOND AS DATE) AS market_day,
       count(*) AS n_intervals, min({_SQL_SETTLE}) AS first_end, max({_SQL_SETTLE}) AS last_end
FROM lineitem GROUP BY 1""",
)
def q_market_day_interval_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("settle", lineitem_settlement())
    return li.groupBy(market_day_interval_end("settle").alias("market_day")).agg(
        F.count(F.lit(1)).alias("n_intervals"), F.min("settle").alias("first_end"), F.max("settle").alias("last_end")
    )


# ---------------------------------------------------------------------------
# D1, D2 — keep-first de-duplication
# ---------------------------------------------------------------------------
_LI_PAYLOAD = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
               "l_returnflag", "l_linestatus", "l_shipdate"]


@register(
    "keep_first_dedup",
    f"""SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
     ORDER BY {', '.join(c + ' NULLS FIRST' for c in _LI_PAYLOAD)}) AS rn FROM lineitem
) WHERE rn = 1""",
)
def q_keep_first_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return keep_first(li, ["l_orderkey", "l_linenumber"], _LI_PAYLOAD)


# ---------------------------------------------------------------------------
# A1, X5, X7 — SCADA summary; A2, X8 — flag breakdown
# ---------------------------------------------------------------------------
@register(
    "scada_summary",
    f"""SELECT duid, market_day, count(*) AS total_rows,
       round(min(m), 3) AS min_mw, round(max(m), 3) AS max_mw,
       round(CAST(sum(CAST(m AS DECIMAL(38,10))) / count(m) AS DECIMAL(38,10)), 3)::DOUBLE AS mean_mw, round(stddev_samp(m), 3) AS std_mw
FROM (SELECT *, CASE WHEN isnan(measured_mw) THEN NULL ELSE measured_mw END AS m
      FROM ({_SQL_SCADA_EVENTS}) s) t
GROUP BY duid, market_day""",
)
def q_scada_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scada_summary(events_as_scada(table(spark, sf_dir, "events")))


@register(
    "flag_breakdown",
    f"""SELECT duid, market_day, mw_quality_flag, count(*) AS count,
       round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY duid, market_day), 1)::DOUBLE AS pct
FROM ({_SQL_SCADA_EVENTS}) s GROUP BY duid, market_day, mw_quality_flag""",
)
def q_flag_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_breakdown(events_as_scada(table(spark, sf_dir, "events")))


# ---------------------------------------------------------------------------
# E1 — whole chain: feed lines → series → summary (the flagship query)
# ---------------------------------------------------------------------------
@register(
    "scada_day_summary",
    f"""SELECT duid, market_day, count(*) AS total_rows,
       round(min(m), 3) AS min_mw, round(max(m), 3) AS max_mw,
       round(CAST(sum(CAST(m AS DECIMAL(38,10))) / count(m) AS DECIMAL(38,10)), 3)::DOUBLE AS mean_mw, round(stddev_samp(m), 3) AS std_mw
FROM (SELECT *, CASE WHEN isnan(measured_mw) THEN NULL ELSE measured_mw END AS m
      FROM ({_SQL_SCADA_SERIES}) s) t
GROUP BY duid, market_day""",
)
def q_scada_day_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = scada_feed_lines(table(spark, sf_dir, "events"))
    return scada_summary(scada_series(lines))


@register(
    "scada_series",
    f"""SELECT duid, market_day, interval_datetime, measurement_datetime, measured_mw, mw_quality_flag
FROM ({_SQL_SCADA_SERIES}) s""",
)
def q_scada_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scada_series(scada_feed_lines(table(spark, sf_dir, "events")))


# ---------------------------------------------------------------------------
# A3 — dispatch summary; C3, A12 — energy series; E2 — whole dispatch chain
# ---------------------------------------------------------------------------
_SQL_DISPATCH = f"""
SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS duid,
       CAST({_SQL_SETTLE} - INTERVAL 4 HOUR - INTERVAL 1 MICROSECOND AS DATE) AS market_day,
       {_SQL_SETTLE} AS settlementdate,
       l_quantity AS initialmw,
       CASE WHEN l_suppkey % 10 <> 0 THEN l_extendedprice END AS initial_energy_storage,
       CASE WHEN l_linenumber <> 7 THEN l_tax END AS energy_storage
FROM lineitem"""


def _sql_dispatch_summary(src: str) -> str:
    parts = ["count(*) AS total_rows"]
    for col, suf in [("initialmw", "mw"), ("initial_energy_storage", "init_mwh"), ("energy_storage", "end_mwh")]:
        m = f"CASE WHEN isnan({col}) THEN NULL ELSE {col} END"
        parts += [f"round(min({m}), 2) AS min_{suf}", f"round(max({m}), 2) AS max_{suf}",
                  f"round(CAST(sum(CAST({m} AS DECIMAL(38,10))) / count({m}) AS DECIMAL(38,10)), 2)::DOUBLE AS mean_{suf}"]
    return f"SELECT duid, market_day, {', '.join(parts)} FROM ({src}) s GROUP BY duid, market_day"


@register("dispatch_summary", _sql_dispatch_summary(_SQL_DISPATCH))
def q_dispatch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dispatch_summary(lineitem_as_dispatch(table(spark, sf_dir, "lineitem")))


_SQL_DISPATCH_SERIES = f"""
SELECT duid, market_day, settlementdate, initialmw, initial_energy_storage, energy_storage FROM (
  SELECT *, row_number() OVER (PARTITION BY duid, settlementdate
            ORDER BY file, k, market_day, initialmw, initial_energy_storage, energy_storage) AS rn
  FROM (SELECT 'dispatch/DISPATCH_' || strftime(l_shipdate, '%Y%m') || '.CSV' AS file,
               l_orderkey * 8 + l_linenumber AS k,
               'S' || CAST(l_suppkey AS VARCHAR) AS duid,
               {_SQL_SETTLE} AS settlementdate,
               CAST({_SQL_SETTLE} - INTERVAL 4 HOUR - INTERVAL 1 MICROSECOND AS DATE) AS market_day,
               l_quantity AS initialmw, l_extendedprice AS initial_energy_storage, l_tax AS energy_storage
        FROM lineitem) x
) WHERE rn = 1"""


@register("dispatch_series", _SQL_DISPATCH_SERIES)
def q_dispatch_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = dispatch_feed_lines(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))
    return dispatch_series(lines)


@register("dispatch_day_summary", _sql_dispatch_summary(_SQL_DISPATCH_SERIES))
def q_dispatch_day_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = dispatch_feed_lines(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))
    return dispatch_summary(dispatch_series(lines))


@register(
    "energy_series",
    f"""WITH long AS (
  SELECT duid, market_day, 'initial_energy_storage' AS measure, 'Initial Energy (MWh)' AS series, settlementdate, initial_energy_storage AS value FROM ({_SQL_DISPATCH}) a
  UNION ALL
  SELECT duid, market_day, 'energy_storage', 'End Energy (MWh)', settlementdate, energy_storage FROM ({_SQL_DISPATCH}) b
  UNION ALL
  SELECT duid, market_day, 'initialmw', 'Dispatch MW', settlementdate, initialmw FROM ({_SQL_DISPATCH}) c
)
SELECT duid, market_day, measure, series, settlementdate, value FROM (
  SELECT *, bool_or(value IS NOT NULL) OVER (PARTITION BY duid, market_day, measure) AS present FROM long
) WHERE present""",
)
def q_energy_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return energy_series(lineitem_as_dispatch(table(spark, sf_dir, "lineitem")))


# ---------------------------------------------------------------------------
# C1, J4, X24 — per-flag series; C2 — quality strip; C4, X26 — stat cards
# ---------------------------------------------------------------------------
_SQL_FLAGS = """(SELECT * FROM (VALUES
  (0, 'Good', '#22c55e', 0), (1, 'Suspect', '#f97316', 1), (2, 'Bad', '#ef4444', 2),
  (-1, 'N/A', '#94a3b8', 3), (3, 'Manual override', '#94a3b8', 4)) AS f(flag, label, color, ord))"""


@register(
    "flag_series",
    f"""SELECT s.duid, s.market_day, s.flag,
       coalesce(f.label, 'Flag ' || CAST(s.flag AS VARCHAR)) AS label,
       coalesce(f.color, '#94a3b8') AS color, s.x, s.y
FROM (SELECT duid, market_day, coalesce(mw_quality_flag, -1) AS flag,
             measurement_datetime AS x, measured_mw AS y FROM ({_SQL_SCADA_EVENTS}) e) s
LEFT JOIN {_SQL_FLAGS} f ON s.flag = f.flag""",
)
def q_flag_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_series(events_as_scada(table(spark, sf_dir, "events")), quality_flags(spark))


@register(
    "quality_strip",
    f"""SELECT b.duid, b.market_day, b.mw_quality_flag, f.label, f.color, f.ord, b.count, b.pct
FROM (SELECT duid, market_day, mw_quality_flag, count(*) AS count,
        round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY duid, market_day), 1)::DOUBLE AS pct
      FROM ({_SQL_SCADA_EVENTS}) s GROUP BY duid, market_day, mw_quality_flag) b
JOIN {_SQL_FLAGS} f ON b.mw_quality_flag = f.flag""",
)
def q_quality_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    bd = flag_breakdown(events_as_scada(table(spark, sf_dir, "events")))
    return quality_strip(bd, quality_flags(spark))


def _sql_fixed(x: str, d: int) -> str:
    return f"coalesce(format('{{:,.{d}f}}', {x}), '—')"


@register(
    "stat_cards",
    f"""WITH s AS (
  SELECT duid, market_day, count(*) AS total_rows,
         round(min(m), 3) AS min_mw, round(max(m), 3) AS max_mw,
         round(CAST(sum(CAST(m AS DECIMAL(38,10))) / count(m) AS DECIMAL(38,10)), 3)::DOUBLE AS mean_mw, round(stddev_samp(m), 3) AS std_mw
  FROM (SELECT *, CASE WHEN isnan(measured_mw) THEN NULL ELSE measured_mw END AS m
        FROM ({_SQL_SCADA_EVENTS}) e) t GROUP BY duid, market_day)
SELECT duid, market_day, 0 AS card_no, 'Total Readings' AS label, format('{{:,}}', total_rows) AS value FROM s
UNION ALL SELECT duid, market_day, 1, 'Min MW', {_sql_fixed('min_mw', 2)} FROM s
UNION ALL SELECT duid, market_day, 2, 'Max MW', {_sql_fixed('max_mw', 2)} FROM s
UNION ALL SELECT duid, market_day, 3, 'Mean MW', {_sql_fixed('mean_mw', 2)} FROM s
UNION ALL SELECT duid, market_day, 4, 'Std Dev', {_sql_fixed('std_mw', 2)} FROM s""",
)
def q_stat_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stat_cards(scada_summary(events_as_scada(table(spark, sf_dir, "events"))))


# K4, D4, X6 — display records: first 25,000 points per unit-day, text times
@register(
    "series_head",
    f"""SELECT duid, market_day, row_no, strftime(measurement_datetime, '%Y-%m-%d %H:%M:%S') AS measurement_text,
       strftime(interval_datetime, '%Y-%m-%d %H:%M:%S') AS interval_text,
       CASE WHEN isnan(measured_mw) THEN NULL ELSE measured_mw END AS measured_mw, mw_quality_flag
FROM (SELECT *, row_number() OVER (PARTITION BY duid, market_day ORDER BY measurement_datetime) AS row_no
      FROM ({_SQL_SCADA_SERIES}) s) t WHERE row_no <= 25000""",
)
def q_series_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = scada_series(scada_feed_lines(table(spark, sf_dir, "events")))
    head = head_per_group(series, n=JSON_ROW_CAP)
    return head.select(
        "duid", "market_day", "row_no",
        format_time("measurement_datetime").alias("measurement_text"),
        format_time("interval_datetime").alias("interval_text"),
        nan_to_null("measured_mw").alias("measured_mw"),
        "mw_quality_flag",
    )


# F11, F18 — availability guards (events shifted into 2025)
@register(
    "availability_guard",
    """SELECT market_day, count(*) AS n_rows,
       market_day >= DATE '2025-02-28' AND market_day < DATE '2025-03-20' AS scada_available,
       market_day >= DATE '2025-02-11' AND market_day < DATE '2025-03-20' AS dispatch_available
FROM (SELECT CAST(ts + INTERVAL 423 DAY - INTERVAL 4 HOUR AS DATE) AS market_day FROM events) e
GROUP BY market_day""",
)
def q_availability_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    day = market_day_instant(F.col("ts") + F.expr("INTERVAL 423 DAYS")).alias("market_day")
    as_of = date(2025, 3, 20)
    return ev.groupBy(day).agg(F.count(F.lit(1)).alias("n_rows")).select(
        "market_day", "n_rows",
        available("market_day", K.SCADA_START_DATE, as_of).alias("scada_available"),
        available("market_day", K.DISPATCH_START_DATE, as_of).alias("dispatch_available"),
    )


# ---------------------------------------------------------------------------
# Archive catalog: S10, X9-X12, X27 — names; X13-X17 — eras, keys, warnings
# ---------------------------------------------------------------------------
_SQL_SDATE = "(CAST(o_orderdate AS DATE) + INTERVAL 9862 DAY)::DATE"
_SQL_CATALOG_PATHS = f"""
SELECT DISTINCT '/landing/' || CASE WHEN o_custkey % 3 = 0 THEN 'current' ELSE 'archive' END || '/' ||
  CASE o_orderkey % 6
    WHEN 0 THEN 'PUBLIC_NEXT_DAY_FPPMW_' || dstr || '_' || lpad(CAST(o_orderkey AS VARCHAR), 16, '0') || '.zip'
    WHEN 1 THEN 'PUBLIC_NEXT_DAY_FPPMW_2_' || dstr || '040000_' || lpad(CAST(o_orderkey AS VARCHAR), 16, '0') || '.zip'
    WHEN 2 THEN 'PUBLIC_NEXT_DAY_FPPMW_' || strftime(date_trunc('month', d), '%Y%m%d') || '.zip'
    WHEN 3 THEN 'PUBLIC_NEXT_DAY_FPPMW_2_' || strftime(date_trunc('week', d), '%Y%m%d') || '.zip'
    WHEN 4 THEN 'PUBLIC_NEXT_DAY_DISPATCH_' || dstr || '_' || lpad(CAST(o_orderkey AS VARCHAR), 16, '0') || '.zip'
    ELSE 'PUBLIC_NEXT_DAY_DISPATCH_' || strftime(date_trunc('month', d), '%Y%m%d') || '.zip' END AS path
FROM (SELECT *, CASE WHEN o_orderkey % 97 = 0 THEN strftime(d, '%Y') || '13' || strftime(d, '%d')
                     ELSE strftime(d, '%Y%m%d') END AS dstr
      FROM (SELECT *, {_SQL_SDATE} AS d FROM orders) o) o2"""
_SQL_CATALOG = f"""
SELECT path, name,
       regexp_extract(path, '/([^/]*)/[^/]*$', 1) AS source,
       CASE WHEN name LIKE '%FPPMW%' THEN 'FPPMW' WHEN upper(name) LIKE '%DISPATCH%' THEN 'DISPATCH' END AS product,
       CASE WHEN regexp_matches(name, '(?i)FPPMW_2_') THEN 2 ELSE 1 END AS format,
       CAST(try_strptime(nullif(regexp_extract(name, '_(\\d{{8}})(?:\\d{{6}})?(?:[_.]|$)', 1), ''), '%Y%m%d') AS DATE) AS file_date,
       CASE WHEN name LIKE '%FPPMW%' THEN regexp_matches(name, '(?i)FPPMW.*_\\d{{8}}\\.zip$')
            ELSE regexp_matches(name, '(?i)DISPATCH.*_\\d{{8}}\\.zip$') END AS is_bundle
FROM (SELECT path, regexp_extract(path, '[^/]*$', 0) AS name FROM ({_SQL_CATALOG_PATHS}) p) q"""


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_catalog(orders_catalog_paths(table(spark, sf_dir, "orders")))


@register("catalog_parse", _SQL_CATALOG)
def q_catalog_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir)


_SQL_TARGETS = f"SELECT DISTINCT {_SQL_SDATE} AS target_date FROM orders"


@register(
    "era_keys",
    f"""SELECT target_date, era, search_key, warning, source_class FROM (
  SELECT target_date,
         CASE WHEN target_date < DATE '2025-04-29' THEN 1 WHEN target_date < DATE '2025-09-11' THEN 2 ELSE 3 END AS era,
         unnest(CASE WHEN target_date < DATE '2025-04-29'
                     THEN [strftime(target_date, '%Y%m%d'), strftime(target_date + INTERVAL 1 DAY, '%Y%m%d')]
                     ELSE [strftime(target_date + INTERVAL 1 DAY, '%Y%m%d')] END) AS search_key,
         CASE WHEN target_date BETWEEN DATE '2025-04-29' AND DATE '2025-09-10'
              THEN 'Half a market day: from 16:00 on nothing was published (29 Apr 2025 to 10 Sep 2025).' ELSE '' END AS warning,
         CASE WHEN target_date >= DATE '2026-01-11' THEN 'current' ELSE 'archive' END AS source_class
  FROM ({_SQL_TARGETS}) t) x""",
)
def q_era_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = order_targets(table(spark, sf_dir, "orders"))
    return t.select(
        "target_date",
        era("target_date").alias("era"),
        F.explode(scada_search_keys("target_date")).alias("search_key"),
        join_warnings(day_warnings("target_date")).alias("warning"),
        scada_source_class("target_date").alias("source_class"),
    )


# J5, D6 — dispatch: latest bundle dated on/before the target (as-of)
@register(
    "bundle_asof",
    f"""SELECT target_date, name AS bundle_name, file_date AS bundle_date FROM (
  SELECT t.target_date, c.name, c.file_date,
         row_number() OVER (PARTITION BY t.target_date ORDER BY c.file_date DESC, c.name DESC) AS rn
  FROM ({_SQL_TARGETS}) t JOIN ({_SQL_CATALOG}) c
    ON c.product = 'DISPATCH' AND c.is_bundle AND c.source = 'archive' AND c.file_date <= t.target_date
) WHERE rn = 1""",
)
def q_bundle_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = _catalog(spark, sf_dir).where(F.col("source") == "archive")
    t = order_targets(table(spark, sf_dir, "orders"))
    out = bundle_candidates(t, cat, product=K.DISPATCH_PRODUCT, k=1)
    return out.select("target_date", F.col("right_name").alias("bundle_name"), F.col("right_file_date").alias("bundle_date"))


# J6, D7 — SCADA: best three bundles per format dated on/before D+1
@register(
    "bundle_topk",
    f"""SELECT target_date, format, rn AS asof_rank, name AS bundle_name FROM (
  SELECT t.target_date, c.format, c.name,
         row_number() OVER (PARTITION BY t.target_date, c.format ORDER BY c.file_date DESC, c.name DESC) AS rn
  FROM ({_SQL_TARGETS}) t JOIN ({_SQL_CATALOG}) c
    ON c.product = 'FPPMW' AND c.is_bundle AND c.source = 'archive'
   AND c.file_date <= t.target_date + INTERVAL 1 DAY
) WHERE rn <= 3""",
)
def q_bundle_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = _catalog(spark, sf_dir).where(F.col("source") == "archive")
    t = order_targets(table(spark, sf_dir, "orders"))
    out = bundle_candidates(t, cat, product=K.SCADA_PRODUCT, k=K.BUNDLE_CANDIDATES)
    return out.select("target_date", "format", "asof_rank", F.col("right_name").alias("bundle_name"))


_SQL_DAILY_MATCH = f"""
SELECT k.target_date, k.search_key, c.source, c.format, c.name
FROM (SELECT target_date, unnest(CASE WHEN target_date < DATE '2025-04-29'
             THEN [strftime(target_date, '%Y%m%d'), strftime(target_date + INTERVAL 1 DAY, '%Y%m%d')]
             ELSE [strftime(target_date + INTERVAL 1 DAY, '%Y%m%d')] END) AS search_key
      FROM ({_SQL_TARGETS}) t) k
JOIN ({_SQL_CATALOG}) c
  ON c.product = 'FPPMW' AND NOT c.is_bundle AND strftime(c.file_date, '%Y%m%d') = k.search_key"""


# J7 — daily files whose embedded date is a search key (equi join)
@register("daily_match", _SQL_DAILY_MATCH)
def q_daily_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = order_targets(table(spark, sf_dir, "orders"))
    m = match_daily(t, _catalog(spark, sf_dir))
    return m.select("target_date", "search_key", "source", "format", "name")


# U4, U5, L24 — first source with a hit wins, per (date, half)
@register(
    "source_fallthrough",
    f"""SELECT target_date, search_key, source, format, name FROM (
  SELECT *, min(CASE source WHEN 'current' THEN 1 WHEN 'archive' THEN 2 ELSE 3 END)
              OVER (PARTITION BY target_date, format) AS best,
            CASE source WHEN 'current' THEN 1 WHEN 'archive' THEN 2 ELSE 3 END AS r
  FROM ({_SQL_DAILY_MATCH}) m
) WHERE r = best""",
)
def q_source_fallthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = order_targets(table(spark, sf_dir, "orders"))
    m = match_daily(t, _catalog(spark, sf_dir)).select("target_date", "search_key", "source", "format", "name")
    return fallthrough(m, ["target_date", "format"])


# D6 — latest daily dispatch file per (source, date): the largest name
@register(
    "dispatch_latest_daily",
    f"""SELECT source, file_date, max(name) AS name FROM ({_SQL_CATALOG}) c
WHERE product = 'DISPATCH' AND NOT is_bundle AND file_date IS NOT NULL GROUP BY source, file_date""",
)
def q_dispatch_latest_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_daily(_catalog(spark, sf_dir))


# ---------------------------------------------------------------------------
# Unit registry: S11, F13, J2, X18-X22 — units; A9, J3, A10 — by state
# ---------------------------------------------------------------------------
_SQL_UNITS = """
SELECT s.state, u.duid, coalesce(nullif(u.name, ''), u.duid) AS name,
       TRY_CAST(u.mw AS DOUBLE) AS capacity_mw, TRY_CAST(u.mwh AS DOUBLE) AS capacity_mwh, u.region
FROM (
  SELECT CASE WHEN c_custkey % 50 = 0 THEN '' ELSE 'C' || CAST(c_custkey AS VARCHAR) END AS duid,
         CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS name,
         CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'Solar PV' ELSE 'Battery Storage' END AS tech,
         CASE WHEN c_acctbal > 0 THEN 'In Service' ELSE 'Committed' END AS status,
         ['QLD1','NSW1','VIC1','SA1','NT1'][n_regionkey + 1] AS region,
         CASE WHEN c_custkey % 5 = 0 THEN 'n/a' ELSE CAST(c_acctbal AS VARCHAR) END AS mw,
         CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE CAST(c_nationkey * 10 AS VARCHAR) END AS mwh
  FROM customer JOIN nation ON c_nationkey = n_nationkey) u
JOIN (VALUES ('QLD1','QLD'),('NSW1','NSW'),('VIC1','VIC'),('SA1','SA'),('TAS1','TAS')) s(region, state)
  ON u.region = s.region
WHERE u.tech = 'Battery Storage' AND u.status = 'In Service' AND u.duid <> ''"""


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = customer_registry_sheet(table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"))
    return units_from_registry(registry_from_sheet(sheet))


@register(
    "unit_registry_text",
    f"""SELECT state, duid, name, capacity_mw, capacity_mwh, region FROM ({_SQL_UNITS}) u""",
)
def q_unit_registry_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S11 text path: title rows, header row found by content, cells by position."""
    lines = customer_registry_lines(table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"))
    return units_from_registry(registry_from_lines(lines))


def _sql_js_num(x: str) -> str:
    return f"regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '')"


@register(
    "unit_registry",
    f"""SELECT *, duid || ' (' || name || ') (' || coalesce({_sql_js_num('capacity_mw')}, '?') || ' MW / '
             || coalesce({_sql_js_num('capacity_mwh')}, '?') || ' MWh)' AS label
FROM ({_SQL_UNITS}) u""",
)
def q_unit_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _units(spark, sf_dir)
    return u.withColumn("label", unit_label("duid", "name", "capacity_mw", "capacity_mwh"))


@register(
    "units_by_state",
    f"""SELECT s.state, coalesce(a.n_units, 0) AS n_units, a.first_duid, a.last_duid, a.total_mw,
       sum(coalesce(a.n_units, 0)) OVER () AS total_units,
       sum(CASE WHEN coalesce(a.n_units, 0) > 0 THEN 1 ELSE 0 END) OVER () AS nonempty_states
FROM (VALUES ('QLD'),('NSW'),('VIC'),('SA'),('TAS')) s(state)
LEFT JOIN (SELECT state, count(*) AS n_units, min(duid) AS first_duid, max(duid) AS last_duid,
                  round(sum(capacity_mw), 2) AS total_mw FROM ({_SQL_UNITS}) u GROUP BY state) a
  ON s.state = a.state""",
)
def q_units_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units_by_state(_units(spark, sf_dir))


# ---------------------------------------------------------------------------
# Request log: A4, A5 — counts; A6, A7, L18 — top lists; D5 — recent;
# A8, F16 — wait estimates; A13, X23 — combined estimate; X25 — client address
# ---------------------------------------------------------------------------
_SQL_LOG = """
SELECT event_id AS id, ts AS "timestamp",
       CASE WHEN fwd IS NOT NULL AND fwd <> '' THEN trim(split_part(fwd, ',', 1)) ELSE coalesce(peer, 'unknown') END AS ip,
       'U' || CAST(user_id AS VARCHAR) AS duid, CAST(ts AS DATE) AS "date",
       CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'download_csv' WHEN 'purchase' THEN 'download_parquet'
            WHEN 'signup' THEN 'download_energy_csv' WHEN 'error' THEN 'download_energy_parquet' END AS action,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(round(value * 1000) AS BIGINT) END AS duration_ms,
       ['current','archive','dispatch_current','dispatch_archive'][user_id % 4 + 1] AS source_type
FROM (SELECT *,
        CASE WHEN event_id % 3 = 0 THEN NULL
             WHEN event_id % 3 = 1 THEN ' 10.0.' || CAST(user_id % 16 AS VARCHAR) || '.' || CAST(user_id % 7 AS VARCHAR) || ' , 172.16.0.1'
             ELSE '' END AS fwd,
        CASE WHEN event_id % 5 = 0 THEN NULL
             ELSE '192.168.' || CAST(user_id % 4 AS VARCHAR) || '.' || CAST(user_id % 9 AS VARCHAR) END AS peer
      FROM events) e"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_log(table(spark, sf_dir, "events"))


@register(
    "log_counts",
    f"""SELECT action, count(*) AS cnt, sum(count(*)) OVER () AS total_requests FROM ({_SQL_LOG}) l GROUP BY action""",
)
def q_log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_counts(_log(spark, sf_dir))


@register(
    "log_top_units",
    f"""SELECT duid, count(*) AS cnt FROM ({_SQL_LOG}) l GROUP BY duid ORDER BY cnt DESC, duid ASC LIMIT 20""",
)
def q_log_top_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_counts(_log(spark, sf_dir), "duid", K.LOG_TOP_UNITS)


@register(
    "log_top_clients",
    f"""SELECT ip, count(*) AS cnt FROM ({_SQL_LOG}) l GROUP BY ip ORDER BY cnt DESC, ip ASC LIMIT 50""",
)
def q_log_top_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_counts(_log(spark, sf_dir), "ip", K.LOG_TOP_CLIENTS)


@register(
    "log_recent",
    f"""SELECT id, "timestamp", ip, duid, "date", action, duration_ms, source_type FROM ({_SQL_LOG}) l ORDER BY id DESC LIMIT 100""",
)
def q_log_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent(_log(spark, sf_dir))


_SQL_TIMING = f"""
WITH v AS (SELECT source_type, duration_ms,
                  row_number() OVER (PARTITION BY source_type ORDER BY id DESC) AS rn
           FROM ({_SQL_LOG}) l WHERE duration_ms IS NOT NULL AND action = 'view'),
     s AS (SELECT source_type, list_sort(list(duration_ms)) AS d, count(*) AS n FROM v WHERE rn <= 100 GROUP BY source_type)
SELECT t.source_type,
       CASE WHEN coalesce(s.n, 0) < 5 THEN CAST(t.dflt AS BIGINT)
            ELSE CAST(round_even(s.d[CAST(floor(0.75 * (s.n - 1)) AS INTEGER) + 1] / 1000.0, 0) AS BIGINT) END AS seconds,
       CAST(coalesce(s.n, 0) AS BIGINT) AS sample_count,
       coalesce(s.n, 0) < 5 AS is_default
FROM (VALUES ('current', 120), ('archive', 480), ('dispatch_current', 60), ('dispatch_archive', 300)) t(source_type, dflt)
LEFT JOIN s ON s.source_type = t.source_type"""


@register("timing_estimate", _SQL_TIMING)
def q_timing_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing_estimates(_log(spark, sf_dir))


def _sql_estimate_text(sec: str, dflt: str, n: str) -> str:
    buckets = " ".join(
        f"WHEN s < {b} THEN '{t}'" for b, t in K.ESTIMATE_BUCKETS if b is not None
    )
    last = K.ESTIMATE_BUCKETS[-1][1]
    return (
        f"'this typically takes ' || (SELECT CASE {buckets} ELSE '{last}' END FROM (SELECT coalesce(nullif({sec}, 0), 60) AS s)) || "
        f"CASE WHEN {dflt} THEN '' ELSE ' (based on ' || CAST({n} AS VARCHAR) || ' recent request' || "
        f"CASE WHEN {n} = 1 THEN '' ELSE 's' END || ')' END"
    )


@register(
    "combined_estimate",
    f"""WITH e AS ({_SQL_TIMING}),
c AS (
  SELECT a.source_type AS scada_source, greatest(a.seconds, b.seconds) AS seconds,
         a.is_default AND b.is_default AS is_default, least(a.sample_count, b.sample_count) AS sample_count
  FROM e a JOIN e b ON b.source_type = 'dispatch_current' WHERE a.source_type IN ('current', 'archive'))
SELECT scada_source, seconds, is_default, sample_count,
       {_sql_estimate_text('seconds', 'is_default', 'sample_count')} AS text
FROM c""",
)
def q_combined_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    est, *_ = persist_counted(timing_estimates(_log(spark, sf_dir)))  # four rows, read twice
    return combined_estimate(est, "current").unionByName(combined_estimate(est, "archive"))


@register(
    "client_address",
    """SELECT event_id AS id,
       CASE WHEN fwd IS NOT NULL AND fwd <> '' THEN trim(split_part(fwd, ',', 1)) ELSE coalesce(peer, 'unknown') END AS ip
FROM (SELECT *,
        CASE WHEN event_id % 3 = 0 THEN NULL
             WHEN event_id % 3 = 1 THEN ' 10.0.' || CAST(user_id % 16 AS VARCHAR) || '.' || CAST(user_id % 7 AS VARCHAR) || ' , 172.16.0.1'
             ELSE '' END AS fwd,
        CASE WHEN event_id % 5 = 0 THEN NULL
             ELSE '192.168.' || CAST(user_id % 4 AS VARCHAR) || '.' || CAST(user_id % 9 AS VARCHAR) END AS peer
      FROM events) e""",
)
def q_client_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    fwd, peer = events_forwarded(ev)
    return ev.select(F.col("event_id").alias("id"), client_address(fwd, peer).alias("ip"))


# ---------------------------------------------------------------------------
# K1, K3, K5, K8 — series written and read back; K6, K7, S14 — request log
# ---------------------------------------------------------------------------
@register("scada_csv_written", f"SELECT * FROM ({_SQL_SCADA_SERIES}) s")
def q_scada_csv_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, f"csv-{uuid.uuid4().hex}")
    write_csv(scada_series(scada_feed_lines(table(spark, sf_dir, "events"))), path, partition_by=("market_day",))
    read = read_csv(spark, path, (
        "duid string, INTERVAL_DATETIME timestamp_ntz, MEASUREMENT_DATETIME timestamp_ntz, MEASURED_MW double,"
        " MW_QUALITY_FLAG int, market_day date"
    ))
    return read.select(*[F.col(c).alias(c.lower()) for c in read.columns])


@register("dispatch_parquet_written", _SQL_DISPATCH_SERIES)
def q_dispatch_parquet_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, f"parquet-{uuid.uuid4().hex}")
    lines = dispatch_feed_lines(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))
    series = dispatch_series(lines)
    # folders by month: a folder for each of seven years' days is mostly file handling
    write_parquet(series.withColumn("market_month", F.date_format("market_day", "yyyy-MM")), path, partition_by=("market_month",))
    return spark.read.schema(series.schema).parquet(path).select(*series.columns)


@register("log_written", f"""SELECT id, "timestamp", ip, duid, "date", action,
       CASE WHEN id % 2 = 0 THEN duration_ms END AS duration_ms, CASE WHEN id % 2 = 0 THEN source_type END AS source_type
FROM ({_SQL_LOG}) l""")
def q_log_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends, one of them in the older form without the last columns."""
    path = scratch_path(spark, f"log-{uuid.uuid4().hex}")
    log = _log(spark, sf_dir)
    log.where("id % 2 = 1").drop("duration_ms", "source_type").write.parquet(path)
    append_log(log.where("id % 2 = 0"), path)
    return read_log(spark, path)


# A9, S12, D9 — nested registry written as JSON, read back, states in order
@register(
    "registry_json_written",
    f"""SELECT CAST(list_position(['NSW', 'QLD', 'SA', 'TAS', 'VIC'], state) AS INTEGER) AS state_no,
       state, duid, name, capacity_mw, capacity_mwh, region FROM ({_SQL_UNITS}) u""",
)
def q_registry_json_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, f"registry-{uuid.uuid4().hex}")
    write_registry_json(_units(spark, sf_dir), path)
    return in_state_order(read_registry_rows(spark, path)).select("state_no", "state", "duid", "name", "capacity_mw", "capacity_mwh", "region")


# F18 — earliest day that a request may ask for
@register(
    "earliest_allowed",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN DATE '2025-02-28' ELSE DATE '2025-02-11' END AS earliest FROM orders""",
)
def q_earliest_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), earliest_allowed(F.col("o_orderkey") % 2 == 0).alias("earliest")
    )


# ---------------------------------------------------------------------------
# C4 dispatch cards; K4 — display records
# ---------------------------------------------------------------------------
def _sql_fixed1(x: str) -> str:
    return f"coalesce(format('{{:,.1f}}', {x}), '—')"


@register(
    "dispatch_stat_cards",
    f"""WITH s AS ({_sql_dispatch_summary(_SQL_DISPATCH)})
SELECT duid, market_day, 0 AS card_no, 'Total Intervals' AS label, format('{{:,}}', total_rows) AS value FROM s
UNION ALL SELECT duid, market_day, 1, 'Min Dispatch MW', {_sql_fixed1('min_mw')} FROM s
UNION ALL SELECT duid, market_day, 2, 'Max Dispatch MW', {_sql_fixed1('max_mw')} FROM s
UNION ALL SELECT duid, market_day, 3, 'Min Energy (MWh)', {_sql_fixed1('min_init_mwh')} FROM s
UNION ALL SELECT duid, market_day, 4, 'Max Energy (MWh)', {_sql_fixed1('max_init_mwh')} FROM s
UNION ALL SELECT duid, market_day, 5, 'Mean Energy (MWh)', {_sql_fixed1('mean_init_mwh')} FROM s""",
)
def q_dispatch_stat_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stat_cards(dispatch_summary(lineitem_as_dispatch(table(spark, sf_dir, "lineitem"))), kind="dispatch")


@register(
    "series_records",
    f"""SELECT duid, market_day,
       json_object('interval_datetime', strftime(interval_datetime, '%Y-%m-%d %H:%M:%S'),
                   'measurement_datetime', strftime(measurement_datetime, '%Y-%m-%d %H:%M:%S'),
                   'measured_mw', CASE WHEN isnan(measured_mw) THEN NULL ELSE measured_mw END,
                   'mw_quality_flag', mw_quality_flag)::VARCHAR AS record
FROM (SELECT *, row_number() OVER (PARTITION BY duid, market_day ORDER BY measurement_datetime) AS row_no
      FROM ({_SQL_SCADA_SERIES}) s) t WHERE row_no <= 25000""",
)
def q_series_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = scada_series(scada_feed_lines(table(spark, sf_dir, "events")))
    head = head_per_group(series, n=JSON_ROW_CAP)
    return json_records(head, ["interval_datetime", "measurement_datetime"],
                        keep=["interval_datetime", "measurement_datetime", "measured_mw", "mw_quality_flag"])


# A2 nested form: one row per unit-day, the breakdown as a JSON object keyed by flag
@register(
    "flag_breakdown_nested",
    f"""SELECT duid, market_day,
       '{{' || string_agg('"' || k || '":' || json_object('count', count, 'pct', pct)::VARCHAR, ',' ORDER BY k) || '}}'
         AS flag_breakdown
FROM (SELECT duid, market_day, coalesce(CAST(mw_quality_flag AS VARCHAR), 'None') AS k, count(*) AS count,
             round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY duid, market_day), 1)::DOUBLE AS pct
      FROM ({_SQL_SCADA_EVENTS}) s GROUP BY duid, market_day, mw_quality_flag) b
GROUP BY duid, market_day""",
)
def q_flag_breakdown_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    bd = flag_breakdown(events_as_scada(table(spark, sf_dir, "events")))
    nested = flag_breakdown_map(bd)
    return nested.select("duid", "market_day", F.to_json("flag_breakdown").alias("flag_breakdown"))
