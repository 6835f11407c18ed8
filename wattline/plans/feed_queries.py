"""Registered queries over faulty feeds, unit filters and written layouts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.casts import to_double, to_int
from ..functions.text import split_fields
from ..operators.segments import VERDICTS, rejects
from ..session import scratch_path
from ..sinks.writers import write_csv, write_json, write_parquet
from .dispatch import cast_dispatch, dispatch_series, parse_dispatch
from .feeds_from_tables import dispatch_feed_lines, events_as_dispatch, events_as_scada, scada_feed_lines, table
from .scada import parse_scada
from .table_queries import _SQL_DISPATCH_SERIES, _SQL_SCADA_EVENTS, _SQL_SETTLE, register

# ---------------------------------------------------------------------------
# F5, F15, A14, L2 — every line's verdict
# ---------------------------------------------------------------------------
_SQL_VERDICTS = """
SELECT file, CASE WHEN rejected THEN 'missing required columns' WHEN event_id % 13 = 0 THEN 'unparsed time' ELSE 'used' END AS reason
FROM (SELECT 'scada/FEED_' || strftime(ts, '%Y%m%d') || '.CSV' AS file, day(ts) % 5 = 0 AS rejected, event_id FROM events) e
UNION ALL SELECT 'scada/FEED_' || strftime(ts, '%Y%m%d') || '.CSV', 'short line' FROM events WHERE event_id % 41 = 0
UNION ALL SELECT 'scada/FEED_' || strftime(ts, '%Y%m%d') || '.CSV', 'unknown tag' FROM events WHERE event_id % 43 = 0
UNION ALL SELECT 'scada/FEED_' || strftime(ts, '%Y%m%d') || '.CSV', 'data line before any header' FROM events WHERE event_id % 47 = 0
UNION ALL SELECT DISTINCT 'scada/FEED_' || strftime(ts, '%Y%m%d') || '.CSV', 'data line before any header' FROM events"""


@register(
    "feed_rejects",
    f"SELECT file, reason, count(*) AS n_lines FROM ({_SQL_VERDICTS}) v WHERE reason <> 'used' GROUP BY file, reason",
)
def q_feed_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_scada(scada_feed_lines(table(spark, sf_dir, "events"), faults=True))
    return rejects(parsed).groupBy("file", "reason").agg(F.count(F.lit(1)).alias("n_lines"))


@register(
    "feed_verdicts",
    f"SELECT reason AS verdict, count(*) AS n_lines FROM ({_SQL_VERDICTS}) v GROUP BY reason",
)
def q_feed_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all verdicts, observed while the rows were written."""
    parsed = parse_scada(scada_feed_lines(table(spark, sf_dir, "events"), faults=True))
    rows, totals = parsed.observed()
    rows.write.parquet(scratch_path(spark, f"rows-{uuid.uuid4().hex}"))
    counts = totals.get
    return spark.createDataFrame([(v, counts[v]) for v in VERDICTS], "verdict string, n_lines long")


# F6, F8 — dispatch files without the unit column (rejected) or storage columns (NULL)
@register(
    "dispatch_layouts",
    f"""SELECT 'dispatch/DISPATCH_' || strftime(l_shipdate, '%Y%m') || '.CSV' AS file,
       'S' || CAST(l_suppkey AS VARCHAR) AS duid, {_SQL_SETTLE} AS settlementdate, l_quantity AS initialmw,
       CASE WHEN month(l_shipdate) % 4 <> 1 THEN l_extendedprice END AS initial_energy_storage,
       CASE WHEN month(l_shipdate) % 4 <> 1 THEN l_tax END AS energy_storage
FROM lineitem WHERE month(l_shipdate) % 4 <> 0""",
)
def q_dispatch_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = dispatch_feed_lines(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), layouts=True)
    typed = cast_dispatch(parse_dispatch(lines).rows)
    return typed.select("file", "duid", "settlementdate", "initialmw", "initial_energy_storage", "energy_storage")


# F3 — dispatch units asked for by id: raw pre-filter, then the exact test
@register("dispatch_unit_filter", f"SELECT * FROM ({_SQL_DISPATCH_SERIES}) s WHERE duid IN ('S1', 'S7')")
def q_dispatch_unit_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = dispatch_feed_lines(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))
    return dispatch_series(lines, units=["S1", "S7"])


# ---------------------------------------------------------------------------
# K1, K2, K3, K5, K8, D3 — default layouts, lines read back with their position.
# Units are folded to eight, so that folders do not grow with the rows.
# ---------------------------------------------------------------------------
_SQL_FLEET = _SQL_SCADA_EVENTS.replace("CAST(user_id AS VARCHAR)", "CAST(user_id % 8 AS VARCHAR)")
_SQL_FLEET = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY duid, measurement_datetime ORDER BY event_id) AS _n FROM ({_SQL_FLEET}) f) WHERE _n = 1"
_SQL_FLEET_DISPATCH = f"""
SELECT duid, CAST(settlementdate - INTERVAL 4 HOUR - INTERVAL 1 MICROSECOND AS DATE) AS market_day, settlementdate,
       initialmw, initial_energy_storage, energy_storage
FROM (SELECT 'U' || CAST(user_id % 8 AS VARCHAR) AS duid, date_trunc('second', ts) AS settlementdate, value AS initialmw,
             CASE WHEN event_id % 3 <> 0 THEN value * 2 END AS initial_energy_storage,
             CASE WHEN event_id % 5 <> 0 THEN value / 2 END AS energy_storage,
             row_number() OVER (PARTITION BY user_id % 8, date_trunc('second', ts) ORDER BY event_id) AS _n FROM events) e
WHERE _n = 1"""


def _fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("user_id", F.col("user_id") % 8)
    first = Window.partitionBy("user_id", F.date_trunc("second", "ts")).orderBy("event_id")
    return events.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def _numbered(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """Lines of the written text files with folder values and line number (1..)."""
    lines = spark.read.text(path, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), "value",
    )
    place = Window.partitionBy("file").orderBy("block", "id")
    folders = [F.regexp_extract("file", rf"{b}=([^/]*)/", 1).alias(b) for b in by]
    return lines.select(*folders, F.row_number().over(place).alias("line_no"), "value")


@register(
    "scada_csv_lines",
    f"""SELECT duid, CAST(market_day AS VARCHAR) AS market_day,
       CAST(1 + row_number() OVER (PARTITION BY duid, market_day ORDER BY measurement_datetime) AS INTEGER) AS line_no,
       strftime(interval_datetime, '%Y-%m-%d %H:%M:%S') AS c1, strftime(measurement_datetime, '%Y-%m-%d %H:%M:%S') AS c2,
       measured_mw AS mw, mw_quality_flag AS flag FROM ({_SQL_FLEET}) s
UNION ALL SELECT DISTINCT duid, CAST(market_day AS VARCHAR), 1, 'INTERVAL_DATETIME', 'MEASUREMENT_DATETIME', NULL, NULL FROM ({_SQL_FLEET}) s""",
)
def q_scada_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, f"csv-{uuid.uuid4().hex}")
    write_csv(events_as_scada(_fleet(spark, sf_dir)), path)
    lines = _numbered(spark, path, ["duid", "market_day"])
    part = lambda i: F.get(split_fields("value"), F.lit(i))
    return lines.select(
        "duid", "market_day", "line_no", part(0).alias("c1"), part(1).alias("c2"),
        to_double(part(2)).alias("mw"), to_int(part(3)).alias("flag"),
    )


@register(
    "dispatch_csv_lines",
    f"""SELECT duid, CAST(market_day AS VARCHAR) AS market_day,
       CAST(1 + row_number() OVER (PARTITION BY duid, market_day ORDER BY settlementdate) AS INTEGER) AS line_no,
       strftime(settlementdate, '%Y-%m-%d %H:%M:%S') AS c1, initialmw AS mw, initial_energy_storage AS first_mwh, energy_storage AS last_mwh
FROM ({_SQL_FLEET_DISPATCH}) s
UNION ALL SELECT DISTINCT duid, CAST(market_day AS VARCHAR), 1, 'SETTLEMENTDATE', NULL, NULL, NULL FROM ({_SQL_FLEET_DISPATCH}) s""",
)
def q_dispatch_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, f"csv-{uuid.uuid4().hex}")
    write_csv(events_as_dispatch(_fleet(spark, sf_dir)), path)
    part = lambda i: F.get(split_fields("value"), F.lit(i))
    return _numbered(spark, path, ["duid", "market_day"]).select(
        "duid", "market_day", "line_no", part(0).alias("c1"), to_double(part(1)).alias("mw"),
        to_double(part(2)).alias("first_mwh"), to_double(part(3)).alias("last_mwh"),
    )


@register(
    "dispatch_json_lines",
    f"""SELECT CAST(market_day AS VARCHAR) AS market_day, duid,
       CAST(row_number() OVER (PARTITION BY duid, market_day ORDER BY settlementdate) AS INTEGER) AS place,
       strftime(settlementdate, '%Y-%m-%d %H:%M:%S') AS settlementdate, initialmw, initial_energy_storage, energy_storage
FROM ({_SQL_FLEET_DISPATCH}) s""",
)
def q_dispatch_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, f"json-{uuid.uuid4().hex}")
    write_json(events_as_dispatch(_fleet(spark, sf_dir)), path)
    lines = _numbered(spark, path, ["market_day"])
    record = "duid string, settlementdate string, initialmw double, initial_energy_storage double, energy_storage double"
    lines = lines.select("market_day", "line_no", F.from_json("value", record).alias("r"))
    # a file holds whole units, one after the other: the place of a line among its unit's lines
    place = Window.partitionBy("market_day", "r.duid").orderBy("line_no")
    return lines.select(
        "market_day", "r.duid", F.row_number().over(place).alias("place"), "r.settlementdate", "r.initialmw",
        "r.initial_energy_storage", "r.energy_storage",
    )


@register(
    "scada_parquet_layout",
    f"""SELECT 'market_day=' || CAST(market_day AS VARCHAR) AS folder, duid, market_day, interval_datetime, measurement_datetime,
       measured_mw, mw_quality_flag FROM ({_SQL_FLEET}) s""",
)
def q_scada_parquet_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, f"parquet-{uuid.uuid4().hex}")
    series = events_as_scada(_fleet(spark, sf_dir))
    write_parquet(series, path)
    folder = F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1)
    return spark.read.schema(series.schema).parquet(path).select(
        folder.alias("folder"), "duid", "market_day", "interval_datetime", "measurement_datetime", "measured_mw", "mw_quality_flag"
    )
