"""Registered queries over archives: entry choice, fall through, bundles.

The archives are landed tables (listing and text) that Spark derives from the
driver tables; published ZIP files are read in ``tests/test_archives.py`` and
``tests/test_archive_source.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import market_day_instant
from ..sources.catalog import parse_catalog
from .archive_plans import (
    choose_and_read,
    dispatch_candidates,
    dispatch_from_archives,
    scada_candidates,
    scada_from_archives,
)
from .feeds_from_tables import dispatch_archives, landed, lineitem_as_dispatch, scada_archives, scada_bundles, table
from .table_queries import _SQL_DISPATCH, _SQL_DISPATCH_SERIES, _SQL_SCADA_SERIES, register

_SQL_SCADA_OF_DAYS = f"""SELECT duid, market_day, interval_datetime, measurement_datetime, measured_mw, mw_quality_flag
FROM ({_SQL_SCADA_SERIES}) s
WHERE market_day IN (SELECT DISTINCT CAST(ts AS DATE) FROM events)"""


def _calendar_days(events: DataFrame) -> DataFrame:
    return events.select(F.to_date("ts").alias("target_date")).distinct()


# S5, S9, S10, U3, D8 — dated CSVs in daily archives
@register("scada_from_archives", _SQL_SCADA_OF_DAYS)
def q_scada_from_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    paths, archives = scada_archives(events)
    return scada_from_archives(_calendar_days(events), parse_catalog(paths), archives=archives)


# S6, F19, U5 — inner archives, some of them corrupt in the first source
@register("nested_archive_series", _SQL_SCADA_OF_DAYS)
def q_nested_archive_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    paths, archives = scada_archives(events, nested=True)
    return scada_from_archives(_calendar_days(events), parse_catalog(paths), archives=archives)


@register(
    "archive_rejects",
    """WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events),
     bad AS (SELECT d FROM days WHERE CAST(strftime(d, '%Y%m%d') AS INTEGER) % 3 = 0)
SELECT DISTINCT t.d AS target_date, 'bad zip' AS reason, strftime(b.d, '%Y%m%d') AS archive_day
FROM days t JOIN bad b ON b.d = t.d OR b.d = t.d + 1""",
)
def q_archive_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    paths, archives = scada_archives(events, nested=True)
    candidates = scada_candidates(_calendar_days(events), parse_catalog(paths))
    _, _, rejected = choose_and_read(candidates, ["target_date", "format"], archives)
    return rejected.select(
        "target_date", F.substring_index("reason", ":", 1).alias("reason"),
        F.regexp_extract("path", r"FPPMW_(\d{8})", 1).alias("archive_day"),
    ).distinct()


# S7, S9 — bundles read by the name of the inner archive, and undated CSVs; the
# events are moved to 2026, where files bear the date of the day after
_SHIFT_DAYS = 731
_SQL_EVENTS_LATER = f"(SELECT * REPLACE (ts + INTERVAL {_SHIFT_DAYS} DAY AS ts) FROM events) events"


def _later(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts") + F.make_dt_interval(days=F.lit(_SHIFT_DAYS)))


@register("scada_bundle_series", _SQL_SCADA_SERIES.replace("FROM events", f"FROM {_SQL_EVENTS_LATER}"))
def q_scada_bundle_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _later(table(spark, sf_dir, "events"))
    paths, archives = scada_bundles(events)
    targets = events.select(market_day_instant("ts").alias("target_date")).distinct()
    return scada_from_archives(targets, parse_catalog(paths), archives=archives)


@register(
    "scada_bundle_choice",
    f"""SELECT DISTINCT d AS target_date,
       CASE WHEN day(d) % 2 = 0 THEN 'current' ELSE 'archive' END AS source,
       CASE WHEN day(d) % 2 = 0 THEN 1 ELSE 2 END AS cls,
       CASE WHEN day(d) % 2 = 1 THEN 'PUBLIC_NEXT_DAY_FPPMW_' || strftime(d + 1, '%Y%m%d') || '_0000000000000002.zip'
            WHEN day(d) % 7 = 0 THEN 'DATA.CSV' ELSE 'PUBLIC_NEXT_DAY_FPPMW_' || strftime(d + 1, '%Y%m%d') || '.CSV' END AS entry_name
FROM (SELECT CAST(ts - INTERVAL 4 HOUR AS DATE) AS d FROM {_SQL_EVENTS_LATER})""",
)
def q_scada_bundle_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _later(table(spark, sf_dir, "events"))
    paths, archives = scada_bundles(events)
    targets = events.select(market_day_instant("ts").alias("target_date")).distinct()
    chosen, _, _ = choose_and_read(scada_candidates(targets, parse_catalog(paths)), ["target_date", "format"], archives)
    return chosen.select("target_date", "source", "cls", F.col("outer").alias("entry_name"))


# S8, U5, D8 for dispatch — daily archives, some corrupt, else the month's bundle


def _market_days(lineitem: DataFrame) -> DataFrame:
    # landed: the candidates use the days several times, and each would read all rows
    return landed(lineitem_as_dispatch(lineitem).select(F.col("market_day").alias("target_date")).distinct())


@register("dispatch_from_archives", _SQL_DISPATCH_SERIES)
def q_dispatch_from_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem")
    paths, archives = dispatch_archives(lineitem, whole=True)
    return dispatch_from_archives(_market_days(lineitem), parse_catalog(paths), archives=archives)


# F19, X28 — what was rejected for which day, with the dates that a bundle has instead
@register(
    "dispatch_rejects",
    f"""WITH days AS (SELECT DISTINCT market_day AS d FROM ({_SQL_DISPATCH}) s),
     has AS (SELECT date_trunc('month', d) AS m, list_sort(list(strftime(d, '%Y%m%d')))[1:10] AS dates
             FROM days WHERE day(d) % 5 <> 0 GROUP BY 1)
SELECT d AS target_date, 'bad zip' AS reason FROM days WHERE day(d) % 4 = 0
UNION ALL
SELECT d, 'no entry for the date; dates seen: ' || array_to_string(dates, ', ')
FROM days JOIN has ON date_trunc('month', d) = m WHERE day(d) % 5 = 0""",
)
def q_dispatch_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem")
    paths, archives = dispatch_archives(lineitem)
    candidates = dispatch_candidates(_market_days(lineitem), parse_catalog(paths))
    _, _, rejected = choose_and_read(candidates, ["target_date"], archives)
    reason = F.when(F.col("reason").startswith("bad zip"), "bad zip").otherwise(F.col("reason"))
    return rejected.select("target_date", reason.alias("reason"))
