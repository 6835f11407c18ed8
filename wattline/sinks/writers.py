"""CSV, Parquet and JSON output of the series.

Layout replaces the per-download file names: ``<root>/market_day=D/duid=U/``
(CSV) or ``<root>/market_day=D/`` (Parquet, rows sorted by unit and time
inside each file). CSV keeps the feed's upper-case column names and writes
times as ``YYYY-MM-DD HH:MM:SS``; Parquet keeps typed times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.casts import format_time
from ..operators.series import json_records

SCADA_TIME_COLS = ["interval_datetime", "measurement_datetime"]
DISPATCH_TIME_COLS = ["settlementdate"]


def _time_cols(df: DataFrame) -> list[str]:
    return [c for c in SCADA_TIME_COLS + DISPATCH_TIME_COLS if c in df.columns]


def _in_order(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each unit-day in one task, rows by (day, unit, time): the order that the
    partitioned writer keeps, so it sorts nothing anew."""
    named = {c.lower(): c for c in df.columns}
    time = [named[c] for c in SCADA_TIME_COLS + DISPATCH_TIME_COLS if c in named][-1:]
    units = [c for c in ("duid",) if c in df.columns and c not in keys]
    return df.repartition(*keys, *units).sortWithinPartitions(*keys, *units, *time)


def _writer(df: DataFrame, mode: str):
    """Overwriting replaces the partitions that ``df`` holds, no others."""
    return df.write.mode(mode).option("partitionOverwriteMode", "dynamic")


def csv_frame(series: DataFrame) -> DataFrame:
    """Series → CSV-shaped frame: text times, feed column names (upper-case)."""
    times = set(_time_cols(series))
    cols = []
    for c in series.columns:
        if c in ("duid", "market_day"):
            cols.append(F.col(c))
        elif c in times:
            cols.append(format_time(c).alias(c.upper()))
        else:
            cols.append(F.col(c).alias(c.upper()))
    return series.select(*cols)


def write_csv(series: DataFrame, path: str, mode: str = "overwrite", partition_by=("market_day", "duid")) -> None:
    """One folder per unit-day (or per day, if so asked), lines in time order."""
    (
        _writer(_in_order(csv_frame(series), list(partition_by)), mode)
        .partitionBy(*partition_by)
        .option("header", True).option("nullValue", "").option("emptyValue", "")
        .csv(path)
    )


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What :func:`write_csv` wrote; ``schema`` in DDL form names the columns
    of a line (upper case) and ``duid string, market_day date``."""
    return spark.read.schema(schema).option("header", True).option("timestampNTZFormat", K.OUTPUT_TIME_FORMAT).csv(path)


MAX_ROWS_PER_FILE = 5_000_000


def write_parquet(series: DataFrame, path: str, mode: str = "overwrite", partition_by=("market_day",)) -> None:
    """Day folders, rows by unit and time in each file. Days are dealt to tasks
    by a rebalance: small days share a task, a large day is split over several,
    and no task opens a file for every day."""
    order = [c for c in (*partition_by, "duid", *_time_cols(series)[-1:]) if c in series.columns]
    (
        _writer(series.hint("rebalance", *partition_by).sortWithinPartitions(*order), mode)
        .option("maxRecordsPerFile", MAX_ROWS_PER_FILE)
        .partitionBy(*partition_by).parquet(path)
    )


def write_json(series: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line (NaN → null, NULL kept as null)."""
    recs = json_records(_in_order(series, ["market_day"]), _time_cols(series))
    _writer(recs.select("market_day", "record"), mode).partitionBy("market_day").text(path)


def write_series(series: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    {"csv": write_csv, "parquet": write_parquet, "json": write_json}[fmt](series, path, mode=mode)
