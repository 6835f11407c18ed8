"""Request log: an append-only Parquet table.

Older log parts may lack ``duration_ms`` / ``source_type``; reading merges
schemas and fills absent columns with NULL (additive migration).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = [
    ("id", "bigint"),
    ("timestamp", "timestamp_ntz"),
    ("ip", "string"),
    ("duid", "string"),
    ("date", "date"),
    ("action", "string"),
    ("duration_ms", "bigint"),
    ("source_type", "string"),
]


def conform_log(df: DataFrame) -> DataFrame:
    """Fixed log columns; absent ones are NULL of the declared type."""
    present = set(df.columns)
    return df.select(*[
        (F.col(c).cast(t) if c in present else F.lit(None).cast(t)).alias(c) for c, t in LOG_SCHEMA
    ])


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return conform_log(spark.read.option("mergeSchema", "true").parquet(path))


def append_log(rows: DataFrame, path: str) -> None:
    """Append a batch of log rows. A failure is the caller's to see: a batch
    that vanishes would make every later statistic wrong."""
    conform_log(rows).write.mode("append").parquet(path)
