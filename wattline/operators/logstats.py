"""Request-log statistics and rank-based wait estimates.

Top-N lists are global ``ORDER BY … LIMIT`` (Spark's distributed top-k:
each task keeps N rows, one task merges them). The "last 100 views" of every
source type are one ranked pass; a group limit below the shuffle lets each
task send 100 rows of a source type at most. Seconds round half to even.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import estimate_text


def log_counts(log: DataFrame) -> DataFrame:
    """Count per action plus the overall count (window over the few actions)."""
    per = log.groupBy("action").agg(F.count(F.lit(1)).alias("cnt"))
    return per.withColumn("total_requests", F.sum("cnt").over(Window.partitionBy(F.lit(1))))


def top_counts(log: DataFrame, key: str, n: int) -> DataFrame:
    """Top ``n`` keys by count; ties broken by key (ascending)."""
    return (
        log.groupBy(key).agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.desc("cnt"), F.asc_nulls_first(key))
        .limit(n)
    )


def recent(log: DataFrame, n: int = K.LOG_RECENT) -> DataFrame:
    return log.orderBy(F.desc("id")).limit(n).select(
        "id", "timestamp", "ip", "duid", "date", "action", "duration_ms", "source_type"
    )


def defaults(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(s, K.TIMING_DEFAULT_SEC[s]) for s in K.SOURCE_TYPES], "source_type string, default_sec int"
    )


def timing_estimates(log: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Per source type: p75 (lower-nearest rank ``int(0.75 (n-1))``) of the last
    ≤100 successful view durations, in seconds; the default below 5 samples.

    Output: ``source_type, seconds, sample_count, is_default``.
    """
    spark = spark or log.sparkSession
    views = log.where(F.col("duration_ms").isNotNull() & (F.col("action") == "view"))
    # one scan: a task passes on its last TIMING_WINDOW rows of a source at most
    newest = F.row_number().over(Window.partitionBy("source_type").orderBy(F.desc("id")))
    latest = views.where(F.col("source_type").isin(K.SOURCE_TYPES)).withColumn("_rn", newest).where(
        F.col("_rn") <= K.TIMING_WINDOW
    )
    # each group holds at most TIMING_WINDOW values
    stats = latest.groupBy("source_type").agg(
        F.sort_array(F.collect_list("duration_ms")).alias("d"), F.count(F.lit(1)).alias("n")
    )
    idx = F.floor(F.lit(K.TIMING_QUANTILE) * (F.col("n") - 1)).cast("int")
    p = F.get(F.col("d"), idx)
    n = F.coalesce(F.col("n"), F.lit(0))
    is_default = n < K.TIMING_MIN_SAMPLES
    out = defaults(spark).join(stats, "source_type", "left")
    return out.select(
        "source_type",
        F.when(is_default, F.col("default_sec").cast("bigint"))
        .otherwise(F.bround(p / 1000.0).cast("bigint")).alias("seconds"),
        n.cast("bigint").alias("sample_count"),
        is_default.alias("is_default"),
    )


def combined_estimate(est: DataFrame, scada_source: str, energy_source: str = "dispatch_current") -> DataFrame:
    """Both data sets requested together run concurrently: the longer wait,
    default only if both are defaults, the smaller sample count — an
    aggregate over the two estimate rows."""
    pair = est.where(F.col("source_type").isin(scada_source, energy_source))
    out = pair.agg(
        F.max("seconds").alias("seconds"),
        F.bool_and("is_default").alias("is_default"),
        F.min("sample_count").alias("sample_count"),
    ).select(F.lit(scada_source).alias("scada_source"), "seconds", "is_default", "sample_count")
    return out.withColumn("text", estimate_text("seconds", "is_default", "sample_count"))
