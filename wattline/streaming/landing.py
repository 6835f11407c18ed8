"""Incremental landing of feed files with Structured Streaming.

Not part of the reference (it re-reads files per request); this is the
streaming form of the same batch plan. New text files in a landing folder
are parsed per micro-batch with the batch operators, and only readings
whose ``(duid, time)`` key is not yet in the output table are appended: keys already landed (overlapping files, replays after a failure)
are skipped, so a re-run batch is idempotent. Within one batch the
keep-first rule orders by file name and line; across batches the earlier
arrival wins.
"""

from __future__ import annotations

import hashlib
import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from pyspark import StorageLevel

from ..plans.dispatch import dispatch_series
from ..plans.scada import scada_series
from ..session import broadcast_if_small

# feed kind → (series builder, time column of the key)
KINDS = {
    "scada": (scada_series, "measurement_datetime"),
    "dispatch": (dispatch_series, "settlementdate"),
}
from ..sources.lines import line_key


def _existing(spark: SparkSession, out_path: str, days: DataFrame, time_col: str) -> DataFrame | None:
    try:
        old = spark.read.parquet(out_path)
    except AnalysisException as exc:
        if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise  # only a table that is not there yet counts as empty
        return None
    # partition pruning: only the market days present in this batch are read
    days, _ = broadcast_if_small(days)
    return old.join(days, "market_day", "left_semi").select("duid", time_col)


def _new_keys(series: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in ``old``; NULL keys equal each other, so a
    replay does not repeat readings without a unit id."""
    old = old.select(*[F.col(k).alias(f"_old_{k}") for k in keys])
    same = [series[k].eqNullSafe(old[f"_old_{k}"]) for k in keys]
    return series.join(old, reduce(lambda a, b: a & b, same), "left_anti")


def land_batch(batch: DataFrame, out_path: str, kind: str = "scada") -> None:
    """Parse one micro-batch of ``(file, block, value)`` rows and append the
    readings whose key is new. Line keys are assigned here: the micro-batch
    is a static frame over a fixed set of files, so a replay gets the same
    keys."""
    spark = batch.sparkSession
    lines = batch.select(
        "file", line_key(F.col("block"), F.monotonically_increasing_id()).alias("line_key"), "value",
        F.lpad(F.col("block").cast("string"), 20, "0").alias("piece"),
    )
    build, time_col = KINDS[kind]
    # the batch's series is used twice (its days, then the append): keep it
    series = build(lines).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        days = series.select("market_day").distinct()
        old = _existing(spark, out_path, days, time_col)
        new = series if old is None else _new_keys(series, old, ["duid", time_col])
        new.write.mode("append").partitionBy("market_day").parquet(out_path)
    finally:
        series.unpersist()


def start_landing(
    spark: SparkSession,
    landing_dir: str,
    out_path: str,
    kind: str = "scada",
    checkpoint: str | None = None,
    trigger_once: bool = False,
) -> StreamingQuery:
    """Watch ``landing_dir`` for text feeds of ``kind`` (``scada`` or
    ``dispatch``); land the parsed series in ``out_path``.

    ``checkpoint`` defaults to a folder under the session's shared
    ``spark.checkpoint.dir``.
    """
    if checkpoint is None:
        from ..session import checkpoint_dir

        # named by the whole path: tables of one name in two folders are two streams
        checkpoint = os.path.join(checkpoint_dir(spark), "landing", hashlib.sha256(out_path.rstrip("/").encode()).hexdigest())
    raw = spark.readStream.format("text").load(landing_dir)
    lines = raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
    )
    w = lines.writeStream.foreachBatch(lambda df, _epoch: land_batch(df, out_path, kind)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="1 minute")
    return w.start()


def start_scada_landing(spark: SparkSession, landing_dir: str, out_path: str, **kw) -> StreamingQuery:
    return start_landing(spark, landing_dir, out_path, kind="scada", **kw)


def start_dispatch_landing(spark: SparkSession, landing_dir: str, out_path: str, **kw) -> StreamingQuery:
    return start_landing(spark, landing_dir, out_path, kind="dispatch", **kw)
