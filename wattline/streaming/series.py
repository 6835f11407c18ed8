"""The de-duplicated series as a stream, with bounded keyed state.

Two streams. The first parses new feed files a batch at a time and appends their
typed readings, each with its place (file, line), to a table; a batch that is
run again replaces its own folder. The second reads that table and keeps, per
(unit, time), the reading of the first place: state is held per key until the
watermark (two market days behind the latest reading) passes it, then the
reading is written and its state dropped. Files may arrive in any order within
the two days; the written table is what the batch plan gives for them, and no
written day is read again. Readings that arrive later than that are not taken.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.dates import market_day_instant, market_day_interval_end, ntz_micros
from ..plans.dispatch import cast_dispatch, parse_dispatch
from ..plans.scada import cast_scada, parse_scada
from ..session import checkpoint_dir, release_cached
from ..sources.lines import line_key

LATENESS = "2 days"

# feed kind → (parse, cast, time, market day)
KINDS = {
    "scada": (parse_scada, cast_scada, "measurement_datetime", market_day_instant),
    "dispatch": (parse_dispatch, cast_dispatch, "settlementdate", market_day_interval_end),
}
READINGS = {
    "scada": (
        "file string, line_key struct<part:bigint,pos:bigint>, duid string, interval_datetime timestamp_ntz,"
        " measurement_datetime timestamp_ntz, measured_mw double, mw_quality_flag int"
    ),
    "dispatch": (
        "file string, line_key struct<part:bigint,pos:bigint>, duid string, settlementdate timestamp_ntz, initialmw double,"
        " initial_energy_storage double, energy_storage double"
    ),
}


def parse_batch(batch: DataFrame, epoch: int, readings: str, kind: str) -> None:
    """Typed readings of one batch of ``(file, block, value)`` rows, in a folder
    of the batch: a replay replaces it."""
    parse, cast, time, _ = KINDS[kind]
    lines = batch.select(
        "file", line_key(F.col("block"), F.monotonically_increasing_id()).alias("line_key"), "value",
        F.lpad(F.col("block").cast("string"), 20, "0").alias("piece"),
    )
    typed = cast(parse(lines).rows).where(F.col(time).isNotNull())
    typed.write.mode("overwrite").parquet(f"{readings}/batch={epoch:012d}")
    release_cached()


def start_readings(spark: SparkSession, landing_dir: str, readings: str, kind: str = "scada", once: bool = False) -> StreamingQuery:
    """Watch ``landing_dir`` for feed files; append their readings to ``readings``."""
    raw = spark.readStream.format("text").load(landing_dir).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    stream = raw.writeStream.foreachBatch(lambda df, epoch: parse_batch(df, epoch, readings, kind))
    return _start(stream, readings, once)


def start_series(spark: SparkSession, readings: str, out: str, kind: str = "scada", once: bool = False,
                 lateness: str = LATENESS) -> StreamingQuery:
    """Write the first reading of each (unit, time) in ``readings`` to ``out``,
    in folders of its market day, once the watermark has passed it."""
    _, _, time, market_day = KINDS[kind]
    rows = spark.readStream.schema(READINGS[kind]).option("recursiveFileLookup", True).parquet(readings)
    payload = [c for c in rows.columns if c not in ("file", "line_key", "duid")]
    place = F.struct("file", "line_key")
    # a watermark wants an instant: the wall-clock time, read as UTC, in any session zone
    timed = rows.withColumn("at", F.timestamp_micros(ntz_micros(time)))
    first = (
        timed.withWatermark("at", lateness).groupBy("duid", "at")
        .agg(F.min(F.struct(place.alias("place"), F.struct(*payload).alias("row"))).alias("first"))
    )
    series = first.select("duid", "first.row.*").withColumn("market_day", market_day(time))
    stream = series.writeStream.outputMode("append").format("parquet").partitionBy("market_day").option("path", out)
    return _start(stream, out, once)


def _start(stream, table: str, once: bool) -> StreamingQuery:
    import hashlib

    folder = hashlib.sha256(table.rstrip("/").encode()).hexdigest()
    spark = SparkSession.active()
    stream = stream.option("checkpointLocation", os.path.join(checkpoint_dir(spark), "series", folder))
    stream = stream.trigger(availableNow=True) if once else stream.trigger(processingTime="1 minute")
    return stream.start()
