"""Line sources: feed text as ``(file, line_key, value)`` rows.

``line_key`` is ``STRUCT<part: BIGINT, pos: BIGINT>`` and orders the lines of
one file. For text files it is ``(file_block_start, monotonically_increasing_id)``:
the id grows along the rows of one input split and the block start orders
the splits of a file, so the key orders a file even when it is split across
tasks. Both are deterministic for a given input, so a lost task recomputes
the same keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_KEY_TYPE = "struct<part:bigint,pos:bigint>"


def line_key(part: Column | int, pos: Column | int) -> Column:
    part = F.lit(part) if isinstance(part, int) else part
    pos = F.lit(pos) if isinstance(pos, int) else pos
    return F.struct(part.cast("bigint").alias("part"), pos.cast("bigint").alias("pos"))


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Text files → ``(file, line_key, value)``; UTF-8 decoded by the reader."""
    if isinstance(paths, str):
        paths = [paths]
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        line_key(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("line_key"),
        F.col("value"),
        # a split of a file is read by one task in line order
        F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0").alias("piece"),
    )


def lines_from_frame(df: DataFrame, file: Column | str, key: Column, value: Column | str) -> DataFrame:
    """Any DataFrame → line rows (for feeds landed in tables or derived in Spark)."""
    f = F.col(file) if isinstance(file, str) else file
    v = F.col(value) if isinstance(value, str) else value
    return df.select(f.cast("string").alias("file"), key.cast(LINE_KEY_TYPE).alias("line_key"), v.cast("string").alias("value"))


def land_lines(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write feed lines once as a Parquet table ``(file, line_key, tag, value)``.

    Rows are range-partitioned on (file, line) — a large file is split over
    several tasks, never gathered in one — and sorted by line, so a file's
    lines stay in order and a later parse needs no sorting of its own: each
    split of the written table is a piece of the carry-forward. Comment lines
    are told by the stored tag, a filter that reaches the scan.
    The written table is also a lineage cut for the parse that follows.
    """
    tagged = lines.select(
        "file", "line_key", F.upper(F.trim(F.substring_index("value", ",", 1))).alias("tag"), "value"
    )
    (
        tagged.repartitionByRange("file", "line_key")
        .sortWithinPartitions("file", "line_key")
        .write.mode(mode)
        .parquet(path)
    )


def read_landed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Landed lines (see :func:`land_lines`), with the stored ``tag`` column and
    ``piece``: the written files ascend along a feed file, and so do their splits."""
    block = F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0")
    return spark.read.parquet(path).select("*", F.concat(F.col("_metadata.file_name"), F.lit("#"), block).alias("piece"))
