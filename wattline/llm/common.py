"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# the six ASCII white-space characters that separate words
SPACES = " \t\n\x0b\x0c\r"

# A group that holds at least 1 / HEAVY_SHARE of all rows is heavy; by
# arithmetic there are at most HEAVY_SHARE of them, whatever the data.
HEAVY_SHARE = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(id_col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (null ids fall in fold 0)."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % n, F.lit(0))


def without_spaces(text: Column) -> Column:
    """The text after deleting every white-space character."""
    return reduce(lambda c, ch: F.replace(c, F.lit(ch), F.lit("")), SPACES, F.coalesce(text, F.lit("")))


def attach_groups(
    rows: DataFrame, key: str, groups: DataFrame, size: str, values: list[str], spread: Column, total: int
) -> DataFrame:
    """Left-join ``values`` of ``groups`` (one row per ``key``, ``size`` rows
    each of ``total``) to ``rows`` without sending a heavy key to one task.

    Heavy groups (at most HEAVY_SHARE rows, by arithmetic) are broadcast; what
    they match takes the binary ``spread`` as its join key from then on, so it
    is dealt evenly and matches nothing. All other keys hold less than
    1 / HEAVY_SHARE of the rows and are joined by a shuffle."""
    heavy = groups.filter(F.col(size) * HEAVY_SHARE >= F.lit(total))
    light = groups.filter(F.col(size) * HEAVY_SHARE < F.lit(total))
    heavy = heavy.select(F.col(key).alias("_hk"), F.lit(True).alias("_hot"), *[F.col(v).alias(f"_h_{v}") for v in values])
    light = light.select(F.col(key).alias("_lk"), *[F.col(v).alias(f"_l_{v}") for v in values])
    hot = rows.join(F.broadcast(heavy), F.col(key) == F.col("_hk"), "left")
    hot = hot.withColumn("_rk", F.when(F.col("_hot"), spread).otherwise(F.col(key)))
    # one plan at every size, so that what is shuffled grows with the input
    out = hot.join(light.hint("merge"), F.col("_rk") == F.col("_lk"), "left")
    return out.select(
        *rows.columns,
        *[F.when(F.col("_hot"), F.col(f"_h_{v}")).otherwise(F.col(f"_l_{v}")).alias(v) for v in values],
    )


def one_row_per_key(rows: DataFrame, keys: list[str], row: str, *order: Column) -> DataFrame:
    """The struct ``row`` of ``rows``, once for each value of ``keys`` (null
    is a value of its own): the least by ``order``, then by its JSON. Hashes of
    keys are counted first (they alone are shuffled); only if some repeat are
    rows brought together."""
    if rows.groupBy(F.xxhash64(*keys).alias("h")).count().filter("count > 1").isEmpty():
        return rows.select(f"{row}.*")
    first = F.min_by(F.col(row), F.struct(*order, F.to_json(row)))
    return rows.groupBy(*keys).agg(first.alias(row)).select(f"{row}.*")


def chunks(texts: list, most_chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Index ranges over ``texts`` of about ``most_chars`` characters each
    (one text at least), so that helper arrays stay small."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= most_chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
