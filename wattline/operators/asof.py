"""As-of joins: for each left row, the ``k`` right rows with the largest order
key not above the left key.

The right side (a catalog of bundles, a list of headers, ...) is cut into
buckets of its order key: months, for dates. Ranks and validity intervals are
made within a bucket, and the left rows meet the intervals of their own bucket
only, by an equi join on ``by`` and the bucket with a range test inside. What a
left row lacks in its bucket comes from earlier ones: every bucket passes on its
``k`` best rows, whatever it holds, and these are numbered through, so that the
candidates are reached by an equi join on their number. No task holds more
than one bucket of a group, or ``k`` rows of each of its buckets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month_of(day: Column) -> Column:
    """Months since year 0: the bucket of a date."""
    return F.year(day) * 12 + F.month(day) - 1


def asof_topk(
    left: DataFrame,
    right: DataFrame,
    *,
    by: list[str],
    left_on: str,
    right_on: str,
    tiebreak: list[str],
    k: int = 1,
    bucket: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Left rows × their ``k`` best right rows with ``right_on <= left_on``,
    best = largest ``(right_on, *tiebreak)``; adds ``asof_rank`` (1 = best).

    Left rows with no candidate are dropped (inner semantics), as are rows
    without a key. ``bucket`` maps an order key to a bucket number and must not
    descend as the key ascends: the month for dates and times, else, where none is
    given, the whole part of the key.
    """
    if bucket is None:
        dated = right.schema[right_on].dataType.typeName() in ("date", "timestamp", "timestamp_ntz")
        bucket = month_of if dated else F.floor
    group = [F.col(b).alias(f"_r_{b}") for b in by]
    keys = [f"_r_{b}" for b in by]
    ranked = right.where(F.col(right_on).isNotNull()).select(
        *group, bucket(F.col(right_on)).cast("long").alias("_bucket"), F.col(right_on).alias("_key"),
        F.struct(*[F.col(t) for t in tiebreak]).alias("_tie"),
        F.struct(*[F.col(c).alias(f"right_{c}") for c in right.columns if c not in by]).alias("_row"),
    )
    within = Window.partitionBy(*keys, "_bucket")
    ranked = ranked.withColumn("_no", F.row_number().over(within.orderBy("_key", "_tie")).cast("long"))
    ranked = ranked.withColumn("_n", F.count("*").over(within))

    # [key, next key of the bucket) and the number of the best row up to there
    intervals = ranked.groupBy(*keys, "_bucket", "_key").agg(F.max("_no").alias("_top"))
    intervals = intervals.withColumn("_next", F.lead("_key").over(within.orderBy("_key")))

    # the k best rows of each bucket, numbered through the buckets of a group
    best = ranked.where(F.col("_no") > F.col("_n") - k)
    passed = best.withColumn("_no", F.row_number().over(Window.partitionBy(*keys).orderBy("_bucket", "_no")).cast("long"))
    rows = ranked.select(*keys, "_bucket", "_no", "_row").unionByName(
        passed.select(*keys, F.lit(-1).cast("long").alias("_bucket"), "_no", "_row")
    )

    asked = left.where(F.col(left_on).isNotNull()).withColumn("_asked", bucket(F.col(left_on)).cast("long"))
    # how many of them lie before each bucket that a left row asks for
    held = best.groupBy(*keys, "_bucket").agg(F.count("*").alias("_held"))
    needed = asked.select(*group, F.col("_asked").alias("_bucket"), F.lit(0).cast("long").alias("_held")).distinct()
    before = held.unionByName(needed).groupBy(*keys, "_bucket").agg(F.sum("_held").alias("_held"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select(*keys, "_bucket", F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_before"))

    def same(bucket_col: str, other: DataFrame) -> Column:
        cond = F.col(bucket_col) == other["_bucket"]
        for b in by:
            cond = cond & (F.col(b) == other[f"_r_{b}"])
        return cond

    hit = asked.join(before, same("_asked", before)).drop("_bucket", *keys)
    inside = (F.col(left_on) >= F.col("_key")) & (F.col("_next").isNull() | (F.col(left_on) < F.col("_next")))
    hit = hit.join(intervals, same("_asked", intervals) & inside, "left").drop("_bucket", "_key", "_next", *keys)
    top = F.coalesce(F.col("_top"), F.lit(0))
    # candidates 1.. of the own bucket, then those passed on, newest first
    hit = hit.withColumn("asof_rank", F.explode(F.sequence(F.lit(1), F.lit(k))))
    own = F.col("asof_rank") <= top
    hit = hit.withColumn("_from", F.when(own, F.col("_asked")).otherwise(F.lit(-1)))
    hit = hit.withColumn("_want", F.when(own, top - F.col("asof_rank") + 1).otherwise(F.col("_before") - (F.col("asof_rank") - top) + 1))
    hit = hit.where(F.col("_want") >= 1).drop("_top", "_before", "_asked")
    found = hit.join(rows, same("_from", rows) & (F.col("_want") == F.col("_no")))
    return found.select(*left.columns, "asof_rank", "_row.*")
