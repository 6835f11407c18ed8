"""Keep-first de-duplication.

"First" is an explicit order (file order, then line key), not arrival order:
``dropDuplicates`` keeps an arbitrary row, so it is not used.

Default strategy aggregates ``min(struct(order, payload))`` per key. The
aggregate is partial: each map task collapses its own copies of a key
before the shuffle, so a key holding a large share of all rows never sends
more than one row per task across the network. The ``window`` strategy
(``row_number() = 1``) sends as little: Spark puts a group limit below its
shuffle, which sorts rows by key in the map task, as the aggregate does too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(
    df: DataFrame,
    keys: list[str],
    order: list[str | Column],
    strategy: str = "aggregate",
) -> DataFrame:
    """One row per ``keys``: the row that is smallest by ``order`` (NULLs first)."""
    payload = [c for c in df.columns if c not in keys]
    order_names = {o for o in order if isinstance(o, str)}
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    if strategy == "window":
        w = Window.partitionBy(*keys).orderBy(*[o.asc_nulls_first() for o in order_cols])
        return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    # columns of the order are not carried twice
    at = {c: f"_first.p.{c}" for c in payload} | {o: f"_first.o._o{i}" for i, o in enumerate(order) if isinstance(o, str)}
    rest = [c for c in payload if c not in order_names]
    packed = F.struct(
        F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order_cols)]).alias("o"),
        *([F.struct(*rest).alias("p")] if rest else []),
    )
    return (
        df.groupBy(*keys)
        .agg(F.min(packed).alias("_first"))
        .select(*keys, *[F.col(at[c]).alias(c) for c in payload])
    )
