"""Chart-ready shaping of the series and summaries (drawing excluded).

Everything stays in long form (one row per point / per card); a collected
per-series array is only built on request and then per (unit, day, flag),
whose size is bounded by the day's time grid after de-duplication.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.casts import format_time
from ..functions.text import display_count, display_fixed
from ..session import broadcast_if_small

DEFAULT_BY = ("duid", "market_day")


def quality_flags(spark: SparkSession) -> DataFrame:
    """Flag dimension ``(flag, label, description, color, ord)`` (5 fixed rows)."""
    return spark.createDataFrame(
        K.QUALITY_FLAGS, "flag int, label string, description string, color string, ord int"
    )


def flag_series(series: DataFrame, flags: DataFrame, flag: str = "mw_quality_flag",
                x: str = "measurement_datetime", y: str = "measured_mw", by=DEFAULT_BY) -> DataFrame:
    """One (x, y) series per flag: NULL flag drawn as −1, unknown codes get
    the label ``Flag n`` and the grey colour. The flag dimension (a handful
    of codes) is broadcast after a count."""
    s = series.select(*by, F.coalesce(F.col(flag), F.lit(-1)).alias("flag"), F.col(x).alias("x"), F.col(y).alias("y"))
    dim, _ = broadcast_if_small(flags.select("flag", "label", "color"))
    out = s.join(dim, "flag", "left")
    return out.select(
        *by,
        "flag",
        F.coalesce("label", F.concat(F.lit("Flag "), F.col("flag").cast("string"))).alias("label"),
        F.coalesce("color", F.lit(K.UNKNOWN_FLAG_COLOR)).alias("color"),
        "x",
        "y",
    )


def quality_strip(breakdown: DataFrame, flags: DataFrame, flag: str = "mw_quality_flag", by=DEFAULT_BY) -> DataFrame:
    """Badges of the present flags in the dimension's order (inner join)."""
    dim, _ = broadcast_if_small(flags.select(F.col("flag").alias(flag), "label", "color", "ord"))
    return breakdown.join(dim, flag, "inner").select(*by, flag, "label", "color", "ord", "count", "pct")


def energy_series(dispatch: DataFrame, time_col: str = "settlementdate", by=DEFAULT_BY) -> DataFrame:
    """Three named series over one time axis; a series with no value in a
    unit-day is dropped. One pass: presence is told over the unit-day (bounded
    by the day's intervals after keep-first) before the points are unpivoted;
    over a series landed by unit-day nothing is shuffled."""
    day = Window.partitionBy(*by)
    present = {c: F.bool_or(F.col(c).isNotNull()).over(day) for c, _ in K.ENERGY_SERIES}
    rows = dispatch.select(*by, time_col, *[c for c, _ in K.ENERGY_SERIES], *[p.alias(f"has_{c}") for c, p in present.items()])
    points = F.array(*[
        F.when(F.col(f"has_{c}"), F.struct(F.lit(c).alias("measure"), F.lit(n).alias("series"), F.col(c).cast("double").alias("value")))
        for c, n in K.ENERGY_SERIES
    ])
    rows = rows.select(*by, time_col, F.explode(F.array_compact(points)).alias("p"))
    return rows.select(*by, "p.measure", "p.series", time_col, "p.value")


def stat_cards(summary: DataFrame, kind: str = "scada", by=DEFAULT_BY) -> DataFrame:
    """Label/value display pairs of a summary (one row per card)."""
    cards = [
        (label, display_count(col) if digits is None else display_fixed(col, digits))
        for label, col, digits in (K.SCADA_CARDS if kind == "scada" else K.DISPATCH_CARDS)
    ]
    arr = F.array(*[
        F.struct(F.lit(i).alias("card_no"), F.lit(lbl).alias("label"), val.alias("value"))
        for i, (lbl, val) in enumerate(cards)
    ])
    return summary.select(*by, F.inline(arr))


def head_per_group(series: DataFrame, n: int, order: str = "measurement_datetime",
                   by=DEFAULT_BY) -> DataFrame:
    """First ``n`` points of each group in time order (display cap).

    The window partition is one unit-day, bounded by the time grid after
    de-duplication (21,600 slots at 4 s), so no group grows with the data.
    """
    w = Window.partitionBy(*by).orderBy(order)
    return series.withColumn("row_no", F.row_number().over(w)).where(F.col("row_no") <= n)


def json_records(series: DataFrame, time_cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """One JSON object per row: datetimes as ``YYYY-MM-DD HH:MM:SS``,
    NaN → null, NULL fields written as null."""
    cols = keep or series.columns
    fields = []
    for c in cols:
        dtype = dict(series.dtypes)[c]
        if c in time_cols:
            fields.append(format_time(c).alias(c))
        elif dtype in ("double", "float"):
            fields.append(F.when(~F.isnan(c), F.col(c)).alias(c))
        else:
            fields.append(F.col(c))
    return series.select(
        *[c for c in ("duid", "market_day") if c in series.columns],
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("record"),
    )
