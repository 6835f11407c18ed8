"""Unit registry, quality-flag dimension and source fallback.

The registry arrives as an exported sheet: either a table whose columns
are the sheet headers (Parquet/CSV with header), or text lines with title
rows above the header row. Both end in canonical STRING columns
``duid, name, tech, status, region, capacity_mw, capacity_mwh``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.casts import unquote
from ..functions.text import clean_cell, split_fields
from ..session import broadcast_if_small

REQUIRED_REGISTRY = ("duid", "tech", "status", "region")


def header_ranks(headers: list[str], target: str) -> list[tuple[bool, int]]:
    """Columns that can stand for ``target``, as (not exact, position): names
    that begin with it in any case, the exact name ranking before the rest."""
    wanted = target.casefold()
    return [(name != target, at) for at, name in enumerate(headers) if name.casefold().startswith(wanted)]


def registry_from_sheet(df: DataFrame) -> DataFrame:
    """Sheet-shaped table (columns named by the header row) → canonical
    STRING columns. Missing optional columns come out as ''."""
    headers = [c.strip() for c in df.columns]
    ranks = {key: header_ranks(headers, target) for key, target in K.REGISTRY_COLUMNS.items()}
    absent = [K.REGISTRY_COLUMNS[key] for key in REQUIRED_REGISTRY if not ranks[key]]
    if absent:
        raise ValueError(f"unit registry lacks {absent}; its columns are {headers}")
    return df.select(*[
        (clean_cell(F.col(f"`{df.columns[min(found)[1]]}`")) if found else F.lit("")).alias(key)
        for key, found in ranks.items()
    ])


def _position_expr(hdr: Column, target: str) -> Column:
    """1-based position of ``target`` in a header array (X21 rule), 0 if absent."""
    exact = F.array_position(hdr, target)
    prefix = F.array_position(F.transform(hdr, lambda h: F.lower(h).startswith(target.lower())), True)
    return F.when(exact > 0, exact).otherwise(prefix)


def registry_from_lines(lines: DataFrame) -> DataFrame:
    """CSV text of the sheet with title rows: the header is the first row of
    each file that names the unit-id and technology columns; rows after it
    are data. Fields are looked up by header position (expressions only). A
    file without such a row, or whose header lacks a required column, is an
    error: nothing is dropped unseen."""
    cells = lines.select(
        "file", "line_key",
        F.transform(split_fields("value"), lambda x: F.trim(unquote(x))).alias("cells"),
    )
    is_header = F.array_contains("cells", K.REGISTRY_COLUMNS["duid"]) & F.exists(
        "cells", lambda c: F.lower(c).startswith(K.REGISTRY_COLUMNS["tech"].lower())
    )
    hdr = cells.where(is_header).groupBy("file").agg(
        F.min_by(F.struct("line_key", "cells"), "line_key").alias("h")
    ).select(F.col("file").alias("_hfile"), F.col("h.line_key").alias("_hkey"), F.col("h.cells").alias("_hdr"))
    # one header row per file: a small, per-file table
    hdr = hdr.select("_hfile", "_hkey", *[
        _position_expr(F.col("_hdr"), target).alias(f"_p_{key}") for key, target in K.REGISTRY_COLUMNS.items()
    ])
    hdr, _ = broadcast_if_small(hdr)
    files = cells.select(F.col("file").alias("_hfile")).distinct().join(hdr, "_hfile", "left")
    lacks = F.greatest(*[F.coalesce(F.col(f"_p_{key}"), F.lit(0)) == 0 for key in REQUIRED_REGISTRY])
    faulty = files.where(lacks).select("_hfile").orderBy("_hfile").take(5)
    if faulty:
        raise ValueError(f"unit registry text without its required columns, for one: {[r[0] for r in faulty]}")
    data = cells.join(hdr, (F.col("file") == F.col("_hfile")) & (F.col("line_key") > F.col("_hkey")))
    return data.select(*[
        clean_cell(F.when(F.col(f"_p_{key}") > 0, F.get(F.col("cells"), F.col(f"_p_{key}") - 1))).alias(key)
        for key in K.REGISTRY_COLUMNS
    ])


def states(spark: SparkSession) -> DataFrame:
    """Region code → state (5 fixed rows)."""
    return spark.createDataFrame(K.REGION_TO_STATE, "region string, state string")


def units_from_registry(reg: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """In-service battery units with a known region and a unit id.

    Output: ``state, duid, name, capacity_mw, capacity_mwh, region``.
    """
    spark = spark or reg.sparkSession
    ok = (
        (F.col("tech") == K.BATTERY_TECH)
        & (F.col("status") == K.IN_SERVICE)
        & (F.col("duid") != "")
    )
    units = reg.where(ok)
    units = units.join(F.broadcast(states(spark)), "region", "inner")
    return units.select(
        "state",
        "duid",
        F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("duid")).alias("name"),
        F.col("capacity_mw").try_cast("double").alias("capacity_mw"),
        F.col("capacity_mwh").try_cast("double").alias("capacity_mwh"),
        "region",
    )


def units_by_state(units: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Per state (all five, empty ones included): unit count, first/last unit
    id, total MW; plus overall totals (units, non-empty states).

    Units are aggregated first (partial aggregation), then the five-row state
    list is joined, so no state's units are ever gathered in one place."""
    spark = spark or units.sparkSession
    agg = units.groupBy("state").agg(
        F.count(F.lit(1)).alias("n_units"),
        F.min("duid").alias("first_duid"),
        F.max("duid").alias("last_duid"),
        F.round(F.sum("capacity_mw"), 2).alias("total_mw"),
    )
    all_states = states(spark).select("state")
    out = all_states.join(agg, "state", "left").select(
        "state", F.coalesce("n_units", F.lit(0)).alias("n_units"), "first_duid", "last_duid", "total_mw"
    )
    w = Window.partitionBy(F.lit(1))  # five rows: a whole-frame window is bounded
    return out.withColumn("total_units", F.sum("n_units").over(w)).withColumn(
        "nonempty_states", F.sum(F.when(F.col("n_units") > 0, 1).otherwise(0)).over(w)
    )


def units_nested(units: DataFrame) -> DataFrame:
    """The registry's nested form as rows, one per unit and one for each state
    without units: ``state, unit_no`` (1.. by unit id within its state, 0 if
    none) and ``unit`` (struct or NULL). Rows, not one map: no state's units
    are gathered, however many there are. The states come in alphabetical
    order with :func:`in_state_order`."""
    unit = F.struct("duid", "name", "capacity_mw", "capacity_mwh", "region").alias("unit")
    number = F.row_number().over(Window.partitionBy("state").orderBy("duid", "name"))
    rows = units.select("state", number.alias("unit_no"), unit)
    empty = states(units.sparkSession).select("state").distinct().join(units.select("state"), "state", "left_anti")
    none = F.lit(None).cast(rows.schema["unit"].dataType)
    return rows.unionByName(empty.select("state", F.lit(0).alias("unit_no"), none.alias("unit")))


def in_state_order(df: DataFrame) -> DataFrame:
    """Rows by state, alphabetically, as the unit list shows them; adds
    ``state_no`` (1..)."""
    order = sorted({state for _, state in K.REGION_TO_STATE})
    number = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("state")).cast("int")
    rest = [c for c in ("unit_no", "duid") if c in df.columns]
    return df.withColumn("state_no", number).orderBy("state_no", *rest)


def write_registry_json(units: DataFrame, path: str) -> None:
    """The nested form as JSON text, one line a unit or empty state
    (``{"state": ..., "unit": {...}}``), spread over as many files as the
    units need."""
    units_nested(units).select(
        F.to_json(F.struct("state", "unit"), {"ignoreNullFields": "false"}).alias("value")
    ).write.text(path)


def read_registry_rows(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_registry_json` wrote, as flat canonical units."""
    unit = "struct<duid:string, name:string, capacity_mw:double, capacity_mwh:double, region:string>"
    parsed = spark.read.text(path).select(F.from_json("value", f"state string, unit {unit}").alias("x"))
    return parsed.select("x.state", "x.unit.*").where(F.col("duid").isNotNull())


#: Units of one state in one object of the map form.
UNITS_PER_OBJECT = 1000


def write_registry_map(units: DataFrame, path: str) -> None:
    """The map form ``{state: [unit, ...]}`` as JSON, an object a line. A state's
    units are dealt over as many objects as they need (about UNITS_PER_OBJECT
    each), so no state is gathered; every state without units has an empty list."""
    n = units.count()
    unit = F.struct("duid", "name", "capacity_mw", "capacity_mwh", "region")
    part = F.pmod(F.xxhash64("duid"), F.lit(max(1, -(-n // UNITS_PER_OBJECT))))
    lists = units.groupBy("state", part.alias("part")).agg(F.sort_array(F.collect_list(unit)).alias("units")).drop("part")
    empty = states(units.sparkSession).select("state").distinct().join(units.select("state"), "state", "left_anti")
    lists = lists.unionByName(empty.select("state", F.array().cast(lists.schema["units"].dataType).alias("units")))
    lists.select(F.to_json(F.create_map("state", "units"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def _objects(spark: SparkSession, path: str, wholetext: bool) -> DataFrame:
    """(file, key, value) of the members of all JSON objects under ``path``, the
    value as VARIANT; a file or line that is no JSON has one row without a key."""
    raw = spark.read.text(path, wholetext=wholetext).select(
        F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v")
    )
    members = raw.lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer())).select("file", "key", "value")
    return members


def read_registry_json(spark: SparkSession, path: str, wholetext: bool = True) -> DataFrame:
    """Registry file in the map form ``{state: [unit, ...]}`` → flat canonical
    units (an empty state yields no unit row). ``wholetext``: one object a file,
    over any number of lines; else an object a line.

    States are read one by one: a state that is no list, or a member of a list
    that is no unit with an id, is left out (see :func:`registry_json_rejects`)
    and the others stay."""
    members = _objects(spark, path, wholetext)
    units = members.lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).select(F.col("key").alias("_name"), F.col("value").alias("unit")))

    def field(name: str, kind: str) -> Column:
        return F.try_variant_get("unit", f"$.{name}", kind).alias(name)

    flat = units.where(F.col("key").isNotNull() & F.col("_name").isNull()).select(
        F.col("key").alias("state"), field("duid", "string"), field("name", "string"),
        field("capacity_mw", "double"), field("capacity_mwh", "double"), field("region", "string"),
    )
    return flat.where(F.col("duid").isNotNull()).withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.col("duid")))


def registry_json_rejects(spark: SparkSession, path: str, wholetext: bool = True) -> DataFrame:
    """(file, state, reason) of what :func:`read_registry_json` leaves out."""
    members = _objects(spark, path, wholetext)
    shape = F.schema_of_variant("value")
    return members.select(
        "file", F.col("key").alias("state"),
        F.when(F.col("key").isNull(), "not a JSON object").when(~shape.startswith("ARRAY"), "not a list of units").alias("reason"),
    ).where(F.col("reason").isNotNull())


def read_quality_flags(spark: SparkSession, path: str) -> DataFrame:
    """Flag description file ``{code: {label, description, color}}``; a code that
    is no whole number or has no description object is left out."""
    members = _objects(spark, path, wholetext=True)
    fields = [F.try_variant_get("value", f"$.{c}", "string").alias(c) for c in ("label", "description", "color")]
    return members.select(F.col("key").try_cast("int").alias("flag"), *fields).where(
        F.col("flag").isNotNull() & F.coalesce("label", "description", "color").isNotNull()
    )


def first_readable(sources: list[Callable[[], DataFrame]]) -> DataFrame:
    """First source that can be read and has a row (fresh → stale → static).

    Only the choice is made on the driver (a one-row probe); data stays in
    Spark."""
    errors = []
    for make in sources:
        try:
            df = make()
            if df.limit(1).count() > 0:
                return df
        except Exception as exc:  # noqa: BLE001 - a source that fails is skipped
            errors.append(repr(exc))
    raise ValueError(f"no readable source: {errors}")
