"""Session helpers: building a session, lineage cuts, size-checked broadcast."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows and unpacked bytes a side may hold to be broadcast. The side is
# materialised first, so both bounds are checked, never assumed.
DEFAULT_BROADCAST_ROWS = 500_000
DEFAULT_BROADCAST_BYTES = 64 << 20


def get_spark(
    master: str | None = None,
    app: str = "wattline",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the settings the library relies on.

    On a cluster, leave ``master`` unset and let spark-submit decide; the
    settings here only switch on adaptive execution and pin a time zone.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # checkpoint files of DataFrames that are no longer referenced are removed
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session; only when it is unset (local tests) a folder of
    our own is chosen and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="wattline-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers on every executor.

    The package is zipped once per application and handed to
    ``SparkContext.addPyFile``, which serves it to executors from the driver;
    nothing relies on a PYTHONPATH or a working folder there. Call before the
    first Python task (every operator that has one does)."""
    sc = spark.sparkContext
    if getattr(sc, "_wattline_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    stage = tempfile.mkdtemp(prefix="wattline-pkg-")
    shutil.copytree(here, os.path.join(stage, "src", "wattline"), ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(stage, "wattline"), "zip", os.path.join(stage, "src")))
    sc._wattline_shipped = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table inside the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "tables", name)


# Row groups of a landed table: a file that one task wrote is read by several.
LANDED_GROUP_BYTES = 16 << 20


def land(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it
    back: lineage is cut, a lost executor costs no recomputation of what is
    written, and later readers prune columns (and folders of ``partition_by``)."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.option("parquet.block.size", LANDED_GROUP_BYTES).partitionBy(*(partition_by or [])).parquet(path)
    landed = df.sparkSession.read.schema(df.schema).parquet(path)
    landed._landed_at = path
    return landed


def remove_landed(*tables: DataFrame) -> None:
    """Delete tables that :func:`land` wrote, once what was made of them is
    written too: nothing may need them any more, not even after a loss."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._landed_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def land_clustered(df: DataFrame, name: str, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Land ``df`` as :func:`land` does, bucketed by ``by`` and sorted: what
    groups or windows by ``by`` (summaries, breakdowns, heads, charts) needs no
    exchange any more, however often the table is used."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        df.repartition(buckets, *by).write.option("path", scratch_path(spark, table))
        .bucketBy(buckets, *by).sortBy(*by, *order).saveAsTable(table, format="parquet")
    )
    return spark.table(table)


_CACHED: list[DataFrame] = []


def release_cached() -> None:
    """Unpersist every helper table cached by this library (header tables,
    ranked catalogs, entry lists). Call between independent jobs of a
    long-running session; anything still referenced is recomputed if used."""
    while _CACHED:
        _CACHED.pop().unpersist(blocking=False)


def row_bytes(df: DataFrame) -> Column:
    """Unpacked size of a row: the bytes of its texts, 16 for any other field."""
    parts = []
    for f in df.schema.fields:
        name = F.col(f"`{f.name}`")
        if f.dataType.typeName() in ("string", "binary"):
            parts.append(F.coalesce(F.octet_length(name), F.lit(0)) + 16)
        elif f.dataType.simpleString() == "array<string>":
            texts = F.octet_length(F.array_join(name, ""))
            parts.append(F.coalesce(texts + 16 * F.size(name), F.lit(0)) + 16)
        else:
            parts.append(F.lit(16))
    return reduce(lambda a, b: a + b, parts, F.lit(0)).cast("long")


def persist_counted(df: DataFrame) -> tuple[DataFrame, int, int]:
    """Persist ``df`` and take its number of rows and unpacked bytes once.

    A per-call token keeps the cache entry private: the cache matches by
    plan, and keys derived from input splits (line keys) must never be
    reused by a later call that reads the same files with other settings."""
    token = uuid.uuid4().hex
    df = df.withColumn("_cache_token", F.lit(token)).persist(StorageLevel.MEMORY_AND_DISK)
    _CACHED.append(df)
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes(df)), F.lit(0))).head()
    return df.drop("_cache_token"), n, size


def land_small(df: DataFrame, name: str) -> DataFrame:
    """Land ``df`` and hint a broadcast when it is counted small, within the
    bounds of :func:`broadcast_if_small`; nothing stays cached."""
    df = land(df, name)
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes(df)), F.lit(0))).head()
    return F.broadcast(df) if n <= DEFAULT_BROADCAST_ROWS and size <= DEFAULT_BROADCAST_BYTES else df


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Persist ``df``, measure it, and hint a broadcast only when it is small
    in rows and in unpacked bytes.

    Returns the (persisted) frame and whether the broadcast hint was applied.
    Above the bounds the frame is returned unhinted so the planner uses a
    shuffle join (with adaptive skew splitting).
    """
    df, n, size = persist_counted(df)
    if n <= max_rows and size <= DEFAULT_BROADCAST_BYTES:
        return F.broadcast(df), True
    return df, False
