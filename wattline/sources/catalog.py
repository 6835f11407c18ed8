"""Archive catalog: landed file names as a table with columns derived by regex.

The listing uses the ``binaryFile`` source with only ``path`` selected, so
file contents are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.dates import basename, name_date


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """All files below ``root`` as a one-column ``path`` table (no content read)."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path")
    )


def parse_catalog(paths: DataFrame, path_col: str = "path", source: Column | None = None) -> DataFrame:
    """``path`` → ``path, name, source, product, format, file_date, is_bundle``.

    ``source`` defaults to the parent folder name (``current`` / ``archive``).
    Only ``.zip`` names are kept; dispatch names must contain ``DISPATCH``.
    ``product`` is ``FPPMW`` (case-sensitive, as published) or ``DISPATCH``.
    """
    named = paths.select(
        F.col(path_col).alias("path"),
        basename(path_col).alias("name"),
        (source if source is not None else
         F.element_at(F.split(F.regexp_replace(path_col, "/[^/]*$", ""), "/"), -1)).alias("source"),
    )
    name = F.col("name")
    product = (
        F.when(name.contains(K.SCADA_PRODUCT), F.lit(K.SCADA_PRODUCT))
        .when(F.upper(name).contains(K.DISPATCH_PRODUCT), F.lit(K.DISPATCH_PRODUCT))
    )
    named = named.withColumn("product", product)
    is_bundle = (
        F.when(F.col("product") == K.SCADA_PRODUCT, name.rlike(K.SCADA_BUNDLE_PATTERN))
        .when(F.col("product") == K.DISPATCH_PRODUCT, name.rlike(K.DISPATCH_BUNDLE_PATTERN))
    )
    fmt = F.when(name.rlike(K.SECOND_HALF_PATTERN), F.lit(2)).otherwise(F.lit(1))
    out = named.select(
        "path", "name", "source", "product",
        fmt.alias("format"),
        name_date(name).alias("file_date"),
        is_bundle.alias("is_bundle"),
    )
    return out.where(F.lower("name").endswith(".zip") & F.col("product").isNotNull())


def source_rank(source: Column | str) -> Column:
    """Position of a source in the search order (current before archive)."""
    s = F.col(source) if isinstance(source, str) else source
    expr = None
    for i, name in enumerate(K.SOURCE_ORDER, start=1):
        expr = F.when(s == name, F.lit(i)) if expr is None else expr.when(s == name, F.lit(i))
    return expr.otherwise(F.lit(len(K.SOURCE_ORDER) + 1))
