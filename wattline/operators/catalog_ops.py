"""Which archives cover which settlement dates.

All functions take a catalog (see ``sources.catalog.parse_catalog``) and a
table of target settlement dates, so one job resolves every requested day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.dates import dispatch_search_keys, scada_search_keys, yyyymmdd
from ..sources.catalog import source_rank
from .asof import asof_topk


def search_keys(targets: DataFrame, date_col: str = "target_date", product: str = K.SCADA_PRODUCT) -> DataFrame:
    """One row per (target, search key ``yyyyMMdd``), era-aware for SCADA."""
    keys = scada_search_keys(date_col) if product == K.SCADA_PRODUCT else dispatch_search_keys(date_col)
    return targets.select("*", F.explode(keys).alias("search_key"))


def match_daily(targets: DataFrame, catalog: DataFrame, date_col: str = "target_date",
                product: str = K.SCADA_PRODUCT) -> DataFrame:
    """Daily (non-bundle) files whose embedded date equals a search key.

    An equi join on the extracted date: a sequence number that happens to
    contain the digits never matches.
    """
    daily = catalog.where((F.col("product") == product) & ~F.col("is_bundle") & F.col("file_date").isNotNull())
    daily = daily.withColumn("search_key", yyyymmdd("file_date"))
    keys = search_keys(targets, date_col, product)
    return keys.join(daily, "search_key", "inner")


def fallthrough(candidates: DataFrame, by: list[str], source_col: str = "source") -> DataFrame:
    """Keep, per ``by`` group, only the candidates of the first source (in the
    fixed search order) that has any. A partial aggregate finds the winning
    source, a semi join keeps its rows."""
    ranked = candidates.withColumn("_src_rank", source_rank(source_col))
    best = ranked.groupBy(*by).agg(F.min("_src_rank").alias("_src_rank"))
    return ranked.join(best, [*by, "_src_rank"], "left_semi").drop("_src_rank")


def latest_daily(catalog: DataFrame, product: str = K.DISPATCH_PRODUCT) -> DataFrame:
    """Per (source, file date) the latest publication: the largest name."""
    daily = catalog.where((F.col("product") == product) & ~F.col("is_bundle") & F.col("file_date").isNotNull())
    return daily.groupBy("source", "file_date").agg(F.max("name").alias("name"))


def bundle_candidates(
    targets: DataFrame,
    catalog: DataFrame,
    *,
    date_col: str = "target_date",
    product: str = K.SCADA_PRODUCT,
    k: int = K.BUNDLE_CANDIDATES,
) -> DataFrame:
    """Best ``k`` bundles per (target, format): largest (date, name) with
    date ≤ the latest search date. SCADA searches up to D+1, dispatch up to D."""
    bundles = catalog.where((F.col("product") == product) & F.col("is_bundle") & F.col("file_date").isNotNull())
    bundles = bundles.select("format", "file_date", "name", "source", "path")
    if product == K.SCADA_PRODUCT:
        limit = F.date_add(F.col(date_col), 1)
    else:
        limit = F.col(date_col)
    # targets × formats: the format domain is the fixed pair (1, 2), so each
    # target is expanded by an explode of the known list, not by a join
    left = targets.withColumn("_search_until", limit).withColumn("format", F.explode(F.array(F.lit(1), F.lit(2))))
    out = asof_topk(
        left, bundles, by=["format"], left_on="_search_until", right_on="file_date",
        tiebreak=["name"], k=k,
    )
    return out.drop("_search_until")
