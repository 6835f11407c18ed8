"""From landed archives to series for many requested days at once.

catalog (file names) → candidate archives per requested day (daily files
first, bundles after; current folder before archive folder) → entries
chosen by the per-archive rules → the first (source, kind) per day and
half that yields entries → lines → series. "First" in the keep-first
de-duplication is the candidate order, then the entry name, then the line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.catalog_ops import bundle_candidates, match_daily
from ..sources.archives import LandedArchives, ZipArchives, entry_id, select_entries
from ..session import land
from ..sources.catalog import source_rank
from .dispatch import dispatch_series
from .scada import scada_series

# cand_rank: 0 for daily files (then name order), the as-of rank for bundles
# (1 = latest bundle first, as candidates are tried best-first)
REQUEST_COLS = ["path", "product", "is_bundle", "target_date", "source", "format", "cls", "cand_rank"]


def scada_candidates(targets: DataFrame, catalog: DataFrame) -> DataFrame:
    """Daily files matching a search key (class 1) and the best bundles per
    format (class 2), in every source; the choice among them comes later."""
    daily = match_daily(targets, catalog, product=K.SCADA_PRODUCT).select(
        "path", "product", "is_bundle", "target_date", "source", "format", F.lit(1).alias("cls"),
        F.lit(0).alias("cand_rank"),
    ).distinct()
    bundles = bundle_candidates(targets, catalog, product=K.SCADA_PRODUCT)
    bundles = bundles.select(
        F.col("right_path").alias("path"), F.lit(K.SCADA_PRODUCT).alias("product"), F.lit(True).alias("is_bundle"),
        "target_date", F.col("right_source").alias("source"), "format", F.lit(2).alias("cls"),
        F.col("asof_rank").alias("cand_rank"),
    )
    return daily.unionByName(bundles)


def dispatch_candidates(targets: DataFrame, catalog: DataFrame) -> DataFrame:
    """Latest daily file of the date in the current folder (class 1), else the
    latest bundle dated on or before it in the archive folder (class 2)."""
    current, archive = K.SOURCE_ORDER
    daily = match_daily(targets, catalog.where(F.col("source") == current), product=K.DISPATCH_PRODUCT)
    daily = daily.groupBy("target_date", "source").agg(F.max(F.struct("name", "path")).alias("m")).select(
        F.col("m.path").alias("path"), F.lit(K.DISPATCH_PRODUCT).alias("product"), F.lit(False).alias("is_bundle"),
        "target_date", "source", F.lit(1).alias("format"), F.lit(1).alias("cls"), F.lit(0).alias("cand_rank"),
    )
    bundles = bundle_candidates(targets, catalog.where(F.col("source") == archive), product=K.DISPATCH_PRODUCT, k=1)
    bundles = bundles.select(
        F.col("right_path").alias("path"), F.lit(K.DISPATCH_PRODUCT).alias("product"), F.lit(True).alias("is_bundle"),
        "target_date", F.col("right_source").alias("source"), "format", F.lit(2).alias("cls"),
        F.col("asof_rank").alias("cand_rank"),
    )
    return daily.unionByName(bundles)


RANK_COLS = ["src_rank", "cls"]
Archives = ZipArchives | LandedArchives


def _candidates(candidates: DataFrame, archives: Archives) -> tuple[DataFrame, DataFrame]:
    # each table is used several times below: landed, so that plans stay short
    cand = land(candidates.withColumn("src_rank", source_rank("source")), "archive-candidates")
    entries = land(archives.entries(cand.select("path"), cand.count()), "archive-entries")
    selected, rejects = select_entries(entries, cand.select(*REQUEST_COLS, "src_rank"))
    return land(selected, "archive-selected"), rejects


def _first_choice(selected: DataFrame, by: list[str]) -> DataFrame:
    """Entries of the first (source, class) per ``by`` that has any."""
    best = selected.groupBy(*by).agg(F.min(F.struct(*RANK_COLS)).alias("_best"))
    chosen = selected.join(best, by).where(F.struct(*RANK_COLS) == F.col("_best")).drop("_best")
    chosen = chosen.withColumn("entry", entry_id(F.col("path"), F.col("outer")))
    return chosen.withColumn("entry_order", F.struct("src_rank", "cls", "format", "cand_rank", "entry"))


def choose_and_read(
    candidates: DataFrame, by: list[str], archives: Archives | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(chosen entries with an order key, their lines, rejects)``.

    The first (source, class) per ``by`` that yields any entry is read, and
    its text landed once. If something in it cannot be read, the archive is
    rejected for the days it was chosen for, and those days fall through to
    their next class or source (or, if there is none, to the other archives of
    the same), which is read in turn. Every archive that failed has a reject
    row for each of its days. The rounds are at most the ranks of a candidate."""
    archives = archives or ZipArchives()
    selected, rejects = _candidates(candidates, archives)
    landed, read = None, None
    while True:
        chosen = land(_first_choice(selected, by), "archive-choice")
        fresh = chosen.select("path", "outer", "inner", "entry", "size").distinct()
        if read is not None:
            fresh = fresh.join(read, "entry", "left_anti")
        n_fresh, size = fresh.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).head()
        if landed is not None and not n_fresh:
            break
        lines = land(archives.lines(fresh, size), "archive-lines")
        landed = lines if landed is None else landed.unionByName(lines)
        read = fresh.select("entry") if read is None else read.union(fresh.select("entry"))
        failed = lines.where(F.col("error").isNotNull()).groupBy("entry").agg(F.min("error").alias("reason"))
        bad = land(chosen.join(failed, "entry").select(*dict.fromkeys([*by, *RANK_COLS, "path", "target_date", "reason"])).distinct(), "archive-rejects")
        if bad.isEmpty():
            break
        rejects = rejects.unionByName(bad.select("path", "target_date", "reason"))
        selected = _without_failed(selected, bad, by)
    return chosen, landed.where(F.col("error").isNull()).drop("error"), rejects


def _without_failed(selected: DataFrame, bad: DataFrame, by: list[str]) -> DataFrame:
    """``selected`` without the archives that failed. Where a later (source,
    class) has entries for the same request, all of the failed rank goes, so
    that the request is served whole from the later one."""
    rank = F.struct(*RANK_COLS)
    failed = bad.groupBy(*by).agg(F.max(rank).alias("_failed"))
    last = F.max(rank).over(Window.partitionBy(*by))
    left = selected.withColumn("_last", last).join(failed, by, "left")
    whole = F.coalesce((F.col("_last") > F.col("_failed")) & (rank == F.col("_failed")), F.lit(False))
    left = left.where(~whole).drop("_last", "_failed")
    return left.join(bad.select(*by, "path").distinct(), [*by, "path"], "left_anti")


def _order_of_days(chosen: DataFrame) -> DataFrame:
    """The days each chosen entry serves, with the entry's order key for them. Its
    lines are parsed once, and meet these rows after that (an entry serving two
    days yields its readings twice, each copy restricted to its day)."""
    return chosen.groupBy("entry", "target_date").agg(F.min("entry_order").alias("entry_order"))


def scada_from_archives(
    targets: DataFrame, catalog: DataFrame, units: list[str] | None = None, archives: Archives | None = None
) -> DataFrame:
    """SCADA series of every requested (day) from landed archives; the
    market-day window keeps only the requested days."""
    chosen, lines, _ = choose_and_read(scada_candidates(targets, catalog), ["target_date", "format"], archives)
    return scada_series(lines, units=units, served=_order_of_days(chosen))


def dispatch_from_archives(
    targets: DataFrame, catalog: DataFrame, units: list[str] | None = None, archives: Archives | None = None
) -> DataFrame:
    """Dispatch series of every requested day from landed archives."""
    chosen, lines, _ = choose_and_read(dispatch_candidates(targets, catalog), ["target_date"], archives)
    return dispatch_series(lines, units=units, served=_order_of_days(chosen))
