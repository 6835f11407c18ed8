"""ZIP archives (outer ZIP → CSV, or outer ZIP → inner ZIP → CSV) as lines.

Three steps, each a Spark job over tables:

1. ``archive_entries(paths)``: one row per CSV reachable in each archive.
   Tasks receive only paths and open the files themselves; the outer
   archive is read through its central directory (seekable handle), inner
   archives are opened per entry. An unreadable archive yields a reject row.
2. ``select_entries(entries, requests)``: which entries serve which
   requested settlement date (dated names first, fallbacks after), written
   as aggregates and filters over the (small) entry table.
3. ``read_entries(selected)``: one task per chosen entry streams its text
   in Arrow batches (``mapInArrow``) → ``(file, line_key, value)``.
"""

from __future__ import annotations

import io
import shutil
import tempfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.dates import dispatch_search_keys, scada_search_keys
from ..session import ship_package
from .lines import line_key

# a date in an entry's name: eight digits by themselves or before six of a time
ENTRY_DATE_PATTERN = r"(?<!\d)(\d{8})(?:\d{6})?(?!\d)"

ENTRY_SCHEMA = "path string, outer string, inner string, size long, error string"


def filesystem_of(uri: str):
    """pyarrow filesystem and path for a Spark path; Hadoop's ``s3a://`` and
    ``s3n://`` are the same object store as pyarrow's ``s3://``."""
    from pyarrow import fs as pafs

    for hadoop in ("s3a://", "s3n://"):
        if uri.startswith(hadoop):
            uri = "s3://" + uri[len(hadoop):]
    return pafs.FileSystem.from_uri(uri)


def _open(path: str):
    """Seekable binary handle for a local or remote path (remote via pyarrow)."""
    if path.startswith(("file:", "/")):
        local = path.removeprefix("file:")
        while local.startswith("//"):
            local = local[1:]
        return open(local, "rb")
    filesystem, inner_path = filesystem_of(path)
    return filesystem.open_input_file(inner_path)


ALL_CSVS = "*"  # ``inner`` of an inner archive: every CSV in it, opened at read time


def _entries_of(path: str) -> list[tuple]:
    """Outer entries of one archive from its central directory only: direct
    CSVs, and inner archives by name (``inner = ALL_CSVS``). Inner archives
    are not opened here — only the chosen ones are, when they are read."""
    rows: list[tuple] = []
    try:
        with _open(path) as fh, zipfile.ZipFile(fh) as outer:
            for info in sorted(outer.infolist(), key=lambda i: i.filename):
                name = info.filename
                low = name.lower()
                if low.endswith(".csv"):
                    rows.append((path, name, None, info.file_size, None))
                elif low.endswith(".zip"):
                    rows.append((path, name, ALL_CSVS, info.file_size, None))
            if not rows:
                rows.append((path, None, None, None, "archive holds no CSV or inner archive"))
    except zipfile.BadZipFile:
        rows.append((path, None, None, None, "bad zip"))
    except OSError as exc:
        rows.append((path, None, None, None, f"unreadable: {exc}"))
    return rows


def _list_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = [r for p in pdf["path"] for r in _entries_of(p)]
        yield pd.DataFrame(out, columns=["path", "outer", "inner", "size", "error"])


LISTED_PER_TASK = 64
BYTES_PER_TASK = 128 << 20


def _tasks(spark, needed: int) -> int:
    """Task count for per-file Python work: what the work needs, at least the
    cluster's parallelism. An explicit count keeps adaptive execution from
    folding a small-row (but heavy) table into one task."""
    return max(spark.sparkContext.defaultParallelism, needed)


def archive_entries(paths: DataFrame, path_col: str = "path", n_paths: int | None = None) -> DataFrame:
    """``path`` table → one row per reachable CSV (``outer``, ``inner``) or a
    reject row (``error`` set). Archives are spread over tasks by path."""
    p = paths.select(F.col(path_col).alias("path")).distinct()
    ship_package(paths.sparkSession)
    p = p.repartition(_tasks(paths.sparkSession, -(-(n_paths or 0) // LISTED_PER_TASK)), F.col("path"))
    return p.mapInPandas(_list_batches, ENTRY_SCHEMA)


def select_entries(entries: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Choose the entries that serve each request.

    ``requests``: ``path, product, is_bundle, target_date`` (from the catalog
    match). Search keys are era-aware for SCADA, the date itself for
    dispatch. Rules per archive:

    * SCADA daily: dated CSVs; else the only CSV; more than one undated CSV
      is an error; without direct CSVs every CSV of every inner archive.
    * SCADA bundle: CSVs of inner archives whose name holds a search key;
      none is an empty (not failed) answer.
    * Dispatch daily: dated CSVs, else all CSVs, else inner archives' CSVs.
    * Dispatch bundle: dated CSVs, else dated inner archives' CSVs, else the
      only CSV, else an error listing up to ten dates found.

    An entry is dated by the dates extracted from its name (eight digits
    between non-digits, or the head of a 14-digit time), never by digits that
    happen to occur in a sequence number.

    Returns ``(selected, rejects)``; rejects carry ``path, target_date, reason``.
    """
    scada, bundle = F.col("product") == K.SCADA_PRODUCT, F.col("is_bundle")
    keys = F.when(scada, scada_search_keys("target_date")).otherwise(dispatch_search_keys("target_date"))
    ok = entries.where(F.col("error").isNull()).select("path", "outer", "inner", "size")
    ok = ok.withColumn("_direct", F.col("inner").isNull())
    ok = ok.withColumn("_dates", F.regexp_extract_all("outer", F.lit(ENTRY_DATE_PATTERN), 1))

    # entries that bear a date asked for, by an equi join on that date
    asked = requests.select("path", "target_date", F.explode(keys).alias("_date"))
    dated = ok.withColumn("_date", F.explode(F.array_distinct("_dates"))).join(asked, ["path", "_date"])
    dated = dated.select("path", "target_date", "outer", "inner", "size", "_direct").distinct()
    found = dated.groupBy("path", "target_date").agg(
        F.count_if("_direct").alias("_ndd"), F.count_if(~F.col("_direct")).alias("_nid")
    )
    held = ok.groupBy("path").agg(F.count_if("_direct").alias("_nd"))
    judged = requests.join(held, "path").join(found, ["path", "target_date"], "left").na.fill(0, ["_ndd", "_nid"])
    nd, ndd, nid = F.col("_nd"), F.col("_ndd"), F.col("_nid")
    takes = (
        F.when(scada & ~bundle, F.when(ndd > 0, "dated direct").when(nd == 1, "direct").when(nd > 1, "none").otherwise("inner"))
        .when(scada, F.lit("dated inner"))
        .when(~bundle, F.when(ndd > 0, "dated direct").when(nd > 0, "direct").otherwise("inner"))
        .otherwise(F.when(ndd > 0, "dated direct").when(nid > 0, "dated inner").when(nd == 1, "direct").otherwise("none"))
    )
    judged = judged.withColumn("_takes", takes).drop("_nd", "_ndd", "_nid")
    kind = F.when(F.col("_direct"), "direct").otherwise("inner")
    by_date = judged.join(dated, ["path", "target_date"]).where(F.col("_takes") == F.concat(F.lit("dated "), kind))
    # without dates: a daily archive's entries (asked for by two days at most), or a bundle's only one
    undated = judged.where(F.col("_takes").isin("direct", "inner")).join(ok.drop("_dates"), "path").where(F.col("_takes") == kind)
    selected = by_date.unionByName(undated).drop("_direct", "_takes")

    # what the archive has instead: for SCADA its five newest dates, for dispatch its ten oldest
    per = Window.partitionBy("path")
    seen = ok.select("path", F.get("_dates", F.lit(0)).alias("_date")).distinct()
    seen = seen.withColumn("_new", F.row_number().over(per.orderBy(F.desc_nulls_last("_date"))))
    seen = seen.withColumn("_old", F.row_number().over(per.orderBy(F.asc_nulls_last("_date"))))

    def listed(kept: Column) -> Column:
        return F.array_join(F.array_sort(F.array_compact(F.collect_list(F.when(kept, F.col("_date"))))), ", ")

    shown = seen.where((F.col("_new") <= K.NEWEST_DATES_SHOWN) | (F.col("_old") <= K.OLDEST_DATES_SHOWN)).groupBy("path").agg(
        listed(F.col("_new") <= K.NEWEST_DATES_SHOWN).alias("_newest"), listed(F.col("_old") <= K.OLDEST_DATES_SHOWN).alias("_oldest")
    )
    rej_rules = judged.where(F.col("_takes") == "none").join(shown, "path").select(
        "path", "target_date",
        F.concat(F.lit("no entry for the date; dates seen: "), F.when(scada, F.col("_newest")).otherwise(F.col("_oldest"))).alias("reason"),
    )
    rej_bad = entries.where(F.col("error").isNotNull()).join(requests.select("path", "target_date"), "path").select(
        "path", "target_date", F.col("error").alias("reason")
    )
    return selected, rej_rules.unionByName(rej_bad)


TEXT_BLOCK = 8 << 20  # characters decoded per read (about 100k feed lines)
_LINE_SCHEMA = None


def _line_schema():
    global _LINE_SCHEMA
    if _LINE_SCHEMA is None:
        import pyarrow as pa

        _LINE_SCHEMA = pa.schema([
            ("file", pa.string()), ("entry", pa.string()), ("pos", pa.int64()), ("value", pa.string()), ("error", pa.string()),
        ])
    return _LINE_SCHEMA


def _line_batch(file_id: str, entry_id: str, start: int, lines: list[str]):
    import pyarrow as pa

    n = len(lines)
    return pa.RecordBatch.from_arrays(
        [pa.array([file_id] * n, pa.string()), pa.array([entry_id] * n, pa.string()),
         pa.array(range(start, start + n), pa.int64()), pa.array(lines, pa.string()), pa.nulls(n, pa.string())],
        schema=_line_schema(),
    )


def _error_batch(entry_id: str, error: str):
    import pyarrow as pa

    row = {"file": [entry_id], "entry": [entry_id], "pos": [None], "value": [None], "error": [error]}
    return pa.RecordBatch.from_pydict(row, schema=_line_schema())


def _stream_text(raw, file_id: str, entry_id: str):
    """Decode in blocks (universal newlines, invalid UTF-8 replaced) and split
    on line ends; a partial last line is carried to the next block, so
    memory stays at one block whatever the entry size."""
    text = io.TextIOWrapper(raw, encoding="utf-8", errors="replace", newline=None)
    carry, start = "", 0
    while True:
        block = text.read(TEXT_BLOCK)
        if not block:
            break
        lines = (carry + block).split("\n")
        carry = lines.pop()
        if lines:
            yield _line_batch(file_id, entry_id, start, lines)
            start += len(lines)
    if carry:
        yield _line_batch(file_id, entry_id, start, [carry])
    text.close()


def _read_batches(batches):
    """Task side: stream each chosen entry as Arrow batches of lines. An
    inner archive is opened here and each of its CSVs (in name order) is a
    file of its own. What cannot be read, and an inner archive without a CSV,
    gives one row with ``error``."""
    for rb in batches:
        d = rb.to_pydict()
        for path, outer_name, inner_name in zip(d["path"], d["outer"], d["inner"]):
            yield from _read_entry(path, outer_name, inner_name)


def _read_entry(path: str, outer_name: str, inner_name: str | None):
    name = f"{path}!/{outer_name}"
    try:
        yield from _entry_lines(path, outer_name, inner_name, name)
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError) as exc:
        yield _error_batch(name, f"bad zip: {exc}")
    except OSError as exc:
        yield _error_batch(name, f"unreadable: {exc}")


def _entry_lines(path: str, outer_name: str, inner_name: str | None, name: str):
    with _open(path) as fh, zipfile.ZipFile(fh) as outer:
        if inner_name is None:
            with outer.open(outer_name) as raw:
                yield from _stream_text(raw, name, name)
            return
        with outer.open(outer_name) as packed, tempfile.TemporaryFile() as copy:
            shutil.copyfileobj(packed, copy)  # the inner archive needs a seekable file, not memory
            with zipfile.ZipFile(copy) as inner:
                members = {
                    info.filename for info in inner.infolist()
                    if info.filename.lower().endswith(".csv") and inner_name in (ALL_CSVS, info.filename)
                }
                if not members:
                    yield _error_batch(name, "inner archive holds no CSV")
                for member in sorted(members):
                    with inner.open(member) as raw:
                        yield from _stream_text(raw, f"{name}!/{member}", name)


def entry_id(path, outer):
    """Id of an outer entry, ``path!/outer`` (a Column); lines carry it."""
    return F.concat(path, F.lit("!/"), outer)


def read_entries(selected: DataFrame, size: int | None = None) -> DataFrame:
    """Chosen entries → ``(file, line_key, value, entry, error)``; entries are
    spread over tasks by identity (about BYTES_PER_TASK each when their total
    ``size`` is known), text is streamed as Arrow batches of one decoded block each (never a whole
    file in memory). ``error`` is NULL but for one row of each entry that could
    not be read to its end."""
    ship_package(selected.sparkSession)
    ent = selected.select("path", "outer", "inner").distinct()
    ent = ent.repartition(_tasks(selected.sparkSession, -(-(size or 0) // BYTES_PER_TASK)), F.col("path"), F.col("outer"), F.col("inner"))
    raw = ent.mapInArrow(_read_batches, "file string, entry string, pos long, value string, error string")
    return raw.select("file", line_key(0, F.col("pos")).alias("line_key"), "value", "entry", "error")


class ZipArchives:
    """Archives as they were published: ZIP files, opened by the tasks."""

    def entries(self, paths: DataFrame, n_paths: int) -> DataFrame:
        return archive_entries(paths, n_paths=n_paths)

    def lines(self, chosen: DataFrame, size: int) -> DataFrame:
        return read_entries(chosen, size)


@dataclass
class LandedArchives:
    """Archives whose listing and text were landed as tables before.

    ``listing``: the rows of :func:`archive_entries`; ``text``: those of
    :func:`read_entries`, a row with ``error`` for what could not be read."""

    listing: DataFrame
    text: DataFrame

    def entries(self, paths: DataFrame, n_paths: int) -> DataFrame:
        return self.listing.join(paths.distinct(), "path", "left_semi")

    def lines(self, chosen: DataFrame, size: int) -> DataFrame:
        text = self.text.join(chosen.select("entry").distinct(), "entry", "left_semi")
        return text.select("file", "line_key", "value", "entry", "error")
