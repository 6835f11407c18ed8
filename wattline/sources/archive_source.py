"""Archives as a Spark data source: ``spark.read.format("feed_archives")``.

One row per line of every CSV reachable in the ZIP archives of a folder, directly
or in an inner archive, and one row with ``error`` for whatever cannot be read.
The entries are known from the archives' central directories when the scan is
planned: tests on ``entry_date`` are pushed down to that list, so entries of
other days are never opened, and the rest are dealt to tasks by their size.

The listing is made on the driver with a few threads; where there are very many
archives, make it as a job (:func:`wattline.sources.archives.archive_entries`),
write it as Parquet and name it in the option ``entries``: the driver then
reads the columns of that table only.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
)

from ..session import ship_package
from .archives import BYTES_PER_TASK, ENTRY_DATE_PATTERN, _entries_of, _read_entry, filesystem_of

FORMAT = "feed_archives"
SCHEMA = (
    "path string, entry string, entry_date date, file string, line_key struct<part:bigint,pos:bigint>,"
    " value string, error string"
)


def register_archive_source(spark: SparkSession) -> None:
    """Make the format known to ``spark``, with filters pushed down to it."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)


class ArchiveSource(DataSource):
    """Options: ``path`` (a folder, searched for ``*.zip``), ``entries`` (a
    Parquet listing instead), ``bytesPerTask``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


class Entries(InputPartition):
    """Entries (path, outer, inner, date, error) that one task reads."""

    def __init__(self, rows: list[tuple]):
        super().__init__(rows)
        self.rows = rows


#: Tests of an entry's date against a pushed value.
_TESTS = {
    EqualTo: lambda d, v: d == v,
    In: lambda d, v: d in v,
    GreaterThan: lambda d, v: d > v,
    GreaterThanOrEqual: lambda d, v: d >= v,
    LessThan: lambda d, v: d < v,
    LessThanOrEqual: lambda d, v: d <= v,
    IsNotNull: lambda d, v: True,
}


def date_in_name(*names: str | None) -> date | None:
    """The first valid date in the first of ``names`` that bears one."""
    for name in names:
        for digits in re.findall(ENTRY_DATE_PATTERN, (name or "").rsplit("/", 1)[-1]):
            try:
                return datetime.strptime(digits, "%Y%m%d").date()
            except ValueError:
                continue
    return None


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}  # Spark's options have no case
        self.tests: list[tuple[type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes tests of ``entry_date``; gives back all others."""
        for f in filters:
            if type(f) in _TESTS and f.attribute == ("entry_date",):
                self.tests.append((type(f), getattr(f, "value", None)))
            else:
                yield f

    def _wanted(self, day: date | None) -> bool:
        return not self.tests or (day is not None and all(_TESTS[t](day, v) for t, v in self.tests))

    def _listing(self) -> list[tuple]:
        if "entries" in self.options:
            import pyarrow.dataset as ds

            filesystem, path = _located(self.options["entries"])
            table = ds.dataset(path, filesystem=filesystem, format="parquet").to_table(["path", "outer", "inner", "size", "error"])
            return list(zip(*(table.column(c).to_pylist() for c in table.column_names)))
        from pyarrow import fs

        filesystem, path = _located(self.options["path"])
        files = filesystem.get_file_info(fs.FileSelector(path, recursive=True))
        scheme = self.options["path"][: -len(path)] if self.options["path"].endswith(path) else ""
        zips = sorted(scheme + f.path for f in files if f.is_file and f.path.lower().endswith(".zip"))
        with ThreadPoolExecutor(16) as pool:
            return [row for rows in pool.map(_entries_of, zips) for row in rows]

    def partitions(self) -> list[Entries]:
        limit = int(self.options.get("bytespertask", BYTES_PER_TASK))
        dealt: list[list[tuple]] = []
        held = limit
        for path, outer, inner, size, error in self._listing():
            day = date_in_name(outer, path)
            if not self._wanted(day):
                continue
            if held + (size or 0) > limit:
                dealt.append([])
                held = 0
            dealt[-1].append((path, outer, inner, day, error))
            held += size or 0
        return [Entries(rows) for rows in dealt] or [Entries([])]

    def read(self, partition: Entries) -> Iterator:
        import numpy as np
        import pyarrow as pa

        key = pa.struct([("part", pa.int64()), ("pos", pa.int64())])
        schema = pa.schema([
            ("path", pa.string()), ("entry", pa.string()), ("entry_date", pa.date32()), ("file", pa.string()),
            ("line_key", key), ("value", pa.string()), ("error", pa.string()),
        ])
        for path, outer, inner, day, error in partition.rows:
            if error is not None:
                row = {"path": path, "entry_date": day, "error": error}
                yield pa.RecordBatch.from_pylist([{n: row.get(n) for n in schema.names}], schema=schema)
                continue
            for lines in _read_entry(path, outer, inner):
                n, pos = lines.num_rows, lines.column("pos")
                keys = pa.StructArray.from_arrays(
                    [pa.array(np.zeros(n, np.int64)), pos.fill_null(0)], fields=list(key), mask=pos.is_null()
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * n), lines.column("entry"), pa.array([day] * n, pa.date32()),
                        lines.column("file"), keys, lines.column("value"), lines.column("error"),
                    ],
                    schema=schema,
                )


def _located(uri: str):
    """pyarrow filesystem and path of a folder, also of a local one without a scheme."""
    if uri.startswith("/"):
        from pyarrow import fs

        return fs.LocalFileSystem(), uri.rstrip("/")
    filesystem, path = filesystem_of(uri)
    return filesystem, path.rstrip("/")
