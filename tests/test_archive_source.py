"""The data source over landed ZIP archives."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from test_archives import build, land, scada_csv, zip_bytes
from wattline.plans.scada import scada_series
from wattline.sources.archive_source import FORMAT, ArchiveReader, ArchiveSource, register_archive_source
from wattline.sources.archives import archive_entries
from wattline.sources.catalog import list_files


@pytest.fixture()
def root(spark, tmpdir_path):
    register_archive_source(spark)
    build(tmpdir_path)
    # an inner archive of one day that cannot be read
    land(tmpdir_path, "archive", "PUBLIC_NEXT_DAY_FPPMW_20251101.zip", zip_bytes({
        "PUBLIC_NEXT_DAY_FPPMW_20251103_0000000000000001.zip": b"broken",
        "PUBLIC_NEXT_DAY_FPPMW_20251104_0000000000000002.zip": zip_bytes({
            "A.CSV": scada_csv([("2025/11/03 05:00:00", "UNIT_A", 1.5, 0)]), "B.csv": scada_csv([("2025/11/03 06:00:00", "UNIT_A", 2.5, 0)]),
        }),
        "readme.txt": b"-",
    }))
    return tmpdir_path


def test_lines_and_rejects_are_rows(spark, root):
    df = spark.read.format(FORMAT).load(root)
    errors = {(r["entry_date"], r["error"].split(":")[0]) for r in df.where("error IS NOT NULL").collect()}
    assert errors == {(dt.date(2025, 10, 2), "bad zip"), (dt.date(2025, 11, 3), "bad zip")}
    lines = df.where("error IS NULL")
    files = {r["file"].split("!/", 1)[1] for r in lines.select("file").distinct().collect()}
    assert "PUBLIC_NEXT_DAY_FPPMW_20251104_0000000000000002.zip!/B.csv" in files and len(files) == 9
    # straight into the parse
    series = scada_series(lines.where("path LIKE '%FPPMW%'").select("file", "line_key", "value"))
    assert series.where("duid = 'UNIT_A' AND market_day = DATE '2025-11-03'").agg(F.sum("measured_mw")).head()[0] == 4.0


def test_entries_of_other_days_are_not_opened(spark, root):
    """A test on the entry's date reaches the listing: the broken entry of the
    day before is not met, and the plan holds one entry only."""
    df = spark.read.format(FORMAT).load(root).where("entry_date = DATE '2025-11-04'")
    assert {r["error"] for r in df.collect()} == {None} and df.count() == 4
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringContains

    def planned(*filters, **options):
        reader = ArchiveReader({"path": root, **options})
        left = list(reader.pushFilters(list(filters)))
        return left, [row[1] for part in reader.partitions() for row in part.rows]

    day = ("entry_date",)
    assert len(planned()[1]) == 10 and len(ArchiveSource({"path": root}).reader(None).partitions()) == 1
    left, rows = planned(EqualTo(day, dt.date(2025, 11, 4)), StringContains(("value",), "x"))
    assert len(left) == 1 and rows == ["PUBLIC_NEXT_DAY_FPPMW_20251104_0000000000000002.zip"]
    assert len(planned(In(day, (dt.date(2025, 11, 3), dt.date(2025, 9, 30))))[1]) == 2
    assert len(planned(GreaterThan(day, dt.date(2025, 11, 3)), LessThanOrEqual(day, dt.date(2026, 3, 5)))[1]) == 2
    assert planned(EqualTo(day, dt.date(1999, 1, 1)))[1] == []


def test_tasks_by_size_and_listing_made_as_a_job(spark, root):
    paths = list_files(spark, root, "*.zip").select("path")
    archive_entries(paths).write.parquet(f"{root}/listing")
    read = spark.read.format(FORMAT).option("entries", f"{root}/listing").option("bytesPerTask", 1).load(root)
    assert read.rdd.getNumPartitions() >= 9
    key = lambda df: sorted((r["value"], r["line_key"]["pos"]) for r in df.where("error IS NULL").collect())
    assert key(read) == key(spark.read.format(FORMAT).load(root))
    assert spark.read.format(FORMAT).load(f"{root}/archive").where("entry_date < DATE '1990-01-01'").count() == 0
