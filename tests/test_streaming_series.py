"""The series as a stream: out-of-order files, watermark, state (§7.5)."""

import pytest

from feed_files import write_text
from wattline.plans.scada import scada_series
from wattline.sources.lines import read_lines
from wattline.streaming.series import READINGS, parse_batch, start_readings, start_series

HEAD = "I,FPP,FPPMW,1,INTERVAL_DATETIME,MEASUREMENT_DATETIME,DUID,MEASURED_MW,MW_QUALITY_FLAG\n"


def _file(day, readings):
    return HEAD + "".join(f'D,FPP,FPPMW,1,"{day} {t}","{day} {t}",{u},{mw},0\n' for t, u, mw in readings)


def _run(spark, root):
    start_readings(spark, f"{root}/land", f"{root}/readings", once=True).awaitTermination(120)
    query = start_series(spark, f"{root}/readings", f"{root}/series", once=True)
    query.awaitTermination(120)
    return query


@pytest.fixture()
def root(tmpdir_path):
    return tmpdir_path


def test_out_of_order_files_give_the_batch_table(spark, root):
    # the file that counts first comes last
    write_text(root, "land/FEED_2.CSV", _file("2025/06/01", [("05:00:04", "U1", 99), ("05:00:08", "U1", 3)]))
    _run(spark, root)
    write_text(root, "land/FEED_1.CSV", _file("2025/06/01", [("05:00:00", "U1", 1), ("05:00:04", "U1", 2), ("05:00:04", "U2", 7)]))
    _run(spark, root)
    write_text(root, "land/FEED_3.CSV", _file("2025/06/02", [("05:00:00", "U1", 4)]))
    _run(spark, root)
    # far later days move the watermark past the first ones
    write_text(root, "land/FEED_4.CSV", _file("2025/06/20", [("05:00:00", "U1", 5)]))
    query = _run(spark, root)
    batch = scada_series(read_lines(spark, f"{root}/land")).where("market_day < DATE '2025-06-10'")
    key = lambda df: sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())
    written = spark.read.parquet(f"{root}/series")
    assert key(written) == key(batch) and written.count() == 5
    # state of what the watermark has passed is gone: one reading is left
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert states[-1] == 1
    # a copy of an old file that comes too late adds nothing
    write_text(root, "land/FEED_9.CSV", _file("2025/06/01", [("05:00:00", "U1", 100)]))
    _run(spark, root)
    assert key(spark.read.parquet(f"{root}/series")) == key(batch)


def test_a_batch_that_is_run_again_replaces_its_readings(spark, root):
    rows = [("f", 0, line) for line in _file("2025/06/01", [("05:00:00", "U1", 1)]).splitlines()]
    batch = spark.createDataFrame(rows, "file string, block long, value string").coalesce(1)
    for _ in range(2):
        parse_batch(batch, 3, f"{root}/r", "scada")
    assert spark.read.schema(READINGS["scada"]).option("recursiveFileLookup", True).parquet(f"{root}/r").count() == 1
