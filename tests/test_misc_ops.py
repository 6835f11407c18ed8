"""Smaller operators: nested breakdown, dispatch cards, presence, lineage cut."""

import datetime as dt

from pyspark.sql import functions as F

from wattline import api
from wattline.operators.series import stat_cards
from wattline.operators.summary import flag_breakdown, flag_breakdown_map
from wattline.session import checkpoint_dir, cut_lineage


def _series(spark):
    rows = [("U1", dt.date(2025, 6, 1), 0, 1.0), ("U1", dt.date(2025, 6, 1), 0, 2.0),
            ("U1", dt.date(2025, 6, 1), None, 3.0), ("U1", dt.date(2025, 6, 1), 2, None)]
    return spark.createDataFrame(rows, "duid string, market_day date, mw_quality_flag int, measured_mw double")


def test_flag_breakdown_nested(spark):
    m = flag_breakdown_map(flag_breakdown(_series(spark))).collect()[0]["flag_breakdown"]
    assert m["0"]["count"] == 2 and m["0"]["pct"] == 50.0
    assert m["None"]["count"] == 1 and m["2"]["pct"] == 25.0


def test_dispatch_cards(spark):
    summ = spark.createDataFrame(
        [("U1", dt.date(2026, 3, 11), 1234, 10.04, 12.96, 50.25, 99.5, None)],
        "duid string, market_day date, total_rows long, min_mw double, max_mw double,"
        " min_init_mwh double, max_init_mwh double, mean_init_mwh double",
    )
    cards = {r["label"]: r["value"] for r in stat_cards(summ, kind="dispatch").collect()}
    assert cards["Total Intervals"] == "1,234"
    assert cards["Min Dispatch MW"] == "10.0" and cards["Max Dispatch MW"] == "13.0"
    assert cards["Mean Energy (MWh)"] == "—"


def test_units_of_state(spark):
    units = spark.createDataFrame([("NSW", "B"), ("NSW", "A"), ("SA", "C")], "state string, duid string")
    assert [r["duid"] for r in api.units_of_state(units, "NSW").collect()] == ["A", "B"]


def test_checkpoint_dir_from_session(spark):
    import os

    d = checkpoint_dir(spark)
    assert d == spark.sparkContext.getCheckpointDir()  # read from the session, not invented
    df = cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.count() == 10
    local = d[5:] if d.startswith("file:") else d
    assert any(os.scandir(local))  # the lineage cut wrote into that folder


def test_landed_tables_can_be_removed(spark):
    import os

    from wattline.session import land, remove_landed

    df = land(spark.range(5), "probe", partition_by=None)
    folder = df._landed_at.removeprefix("file:")
    assert df.count() == 5 and os.path.isdir(folder)
    remove_landed(df)
    assert not os.path.exists(folder)


def test_release_cached_frees_helpers(spark):
    from wattline import session

    df, n, size = session.persist_counted(spark.range(5))
    assert n == 5 and session._CACHED
    session.release_cached()
    assert not session._CACHED
    assert df.count() == 5  # still usable: recomputed from lineage
