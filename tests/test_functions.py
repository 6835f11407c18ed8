"""Column functions: casts (X2–X5), dates (F9, F10, X10, X13–X15), text."""

import datetime as dt
import math

from pyspark.sql import functions as F

from wattline.functions import casts, dates, text


def _one(spark, expr_fn, values, schema):
    df = spark.createDataFrame([(v,) for v in values], f"x {schema}")
    return [r[0] for r in df.select(expr_fn(F.col("x"))).collect()]


def test_feed_casts(spark):
    ts = _one(spark, casts.feed_timestamp, ["2025/06/01 04:00:00", "2025-06-01 04:00:00", "2025/06/01", "bad", None], "string")
    assert ts == [dt.datetime(2025, 6, 1, 4), None, None, None, None]
    d = _one(spark, casts.to_double, ["-12.5", "NaN", "", "bad", "1e3"], "string")
    assert d[0] == -12.5 and math.isnan(d[1]) and d[2] is None and d[3] is None and d[4] == 1000.0
    assert _one(spark, casts.to_int, ["0", "2.0", "1.7", "x", "-1"], "string") == [0, 2, 1, None, -1]
    assert _one(spark, casts.unquote, ['"a,b"', '"', 'x', '""'], "string") == ["a,b", '"', "x", ""]
    n = _one(spark, casts.nan_to_null, [1.0, float("nan")], "double")
    assert n == [1.0, None]
    t = _one(spark, casts.format_time, [dt.datetime(2025, 6, 1, 4, 0, 7, 123456)], "timestamp_ntz")
    assert t == ["2025-06-01 04:00:07"]
    assert _one(spark, casts.render_feed_time, [dt.datetime(2025, 6, 1, 4)], "timestamp_ntz") == ["2025/06/01 04:00:00"]


def test_market_days(spark):
    vals = [dt.datetime(2025, 6, 1, 3, 59, 59), dt.datetime(2025, 6, 1, 4), dt.datetime(2025, 6, 2, 4)]
    assert _one(spark, dates.market_day_instant, vals, "timestamp_ntz") == [
        dt.date(2025, 5, 31), dt.date(2025, 6, 1), dt.date(2025, 6, 2)]
    assert _one(spark, dates.market_day_interval_end, vals, "timestamp_ntz") == [
        dt.date(2025, 5, 31), dt.date(2025, 5, 31), dt.date(2025, 6, 1)]


def test_name_dates(spark):
    names = ["X_20250601_0000000000000001.zip", "X_2_20250601040000_0000000000000001.zip", "X_20250601.zip",
             "X_20251301.zip", "X_0000000020250601.zip", "nodate.zip"]
    assert _one(spark, dates.name_date, names, "string") == [
        dt.date(2025, 6, 1), dt.date(2025, 6, 1), dt.date(2025, 6, 1), None, None, None]
    assert _one(spark, dates.basename, ["/a/b/c.zip", "file:/x/y/", "z"], "string") == ["c.zip", "y", "z"]


def test_split_and_labels(spark):
    parts = _one(spark, text.split_fields, ['D,a,"b,c",d', 'D,"x","y",z', "D,,e"], "string")
    assert parts == [["D", "a", '"b,c"', "d"], ["D", '"x"', '"y"', "z"], ["D", "", "e"]]
    df = spark.createDataFrame([("U1", "Unit", 126.0, None), ("U2", "B", 12.5, 50.0)],
                               "duid string, name string, mw double, mwh double")
    got = [r[0] for r in df.select(text.unit_label("duid", "name", "mw", "mwh")).collect()]
    assert got == ["U1 (Unit) (126 MW / ? MWh)", "U2 (B) (12.5 MW / 50 MWh)"]
    est = spark.createDataFrame([(59, False, 1), (100, True, 0), (600, False, 7), (0, True, 0)],
                                "s long, d boolean, n long")
    got = [r[0] for r in est.select(text.estimate_text("s", "d", "n")).collect()]
    assert got == [
        "this typically takes less than a minute (based on 1 recent request)",
        "this typically takes about 2 minutes",
        "this typically takes 10 minutes or more (based on 7 recent requests)",
        "this typically takes about 1 minute",
    ]
    ip = spark.createDataFrame([(" 1.2.3.4 , 5.6.7.8", "9.9.9.9"), ("", "9.9.9.9"), (None, None), (",x", "p")],
                               "f string, p string")
    assert [r[0] for r in ip.select(text.client_address("f", "p")).collect()] == ["1.2.3.4", "9.9.9.9", "unknown", ""]
    shown = spark.createDataFrame([(21600, 12.345, 2.675, None)], "n long, x double, z double, y double").select(
        text.display_count("n"), text.display_fixed("x", 2), text.display_fixed("z", 2),
        text.display_fixed("y", 2)).collect()[0]
    # rounded from the exact binary value, as a browser does: 12.345 is stored
    # as 12.3450000…06 (up), 2.675 as 2.67499999… (down)
    assert tuple(shown) == ("21,600", "12.35", "2.67", "—")
