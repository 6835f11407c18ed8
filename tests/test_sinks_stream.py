"""Sinks (K1–K5, K8), keep-first strategies (D1), streaming landing (§7.5)."""

import glob
import json
import os

from pyspark.sql import functions as F

from feed_files import write_text
from wattline.operators.dedup import keep_first
from wattline.operators.series import head_per_group
from wattline.plans.feeds_from_tables import scada_feed_lines, table
from wattline.plans.scada import scada_series
from wattline.sinks.writers import write_series
from wattline.streaming.landing import start_scada_landing

SF = "/root/testdata/sf0.001"


def _series(spark):
    return scada_series(scada_feed_lines(table(spark, SF, "events")))


def test_csv_parquet_json(spark, tmpdir_path):
    s = _series(spark)
    n = s.count()
    write_series(s, f"{tmpdir_path}/csv", "csv")
    csvs = glob.glob(f"{tmpdir_path}/csv/market_day=*/duid=*/*.csv")
    assert csvs
    with open(csvs[0]) as fh:
        header = fh.readline().strip().split(",")
        first = fh.readline().strip().split(",")
    assert header == ["INTERVAL_DATETIME", "MEASUREMENT_DATETIME", "MEASURED_MW", "MW_QUALITY_FLAG"]
    assert len(first[1]) == 19 and first[1][10] == " "  # YYYY-MM-DD HH:MM:SS
    back = spark.read.option("header", True).csv(f"{tmpdir_path}/csv")
    assert back.count() == n
    write_series(s, f"{tmpdir_path}/pq", "parquet")
    pq = spark.read.parquet(f"{tmpdir_path}/pq")
    assert pq.count() == n and dict(pq.dtypes)["measurement_datetime"] == "timestamp_ntz"
    write_series(s, f"{tmpdir_path}/js", "json")
    lines = [json.loads(x) for f in glob.glob(f"{tmpdir_path}/js/market_day=*/*.txt") for x in open(f)]
    assert len(lines) == n
    assert all("measured_mw" in r for r in lines)  # NULL and NaN written as null
    assert any(r["measured_mw"] is None for r in lines)


def test_head_cap(spark):
    s = _series(spark)
    h = head_per_group(s, n=1)
    assert h.count() == s.select("duid", "market_day").distinct().count()


def test_keep_first_strategies_agree_with_hot_key(spark):
    li = table(spark, "/root/testdata/sf0.01", "lineitem")
    # a hot key: a third of all rows share one (orderkey, linenumber)
    hot = li.withColumn("l_orderkey", F.when(F.col("l_partkey") % 3 == 0, F.lit(-1)).otherwise(F.col("l_orderkey")))
    order = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    a = keep_first(hot, ["l_orderkey", "l_linenumber"], order)
    b = keep_first(hot, ["l_orderkey", "l_linenumber"], order, strategy="window")
    key = lambda df: sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())
    assert key(a) == key(b)


FEED1 = """I,FPP,FPPMW,1,INTERVAL_DATETIME,MEASUREMENT_DATETIME,DUID,MEASURED_MW,MW_QUALITY_FLAG
D,FPP,FPPMW,1,"2025/06/01 05:00:00","2025/06/01 05:00:00",U1,1,0
D,FPP,FPPMW,1,"2025/06/01 05:00:04","2025/06/01 05:00:04",U1,2,0
"""
FEED2 = """I,FPP,FPPMW,1,INTERVAL_DATETIME,MEASUREMENT_DATETIME,DUID,MEASURED_MW,MW_QUALITY_FLAG
D,FPP,FPPMW,1,"2025/06/01 05:00:04","2025/06/01 05:00:04",U1,99,0
D,FPP,FPPMW,1,"2025/06/01 05:00:08","2025/06/01 05:00:08",U1,3,0
"""


def test_streaming_landing_idempotent(spark, tmpdir_path):
    land, out, ck = f"{tmpdir_path}/land", f"{tmpdir_path}/out", f"{tmpdir_path}/ck"
    write_text(land, "f1.csv", FEED1)
    q = start_scada_landing(spark, land, out, checkpoint=ck, trigger_once=True)
    q.awaitTermination(120)
    write_text(land, "f2.csv", FEED2)
    q = start_scada_landing(spark, land, out, checkpoint=ck, trigger_once=True)
    q.awaitTermination(120)
    got = sorted((str(r["measurement_datetime"]), r["measured_mw"]) for r in spark.read.parquet(out).collect())
    assert got == [("2025-06-01 05:00:00", 1.0), ("2025-06-01 05:00:04", 2.0), ("2025-06-01 05:00:08", 3.0)]


def test_streaming_dispatch_landing(spark, tmpdir_path):
    from test_dispatch_parse import FEED
    from wattline.streaming.landing import start_dispatch_landing

    land, out, ck = f"{tmpdir_path}/dland", f"{tmpdir_path}/dout", f"{tmpdir_path}/dck"
    write_text(land, "d1.csv", FEED)
    start_dispatch_landing(spark, land, out, checkpoint=ck, trigger_once=True).awaitTermination(120)
    write_text(land, "d2.csv", FEED)  # a replayed copy adds nothing
    start_dispatch_landing(spark, land, out, checkpoint=ck, trigger_once=True).awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == 6 and got.select("duid", "settlementdate").distinct().count() == 6


def _many(spark):
    """One unit-day of 3,000 readings and a second day, in no order."""
    from pyspark.sql import functions as F

    t = F.timestamp_seconds(F.lit(1748750400) + F.pmod(F.col("id") * 7919, F.lit(3000)) * 4).cast("timestamp_ntz")
    return spark.range(3000).repartition(7).select(
        F.lit("U1").alias("duid"), F.when(F.col("id") % 2 == 0, F.lit("2025-06-01")).otherwise(F.lit("2025-06-02")).cast("date").alias("market_day"),
        t.alias("interval_datetime"), t.alias("measurement_datetime"), F.col("id").cast("double").alias("measured_mw"), F.lit(0).alias("mw_quality_flag"),
    )


def test_csv_lines_are_in_time_order_and_days_stay(spark, tmpdir_path):
    import glob

    from wattline.sinks.writers import write_csv, write_parquet

    s = _many(spark)
    write_csv(s, f"{tmpdir_path}/csv")
    for f in glob.glob(f"{tmpdir_path}/csv/market_day=*/duid=U1/*.csv"):
        times = [line.split(",")[1] for line in open(f).read().splitlines()[1:]]
        assert len(times) > 500 and times == sorted(times)
    for write, folder in ((write_csv, "csv2"), (write_parquet, "pq2")):
        for day in ("2025-06-01", "2025-06-02"):
            write(s.where(f"market_day = '{day}'"), f"{tmpdir_path}/{folder}")
        assert len(glob.glob(f"{tmpdir_path}/{folder}/market_day=*")) == 2


def test_extreme_readings_leave_other_groups_alone(spark):
    from wattline.operators.summary import dispatch_summary, scada_summary

    rows = [("A", 1.0), ("A", 2.0), ("B", 1e29), ("B", 3.0), ("C", float("inf")), ("D", 1e300), ("E", float("nan")), ("E", 4.0)]
    df = spark.createDataFrame([(u, "2025-06-01", v, 0, v, v, v) for u, v in rows],
                               "duid string, market_day string, measured_mw double, mw_quality_flag int, initialmw double, initial_energy_storage double, energy_storage double")
    for out, mean in ((scada_summary(df), "mean_mw"), (dispatch_summary(df), "mean_mw")):
        got = {r["duid"]: r[mean] for r in out.collect()}
        assert got["A"] == 1.5 and got["E"] == 4.0 and got["C"] == float("inf")
        assert abs(got["B"] / 5e28 - 1) < 1e-9 and got["D"] == 1e300
