"""SQL table functions over given tables."""

import datetime as dt

from wattline import sqlapi
from wattline.operators.summary import scada_summary
from wattline.session import land_clustered
from wattline.plans.sql_queries import clustered_day_report


def _series(spark):
    day = dt.date(2025, 6, 1)
    rows = [(u, day + dt.timedelta(d), dt.datetime(2025, 6, 1 + d, 5, 0, 4 * i), dt.datetime(2025, 6, 1 + d, 5, 0, 4 * i), float(i), i % 3 or None)
            for u in ("U1", "U2", "U'3") for d in range(3) for i in range(10)]
    return spark.createDataFrame(rows, "duid string, market_day date, interval_datetime timestamp_ntz,"
                                       " measurement_datetime timestamp_ntz, measured_mw double, mw_quality_flag int")


def test_functions_answer_one_request_and_many(spark):
    series = _series(spark)
    names = sqlapi.register(spark, scada=series, cap=3)
    assert {"scada_view", "scada_records", "app_info"} <= set(names) and "units_of" not in names
    one = spark.sql("SELECT * FROM scada_view('U1', DATE '2025-06-02')")
    assert one.columns == ["interval_datetime", "measurement_datetime", "measured_mw", "mw_quality_flag"]
    assert one.count() == 10
    assert spark.sql("SELECT * FROM scada_view('U9', DATE '2025-06-02')").count() == 0
    assert spark.sql("SELECT * FROM scada_records(\"U'3\", DATE '2025-06-02')").count() == 3
    every = spark.sql("SELECT k.duid, k.market_day, s.* FROM (SELECT DISTINCT duid, market_day FROM _scada_view) k,"
                      " LATERAL scada_summary_of(k.duid, k.market_day) s")
    assert sorted(every.collect()) == sorted(scada_summary(series).collect())
    assert [r["value"] for r in spark.sql("SELECT * FROM app_info() WHERE item = 'cutover_date'").collect()] == ["2026-01-11"]
    note = spark.sql("SELECT * FROM day_notes('U2', DATE '2025-06-03')").collect()[0]
    assert note["source_type"] == "archive" and "16:00" in note["warning"]


def test_constants_reach_the_landed_table(spark):
    series = land_clustered(_series(spark), "probe", ("duid", "market_day"), ("measurement_datetime",))
    sqlapi.register(spark, scada=series)
    plan = spark.sql("SELECT * FROM scada_summary_of('U1', DATE '2025-06-02')")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(duid,U1)" in plan and "Exchange" not in plan


def test_landed_by_unit_day_nothing_is_shuffled(spark):
    series = land_clustered(_series(spark), "probe", ("duid", "market_day"), ("measurement_datetime",))
    report = clustered_day_report(series)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    rows = report.collect()
    assert len(rows) == 9 and {r["total_rows"] for r in rows} == {10}
