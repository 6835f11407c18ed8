"""Plan shapes that matter at scale, checked on every registered query."""

import pytest

import __spark_entry__ as E
from wattline.session import release_cached

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    found = {}
    for name, fn in E.QUERIES.items():
        found[name] = _plan(fn(spark, SF))
        release_cached()
    return found


def test_no_cartesian_or_nested_loop(plans):
    for name, p in plans.items():
        assert "CartesianProduct" not in p, name
        assert "BroadcastNestedLoopJoin" not in p, name


def test_feed_text_is_scanned_once(plans):
    for name in ("segment_parse", "table_scoped_parse", "scada_series", "dispatch_series", "unit_prefilter"):
        scans = [p.split("ReadSchema:")[1].splitlines()[0] for p in plans[name].split("FileScan")[1:]]
        assert sum("value:string" in p for p in scans) == 1, name
        assert "InMemoryTableScan" not in plans[name], name


def test_energy_series_is_one_pass(plans):
    assert plans["energy_series"].count("FileScan") == 1
    assert plans["energy_series"].count("Exchange hash") == 1


def test_landed_by_unit_day_needs_no_exchange(plans):
    assert "Exchange" not in plans["clustered_day_report"]


def test_keep_first_combines_before_shuffle(spark):
    from pyspark.sql import functions as F

    q = E.queries()["keep_first_dedup"](spark, SF)
    p = q._jdf.queryExecution().executedPlan().toString()
    # partial aggregate below the exchange, final above it
    assert p.count("SortAggregate") >= 2 or p.count("HashAggregate") >= 2
    assert "Window" not in p


def test_scan_reads_only_needed_columns(spark):
    df = E.queries()["scada_summary"](spark, SF)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "props" not in p  # the unused JSON column of events is never read
