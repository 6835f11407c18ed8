"""Endpoint-shaped entry points (F12, F14, F17, F18, §2.12)."""

import datetime as dt
import json

import pytest

from feed_files import write_text
from wattline import api
from wattline.sources.lines import read_lines
from test_scada_parse import _feed
from test_dispatch_parse import FEED


def test_date_param_and_default():
    assert api.parse_request_date("2025-06-01") == dt.date(2025, 6, 1)
    for bad in ["2025-6-1", "2025/06/01", "2025-02-30", "x"]:
        with pytest.raises(ValueError):
            api.parse_request_date(bad)
    assert api.default_request_date(dt.date(2025, 3, 1)) == dt.date(2025, 2, 28)


def test_scada_view_one_unit_day(spark, tmpdir_path):
    lines = read_lines(spark, _feed(tmpdir_path))
    v = api.scada_view(lines, "UNIT_A", dt.date(2025, 6, 1))
    s = v["summary"].collect()
    assert len(s) == 1 and s[0]["total_rows"] == v["series"].count()
    c = api.scada_view(lines, "UNIT_A", dt.date(2025, 6, 1), cap=2)["counts"].collect()[0]
    assert (c["total_rows"], c["displayed_rows"]) == (s[0]["total_rows"], 2)
    recs = [json.loads(r["record"]) for r in v["records"].collect()]
    assert all(" " in r["measurement_datetime"] for r in recs)
    assert any(r["measured_mw"] is None for r in recs)  # NaN → null
    w = v["warnings"].collect()[0]
    assert w["source_type"] == "archive" and w["warnings"].startswith("Half a market day")  # partial-publication era
    with pytest.raises(LookupError):
        api.scada_view(lines, "NOPE", dt.date(2025, 6, 1), strict=True)


def test_energy_view(spark, tmpdir_path):
    write_text(tmpdir_path, "d/x.CSV", FEED)
    v = api.energy_view(read_lines(spark, f"{tmpdir_path}/d"), "UNIT_A", dt.date(2026, 3, 11))
    assert v["summary"].collect()[0]["total_rows"] == 3
    assert v["records"].count() == 3


def test_log_stats_and_info(spark):
    from wattline.plans.feeds_from_tables import events_as_log, table

    log = events_as_log(table(spark, "/root/testdata/sf0.001", "events"))
    st = api.log_stats(log)
    total = st["total_requests"].collect()[0]["total_requests"]
    by_action = st["by_action"].collect()
    assert sum(r["cnt"] for r in by_action) == total == log.count()
    assert [r["cnt"] for r in by_action] == sorted((r["cnt"] for r in by_action), reverse=True)
    assert st["by_duid"].count() <= 20 and st["by_ip"].count() <= 50 and st["recent"].count() <= 100
    info = api.info(log)
    assert info["data_start_date"] == "2025-02-28"
    assert {r["source_type"] for r in info["estimates"].collect()} == {"current", "archive", "dispatch_current", "dispatch_archive"}


def test_day_requests_as_table(spark, tmpdir_path):
    from wattline.plans.scada import scada_series

    lines = read_lines(spark, _feed(tmpdir_path))
    req = spark.createDataFrame([("UNIT_A", dt.date(2025, 6, 1))], "duid string, market_day date")
    s = scada_series(lines, days=req)
    assert {(r["duid"], r["market_day"]) for r in s.collect()} == {("UNIT_A", dt.date(2025, 6, 1))}


def test_request_date_within_the_published_range():
    as_of = dt.date(2026, 1, 1)
    assert api.check_request_date(dt.date(2025, 2, 28), True, as_of) == dt.date(2025, 2, 28)
    assert api.check_request_date(dt.date(2025, 2, 11), False, as_of)
    for day, scada in ((dt.date(2025, 2, 27), True), (dt.date(2025, 2, 10), False), (as_of, True)):
        with pytest.raises(ValueError):
            api.check_request_date(day, scada, as_of)
