"""Unit registry (FIXTURES §4), flags (§5), request log (§6)."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from feed_files import write_text
from wattline.operators.logstats import combined_estimate, log_counts, recent, timing_estimates, top_counts
from wattline.operators.series import quality_flags
from wattline.sources.registry import (
    first_readable,
    read_quality_flags,
    read_registry_json,
    registry_json_rejects,
    registry_from_lines,
    registry_from_sheet,
    header_ranks,
    units_by_state,
    units_from_registry,
    in_state_order,
    read_registry_rows,
    units_nested,
    write_registry_json,
)
from wattline.sources.requestlog import append_log, read_log

SHEET = """Generation Information,,,,,,
Published,,,,,,
,,,,,,
DUID,Unit Name,Technology Type - Descriptor,Commitment Status,Region,Agg Nameplate Capacity (MW AC),Agg Nameplate Storage Capacity (MWh)
 BAT1 ,Battery One,Battery Storage,In Service,NSW1,100,200
BAT2,,Battery Storage,In Service,QLD1,n/a,
SOL1,Solar One,Solar PV,In Service,VIC1,50,
BAT3,Battery Three,Battery Storage,Committed,SA1,30,60
BAT4,Battery Four,Battery Storage,In Service,WA1,30,60
,No Id,Battery Storage,In Service,SA1,30,60
"""


def test_header_rule():
    h = ["DUID", "Unit Name", "duid extra", "Region Name", "Region"]
    assert min(header_ranks(h, "DUID"))[1] == 0
    assert min(header_ranks(h, "Region"))[1] == 4  # exact beats prefix
    assert header_ranks(["region code"], "Region") == [(True, 0)]
    assert header_ranks(["x"], "Region") == []


def test_registry_from_lines(spark, tmpdir_path):
    from wattline.sources.lines import read_lines

    write_text(tmpdir_path, "reg/sheet.csv", SHEET)
    units = units_from_registry(registry_from_lines(read_lines(spark, f"{tmpdir_path}/reg")))
    got = {r["duid"]: r for r in units.collect()}
    assert set(got) == {"BAT1", "BAT2"}
    assert got["BAT1"]["state"] == "NSW" and got["BAT1"]["capacity_mwh"] == 200.0
    assert got["BAT2"]["name"] == "BAT2" and got["BAT2"]["capacity_mw"] is None
    bs = {r["state"]: r for r in units_by_state(units).collect()}
    assert set(bs) == {"QLD", "NSW", "VIC", "SA", "TAS"} and bs["TAS"]["n_units"] == 0
    assert bs["NSW"]["total_units"] == 2 and bs["NSW"]["nonempty_states"] == 2
    nested = {(r["state"], r["unit_no"]): r["unit"] for r in units_nested(units).collect()}
    assert nested["TAS", 0] is None and nested["NSW", 1]["duid"] == "BAT1" and ("NSW", 0) not in nested
    shown = [r["state"] for r in in_state_order(units_nested(units)).collect()]
    assert shown == sorted(shown) and set(shown) == {"NSW", "QLD", "SA", "TAS", "VIC"}
    write_registry_json(units, f"{tmpdir_path}/nested")
    assert sorted(map(str, read_registry_rows(spark, f"{tmpdir_path}/nested").collect())) == sorted(
        map(str, units.select("state", "duid", "name", "capacity_mw", "capacity_mwh", "region").collect())
    )


def test_registry_text_without_required_columns(spark, tmpdir_path):
    write_text(tmpdir_path, "reg/sheet.csv", "title\nDUID,Unit Name,Technology Type,Commitment Status\nA,a,b,c\n")
    from wattline.sources.lines import read_lines

    with pytest.raises(ValueError):
        registry_from_lines(read_lines(spark, f"{tmpdir_path}/reg"))


def test_registry_sheet_missing_column(spark):
    df = spark.createDataFrame([("A", "x")], "DUID string, Other string")
    with pytest.raises(ValueError):
        registry_from_sheet(df)


def test_json_fallbacks(spark, tmpdir_path):
    reg = {"NSW": [{"duid": "U1", "name": "Unit 1", "capacity_mw": 126, "region": "NSW1"}], "TAS": []}
    p = write_text(tmpdir_path, "units.json", json.dumps(reg))
    units = read_registry_json(spark, p).collect()
    assert [(u["state"], u["duid"], u["capacity_mw"], u["capacity_mwh"]) for u in units] == [("NSW", "U1", 126.0, None)]
    flags = {"0": {"label": "Good", "description": "d", "color": "#0"}, "-1": {"label": "N/A", "description": "d", "color": "#1"}}
    fp = write_text(tmpdir_path, "flags.json", json.dumps(flags))
    assert sorted((r["flag"], r["label"]) for r in read_quality_flags(spark, fp).collect()) == [(-1, "N/A"), (0, "Good")]
    assert quality_flags(spark).count() == 5
    # one bad state, and one bad unit, leave the others
    mixed = {"NSW": [{"duid": "U1"}, 7, {"name": "no id"}], "QLD": "soon", "SA": {"duid": "U2"}, "VIC": [{"duid": "U3", "capacity_mw": "x"}]}
    mp = write_text(tmpdir_path, "mixed/units.json", json.dumps(mixed, indent=2))
    write_text(tmpdir_path, "mixed/other.json", "no json")
    got = sorted((u["state"], u["duid"], u["name"], u["capacity_mw"]) for u in read_registry_json(spark, f"{tmpdir_path}/mixed").collect())
    assert got == [("NSW", "U1", "U1", None), ("VIC", "U3", "U3", None)]
    bad = {(r["file"].rsplit("/", 1)[1], r["state"], r["reason"]) for r in registry_json_rejects(spark, f"{tmpdir_path}/mixed").collect()}
    assert bad == {("other.json", None, "not a JSON object"), ("units.json", "QLD", "not a list of units"), ("units.json", "SA", "not a list of units")}
    assert mp.endswith("units.json")
    broken = lambda: spark.read.parquet(os.path.join(tmpdir_path, "missing"))
    assert first_readable([broken, lambda: read_registry_json(spark, p)]).count() == 1


def _log(spark, n_view_current):
    rows = []
    for i in range(n_view_current):
        rows.append((i, "1.1.1.1", "U1", "view", (i + 1) * 1000, "current"))
    rows += [(1000 + i, "2.2.2.2", f"U{i % 3}", "download_csv", None, "archive") for i in range(7)]
    df = spark.createDataFrame(rows, "id long, ip string, duid string, action string, duration_ms long, source_type string")
    return df.withColumn("timestamp", F.lit(None).cast("timestamp_ntz")).withColumn("date", F.lit(None).cast("date"))


@pytest.mark.parametrize("n", [4, 5, 6, 100, 101])
def test_timing_estimate_rank_rule(spark, n):
    est = {r["source_type"]: r for r in timing_estimates(_log(spark, n)).collect()}
    cur = est["current"]
    last = list(range(1, n + 1))[-100:]  # durations of the latest ≤100 views, in seconds
    if n < 5:
        assert (cur["seconds"], cur["is_default"], cur["sample_count"]) == (120, True, n)
    else:
        expect = sorted(last)[int(0.75 * (len(last) - 1))]
        assert (cur["seconds"], cur["is_default"], cur["sample_count"]) == (expect, False, len(last))
    assert est["archive"]["is_default"] and est["archive"]["seconds"] == 480
    comb = combined_estimate(timing_estimates(_log(spark, n)), "current").collect()[0]
    assert comb["seconds"] == max(cur["seconds"], 60)


def test_log_stats_and_migration(spark, tmpdir_path):
    log = _log(spark, 6)
    counts = {r["action"]: (r["cnt"], r["total_requests"]) for r in log_counts(log).collect()}
    assert counts == {"view": (6, 13), "download_csv": (7, 13)}
    top = [(r["duid"], r["cnt"]) for r in top_counts(log, "duid", 2).collect()]
    assert top == [("U1", 8), ("U0", 3)]
    assert [r["id"] for r in recent(log, 3).collect()] == [1006, 1005, 1004]
    old = spark.createDataFrame([(-1, "view")], "id long, action string")
    path = os.path.join(tmpdir_path, "log")
    old.write.parquet(path)
    append_log(log, path)
    merged = read_log(spark, path)
    assert merged.count() == 14 and "source_type" in merged.columns
    assert merged.where("id = -1").collect()[0]["duration_ms"] is None
