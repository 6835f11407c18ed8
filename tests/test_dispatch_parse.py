"""Dispatch feed: one table of a multi-table file (FIXTURES §2)."""

import datetime as dt

from feed_files import write_text
from wattline.operators.summary import dispatch_summary
from wattline.operators.series import energy_series
from wattline.plans.dispatch import dispatch_series
from wattline.sources.lines import read_lines

FEED = """C,NEMP.WORLD,DISPATCH
I,DISPATCH,PRICE,4,SETTLEMENTDATE,RUNNO,REGIONID,RRP
D,DISPATCH,PRICE,4,2026/03/11 04:05:00,1,NSW1,88.1
I,DISPATCH,UNIT_SOLUTION,4,SETTLEMENTDATE,RUNNO,DUID,INITIALMW,INITIAL_ENERGY_STORAGE,ENERGY_STORAGE
D,DISPATCH,UNIT_SOLUTION,4,2026/03/11 04:00:00,1,UNIT_A,9.0,50.0,49.0
D,DISPATCH,UNIT_SOLUTION,4,2026/03/11 04:05:00,1,UNIT_A,10.0,50.5,49.7
I,DISPATCH,INTERCONNECTORSOLN,4,SETTLEMENTDATE,RUNNO,INTERCONNECTORID,MWFLOW
d,DISPATCH,UNIT_SOLUTION,4,2026/03/11 04:10:00,1,UNIT_A,11.0,49.7,48.9
D,DISPATCH,INTERCONNECTORSOLN,4,2026/03/11 04:10:00,1,N-Q,300
D,DISPATCH,UNIT_SOLUTION,4,2026/03/12 04:00:00,1,UNIT_A,12.0,NaN,48.0
D,DISPATCH,UNIT_SOLUTION,4,2026/03/12 04:05:00,1,UNIT_A,13.0,47.0,46.0
D,DISPATCH,UNIT_SOLUTION,4,2026/03/11 04:05:00,1,UNIT_B,1.0,2.0,3.0
"""

# an older layout without the storage columns
OLD = """I,DISPATCH,UNIT_SOLUTION,3,SETTLEMENTDATE,RUNNO,DUID,INITIALMW
D,DISPATCH,UNIT_SOLUTION,3,2025/01/05 12:00:00,1,UNIT_A,5.5
"""


def test_table_scoped_parse_and_window(spark, tmpdir_path):
    write_text(tmpdir_path, "d/DISPATCH_1.CSV", FEED)
    write_text(tmpdir_path, "d/DISPATCH_0.CSV", OLD)
    s = dispatch_series(read_lines(spark, f"{tmpdir_path}/d"))
    rows = {(r["duid"], r["settlementdate"]): r for r in s.collect()}
    t = dt.datetime
    # interval-end window: 04:00 belongs to the previous day, 04:05 opens the day
    assert rows[("UNIT_A", t(2026, 3, 11, 4, 0))]["market_day"] == dt.date(2026, 3, 10)
    assert rows[("UNIT_A", t(2026, 3, 11, 4, 5))]["market_day"] == dt.date(2026, 3, 11)
    assert rows[("UNIT_A", t(2026, 3, 12, 4, 0))]["market_day"] == dt.date(2026, 3, 11)
    # lower-case tag after another table's header still belongs to UNIT_SOLUTION
    assert rows[("UNIT_A", t(2026, 3, 11, 4, 10))]["initialmw"] == 11.0
    # absent storage columns are NULL
    old = rows[("UNIT_A", t(2025, 1, 5, 12, 0))]
    assert old["initialmw"] == 5.5 and old["energy_storage"] is None
    # PRICE and INTERCONNECTORSOLN rows never appear
    assert {k[0] for k in rows} == {"UNIT_A", "UNIT_B"}


def test_summary_and_energy_series(spark, tmpdir_path):
    write_text(tmpdir_path, "d/DISPATCH_1.CSV", FEED)
    write_text(tmpdir_path, "d/DISPATCH_0.CSV", OLD)
    s = dispatch_series(read_lines(spark, f"{tmpdir_path}/d"), units=["UNIT_A"])
    summ = {r["market_day"]: r for r in dispatch_summary(s).collect()}
    d11 = summ[dt.date(2026, 3, 11)]
    assert d11["total_rows"] == 3
    assert (d11["min_mw"], d11["max_mw"], d11["mean_mw"]) == (10.0, 12.0, 11.0)
    # NaN ignored: storage mean over 50.5 and 49.7 only
    assert d11["mean_init_mwh"] == 50.1
    old = summ[dt.date(2025, 1, 5)]
    assert old["min_init_mwh"] is None and old["mean_end_mwh"] is None
    es = energy_series(s)
    series_old = {r["series"] for r in es.collect() if r["market_day"] == dt.date(2025, 1, 5)}
    assert series_old == {"Dispatch MW"}  # all-NULL storage series are dropped
