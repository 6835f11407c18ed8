"""Feed parsing, header attachment and the SCADA series (FIXTURES §1)."""

import datetime as dt
import math

from pyspark.sql import functions as F

from feed_files import write_text
from wattline.operators.segments import ingest_report, rejects
from wattline.plans.scada import cast_scada, parse_scada, scada_series
from wattline.sources.lines import read_lines

FILE_A = """C,comment line
D,FPP,FPPMW,1,"2025/06/01 05:00:00","2025/06/01 05:00:00",UNIT_A,99,0
I,FPP,FPPMW,1,INTERVAL_DATETIME,MEASUREMENT_DATETIME,FPP_UNITID,MEASURED_MW,MW_QUALITY_FLAG
D,FPP,FPPMW,1,"2025/06/01 04:00:00","2025/06/01 04:00:00",UNIT_A,-12.5,0
D,FPP,FPPMW,1,"2025/06/01 04:00:04","2025/06/01 04:00:04",UNIT_A,NaN,1
D,FPP,FPPMW,1,"2025/06/01 04:00:08","2025/06/01 04:00:08",UNIT_A,,2

D,FPP,FPPMW,1,"2025/06/01 04:00:12","2025/06/01 04:00:12",UNIT_A,bad,0.0
D,FPP,FPPMW,1,"2025/06/01 04:00:16","2025/06/01 04:00:16",UNIT_A,3.5
D,FPP,FPPMW,1,"2025/06/01 04:00:20","2025/06/01 04:00:20",UNIT_A,4.5,1,extra,cells
D,FPP,FPPMW,1,"2025/06/01 04:00:00","2025/06/01 04:00:00",UNIT_AB,7,0
D,FPP,FPPMW,1,"2025/06/01 03:59:59","2025/06/01 03:59:59",UNIT_A,1,0
I,FPP,FPPMW,2,INTERVAL_DATETIME,MEASUREMENT_DATETIME,DUID,EXTRA,MEASURED_MW,MW_QUALITY_FLAG
D,FPP,FPPMW,2,"2025/06/01 16:00:00","2025/06/01 16:00:01",UNIT_A,"x,y",7.25,1
D,FPP,FPPMW,2,"2025/06/02 04:00:00","2025/06/02 04:00:00",UNIT_A,x,8,0
I,FPP,FPPMW,3,INTERVAL_DATETIME,MEASUREMENT_DATETIME,DUID,MEASURED_MW,MW_QUALITY_FLAG
"""

# the next day's file repeats a reading (overlap); the first file wins
FILE_B = """I,FPP,FPPMW,1,INTERVAL_DATETIME,MEASUREMENT_DATETIME,DUID,MEASURED_MW,MW_QUALITY_FLAG
D,FPP,FPPMW,1,"2025/06/01 16:00:00","2025/06/01 16:00:01",UNIT_A,-1,2
D,FPP,FPPMW,1,"2025/06/01 17:00:00","2025/06/01 17:00:00",UNIT_A,5,0
"""

# a file lacking a required column is rejected as a whole
FILE_C = """I,FPP,FPPMW,1,INTERVAL_DATETIME,MEASUREMENT_DATETIME,DUID,MEASURED_MW
D,FPP,FPPMW,1,"2025/06/01 06:00:00","2025/06/01 06:00:00",UNIT_A,5
"""


def _feed(tmp, crlf=False):
    nl = "\r\n" if crlf else "\n"
    write_text(tmp, "a/FEED_1.CSV", FILE_A, nl)
    write_text(tmp, "a/FEED_2.CSV", FILE_B, nl)
    write_text(tmp, "a/FEED_3.CSV", FILE_C, nl)
    return f"{tmp}/a"


def _v(x):
    return "nan" if isinstance(x, float) and math.isnan(x) else x


def _rows(df, *cols):
    return sorted((tuple(_v(r[c]) for c in cols) for r in df.collect()), key=repr)


def test_parse_values_and_quirks(spark, tmpdir_path):
    lines = read_lines(spark, _feed(tmpdir_path))
    typed = cast_scada(parse_scada(lines).rows).where(F.col("file").endswith("FEED_1.CSV"))
    got = {(r["duid"], r["measurement_datetime"]): r for r in typed.collect()}
    t = lambda s: dt.datetime.fromisoformat(s)
    a = got[("UNIT_A", t("2025-06-01 04:00:00"))]
    assert a["measured_mw"] == -12.5 and a["mw_quality_flag"] == 0
    assert math.isnan(got[("UNIT_A", t("2025-06-01 04:00:04"))]["measured_mw"])
    assert got[("UNIT_A", t("2025-06-01 04:00:08"))]["measured_mw"] is None
    bad = got[("UNIT_A", t("2025-06-01 04:00:12"))]
    assert bad["measured_mw"] is None and bad["mw_quality_flag"] == 0  # '0.0' → 0
    assert got[("UNIT_A", t("2025-06-01 04:00:16"))]["mw_quality_flag"] is None  # short row
    assert got[("UNIT_A", t("2025-06-01 04:00:20"))]["mw_quality_flag"] == 1  # long row
    q = got[("UNIT_A", t("2025-06-01 16:00:01"))]  # quoted comma, second layout
    assert q["measured_mw"] == 7.25 and q["interval_datetime"] == t("2025-06-01 16:00:00")
    # data line before any header is not attached
    assert ("UNIT_A", t("2025-06-01 05:00:00")) not in got


def test_rejects_and_report(spark, tmpdir_path):
    lines = read_lines(spark, _feed(tmpdir_path))
    parsed = parse_scada(lines)
    rej = rejects(parsed).collect()
    reasons = sorted({(r["file"].split("/")[-1], r["reason"]) for r in rej})
    assert ("FEED_1.CSV", "data line before any header") in reasons
    assert ("FEED_3.CSV", "missing required columns") in reasons
    rep = {r["file"].split("/")[-1]: r for r in ingest_report(parsed).collect()}
    assert rep["FEED_1.CSV"]["n_segments"] == 2  # the third header has no data
    assert rep["FEED_1.CSV"]["schemas_differ"] is True
    assert "FEED_3.CSV" not in rep


def test_series_window_dedup_units(spark, tmpdir_path):
    lines = read_lines(spark, _feed(tmpdir_path))
    s = scada_series(lines, units=["UNIT_A"])
    rows = _rows(s, "market_day", "measurement_datetime", "measured_mw")
    days = {r[0] for r in rows}
    # 03:59:59 belongs to the previous market day, next-day 04:00 to the next
    assert dt.date(2025, 5, 31) in days and dt.date(2025, 6, 2) in days
    # substring unit (UNIT_AB) is not UNIT_A
    assert all(r[2] != 7 for r in rows)
    # the 16:00:01 reading appears in both files: the first file's value stays
    dup = [r for r in rows if r[1] == dt.datetime(2025, 6, 1, 16, 0, 1)]
    assert len(dup) == 1 and dup[0][2] == 7.25


def test_crlf_and_split_invariance(spark, tmpdir_path):
    base = scada_series(read_lines(spark, _feed(tmpdir_path)))
    expect = _rows(base, "duid", "measurement_datetime", "measured_mw", "mw_quality_flag")
    crlf_dir = tmpdir_path + "/crlf"
    crlf = scada_series(read_lines(spark, _feed(crlf_dir, crlf=True)))
    assert _rows(crlf, "duid", "measurement_datetime", "measured_mw", "mw_quality_flag") == expect
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200")  # many splits per file
        split = scada_series(read_lines(spark, _feed(tmpdir_path)))
        assert _rows(split, "duid", "measurement_datetime", "measured_mw", "mw_quality_flag") == expect
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_landed_lines_same_result_and_pushdown(spark, tmpdir_path):
    from wattline.sources.lines import land_lines, read_landed_lines

    lines = read_lines(spark, _feed(tmpdir_path))
    expect = _rows(scada_series(lines), "duid", "measurement_datetime", "measured_mw", "mw_quality_flag")
    land_lines(lines, f"{tmpdir_path}/landed")
    landed = read_landed_lines(spark, f"{tmpdir_path}/landed")
    got = scada_series(landed)
    assert _rows(got, "duid", "measurement_datetime", "measured_mw", "mw_quality_flag") == expect
    hdr = landed.where(F.col("tag") == "I")
    assert "PushedFilters: [IsNotNull(tag), EqualTo(tag,I)]" in hdr._jdf.queryExecution().executedPlan().toString()
