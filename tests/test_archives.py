"""Landed archives → entries → lines → series."""

import datetime as dt
import io
import os
import zipfile

from pyspark.sql import functions as F

from wattline.operators.catalog_ops import match_daily
from wattline.plans.archive_plans import (
    choose_and_read,
    dispatch_candidates,
    dispatch_from_archives,
    scada_candidates,
    scada_from_archives,
)
from wattline.sources.archives import archive_entries, read_entries
from wattline.sources.catalog import list_files, parse_catalog

HDR = "I,FPP,FPPMW,1,INTERVAL_DATETIME,MEASUREMENT_DATETIME,DUID,MEASURED_MW,MW_QUALITY_FLAG\n"


def scada_csv(rows):
    return HDR + "".join(
        f'D,FPP,FPPMW,1,"{t}","{t}",{u},{mw},{fl}\n' for t, u, mw, fl in rows
    )


def zip_bytes(members: dict) -> bytes:
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return buf.getvalue()


def land(root, folder, name, data):
    os.makedirs(f"{root}/{folder}", exist_ok=True)
    with open(f"{root}/{folder}/{name}", "wb") as fh:
        fh.write(data)


def build(root):
    # settlement day 2025-10-01 (era 3): names carry the publication date 20251002
    first = scada_csv([("2025/10/01 04:00:00", "UNIT_A", 1.0, 0), ("2025/10/01 15:59:56", "UNIT_A", 2.0, 0)])
    second = scada_csv([("2025/10/01 15:59:56", "UNIT_A", 99.0, 2), ("2025/10/02 03:59:56", "UNIT_A", 3.0, 1),
                        ("2025/10/02 04:00:00", "UNIT_A", 4.0, 1)])
    land(root, "current", "PUBLIC_NEXT_DAY_FPPMW_20251002_0000000000000001.zip",
         zip_bytes({"PUBLIC_NEXT_DAY_FPPMW_20251002_0000000000000001.ZIP": zip_bytes({"A.CSV": first})}))
    land(root, "current", "PUBLIC_NEXT_DAY_FPPMW_2_20251002040000_0000000000000002.zip",
         zip_bytes({"PUBLIC_NEXT_DAY_FPPMW_2_20251002040000.ZIP": zip_bytes({"B.CSV": second})}))
    # the same day in the archive folder is corrupt: never needed, current wins
    land(root, "archive", "PUBLIC_NEXT_DAY_FPPMW_20251002_0000000000000009.zip", b"not a zip")
    # settlement day 2025-09-28 only in a weekly bundle (inner archives per publication date)
    bundle = zip_bytes({
        "PUBLIC_NEXT_DAY_FPPMW_20250929_0000000000000003.zip": zip_bytes({"C.CSV": scada_csv([
            ("2025/09/28 10:00:00", "UNIT_A", 5.0, 0), ("2025/09/28 10:00:04", "UNIT_B", 6.0, 0)])}),
        "PUBLIC_NEXT_DAY_FPPMW_20250930_0000000000000004.zip": zip_bytes({"D.CSV": scada_csv([
            ("2025/09/29 10:00:00", "UNIT_A", 7.0, 0)])}),
    })
    land(root, "archive", "PUBLIC_NEXT_DAY_FPPMW_20250928.zip", bundle)
    # dispatch: a daily file in current, a monthly bundle in archive
    dhdr = "I,DISPATCH,UNIT_SOLUTION,4,SETTLEMENTDATE,RUNNO,DUID,INITIALMW,INITIAL_ENERGY_STORAGE,ENERGY_STORAGE\n"
    day = dhdr + "D,DISPATCH,UNIT_SOLUTION,4,2026/03/11 04:05:00,1,UNIT_A,10,50,49\n"
    land(root, "current", "PUBLIC_NEXT_DAY_DISPATCH_20260311_0000000507452407.zip",
         zip_bytes({"PUBLIC_NEXT_DAY_DISPATCH_20260311.CSV": day}))
    month = zip_bytes({
        "PUBLIC_NEXT_DAY_DISPATCH_20260305.CSV": dhdr + "D,DISPATCH,UNIT_SOLUTION,4,2026/03/05 12:00:00,1,UNIT_A,3,30,29\n",
        "PUBLIC_NEXT_DAY_DISPATCH_20260306.CSV": dhdr + "D,DISPATCH,UNIT_SOLUTION,4,2026/03/06 12:00:00,1,UNIT_A,4,40,39\n",
    })
    land(root, "archive", "PUBLIC_NEXT_DAY_DISPATCH_20260301.zip", month)


def _targets(spark, *days):
    return spark.createDataFrame([(d,) for d in days], "target_date date")


def test_entries_and_rejects(spark, tmpdir_path):
    build(tmpdir_path)
    cat = parse_catalog(list_files(spark, tmpdir_path, "*.zip"))
    ent = archive_entries(cat.select("path")).collect()
    bad = [r for r in ent if r["error"]]
    assert len(bad) == 1 and bad[0]["error"] == "bad zip"
    inner = [r for r in ent if r["inner"] == "*" and r["outer"].endswith("0000000000000003.zip")]
    assert inner and inner[0]["outer"].endswith("0000000000000003.zip")
    lines = read_entries(archive_entries(cat.where(F.col("name").contains("DISPATCH_20260301")).select("path"))
                         .where(F.col("error").isNull()))
    assert lines.count() == 4  # two entries × (header + one row)


def test_scada_from_archives(spark, tmpdir_path):
    build(tmpdir_path)
    cat = parse_catalog(list_files(spark, tmpdir_path, "*.zip"))
    targets = _targets(spark, dt.date(2025, 10, 1), dt.date(2025, 9, 28))
    s = scada_from_archives(targets, cat)
    got = {(r["duid"], r["measurement_datetime"]): r["measured_mw"] for r in s.collect()}
    t = dt.datetime
    # the reading repeated in the second-half file keeps the first file's value
    assert got[("UNIT_A", t(2025, 10, 1, 15, 59, 56))] == 2.0
    assert got[("UNIT_A", t(2025, 10, 2, 3, 59, 56))] == 3.0
    assert ("UNIT_A", t(2025, 10, 2, 4, 0)) not in got  # next market day
    assert got[("UNIT_B", t(2025, 9, 28, 10, 0, 4))] == 6.0  # from the bundle
    assert ("UNIT_A", t(2025, 9, 29, 10, 0)) not in got  # other inner archive not read
    chosen, _, rejects = choose_and_read(scada_candidates(targets, cat), ["target_date", "format"])
    assert {r["source"] for r in chosen.where(F.col("target_date") == dt.date(2025, 10, 1)).collect()} == {"current"}
    assert "bad zip" in {r["reason"] for r in rejects.collect()}


def test_dispatch_from_archives(spark, tmpdir_path):
    build(tmpdir_path)
    cat = parse_catalog(list_files(spark, tmpdir_path, "*.zip"))
    targets = _targets(spark, dt.date(2026, 3, 11), dt.date(2026, 3, 5))
    s = dispatch_from_archives(targets, cat)
    got = sorted((r["market_day"], r["initialmw"]) for r in s.collect())
    assert got == [(dt.date(2026, 3, 5), 3.0), (dt.date(2026, 3, 11), 10.0)]
    chosen, _, _ = choose_and_read(dispatch_candidates(targets, cat), ["target_date"])
    src = {r["target_date"]: (r["source"], r["cls"]) for r in chosen.collect()}
    assert src[dt.date(2026, 3, 11)] == ("current", 1)
    assert src[dt.date(2026, 3, 5)] == ("archive", 2)


def test_daily_match_ignores_sequence_digits(spark):
    paths = spark.createDataFrame([
        ("/l/current/PUBLIC_NEXT_DAY_FPPMW_20250601_0000202506020000.zip",),
        ("/l/current/PUBLIC_NEXT_DAY_FPPMW_20250602_0000000000000001.zip",),
    ], "path string")
    cat = parse_catalog(paths)
    m = match_daily(_targets(spark, dt.date(2025, 6, 1)), cat).collect()
    # era 3 key is 20250602: the first name only holds it inside its sequence number
    assert [r["name"] for r in m] == ["PUBLIC_NEXT_DAY_FPPMW_20250602_0000000000000001.zip"]


def test_each_day_comes_from_its_own_files(spark, tmpdir_path):
    build(tmpdir_path)
    # settlement day 2025-10-02 has its own file; it repeats the 04:00 reading
    # (also present, with another value, in the file chosen for 2025-10-01)
    own = scada_csv([("2025/10/02 04:00:00", "UNIT_A", 40.0, 0), ("2025/10/02 05:00:00", "UNIT_A", 41.0, 0)])
    land(tmpdir_path, "current", "PUBLIC_NEXT_DAY_FPPMW_20251003_0000000000000005.zip",
         zip_bytes({"PUBLIC_NEXT_DAY_FPPMW_20251003_0000000000000005.ZIP": zip_bytes({"E.CSV": own})}))
    cat = parse_catalog(list_files(spark, tmpdir_path, "*.zip"))
    s = scada_from_archives(_targets(spark, dt.date(2025, 10, 1), dt.date(2025, 10, 2)), cat)
    got = {(r["duid"], r["measurement_datetime"]): r["measured_mw"] for r in s.collect()}
    assert got[("UNIT_A", dt.datetime(2025, 10, 2, 4, 0))] == 40.0
    assert got[("UNIT_A", dt.datetime(2025, 10, 1, 15, 59, 56))] == 2.0


def test_latest_bundle_first_among_bundles(spark, tmpdir_path):
    build(tmpdir_path)
    # an older bundle also holds the day's inner archive, with another value;
    # bundles are tried best (latest) first, so the newer bundle's value stays
    older = zip_bytes({
        "PUBLIC_NEXT_DAY_FPPMW_20250929_0000000000000008.zip": zip_bytes({"F.CSV": scada_csv([
            ("2025/09/28 10:00:00", "UNIT_A", 55.0, 0)])}),
    })
    land(tmpdir_path, "archive", "PUBLIC_NEXT_DAY_FPPMW_20250925.zip", older)
    cat = parse_catalog(list_files(spark, tmpdir_path, "*.zip"))
    s = scada_from_archives(_targets(spark, dt.date(2025, 9, 28)), cat)
    got = {(r["duid"], r["measurement_datetime"]): r["measured_mw"] for r in s.collect()}
    assert got[("UNIT_A", dt.datetime(2025, 9, 28, 10, 0))] == 5.0


def test_unreadable_inner_archive_rejects_and_falls_through(spark, tmpdir_path):
    """A corrupt inner ZIP in ``current``, and one without a CSV, give reject
    rows, and the day is served from the archive folder."""
    good = scada_csv([("2025/10/01 05:00:00", "UNIT_A", 8.0, 0)])
    name = "PUBLIC_NEXT_DAY_FPPMW_20251002_000000000000000{}.zip"
    land(tmpdir_path, "current", name.format(1), zip_bytes({"PUBLIC_NEXT_DAY_FPPMW_20251002_1.ZIP": b"no zip at all"}))
    land(tmpdir_path, "current", name.format(2), zip_bytes({"PUBLIC_NEXT_DAY_FPPMW_20251002_2.ZIP": zip_bytes({"readme.txt": "-"})}))
    land(tmpdir_path, "archive", name.format(3), zip_bytes({"PUBLIC_NEXT_DAY_FPPMW_20251002_3.ZIP": zip_bytes({"A.CSV": good})}))
    cat = parse_catalog(list_files(spark, tmpdir_path, "*.zip"))
    targets = _targets(spark, dt.date(2025, 10, 1))
    assert [r["measured_mw"] for r in scada_from_archives(targets, cat).collect()] == [8.0]
    chosen, _, rejects = choose_and_read(scada_candidates(targets, cat), ["target_date", "format"])
    assert {r["source"] for r in chosen.collect()} == {"archive"}
    reasons = sorted(r["reason"].split(":")[0] for r in rejects.collect())
    assert reasons == ["bad zip", "inner archive holds no CSV"]


def test_entry_dates_are_extracted_not_searched(spark, tmpdir_path):
    hdr = "I,DISPATCH,UNIT_SOLUTION,4,SETTLEMENTDATE,RUNNO,DUID,INITIALMW,INITIAL_ENERGY_STORAGE,ENERGY_STORAGE\n"
    row = "D,DISPATCH,UNIT_SOLUTION,4,2026/03/{:02d} 12:00:00,1,UNIT_A,{},40,39\n"
    land(tmpdir_path, "archive", "PUBLIC_NEXT_DAY_DISPATCH_20260301.zip", zip_bytes({
        # the sequence number of the 5th happens to hold the digits of the 6th
        "PUBLIC_NEXT_DAY_DISPATCH_20260305_0000000020260306.CSV": hdr + row.format(6, 1),
        "PUBLIC_NEXT_DAY_DISPATCH_20260306_0000000000000001.CSV": hdr + row.format(6, 2),
    }))
    cat = parse_catalog(list_files(spark, tmpdir_path, "*.zip"))
    out = dispatch_from_archives(_targets(spark, dt.date(2026, 3, 6)), cat).collect()
    assert [r["initialmw"] for r in out] == [2.0]
