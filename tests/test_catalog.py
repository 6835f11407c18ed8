"""Catalog names, eras, as-of / top-k as-of against brute force (FIXTURES §3)."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wattline.functions.dates import day_warnings, era, join_warnings, scada_search_keys, scada_source_class
from wattline.operators.asof import asof_topk
from wattline.operators.catalog_ops import fallthrough
from wattline.sources.catalog import parse_catalog

NAMES = [
    ("PUBLIC_NEXT_DAY_FPPMW_20250601_0000000000000123.zip", "FPPMW", 1, dt.date(2025, 6, 1), False),
    ("PUBLIC_NEXT_DAY_FPPMW_2_20250601040000_0000000000000124.zip", "FPPMW", 2, dt.date(2025, 6, 1), False),
    ("PUBLIC_NEXT_DAY_FPPMW_20250228.zip", "FPPMW", 1, dt.date(2025, 2, 28), True),
    ("PUBLIC_NEXT_DAY_FPPMW_2_20250907.zip", "FPPMW", 2, dt.date(2025, 9, 7), True),
    ("PUBLIC_NEXT_DAY_DISPATCH_20260311_0000000507452407.zip", "DISPATCH", 1, dt.date(2026, 3, 11), False),
    ("PUBLIC_NEXT_DAY_DISPATCH_20260301.zip", "DISPATCH", 1, dt.date(2026, 3, 1), True),
    ("PUBLIC_NEXT_DAY_DISPATCH_20261301.zip", "DISPATCH", 1, None, True),
]


def test_name_shapes(spark):
    df = spark.createDataFrame([(f"file:/land/archive/{n[0]}",) for n in NAMES] + [("file:/land/archive/readme.txt",)], "path string")
    got = {r["name"]: r for r in parse_catalog(df).collect()}
    assert "readme.txt" not in got
    for name, product, fmt, date, bundle in NAMES:
        r = got[name]
        assert (r["product"], r["format"], r["file_date"], r["is_bundle"], r["source"]) == (product, fmt, date, bundle, "archive")


def test_eras_keys_warnings(spark):
    days = [dt.date(2025, 4, 28), dt.date(2025, 4, 29), dt.date(2025, 9, 10), dt.date(2025, 9, 11), dt.date(2026, 1, 11)]
    df = spark.createDataFrame([(d,) for d in days], "d date").select(
        "d", era("d").alias("era"), scada_search_keys("d").alias("keys"),
        join_warnings(day_warnings("d")).alias("w"), scada_source_class("d").alias("src"))
    r = {x["d"]: x for x in df.collect()}
    assert r[days[0]]["era"] == 1 and r[days[0]]["keys"] == ["20250428", "20250429"]
    assert r[days[1]]["era"] == 2 and r[days[1]]["keys"] == ["20250430"] and r[days[1]]["w"]
    assert r[days[2]]["w"] and not r[days[3]]["w"] and r[days[3]]["era"] == 3
    assert r[days[3]]["src"] == "archive" and r[days[4]]["src"] == "current"


@pytest.mark.parametrize("width", [1, 7, 100])
def test_asof_topk_matches_brute_force(spark, width):
    """Buckets of one key, of some, and of all; keys below 0, gaps, ties."""
    rnd = random.Random(7)
    right = [(g, rnd.randint(0, 60), f"n{rnd.randint(0, 9)}{i}") for i in range(80) for g in (rnd.choice("ab"),)]
    left = [(i, g, rnd.randint(-5, 70)) for i in range(200) for g in (rnd.choice("abc"),)]
    rdf = spark.createDataFrame(right, "g string, k int, name string")
    ldf = spark.createDataFrame(left, "id int, g string, t int")
    out = asof_topk(ldf, rdf, by=["g"], left_on="t", right_on="k", tiebreak=["name"], k=3,
                    bucket=lambda c: F.floor((c + 10) / width))
    got = sorted((r["id"], r["asof_rank"], r["right_name"]) for r in out.collect())
    expect = []
    for i, g, t in left:
        cands = sorted([(k, n) for gg, k, n in right if gg == g and k <= t], reverse=True)[:3]
        expect += [(i, j + 1, n) for j, (_, n) in enumerate(cands)]
    assert got == sorted(expect)


def test_asof_over_months_and_years_without_bundles(spark):
    days = [dt.date(2024, 1, 31), dt.date(2024, 1, 31), dt.date(2024, 3, 1), dt.date(2025, 12, 31), None]
    right = spark.createDataFrame([(1, d, f"b{i}") for i, d in enumerate(days)], "format int, file_date date, name string")
    asks = [dt.date(2024, 1, 30), dt.date(2024, 1, 31), dt.date(2024, 2, 29), dt.date(2024, 3, 1), dt.date(2025, 11, 5), dt.date(2027, 1, 1), None]
    left = spark.createDataFrame([(f, d) for f in (1, 2) for d in asks], "format int, t date")
    out = asof_topk(left, right, by=["format"], left_on="t", right_on="file_date", tiebreak=["name"], k=3)
    assert out.columns == ["format", "t", "asof_rank", "right_file_date", "right_name"]
    got = sorted((r["t"], r["asof_rank"], r["right_name"]) for r in out.collect())
    want = []
    for t in asks[:-1]:
        c = sorted(((d, f"b{i}") for i, d in enumerate(days) if d and d <= t), reverse=True)[:3]
        want += [(t, j + 1, n) for j, (_, n) in enumerate(c)]
    assert got == sorted(want)
    # nothing is windowed over a whole format but k rows a month
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_fallthrough_first_source_wins(spark):
    rows = [(1, 1, "archive", "x"), (1, 1, "current", "y"), (1, 2, "archive", "z"), (2, 1, "archive", "w")]
    df = spark.createDataFrame(rows, "t int, format int, source string, name string")
    got = sorted((r["t"], r["format"], r["name"]) for r in fallthrough(df, ["t", "format"]).collect())
    assert got == [(1, 1, "y"), (1, 2, "z"), (2, 1, "w")]
