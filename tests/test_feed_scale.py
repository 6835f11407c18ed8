"""What the feed scan does once per line, however large the feed (own rows)."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

import __spark_entry__ as E
from wattline.operators import segments
from wattline.operators.dedup import keep_first
from wattline.plans import archive_queries, scada
from wattline.plans.dispatch import dispatch_series
from wattline.plans.feeds_from_tables import dispatch_archives, dispatch_feed_lines, scada_feed_lines
from wattline.plans.scada import scada_series
from wattline.sources.lines import line_key

LINEITEM = (
    "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_tax double, l_shipdate timestamp_ntz"
)
ORDERS = "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def _lineitem(spark):
    # noon and an hour: market days 1 to 28
    rows = [(k, k, k % 3, 1, 1.5 * k, 2.0 * k, 0.5, dt.datetime(1999, 3, d, 12)) for k, d in enumerate(range(1, 29), 1)]
    return spark.createDataFrame(rows, LINEITEM)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _text_lines(spark, values, **extra):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "pos long, value string")
    cols = [F.lit(v).alias(k) for k, v in extra.items()]
    return rows.select(F.lit("a.csv").alias("file"), line_key(0, F.col("pos")).alias("line_key"), "value", *cols)


def test_dispatch_from_archives_serves_every_day(spark, tmpdir_path):
    path = f"{tmpdir_path}/{uuid.uuid4().hex}"
    _lineitem(spark).write.parquet(f"{path}/lineitem.parquet")
    got = E.queries()["dispatch_from_archives"](spark, path).collect()
    assert sorted(r["market_day"].day for r in got) == list(range(1, 29))


def test_archive_listing_and_text_are_derived_once(spark):
    _, archives = dispatch_archives(_lineitem(spark))
    for df in (archives.listing, archives.text):
        assert "date_format" not in _plan(df)  # not anew for every round of the choice


def test_fields_are_split_once(spark):
    orders = spark.createDataFrame([(1, "O", 5.0, dt.datetime(1999, 3, 2))], ORDERS)
    series = dispatch_series(dispatch_feed_lines(_lineitem(spark), orders))
    assert "split(" not in _plan(series)  # not once per use of a field, not in pushed filters
    assert series.count() == 28


def test_feed_lines_are_rendered_once(spark):
    events = spark.createDataFrame([(1, dt.datetime(2024, 1, 2, 5), 7, "view", 1.0)], EVENTS)
    orders = spark.createDataFrame([(1, "O", 5.0, dt.datetime(1999, 3, 2))], ORDERS)
    for lines in (scada_feed_lines(events), dispatch_feed_lines(_lineitem(spark), orders)):
        assert "concat_ws" not in _plan(lines.where(F.col("value").contains("D")))


def test_parts_follow_the_number_of_lines(spark, monkeypatch):
    monkeypatch.setattr(segments, "LINES_PER_PART", 10)
    lines = _text_lines(spark, [f"C,{i}" for i in range(400)])
    p = segments.in_pieces(lines, 400)
    assert p.select("piece").distinct().count() > 20
    assert "REPARTITION_BY_NUM" in _plan(p)  # adaptive execution leaves the number alone


def test_header_names_go_to_tasks_as_one_text(spark):
    values = ['I,G,T,1,"A, b",A,B', 'D,G,T,1,"x, y",1,', 'D,G,T,1,"",""2"",3', "D,G,T"]
    out = segments.parse_segments(_text_lines(spark, values), ["A", "A, b", "B", "NONE"])
    rows = {r["line_key"]["pos"]: r for r in out.rows.collect()}
    assert (rows[1]["A, b"], rows[1]["A"], rows[1]["B"], rows[1]["NONE"]) == ("x, y", "1", None, None)
    assert (rows[2]["A, b"], rows[2]["A"], rows[2]["B"]) == (None, '"2"', "3")
    assert out.headers.head()["header"] == ["1", "A, b", "A", "B"]
    assert {r["verdict"] for r in out.lines.where("line_key.pos = 3").collect()} == {segments.SHORT_LINE}


def test_keep_first_carries_the_order_once(spark):
    rows = [("k", 2, "b", 1.0), ("k", 1, "c", 2.0), ("k", 1, "b", None), ("m", None, "z", 3.0), (None, 1, "a", 4.0), (None, 1, "a", 0.0)]
    df = spark.createDataFrame(rows, "k string, o int, v string, w double")
    got = keep_first(df, ["k"], ["o", "v"])
    assert got.columns == ["k", "o", "v", "w"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("k", 1, "b", None), ("m", None, "z", 3.0), (None, 1, "a", 0.0)], key=str)
    assert "p, struct(w, " in _plan(got)


def test_entry_serving_two_days_is_parsed_once(spark, monkeypatch):
    seen = []
    parse = scada.parse_scada
    monkeypatch.setattr(scada, "parse_scada", lambda lines, **kw: seen.append(lines.count()) or parse(lines, **kw))
    values = [
        "I,FPP,FPPMW,1,INTERVAL_DATETIME,MEASUREMENT_DATETIME,DUID,MEASURED_MW,MW_QUALITY_FLAG",
        *[f"D,FPP,FPPMW,1,2025/10/0{d} 10:00:00,2025/10/0{d} 10:00:00,U1,{d},0" for d in (1, 2, 3)],
    ]
    served = spark.createDataFrame(
        [("e", dt.date(2025, 10, 1), (1, "e")), ("e", dt.date(2025, 10, 2), (2, "e"))],
        "entry string, target_date date, entry_order struct<a:int,b:string>",
    )
    got = scada_series(_text_lines(spark, values, entry="e"), served=served).collect()
    assert sorted(r["market_day"].day for r in got) == [1, 2]  # the third day was not asked for
    assert seen == [4]


def _pos_rows(parsed):
    return sorted(((r["file"], tuple(r["line_key"]), r["verdict"], r["segment_key"], r["A"], r["B"]) for r in parsed.lines.collect()), key=str)


def _many_files(spark):
    """Files of two layouts, one rejected, one without a name; keys repeat or are NULL."""
    rows = [
        ("f", 1, "D,G,T,1,early,x"), ("f", 2, "I,G,T,1,A,B"), ("f", 3, "D,G,T,1,a3,b3"), ("f", 3, 'D,G,T,1,"a,3",""'),
        ("f", 5, "I,G,T,2,B,X,A"), ("f", 6, "D,G,T,2,b6,x,a6"), ("f", 7, "D,G,T,2,b7"), ("f", 8, "D,G"), ("f", 9, "Q,G,T,1,z"),
        ("f", 10, "C,end"), ("f", 11, ""), ("f", 12, None), ("f", 13, " d ,G,T,2,b,x,a"),
        ("g", 1, "I,G,T,1,B"), ("g", 2, "D,G,T,1,b2"), ("h", 4, "D,G,T,1,none"),
        (None, None, "D,G,T,1,early"), (None, 1, "I,G,T,1,A"), (None, 2, "D,G,T,1,a2"),
    ]
    df = spark.createDataFrame(rows, "file string, pos long, value string")
    return df.select("file", line_key(0, F.col("pos")).alias("line_key"), "value")


def test_few_headers_are_looked_up_and_no_line_is_shuffled(spark, monkeypatch):
    def never(*args):
        raise AssertionError("lines were sorted by file")

    monkeypatch.setattr(segments, "in_pieces", never)
    out = segments.parse_segments(_many_files(spark), ["A", "B"], require=["A"])
    got = {(r["file"], r["line_key"]["pos"], r["A"], r["B"]): r["verdict"] for r in out.lines.collect()}
    used, headless = segments.USED, segments.HEADLESS
    assert got == {
        ("f", 1, None, None): headless, ("f", 3, "a3", "b3"): used, ("f", 3, "a,3", None): used, ("f", 6, "a6", "b6"): used,
        ("f", 7, None, "b7"): used, ("f", 8, None, None): segments.SHORT_LINE, ("f", 9, None, None): segments.UNKNOWN_TAG,
        ("f", 13, "a", "b"): used, ("g", 2, None, "b2"): segments.REJECTED_FILE, ("h", 4, None, None): headless,
        (None, None, None, None): headless, (None, 2, "a2", None): used,
    }
    heads = {(r["file"], r["segment_key"]["pos"]): (r["header"], r["accepted"], r["reason"]) for r in out.headers.collect()}
    assert heads[("f", 5)] == (["2", "B", "X", "A"], True, None)
    assert heads[("g", 1)] == (["1", "B"], False, segments.REJECTED_FILE)
    assert "Exchange hashpartitioning" not in _plan(out.rows) and out.rows.count() == 6


def test_look_up_and_carry_forward_agree(spark, monkeypatch):
    lines = _many_files(spark).where("file IS NOT NULL")
    looked_up = _pos_rows(segments.parse_segments(lines, ["A", "B"], require=["A"]))
    monkeypatch.setattr(segments, "HEADERS_PER_FILE", 1)  # file f has two
    called = []
    carry = segments._carry_forward
    monkeypatch.setattr(segments, "_carry_forward", lambda *a: called.append(1) or carry(*a))
    assert _pos_rows(segments.parse_segments(lines, ["A", "B"], require=["A"])) == looked_up
    assert called == [1]


def test_market_days_are_derived_once(spark):
    days = archive_queries._market_days(_lineitem(spark))
    assert "Aggregate" not in _plan(days)  # not anew for every use of the targets
    assert sorted(r["target_date"].day for r in days.collect()) == list(range(1, 29))
