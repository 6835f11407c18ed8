"""Header carry-forward: pieces of files, verdicts, order."""

import random

import pytest
from pyspark.sql import functions as F

from feed_files import write_text
from wattline.operators.segments import parse_segments, rejects
from wattline.plans.scada import parse_scada
from wattline.sources.lines import lines_from_frame, line_key, read_lines

COLUMNS = ["A", "B"]


def _feed(rng, n):
    """Lines and what becomes of them: headers of changing layout far apart."""
    lines, want, header = [], [], None
    for i in range(n):
        x = rng.random()
        if x < 0.01 or i == n // 2:
            header = rng.choice([["A", "B"], ["B", "X", "A"], ["A"]])
            lines.append("I,G,T,1," + ",".join(header))
        elif x < 0.02:
            lines.append("C,a comment")
        elif x < 0.03:
            lines.append(rng.choice(["D,G", "I,G,T"]))
            want.append(("short line", None, None))
        elif x < 0.04:
            lines.append("Q,G,T,1,a")
            want.append(("unknown tag", None, None))
        elif x < 0.05:
            lines.append("")
        else:
            lines.append(f"D,G,T,1,{i},{i + 1},{i + 2}")
            if header is None:
                want.append(("data line before any header", None, None))
            else:
                cell = {c: str(i + k) for k, c in enumerate(header)}
                want.append(("used", cell.get("A"), cell.get("B")))
    return lines, want


def test_files_cut_into_many_pieces(spark, tmpdir_path):
    """Splits far smaller than a segment: headers come from pieces before."""
    rng = random.Random(3)
    feeds = {f"f{k}.CSV": _feed(rng, n) for k, n in enumerate([5000, 700, 40, 1])}
    for name, (lines, _) in feeds.items():
        write_text(tmpdir_path, f"feed/{name}", "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        lines = read_lines(spark, f"{tmpdir_path}/feed")
        assert lines.rdd.getNumPartitions() > 20
        got = parse_segments(lines, COLUMNS).lines.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name, (_, want) in feeds.items():
        mine = sorted((r for r in got if r["file"].endswith(name)), key=lambda r: r["line_key"])
        assert [(r["verdict"], r["A"], r["B"]) for r in mine] == want


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_lines_in_no_order(spark, parts):
    """Lines of a table are range-partitioned; one file spans many parts."""
    rng = random.Random(parts)
    lines, want = _feed(rng, 3000)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "pos long, value string").orderBy(F.rand(1))
    frame = lines_from_frame(df, F.lit("one"), line_key(0, F.col("pos")), "value")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = parse_segments(frame, COLUMNS).lines.orderBy("line_key").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [(r["verdict"], r["A"], r["B"]) for r in got] == want


def test_lines_out_of_order_are_an_error(spark):
    rows = [("f", 2, "D,G,T,1,a,b"), ("f", 1, "I,G,T,1,A,B")]
    df = spark.createDataFrame(rows, "file string, pos long, value string").coalesce(1)
    lines = lines_from_frame(df, "file", line_key(0, F.col("pos")), "value").withColumn("piece", F.lit("0"))
    with pytest.raises(Exception, match="not in order"):
        parse_segments(lines, COLUMNS)


def test_totals_are_observed_in_passing(spark, tmpdir_path):
    head = "I,FPP,FPPMW,1,INTERVAL_DATETIME,MEASUREMENT_DATETIME,DUID,MEASURED_MW,MW_QUALITY_FLAG\n"
    row = 'D,FPP,FPPMW,1,"2025/06/01 05:00:00","{}",U1,1,0\n'
    good = row.format("2025/06/01 05:00:00")
    write_text(tmpdir_path, "v/a.CSV", good + head + good * 3 + row.format("noon") + "D,x\n" + "Z,1,2,3,4\n\nC,end\n")
    write_text(tmpdir_path, "v/b.CSV", head.replace("MEASURED_MW", "MW") + good * 2)
    write_text(tmpdir_path, "v/empty.CSV", "")
    parsed = parse_scada(read_lines(spark, f"{tmpdir_path}/v"))
    rows, totals = parsed.observed()
    assert rows.count() == 4  # three used, one without a valid time
    assert totals.get == {
        "lines": 9, "used": 3, "data line before any header": 1, "missing required columns": 2, "short line": 1,
        "unknown tag": 1, "unparsed time": 1,
    }
    reasons = [r["reason"] for r in rejects(parsed).collect()]
    assert len(reasons) == 6 and reasons.count("missing required columns") == 2
    assert {(r["file"][-5:], r["accepted"]) for r in parsed.headers.collect()} == {("a.CSV", True), ("b.CSV", False)}
    nothing = parse_scada(read_lines(spark, f"{tmpdir_path}/v").limit(0))
    assert nothing.rows.count() == 0 and nothing.headers.count() == 0


def test_the_text_is_read_once(spark, tmpdir_path):
    write_text(tmpdir_path, "t/a.CSV", "I,G,T,1,A,B\nD,G,T,1,1,2\n")
    rows = parse_segments(read_lines(spark, f"{tmpdir_path}/t"), COLUMNS, require=["A"]).rows
    plan = rows._jdf.queryExecution().executedPlan().toString()
    scans = [p.split("ReadSchema:")[1] for p in plan.split("FileScan")[1:]]
    assert sum("value:string" in p.splitlines()[0] for p in scans) == 1
    assert "NestedLoop" not in plan and "Cartesian" not in plan
