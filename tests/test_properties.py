"""Property tests (Hypothesis) and order invariance."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feed_files import write_text
from wattline.operators.asof import asof_topk
from wattline.operators.dedup import keep_first
from wattline.plans.scada import scada_series
from wattline.sources.lines import read_lines

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

rows_st = st.lists(
    st.tuples(st.integers(0, 4), st.integers(0, 3), st.integers(0, 50), st.one_of(st.none(), st.floats(-5, 5))),
    min_size=1, max_size=40,
)


@SETTINGS
@given(rows=rows_st)
def test_keep_first_matches_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "k1 int, k2 int, o int, v double")
    got = sorted(tuple(r) for r in keep_first(df, ["k1", "k2"], ["o", "v"]).select("k1", "k2", "o", "v").collect())
    best = {}
    for k1, k2, o, v in rows:
        key = (o, (v is not None, v if v is not None else 0.0))  # NULLs first
        if (k1, k2) not in best or key < best[(k1, k2)][0]:
            best[(k1, k2)] = (key, (k1, k2, o, v))
    assert got == sorted(b[1] for b in best.values())


@SETTINGS
@given(
    right=st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 30), st.text("xyz", min_size=1, max_size=3)),
                   min_size=1, max_size=25, unique=True),
    left=st.lists(st.tuples(st.sampled_from("abc"), st.integers(-3, 35)), min_size=1, max_size=25),
    k=st.integers(1, 4),
)
def test_asof_topk_matches_brute_force(spark, right, left, k):
    rdf = spark.createDataFrame(right, "g string, t int, name string")
    ldf = spark.createDataFrame([(i, g, t) for i, (g, t) in enumerate(left)], "id int, g string, at int")
    out = asof_topk(ldf, rdf, by=["g"], left_on="at", right_on="t", tiebreak=["name"], k=k)
    got = sorted((r["id"], r["asof_rank"], r["right_name"]) for r in out.collect())
    expect = []
    for i, (g, at) in enumerate(left):
        cands = sorted([(t, n) for gg, t, n in right if gg == g and t <= at], reverse=True)[:k]
        expect += [(i, j + 1, n) for j, (_, n) in enumerate(cands)]
    assert got == sorted(expect)


HDR = "I,FPP,FPPMW,1,INTERVAL_DATETIME,MEASUREMENT_DATETIME,DUID,MEASURED_MW,MW_QUALITY_FLAG\n"


def test_explicit_file_order_beats_name_order(spark, tmpdir_path):
    write_text(tmpdir_path, "f/A.CSV", HDR + 'D,FPP,FPPMW,1,"2025/06/01 05:00:00","2025/06/01 05:00:00",U1,1,0\n')
    write_text(tmpdir_path, "f/B.CSV", HDR + 'D,FPP,FPPMW,1,"2025/06/01 05:00:00","2025/06/01 05:00:00",U1,2,0\n')
    lines = read_lines(spark, f"{tmpdir_path}/f")
    by_name = scada_series(lines).collect()
    assert [r["measured_mw"] for r in by_name] == [1.0]
    ranked = lines.withColumn("rank", F.when(F.col("file").endswith("B.CSV"), 0).otherwise(1))
    by_rank = scada_series(ranked, file_order="rank").collect()
    assert [r["measured_mw"] for r in by_rank] == [2.0]
    assert by_rank[0]["market_day"] == dt.date(2025, 6, 1)
