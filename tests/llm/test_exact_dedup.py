import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from wattline.llm import exact_dedup as module
from wattline.llm.exact_dedup import exact_dedup, keep_exact

SF = "/root/testdata/sf0.001"


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0d]", "", text or "")].append((doc_id, text or ""))
    out = {}
    for content, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        for doc_id, text in members:
            out[doc_id, text] = (keep, len(members), doc_id == keep, hashlib.sha256(content.encode()).hexdigest())
    return out


def check(df, **options):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    want = sorted(map(str, [(d, *brute(rows)[d, t or ""]) for d, t in rows]))
    got = exact_dedup(df, **options).collect()
    assert sorted(map(str, map(tuple, got))) == want


def test_documents_against_brute_force(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def test_odd_rows(odd):
    check(odd.select("doc_id", "text", "row", "key"))


def test_contents_that_share_a_digest_stay_apart(spark, odd):
    weak = lambda c: F.unhex(F.substring(F.sha2(c.cast("binary"), 256), 1, 1).cast("string"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup(docs).collect()}
    b = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup(docs, digest=weak).collect()}
    assert a == b


def test_one_hot_group_over_many_partitions(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "if(id % 3 = 0, 'the same text', concat('text ', id)) as text").repartition(40)
    out = exact_dedup(docs)
    assert out.filter("kept").count() == 1 + 4000 - 1334
    assert out.filter("group_size = 1334").select("keep_id").distinct().collect()[0][0] == 0


def test_only_groups_that_rows_look_up_are_landed_in_few_files(spark, monkeypatch):
    landed, land = [], module.land
    monkeypatch.setattr(module, "land", lambda *a: landed.append(land(*a)) or landed[-1])
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.parallelismFirst")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        docs = spark.range(4000).selectExpr("id as doc_id", "concat('text ', id % 3990, repeat(' and its words', 20)) as text")
        out = exact_dedup(docs.repartition(8)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", before)
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert sum(r["kept"] for r in out) == 3990 and sum(r["group_size"] for r in out) == 3980 + 20 * 2
    assert [(g.count(), len(g.inputFiles())) for g in landed] == [(10, 1)]


def test_empty_table(none):
    assert exact_dedup(none).count() == 0
    assert keep_exact(none).columns == none.columns


def test_keep_returns_all_columns_and_one_row_each(odd):
    kept = keep_exact(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    # copies of 1; 4, 5 and the row without id are as long as each other, 6 is longer
    assert sorted(ids, key=lambda x: (x is None, x)) == [2, 6, 7, 8, 9, 10, None]


def test_texts_that_only_share_an_id_stay(spark):
    rows = [
        (None, "first text", "b"), (None, "second text", "a"), (None, "second  text", "a"), (None, "second text", "b"),
        (5, "third text", "a"), (5, "fourth text", "a"), (5, "fourth text", "b"), (5, "fourth text", "a"), (6, "fourth text", "0"),
    ]
    want = [(None, "first text", "b"), (None, "second  text", "a"), (5, "fourth text", "a"), (5, "third text", "a")]
    for n in (1, 5):
        docs = spark.createDataFrame(rows[::-1] if n == 5 else rows, "doc_id long, text string, source string").repartition(n)
        assert sorted(map(tuple, keep_exact(docs).collect()), key=str) == sorted(want, key=str)
