import math
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from wattline.llm.quality_rules import bucket, quality_rules

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def grams(text):
    words = WORD.findall(text or "")
    return [(w,) for w in words] + list(zip(words, words[1:]))


def check(spark, docs, trusted, buckets=64, threshold=-0.05):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    good = {r["doc_id"] for r in trusted.collect()} - {None}
    every = sorted({g for _, t in rows for g in grams(t)})
    table = spark.createDataFrame([(list(g),) for g in every] or [(["x"],)], "g array<string>")
    one, two = bucket(F.col("g")[0], buckets=buckets), bucket(F.col("g")[0], F.get("g", F.lit(1)), buckets=buckets)
    of = {tuple(r["g"]): r["b"] for r in table.select("g", F.when(F.size("g") == 1, one).otherwise(two).alias("b")).collect()}
    raw, target = [1] * buckets, [1] * buckets
    for d, t in rows:
        for g in grams(t):
            raw[of[g]] += 1
            target[of[g]] += d in good
    ratio = [math.log(a / sum(target)) - math.log(b / sum(raw)) for a, b in zip(target, raw)]
    want = []
    for d, t in rows:
        n, *rest = counts(t)
        llr = sum(ratio[of[g]] for g in grams(t)) / max(1, len(grams(t)))
        failed = n < 10 or 100 * rest[-1] > 20 * n
        want.append((d, n, *rest, failed, not failed and llr >= threshold, round(llr, 9)))
    got = quality_rules(docs, trusted, buckets=buckets, threshold=threshold).collect()
    got = [(*tuple(r)[:-1], round(r["llr"], 9)) for r in got]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_documents_against_brute_force(spark):
    trusted = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1 and toxic = 0").select("doc_id")
    check(spark, spark.read.parquet(f"{SF}/documents.parquet"), trusted)


def test_odd_rows(spark, odd):
    check(spark, odd, spark.createDataFrame([(1,), (1,), (7,), (None,), (99,)], "doc_id long"))


def test_empty_tables(spark, odd, none):
    nobody = spark.createDataFrame([], "doc_id long")
    assert quality_rules(none, nobody).count() == 0
    assert quality_rules(odd, nobody).count() == odd.count()


@pytest.mark.parametrize("text", ["a b c d e " * 40, "x " * 30, "p q r s t u p q r s t", "a b c d e f a b c d e g a b c d e"])
def test_repeated_words(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = quality_rules(docs, spark.createDataFrame([], "doc_id long")).head()
    assert got["n_repeat_words"] == counts(text)[-1]


def test_plan_is_native(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = quality_rules(docs, docs.select("doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
