import random

import pytest
import xxhash
from pyspark.sql import functions as F

from wattline.llm import simhash
from wattline.llm.components import components

SF = "/root/testdata/sf0.001"


def brute_print(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, near):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_fingerprints(spark):
    for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect():
        assert simhash.fingerprint(r["text"]) % 2**64 == brute_print(r["text"])
    # the shingle hash is Spark's own xxhash64
    assert spark.sql("select xxhash64('a b c d') h").head()["h"] % 2**64 == xxhash.xxh64_intdigest(b"a b c d", 42)


def check(df):
    rows = df.select("doc_id", "text").collect()
    prints = {r["doc_id"]: brute_print(r["text"]) for r in rows if r["doc_id"] is not None}
    roots = brute_components(sorted(set(prints.values())), lambda a, b: bin(a ^ b).count("1") <= 4)
    least = {}
    for d, p in prints.items():
        least[roots[p]] = min(d, least.get(roots[p], d))
    got = simhash.simhash_groups(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}"
            assert r["component_id"] == least[roots[prints[r["doc_id"]]]]


def test_documents_against_brute_force(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def test_odd_rows(odd):
    check(odd)


def test_empty_table(none):
    assert simhash.simhash_groups(none).count() == 0
    assert simhash.keep_simhash(none).columns == none.columns


@pytest.mark.parametrize("distance", [0, 1, 4, 6])
def test_links_are_all_found(spark, distance):
    rng = random.Random(distance)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints):  # chains of neighbours around each
        for k in range(0, 9, 2):
            prints.add(p ^ sum(1 << b for b in rng.sample(range(64), k)))
    signed = [simhash._signed(p) for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {(r["u"], r["v"]) for r in simhash.links(df, distance).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) % 2**64).count("1") <= distance}
    assert got == want


def test_allocation_is_least_of_all():
    costs = [[1.0, 9.0, 30.0], [2.0, 3.0, 50.0], [0.5, 0.6, 0.7]]
    total, chosen = simhash.allocate(costs, 3)
    options = [
        (sum(costs[g][e] for g, e in enumerate(t) if e >= 0), list(t))
        for t in [(a, b, c) for a in range(-1, 3) for b in range(-1, 3) for c in range(-1, 3)]
        if sum(e + 1 for e in t) == 3
    ]
    assert (total, chosen) == min(options)


def test_every_plan_covers_the_distance():
    import numpy as np

    for n in (10, 10**5, 10**7, 10**9):
        both = np.full((64, 64), n / 4) + np.eye(64) * n / 4
        parts = simhash.plan(n, both, 4)
        assert sum(t + 1 for _, t, _ in parts) == 5
        bits = [b for _, _, g in parts for b in g]
        assert len(bits) == len(set(bits))


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(path + star + [(5, 5)], "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(300))


def test_keep_leaves_one_of_each_group(odd):
    ids = [r["doc_id"] for r in simhash.keep_simhash(odd).select("doc_id").collect()]
    # 1, 2, 3 have equal words; 4, 5, 6 and one row without id have none
    assert sorted(i for i in ids if i is not None) == [1, 4, 7, 8, 9, 10]


def test_texts_that_only_share_an_id_stay(spark):
    rows = [
        (None, "alpha beta gamma delta", "b"), (None, "one two three four", "a"), (None, "One two three four", "a"),
        (None, "red green blue white", "a"), (4, "red green blue white", "a"),
        (5, "north south east west", "a"), (5, "spring summer autumn winter", "b"), (5, "spring summer autumn winter", "a"),
        (6, "spring summer autumn winter", "0"),
    ]
    kept = []
    for n in (1, 5):
        docs = spark.createDataFrame(rows[::-1] if n == 5 else rows, "doc_id long, text string, source string").repartition(n)
        kept.append(sorted(map(tuple, simhash.keep_simhash(docs).collect()), key=str))
    assert kept[0] == kept[1]
    assert sorted(((i, t.lower(), s) for i, t, s in kept[0]), key=str) == sorted([
        (None, "alpha beta gamma delta", "b"), (None, "one two three four", "a"), (4, "red green blue white", "a"),
        (5, "north south east west", "a"), (5, "spring summer autumn winter", "a"),
    ], key=str)
