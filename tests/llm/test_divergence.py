"""Source divergence against plain loops over whole numbers."""

import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from wattline.llm import divergence as dv
from wattline.llm import queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def loop(rows, least=10, top=10):
    counts, texts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        texts[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, c in texts[lang].items() if c >= least)
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        share = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 2) // (total[s] + 2 * len(kept)) for t in kept} for s in sources}
        whole = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        base = {t: 1 + 10**9 * (whole[t] + 2) // (sum(whole.values()) + 2 * len(kept)) for t in kept}
        for s in sources:
            pairs = [(o, sum((share[s][t] - share[o][t]) ** 2 // (share[s][t] + share[o][t]) for t in kept)) for o in sources - {s}]
            terms = [(t, (share[s][t] - base[t]) ** 2 // (share[s][t] + base[t])) for t in kept
                     if counts[lang, s][t] and share[s][t] > base[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(items[:most], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=3, max_size=3), max_size=40))
def test_pairs_of_run_length_columns(table):
    counts = np.array(table, np.int64).reshape(len(table), 3)
    totals = counts.sum(axis=0).tolist()
    got = {(i, j): v for i, j, v in dv.pair_values(counts, totals, len(table))}
    for i, j in combinations(range(3), 2):
        want = 0
        for row in table:
            p, q = (1 + 10**9 * (row[k] + 2) // (totals[k] + 2 * len(table)) for k in (i, j))
            want += (p - q) ** 2 // (p + q)
        assert got[i, j] == want


def test_query_equals_the_loop(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "source", "text").collect()
    got = rows_of(queries.op12_source_divergence(spark, sf))
    assert got == loop([tuple(d) for d in docs])
    assert {r[2] for r in got} == {"pair", "term"}


def test_many_blocks_and_flushes_give_the_same(spark, monkeypatch):
    """Blocks of a few terms, and counts passed on after a few entries."""
    rows = [("en", f"s{i % 5}", " ".join(f"w{chr(97 + (i * k) % 11)}" for k in range(i % 9))) for i in range(150)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(7)
    monkeypatch.setattr(dv, "BLOCK_CELLS", 12)
    monkeypatch.setattr(dv, "MOST_HELD", 10)
    assert rows_of(dv.divergence(df)) == loop(rows)


def test_odd_rows(spark, odd, none):
    rows = [tuple(r) for r in odd.select("lang", "source", "text").collect()]
    assert rows_of(dv.divergence(odd, least_texts=2)) == loop(rows, least=2)
    assert rows_of(dv.divergence(odd)) == loop(rows)  # no term is kept: pairs of value 0
    assert dv.divergence(none).count() == 0
    # ties in value go by the bytes of the item; a null language and source are groups
    rows = [(None, s, "Éa z éa Z a") for s in (None, "a", "B", "é")] * 3
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert rows_of(dv.divergence(df, least_texts=3)) == loop(rows, least=3)


def test_a_source_with_most_rows_and_large_counts(spark):
    rows = [("en", "hot", "a b c " * 50)] * 300 + [("en", f"s{i}", "a d") for i in range(40)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(9)
    assert rows_of(dv.divergence(df)) == loop(rows)
    # shares are exact where 10^9 * count passes 64 bits
    got = spark.range(1).selectExpr("9000000000000000000L as n", "9100000000000000000L as t", "5L as v").select(dv.share("n", "t", "v")).head()[0]
    assert got == 1 + 10**9 * (9 * 10**18 + 2) // (91 * 10**17 + 10)
