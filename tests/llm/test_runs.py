"""Periodic runs against a search of every period, and the registered query
against a loop over the planted texts."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wattline.llm import queries
from wattline.llm.runs import find_runs, periodic_runs, runs_of_texts


def brute(words, least=12):
    """Runs of one text: for each period, the maximal stretches of equal words."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, 2 * q):
                best.setdefault((i, length), q)
            i = j
    return sorted((s, length, q) for (s, length), q in best.items())


def found(texts, least=12):
    words = np.array([w for t in texts for w in t], np.int64)
    ends = np.cumsum([len(t) for t in texts]) if texts else np.zeros(0, np.int64)
    begins = [0, *ends.tolist()]
    out = [[] for _ in texts]
    for t, s, length, q in zip(*(x.tolist() for x in find_runs(words, ends, least))):
        out[t].append((s - begins[t], length, q))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=5), st.sampled_from([2, 3, 5, 8, 12, 16]))
def test_every_run_of_small_alphabets(texts, least):
    assert [sorted(x) for x in found(texts, least)] == [brute(t, least) for t in texts]


def test_planted_runs_of_any_period():
    rng = random.Random(5)
    texts = []
    for q in [1, 2, 3, 4, 5, 6, 7, 11, 12, 40]:
        for extra in (0, 1, q - 1, 3 * q):
            body = [rng.randrange(1000) for _ in range(q)]
            texts.append([rng.randrange(30) for _ in range(25)] + [body[i % q] for i in range(max(12, 2 * q) + extra)] + [2000])
    assert [sorted(x) for x in found(texts)] == [brute(t) for t in texts]


@pytest.mark.parametrize("shape", ["one word", "two words", "fibonacci", "copies"])
def test_long_repetitive_texts(shape):
    if shape == "one word":
        text = [0] * 400
    elif shape == "two words":
        text = [0, 1] * 300
    elif shape == "fibonacci":
        a, b = [0], [0, 1]
        while len(b) < 400:
            a, b = b, b + a
        text = b
    else:
        part = list(range(50)) + [7] * 20
        text = part * 6
    assert [sorted(x) for x in found([text, text])] == [brute(text)] * 2


def test_unary_text_grows_no_faster_than_n_log_n():
    runs = found([[0] * 300_000])
    assert runs == [[(0, 300_000, 1)]]


def test_collapsed_text_and_edges():
    texts = [b"", b" \n\t", b"a\xc2\xa0b x", b"k " * 30 + b"z", None]
    got = runs_of_texts(texts).to_pylist()
    assert [g["n_words"] for g in got] == [0, 0, 2, 31, 0]
    assert got[3] == {"n_words": 31, "runs": [{"start": 0, "length": 30, "period": 1}], "collapsed": b"k z"}
    assert got[2]["collapsed"] == "a b x".encode() and not got[2]["runs"]


def planted(doc_id, text):
    words = text.encode().split() if text else []
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def expected(doc_id, text):
    words = planted(doc_id, text)
    runs = sorted(((s, q, length) for s, length, q in brute(words)))
    drop = {k for s, q, length in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[2], r[0], r[1]), default=None)
    digest = "".join(f"{s},{length},{q}\n" for s, q, length in runs)
    kept = b" ".join(w for k, w in enumerate(words) if k not in drop)
    return (
        doc_id, len(runs), *((best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4),
        hashlib.sha256(digest.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def _rows(df):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=key)


def test_query_over_odd_rows_and_planted_texts(spark, odd, none, tmp_path):
    rng = random.Random(3)
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    rows = [(i, " ".join(rng.choice(["a", "b", "cc", "é", "dd"]) for _ in range(rng.randrange(1, 90))), "en", "s", 1) for i in ids + [1, 2]]
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(rows, SCHEMA))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = _rows(queries.op11_periodic_runs(spark, str(tmp_path)))
    key = lambda r: tuple((x is not None, x) for x in r)
    want = sorted((expected(r.doc_id, r.text) for r in docs.filter("length(text) < 5000 or text is null").collect()), key=key)
    assert [r for r in got if r[0] != 7] == want
    long = next(r for r in got if r[0] == 7)
    assert long[1] == 0  # its 12,000 words never come back after one period
    assert sum(r[1] for r in got) > 10
    empty = periodic_runs(none)
    assert empty.columns == ["row", "n_words", "runs", "collapsed"] and empty.count() == 0
    assert periodic_runs(odd).select("row.row", "runs").count() == odd.count()


def test_query_equals_the_loop_on_the_smallest_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r[0]: r for r in _rows(queries.op11_periodic_runs(spark, sf))}
    short = [d for d in docs if len(d.text or "") < 6000]
    assert len(got) == len(docs) and len(short) > 100
    for d in short:
        assert got[d.doc_id] == expected(d.doc_id, d.text), d.doc_id
