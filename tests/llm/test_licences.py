"""Licence scans: phrases and matching statistics against plain searches."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wattline.llm import licences as lc
from wattline.llm import queries

WORDS = [b"a", b"b", b"c"]
TEXTS = [("x", "a b c a b a c"), ("y", "b b a c c a"), ("x", "c a"), ("z", "a b c a b b")]
OWN = {"a b": "ab", "b a c": "bac", "c c c": "ccc"}


def longest(text, i):
    """Longest match of any template or phrase that ends with word ``i``."""
    known = [lc.words_of(t.encode()) for _, t in TEXTS] + [p.encode().split() for p in OWN]
    for n in range(i + 1, 0, -1):
        part = text[i + 1 - n : i + 1]
        if any(k[a : a + n] == part for k in known for a in range(len(k))):
            return n
    return 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*WORDS, b"other"]), max_size=30))
def test_statistics_and_phrases_of_any_text(text):
    auto = lc.Automaton(TEXTS, OWN, least=3)
    numbers = [auto.number.get(w, 0) for w in text]
    assert [n for _, n in auto.statistics(numbers)] == [longest(text, i) for i in range(len(text))]
    places, spans = auto.scan(np.array(numbers, np.int64))
    want = sorted((i, k) for k, p in enumerate(OWN) for i in range(len(text)) if text[i : i + len(p.split())] == p.encode().split())
    assert places == want
    for s in spans:  # no more words than there are, in the text or in the template
        assert 0 < s.covered <= min(s.end - s.start, len(auto.texts[s.template]))
    whole = [(t, i) for t, (_, x) in enumerate(TEXTS) for i in range(len(text)) if text[i : i + len(x.split())] == x.encode().split()]
    for t, i in whole:  # an exact copy of a template lies in a span that covers it all
        assert any(s.template == t and s.start <= i < s.end for s in spans)


def _scan(text, **kw):
    auto = lc.Automaton(lc.templates(), lc.PHRASES, **kw)
    words = lc.words_of(text.encode())
    places, spans = auto.scan(np.array([auto.number.get(w, 0) for w in words], np.int64))
    return words, places, [(auto.labels[s.template], s.covered / len(auto.texts[s.template]), s) for s in spans]


@pytest.mark.parametrize("label", sorted({*lc.NOTICES, *lc.PASSAGES}))
def test_every_label_is_found_in_prose_and_after_small_edits(label):
    rng = random.Random(label)
    for t_label, text in lc.templates():
        if t_label != label:
            continue
        _, _, spans = _scan(f"The old text of the house {text} and more of that in the end")
        assert any(x == label and share == 1.0 for x, share, _ in spans), text
        words = text.split()
        if len(words) >= 20:  # one word is changed, two are put in
            k = rng.randrange(8, len(words) - 8)
            changed = " ".join([*words[:k], "changed", *words[k + 1 : k + 3], "very", "new", *words[k + 3 :]])
            _, _, spans = _scan(changed)
            assert any(x == label and share >= 0.8 for x, share, _ in spans), changed


def test_prose_with_licence_words_is_left_alone():
    text = "the copy of the software and the rights to use the work under the law of the land, subject to the conditions " * 50
    _, places, spans = _scan(text)
    assert not places and not [s for s in spans if s[1] >= 0.8]


def test_query_over_odd_rows(spark, odd, none, tmp_path):
    marked = "Licensed under CC BY-NC 4.0. " * 3 + "x ALL RIGHTS reserved. cc by cc by"
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    more = [(50, marked, "en", "s", 1), (51, "General Public\nLicense", None, None, None), (52, "cc", "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in queries.op13_licence_scan(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[3]) == 2 and len(got[None]) == 2 and sum(map(len, got.values())) == docs.count()
    for r in docs.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        places = [(i, v) for p, v in lc.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        base = ",".join(sorted({v for _, v in places}))
        mine = [(g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) for g in got[r.doc_id]]
        assert (len(words), len(places), min(starts, default=None), max(starts, default=None), base) in mine
    assert got[50][0].labels == "cc-by,cc-by-nc,reserved" and got[50][0].score == 1.0
    assert len([s for s in got[50][0].spans if s.label == "cc-by-nc"]) == 3
    assert got[51][0].labels == "gpl" and got[51][0].score == 0.0
    assert got[4][0].labels == "" and got[4][0].n_words == 0
    assert lc.licence_spans(none, lc.templates()).count() == 0


def test_query_equals_a_plain_search_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op13_licence_scan(spark, sf).collect()}
    found = 0
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = lc.words_of((d.text or "").encode())
        joined = b" " + b" ".join(words) + b" "
        places = sorted(joined[: m.start()].count(b" ") for p in lc.PHRASES for m in re.finditer(b"(?= " + p.encode() + b" )", joined))
        r = got[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), *((places[0], places[-1]) if places else (None, None)))
        found += len(places)
        if b" licensed under the apache license version 2 0 " in joined:
            assert "apache" in r.labels.split(",")
    assert found > 10
