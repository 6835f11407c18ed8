import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.llm import hpylm
from wattline.llm.common import fold

SF = "/root/testdata/sf0.001"


def score(df, train, **options):
    return hpylm.score_documents(df, train, **options).collect()


def check_counts(rows, texts, held):
    words = {d: [*hpylm.words_of(t), hpylm._TEXT_END] for d, t in texts.items()}
    seen = Counter(w for d, ws in words.items() if not held(d) for w in ws)
    n, v = sum(seen.values()), len(seen)
    for r in rows:
        ws = words[r["doc_id"]]
        assert r["held_out"] == held(r["doc_id"])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(seen[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in ws))


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = score(docs, fold("doc_id", 7) != 2, block_bytes=1 << 17)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    import zlib

    check_counts(rows, texts, lambda d: zlib.crc32(str(d).encode()) % 7 == 2)
    held = [r for r in rows if r["held_out"]]
    letters = sum(len(b" ".join(hpylm.words_of(texts[r["doc_id"]]))) + 2 for r in held)
    # far better than the uniform base, 2.41 a letter
    assert -sum(r["score"] for r in held) / letters < 1.0


def test_blocks_do_not_change_the_counts_and_hardly_the_score(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60")
    a = {r["doc_id"]: r for r in score(docs, F.lit(True), block_bytes=1 << 14)}
    b = {r["doc_id"]: r for r in score(docs, F.lit(True))}
    for d in a:
        assert a[d]["base_score"] == pytest.approx(b[d]["base_score"])
        assert a[d]["score"] == pytest.approx(b[d]["score"], rel=0.1)  # other random draws
    assert sum(r["score"] for r in a.values()) == pytest.approx(sum(r["score"] for r in b.values()), rel=0.01)


def test_odd_rows(spark, odd, none):
    rows = score(odd, F.col("doc_id") > 1)
    assert len(rows) == odd.count()
    empty = {r["score"] for r in rows if r["n_tokens"] == 1}
    assert len(empty) == 1 and all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert all(r["held_out"] for r in rows if r["doc_id"] in (1, None))
    assert score(none, F.lit(True)) == []


def test_without_training_text_the_base_is_left(odd):
    for r in score(odd.filter("doc_id in (4, 10)"), F.lit(False)):
        letters = 1 if r["doc_id"] == 4 else len(b"one two three") + 2
        assert r["score"] == pytest.approx(letters * math.log10(hpylm.BASE), rel=1e-5)
        assert (r["n_known"], r["train_tokens"], r["base_score"]) == (0, 0, 0.0)


def test_ngrams():
    keys, lengths = hpylm.ngrams([[b"ab"], []])
    assert lengths.tolist() == [4, 1]  # a b space line feed; line feed
    assert [int(k) & 255 for k in keys] == [*b"ab \n", *b"\n"]
    assert [(int(k) >> 8) & 255 for k in keys] == [10, *b"ab ", 10]


def test_keys_counted_and_looked_up():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 48, 150_000, dtype=np.uint64)
    keys[rng.integers(0, len(keys), 90_000)] = keys[:90_000]
    train = rng.random(len(keys)) < 0.4
    distinct, counts = hpylm.distinct_counts(keys, train)
    assert (distinct == np.unique(keys)).all() and counts.sum() == train.sum()
    seen, n = np.unique(keys[train], return_counts=True)
    assert (counts[np.searchsorted(distinct, seen)] == n).all()
    values = rng.random(len(distinct))
    assert (hpylm.looked_up(keys, distinct, values) == values[np.searchsorted(distinct, keys)]).all()
    assert len(hpylm.looked_up(keys[:0], distinct, values)) == 0


def test_keys_summed_by_text():
    rng = np.random.default_rng(3)
    lengths = np.concatenate((rng.integers(1, 40, 300), np.ones(1 << 16, np.int64), [70_000]))
    keys = rng.integers(0, 1 << 48, 5000, dtype=np.uint64)[rng.integers(0, 5000, lengths.sum())]
    distinct = np.unique(keys)
    values = -rng.random(len(distinct))
    want = np.add.reduceat(values[np.searchsorted(distinct, keys)], np.cumsum(lengths) - lengths)
    assert np.allclose(hpylm.summed_by_text(keys, lengths, distinct, values), want)
    assert len(hpylm.summed_by_text(keys[:0], lengths[:0], distinct, values)) == 0


def test_tokens_are_told_apart():
    """Words of up to 600 bytes, zeros and prefixes of each other among them, and the ends."""
    long = bytes(range(33, 120)) * 7
    words = [long[:n] for n in range(1, 600)] + [b"a" * n for n in range(1, 300)] + [b"a" + bytes(n) for n in range(1, 20)]
    words += [b"x" * n + b"y" + b"x" * (300 - n) for n in range(0, 300, 7)]
    hashes, lengths = hpylm.tokens([words, [], words[::-1], [b"x"]])
    assert lengths.tolist() == [len(words) + 1, 1, len(words) + 1, 2]
    ends = np.cumsum(lengths) - 1
    assert len(set(hashes[ends].tolist())) == 1 and len(set(hashes.tolist())) == len(set(words)) + 2
    assert hashes[: len(words)].tolist() == hashes[ends[2] - len(words) : ends[2]][::-1].tolist()
    assert [len(x) for x in hpylm.tokens([])] == [0, 0]


def test_a_draw_weighs_no_dish_whose_end_is_found(monkeypatch):
    """One dish of many customers does not make the others take as many steps."""
    weighed, arccos = [], np.arccos
    monkeypatch.setattr(np, "arccos", lambda x: weighed.append(np.size(x)) or arccos(x))
    n = 5000
    customers = np.append(np.full(n, 70), 10**7)
    hpylm.stirling(0.5).draw(customers, np.full(n + 1, -1.0), np.random.default_rng(0))
    assert sum(weighed) < 60 * n


def tree(seed=1, n=4000):
    rng = np.random.default_rng(seed)
    text = bytes(rng.choice(list(b"abc \n"), n, p=[0.5, 0.2, 0.1, 0.15, 0.05]).tolist())
    keys, _ = hpylm.ngrams([text.split()])
    distinct, counts = np.unique(keys, return_counts=True)
    return hpylm.Subtree.first(distinct, counts, [0.5] * hpylm.ORDER), distinct, counts


def test_seating_stays_consistent():
    subtree, keys, counts = tree()
    house, rng = hpylm.SharedRestaurants(), np.random.default_rng(3)
    for _ in range(3):
        customers = np.zeros(1 << 16, np.int64)
        at, n = subtree.to_shared()
        customers[at] = n
        shared = house.sample(customers, [0.5] * hpylm.ORDER, rng)
        assert (house.one.seats.customers() == customers).all()
        subtree.sweep(shared, rng)
        assert (subtree.levels[0].seats.customers() == counts).all()
        for i, level in enumerate(subtree.levels):
            t, c = level.seats.tables(), level.seats.customers()
            assert (t >= 1).all() and (t <= c).all()
            if i:
                above = np.bincount(subtree.parents[i - 1], weights=subtree.levels[i - 1].seats.tables())
                assert (above == c).all()
    back = hpylm.Subtree.unpacked(subtree.packed(), [0.5] * hpylm.ORDER)
    assert np.allclose(back.predict(keys, shared), subtree.predict(keys, shared))
    # the restaurants' own dishes have the probabilities that look-ups give
    own = subtree.levels[0].predictive(subtree.predictives(shared)[0])
    assert np.allclose(own, subtree.predict(keys, shared))


def test_each_context_is_a_distribution():
    subtree, keys, _ = tree(2)
    house, rng = hpylm.SharedRestaurants(), np.random.default_rng(5)
    customers = np.zeros(1 << 16, np.int64)
    at, n = subtree.to_shared()
    customers[at] = n
    shared = house.sample(customers, [0.5] * hpylm.ORDER, rng)
    subtree.sweep(shared, rng)
    customers[:] = 0
    at, n = subtree.to_shared()
    customers[at] = n
    shared = house.sample(customers, [0.5] * hpylm.ORDER, rng)
    for context in {int(k) >> 8 for k in keys[:50]} | {0x7A7A7A7A7A}:
        every = np.array([context << 8 | s for s in range(256)], np.uint64)
        assert 0.98 < subtree.predict(every, shared).sum() <= 1.0 + 1e-9


def test_gibbs_finds_the_number_of_tables():
    """Against the expected number of tables of one restaurant with one dish:
    enumerated exactly for a small number of customers."""
    d, s, p, n = 0.5, 1.0, 0.3, 6
    weight = {1: 1.0}  # tables -> weight of all seatings of the customers so far
    for c in range(1, n):
        nxt = Counter()
        for t, w in weight.items():
            nxt[t] += w * (c - d * t)
            nxt[t + 1] += w * (s + d * t) * p
        weight = nxt
    want = sum(t * w for t, w in weight.items()) / sum(weight.values())
    rng = np.random.default_rng(0)
    levels = [hpylm.Level(1, np.array([i << 8], np.uint64), hpylm.Seats.one_table_each(np.array([n])), d, s) for i in range(1)]
    total, kept = 0, 0
    for i in range(6000):
        levels[0].sweep(np.array([p]), rng)
        if i > 200:
            total += int(levels[0].seats.tables()[0])
            kept += 1
    assert total / kept == pytest.approx(want, rel=0.05)


@pytest.mark.parametrize("discount, p", [(0.5, 0.99), (0.8, 0.9), (0.8, 0.999)])
def test_frequent_dishes_get_their_tables_in_the_production_sweeps(discount, p):
    """Dishes of many customers, alone in their restaurants, against the exact
    distribution of their tables: by recurrence over the customers."""
    n, most, copies = 10_000, 6000, 400
    t = np.arange(1, most + 1)
    weight = np.zeros(most)
    weight[0] = 1.0
    for c in range(1, n):
        grown = weight * (c - discount * t)
        grown[1:] += (weight * (1.0 + discount * t) * p)[:-1]
        weight = grown / grown.sum()
    want = float((t * weight).sum())
    spread = math.sqrt(float((t * t * weight).sum()) - want**2)
    assert weight[-1] < 1e-12
    level = hpylm.Level(
        1, np.arange(copies, dtype=np.uint64) << np.uint64(8), hpylm.Seats.one_table_each(np.full(copies, n)), discount, 1.0
    )
    rng = np.random.default_rng(4)
    for _ in range(hpylm.SWEEPS):
        level.sweep(np.full(copies, p), rng)
    tables = level.seats.tables()
    assert tables.mean() == pytest.approx(want, abs=4 * spread / math.sqrt(copies) + 0.01 * want)
    assert tables.std() == pytest.approx(spread, rel=0.2)


@pytest.mark.parametrize("discount", [0.1, 0.5, 0.9])
def test_stirling_numbers(discount):
    """Ratios of neighbours, interpolated, against the recurrence."""
    n = 3000
    t = np.arange(1, n + 1)
    row = np.where(t == 1, 0.0, -np.inf)
    for c in range(1, n):
        stay = np.where(t <= c, np.log(np.maximum(c - discount * t, 1e-300)), 0.0) + row
        row = np.logaddexp(stay, np.concatenate(([-np.inf], row[:-1])))
    got = hpylm.stirling(discount).log_weight(np.full(n, n), t)
    want, got = np.diff(row)[: n * 9 // 10], np.diff(got)[: n * 9 // 10]
    assert np.abs(want - got).max() < 0.02


def test_tables_grow_with_a_million_customers():
    n = np.array([10**4, 10**6, 10**8])
    level = hpylm.Level(1, np.arange(3, dtype=np.uint64) << np.uint64(8), hpylm.Seats.one_table_each(n), 0.8, 1.0)
    for _ in range(hpylm.SWEEPS):
        level.sweep(np.full(3, 1.0 - 1e-12), np.random.default_rng(1))
    few, more, most = level.seats.tables()
    # as the power 0.8 of the count: 39.8 times for a hundred times the customers
    assert 10 < more / few < 160 and 10 < most / more < 160


def test_words_of_more_than_32_bits_of_occurrences(spark):
    key, count = np.array([12345], "<u8").tobytes(), np.array([2**32 - 1], "<u4").tobytes()
    requests = spark.createDataFrame([(hpylm._WORDS, 3, b, key, count) for b in range(3)], hpylm._PARTS)
    combined = hpylm._combined(requests, 4, 2)
    for r in hpylm._answers(requests, hpylm._predicted(combined, [], [0.5] * hpylm.ORDER), 4).collect():
        assert np.frombuffer(r["values"], "<u8").tolist() == [3 * (2**32 - 1)]


def test_ngrams_of_more_than_32_bits_of_occurrences(spark):
    """Counts stay whole when blocks are combined and when customers are seated."""
    key, count = np.array([0x0A0A0A0A0A61], "<u8").tobytes(), np.array([2**31], "<u4").tobytes()
    requests = spark.createDataFrame([(hpylm._NGRAMS, 3, b, key, count) for b in range(6)], hpylm._PARTS)
    combined = hpylm._combined(requests, 4, 1)
    blob = hpylm._first_seats(combined, [0.5] * hpylm.ORDER).filter("level = -1").head()["state"]
    tree = hpylm.Subtree.unpacked(blob, [0.5] * hpylm.ORDER)
    assert tree.levels[0].seats.customers().tolist() == [6 * 2**31]


def test_copies_of_one_row_are_spread_over_blocks(spark):
    """Rows without id and text, and copies of one row, from all partitions."""
    rows = [(None, None)] * 2000 + [(7, "the same words again")] * 2000
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8).cache()
    got = score(df, F.lit(True), block_bytes=1 << 12)
    assert len(got) == 4000 and len({(r["doc_id"], r["score"]) for r in got}) == 2
    assert {r["train_tokens"] for r in got} == {2000 * 1 + 2000 * 5}


def brute_probability(corpus, discounts, strength):
    """Predictive probability by a plain recursion over one-table seatings:
    the start of the sampler, before any sweep."""
    seats = {}
    for text in corpus:
        raw = bytes([10]) * (hpylm.ORDER - 1) + text
        for i in range(hpylm.ORDER - 1, len(raw)):
            context = raw[i - hpylm.ORDER + 1 : i]
            dishes = seats.setdefault(context, Counter())
            dishes[raw[i]] += 1
    for size in range(hpylm.ORDER - 2, -1, -1):  # each dish's one table is a customer of the parent
        for context in [c for c in seats if len(c) == size + 1]:
            for dish in seats[context]:
                seats.setdefault(context[1:], Counter())[dish] += 1

    def p(context, dish):
        below = hpylm.BASE if not context else p(context[1:], dish)
        dishes = seats.get(context)
        if not dishes:
            return below
        d, n, t = discounts[len(context)], sum(dishes.values()), len(dishes)
        own = max(0.0, dishes[dish] - d) if dishes[dish] else 0.0
        return (own + (strength + d * t) * below) / (strength + n)

    return p


def test_score_against_a_plain_recursion():
    """Before any sweep every dish has one table: the predictive probabilities of
    a tiny corpus, by look-ups and by recursion over plain counters."""
    texts = ["abra cadabra", "a cab", "", "bra bra abra"]
    split = [hpylm.words_of(t) for t in texts]
    keys, _ = hpylm.ngrams(split)
    distinct, counts = np.unique(keys, return_counts=True)
    discounts = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8]
    tree = hpylm.Subtree.first(distinct, counts, discounts)
    house = np.zeros(1 << 16, np.int64)
    at, n = tree.to_shared()
    house[at] = n
    one = hpylm.Level(1, np.arange(1 << 16, dtype=np.uint64), hpylm.Seats.one_table_each(house), discounts[1])
    up = np.bincount(np.arange(1 << 16) & 255, weights=np.minimum(house, 1), minlength=256)
    none = hpylm.Level(0, np.arange(256, dtype=np.uint64), hpylm.Seats.one_table_each(up), discounts[0])
    shared = one.predictive(none.predictive(np.full(256, hpylm.BASE))[np.arange(1 << 16) & 255])
    p = brute_probability([b" ".join(w) + (b" \n" if w else b"\n") for w in split], discounts, hpylm.STRENGTH)
    for key, got in zip(distinct.tolist(), tree.predict(distinct, shared).tolist()):
        raw = key.to_bytes(8, "big")[8 - hpylm.ORDER :]
        assert got == pytest.approx(p(raw[:-1], raw[-1]), rel=1e-9)
    unseen, _ = hpylm.ngrams([[b"zebra"], [b"cadab"]])
    for key, got in zip(unseen.tolist(), tree.predict(unseen, shared).tolist()):
        raw = key.to_bytes(8, "big")[8 - hpylm.ORDER :]
        assert got == pytest.approx(p(raw[:-1], raw[-1]), rel=1e-9)
