"""BPE, token counts and packing against the tokenizer libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from wattline.llm import bpe, packing, token_counts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u3000", "\u2003", "é", "e\u0301", "日本", "'s", "'LL", "12",
         "²", "!", "##", "😀", "\u200d", "ſ", "İ", "Σ", "ß", "\r\n", "\x00", "▁", "<s>", "<0x41>", "<|endoftext|>", "tion", "ing."]


def texts(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["a" * 3000, "ab c" * 700, " " * 300 + "x", " " * 300]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_against_the_library(tiktoken_encoding):
    enc = bpe.Encoder(RANKS, public_tokenizers.PATTERN, most=500)
    some = texts(3000)
    for a in range(0, len(some), 100):
        for t, ids in zip(some[a : a + 100], enc.encode(some[a : a + 100])):
            assert ids.tolist() == tiktoken_encoding.encode_ordinary(t), t
            assert enc.ranks.decode(ids) == t.encode()


def test_both_segment_trees_agree():
    ranks = bpe.Ranks(RANKS)
    rng = random.Random(2)
    pieces = [bytes(rng.choice(b"abcdehinorst \xc3\xa9") for _ in range(rng.randint(2, 60))) for _ in range(400)]
    for size in (4, 64):
        own = [p for p in pieces if len(p) <= size]
        tokens, counts = ranks.merge_side_by_side(own, size)
        for p, part in zip(own, np.split(tokens, np.cumsum(counts)[:-1])):
            assert part.tolist() == ranks.merge_long(p)


def test_bpe_documents(odd, none, tiktoken_encoding):
    got = bpe.encode_documents(odd, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode_documents(got, RANKS, public_tokenizers.PATTERN)
    rows = back.select("row.text", "n_tokens", "ids_sha256", "decoded_sha256", "decoded").collect()
    assert len(rows) == odd.count()
    for r in rows:
        ids = tiktoken_encoding.encode_ordinary(r["text"] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert bytes(r["decoded"]).decode() == (r["text"] or "")
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.encode_documents(none, RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.fixture(scope="module")
def sentence_model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_counts_against_the_library(sentence_model):
    counter = token_counts.PrefixCounter(PIECES, most=500)
    some = texts(3000, 6)
    for a in range(0, len(some), 100):
        part = some[a : a + 100]
        assert counter.count(part) == [len(x) for x in sentence_model.encode(part, num_threads=1)]


def test_compatible_pairs_by_edges_and_by_encoding():
    counter = token_counts.PrefixCounter(PIECES)
    rng = random.Random(9)
    vocabulary = sorted(counter.score)
    starts = [p for p in vocabulary if p.isascii() and len(p) <= 6]
    for _ in range(20000):
        s, t = rng.choice(vocabulary if rng.random() < 0.5 else starts), rng.choice(starts)
        if counter.merged(s) == [s] and counter.merged(t) == [t]:
            assert counter._fits(s, t) == (counter.merged(s + t) == [s, t]), (s, t)


def test_every_prefix_of_a_unit(sentence_model):
    counter = token_counts.PrefixCounter(PIECES)
    for word in ("internationalisation", "aaaaaaa", "日x本é", "thththth"):
        counts = counter.prefix_counts("▁" + word)
        assert counts[1:] == [len(sentence_model.encode(word[:i])) if i else 1 for i in range(len(word) + 1)]


def test_longest_prefix_within_a_budget(sentence_model):
    counter = token_counts.PrefixCounter(PIECES)
    for t in texts(200, 7)[:200]:
        numbers, _ = counter.units_of([t])
        for budget in (0, 1, 4, 9):
            want = max(i for i in range(len(t) + 1) if len(sentence_model.encode(t[:i])) <= budget)
            assert counter.fitting(t, numbers[0], budget) == want


def test_count_documents(odd, none, sentence_model):
    rows = token_counts.count_tokens(odd, PIECES, budget=20).select("row.text", "n_bytes", "n_tokens", "over_limit").collect()
    assert len(rows) == odd.count()
    for r in rows:
        n = len(sentence_model.encode(r["text"] or ""))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((r["text"] or "").encode()), n, n > 20)
    assert token_counts.count_tokens(none, PIECES, budget=20).count() == 0


def word_ids(some):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    return [[*e.ids, packing.END_ID] for e in tok.encode_batch([t or "" for t in some], add_special_tokens=False)]


def test_word_tokens_against_the_library():
    words = packing.WordTokens(WORDS, most=300)
    some = texts(2000, 8)
    for a in range(0, len(some), 100):
        got = [ids.tolist() for ids, _ in words.encode(some[a : a + 100])]
        assert got == word_ids(some[a : a + 100])


def cost_of(cuts, ends, penalties, limit):
    total, begin = 0.0, 0
    for i in cuts:
        n = ends[i] - begin
        assert 0 < n <= limit
        total += (0 if n & (n - 1) == 0 else limit - n) + penalties[i] + packing.WINDOW_PENALTY
        begin = ends[i]
    return total


def test_window_cuts_are_best():
    rng = random.Random(4)
    for _ in range(60):
        limit = 16
        ends = np.cumsum([rng.randint(1, 9) for _ in range(rng.randint(1, 12))]).tolist()
        penalties = [rng.choice([0.0, 2.0, 5.0]) for _ in ends]
        cuts = packing.window_cuts(ends, penalties, limit)
        assert cuts[-1] == len(ends) - 1
        best = [0.0]
        for j, e in enumerate(ends):
            best.append(min(
                best[i] + (0 if (n := e - (ends[i - 1] if i else 0)) & (n - 1) == 0 else limit - n) + penalties[j] + packing.WINDOW_PENALTY
                for i in range(j + 1) if e - (ends[i - 1] if i else 0) <= limit
            ))
        assert cost_of(cuts, ends, penalties, limit) == pytest.approx(best[-1])


@pytest.mark.parametrize("block_tokens", [1, 50, 1 << 19])
def test_packed_documents(odd, none, block_tokens):
    rows = packing.pack_documents(odd, WORDS, limit=64, block_tokens=block_tokens).collect()
    want = {}
    source = odd.select("doc_id", "text").collect()
    for r, ids in zip(source, word_ids([r["text"] for r in source])):
        want.setdefault((r["doc_id"], len(ids)), []).append(ids)
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces) == set(want)
    for key, parts in pieces.items():
        copies = len(want[key])
        assert sum(p["length"] for p in parts) == key[1] * copies
        for p in parts:
            assert any(
                zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"] for ids in want[key]
            )
    for parts in sequences.values():
        parts.sort(key=lambda p: p["offset"])
        at = 0
        for p in parts:
            assert p["offset"] == at
            at += p["length"]
        assert at <= 64
    assert packing.pack_documents(none, WORDS).count() == 0


def test_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = [r["n"] for r in packing.pack_documents(docs, WORDS).groupBy("sequence_id").agg({"length": "sum"}).toDF("s", "n").collect()]
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes)
    assert padding < 0.01 * sum(sizes)
