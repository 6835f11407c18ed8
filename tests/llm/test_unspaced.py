"""Text without spaces: exact, and in little memory (op5, op8, op9)."""

import base64
import random
import resource
import subprocess
import sys
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest

from wattline.llm.bpe import Encoder
from wattline.llm.packing import WordTokens
from wattline.llm.token_counts import PrefixCounter

BPE, WORDS, PIECES = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")


def made_up(rng, n, marks=True):
    """``n`` characters without a space, in several scripts."""
    pools = ["的一是不了人我在有他这为之大来以个中上们到说国和地也子时道出而要于就下得可你年生自会那后能对着事其里所去行过", "абвгдежзиклмнопрст", "ぁあいうえおかがきくけこアイウエオカ", "abcdefghijklm", "한국어가나다라마바사", "אבגדהוזח"]
    out = []
    while len(out) < n:
        pool = rng.choice(pools)
        out += [rng.choice(pool) if rng.random() < 0.9 else chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(rng.randrange(1, 40))]
        if marks and rng.random() < 0.3:
            out.append(rng.choice("，。！？、.,!?'\n\u3000é"))
    return "".join(out[:n])


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    return [made_up(rng, rng.randrange(1, 4000), marks=i % 2 == 0) for i in range(60)] + ["a" * 3000, "ab" * 900, "的" * 2000, "é" * 700 + " x"]


def test_bpe_equals_the_library(texts):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = Encoder(BPE, P.PATTERN)
    for _ in range(2):  # the second time from memory
        for text, ids in zip(texts, encoder.encode(texts)):
            assert ids.tolist() == own.encode_ordinary(text)


def test_white_space_between_words_stays_in_its_piece():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = ["a\n \nb", "a \n b", " a  b\t c", "\n\n x", "a\u3000 b \u3000c", "  ", " ", "x ", "\r\n \r\n y"]
    encoder = Encoder(BPE, P.PATTERN)
    assert [i.tolist() for i in encoder.encode(odd)] == [own.encode_ordinary(t) for t in odd]
    assert encoder.units("a\n \nb") == ["a\n \nb"] and encoder.units("a b\n c") == ["a", " b\n c"]


def test_counts_equal_the_library(texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counter = PrefixCounter(PIECES)
    assert counter.count(texts) == [len(model.encode(t)) for t in texts]
    numbers, _ = counter.units_of(texts)
    for text, n in zip(texts, numbers):
        for budget in (0, 1, 7, 100):
            k = counter.fitting(text, n, budget)
            assert len(model.encode(text[:k])) <= budget or k == 0


def test_words_equal_the_library(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    for text, (ids, stops) in zip(texts, WordTokens(WORDS).encode(texts)):
        assert ids[:-1].tolist() == library.encode(text, add_special_tokens=False).ids and ids[-1] == 1
        assert stops[-1] == len(ids) and (np.diff(stops) > 0).all()


GROWTH = """
import random, resource, sys, gc
sys.path.insert(0, {tests!r})
from test_unspaced import BPE, PIECES, WORDS, made_up
from wattline.llm.bpe import Encoder
from wattline.llm.packing import WordTokens
from wattline.llm.token_counts import PrefixCounter
import public_tokenizers as P
which = {which!r}
own = Encoder(BPE, P.PATTERN) if which == "bpe" else WordTokens(WORDS) if which == "words" else PrefixCounter(PIECES)
run = own.count if which == "pieces" else own.encode
rng = random.Random(1)
def block(k):
    return [made_up(rng, 20_000) for _ in range(16)]
run(block(0))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
size = 0
for k in range({blocks}):
    texts = block(k)
    size += sum(len(t.encode()) for t in texts)
    run(texts)
grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10
print(which, size >> 20, "MB read,", grown, "MB more")
assert grown < 300, grown
"""


@pytest.mark.parametrize("which", ["bpe", "words", "pieces"])
def test_memory_stays_bounded(which):
    """Some 25 MB that never repeat: the worker's memory is bounded by bytes, so
    more would not hold more (100 MB were run by hand, see the README)."""
    code = GROWTH.format(tests=str(Path(__file__).parent), which=which, blocks=40)
    root = Path(__file__).resolve().parents[2]
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=300)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
