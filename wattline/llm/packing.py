"""Packing documents into sequences by order-preserving dynamic programming.

Documents keep the order in which they are read. Their tokens form a stream;
windows of at most ``limit`` tokens are cut from it at document or sentence
ends so that padding plus penalties for truncated documents is least. The
best cost of a prefix needs the minimum over the cuts that one window can
reach, which a monotone queue gives in constant time a cut.

Padding: a window is padded to ``limit``, except that a window whose length
is a power of two needs none.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import chunks

END_ID = 1
# penalties in tokens of padding: each window, a cut at a sentence end, a cut within a sentence
WINDOW_PENALTY, SENTENCE_PENALTY, MIDDLE_PENALTY = 16.0, 2.0, 64.0
# sentences longer than this may be cut every so many tokens
LONG_SENTENCE = 256
_SENTENCE_END = (b".", b"!", b"?", b'."', b'!"', b'?"', b".)", b"!)", b"?)")


# Words of these characters alone are cut into pieces and looked up here;
# they are stable under NFC, and their lower case is by character.
_PLAIN = re.compile(rb"(?:[\x21-\x7e]++|\xc2[\xa1-\xbf]|\xc3[\x80-\xbf])+\Z").match


# All bytes of characters below U+0100: no combining marks, so the lower case of
# ASCII letters may be taken before NFC.
_LATIN = bytes(range(0xC4))
_LETTER, _POINT, _BLANK = (np.isin(np.arange(256), np.frombuffer(s, np.uint8)) for s in (
    b"abcdefghijklmnopqrstuvwxyz", b",.", b" \t\n\x0b\x0c\r",
))


def folded(text: str) -> bytes:
    """``text`` with ASCII letters in lower case, where that changes no token."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw if raw.translate(None, _LATIN) or b"<|" in raw else raw.lower()


def apart(raws: list[bytes]) -> list[bytes]:
    """``raws`` with a space between a letter and a comma or point that white
    space follows. The tokenizer's pattern cuts there anyway; words are the same
    with and without such a mark, so fewer of them need remembering."""
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    at = np.flatnonzero(_POINT[data[1:-1]] & _LETTER[data[:-2]] & _BLANK[data[2:]]) + 1
    ends = np.cumsum([len(r) + 1 for r in raws])
    ends += np.searchsorted(at, ends)
    spaced = np.insert(data, at, 32).tobytes()
    return [spaced[a:z] for a, z in zip([0, *ends.tolist()], ends.tolist())]


class WordTokens(dict):
    """Token ids of white-space separated words, remembered by word.

    The tokenizer drops white space and never joins tokens across it, so the
    ids of a text are those of its words in turn. ``dict`` look-up of a word
    gives its number; unknown words are numbered on the fly and encoded
    together: plain ones by the pieces that the tokenizer's own pattern cuts,
    each given to its model once; others, and those that may hold a special
    token, as whole words by the tokenizer. At ``most`` words, or ``most_bytes``
    of them (text without white space is one word), the memory is emptied."""

    def __init__(self, path: str, most: int = 600_000, most_bytes: int = 16 << 20):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer, self.most, self.most_bytes = Tokenizer.from_file(path), most, most_bytes
        with open(path, encoding="utf-8") as fh:
            description = json.load(fh)
        self.find = regex.compile(_split_pattern(description["pre_tokenizer"]) + r"|\n").findall
        self.letters = _byte_letters()
        suffix = description["model"]["end_of_word_suffix"]
        vocabulary = description["model"]["vocab"]
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = WhitespaceSplit()
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.held = 0
        self.new: list[bytes] = []
        self.pieces: dict[str, list[int]] = {}
        self.ids = np.zeros(0, np.uint32)
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ends = np.zeros(0, bool)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        self.held += len(word)
        return number

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``words``, each one piece in the byte-level alphabet, by the
        model alone, and how many each has: its last token alone ends a word."""
        ids = [np.zeros(0, np.uint32)]
        for at in range(0, len(words), 1 << 16):
            lines = [" ".join(words[i : i + 256]) for i in range(at, min(at + (1 << 16), len(words)), 256)]
            batch = self.plain.encode_batch_fast(lines, add_special_tokens=False)
            ids.append(np.fromiter(chain.from_iterable(e.ids for e in batch), np.uint32))
        ids = np.concatenate(ids)
        return ids, np.diff(np.flatnonzero(self.word_end[ids]) + 1, prepend=0)

    def _encode_pieces(self, pieces: list[str]) -> None:
        spelled = [p if p.isascii() else p.encode().decode("latin-1").translate(self.letters) for p in pieces]
        ids, lengths = self._encode_words(spelled)
        ids, stops = ids.tolist(), np.cumsum(lengths).tolist()
        self.pieces.update((p, ids[i:j]) for p, i, j in zip(pieces, [0, *stops], stops))

    def _encode_new(self) -> None:
        new = self.new
        simple = [i for i, w in enumerate(new) if w.isalpha()]  # ASCII letters: a piece as they stand
        ids, lengths = self._encode_words([new[i].decode().lower() for i in simple])
        known = set(simple)
        plain = [i for i, w in enumerate(new) if i not in known and _PLAIN(w) and b"<|" not in w]
        cut = self.find(b"\n".join([new[i] for i in plain]).decode().lower())
        self._encode_pieces([p for p in dict.fromkeys(cut) if p != "\n" and p not in self.pieces])
        found: dict[int, list[int]] = {}
        at, pieces, number = 0, self.pieces, len(cut)
        for i in plain:
            word = pieces[cut[at]]
            at += 1
            while at < number and cut[at] != "\n":
                word = word + pieces[cut[at]]
                at += 1
            at += 1
            found[i] = word
        known.update(plain)
        other = [i for i in range(len(new)) if i not in known]
        for at, z in chunks([new[i] for i in other], 1 << 18):
            part = other[at:z]
            texts = [new[i].decode("utf-8", "replace") for i in part]
            for i, e in zip(part, self.tokenizer.encode_batch(texts, add_special_tokens=False)):
                found[i] = e.ids
        rest = np.fromiter(map(len, found.values()), np.int64, len(found))
        order = np.fromiter(chain(simple, found), np.int64, len(new))
        in_order = np.concatenate([lengths, rest])
        lengths, starts = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
        lengths[order], starts[order] = in_order, len(self.ids) + np.cumsum(in_order) - in_order
        more = np.fromiter(chain.from_iterable(found.values()), np.uint32, int(rest.sum()))
        self.starts = np.concatenate([self.starts, starts])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids, more])
        self.ends = np.concatenate([self.ends, np.array([w.endswith(_SENTENCE_END) for w in new], bool)])
        self.new = []

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids with END_ID, and the ends of its sentences
        (positions in the ids, the last being their number)."""
        if len(self) > self.most or self.held > self.most_bytes:
            self._empty()
        split = [raw.split() for raw in apart([folded(t) if t else b"" for t in texts])] if texts else []
        total = sum(map(len, split))
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64, total)
        if self.new:
            self._encode_new()
        lengths = self.lengths[numbers]
        upto = np.cumsum(lengths)
        flat = self.ids[np.repeat(self.starts[numbers] - (upto - lengths), lengths) + np.arange(int(lengths.sum()))]
        sentence = np.flatnonzero(self.ends[numbers])
        stop_words = np.searchsorted(sentence, np.cumsum([0, *map(len, split)])).tolist()
        stop_at = upto[sentence]
        out, word, token = [], 0, 0
        for n, words in enumerate(split):
            word += len(words)
            end = int(upto[word - 1]) if word else 0
            ids = np.append(flat[token:end], np.uint32(END_ID))
            stops = stop_at[stop_words[n] : stop_words[n + 1]] - token
            if len(stops) and (stops[0] == 0 or stops[-1] == len(ids) - 1 or (np.diff(stops) == 0).any()):
                stops = np.unique(stops[(stops > 0) & (stops < len(ids) - 1)])
            out.append((ids, np.append(stops, len(ids))))
            token = end
        return out


def _split_pattern(pre: dict) -> str:
    """The pattern of the Split step in the tokenizer's description."""
    steps = pre.get("pretokenizers", [pre])
    return next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: visible Latin-1 characters stand for
    themselves, the other bytes in turn for the characters from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: 256 + i for i, b in enumerate(hidden)}


_WORDS: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One memory of words for each Python worker, kept between its tasks."""
    if path not in _WORDS:
        _WORDS[path] = WordTokens(path)
    return _WORDS[path]


def with_middle_cuts(stops: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """``stops`` and, inside sentences longer than ``step``, a cut every
    ``step`` tokens; the second array marks the cuts that were added."""
    begins = np.concatenate(([0], stops[:-1]))
    long = np.flatnonzero(stops - begins > step)
    if not len(long):
        return stops, np.zeros(len(stops), bool)
    extra = np.concatenate([np.arange(begins[i] + step, stops[i], step) for i in long])
    cuts = np.concatenate([stops, extra])
    order = np.argsort(cuts, kind="stable")
    return cuts[order], np.concatenate([np.zeros(len(stops), bool), np.ones(len(extra), bool)])[order]


def _exact_windows(at: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """(k, j) for all cuts that lie a power of two below ``limit`` apart, by k."""
    found = []
    for e in range(limit.bit_length()):
        if 1 << e < limit:
            j = np.minimum(np.searchsorted(at, at - (1 << e)), len(at) - 1)
            k = np.flatnonzero(at[j] == at - (1 << e))
            found.append(np.column_stack([k, j[k]]))
    pairs = np.concatenate(found)
    return iter(map(tuple, pairs[np.argsort(pairs[:, 0], kind="stable")].tolist()))


def window_cuts(ends: list[int], penalties: list[float], limit: int) -> list[int]:
    """Indices into ``ends`` at which windows end, the last one included, of
    least total cost. ``ends`` are increasing token positions at which a cut
    is allowed, no two neighbours further apart than ``limit`` (the first from
    0), ``penalties`` what a cut there costs."""
    # best[k]: least cost of cutting the stream at ends[k - 1]; best[0]: its start
    at = [0, *ends]
    exact = _exact_windows(np.array(at, np.int64), limit)
    best, came = [0.0] * len(at), [0] * len(at)
    queue: deque[int] = deque([0])  # cuts in reach, best[k] + at[k] increasing
    value = [0.0] * len(at)
    nxt, then = next(exact, (0, 0))
    for k in range(1, len(at)):
        here = at[k]
        while at[queue[0]] < here - limit:
            queue.popleft()
        i = queue[0]
        cost = value[i] + limit - here
        while nxt == k:
            if best[then] < cost:
                cost, i = best[then], then
            nxt, then = next(exact, (0, 0))
        cost += penalties[k - 1] + WINDOW_PENALTY
        best[k], came[k] = cost, i
        value[k] = cost = cost + here
        while queue and value[queue[-1]] >= cost:
            queue.pop()
        queue.append(k)
    out, k = [], len(at) - 1
    while k:
        out.append(k - 1)
        k = came[k]
    return out[::-1]


class Packer:
    """Packs the documents of one partition block by block. What the last
    window of a block holds is carried into the next block."""

    def __init__(self, limit: int, sequence: int):
        self.limit, self.sequence = limit, sequence
        # (id, ids, cuts, marks of cuts within sentences, tokens already packed)
        self.open: list[tuple] = []

    def add(self, doc_id: object, ids: np.ndarray, stops: np.ndarray) -> None:
        cuts, middle = with_middle_cuts(stops, min(LONG_SENTENCE, self.limit))
        self.open.append((doc_id, ids, cuts, middle, 0))

    def pack(self, last: bool) -> list[tuple]:
        """Pieces (id, start, length, crc, tokens, sequence, offset) of the
        windows that are complete; of all if this is the ``last`` call."""
        if not self.open:
            return []
        ends, costs, base = [], [], 0
        for _, ids, cuts, middle, done in self.open:
            use = cuts > done
            ends.append(cuts[use] - done + base)
            cost = np.where(middle[use], MIDDLE_PENALTY, SENTENCE_PENALTY)
            cost[-1] = 0.0
            costs.append(cost)
            base += len(ids) - done
        ends, costs = np.concatenate(ends), np.concatenate(costs)
        at = ends[window_cuts(ends.tolist(), costs.tolist(), self.limit)].tolist()
        if not last:
            at.pop()
        out, doc, begin, base = [], 0, 0, 0  # base: where the document's rest begins
        for end in at:
            pos = begin
            while pos < end:
                doc_id, ids, _, _, done = self.open[doc]
                stop = min(end, base + len(ids) - done)
                a, b = pos - base + done, stop - base + done
                out.append((doc_id, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()), len(ids), self.sequence, pos - begin))
                pos = stop
                if b == len(ids):
                    base, doc = stop, doc + 1
            begin, self.sequence = end, self.sequence + 1
        rest = self.open[doc:]
        if rest and begin > base:
            doc_id, ids, cuts, middle, done = rest[0]
            rest[0] = (doc_id, ids, cuts, middle, done + begin - base)
        self.open = rest
        return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(
    docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text",
    block_tokens: int = 1 << 19,
) -> DataFrame:
    """One row per piece: ``doc_id``, ``start`` and ``length`` in the ids of
    its document, ``ids_crc32`` of them (little-endian unsigned 32-bit),
    ``doc_tokens``, ``sequence_id`` and ``offset``.

    ``tokenizer`` is the path of a ``tokenizers`` file whose tokens never span
    white space. Documents stay in the order of their input partition and no
    row is shuffled; sequences are numbered from ``partition << 40``. Null and
    empty texts are the end id alone. A text of any length is cut at will;
    only its own ids are held. Rows that repeat are packed as often; a null id
    stays null. An empty table gives an empty result; other columns are not
    read."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get()
        packer = Packer(limit, (task.partitionId() if task else 0) << 40)
        words = word_tokens(tokenizer)
        names = [c.split()[0] for c in PIECES.split(", ")]

        def frame(pieces: list[tuple]) -> pd.DataFrame:
            made = pd.DataFrame(pieces, columns=names)
            return made.astype({c: "Int64" for c in names})

        held = 0
        for b in batches:
            ids, texts = b["id"].tolist(), b["text"].tolist()
            for a, z in chunks(texts):
                for doc_id, (tokens, stops) in zip(ids[a:z], words.encode(texts[a:z])):
                    packer.add(None if doc_id is None or doc_id != doc_id else int(doc_id), tokens, stops)
                    held += len(tokens)
                if held >= block_tokens:
                    yield frame(packer.pack(last=False))
                    held = 0
        yield frame(packer.pack(last=True))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, PIECES)
