"""Exact token counts by prefix dynamic programming.

For a vocabulary that merges the adjacent pair with the best-scored
concatenation, a prefix of a text ends with the one token ``t`` that is
compatible with the last token ``s`` of the prefix before it, that is, the two
encode to themselves when put together. So the last token and the number of
tokens of every prefix follow from those of shorter prefixes, in one pass, and
truncation and budget questions need no further encoding.

Merges never cross into a word from the text before its leading spaces, so
texts are cut there; the counts of a unit's prefixes are remembered, up to a
number of units and of their characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain
from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import chunks

SPACE = "▁"
ENDING = 4  # characters by which the tokens that may end a prefix are looked up
LONG_UNIT = 64  # units of more characters are cut further
_MARKS = frozenset(",.")


class PrefixCounter:
    """Token counts of every prefix, for a sentencepiece BPE model with byte
    fallback, identity normalisation and a leading space added."""

    def __init__(self, path: str, most: int = 600_000, most_chars: int = 16 << 20):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        for i in range(model.vocab_size()):
            if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)):
                self.score[model.id_to_piece(i)] = model.get_score(i)
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece of this model spans words; texts cannot be cut at spaces")
        # pairs of characters that some piece holds; no merge joins any others
        self.inner = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.lines_apart = not any("\n" in p for p in self.score if len(p) > 1)
        # the longest token that ends with ENDING given characters, if longer than those
        self.reach: dict[str, int] = {}
        for p in self.score:
            if len(p) > ENDING:
                self.reach[p[-ENDING:]] = max(len(p), self.reach.get(p[-ENDING:], 0))
        # by the last ENDING characters: that length, and the tokens within them
        self.endings: dict[str, tuple[int, tuple]] = {}
        # after[t][s]: do the tokens s, t encode to themselves side by side
        self.after: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        self.edges: dict[str, tuple | None] = {}
        # state of the unit counted last: of each prefix, its last token ("" at
        # the start and after an unknown character) and its number of tokens
        self.unit, self.last, self.count_of_last = "", [""], [0]
        self.most, self.most_chars = most, most_chars
        self.numbers: dict[str, int] = {}
        self._empty()

    def _empty(self) -> None:
        self.numbers.clear()
        self.held = 0
        self.counts: list[bytes | np.ndarray] = []  # bytes where no count passes 255
        self.totals = np.zeros(0, np.int64)
        if self.pairs > 2 * self.most or len(self.endings) > self.most:  # these recur far more than units
            self.endings.clear()
            self.after.clear()
            self.pairs = 0

    def merged(self, text: str, log: list | None = None) -> list[str]:
        """Plain encoding of a short string: the best-scored adjacent pair
        first, the leftmost of equals. ``log`` gets each merge as (position of
        the left part, left, right, score)."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        score = self.score
        queue = [(-score[a + b], i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in score]
        heapify(queue)
        while queue:
            _, i, a, b = heappop(queue)
            j = after[i] if parts[i] == a else len(parts)
            if j >= len(parts) or parts[j] != b:
                continue
            if log is not None:
                log.append((i, a, b, score[a + b]))
            parts[i], parts[j] = a + b, None
            after[i] = k = after[j]
            if k < len(parts):
                before[k] = i
                if a + b + parts[k] in score:
                    heappush(queue, (-score[a + b + parts[k]], i, a + b, parts[k]))
            h = before[i]
            if h >= 0 and parts[h] + a + b in score:
                heappush(queue, (-score[parts[h] + a + b], h, parts[h], a + b))
        return [p for p in parts if p is not None]

    def _edges(self, token: str) -> tuple | None:
        """What stands at the right and at the left edge of ``token`` while it
        is merged, each part with the score of the merge that ends it (None
        for the token itself). None if its merges do not come in order of
        falling scores; such tokens are compared by encoding."""
        log: list = []
        if self.merged(token, log) != [token] or any(x[3] <= y[3] for x, y in zip(log, log[1:])):
            return None
        right = [(b, s) for i, a, b, s in log if i + len(a) + len(b) == len(token)]
        left = [(a, s) for i, a, b, s in log if i == 0]
        return [*right, (token, None)], [*left, (token, None)]

    def _fits(self, s: str, t: str) -> bool:
        """Do ``s`` and ``t`` encode to themselves side by side? They do unless
        a part at the right edge of ``s`` and one at the left edge of ``t``
        merge before either is merged within its own token (of equal scores,
        the leftmost first)."""
        edges = self.edges
        for x in (s, t):
            if x not in edges:
                edges[x] = self._edges(x)
        if edges[s] is None or edges[t] is None:
            return self.merged(s + t) == [s, t]
        score = self.score
        for a, ends in edges[s][0]:
            for b, stops in edges[t][1]:
                across = score.get(a + b)
                if across is not None and (ends is None or across > ends) and (stops is None or across >= stops):
                    return False
        return True

    def _compatible(self, s: str, t: str) -> bool:
        known = self.after.setdefault(t, {})
        fits = known.get(s)
        if fits is None:
            fits = known[s] = self._fits(s, t) if s else self.merged(t) == [t]
            self.pairs += 1
        return fits

    def _ending(self, key: str) -> tuple[int, tuple]:
        """For a prefix that ends with ``key``: how long its last token may be, if
        longer than ``key``, and (length, token, what fits before it) of the
        tokens that ``key`` ends with, the longest first."""
        ends = [key[-n:] for n in range(len(key), 0, -1)]
        tokens = tuple((len(t), t, self.after.setdefault(t, {})) for t in ends if t in self.score)
        self.endings[key] = found = (self.reach.get(key, 0), tokens)
        return found

    def prefix_counts(self, unit: str) -> list[int]:
        """Number of tokens of each prefix of ``unit`` (without further
        spaces inside), the empty one first.

        The states of the unit asked for last are kept; what the two units
        have in common is not computed again."""
        score, endings = self.score, self.endings
        last, count = self.last, self.count_of_last
        shared = len(commonprefix((unit, self.unit)))
        del last[shared + 1 :], count[shared + 1 :]
        self.unit = unit
        for end in range(shared + 1, len(unit) + 1):
            key = unit[end - ENDING : end] if end > ENDING else unit[:end]
            reach, tokens = endings.get(key) or self._ending(key)
            if not tokens:  # unknown: one token for each of its bytes, merged with nothing
                last.append("")
                count.append(count[-1] + len(key[-1].encode("utf-8", "surrogatepass")))
                continue
            t = ""
            for n in range(min(reach, end), ENDING, -1):
                longer = unit[end - n : end]
                if longer in score and self._compatible(last[end - n], longer):
                    t = longer
                    break
            else:
                for n, t, known in tokens:  # the longest first; a single character always fits
                    fits = known.get(last[end - n])
                    if fits is None:
                        fits = self._compatible(last[end - n], t)
                    if fits:
                        break
            last.append(t)
            count.append(count[end - n] + 1)
        return count

    def units(self, text: str) -> list[str]:
        """Cuts of the text before each run of spaces; the first unit has the
        leading space that the model adds. Long units, as text without spaces
        is, are cut on between characters that no piece holds side by side."""
        units = self.spaced(text)
        if max(map(len, units)) <= LONG_UNIT:
            return units
        return list(chain.from_iterable([u] if len(u) <= LONG_UNIT else self.parts(u) for u in units))

    def parts(self, unit: str) -> list[str]:
        inner = self.inner
        cuts = [i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in inner]
        return [unit[i:j] for i, j in zip([0, *cuts], [*cuts, len(unit)])]

    def spaced(self, text: str) -> list[str]:
        """Cuts before spaces, around line feeds, and before a last comma or point;
        the last two only where no piece spans them. A word is the same with
        and without such a mark, so fewer units need counting."""
        out: list[str] = []
        add, inner, lines, spaces = out.append, self.inner, self.lines_apart, ""
        for word in text.replace(SPACE, " ").split(" "):
            spaces += SPACE
            if not word:
                continue
            unit, spaces = spaces + word, ""
            if lines and "\n" in word:
                for i, part in enumerate(unit.split("\n")):
                    if i:
                        add("\n")
                    if part[-1:] in _MARKS and part[-2:] not in inner and len(part) > 1:
                        add(part[:-1])
                        add(part[-1])
                    elif part:
                        add(part)
            elif unit[-1] in _MARKS and unit[-2:] not in inner:
                add(unit[:-1])
                add(unit[-1])
            else:
                add(unit)
        if spaces:
            add(spaces)
        return out

    def _number(self, unit: str) -> int:
        self.numbers[unit] = number = len(self.counts)
        counts = self.prefix_counts(unit)
        self.counts.append(bytes(counts) if len(counts) <= 64 else np.array(counts, np.int32))
        self.held += len(unit)
        return number

    def units_of(self, texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
        """Numbers of the units of each text, and the token count of each
        number."""
        if len(self.numbers) > self.most or self.held > self.most_chars:
            self._empty()
        split = [self.units(t) if t else [] for t in texts]
        new = set(chain.from_iterable(split)).difference(self.numbers)
        for unit in sorted(new):
            self._number(unit)
        if new:
            fresh = self.counts[len(self.totals) :]
            self.totals = np.concatenate([self.totals, np.fromiter((c[-1] for c in fresh), np.int64, len(fresh))])
        ends = np.cumsum([0, *map(len, split)])
        flat = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(split)), np.int64, int(ends[-1]))
        return [flat[a:z] for a, z in zip(ends.tolist(), ends[1:].tolist())], self.totals

    def count(self, texts: list[str | None]) -> list[int]:
        numbers, totals = self.units_of(texts)
        return [int(totals[n].sum()) for n in numbers]

    def fitting(self, text: str | None, numbers: np.ndarray, budget: int) -> int:
        """Code points of the longest prefix that encodes to at most
        ``budget`` tokens, from the stored counts alone."""
        if not text:
            return 0
        upto = np.cumsum(self.totals[numbers])
        if not len(upto) or upto[-1] <= budget:
            return len(text)
        # a unit that begins over the budget has no prefix within it, for each of its own counts is 1 at least
        i = int(np.searchsorted(upto, budget, side="right"))
        begin = 0  # in code points of the normalised text, which has one leading space more
        for n in numbers[:i]:
            begin += len(self.counts[n]) - 1
        left = budget - (int(upto[i - 1]) if i else 0)
        best = max(k for k, n in enumerate(self.counts[numbers[i]]) if n <= left)
        return max(0, begin + best - 1)


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter for each Python worker, kept between its tasks."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, budget: int, text_col: str = "text") -> DataFrame:
    """``docs`` as struct ``row``, with ``n_bytes`` (UTF-8), ``n_tokens``,
    ``over_limit`` (more tokens than ``budget``) and ``fits_chars``, the code
    points of the longest prefix within the budget.

    Counts are those of the library for the sentencepiece model at ``path``,
    without begin or end tokens; strings of special tokens are ordinary text.
    Null counts as empty: no bytes, no tokens. Whole texts count; repeated
    rows each come out; names of other columns cannot clash; an empty table
    gives an empty result."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("n_tokens long, fits_chars long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = counter(path)
        for texts in batches:
            texts = [t if isinstance(t, str) else None for t in texts]
            total, fits = [], []
            for a, z in chunks(texts):
                numbers, totals = own.units_of(texts[a:z])
                total += [int(totals[n].sum()) for n in numbers]
                fits += [own.fitting(t, n, budget) for t, n in zip(texts[a:z], numbers)]
            yield pd.DataFrame({"n_tokens": total, "fits_chars": fits}, dtype="int64")

    text = F.coalesce(docs[text_col], F.lit(""))
    out = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        count(docs[text_col]).alias("c"),
    )
    return out.select("row", "n_bytes", "c.n_tokens", (F.col("c.n_tokens") > budget).alias("over_limit"), "c.fits_chars")
