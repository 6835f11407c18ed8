"""Periodic runs of words: stretches that repeat with some period.

An enhanced suffix array of every text (suffix array, its inverse and the
common prefixes of neighbours) gives the LCP intervals, each of which stands
for a repeated string of some depth. The suffixes of all children of an
interval but the largest are tested: suffix ``i`` and ``i + depth`` (or
``i - depth``) in the same interval, with different words after them, are a
branching tandem. Turned left as long as the words allow, its squares merge
into one run. No tree nodes are built.

Texts are taken a block at a time; suffixes are ranked by prefix doubling
inside each text, all texts of a block side by side in arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import chunks

RESULT = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_NONE = np.zeros(0, np.int64)


class Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _sorted(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by ``(first, second)``, and where a pair differs from the one before."""
    n = len(first)
    low = int(n).bit_length()
    mid = int(second.max(initial=0)).bit_length()
    if low + mid + int(first.max(initial=0)).bit_length() < 63:
        # number and both keys fit one integer, which sorts fastest
        keys = (((first << mid) | second) << low) | np.arange(n)
        keys.sort()
        order = keys & ((1 << low) - 1)
        keys >>= low
        differ = keys[1:] != keys[:-1]
    else:
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        differ = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.concatenate(([True], differ)) if n else np.zeros(0, bool)


def suffix_ranks(words: np.ndarray, text: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of all texts (of one text after the other) and the
    ranks of the first 1, 2, 4, ... words of every suffix; the last ranks are
    the inverse of the array. ``end`` is where the text of a word ends."""
    n = len(words)
    array, new = _sorted(text, words)
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[array] = np.maximum.accumulate(np.where(new, slots, 0))
    levels, step = [rank.astype(np.int32)], 1
    while True:
        shared = ~(new & np.concatenate((new[1:], [True])))
        slots = np.flatnonzero(shared)
        if not len(slots):
            return array, levels
        these = array[slots]
        after = these + step
        inside = after < end[these]
        second = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        order, differ = _sorted(rank[these], second)
        these = these[order]
        array[slots], new[slots] = these, differ
        rank[these] = np.maximum.accumulate(np.where(differ, slots, 0))
        levels.append(rank.astype(np.int32))
        step *= 2


def _common(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many words the suffixes ``x`` and ``y`` of a text have in common."""
    n, x, y, start = len(levels[0]), x.copy(), y.copy(), x
    for level in range(len(levels) - 1, -1, -1):
        rank = levels[level]
        same = (np.maximum(x, y) < end) & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)])
        x += same << level
        y += same << level
    return x - start


def _intervals(lcp: list[int]) -> tuple[list[int], list[int], list[int]]:
    """For each place of ``lcp`` (0 at both ends) the place before it that is
    not larger, the next that is smaller, and the first of its own interval."""
    before, after, first, stack = [0] * len(lcp), [0] * len(lcp), [0] * len(lcp), [0]
    for t in range(1, len(lcp)):
        depth = lcp[t]
        while lcp[stack[-1]] > depth:
            after[stack.pop()] = t
        left = stack[-1]
        before[t] = left
        first[t] = first[left] if lcp[left] == depth else t
        stack.append(t)
    return before, after, first


def find_runs(words: np.ndarray, ends: np.ndarray, least: int = 12) -> tuple[np.ndarray, ...]:
    """All runs of at least ``least`` words of the texts that end at ``ends``:
    number of the text, first word (of all words), length and smallest period,
    by text, start and period. Time grows with n log n, memory with the number
    of words times the logarithm of the longest repeat.

    A run of ``least`` words or more has a square of some multiple of its
    period that is deeper than a quarter of ``least``, so intervals less deep
    need no test; the smallest period is found among the divisors."""
    nothing = (_NONE, _NONE, _NONE, _NONE)
    n, shallow = len(words), max(1, least // 4 + 1)
    if not n:
        return nothing
    sizes = np.diff(ends, prepend=0)
    text = np.repeat(np.arange(len(ends)), sizes)
    end, start = ends[text], (ends - sizes)[text]
    array, levels = suffix_ranks(words, text, end)
    level = shallow.bit_length() - 1
    if len(levels) <= level:
        return nothing
    # neighbours in the suffix array that share `shallow` words or more
    near = levels[level][array]
    at = np.flatnonzero(near[1:] == near[:-1]) + 1
    depth = _common(levels, array[at - 1], array[at], end[array[at]])
    deep = depth >= shallow
    at, depth = at[deep], depth[deep]
    if not len(at):
        return nothing
    # stretches of neighbouring slots, a zero before each and at the end
    gap = np.concatenate(([True], np.diff(at) > 1))
    place = np.arange(len(at)) + np.cumsum(gap)
    lcp = np.zeros(place[-1] + 2, np.int64)
    lcp[place] = depth
    heads = np.flatnonzero(gap)
    tails = np.append(heads[1:], len(at)) - 1
    opens, closes = np.zeros(len(lcp), np.int64), np.zeros(len(lcp), np.int64)
    opens[place] = closes[place] = at
    opens[place[heads] - 1], closes[place[tails] + 1] = at[heads] - 1, at[tails] + 1
    before, after, first = (np.array(x, np.int64) for x in _intervals(lcp.tolist()))
    left, right = opens[before[place]], closes[after[place]]
    own = first[place]
    # children: the slots left of each place, and those right of the last place of an interval
    last = np.ones(len(lcp), bool)
    equal = lcp[before[place]] == depth
    last[before[place][equal]] = False
    last = last[place]
    by_place = np.zeros(len(lcp), np.int64)
    by_place[place] = left
    low = by_place[own]
    child_of = np.concatenate((own, own[last]))
    child_from = np.concatenate((left, at[last]))
    child_to = np.concatenate((at, right[last]))
    child_low = np.concatenate((low, low[last]))
    child_high = np.concatenate((right, right[last]))
    child_depth = np.concatenate((depth, depth[last]))
    size = child_to - child_from
    order = np.lexsort((-size, child_of))
    largest = np.concatenate(([True], np.diff(child_of[order]) != 0))
    small = order[~largest]
    size = size[small]
    upto = np.cumsum(size)
    members = np.repeat(child_from[small] - (upto - size), size) + np.arange(int(size.sum()))
    i, d = array[members], np.repeat(child_depth[small], size)
    low, high = np.repeat(child_low[small], size), np.repeat(child_high[small], size)
    inverse = levels[-1]

    def inside(j: np.ndarray, valid: np.ndarray) -> np.ndarray:
        found = inverse[np.clip(j, 0, n - 1)]
        return valid & (low <= found) & (found < high)

    ahead, behind = inside(i + d, i + d < end[i]), inside(i - d, i - d >= start[i])
    square = np.concatenate((i[ahead], (i - d)[behind]))
    period = np.concatenate((d[ahead], d[behind]))
    stop = square + 2 * period
    # branching: what follows the first half is not what follows the square
    branch = (stop >= end[square]) | (words[np.minimum(stop, n - 1)] != words[np.minimum(square + period, n - 1)])
    square, period, stop = square[branch], period[branch], stop[branch]
    # turn left
    head, begin = square.copy(), start[square]
    for level in range(len(levels) - 1, -1, -1):
        rank, step = levels[level], 1 << level
        back = head - step
        same = (back >= begin) & (rank[np.maximum(back, 0)] == rank[np.minimum(np.maximum(back + period, 0), n - 1)])
        head -= same << level
    long = stop - head >= least
    head, stop, period = head[long], stop[long], period[long]
    # squares of the same stretch are one run, of the least of their periods
    order = np.lexsort((period, stop, head))
    head, stop, period = head[order], stop[order], period[order]
    one = np.concatenate(([True], (np.diff(head) != 0) | (np.diff(stop) != 0))) if len(head) else np.zeros(0, bool)
    head, stop, period = head[one], stop[one], period[one]
    for q in range(shallow - 1, 0, -1):
        may = np.flatnonzero((period < 2 * shallow) & (period % q == 0))
        whole = np.ones(len(may), bool)
        for t in range(q, 2 * shallow):
            a = head[may]
            whole &= (t >= period[may]) | (words[np.minimum(a + t, n - 1)] == words[a + t % q])
        period[may[whole]] = q
    order = np.lexsort((period, head))
    head, stop, period = head[order], stop[order], period[order]
    return text[head], head, stop - head, period


def runs_of_texts(texts: list[bytes], least: int = 12) -> pa.StructArray:
    """Number of words, runs and collapsed text of each of ``texts`` (UTF-8)."""
    cut = [t.split() if t else [] for t in texts]
    counts = np.fromiter(map(len, cut), np.int64, len(cut))
    ends = np.cumsum(counts)
    number = Numbers().__getitem__
    words = np.fromiter((number(w) for c in cut for w in c), np.int64, int(counts.sum()))
    text, head, length, period = find_runs(words, ends, least)
    begins = ends - counts
    # words that a run holds after its first period
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, head + period, 1)
    np.add.at(change, head + length, -1)
    keep = np.cumsum(change)[:-1] == 0
    per_text = np.bincount(text, minlength=len(texts)) if len(texts) else _NONE
    collapsed = []
    for c, a, z, has in zip(cut, begins.tolist(), ends.tolist(), per_text.tolist()):
        collapsed.append(b" ".join(c if not has else [c[k] for k in np.flatnonzero(keep[a:z])]))
    runs = pa.StructArray.from_arrays(
        [pa.array(head - begins[text]), pa.array(length), pa.array(period)], fields=list(_RUN)
    )
    offsets = pa.array(np.concatenate(([0], np.cumsum(per_text))), pa.int32())
    return pa.StructArray.from_arrays(
        [pa.array(counts), pa.ListArray.from_arrays(offsets, runs), pa.array(collapsed, pa.binary())],
        names=["n_words", "runs", "collapsed"],
    )


def periodic_runs(docs: DataFrame, least: int = 12, text_col: str = "text") -> DataFrame:
    """``docs`` as struct ``row``, with ``n_words``, ``runs`` (start, length and
    smallest period of each run, in words, by start, then period) and
    ``collapsed``: the words that no run holds after its first period, joined
    by one space.

    Words are what white space (tab to carriage return, and the space) leaves.
    A run has ``least`` words or more, two periods at least, and no
    neighbouring word extends it. Null and blank texts have no words, no runs
    and an empty collapsed text; whole texts are searched, however long;
    repeated rows each come out; rows without an id are rows like any other;
    names of other columns cannot clash; an empty table gives an empty result.
    Nothing is shuffled."""
    ship_package(docs.sparkSession)

    @F.arrow_udf(RESULT)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch.to_pylist()
            found = [runs_of_texts(texts[a:z], least) for a, z in chunks(texts)]
            yield pa.concat_arrays(found or [runs_of_texts([], least)])

    text = F.coalesce(docs[text_col], F.lit("")).cast("binary")
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), find(text).alias("f"))
    return out.select("row", "f.n_words", "f.runs", F.col("f.collapsed").cast("string").alias("collapsed"))
