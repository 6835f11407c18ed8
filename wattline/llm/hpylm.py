"""Language-model scoring with a hierarchical Pitman-Yor model.

The model generates the lower-cased words of a text letter by letter (bytes; a
space ends a word, a line feed the text), each from the restaurant of the
preceding ORDER - 1 bytes. Restaurants share parents: the parent of a context
is the context without its oldest byte, down to one restaurant without
context over a uniform base. Seating is sampled by Gibbs: all customers of a
dish are seated anew at once, the number of their tables drawn from its
conditional distribution (module ``stirling``), however many customers there
are; each table is a customer of the parent. Predictive probabilities need the
numbers of customers and tables only, and are averaged over several samples.
Every text has a probability, whatever its words.

Layout. Contexts are dealt to buckets by their last two bytes, so a context
and its ancestors of two bytes or more are in one bucket; only contexts of one
byte or none (at most 257 restaurants of at most 256 dishes) are shared, and
sampled by the driver between sweeps. Documents are dealt to blocks by a hash
and the partition that holds them, so copies of one row are spread. A block asks
for the probabilities of its distinct n-grams and the counts of its words. Its
requests go to cells, which split a bucket further by the older bytes of the
context; a cell combines the requests of all blocks, the buckets seat and answer
the distinct n-grams alone, and the cells give each block its answers, which
meet the block's texts once more. Nothing that grows with the corpus is
broadcast or collected.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import land, remove_landed, ship_package
from .common import chunks
from .stirling import stirling

ORDER = 6  # bytes of an n-gram: five of context and the one predicted (more do not fit summed_by_text)
SHARED = 1  # contexts of so many bytes or fewer are sampled by the driver
STRENGTH = 1.0
SWEEPS, KEPT = 4, 2  # Gibbs sweeps, and how many of the last ones are averaged
SETTLE = 7  # steps of the search for a start
ROUNDS = 2  # draws of all dishes of a restaurant in a sweep
BLOCK_BYTES = 8 << 20  # text of a block, on average
CHUNK_CHARS = 1_000_000  # text of a block that is cut up at a time
BASE = 1.0 / 257

_NGRAMS, _WORDS = 0, 1
_END = ord("\n")
_PARTS = "kind int, cell int, block int, keys binary, counts binary"
_COMBINED = "kind int, bucket int, cell int, keys binary, counts binary"
MOST_BUCKETS = 512  # of restaurants; their size levels off as the n-grams of five bytes are seen
MOST_TASKS = 20_000  # of a stage
OLDER = 16  # parts of a two-byte context, by the bytes before it


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """Shuffle files go as soon as the job that made them is done."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _land(df: DataFrame, name: str) -> DataFrame:
    with _shuffles_removed(df.sparkSession):
        return land(df, name)


def _mask(level: int) -> np.uint64:
    """Of an n-gram key: the last ``level`` bytes of context and the symbol."""
    return np.uint64((1 << 8 * (level + 1)) - 1)


# ---------------------------------------------------------------- texts


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def ngrams(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (bytes of context and symbol, the oldest byte highest) of all
    n-grams of the texts (as words) in turn, and the number of each text."""
    pad = bytes([_END]) * (ORDER - 1)
    parts = [pad + b" ".join(w) + (b" \n" if w else b"\n") for w in texts]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    raw = b"".join(parts) + bytes(8)
    # eight bytes from every place on, the oldest highest, of which ORDER count
    every = np.ndarray((len(raw) - 8,), ">u8", raw, 0, (1,)).astype(np.uint64)
    every >>= np.uint64(64 - 8 * ORDER)
    ends = np.cumsum(size)
    beyond = (ends[:, None] - np.arange(ORDER - 1, 0, -1)).ravel()  # would reach into the next text
    return np.delete(every, beyond), size - (ORDER - 1)


_TEXT_END = b"\n"  # the end token; no word has white space
_SHORT = 256  # bytes of a word that is hashed in arrays
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n bytes of eight


def _mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each token of all texts in turn (each text's last is its
    end), and the number of tokens of each: eight bytes at a time, all tokens side
    by side; long words by XXH3."""
    raw = b"".join(b" ".join([*w, _TEXT_END, b""]) for w in texts)
    after = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32) + 1  # a token ends in a space, and has no other
    start = np.concatenate((np.zeros(min(1, len(after)), np.int64), after[:-1]))
    window = np.ndarray((len(raw),), "<u8", raw + bytes(8), 0, (1,))  # eight bytes from every place on
    hashes, left, at, size = np.zeros(len(start), np.uint64), np.arange(len(start)), start, after - start
    for _ in range(0, _SHORT, 8):
        hashes[left] = _mixed(hashes[left] ^ (window[at] & _FIRST[np.minimum(size, 8)]))
        more = size > 8
        left, at, size = left[more], at[more] + 8, size[more] - 8
    for i in left.tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(raw[start[i] : after[i]])
    return hashes, np.fromiter((len(w) + 1 for w in texts), np.int64, len(texts))


def bucket_of_ngrams(keys: np.ndarray, buckets: int) -> np.ndarray:
    """By the last two bytes of context."""
    two = (keys >> np.uint64(8)) & np.uint64(0xFFFF)
    return (((two * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def cell_of_ngrams(keys: np.ndarray, cells: int) -> np.ndarray:
    """By the last two bytes of context, and a hash of the two before them."""
    two = (keys >> np.uint64(8)) & np.uint64(0xFFFF)
    older = ((keys >> np.uint64(24)) & np.uint64(0xFFFF)) * np.uint64(0xD6E8FEB86659FD93)
    part = (older >> np.uint64(37)) % np.uint64(OLDER)
    mixed = (two * np.uint64(OLDER) + part) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(40)) % np.uint64(cells)).astype(np.int64)


def cell_of_words(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)


def _starts(ascending: np.ndarray) -> np.ndarray:
    """Where the runs of equal values start."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(ascending)), bool), ascending[1:] != ascending[:-1])))


def distinct_counts(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram keys, ascending, and how many of each are marked: one sort
    of keys with the mark as their last bit."""
    marked = (keys << np.uint64(1)) | train.astype(np.uint64)
    marked.sort()
    keys = marked >> np.uint64(1)
    first = _starts(keys)
    return keys[first], np.add.reduceat((marked & np.uint64(1)).astype(np.int64), first)


def looked_up(keys: np.ndarray, known: np.ndarray | pd.Index, values: np.ndarray) -> np.ndarray:
    """The value of each of ``keys``, all of which are in ``known`` (distinct)."""
    known = known if isinstance(known, pd.Index) else pd.Index(known)
    return values[known.get_indexer(keys)]


def summed_by_text(keys: np.ndarray, lengths: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each text the sum of the values of its keys (below 2^48, all of which are in
    ``known``, ascending): keys are sorted together with the numbers of their texts."""
    out, ends = np.zeros(len(lengths)), np.cumsum(lengths)
    for a in range(0, len(lengths), 1 << 16):
        own = lengths[a : a + (1 << 16)]
        part = keys[ends[a] - own[0] : ends[a + len(own) - 1]] << np.uint64(16)
        part |= np.repeat(np.arange(len(own), dtype=np.uint64), own)
        part.sort()
        sorted_keys = part >> np.uint64(16)
        first = _starts(sorted_keys)
        found = np.repeat(values[np.searchsorted(known, sorted_keys[first])], np.diff(first, append=len(part)))
        out[a : a + len(own)] = np.bincount((part & np.uint64(0xFFFF)).astype(np.int64), found, len(own))
    return out


def block_requests(texts: list[str | None], train: np.ndarray, cells: int) -> list[tuple]:
    """(kind, cell, keys, counts) of the distinct n-grams and tokens of a
    block of texts, ascending by key within a cell; counts are those in
    texts marked ``train``."""
    found: dict[int, list[tuple]] = {_NGRAMS: [], _WORDS: []}
    for a, z in chunks(texts, CHUNK_CHARS):  # helper arrays of a chunk, not of a block
        split = [words_of(t) for t in texts[a:z]]
        hashes, lengths = tokens(split)
        marked = np.repeat(train[a:z], lengths)
        found[_WORDS].append(np.unique(hashes[marked], return_counts=True))
        held = np.unique(hashes[~marked])
        found[_WORDS].append((held, np.zeros(len(held), np.int64)))
        keys, lengths = ngrams(split)
        found[_NGRAMS].append(distinct_counts(keys, np.repeat(train[a:z], lengths)))
    out = []
    for kind, cell_of in ((_NGRAMS, cell_of_ngrams), (_WORDS, cell_of_words)):
        if found[kind]:
            keys, counts = _summed(*map(np.concatenate, zip(*found[kind])))
            out += [(kind, *r) for r in _dealt(keys, counts, cell_of(keys, cells))]
    return out


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of the counts of each."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _dealt(keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> Iterator[tuple]:
    # numbers of 16 bits are sorted by radix
    order = np.argsort(bucket.astype(np.uint16) if bucket.max(initial=0) < 1 << 16 else bucket, kind="stable")
    keys, counts, bucket = keys[order], counts[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for k, c, b in zip(np.split(keys, cuts), np.split(counts, cuts), np.split(bucket, cuts)):
        if len(k):
            # 64 bits where a count needs them
            form = "<u4" if int(c.max()) < 1 << 32 else "<u8"
            yield int(b[0]), k.astype("<u8").tobytes(), c.astype(form).tobytes()


def _counts(keys: bytes, counts: bytes) -> np.ndarray:
    return np.frombuffer(counts, "<u4" if len(counts) < len(keys) else "<u8").astype(np.int64)


# ---------------------------------------------------------------- seating


class Seats:
    """Numbers of customers and of tables of a set of dishes."""

    def __init__(self, customers: np.ndarray, tables: np.ndarray):
        self._customers, self._tables = customers.astype(np.int64), tables.astype(np.int64)

    @classmethod
    def one_table_each(cls, customers: np.ndarray) -> Seats:
        return cls(customers, np.minimum(customers, 1))

    def customers(self) -> np.ndarray:
        return self._customers

    def tables(self) -> np.ndarray:
        return self._tables


class Level:
    """Restaurants whose contexts have ``level`` bytes."""

    def __init__(self, level: int, keys: np.ndarray, seats: Seats, discount: float, strength: float = STRENGTH):
        self.level, self.keys, self.seats = level, keys, seats
        self.discount, self.strength = discount, strength
        self.contexts, self.house = np.unique(keys >> np.uint64(8), return_inverse=True)

    def _totals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        c, t = self.seats.customers(), self.seats.tables()
        n = len(self.contexts)
        return c, t, np.bincount(self.house, weights=c, minlength=n), np.bincount(self.house, weights=t, minlength=n)

    def predictive(self, parent: np.ndarray) -> np.ndarray:
        """Probability of each dish, given those of its parents' dishes."""
        c, t, cu, tu = self._totals()
        d, s = self.discount, self.strength
        return (c - d * t + (s + d * tu[self.house]) * parent) / (s + cu[self.house])

    def predict(self, keys: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Probability of any n-gram keys, seen or not."""
        want = keys & _mask(self.level)
        if not len(self.keys):
            return parent
        c, t, cu, tu = self._totals()
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        dish = self.keys[at] == want
        house = np.minimum(np.searchsorted(self.contexts, want >> np.uint64(8)), len(self.contexts) - 1)
        known = self.contexts[house] == want >> np.uint64(8)
        d, s = self.discount, self.strength
        own = np.where(dish, c[at] - d * t[at], 0.0)
        return np.where(known, (own + (s + d * tu[house]) * parent) / (s + cu[house]), parent)

    def adjust(self, customers: np.ndarray) -> None:
        """Each dish has ``customers``, until the next sweep at as many tables
        as before if they fill them."""
        least = np.minimum(customers, 1)
        self.seats = Seats(customers, np.clip(self.seats.tables(), least, customers))

    def sweep(self, parent: np.ndarray, rng: np.random.Generator) -> None:
        """Gibbs rounds: in each, all customers of every dish are seated anew.

        The seatings of a restaurant's dishes weigh S(c, t) (d p)^t each and
        Gamma(s / d + all tables) together. Given a gamma variable g of that
        shape the dishes are independent, with weights S(c, t) (d g p)^t: so
        all but the largest dish are drawn; then the largest, given the tables
        of the others, without g."""
        weights, d = stirling(self.discount), self.discount
        c, t, n = self.seats.customers(), self.seats.tables().copy(), len(self.contexts)
        log_x = np.log(d * parent)
        order = np.lexsort((c, self.house))
        last = np.append(np.diff(self.house[order]) != 0, np.ones(min(1, len(order)), bool))
        chief, rest = order[last], order[~last]
        chief, rest = chief[c[chief] > 1], rest[c[rest] > 1]
        for _ in range(ROUNDS if len(rest) else 1):
            if len(rest):
                total = np.bincount(self.house, weights=t, minlength=n)
                g = np.log(rng.standard_gamma(self.strength / d + total))
                t[rest] = weights.draw(c[rest], log_x[rest] + g[self.house[rest]], rng)
            total = np.bincount(self.house, weights=t, minlength=n)
            others = self.strength / d + total[self.house[chief]] - t[chief]
            t[chief] = weights.draw(c[chief], log_x[chief], rng, others)
        self.seats = Seats(c, t)

    def settle(self, parent: np.ndarray, rng: np.random.Generator) -> None:
        """A start near which sweeps stay: by bisection, for each restaurant
        the g at which the tables drawn given g are as many as g stands for."""
        weights, d = stirling(self.discount), self.discount
        c, t, n = self.seats.customers(), self.seats.tables().copy(), len(self.contexts)
        base = self.strength / d
        many = np.flatnonzero((c > 1) & (np.bincount(self.house, weights=c > 0, minlength=n)[self.house] > 1))
        log_x = np.log(d * parent)
        lo = np.log(base + np.bincount(self.house, weights=np.minimum(c, 1), minlength=n))
        hi = np.log(base + np.bincount(self.house, weights=c, minlength=n))
        for _ in range(SETTLE if len(many) else 0):
            g = (lo + hi) / 2
            t[many] = weights.draw(c[many], (log_x + g[self.house])[many], rng)
            more = np.log(base + np.bincount(self.house, weights=t, minlength=n)) > g
            lo, hi = np.where(more, g, lo), np.where(more, hi, g)
        self.seats = Seats(c, t)


class Subtree:
    """The restaurants of one bucket (contexts of more than SHARED bytes), the
    longest contexts first."""

    def __init__(self, levels: list[Level]):
        self.levels = levels
        self.parents = [
            np.searchsorted(b.keys, a.keys & _mask(b.level)) for a, b in zip(levels, levels[1:])
        ]

    @classmethod
    def first(cls, keys: np.ndarray, counts: np.ndarray, discounts: list[float]) -> Subtree:
        """One table for each dish of each restaurant."""
        levels, customers = [], counts
        for level in range(ORDER - 1, SHARED, -1):
            levels.append(Level(level, keys, Seats.one_table_each(customers), discounts[level]))
            keys, customers = np.unique(keys & _mask(level - 1), return_counts=True)
        return cls(levels)

    def predictives(self, shared: np.ndarray) -> list[np.ndarray]:
        """For each level the probabilities of its dishes' parents."""
        last = self.levels[-1]
        parent = [shared[(last.keys & _mask(SHARED)).astype(np.int64)]]
        for i in range(len(self.levels) - 1, 0, -1):
            parent.append(self.levels[i].predictive(parent[-1])[self.parents[i - 1]])
        return parent[::-1]

    def sweep(self, shared: np.ndarray, rng: np.random.Generator, start: bool = False) -> None:
        parent = self.predictives(shared)
        for i, level in enumerate(self.levels):
            if i:  # the tables just drawn
                above = self.levels[i - 1].seats.tables()
                level.adjust(np.bincount(self.parents[i - 1], weights=above, minlength=len(level.keys)).astype(np.int64))
            if start:
                level.settle(parent[i], rng)
            level.sweep(parent[i], rng)

    def to_shared(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and numbers of the customers sent to the shared restaurants."""
        last = self.levels[-1]
        keys, at = np.unique(last.keys & _mask(SHARED), return_inverse=True)
        return keys.astype(np.int64), np.bincount(at, weights=last.seats.tables(), minlength=len(keys)).astype(np.int64)

    def predict(self, keys: np.ndarray, shared: np.ndarray) -> np.ndarray:
        p = shared[(keys & _mask(SHARED)).astype(np.int64)]
        for level in reversed(self.levels):
            p = level.predict(keys, p)
        return p

    def packed(self) -> bytes:
        parts = []
        for x in self.levels:
            parts += [x.keys.astype("<u8"), x.seats.customers().astype("<i8"), x.seats.tables().astype("<i8")]
        head = np.array([len(p) for p in parts], "<i8")
        return zlib.compress(head.tobytes() + b"".join(p.tobytes() for p in parts), 1)

    @classmethod
    def unpacked(cls, blob: bytes, discounts: list[float]) -> Subtree:
        raw = zlib.decompress(blob)
        n = 3 * (ORDER - 1 - SHARED)
        head, at, levels = np.frombuffer(raw, "<i8", n).tolist(), 8 * n, []
        for i, level in enumerate(range(ORDER - 1, SHARED, -1)):
            arrays = []
            for size, kind in zip(head[3 * i : 3 * i + 3], ("<u8", "<i8", "<i8")):
                arrays.append(np.frombuffer(raw, kind, size, at).copy())
                at += arrays[-1].nbytes
            keys, customers, tables = arrays
            levels.append(Level(level, keys, Seats(customers, tables), discounts[level]))
        return cls(levels)


class SharedRestaurants:
    """Contexts of one byte and of none: a table of constant size."""

    def __init__(self):
        self.one: Level | None = None
        self.none: Level | None = None

    def sample(self, customers: np.ndarray, discounts: list[float], rng: np.random.Generator) -> np.ndarray:
        """Take the ``customers`` of each one-byte dish (65,536 numbers),
        sample, and return the probability of each."""
        if self.one is None:
            # every dish begins with one table
            self.one = Level(1, np.arange(1 << 16, dtype=np.uint64), Seats.one_table_each(customers), discounts[1])
            up = np.bincount(np.arange(1 << 16) & 255, weights=np.minimum(customers, 1), minlength=256)
            self.none = Level(0, np.arange(256, dtype=np.uint64), Seats.one_table_each(up), discounts[0])
        below = np.arange(1 << 16) & 255
        uniform = np.full(256, BASE)
        self.one.adjust(customers)
        self.one.sweep(self.none.predictive(uniform)[below], rng)
        self.none.adjust(np.bincount(below, weights=self.one.seats.tables(), minlength=256).astype(np.int64))
        self.none.sweep(uniform, rng)
        return self.one.predictive(self.none.predictive(uniform)[below])


# ---------------------------------------------------------------- jobs


def _merged(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all rows of ``group``, and their training counts."""
    keys = np.frombuffer(b"".join(group["keys"]), "<u8").astype(np.uint64)
    return _summed(keys, np.concatenate([_counts(k, c) for k, c in zip(group["keys"], group["counts"])]))


def _dealt_by(df: DataFrame, tasks: int, *keys: str):
    """``df`` grouped by ``keys`` over as many tasks as there are groups to deal, so
    that a task's share does not grow with the input."""
    return df.repartition(min(tasks, MOST_TASKS), *keys).groupBy(*keys)


def _requests(docs: DataFrame, blocks: int, cells: int) -> DataFrame:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row", kind="stable")
        made = block_requests(list(group["text"]), group["train"].to_numpy(bool), cells)
        out = pd.DataFrame(made, columns=["kind", "cell", "keys", "counts"])
        out.insert(2, "block", int(group["block"].iloc[0]))
        return out

    return _dealt_by(docs, blocks, "block").applyInPandas(run, _PARTS)


def _combined(requests: DataFrame, cells: int, buckets: int) -> DataFrame:
    """The requests of all blocks of a cell as one, by bucket."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        kind, cell = int(group["kind"].iloc[0]), int(group["cell"].iloc[0])
        keys, counts = _merged(group)
        bucket = np.full(len(keys), cell % buckets) if kind == _WORDS else bucket_of_ngrams(keys, buckets)
        rows = [(kind, b, cell, k, c) for b, k, c in _dealt(keys, counts, bucket)]
        return pd.DataFrame(rows, columns=["kind", "bucket", "cell", "keys", "counts"])

    return _dealt_by(requests, cells, "kind", "cell").applyInPandas(run, _COMBINED)


_STATE = "bucket int, level int, at int, n long, state binary"


def _first_counts(combined: DataFrame) -> DataFrame:
    """For each bucket: how many dishes of each level have one and two
    customers in the first seating; and numbers of training tokens and words."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _merged(group)
        keys, counts = keys[counts > 0], counts[counts > 0]
        rows = []
        if group["kind"].iloc[0] == _WORDS:
            rows = [(-1, 0, int(counts.sum())), (-1, 1, len(keys))]
        else:
            for level in range(ORDER - 1, SHARED, -1):
                rows += [(level, n, int((counts == n).sum())) for n in (1, 2)]
                keys, counts = np.unique(keys & _mask(level - 1), return_counts=True)
        return pd.DataFrame(rows, columns=["level", "at", "n"])

    return combined.groupBy("kind", "bucket").applyInPandas(run, "level int, at int, n long")


def _rows_of(bucket: int, tree: Subtree) -> pd.DataFrame:
    keys, numbers = tree.to_shared()
    out = pd.DataFrame({"bucket": bucket, "level": SHARED, "at": keys, "n": numbers, "state": None})
    own = pd.DataFrame({"bucket": [bucket], "level": [-1], "at": [0], "n": [0], "state": [tree.packed()]})
    return pd.concat([out, own], ignore_index=True)


def _first_seats(combined: DataFrame, discounts: list[float]) -> DataFrame:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _merged(group)
        tree = Subtree.first(keys[counts > 0], counts[counts > 0], discounts)
        return _rows_of(int(group["bucket"].iloc[0]), tree)

    return combined.filter(F.col("kind") == _NGRAMS).groupBy("bucket").applyInPandas(run, _STATE)


def _swept(states: DataFrame, discounts: list[float], shared: np.ndarray, sweep: int) -> DataFrame:
    table = shared.astype("<f8").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        probabilities = np.frombuffer(table, "<f8")
        for b in batches:
            for bucket, blob in zip(b["bucket"], b["state"]):
                tree = Subtree.unpacked(blob, discounts)
                tree.sweep(probabilities, np.random.default_rng([sweep, int(bucket)]), start=sweep == 0)
                yield _rows_of(int(bucket), tree)

    return states.filter("level = -1").select("bucket", "state").mapInPandas(run, _STATE)


def _customers(states: DataFrame) -> np.ndarray:
    """Customers of the shared restaurants: at most 65,536 numbers."""
    out = np.zeros(1 << 16, np.int64)
    for r in states.filter(F.col("level") == SHARED).groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def _predicted(combined: DataFrame, samples: list[tuple[DataFrame, np.ndarray]], discounts: list[float]) -> DataFrame:
    """(kind, cell, keys, values) of all distinct n-grams and words: averaged
    log10 probabilities (float32), or training counts (unsigned 64-bit)."""
    ngrams = combined.filter(F.col("kind") == _NGRAMS)
    asked = ngrams.select("bucket", "cell", "keys", F.lit(-1).alias("sample"))
    tables = [shared.astype("<f8").tobytes() for _, shared in samples]
    for i, (states, _) in enumerate(samples):
        asked = asked.unionByName(states.filter("level = -1").select(
            "bucket", F.lit(-1).alias("cell"), F.col("state").alias("keys"), F.lit(i).alias("sample")
        ))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        parts, kept = group[group["sample"] < 0], group[group["sample"] >= 0]
        keys = np.frombuffer(b"".join(parts["keys"]), "<u8").astype(np.uint64)
        total = np.zeros(len(keys))
        for blob, i in zip(kept["keys"], kept["sample"]):
            total += Subtree.unpacked(blob, discounts).predict(keys, np.frombuffer(tables[i], "<f8"))
        if len(kept):
            values = np.log10(total / len(kept)).astype("<f4")
        else:  # no training text at all: the base
            values = np.full(len(keys), math.log10(BASE), "<f4")
        ends = np.cumsum([len(k) // 8 for k in parts["keys"]]).tolist()
        rows = [(_NGRAMS, int(c), k, values[a:z].tobytes()) for c, k, a, z in zip(parts["cell"], parts["keys"], [0, *ends], ends)]
        return pd.DataFrame(rows, columns=["kind", "cell", "keys", "values"])

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["values"] = [_counts(k, c).astype("<u8").tobytes() for k, c in zip(b["keys"], b["counts"])]
            yield b[["kind", "cell", "keys", "values"]]

    out = "kind int, cell int, keys binary, values binary"
    words = combined.filter(F.col("kind") == _WORDS).select("kind", "cell", "keys", "counts").mapInPandas(counted, out)
    return asked.groupBy("bucket").applyInPandas(run, out).unionByName(words)


def _answers(requests: DataFrame, predicted: DataFrame, cells: int) -> DataFrame:
    """(kind, block, keys, values): the keys of each request and their values."""

    def run(group: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(group):
            kind = int(group["kind"].iloc[0])
            keys = np.frombuffer(b"".join(got["keys"]), "<u8").astype(np.uint64)
            values = np.frombuffer(b"".join(got["values"]), "<u8" if kind == _WORDS else "<f4")
            order = np.argsort(keys, kind="stable")
            keys, values = keys[order], values[order]
            for block, own in zip(group["block"], group["keys"]):
                at = np.searchsorted(keys, np.frombuffer(own, "<u8").astype(np.uint64))
                rows.append((kind, int(block), own, values[at].tobytes()))
        return pd.DataFrame(rows, columns=["kind", "block", "keys", "values"])

    asked = _dealt_by(requests.select("kind", "cell", "block", "keys"), cells, "kind", "cell")
    known = _dealt_by(predicted, cells, "kind", "cell")
    return asked.cogroup(known).applyInPandas(run, "kind int, block int, keys binary, values binary")


def _scored(docs: DataFrame, answers: DataFrame, blocks: int, n_train: int, n_words: int) -> DataFrame:
    def run(group: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row", kind="stable")
        texts = list(group["text"])

        def answered(kind: int, form: str) -> tuple[np.ndarray, np.ndarray]:
            """The block's distinct keys, ascending, and the answers to them."""
            own = got[got["kind"] == kind]
            keys = np.frombuffer(b"".join(own["keys"]), "<u8").astype(np.uint64)
            order = np.argsort(keys)
            return keys[order], np.frombuffer(b"".join(own["values"]), form)[order].astype(np.float64)

        grams, logs = answered(_NGRAMS, "<f4")
        words, counts = answered(_WORDS, "<u8")
        of_word = np.log10((counts + 1) / (n_train + n_words + 1))
        words, places = pd.Index(words), np.arange(len(words))
        score, base, known, n_tokens = [], [], [], []
        for a, z in chunks(texts, CHUNK_CHARS):
            split = [words_of(t) for t in texts[a:z]]
            keys, lengths = ngrams(split)
            score.append(summed_by_text(keys, lengths, grams, logs))
            hashes, lengths = tokens(split)
            at = looked_up(hashes, words, places)
            starts = np.cumsum(lengths) - lengths
            base.append(np.add.reduceat(of_word[at], starts))
            known.append(np.add.reduceat((counts > 0).astype(np.int64)[at], starts))
            n_tokens.append(lengths)
        return pd.DataFrame({
            "doc_id": group["doc_id"].astype("Int64"), "held_out": ~group["train"].to_numpy(bool), "n_tokens": np.concatenate(n_tokens),
            "n_known": np.concatenate(known), "train_tokens": n_train,
            "base_score": np.concatenate(base), "score": np.concatenate(score),
        })

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _dealt_by(docs, blocks, "block").cogroup(_dealt_by(answers, blocks, "block")).applyInPandas(run, out)


def score_documents(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", sweeps: int = SWEEPS, kept: int = KEPT,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens (words and one end),
    n_known (tokens seen in training), train_tokens, base_score (log10, words
    counted and one added), score (log10 probability of the text).

    Learns from the rows for which ``train`` holds (null: not). Null counts as
    empty, a text of the end alone. A text of any length is scored whole.
    Repeated rows, with or without an id, each come out with equal scores; without
    training text the model is its uniform base; an empty table gives an empty
    result; other columns are not read. ``docs`` is read twice and has to come in
    the same partitions both times, as a scan does."""
    spark = docs.sparkSession
    ship_package(spark)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).head()[0]
    blocks = max(1, math.ceil(size / block_bytes))
    cells = max(4, blocks)
    buckets = min(cells, MOST_BUCKETS)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
        F.coalesce(train, F.lit(False)).alias("train"),
    ).withColumn("row", F.xxhash64("doc_id", "train", "text"))
    # with the partition, so that copies of one row do not meet in one block
    block = F.pmod(F.xxhash64(F.lit("block"), "row", F.spark_partition_id()), F.lit(blocks))
    rows = rows.withColumn("block", block.cast("int"))
    requests = _land(_requests(rows, blocks, cells), "lm-requests")
    combined = _land(_combined(requests, cells, buckets), "lm-combined")
    first = {(r["level"], r["at"]): r["n"] for r in _first_counts(combined).groupBy("level", "at").agg(F.sum("n").alias("n")).collect()}
    n_train, n_words = first.get((-1, 0), 0), first.get((-1, 1), 0)
    # Ney's estimate from the dishes with one and two customers
    discounts = [0.5] * ORDER
    for level in range(SHARED + 1, ORDER):
        one, two = first.get((level, 1), 0), first.get((level, 2), 0)
        discounts[level] = min(0.9, max(0.1, one / (one + 2 * two))) if one else 0.5
    states = _land(_first_seats(combined, discounts), "lm-states")
    house, rng, samples = SharedRestaurants(), np.random.default_rng(11), []
    shared = house.sample(_customers(states), discounts, rng)
    for sweep in range(sweeps):
        before, states = states, _land(_swept(states, discounts, shared, sweep), "lm-states")
        if sweep <= sweeps - kept:  # not one of the samples
            remove_landed(before)
        shared = house.sample(_customers(states), discounts, rng)
        if sweep >= sweeps - kept:
            samples.append((states, shared))
    answers = _land(_answers(requests, _predicted(combined, samples, discounts), cells), "lm-answers")
    remove_landed(requests, combined, *[s for s, _ in samples])
    return _scored(rows, answers, blocks, n_train, n_words)
