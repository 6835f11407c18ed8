"""How far the sources of a language differ in their words.

Terms of every language are counted by source. The vocabulary of a language is
cut into blocks of bounded size; each block is a table of run-length columns:
terms are reordered so that equal counts stand together (columns of few
different counts sort first), each source's column is cut into runs of equal
count, and for each pair of sources the run boundaries are intersected, so that
the divergence of a pair is one value for each common run times its length.
Everything is whole numbers, so sums do not depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, land, ship_package
from .common import chunks

SCALE = 10**9
#: Terms times sources of a block of the vocabulary.
BLOCK_CELLS = 250_000
#: Different terms of different sources that a task counts before it passes them on.
MOST_HELD = 500_000

#: Bytes of terms: letters, in lower case, and all bytes of further characters.
_TO_TERM = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


class _Counter:
    """Terms of texts by group, counted until they are taken."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.empty()

    def empty(self) -> None:
        self.terms: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, groups: list[tuple[str, str]], texts: list[bytes]) -> None:
        cut = [t.translate(_TO_TERM).split() if t else [] for t in texts]
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        terms = self.terms
        number = np.fromiter(
            (terms.setdefault(w, len(terms)) for c in cut for w in c), np.int64, int(counts.sum())
        )
        group = np.fromiter((self.groups.setdefault(g, len(self.groups)) for g in groups), np.int64, len(groups))
        text = np.repeat(np.arange(len(cut)), counts)
        in_text, times = np.unique((text << 32) | number, return_counts=True)
        keys = (group[in_text >> 32] << 32) | (in_text & 0xFFFFFFFF)
        self.parts.append((keys, times, np.ones(len(keys), np.int64)))
        self.held += len(keys)
        if self.held > 2 * MOST_HELD:
            self._combine()

    def _combine(self) -> None:
        keys, times, texts = (np.concatenate(x) for x in zip(*self.parts))
        keys, at = np.unique(keys, return_inverse=True)
        sums = [np.bincount(at, x, len(keys)).astype(np.int64) for x in (times, texts)]
        self.parts, self.held = [(keys, *sums)], len(keys)

    @property
    def full(self) -> bool:
        return self.held > MOST_HELD or len(self.terms) > MOST_HELD

    def take(self) -> pa.RecordBatch:
        if self.parts:
            self._combine()
            keys, times, texts = self.parts[0]
        else:
            keys = times = texts = np.zeros(0, np.int64)
        names, terms = list(self.groups), pa.array(list(self.terms), pa.binary())
        group = pa.array(keys >> 32)
        out = pa.record_batch(
            [
                pa.array([g[0] for g in names], pa.string()).take(group),
                pa.array([g[1] for g in names], pa.string()).take(group),
                terms.take(pa.array(keys & 0xFFFFFFFF)),
                pa.array(times), pa.array(texts),
            ],
            names=["lang", "source", "term", "n", "texts"],
        )
        self.empty()
        return out


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, term, source, n, texts)``: how often each source of a language
    has a term, and in how many rows. Nulls count as empty. Counted in the tasks
    first, so a source with a third of all rows sends no more than another."""
    ship_package(docs.sparkSession)
    rows = docs.select(
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            groups = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
            for a, z in chunks(texts):
                counter.add(groups[a:z], texts[a:z])
                if counter.full:
                    yield counter.take()
        yield counter.take()

    found = rows.mapInArrow(count, "lang string, source string, term binary, n long, texts long")
    found = found.withColumn("term", F.col("term").cast("string"))
    # dealt by (lang, term), which serves the sum by source and all that follows
    return found.repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("texts").alias("texts")
    )


def share(n: Column | str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), in whole numbers."""
    return F.expr(f"1 + (cast({SCALE} as decimal(12,0)) * ({n} + 2)) div ({total} + 2 * {terms})")


def _runs(column: np.ndarray) -> np.ndarray:
    """Where the runs of equal counts start."""
    return np.flatnonzero(np.concatenate(([True], column[1:] != column[:-1])))


def pair_values(counts: np.ndarray, totals: list[int], n_terms: int) -> Iterator[tuple[int, int, int]]:
    """``(i, j, value)`` for all pairs of columns of ``counts`` (a row a term):
    the sum over the terms of (p - q)^2 / (p + q), rounded down for each term,
    where p and q are the shares of a count in its column's ``total``."""
    if len(counts):
        different = [len(np.unique(c)) for c in counts.T]
        by = sorted(range(counts.shape[1]), key=lambda c: (different[c], c))
        counts = counts[np.lexsort(counts.T[by[::-1]])]
    starts, shares = [], []
    for column, total in zip(counts.T, totals):
        if not len(counts):
            continue
        at = _runs(column)
        values, which = np.unique(column[at], return_inverse=True)
        p = [1 + SCALE * (v + 2) // (total + 2 * n_terms) for v in values.tolist()]
        starts.append(at)
        shares.append(np.array(p, np.int64)[which])
    for i, j in combinations(range(len(totals)), 2):
        if not len(counts):
            yield i, j, 0
            continue
        at = np.union1d(starts[i], starts[j])
        p = shares[i][np.searchsorted(starts[i], at, "right") - 1]
        q = shares[j][np.searchsorted(starts[j], at, "right") - 1]
        length = np.diff(at, append=len(counts))
        yield i, j, int(((p - q) * (p - q) // (p + q) * length).sum())


def divergence(docs: DataFrame, least_texts: int = 10, top: int = 10) -> DataFrame:
    """The audit of ``docs`` (lang, source, text; further columns are not read):
    ``(lang, source, part, item, value, rank)``.

    Terms are letters A-Z in lower case and characters beyond ASCII; a language
    keeps the terms of at least ``least_texts`` of its rows. With p the share of
    a term in a source (see :func:`share`), q its share in the other, ``pair``
    gives each other source of the language and the sum of
    (p - q)^2 / (p + q) over the kept terms; ``term`` the ``top`` terms of a
    source that are more frequent there than in its language, by the same
    measure. Ranks go by value, then by item.

    Nulls count as empty: an empty language and an empty source are groups of
    their own. A source without a term has all counts 0; a language that keeps
    no term has pairs of value 0 and no terms. Repeated rows count as often as
    they come; an empty table gives an empty result."""
    by = Window.partitionBy("lang", "term")
    counts = term_counts(docs).withColumn("seen", F.sum("texts").over(by)).filter(F.col("seen") >= least_texts)
    kept = land(
        counts.select(
            "lang", "term", "source", "n", F.sum("n").over(by).alias("n_lang"),
            (F.row_number().over(by.orderBy("source")) == 1).cast("long").alias("first"),
        ), "terms",
    )
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("first").alias("terms"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = land(
        groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0), "groups"
    )

    # pairs: every block of a language's vocabulary with all of its sources
    sizes = groups.groupBy("lang").agg(
        F.ceil(F.greatest(F.lit(1), F.max("terms") * F.count("*")) / BLOCK_CELLS).alias("blocks")
    )
    sizes, _ = broadcast_if_small(sizes)  # a row a language
    dealt = kept.join(sizes, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
    sources = groups.join(sizes, "lang").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

    def block(terms: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        names = sources.source.to_numpy()
        column = pd.Index(names).get_indexer(terms.source)
        row, _ = pd.factorize(terms.term)
        table = np.zeros((int(row.max(initial=-1)) + 1, len(names)), np.int64)
        table[row, column] = terms.n
        lang, n_terms = sources.lang.iloc[0], int(sources.terms.iloc[0])
        out = [(lang, names[i], names[j], v) for i, j, v in pair_values(table, sources.total.tolist(), n_terms)]
        found = pd.DataFrame(out, columns=["lang", "source", "item", "value"])
        swapped = found.rename(columns={"source": "item", "item": "source"})
        return pd.concat([found, swapped])[["lang", "source", "item", "value"]]

    ship_package(docs.sparkSession)
    pairs = (
        dealt.select("lang", "block", "term", "source", "n").groupBy("lang", "block")
        .cogroup(sources.select("lang", "block", "source", "total", "terms").groupBy("lang", "block"))
        .applyInPandas(block, "lang string, source string, item string, value long")
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        .withColumn("part", F.lit("pair"))
    )
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))

    # terms: shares in the source against shares in the language
    small, _ = broadcast_if_small(groups)
    both = kept.join(small, ["lang", "source"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        share("n", "total", "terms").alias("p"), share("n_lang", "lang_total", "terms").alias("q"),
    ).filter("p > q")
    terms = both.withColumn("value", F.expr("((p - q) * (p - q)) div (p + q)"))
    terms = terms.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(columns).unionByName(terms.select(columns))
