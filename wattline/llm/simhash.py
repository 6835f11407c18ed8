"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints of 64 bits link when they differ in few bits. The bits are
grouped into partitions, correlated bits together; partition ``g`` gets its
own threshold ``T_g``, with the sum of all ``T_g + 1`` equal to ``distance + 1``.
Two fingerprints within ``distance`` must then differ in at most ``T_g`` bits
of some partition, else they would differ in more than ``distance`` bits in
all. The thresholds are chosen by dynamic programming on the estimated number
of probes and candidates; every candidate is verified on all 64 bits, so the
choice changes the cost, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import land, ship_package
from .common import attach_groups, one_row_per_key
from .components import components

BITS = 64
SEED = 42
# relative costs: a probe row that is shuffled, a candidate that is verified
PROBE_COST, VERIFY_COST = 1.0, 0.03


def fingerprint(text: str | None, width: int = 4) -> int:
    """Signed 64-bit SimHash of the word shingles of one text (null: empty)."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = np.array([digest(joined, SEED)], np.uint64)
    else:
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts = [0, *(gaps[: len(words) - width] + 1).tolist()]
        ends = [*gaps[width - 1 :].tolist(), len(joined)]
        hashes = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], np.uint64, len(starts))
    # bit counts: the 8 bits of each byte position, for all hashes at once
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int, *more: Column) -> DataFrame:
    """(id, fp) and ``more`` of every row of ``docs``."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return docs.select(F.col(id_col).alias("id"), prints(F.col(text_col)).alias("fp"), *more)


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for every two bits, in how many both are 1
    (64 × 64 sums over all rows, combined by task)."""

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            fps = b["fp"].to_numpy(np.int64)
            for i in range(0, len(fps), 65536):
                raw = np.ascontiguousarray(fps[i : i + 65536]).view(np.uint8).reshape(-1, 8)
                bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
                n += len(bits)
        at = np.arange(BITS * BITS + 1)
        yield pd.DataFrame({"at": at, "n": np.append(total.ravel(), n).astype(np.int64)})

    got = prints.select("fp").mapInPandas(counts, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for r in got:
        flat[r["at"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """``parts`` groups of about equal size, each grown from the most
    correlated free bit by the bits most correlated with the group."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for g in range(parts):
        size = BITS // parts + (g < BITS % parts)
        group = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())]
        free.discard(group[0])
        while len(group) < size:
            nxt = max(sorted(free), key=lambda b: corr[b, group].sum())
            group.append(nxt)
            free.discard(nxt)
        groups.append(sorted(group))
    return groups


def distance_odds(n: int, both: np.ndarray, group: list[int], most: int) -> list[float]:
    """Estimated chance that two fingerprints differ in at most 0..most bits
    of ``group``: bits taken as independent, then raised to the share of the
    group's bits that its correlations leave effective."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = (both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    sub = corr[np.ix_(group, group)].copy()
    np.fill_diagonal(sub, 1)
    effective = len(group) / float((sub**2).sum())  # 1 if uncorrelated, 1 / size if all alike
    odds = np.zeros(most + 1)
    odds[0] = 1.0
    for b in group:
        q = 2 * p[b] * (1 - p[b])
        odds = odds * (1 - q) + np.concatenate(([0.0], odds[:-1])) * q
    return [min(1.0, max(float(x), 1e-300)) ** effective for x in np.cumsum(odds)]


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds of least total cost whose ``T + 1`` sum to ``budget``.

    ``costs[g][e]`` is the cost of threshold ``e`` in partition ``g``; the
    threshold -1 (partition unused) is free."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for e in range(-1, budget - used):
                option = (total + (cost[e] if e >= 0 else 0.0), [*chosen, e])
                if used + e + 1 not in nxt or option < nxt[used + e + 1]:
                    nxt[used + e + 1] = option
        best = nxt
    return best[budget]


def plan(n: int, both: np.ndarray, distance: int) -> list[tuple[int, int, list[int]]]:
    """(partition, threshold, bits) to probe, for the number of partitions and
    thresholds of least estimated cost."""
    best: tuple[float, list] | None = None
    for parts in range(2, distance + 2):
        groups = grouped_bits(n, both, parts)
        costs = []
        for g in groups:
            odds = distance_odds(n, both, g, distance)
            balls = np.cumsum([comb(len(g), e) for e in range(distance + 1)])
            costs.append([PROBE_COST * n * float(balls[e]) + VERIFY_COST * n * n * odds[e] for e in range(distance + 1)])
        total, chosen = allocate(costs, distance + 1)
        if best is None or total < best[0]:
            best = (total, [(g, t, groups[g]) for g, t in enumerate(chosen) if t >= 0])
    return best[1] if best else [(0, distance, list(range(BITS)))]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def probe_masks(parts: list[tuple[int, int, list[int]]]) -> list[tuple[int, int, int]]:
    """(partition, bit mask, flips) of every probe of a fingerprint."""
    out = []
    for g, threshold, bits in parts:
        mask = _signed(sum(1 << b for b in bits))
        for e in range(threshold + 1):
            out += [(g, mask, _signed(sum(1 << b for b in flips))) for flips in combinations(bits, e)]
    return out


def links(prints: DataFrame, distance: int) -> DataFrame:
    """(u, v) for all pairs of different fingerprints in ``prints(fp)``
    (distinct) that differ in at most ``distance`` bits, u < v."""
    parts = plan(*bit_statistics(prints), distance)
    masks = probe_masks(parts)

    def keyed(which: list[tuple[int, int, int]], name: str) -> DataFrame:
        shapes = F.expr(
            "array(" + ",".join(f"named_struct('g',{g},'mask',{_long(m)},'flips',{_long(f)})" for g, m, f in which) + ")"
        )
        x = prints.select(F.col("fp").alias(name), F.explode(shapes).alias("s"))
        return x.select("s.g", F.col(name).bitwiseAND(F.col("s.mask")).bitwiseXOR(F.col("s.flips")).alias("key"), name)

    probes = keyed(masks, "u")
    index = keyed([m for m in masks if m[2] == 0], "v")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance
    found = probes.join(index, (probes["g"] == index["g"]) & (probes["key"] == index["key"]) & (F.col("u") < F.col("v")) & near)
    return found.select("u", "v").distinct()


def _long(x: int) -> str:
    """SQL text of a 64-bit integer (its minimum has no literal form)."""
    return "(-9223372036854775807L - 1L)" if x == -(1 << 63) else f"{x}L"


def _rooted(prints: DataFrame, distance: int, *values: Column) -> DataFrame:
    """One row per fingerprint: fp, the aggregates ``values`` of its rows, and
    the ``root`` of its component."""
    nodes = land(prints.groupBy("fp").agg(*values), "simhash-nodes")
    rooted = components(links(nodes.select("fp"), distance))
    return nodes.join(rooted, nodes["fp"] == rooted["node"], "left").withColumn("root", F.coalesce("root", "fp"))


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4
) -> DataFrame:
    """One row per input row: id, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id reachable over links of fingerprints
    that differ in at most ``distance`` bits.

    Null and empty texts have fingerprint zero, linked like any other; a text
    of fewer than ``width`` words is one shingle. Equal fingerprints are one
    node however many rows hold them. A null id never names a component unless
    all its ids are null. Repeated rows each come out; an empty table gives
    an empty result; other columns are not read."""
    prints = land(with_fingerprints(docs, id_col, text_col, width), "simhash-prints")
    joined = _rooted(prints, distance, F.min("id").alias("least"), F.count("*").alias("n"))
    names = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = land(joined.join(names, "root").select("fp", "n", "component_id"), "simhash-groups")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    groups = groups.withColumn("key", F.col("fp").cast("string").cast("binary"))
    spread = F.concat(F.lit("-").cast("binary"), F.coalesce(F.col("id"), F.lit(0)).cast("string").cast("binary"))
    out = attach_groups(
        prints.withColumn("key", F.col("fp").cast("string").cast("binary")), "key", groups, "n", ["component_id"], spread, total
    )
    return out.select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_simhash(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4
) -> DataFrame:
    """The rows of ``docs``, all columns, of which one of each group of near
    duplicates stays: the one with the smallest id, a row without id only where
    none has one. Of a group's rows that repeat that id, the least by the digest
    of id and text stays, then by all columns; rows that share an id alone are
    not copies."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\0"), text).cast("binary"), 256))
    prints = land(with_fingerprints(docs, id_col, text_col, width, key.alias("key")), "simhash-prints")
    joined = _rooted(prints, distance, F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"))
    stay = joined.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias("stay"))
    rows = docs.select(key.alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return one_row_per_key(rows.join(stay, rows["key"] == stay["stay"], "left_semi"), ["key"], "row")
