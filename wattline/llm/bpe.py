"""Byte-level BPE encoding and decoding.

Every match of the split pattern is encoded by itself. A segment tree over its
byte positions holds, at each live position, the rank of the pair that starts
there; its root is the leftmost pair of least rank. A merge changes the leaves
of the merged position, of the one that vanishes and of the live neighbour to
the left, each updated along a path of logarithmic length. Short pieces of
equal tree size are merged side by side in arrays; long ones one at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import chunks

_FAR = np.int64(1) << 62
SIDE_BY_SIDE = 64  # pieces of at most so many bytes are merged side by side
LONG_UNIT, LONG_PIECE = 256, 16  # in characters: units and pieces longer than this are cut where no token spans
# white space as the pattern's own engine has it (fixed values)
_SPACE = r"\t-\r \x85\xa0  -     　"


def _inside(byte: int) -> bool:
    """Is this a byte within a character, not its first one?"""
    return byte & 0xC0 == 0x80


def _tail(left: bytes) -> bytes:
    """The end of ``left`` that belongs to its last character."""
    i = len(left) - 1
    while i > 0 and _inside(left[i]):
        i -= 1
    return left[i:]


def _head(right: bytes) -> bytes:
    """The start of ``right`` that belongs to its first character."""
    i = 1
    while i < len(right) and _inside(right[i]):
        i += 1
    return right[:i]


class Ranks:
    """A vocabulary of byte strings by rank, and the rank of every pair of
    tokens whose concatenation is a token."""

    def __init__(self, path: str):
        self.rank: dict[bytes, int] = {}
        with open(path, "rb") as fh:
            for line in fh:
                if line.strip():
                    token, rank = line.split()
                    self.rank[base64.b64decode(token)] = int(rank)
        size = max(self.rank.values()) + 1
        self.pair: dict[tuple[int, int], int] = {}
        for token, rank in self.rank.items():
            for i in range(1, len(token)):
                left, right = self.rank.get(token[:i]), self.rank.get(token[i:])
                if left is not None and right is not None:
                    self.pair[left, right] = rank
        self.width = np.int64(size)
        keys = np.array([a * size + b for a, b in self.pair], np.int64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array(list(self.pair.values()), np.int64)[order]
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        # for each place in a token at which a character begins: what the token
        # holds of the character before it, and of the one that begins
        self.joins: set[tuple[bytes, bytes]] = set()
        for token in self.rank:
            for i in range(1, len(token)):
                if not _inside(token[i]):
                    self.joins.add((_tail(token[:i]), _head(token[i:])))
        self.joined: dict[tuple[str, str], bool] = {}
        # all tokens' bytes in one array, for decoding
        tokens = [b""] * size
        for token, rank in self.rank.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)

    def may_join(self, a: str, b: str) -> bool:
        """Does any token hold the end of character ``a`` and the start of ``b``?"""
        found = self.joined.get((a, b))
        if found is None:
            x, y = a.encode("utf-8", "surrogatepass"), b.encode("utf-8", "surrogatepass")
            found = any((x[i:], y[:j]) in self.joins for i in range(len(x)) for j in range(1, len(y) + 1))
            if len(self.joined) > 200_000:
                self.joined.clear()
            self.joined[a, b] = found
        return found

    def parts(self, piece: str) -> list[bytes]:
        """``piece`` cut at all places that no token spans. A merge across
        such a place would make a token that spans it, so the parts are encoded
        as the whole is."""
        known, ask = self.joined.get, self.may_join
        cuts = [i for i, ab in enumerate(zip(piece, piece[1:]), 1) if not (ask(*ab) if (j := known(ab)) is None else j)]
        return [piece[i:j].encode("utf-8", "surrogatepass") for i, j in zip([0, *cuts], [*cuts, len(piece)])]

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, _FAR where there is none."""
        want = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.values[at], _FAR)

    def merge_long(self, piece: bytes) -> list[int]:
        """Tokens of one piece, by a segment tree in plain lists."""
        n = len(piece)
        size = 1 << max(1, (n - 1).bit_length())
        token = [int(self.byte[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        far, pair = int(_FAR), self.pair.get
        tree = [far] * (2 * size)

        def leaf(i: int) -> int:
            j = after[i]
            rank = pair((token[i], token[j])) if j < n else None
            return far if rank is None else rank * size + i

        for i in range(n):
            tree[size + i] = leaf(i)
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            while k > 1:
                k >>= 1
                value = tree[2 * k] if tree[2 * k] < tree[2 * k + 1] else tree[2 * k + 1]
                if tree[k] == value:
                    break
                tree[k] = value

        while tree[1] < far:
            rank, i = divmod(tree[1], size)
            j = after[i]
            token[i], after[i] = rank, after[j]
            if after[j] < n:
                before[after[j]] = i
            put(j, far)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        out, i = [], 0
        while i < n:
            out.append(token[i])
            i = after[i]
        return out

    def merge_side_by_side(self, pieces: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all ``pieces`` (of 2 to ``size`` bytes, a power of two) in
        one array, and the number of tokens of each. One segment tree a row."""
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        rows = np.arange(len(pieces))
        token = np.full((len(pieces), size + 1), -1, np.int64)
        inside = np.arange(size + 1) < n[:, None]
        token[inside] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.broadcast_to(np.arange(1, size + 2), token.shape).copy()
        before = np.broadcast_to(np.arange(-1, size), token.shape).copy()
        tree = np.full((len(pieces), 2 * size), _FAR, np.int64)
        first = inside[:, 1:]
        ranks = np.where(first, self.of_pairs(token[:, :-1], token[:, 1:]), _FAR)
        tree[:, size:] = np.where(ranks < _FAR, ranks * size + np.arange(size), _FAR)
        level = size
        while level > 1:
            level //= 2
            pairs = tree[:, 2 * level : 4 * level]
            tree[:, level : 2 * level] = np.minimum(pairs[:, ::2], pairs[:, 1::2])

        def put(r: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
            k = i + size
            tree[r, k] = value
            while k[0] > 1:
                k >>= 1
                tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])

        def leaf(r: np.ndarray, i: np.ndarray) -> np.ndarray:
            j = after[r, i]
            inner = j < n[r]
            rank = np.where(inner, self.of_pairs(token[r, i], token[r, np.minimum(j, size)]), _FAR)
            return np.where(rank < _FAR, rank * size + i, _FAR)

        live = rows[tree[:, 1] < _FAR]
        while len(live):
            root = tree[live, 1]
            i = root % size
            j = after[live, i]
            far = after[live, j]
            token[live, i], after[live, i] = root // size, far
            token[live, j] = -1
            before[live, np.minimum(far, size)] = i
            put(live, j, np.full(len(live), _FAR))
            put(live, i, leaf(live, i))
            left = before[live, i]
            has = left >= 0
            if has.any():
                put(live[has], left[has], leaf(live[has], left[has]))
            live = live[tree[live, 1] < _FAR]
        keep = token[:, :size] >= 0
        return token[:, :size][keep], keep.sum(axis=1)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all pieces in turn, and how many each has. A piece that
        is a token stays whole."""
        found: list[np.ndarray | list[int] | None] = [None] * len(pieces)
        classes: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.rank.get(p)
            if whole is not None:
                found[i] = [whole]
            elif len(p) > SIDE_BY_SIDE:
                found[i] = self.merge_long(p)
            else:
                classes.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
        for size, members in classes.items():
            for a in range(0, len(members), 16384):
                part = members[a : a + 16384]
                tokens, counts = self.merge_side_by_side([pieces[i] for i in part], size)
                tokens, stops = tokens.tolist(), np.cumsum(counts).tolist()
                for i, a0, z0 in zip(part, [0, *stops], stops):
                    found[i] = tokens[a0:z0]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum())), counts

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        upto = np.cumsum(lengths)
        where = np.repeat(self.starts[ids] - (upto - lengths), lengths) + np.arange(int(lengths.sum()))
        return self.blob[where].tobytes()


class Encoder(dict):
    """Ids of whole texts. The pattern never matches across a space that
    stands before a word and after other text, so texts are cut there into
    units, which are remembered: at most ``most`` of them and ``most_bytes`` of
    their characters, then all are forgotten. What is longer than LONG_UNIT
    characters, as text without spaces is, is cut further (:meth:`Ranks.parts`);
    such parts are remembered as bytes, which the pattern cuts no more."""

    def __init__(self, path: str, pattern: str, most: int = 600_000, most_bytes: int = 16 << 20):
        super().__init__()
        import regex

        pattern = pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"(?!\S)", f"(?![^{_SPACE}])").replace(r"\s", f"[{_SPACE}]")
        self.find = regex.compile(pattern).findall
        self.touching = re.compile(f" [{_SPACE}]|[{_SPACE}] | $").search  # a space at the end, or beside white space
        self.between = regex.compile(rf"(?<=[^{_SPACE}])(?= [^{_SPACE}])").split
        self.ranks, self.most, self.most_bytes = Ranks(path), most, most_bytes
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.held = 0
        self.new: list[str | bytes] = []
        self.pieces: dict[str | bytes, list[int]] = {}
        self.ids = np.zeros(0, np.uint32)
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, unit: str | bytes) -> int:
        self[unit] = number = len(self)
        self.new.append(unit)
        self.held += len(unit)
        return number

    def _encode_new(self) -> None:
        cut = [[u] if isinstance(u, bytes) else self.find(u) for u in self.new]
        pieces = [p for p in dict.fromkeys(chain.from_iterable(cut)) if p not in self.pieces]
        tokens, counts = self.ranks.encode_pieces(
            [p if isinstance(p, bytes) else p.encode("utf-8", "surrogatepass") for p in pieces]
        )
        stops = np.cumsum(counts).tolist()
        tokens = tokens.tolist()
        self.pieces.update((p, tokens[a:z]) for p, a, z in zip(pieces, [0, *stops], stops))
        get = self.pieces.__getitem__
        found = [get(c[0]) if len(c) == 1 else list(chain.from_iterable(map(get, c))) for c in cut]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))])
        self.new = []

    def units(self, text: str) -> list[str | bytes]:
        """Cuts at each space that stands between two characters which are no
        white space; long units are cut on."""
        if self.touching(text):
            words = self.between(text)
        else:  # each space is such a space
            first, *rest = text.split(" ")
            words = [first] if first else []
            words += [" " + w for w in rest]
        if max(map(len, words), default=0) <= LONG_UNIT:
            return words
        units: list[str | bytes] = []
        for w in words:
            if len(w) <= LONG_UNIT:
                units.append(w)
                continue
            for piece in self.find(w):
                units += self.ranks.parts(piece) if len(piece) > LONG_PIECE else [piece.encode("utf-8", "surrogatepass")]
        return units

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self) > self.most or self.held > self.most_bytes:
            self._empty()
        units = [self.units(t) if t else [] for t in texts]
        ends = np.cumsum([0, *map(len, units)])
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(units)), np.int64, int(ends[-1]))
        if self.new:
            self._encode_new()
        lengths = self.lengths[numbers]
        upto = np.cumsum(lengths)
        flat = self.ids[np.repeat(self.starts[numbers] - (upto - lengths), lengths) + np.arange(int(lengths.sum()))]
        stops = np.concatenate(([0], upto))[ends].tolist()
        return [flat[a:z] for a, z in zip(stops, stops[1:])]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each Python worker, kept between its tasks."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``docs`` as struct ``row``, with ``ids`` (if ``with_ids``; binary,
    little-endian unsigned 32-bit), ``n_tokens``, ``ids_sha256`` and
    ``decoded_sha256`` (of the bytes that the ids decode to).

    ``path`` names a file of ranks, ``pattern`` the split pattern; special
    tokens are ordinary text. Null counts as empty: no ids. Whole texts are
    encoded, however long; repeated rows each come out; names of other columns
    cannot clash; an empty table gives an empty result."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, pattern)
        for texts in batches:
            texts = [t if isinstance(t, str) else None for t in texts]
            rows = []
            for a, z in chunks(texts):
                for ids in enc.encode(texts[a:z]):
                    raw = ids.astype("<u4").tobytes()
                    rows.append((
                        raw if with_ids else None, len(ids), hashlib.sha256(raw).hexdigest(),
                        hashlib.sha256(enc.ranks.decode(ids)).hexdigest(),
                    ))
            yield pd.DataFrame(rows, columns=["ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), encode(docs[text_col]).alias("e"))
    return out.select("row", *(["e.ids"] if with_ids else []), "e.n_tokens", "e.ids_sha256", "e.decoded_sha256")


def decode_documents(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded`` (binary): the bytes of its ids; null ids
    decode to nothing."""
    ship_package(encoded.sparkSession)

    @F.pandas_udf("binary")
    def decode(ids: pd.Series) -> pd.Series:
        ranks = encoder(path, pattern).ranks
        return pd.Series([ranks.decode(np.frombuffer(x or b"", "<u4").astype(np.int64)) for x in ids])

    return encoded.withColumn("decoded", decode(F.col(ids_col)))
