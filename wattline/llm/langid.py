"""Language identification by hierarchical discrimination.

The family of the language is predicted first; then one-versus-one linear
support vector machines separate the languages within that family. Both
levels use the same features: hashed byte trigrams of the lower-cased letters
of the whole text, square-rooted relative frequencies of unit length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

UNDETERMINED = "und"
DIMENSIONS = 4096

# Language codes by family; a code not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}

_LETTER = re.compile(r"[^\W\d_]")
# ASCII bytes that are no letters become spaces
_LETTERS_ONLY = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes), f"only {lang}")


def features(texts: list[str]) -> np.ndarray:
    """One row of unit length for each text (zeros if shorter than a trigram)."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for i, t in enumerate(texts):
        raw = f" {t.lower()} ".encode("utf-8", "surrogatepass").translate(_LETTERS_ONLY)
        b = np.frombuffer(raw, np.uint8).astype(np.uint32)
        if len(b) < 3:
            continue
        code = (b[:-2] * 0x9E3779B1 + b[1:-1] * 0x85EBCA77 + b[2:] * 0xC2B2AE3D).astype(np.uint32)
        code ^= code >> 15
        blank = (b[:-2] == 32) & (b[1:-1] == 32)
        count = np.bincount(code[~blank] % DIMENSIONS, minlength=DIMENSIONS)
        out[i] = np.sqrt(count / max(1, count.sum()))
    return out


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 4.0, rounds: int = 12) -> np.ndarray:
    """Weights (last one the bias) of a linear SVM with squared hinge loss, by
    dual coordinate descent in a fixed order. ``y`` holds +1 and -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    diagonal = (x**2).sum(axis=1) + 0.5 / cost
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            gradient = y[i] * (w @ x[i]) - 1 + 0.5 / cost * alpha[i]
            new = max(0.0, alpha[i] - gradient / diagonal[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


@dataclass
class LanguageModel:
    """Weights of one-versus-one machines: between families, and within each."""

    families: dict[str, list[str]] = field(default_factory=dict)
    weights: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def _choose(self, x: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner by votes (ties: by sum of margins) and the
        logistic of its least margin against the others."""
        votes, sums = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
        least = np.full((len(x), len(names)), np.inf)
        for (i, a), (j, b) in combinations(enumerate(names), 2):
            if (a, b) not in self.weights:
                continue
            w = self.weights[a, b]
            m = x @ w[:-1] + w[-1]
            for k, s in ((i, m), (j, -m)):
                votes[:, k] += s > 0
                sums[:, k] += s
                least[:, k] = np.minimum(least[:, k], s)
        best = (votes + 0.5 * np.tanh(sums / 100)).argmax(axis=1)
        return best, 1 / (1 + np.exp(-np.clip(3 * least[np.arange(len(x)), best], -30, 30)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        ok = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        names = sorted(self.families)
        for at in range(0, len(ok) if names else 0, 256):
            rows = ok[at : at + 256]
            x = features([texts[i] for i in rows])
            fam, sure = self._choose(x, names)
            for f, name in enumerate(names):
                mine = np.flatnonzero(fam == f)
                if not len(mine):
                    continue
                members = self.families[name]
                lang, within = self._choose(x[mine], members)
                for r, l, s in zip(mine, lang, within * sure[mine]):
                    langs[rows[r]] = members[l]
                    scores[rows[r]] = s
        return langs, scores


def fit(labelled: DataFrame, per_lang: int = 500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on about ``per_lang`` rows of each language of ``labelled``, chosen
    by a hash of id and text (the documented bound: the sample never holds more
    than a small multiple of ``per_lang`` rows a language, but for copies of one
    row, which are chosen together). Rows without an id are rows like any other;
    rows without a language or a letter are not used. A language none of whose
    rows was chosen is never answered; a model without any, as an empty table
    gives, answers ``und``. Each machine is trained by a task of its own."""
    ship_package(labelled.sparkSession)
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[lang_col]: r["count"] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return LanguageModel()
    share = F.coalesce(*[F.when(F.col(lang_col) == l, F.lit(per_lang / n)) for l, n in sorted(counts.items())])
    lot = F.pmod(F.xxhash64(F.lit("language sample"), F.col(id_col), F.col(text_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.filter(lot < share).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    langs = sorted(counts)
    families: dict[str, list[str]] = {}
    for l in langs:
        families.setdefault(family(l), []).append(l)
    machines = [(a, b, "family") for a, b in combinations(sorted(families), 2)]
    machines += [(a, b, "lang") for members in families.values() for a, b in combinations(members, 2)]
    if not machines:
        return LanguageModel(families, {})

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Features of a row, once for each machine that it trains."""
        for b in batches:
            b = b[[bool(_LETTER.search(t)) for t in b["text"]]]
            for i in range(0, len(b), 128):
                part = b.iloc[i : i + 128]
                x = features(list(part["text"]))
                for m, (a, c, level) in enumerate(machines):
                    names = [family(l) if level == "family" else l for l in part["lang"]]
                    use = [k for k, n in enumerate(names) if n in (a, c)]
                    if use:
                        yield pd.DataFrame({
                            "machine": m, "id": part["id"].to_numpy()[use], "y": [1 if names[k] == a else -1 for k in use],
                            "x": [x[k].tobytes() for k in use],
                        })

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["id", "y", "x"], kind="stable")
        x = np.frombuffer(b"".join(group["x"]), np.float32).reshape(len(group), -1)
        w = train_svm(x, group["y"].to_numpy(np.float64))
        sides = [int((group["y"] == s).sum()) for s in (1, -1)]
        return pd.DataFrame({"machine": [group["machine"].iloc[0]], "w": [w.astype(np.float32).tobytes()], "a": sides[:1], "b": sides[1:]})

    dealt = sample.mapInPandas(deal, "machine int, id long, y int, x binary")
    weights = dealt.groupBy("machine").applyInPandas(train, "machine int, w binary, a long, b long").collect()
    found = {machines[r["machine"]][:2]: np.frombuffer(r["w"], np.float32) for r in weights}
    # what no row was chosen of is not answered
    seen: dict[str, set[str]] = {"family": set(), "lang": set()}
    for r in weights:
        a, b, level = machines[r["machine"]]
        seen[level] |= {name for name, n in ((a, r["a"]), (b, r["b"])) if n}
    if len(families) > 1:
        families = {f: members for f, members in families.items() if f in seen["family"]}
    families = {f: members if len(members) == 1 else [l for l in members if l in seen["lang"]] for f, members in families.items()}
    return LanguageModel({f: members for f, members in families.items() if members}, found)


def with_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` as struct ``row``, with ``lang_pred`` and ``score`` (0 to 1)
    from the text alone. Null texts and texts without a letter get ``und``
    and 0; the whole text counts, however long; repeated rows get equal
    answers; names of other columns cannot clash, as they stay in ``row``."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores = model.predict([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), predict(docs[text_col]).alias("p"))
    return out.select("row", "p.lang_pred", "p.score")
