"""Quality classifier: regularised quadratic discriminant analysis.

Each class is a normal distribution over transformed statistics of the whole
text. Its covariance is shrunk towards the pooled diagonal; scores are the
logistic of the difference of Mahalanobis log densities, computed with
Cholesky factors that are cached in the fitted model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

STATISTICS = (
    "words", "word_bytes", "upper", "digits", "marks", "sentence_marks", "pipes", "dup_lines",
    "line_words", "distinct_words", "marked_words", "short_words",
)
_MARKS = np.isin(np.arange(256), list(b"#*$%&<>@^~_=+\\{}[]"))
_LETTER_BYTES = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])


def _log_odds(part: float, whole: float) -> float:
    return float(np.log((part + 0.5) / (max(whole - part, 0.0) + 0.5)))


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one text (null: those of the empty text)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters, total = int(count[_LETTER_BYTES].sum()), int(count.sum())
    black = total - int(count[[32, 9, 10, 11, 12, 13]].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    distinct = len(set(words))
    marked = sum(1 for w in words if w[-1] in b"!#*$%&|<>")
    short = sum(1 for w in words if len(w) <= 3)
    return [
        float(np.log1p(n)),
        float(np.log1p(black / n)) if n else 0.0,
        _log_odds(int(count[_UPPER].sum()), letters),
        _log_odds(int(count[_DIGIT].sum()), black),
        _log_odds(int(count[_MARKS].sum()), black),
        _log_odds(int(count[list(b".,;:!?")].sum()), black),
        _log_odds(int(count[124]), black),
        _log_odds(len(lines) - len(set(lines)), len(lines)),
        float(np.log1p(n / max(1, len(lines)))),
        _log_odds(distinct, n) / max(1.0, float(np.log1p(n))),
        _log_odds(marked, n),
        _log_odds(short, n),
    ]


def _forward(factor: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``factor`` (lower triangular) solved for ``y`` by forward substitution."""
    z = np.empty_like(y)
    for i, row in enumerate(factor):
        z[i] = (y[i] - row[:i] @ z[:i]) / row[i]
    return z


@dataclass
class QualityModel:
    """Means, Cholesky factors and log priors of classes 0 and 1 (absent
    classes are None)."""

    mean: list[np.ndarray | None]
    factor: list[np.ndarray | None]
    log_prior: list[float]
    temper: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row. A model that saw one class
        only answers that class, one that saw none 0.5."""
        if self.mean[0] is None or self.mean[1] is None:
            return np.full(len(x), 0.5 if self.mean[0] is self.mean[1] else float(self.mean[1] is not None))
        density = []
        for c in (0, 1):
            z = _forward(self.factor[c], (x - self.mean[c]).T)
            density.append(self.log_prior[c] - np.log(np.diag(self.factor[c])).sum() - 0.5 * (z**2).sum(axis=0))
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / self.temper, -30, 30)))


def fit(
    docs: DataFrame, labels: DataFrame, most: int = 20_000, shrink: float = 0.1, temper: float = 2.0,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> QualityModel:
    """Fit on the labelled rows of ``docs``. At most about ``most`` labels are
    used (the documented bound of the sample, drawn by a hash of the id; it
    also bounds the broadcast of the labels). Labels other than 0 and 1 and
    null ids are not used; an id with several labels counts as the least."""
    ship_package(docs.sparkSession)
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    n = known.count()
    lot = F.pmod(F.xxhash64(F.lit("quality sample"), F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    known = known.filter(lot < F.lit(min(1.0, most / max(n, 1)))).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"))
    small = known.count() <= 2 * most  # checked, though the draw makes it all but certain
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known) if small else known, "id")
    k = len(STATISTICS)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 + k + k * k))
        for b in batches:
            x = np.array([statistics(t) for t in b["text"]]).reshape(-1, k)
            for c in (0, 1):
                own = x[b["y"].to_numpy() == c]
                total[c] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        for c in (0, 1):
            yield pd.DataFrame({"y": c, "at": np.arange(total.shape[1]), "s": total[c]})

    got = rows.select("y", "text").mapInPandas(sums, "y int, at int, s double")
    total = np.zeros((2, 1 + k + k * k))
    for r in got.groupBy("y", "at").agg(F.sum("s").alias("s")).collect():
        total[r["y"], r["at"]] = r["s"]
    mean, cov = [None, None], [None, None]
    for c in (0, 1):
        if total[c, 0] > 0:
            mean[c] = total[c, 1 : 1 + k] / total[c, 0]
            cov[c] = total[c, 1 + k :].reshape(k, k) / total[c, 0] - np.outer(mean[c], mean[c])
    seen = [c for c in (0, 1) if mean[c] is not None]
    pooled = sum(total[c, 0] * np.diag(cov[c]) for c in seen) / max(1.0, total[:, 0].sum()) if seen else None
    factor = [
        None if cov[c] is None else np.linalg.cholesky((1 - shrink) * cov[c] + shrink * np.diag(pooled) + 1e-3 * np.eye(k))
        for c in (0, 1)
    ]
    prior = np.log(np.maximum(total[:, 0], 1) / max(1.0, total[:, 0].sum()))
    return QualityModel(mean, factor, [float(p) for p in prior], temper)


def with_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """``docs`` as struct ``row``, with ``score`` (0 to 1, higher: class 1
    likelier) from the whole text alone. Null counts as empty; repeated rows
    get equal scores; names of other columns cannot clash."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t if isinstance(t, str) else None) for t in texts]).reshape(-1, len(STATISTICS))
        return pd.Series(model.scores(x))

    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), score(docs[text_col]).alias("score"))
