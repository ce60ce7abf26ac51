"""Quality classifier: positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are training documents whose label is 1; the unlabelled side is a sample of the
web text itself, whatever its labels. A first classifier of positives against unlabelled text gives
the class prior: the smallest ratio of the unlabelled to the positive share above a threshold,
which is reached where the text is all but purely positive. The second one minimises

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])

with the logistic loss, so that sigmoid(g) is the probability of label 1; where the bracket turns
negative its gradient is ascended instead, which keeps it from overfitting.

Inputs are statistics of the text alone. Defined results: null and empty texts are texts without
words and get a score like any other; without any positive the score is 0.5 everywhere; repeated
rows and null ids are scored like any other row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ticketlake.llm.common import held_out, whole_text

#: Trusted positives and unlabelled documents that the fit reads at most, each.
SAMPLE = 20_000
THRESHOLD = 0.3

FEATURES = (
    "log_words", "bytes_per_word", "upper", "symbols", "digits", "punctuation", "distinct_words",
    "distinct_pairs", "repeated_lines", "lines_per_word",
)

_UPPER = bytes(range(65, 91))
_SYMBOLS = b"#*$%&|<>!"
_DIGITS = b"0123456789"
_PUNCTUATION = b".,;:?'\"()-"


def statistics(text: str) -> list[float]:
    """The values of ``FEATURES``; shares are 0 where there is nothing to share."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    size, n = max(len(data), 1), len(words)
    lines = [line for line in data.split(b"\n") if line.strip()]

    def share(characters: bytes) -> float:
        return (len(data) - len(data.translate(None, characters))) / size

    return [
        np.log1p(n),
        sum(map(len, words)) / max(n, 1),
        share(_UPPER),
        share(_SYMBOLS),
        share(_DIGITS),
        share(_PUNCTUATION),
        len(set(words)) / n if n else 1.0,
        len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 1.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        data.count(b"\n") / max(n, 1),
    ]


@dataclass
class QualityModel:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def basis(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        return np.hstack([np.ones((len(z), 1)), z, z * z / 4])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.basis(x) @ self.weights, -40, 40)))


def _softplus(v: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, v)


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))


def _against_unlabelled(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 30) -> np.ndarray:
    """Weights of a balanced logistic fit of positives against unlabelled rows."""
    x = np.vstack([positive, unlabelled])
    y = np.r_[np.ones(len(positive)), np.zeros(len(unlabelled))]
    weight = np.r_[np.full(len(positive), 1 / len(positive)), np.full(len(unlabelled), 1 / len(unlabelled))]
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ beta)
        gradient = x.T @ (weight * (p - y)) + 1e-3 * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(beta))
        beta -= np.linalg.solve(curve, gradient)
    return beta


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives in the unlabelled rows, by scores: the least ratio of upper shares."""
    cuts = np.quantile(positive, np.linspace(0.02, 0.95, 200))
    above_p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    above_u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    slack = np.sqrt(np.log(40) / 2 / len(positive)) + np.sqrt(np.log(40) / 2 / len(unlabelled))
    best = np.argmin((above_u + slack) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def _minimise(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 800) -> np.ndarray:
    """Full-batch Adam on the non-negative unbiased risk."""
    beta = np.zeros(positive.shape[1])
    first, second = np.zeros_like(beta), np.zeros_like(beta)
    for step in range(1, steps + 1):
        gp, gu = positive @ beta, unlabelled @ beta
        # Gradients of the logistic loss l(v) = softplus(-v) on either side.
        as_positive = -positive.T @ _sigmoid(-gp) / len(gp)
        p_as_negative = positive.T @ _sigmoid(gp) / len(gp)
        u_as_negative = unlabelled.T @ _sigmoid(gu) / len(gu)
        negative_risk = _softplus(gu).mean() - prior * _softplus(gp).mean()
        if negative_risk >= 0:
            gradient = prior * as_positive + u_as_negative - prior * p_as_negative
        else:
            gradient = -(u_as_negative - prior * p_as_negative)
        gradient = gradient + 1e-4 * beta
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        rate = 0.1 * (1 - step / (steps + 1))
        beta = beta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return beta


def fit_rows(positive: np.ndarray, unlabelled: np.ndarray) -> QualityModel:
    """The model of two feature tables. Even rows fit the first classifier, odd ones the prior."""
    spread = unlabelled.std(axis=0)
    model = QualityModel(unlabelled.mean(axis=0), np.where(spread > 1e-9, spread, 1.0), np.zeros(0), 0.5)
    p, u = model.basis(positive), model.basis(unlabelled)
    rough = _against_unlabelled(p[::2], u[::2])
    odd = (p[1::2], u[1::2]) if len(p) > 1 and len(u) > 1 else (p, u)
    model.prior = estimate_prior(odd[0] @ rough, odd[1] @ rough)
    model.weights = _minimise(p, u, model.prior)
    return model


def features(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def computed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([statistics(t) for t in part])

    return computed(text)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Fits on ``sample`` positives and ``sample`` unlabelled documents at most.

    Both are the documents of the smallest hashes outside the held-out fold; their ids are bounded
    by the parameter, and so are the broadcast and the rows of ten numbers that reach the driver.
    """
    trusted = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull() & ~held_out())
    web = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & ~held_out())

    def ids(rows: DataFrame, salt: str) -> DataFrame:
        return rows.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(sample)

    chosen = (
        ids(trusted, "trusted").withColumn("side", F.lit(1))
        .unionByName(ids(web, "web").withColumn("side", F.lit(0)))
        .distinct()
    )
    rows = (
        docs.select("doc_id", whole_text().alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "side", features(F.col("text")).alias("x"))
        .collect()
    )
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    sides = [np.array([r["x"] for r in rows if r["side"] == k]) for k in (1, 0)]
    if not len(sides[0]) or not len(sides[1]):
        n = len(FEATURES)
        return QualityModel(np.zeros(n), np.ones(n), np.zeros(2 * n + 1), 0.5)
    return fit_rows(*sides)


def quality(text: Column, model: QualityModel) -> Column:
    """The probability of label 1."""

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            x = np.array([statistics(t) for t in part]).reshape(len(part), len(FEATURES))
            yield pd.Series(model.probability(x))

    return scored(text)


def score_documents(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row."""
    scored = docs.select(
        "doc_id", held_out().alias("held_out"), quality(whole_text(), model).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
