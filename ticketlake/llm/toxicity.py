"""Toxicity: maximum-scoring segments over token log-odds, calibrated by extreme values.

A token's score is the log-likelihood ratio of toxic passages against clean text. Both frequencies
are smoothed with a Dirichlet prior centred on the pooled counts. A passage is a mixture of toxic
tokens (a share of ``PASSAGE_SHARE``) and clean text, so tokens that don't lean towards toxic
documents lower a segment a little. Words outside the lexicon fall back to their stems (the first
five or four characters), which are outcomes of their own. A linear scan finds all maximal scoring
segments of a document. Segment scores in clean text follow an extreme-value law, P(max >= s) =
1 - exp(-K n exp(-s)); K is fitted on clean training documents. A document's evidence is the sum of
s - ln(K n) over its significant segments, and a logistic fit turns it into a probability.

Defined results: null and empty texts have no segments and get the base rate of such documents;
without usable labels the lexicon is empty and every score is below 0.5; repeated rows and null ids
are scored like any other row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ticketlake.llm.common import held_out, labelled_sample, settle, whole_text

#: Training documents of each label at most. It bounds the lexicon and what reaches the driver.
SAMPLE_PER_CLASS = 20_000
#: Toxic documents that a word must be in, and how many times the share of clean ones that hold it
#: the share of toxic ones must be: rates, so the sizes of the classes don't matter.
MIN_TOXIC, RATE = 3, 4
PASSAGE_SHARE = 0.1
PRIOR_TOKENS = 1000.0
#: A token enters the lexicon if chance explains its lean with a probability below exp(-this).
MIN_EVIDENCE = 12.0
STEMS = (5, 4)
THRESHOLD = 0.5

_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def tokens(text: str) -> list[bytes]:
    """Lower-cased runs of letters and digits; every character beyond ASCII counts as a letter."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()


def stems(token: bytes) -> list[bytes]:
    """The token's stems, longest first; the asterisk keeps them apart from whole words."""
    word = token.decode("utf-8", "replace")
    return [word[:k].encode("utf-8", "replace") + b"*" for k in STEMS if len(word) > k]


def segments(scores: np.ndarray, places: np.ndarray, other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first token, last token, score), in one linear scan.

    ``scores`` are the positive scores at the token positions ``places``; every other token scores
    ``other``, below zero. A segment is maximal if no extension or part of it scores more.
    """
    # First, last, sum before it, sum at its end, and the nearest segment with a smaller sum before.
    found: list[list] = []
    total, previous = 0.0, -1
    for place, score in zip(places.tolist(), scores.tolist(), strict=True):
        total += other * (place - previous - 1)
        piece = [place, place, total, total + score]
        total += score
        previous = place
        at = len(found) - 1
        while at >= 0 and found[at][2] >= piece[2]:
            at = found[at][4]
        while at >= 0 and found[at][3] < piece[3]:
            piece, link = [found[at][0], piece[1], found[at][2], piece[3]], found[at][4]
            del found[at:]
            at = link
        found.append([*piece, at])
    return [(first, last, end - start) for first, last, start, end, _ in found]


@dataclass
class ToxicityModel:
    lexicon: dict[bytes, float] = field(default_factory=dict)
    other: float = math.log(1 - PASSAGE_SHARE)
    log_k: float = 0.0
    intercept: float = -4.0
    slope: float = 1.0

    def word_scores(self) -> dict[bytes, float]:
        """A memo from word to score; words outside the lexicon fall back to a stem, then to 0."""
        lexicon = self.lexicon

        class Memo(dict):
            def __missing__(self, word: bytes) -> float:
                score = lexicon.get(word)
                if score is None:
                    score = next((lexicon[s] for s in stems(word) if s in lexicon), 0.0)
                if len(self) > 1_000_000:
                    self.clear()
                self[word] = score
                return score

        return Memo()

    def passages(self, text: str, memo: dict) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of tokens and the maximal segments."""
        words = tokens(text)
        values = np.fromiter(map(memo.__getitem__, words), float, len(words))
        places = np.flatnonzero(values > 0)
        return len(words), segments(values[places], places, self.other) if len(places) else []

    def significant(self, n: int, found: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
        """Segments above what clean text of this length reaches, with their surplus."""
        floor = self.log_k + math.log(max(n, 1))
        return [(first, last, s - floor) for first, last, s in found if s > floor]

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * evidence, -60, 60)))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per token and label: documents and occurrences; the empty token holds the totals."""
    for batch in batches:
        documents, places = (Counter(), Counter()), (Counter(), Counter())
        for text, y in zip(batch["text"], batch["y"], strict=True):
            words = tokens(text)
            own = Counter(words)
            for word, n in list(own.items()):
                for stem in stems(word):
                    own[stem] += n
            documents[y].update(own.keys())
            places[y].update(own)
            documents[y][b""] += 1
            places[y][b""] += len(words)
        rows = [
            (word, documents[1][word], documents[0][word], places[1][word], places[0][word])
            for word in documents[0].keys() | documents[1].keys()
        ]
        yield pd.DataFrame(rows, columns=["token", "d1", "d0", "n1", "n0"])


def _lean(ones: float, zeros: float, share: float) -> float:
    """Exponent of the Chernoff bound that ``ones`` of ``ones + zeros`` are toxic by chance."""
    n = ones + zeros
    rate = ones / n
    if rate <= share:
        return 0.0
    rest = (1 - rate) * math.log((1 - rate) / (1 - share)) if rate < 1 else 0.0
    return n * (rate * math.log(rate / share) + rest)


def _lexicon(rows: list[tuple], totals: tuple) -> tuple[dict[bytes, float], float]:
    d1, d0, n1, n0 = totals
    share, place_share = d1 / (d1 + d0), n1 / (n1 + n0)
    counts = {}
    words = [r for r in rows if not r[0].endswith(b"*")]
    for word, a, b, x, y in words:
        if _lean(a, b, share) >= MIN_EVIDENCE:
            counts[word] = (x, y)
    left = {r[0]: [r[3], r[4]] for r in rows if r[0].endswith(b"*")}
    for word, (x, y) in counts.items():
        for stem in stems(word):
            if stem in left:
                left[stem][0] -= x
                left[stem][1] -= y
    for stem, (x, y) in sorted(left.items(), key=lambda item: -len(item[0])):
        if x >= 4 and _lean(x, y, place_share) >= 2 * MIN_EVIDENCE:
            counts[stem] = (x, y)
    if not counts:
        return {}, math.log(1 - PASSAGE_SHARE)
    clean, excess = {}, {}
    for word, (x, y) in counts.items():
        prior = PRIOR_TOKENS * (x + y) / (n1 + n0)
        clean[word] = (y + prior) / (n0 + PRIOR_TOKENS)
        excess[word] = max((x + prior) / (n1 + PRIOR_TOKENS) - clean[word], 0.0)
    whole = sum(excess.values())
    scores = {
        word: math.log(PASSAGE_SHARE * excess[word] / whole / clean[word] + 1 - PASSAGE_SHARE)
        for word in counts
    }
    return {w: s for w, s in scores.items() if s > 0}, math.log(1 - PASSAGE_SHARE)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic fit of one feature with a small ridge, by Newton steps."""
    design, beta = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + 0.1 * beta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        beta -= np.clip(np.linalg.solve(curve, gradient), -2, 2)
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> ToxicityModel:
    """Learns the lexicon, the extreme-value law and the calibration from a bounded sample."""
    sample = labelled_sample(docs, labels, "toxic", per_class).select("text", "y")
    model = ToxicityModel()
    counts = (
        sample.mapInPandas(_count, "token binary, d1 long, d0 long, n1 long, n0 long")
        .groupBy("token")
        .agg(*[F.sum(c).alias(c) for c in ("d1", "d0", "n1", "n0")])
    )
    counts = settle(counts)
    totals = next((tuple(r)[1:] for r in counts.filter(F.length("token") == 0).collect()), (0, 0, 0, 0))
    if min(totals) == 0:
        return model
    # Words in MIN_TOXIC toxic documents or more, with RATE times the share that clean ones have.
    marked = (F.col("d1") >= MIN_TOXIC) & (F.col("d1") * totals[1] > F.col("d0") * (RATE * totals[0]))
    rows = [tuple(r) for r in counts.filter((F.length("token") > 0) & marked).collect()]
    rows = [(bytes(token), *n) for token, *n in rows]
    model.lexicon, model.other = _lexicon(rows, totals)

    def clean_law(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = model.word_scores()
        for batch in batches:
            found = [model.passages(text, memo) for text in batch["text"]]
            mass = [n * math.exp(-max((s for _, _, s in f), default=0.0)) for n, f in found if n]
            yield pd.DataFrame({"documents": [len(mass)], "mass": [math.fsum(mass)]})

    law = (
        sample.filter("y = 0")
        .mapInPandas(clean_law, "documents long, mass double")
        .agg(F.sum("documents"), F.sum("mass"))
        .first()
    )
    model.log_k = math.log(law[0] / law[1]) if law[0] and law[1] else 0.0
    binned = (
        sample.select("y", F.round(F.least(toxicity(F.col("text"), model)["evidence"], F.lit(100.0)), 1).alias("x"))
        .groupBy("x", "y")
        .count()
        .collect()
    )
    x, y, weight = (np.array([float(r[k]) for r in binned]) for k in ("x", "y", "count"))
    model.intercept, model.slope = _logistic(x, y, weight)
    return model


def toxicity(text: Column, model: ToxicityModel) -> Column:
    """A struct of the document's score, evidence and significant passages (token positions)."""

    @F.pandas_udf(
        "score double, evidence double, passages array<struct<first_token: int, last_token: int, surplus: double>>"
    )
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo = model.word_scores()
        for part in parts:
            kept = [model.significant(*model.passages(t, memo)) for t in part]
            evidence = np.array([math.fsum(s for _, _, s in found) for found in kept])
            yield pd.DataFrame(
                {"score": model.probability(evidence), "evidence": evidence, "passages": kept}
            )

    return scored(text)


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``(doc_id, held_out, score, predicted, evidence, passages)`` of every row."""
    return docs.select(
        "doc_id", held_out().alias("held_out"), toxicity(whole_text(), model).alias("t")
    ).select(
        "doc_id",
        "held_out",
        "t.score",
        (F.col("t.score") >= THRESHOLD).cast("int").alias("predicted"),
        "t.evidence",
        "t.passages",
    )


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows that aren't rejected, with their columns as they are."""
    return docs.filter(toxicity(whole_text(), model)["score"] < THRESHOLD)
