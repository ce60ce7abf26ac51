"""Whitening of embeddings by shifted CholeskyQR.

An entry c becomes the whole number ``x = floor(1024 * c) + 100000``. The rows are centred before
anything is multiplied: with n vectors and sums S per dimension, ``n * x - S`` is a whole number,
and dividing it by n rounds once. The centred rows A are then orthogonalised in passes over the
table: each pass solves the rows against the triangular factors found so far, adds up the Gram
matrix of the result in Spark, and factors it by Cholesky (the first time with a shift that keeps
it positive). The factors are composed to R with A = Q R; the singular values and right vectors of
R are the standard deviations (times sqrt(n)) and the components. Q is never stored: a pass makes
it again from the rows and the factors, so a lost task costs its own rows only.

What goes through the driver per pass is one d x d matrix, whatever the number of rows.

Defined results: a row is left out if its vector is null, holds a null or non-finite entry, or one
beyond ``LARGEST`` in size. Vectors of another length than the most common one (of equally common
lengths the largest) are left out too; so are empty ones.
Components whose eigenvalue vanishes have no whitened value: they and what follows are missing, so
equal vectors, a single one or an empty table give no rows. A repeated row counts and is returned
each time. A null ``vec_id`` is an id like any other. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ticketlake.llm.common import settle

#: x = floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Entries beyond this size are no embedding's; with them block sums would not fit 64 bits.
LARGEST = float(1 << 30)
COMPONENTS = 8
#: Passes end when the Gram matrix is this close to the identity, or after so many.
ORTHOGONAL, PASSES = 1e-13, 4
#: Singular values below this share of the largest are those of a vanishing direction.
VANISHING = 1e-9
EXACT = pa.decimal128(38, 0)
#: Numbers that a worker holds in one block of rows.
BLOCK = 1 << 20


@dataclass(frozen=True)
class Whitening:
    """The fitted components: ``vectors`` has one per column, by falling ``variances``."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    variances: np.ndarray
    trace: float

    def loadings(self, k: int) -> np.ndarray:
        """Columns that turn centred rows into whitened ones."""
        return self.vectors[:, :k] / np.sqrt(self.variances[:k])


def whole_numbers(vectors: pa.ListArray, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of a length, and their whole numbers as a matrix."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    places = np.flatnonzero((lengths == dimensions) & (lengths > 0))
    if not len(places):
        return places, np.empty((0, dimensions), dtype=np.int64)
    flat = vectors.take(pa.array(places)).flatten().cast(pa.float64())
    entries = flat.to_numpy(zero_copy_only=False).reshape(-1, dimensions)  # nulls become NaN
    usable = (np.abs(entries) <= LARGEST).all(axis=1)
    return places[usable], np.floor(SCALE * entries[usable]).astype(np.int64) + OFFSET


def _blocks(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """``(ids, whole numbers)`` of the usable rows, some at a time."""
    step = max(1, BLOCK // max(1, dimensions))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            places, x = whole_numbers(part.column(1), dimensions)
            if len(places):
                yield part.column(0).take(pa.array(places)), x


def _lengths_and_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list] = {}
    for batch in batches:
        found = batch.column(0).value_lengths().fill_null(0).unique().to_pylist()
        for length in (n for n in found if n):
            step = max(1, BLOCK // length)
            for start in range(0, batch.num_rows, step):
                _, x = whole_numbers(batch.column(0).slice(start, step), length)
                own = sums.setdefault(length, [0, np.zeros(length, dtype=object)])
                own[0] += len(x)
                own[1] += x.sum(axis=0).astype(object)
    for length, (n, total) in sums.items():
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(length, length)), pa.array(np.arange(length)),
                pa.array(np.full(length, n)), pa.array(total.tolist(), type=EXACT),
            ],
            names=["length", "i", "n", "total"],
        )


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """``n * x - S`` exactly (Python integers if 64 bits are too few) and divided by n."""
    if int(np.abs(x).max()) * n + max(map(abs, sums)) >= 1 << 63:
        exact = x.astype(object) * n - np.array(sums, dtype=object)
        return exact, (exact / n).astype(np.float64)
    exact = x * np.int64(n) - np.array(sums, dtype=np.int64)
    return exact, exact / n


def _entries(matrix: np.ndarray) -> pa.RecordBatch:
    """The upper triangle of a symmetric matrix as rows."""
    i, j = np.triu_indices(len(matrix))
    return pa.RecordBatch.from_arrays(
        [pa.array(i), pa.array(j), pa.array(matrix[i, j])], names=["i", "j", "v"]
    )


def _summed_matrix(rows: DataFrame, work: Callable, size: int) -> np.ndarray:
    """Adds up the triangles that tasks return; what reaches the driver is one matrix."""
    partial = rows.mapInArrow(work, "i long, j long, v double")
    found = partial.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    matrix = np.zeros((size, size))
    for i, j, v in found:
        matrix[i, j] = matrix[j, i] = v
    return matrix


def _gram(rows: DataFrame, n: int, sums: list[int], factors: list[np.ndarray]) -> np.ndarray:
    """Gram matrix of the centred rows after the triangular solves of the factors so far."""
    d = len(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for _, x in _blocks(batches, d):
            q = centred(x, n, sums)[1]
            for upper in factors:
                q = solved(q, upper)
            total += q.T @ q
        yield _entries(total)

    return _summed_matrix(rows, add, d)


def solved(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Rows times the inverse of an upper triangular factor, by substitution."""
    out = np.empty_like(rows)
    for j in range(len(upper)):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def cholesky(gram: np.ndarray) -> np.ndarray:
    """Upper factor of a Gram matrix, with a shift of its diagonal that is sure to suffice.

    The shift starts at the rounding of the sums of a block and grows until the factor exists.
    """
    d = len(gram)
    unit = np.finfo(np.float64).eps / 2
    shift = 11 * (d * d + d + BLOCK) * unit * np.linalg.norm(gram, 2)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 8


def fit(embeddings: DataFrame, vectors: str = "embedding") -> Whitening | None:
    """Components of all usable vectors; ``None`` if there are none or all are equal."""
    column = embeddings.select(F.col(vectors).alias("v"))
    sums = settle(
        column.mapInArrow(_lengths_and_sums, "length long, i long, n long, total decimal(38,0)")
        .groupBy("length", "i")
        .agg(F.sum("n").alias("n"), F.sum("total").alias("total")),
        small=True,
    )
    best = sums.filter("i = 0 and n > 0").orderBy(F.desc("n"), F.desc("length")).limit(1)
    found = best.select("length", "n").head()
    if found is None:
        return None
    d, n = found["length"], found["n"]
    per_dimension = sums.filter(F.col("length") == d).select("i", "total").collect()
    total = [int(s) for _, s in sorted(map(tuple, per_dimension))]
    rows = embeddings.select(F.lit(0).alias("id"), F.col(vectors).alias("v"))
    factors: list[np.ndarray] = []
    gram = _gram(rows, n, total, factors)
    if not gram.any():
        return None
    composed = np.eye(d)
    trace = float(np.trace(gram)) / n
    while len(factors) < PASSES and np.abs(gram - np.eye(d)).max() > ORTHOGONAL * d:
        upper = cholesky(gram)
        factors.append(upper)
        composed = upper @ composed
        gram = _gram(rows, n, total, factors)
    # What the passes left of Q's Gram matrix: the identity, but for directions that vanish.
    left, vectors_of_gram = np.linalg.eigh(gram)
    root = np.sqrt(np.clip(left, 0, None))[:, None] * vectors_of_gram.T
    _, singular, right = np.linalg.svd(root @ composed)
    kept = singular > VANISHING * singular[0]
    return Whitening(n, total, right.T[:, kept], singular[kept] ** 2 / n, trace)


def identity_error(embeddings: DataFrame, model: Whitening, k: int, vectors: str = "embedding") -> float:
    """Largest entry of the whitened vectors' covariance minus the identity, over all of them."""
    n, sums, loadings = model.n, model.sums, model.loadings(k)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last row and column hold the sums, so that the covariance is centred.
        total = np.zeros((k + 1, k + 1))
        for _, x in _blocks(batches, len(sums)):
            white = centred(x, n, sums)[1] @ loadings
            ones = np.ones((len(white), 1))
            white = np.hstack([white, ones])
            total += white.T @ white
        yield _entries(total)

    rows = embeddings.select(F.lit(0).alias("id"), F.col(vectors).alias("v"))
    total = _summed_matrix(rows, add, k + 1)
    mean = total[:k, k] / n
    covariance = total[:k, :k] / n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(
    embeddings: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vectors: str = "embedding"
) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``.

    One row for each usable vector and component. ``deviation`` is the exact sum of squares of
    ``n * x - S`` as ``decimal(38,0)``; a sum beyond 38 digits stops the job.
    """
    kind = embeddings.schema[key].dataType.simpleString()
    schema = (
        f"`{key}` {kind}, component int, n long, deviation decimal(38,0), whitened double, "
        "explained double, identity_error double"
    )
    model = fit(embeddings, vectors)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    k = min(components, len(model.variances))
    n, sums, loadings = model.n, model.sums, model.loadings(k)
    explained, error = model.variances[:k] / model.trace, identity_error(embeddings, model, k, vectors)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, len(sums)):
            exact, rows = centred(x, n, sums)
            white = rows @ loadings
            size, each = len(x) * k, pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(size, n)),
                    pa.array(squares(exact), type=EXACT).take(each),
                    pa.array(white.ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(size, error)),
                ],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    rows = embeddings.select(F.col(key).alias("id"), F.col(vectors).alias("v"))
    return rows.mapInArrow(project, schema)


def squares(exact: np.ndarray) -> list[int]:
    """Exact sums of squares of the rows."""
    largest = max(int(exact.max()), -int(exact.min()))
    if largest * largest * exact.shape[1] < 1 << 63:
        return (exact * exact).sum(axis=1).tolist()
    return [sum(int(v) * int(v) for v in row) for row in exact]
