import numpy as np
import pytest
from corpus import CLASHING, rows
from pyspark.sql import functions as F

from ticketlake.llm import whitening
from ticketlake.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def table(spark, vectors, parts=3):
    data = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in vectors]
    return spark.createDataFrame(data, SCHEMA).repartition(parts)


def brute(vectors):
    """Whole numbers, exact deviations and the eigenvectors of the exact covariance."""
    x = [[int(np.floor(1024 * np.float64(np.float32(c)))) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(column) for column in zip(*x, strict=True)]
    rows_ = [[n * e - s for e, s in zip(v, sums, strict=True)] for v in x]
    exact = [[sum(r[i] * r[j] for r in rows_) for j in range(len(sums))] for i in range(len(sums))]
    covariance = np.array([[e / n**3 for e in r] for r in exact])
    values, vectors_ = np.linalg.eigh(covariance)
    centred = np.array([[e / n for e in r] for r in rows_])
    return n, [sum(e * e for e in r) for r in rows_], centred, values[::-1], vectors_[:, ::-1], covariance


def check(found, ids, vectors, k):
    n, deviations, centred, values, components, covariance = brute(vectors)
    assert len(found) == len(ids) * k
    white = {(r["vec_id"], r["component"]): r for r in found}
    for c in range(k):
        expected = centred @ components[:, c] / np.sqrt(values[c])
        got = np.array([white[i, c + 1]["whitened"] for i in ids])
        sign = np.sign(expected @ got)
        assert np.allclose(got, sign * expected, rtol=1e-7, atol=1e-7)
        for i, d in zip(ids, deviations, strict=True):
            r = white[i, c + 1]
            assert (r["n"], int(r["deviation"])) == (n, d)
            assert r["explained"] == pytest.approx(values[c] / np.trace(covariance), rel=1e-9)
            assert r["identity_error"] < 1e-9


def spectrum(seed, n, d):
    draw = np.random.default_rng(seed)
    basis = np.linalg.qr(draw.normal(size=(d, d)))[0]
    return draw.normal(size=(n, d)) @ (basis * (2.0 ** -np.arange(d))).T * 3


def test_against_exact_covariance(spark):
    vectors = spectrum(1, 300, 6)
    found = rows(whitening.whiten(table(spark, list(enumerate(vectors)))))
    check(found, range(300), vectors, 6)


def test_top_components_only(spark):
    vectors = spectrum(2, 200, 12)
    check(rows(whitening.whiten(table(spark, list(enumerate(vectors))))), range(200), vectors, 8)


def test_unusable_rows_are_left_out(spark):
    vectors = spectrum(3, 40, 4)
    odd = [
        (100, None), (101, [1, None, 2, 3]), (102, [1, float("nan"), 2, 3]), (None, vectors[0]),
        (103, [float("inf"), 0, 0, 0]), (104, []), (105, [1, 2]), (106, [3e38, 0, 0, 0]),
    ]
    frame = table(spark, [*enumerate(vectors), *odd]).withColumns({c: F.lit("clash") for c in CLASHING})
    found = rows(whitening.whiten(frame))
    check(found, [*range(40), None], [*vectors, vectors[0]], 4)


def test_repeated_rows_and_vanishing_directions(spark):
    flat = np.hstack([spectrum(4, 50, 3), np.ones((50, 2)), np.zeros((50, 1))])
    twice = [*enumerate(flat), *enumerate(flat)]
    found = rows(whitening.whiten(table(spark, twice)))
    assert len(found) == 100 * 3 and {r["component"] for r in found} == {1, 2, 3}
    once = {(r["vec_id"], r["component"]): r["whitened"] for r in found}
    assert all(once[r["vec_id"], r["component"]] == r["whitened"] for r in found)


@pytest.mark.parametrize("vectors", [[], [(1, [1, 2])], [(i, [5, 5, 5]) for i in range(9)], [(1, None)]])
def test_nothing_to_whiten(spark, vectors):
    found = whitening.whiten(table(spark, vectors))
    assert found.columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    ]
    assert found.count() == 0


def test_sums_beyond_64_bits(spark):
    vectors = [(i, [1e6 * (i % 5), 9e8 - i, i]) for i in range(30)]
    kept = [[float(np.float32(c)) for c in v] for _, v in vectors]
    found = rows(whitening.whiten(table(spark, vectors), components=1))
    _, deviations, *_ = brute(kept)
    assert max(deviations) > 1 << 63
    assert {r["vec_id"]: int(r["deviation"]) for r in found} == dict(enumerate(deviations))


def test_query(spark, sf_dir):
    found = QUERIES["op11_shifted_cholesky_whitening"](spark, sf_dir)
    assert dict(found.dtypes)["deviation"] == "bigint"
    source = rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    usable = [r for r in source if r["embedding"] is not None and np.isfinite(np.array(r["embedding"], float)).all()]
    check(rows(found), [r["vec_id"] for r in usable], [r["embedding"] for r in usable], 8)
