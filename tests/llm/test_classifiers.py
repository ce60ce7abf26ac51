import itertools
import math
import random

import numpy as np
import pytest
from corpus import documents, empty_documents, odd_documents, rows
from pyspark.sql import functions as F

from ticketlake.llm import quality, toxicity
from ticketlake.llm.common import held_out, labelled_sample

SF = "/root/testdata/sf0.01"


def tables(spark, sf_dir=SF):
    return (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_fold(spark):
    import zlib

    found = spark.range(200).select("id", held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in found)


# Quality --------------------------------------------------------------------------------------


def test_prior_and_risk_on_known_mixture():
    draw = np.random.default_rng(5)
    good, bad = draw.normal(0, 1, (3000, 10)), draw.normal(4, 1, (900, 10))
    unlabelled = np.vstack([draw.normal(0, 1, (2100, 10)), bad])
    model = quality.fit_rows(good, unlabelled)
    assert abs(model.prior - 0.7) < 0.06
    p = model.probability(np.vstack([draw.normal(0, 1, (500, 10)), draw.normal(4, 1, (500, 10))]))
    assert (p[:500] >= 0.3).mean() > 0.98 and (p[500:] < 0.3).mean() > 0.95


def test_quality_on_held_out_rows(spark):
    docs, labels = tables(spark)
    scored = quality.score_documents(docs, quality.fit(docs, labels))
    assert scored.count() == docs.count()
    judged = scored.filter("held_out").join(labels, "doc_id")
    right = judged.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right >= 0.93
    assert judged.filter("quality = 1 and predicted = 0").count() == 0


def test_quality_reads_no_held_out_labels(spark):
    docs, labels = tables(spark)
    flipped = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, flipped)
    assert np.array_equal(a.weights, b.weights)


def test_quality_odd_rows(spark):
    _, labels = tables(spark)
    docs = odd_documents(spark)
    model = quality.fit(docs, labels.limit(0))
    found = rows(quality.score_documents(docs, model))
    assert len(found) == 14 and all(r["score"] == 0.5 and r["predicted"] == 1 for r in found)
    trained = quality.fit(*tables(spark))
    found = rows(quality.score_documents(docs, trained))
    assert len(found) == 14 and all(0 <= r["score"] <= 1 for r in found)
    assert quality.score_documents(empty_documents(spark), trained).count() == 0
    assert quality.fit(empty_documents(spark), no_labels(spark)).prior == 0.5


# Toxicity -------------------------------------------------------------------------------------


def brute_segments(values):
    """Maximal segments by their definition: take the best-scoring one (shortest, leftmost), then
    look left and right of it."""
    best = None
    for a, b in itertools.combinations(range(len(values) + 1), 2):
        score = math.fsum(values[a:b])
        if score > 1e-9 and (best is None or score > best[0] + 1e-9 or (abs(score - best[0]) <= 1e-9 and b - a < best[2] - best[1])):
            best = (score, a, b)
    if best is None:
        return []
    score, a, b = best
    left, right = brute_segments(values[:a]), brute_segments(values[b:])
    return [*left, (a, b - 1, score), *[(x + b, y + b, s) for x, y, s in right]]


@pytest.mark.parametrize("seed", range(25))
def test_segments_against_brute_force(seed):
    draw = random.Random(seed)
    other = -draw.choice([0.3, 0.7])
    values = [draw.choice([1.05, 2.3, 0.41]) if draw.random() < 0.35 else other for _ in range(22)]
    places = np.array([k for k, v in enumerate(values) if v > 0], int)
    scores = np.array([values[k] for k in places])
    found = toxicity.segments(scores, places, other)
    expected = brute_segments(values)
    assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in expected]
    assert np.allclose([s for *_, s in found], [s for *_, s in expected])


def test_toxicity_on_held_out_rows(spark):
    docs, labels = tables(spark)
    model = toxicity.fit(docs, labels)
    scored = toxicity.score_documents(docs, model)
    assert scored.count() == docs.count()
    judged = scored.join(labels, "doc_id")
    counts = {(r["toxic"], r["predicted"]): r["count"] for r in rows(judged.groupBy("toxic", "predicted").count())}
    assert counts.get((0, 1), 0) == 0
    assert counts[(1, 1)] >= 0.8 * (counts[(1, 1)] + counts.get((1, 0), 0))
    passages = scored.filter("predicted = 1").select(F.explode("passages").alias("p")).select("p.*")
    assert passages.filter("surplus <= 0 or first_token > last_token").count() == 0


def test_toxicity_reads_no_held_out_labels(spark):
    docs, labels = tables(spark)
    flipped = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert a.lexicon == b.lexicon and a.slope == b.slope


def test_toxicity_odd_rows(spark):
    docs = odd_documents(spark)
    untrained = toxicity.fit(docs, no_labels(spark))
    found = rows(toxicity.score_documents(docs, untrained))
    assert len(found) == 14 and all(r["score"] < 0.5 and r["predicted"] == 0 for r in found)
    model = toxicity.fit(*tables(spark))
    found = rows(toxicity.score_documents(docs, model))
    assert len(found) == 14 and all(r["predicted"] == 0 for r in found)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.schema.names == docs.schema.names and kept.count() == 14
    assert toxicity.score_documents(empty_documents(spark), model).count() == 0


def test_toxic_words_decide(spark):
    model = toxicity.fit(*tables(spark))
    worst = sorted(model.lexicon, key=model.lexicon.get)[-4:]
    bad = " ".join(w.decode().rstrip("*") for w in worst)
    docs = documents(spark, {1: f"some plain text {bad} {bad} and more", 2: "some plain text and more"})
    assert {r["doc_id"]: r["predicted"] for r in rows(toxicity.score_documents(docs, model))} == {1: 1, 2: 0}


def test_sample_is_bounded_by_rows(spark):
    """A document that is repeated many times is one row of the sample."""
    docs = spark.range(4_000).selectExpr("id % 4 AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(40).selectExpr("id AS doc_id", "int(id % 2) AS toxic")
    sample = labelled_sample(docs, labels, "toxic", 10)
    assert sample.count() == sample.select("doc_id").distinct().count() <= 4


def scan_steps(hits):
    """Segments of hits that all lie apart, the case in which a scan back would visit all of them."""
    import time

    places = np.arange(hits) * 100
    start = time.perf_counter()
    assert len(toxicity.segments(np.full(hits, 1.0), places, -0.1)) == hits
    return time.perf_counter() - start


def test_segments_take_linear_time():
    assert scan_steps(64_000) < 8 * max(scan_steps(16_000), 0.02)


@pytest.mark.parametrize("seed", range(20))
def test_segments_are_maximal(seed):
    """Against the definition, by recursion on the best segment of what is left."""
    draw = np.random.default_rng(seed)
    scores = np.where(draw.random(40) < 0.4, draw.integers(1, 6, 40), -2).astype(float)

    def best(low, high):
        total = np.concatenate([[0.0], np.cumsum(scores[low:high])])
        found = max(
            ((total[j] - total[i], -(j - i), i, j) for i in range(high - low) for j in range(i + 1, high - low + 1)),
            default=(0, 0, 0, 0),
        )
        if found[0] <= 0:
            return []
        i, j = low + found[2], low + found[3]
        return [*best(low, i), (i, j - 1, found[0]), *best(j, high)]

    places = np.flatnonzero(scores > 0)
    got = toxicity.segments(scores[places], places, -2.0)
    assert sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in best(0, 40)))
    assert len(got) >= 1
