import random
import zlib
from itertools import groupby

import duckdb
import numpy as np
import pytest
import tokenizers
from corpus import documents, empty_documents, odd_documents, rows, words
from pyspark.sql import functions as F

from ticketlake.llm import common, mixing, packing
from ticketlake.llm.common import running_position, settle, spread
from ticketlake.llm.oracle import mixing_sql


def test_running_position(spark):
    table = settle(
        spark.range(500).select(
            F.when(F.col("id") % 3 == 0, None).otherwise(F.lit("hot")).alias("key"),
            spread(F.col("id")).alias("place"),
            (F.col("id") % 7).alias("weight"),
        )
    )
    found = rows(running_position(table, ["key"], ["place", "weight"], F.col("weight"), "start"))
    assert len(found) == 500
    for key in (None, "hot"):
        total = 0
        for r in sorted((r for r in found if r["key"] == key), key=lambda r: r["place"]):
            assert r["start"] == total
            total += r["weight"]


# Mixing ---------------------------------------------------------------------------------------


def water_fill(budget, children):
    """children: (name, capacity, weight). One full child after the other, by whole numbers."""
    taken, open_ = {}, sorted(children, key=lambda c: (c[1] / c[2], c[0]))
    while open_:
        name, capacity, weight = open_[0]
        if capacity * sum(c[2] for c in open_) <= weight * budget:
            taken[name] = capacity
            budget -= capacity
            open_.pop(0)
        else:
            whole = sum(c[2] for c in open_)
            taken |= {n: w * budget // whole for n, _, w in open_}
            break
    return taken


def brute_allocation(leaves, mixture, budget):
    """leaves: {(domain, language, source): tokens}."""
    out = {}

    def down(prefix, amount):
        level = mixing.LEVELS[len(prefix)]
        names = sorted({leaf[len(prefix)] for leaf in leaves if leaf[: len(prefix)] == prefix})
        children = []
        for name in names:
            capacity = mixture.max_epochs * sum(
                n for leaf, n in leaves.items() if leaf[: len(prefix) + 1] == (*prefix, name)
            )
            children.append((name, capacity, mixture.weights.get(level, {}).get(name, 1)))
        for name, share in water_fill(amount, [c for c in children if c[2] > 0]).items():
            if len(prefix) == 2:
                out[(*prefix, name)] = share
            else:
                down((*prefix, name), share)

    down((), budget)
    return out


@pytest.mark.parametrize("budget", [None, 100, 5_000, 10**7])
def test_allocation_against_brute_force(spark, sf_dir, budget):
    mixture = mixing.Mixture(budget=budget, max_epochs=3)
    table = settle(mixing.leveled(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    found = rows(mixing.allocate(table, mixture))
    leaves = {(r["domain"], r["language"], r["source"]): r["leaf_tokens"] for r in found}
    expected = brute_allocation(leaves, mixture, budget if budget is not None else sum(leaves.values()))
    assert {k: r["take"] for k, r in zip(leaves, found, strict=True)} == expected


def test_shortage_stays_among_siblings():
    mixture = mixing.Mixture(weights={}, max_epochs=1)
    leaves = {("web", "en", "a"): 10, ("web", "en", "b"): 500, ("web", "de", "c"): 500, ("news", "en", "d"): 900}
    taken = brute_allocation(leaves, mixture, 800)
    assert taken == {("web", "en", "a"): 10, ("web", "en", "b"): 190, ("web", "de", "c"): 200, ("news", "en", "d"): 400}


@pytest.mark.parametrize("budget", [None, 3_000, 10**7])
def test_selection_against_sql(spark, sf_dir, budget):
    mixture = mixing.Mixture(budget=budget)
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    expected = sorted(connection.sql(mixing_sql(mixture)).fetchall())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    table = settle(mixing.leveled(docs))
    selected = mixing.select_documents(table, mixture)
    assert sorted(tuple(r) for r in selected.collect()) == expected
    mixed = mixing.mix_documents(docs, mixture)
    assert mixed.columns == docs.columns
    read = sorted(r["doc_id"] for r in mixed.select("doc_id").collect())
    assert read == sorted(r[0] for r in expected)


def test_mixing_odd_rows(spark):
    docs = odd_documents(spark)
    mixture = mixing.Mixture(weights={}, max_epochs=2, budget=10**9)
    mixed = mixing.mix_documents(docs, mixture)
    assert mixed.columns == docs.columns
    read = [r["doc_id"] for r in mixed.select("doc_id").collect()]
    assert read.count(1) == 2 and read.count(8) == 4 and read.count(None) >= 2
    assert mixing.mix_documents(empty_documents(spark)).count() == 0
    assert mixing.select_documents(settle(mixing.leveled(empty_documents(spark)))).count() == 0
    table = settle(mixing.leveled(docs))
    taken = mixing.select_documents(table, mixing.Mixture(weights={}, budget=500))
    assert 0 < taken.agg(F.sum("taken")).first()[0] <= 500


# Packing --------------------------------------------------------------------------------------


def laid_out(plan):
    """The sequences of a plan as lists of (offset, length), with every rank used once."""
    sequences, used = {}, {}
    for length, first, pieces, sequence, per, offset in plan.runs:
        for k in range(pieces):
            sequences.setdefault(sequence + k // per, []).append((offset + k % per * length, length))
            used.setdefault(length, set()).add(first + k)
    return sequences, used


def least_bins(sizes, capacity):
    """The optimum by exhaustive search."""
    best = len(sizes)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for room in {*bins}:
            if room >= sizes[k]:
                rest = list(bins)
                rest.remove(room)
                place(k + 1, [*rest, room - sizes[k]])
        place(k + 1, [*bins, capacity - sizes[k]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_plans_are_sound_and_the_reduction_loses_nothing(seed):
    draw = random.Random(seed)
    capacity = draw.choice([10, 17, 30])
    sizes = [draw.randint(1, capacity) for _ in range(draw.randint(1, 9))]
    counts = {s: sizes.count(s) for s in sizes}
    plan = packing.Plan(counts, capacity)
    sequences, used = laid_out(plan)
    assert used == {s: set(range(n)) for s, n in counts.items()}
    assert sorted(sequences) == list(range(plan.sequences))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    fixed = [length for s, pieces in sequences.items() if s < plan.fixed for _, length in pieces]
    rest = list(sizes)
    for length in fixed:
        rest.remove(length)
    optimum = least_bins(sizes, capacity)
    assert plan.fixed + (least_bins(rest, capacity) if rest else 0) == optimum
    assert plan.sequences <= optimum + 1


def test_large_histogram_reaches_the_bound():
    draw = np.random.default_rng(2)
    lengths, counts = np.unique(np.clip(draw.lognormal(6, 1, 400_000), 1, 2048).astype(int), return_counts=True)
    plan = packing.Plan(dict(zip(lengths.tolist(), (counts * 1000).tolist(), strict=True)), 2048)
    bound = -(-int((lengths * counts).sum() * 1000) // 2048)
    assert plan.sequences <= bound * 1.001 + 1
    assert len(plan.runs) < 50_000


def test_packing_against_the_tokenizer(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = rows(packing.pack_documents(docs, keep_ids=True))
    exact = tokenizers.Tokenizer.from_file(packing.VOCABULARY)
    by_doc = {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
    texts = {r["doc_id"]: r["text"] for r in rows(docs)}
    assert by_doc.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids = [*exact.encode(text, add_special_tokens=False).ids, 0]
        parts = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [t for r in parts for t in r["ids"]] == ids
        assert [(r["start"], r["length"]) for r in parts] == packing.cut(len(ids), 2048)
        for r in parts:
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    assert_gapless(found, 2048)
    total = sum(r["length"] for r in found)
    assert len({r["sequence_id"] for r in found}) <= -(-total // 2048) + 1


def assert_gapless(found, capacity):
    found = sorted(found, key=lambda r: (r["sequence_id"], r["offset"]))
    for _, pieces in groupby(found, key=lambda r: r["sequence_id"]):
        end = 0
        for r in pieces:
            assert r["offset"] == end
            end += r["length"]
        assert end <= capacity


def test_encoders_agree():
    encoder = packing.Encoder(packing.VOCABULARY, packing.RANKS)
    exact = tokenizers.Tokenizer.from_file(packing.VOCABULARY)
    texts = ["", "a", "<|endoftext|> x", " " * 5000 + "y", "été \U0001f600 1234\r\n\t 'll we're", words(3, 500), "\n" * 300, "x" * 30_000]
    for text in texts:
        assert list(encoder.ids(text)) == exact.encode(text, add_special_tokens=False).ids


def test_packing_odd_rows(spark):
    found = rows(packing.pack_documents(odd_documents(spark), capacity=256))
    assert_gapless(found, 256)
    assert sum(r["piece"] == 0 for r in found) == 14
    assert sorted(r["length"] for r in found if r["doc_id"] in (3, 4)) == [1, 1]
    assert all(r["length"] == 256 for r in found if r["piece"] > 0)
    assert packing.pack_documents(empty_documents(spark)).count() == 0


def test_many_leaves_are_joined(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    few = sorted(r["doc_id"] for r in mixing.mix_documents(docs).collect())
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    assert sorted(r["doc_id"] for r in mixing.mix_documents(docs).collect()) == few
