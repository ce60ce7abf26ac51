import random

import duckdb
import numpy as np
import pytest
from corpus import SCHEMA, documents, empty_documents, odd_documents, rows, words

from ticketlake.llm import near_dedup
from ticketlake.llm.components import connected_components
from ticketlake.llm.oracle import NEAR_DUPLICATES


def brute_components(links):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_union_find(spark, seed):
    draw = random.Random(seed)
    links = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)]
    links += [(100 + k, 101 + k) for k in range(30)] + [(200, 200 + k) for k in range(1, 40)]
    found = connected_components(spark.createDataFrame(links, "a long, b long"))
    expected = brute_components([(a, b) for a, b in links if a != b])
    assert {r["node"]: r["component"] for r in rows(found)} == expected


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(texts):
    """Every pair on its full sets."""
    sets = {}
    for i, text in texts.items():
        w = near_dedup.split_words(text or "")
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    root = brute_components(links)
    return {i: (len(sets[i]), root.get(i, i)) for i in sets}


def mutated(text, seed, edits):
    draw, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[draw.randrange(len(w))] = f"new{draw.randrange(10**6)}"
    return " ".join(w)


def test_against_brute_force_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", 7)
    base = words(1, 150)
    texts = {k: mutated(base, k, k % 6) for k in range(60)}
    texts |= {100 + k: words(100 + k, 40) for k in range(20)}
    texts |= {200: "one two three", 201: "ONE two  three", 202: "one two", 203: "", 204: None}
    found = rows(near_dedup.near_duplicates(documents(spark, texts)))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(texts)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_spanning_links_join_what_all_links_join():
    draw = np.random.default_rng(3)
    pool = draw.integers(0, 2**63, 300, dtype=np.uint64)
    sets = [np.unique(draw.choice(pool[:60], 55)) for _ in range(30)]
    first = np.arange(30) < 15
    for same in (True, False):
        pairs = [
            (x, y)
            for x in range(30)
            for y in range(30)
            if (x < y if same else first[x] and not first[y])
            and 100 * len(np.intersect1d(sets[x], sets[y])) >= 60 * len(np.union1d(sets[x], sets[y]))
        ]
        found = near_dedup._spanning(sets, first, same, 60)
        assert brute_components(found) == brute_components(pairs)


def test_against_sql(spark, sf_dir):
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    expected = set(connection.sql(NEAR_DUPLICATES).fetchall())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert {tuple(r) for r in near_dedup.near_duplicates(docs).collect()} == expected


def test_odd_rows(spark):
    found = rows(near_dedup.near_duplicates(odd_documents(spark)))
    assert len(found) == 14
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert by_id[2]["component_id"] == 1 and not by_id[2]["kept"]
    assert [by_id[k]["n_shingles"] for k in (3, 4, 5, 6, 9)] == [0, 0, 0, 1, 1]
    assert all(by_id[k]["kept"] for k in (1, 3, 4, 5, 6, 7, 8, 9, 10, 11))
    assert all(r["kept"] and r["component_id"] is None for r in found if r["doc_id"] is None)


def test_one_stays(spark):
    docs = odd_documents(spark)
    stays = near_dedup.drop_near_duplicates(docs)
    assert stays.schema.names == docs.schema.names
    ids = sorted(r["doc_id"] for r in rows(stays) if r["doc_id"] is not None)
    assert ids == [1, 3, 4, 5, 6, 7, 8, 9, 10, 11]
    assert stays.filter("doc_id is null").count() == 2


def test_empty(spark):
    assert near_dedup.near_duplicates(empty_documents(spark)).count() == 0
    assert near_dedup.drop_near_duplicates(empty_documents(spark)).count() == 0


def test_links_of_a_repeated_id(spark):
    """Every text of a document with several rows links it."""
    a, b = words(31, 60), words(32, 60)
    rows_ = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (4, words(33, 60)), (7, b), (7, words(33, 60))]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows_], SCHEMA)
    found = {(r["doc_id"], r["component_id"]) for r in rows(near_dedup.near_duplicates(frame))}
    assert found == {(i, 1) for i in (1, 2, 3, 4, 7)}
    assert [r["doc_id"] for r in rows(near_dedup.drop_near_duplicates(frame))] == [1]
