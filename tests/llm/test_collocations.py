import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from corpus import documents, empty_documents, odd_documents, odd_rows, rows, words
from hypothesis import given, settings, strategies as st

from ticketlake.llm import collocations
from ticketlake.llm.queries import ORACLE, QUERIES



@st.composite
def keys_of_halves(draw):
    half = draw(st.sampled_from([4, 20, 33, 64]))
    part = st.integers(0, 2**half - 1)
    return half, draw(st.lists(st.tuples(part, part), min_size=1, max_size=60))


def brute(texts, min_count=10, top=2000):
    """texts: (lang, text)."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in texts:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            for k in (1, 2, 3):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 2 * b >= a for q, b in found.items()):
                continue
            score, _, left, right = min(
                (1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))
            )
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def found(df):
    return sorted(tuple(r.values()) for r in rows(df))


def prose(seed, n, vocabulary=12):
    draw = random.Random(seed)
    names = ["The", "of", "été", "a", "Zürich", "x1", "(b)", "long-word", "\U0001f600", "c", "d", "e"][:vocabulary]
    return "".join(draw.choice(names) + draw.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", " ? "]) for _ in range(n))


@given(keys_of_halves())
def test_permutation_is_one_to_one(halves):
    half, keys = halves
    high, low = (np.array(c, dtype=np.uint64) for c in zip(*keys, strict=True))
    there = collocations.permuted(high, low, half)
    back = collocations.restored(*there, half)
    assert max(there[0].max(), there[1].max()) < 2**half
    assert (back[0] == high).all() and (back[1] == low).all()


@given(
    st.lists(st.tuples(*[st.integers(0, 2**42 - 1)] * 3), min_size=1), st.sampled_from([2, 3]), st.integers(2, 42)
)
def test_packing_is_lossless(ids, size, width):
    columns = [np.array(c, dtype=np.uint64) % 2**width for c in zip(*ids, strict=True)][:size]
    halves = collocations.packed(size, columns, width)
    assert max(h.max() for h in halves) < 2 ** collocations.half_bits(width)
    sizes, back = collocations.unpacked(*halves, width)
    assert (sizes == size).all()
    assert all((a == b).all() for a, b in zip(columns, back, strict=False))


@given(keys_of_halves(), st.lists(st.integers(1, 2**40), min_size=60, max_size=60), st.integers(0, 9))
@settings(max_examples=200)
def test_filters_are_lossless(halves, counts, range_bits):
    """Keys that agree in one half or in all their first bits included."""
    half, keys = halves
    range_bits = min(half, range_bits)
    keys = keys + [(h, l ^ 1) for h, l in keys[:5]] + [(h ^ 1, l) for h, l in keys[:5]]
    expected = Counter()
    for key, n in zip(keys, counts * 2, strict=False):
        expected[key] += n
    high, low = (np.array(c, dtype=np.uint64) for c in zip(*keys, strict=True))
    n = np.array((counts * 2)[: len(keys)], dtype=np.int64)
    got = Counter()
    for batch in collocations._filters("en", collocations.summed(high, low, n), half, range_bits):
        for row in batch.to_pylist():
            h, l, c = collocations.entries(row, half, range_bits)
            assert list(zip(h.tolist(), l.tolist(), strict=True)) == sorted(zip(h.tolist(), l.tolist(), strict=True))
            got.update(dict(zip(zip(h.tolist(), l.tolist(), strict=True), c.tolist(), strict=True)))
    assert got == expected


@pytest.mark.parametrize("limit", [7, 20, 64, 1000])
def test_chunks_repeat_context_only(limit):
    for text in (prose(1, 200), words(2, 100), "a" * 300, "a b " * 90, "", " " * 99, "x" * 50 + " y z " + "w" * 90):
        data = text.encode()
        pieces = Counter(), Counter()
        for k in (1, 2, 3):
            for piece in re.split(rb"[.,;:!?\n\x0b\x0c\r]", data):
                w = re.findall(rb"[^ \t]+", piece)
                pieces[0].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
            for part, skip in collocations.chunks(data, limit):
                for j, piece in enumerate(re.split(rb"[.,;:!?\n\x0b\x0c\r]", part)):
                    w, own = re.findall(rb"[^ \t]+", piece), skip if j == 0 else 0
                    pieces[1].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1) if i + k > own)
        assert pieces[0] == pieces[1]


@pytest.mark.parametrize(
    "options", [{}, {"limit": 40}, {"min_bits": 1}, {"min_bits": 41}, {"flush": 20, "occurrences": 16}, {"top": 5, "min_count": 4}]
)
def test_against_brute_force(spark, options):
    """Texts in parts, colliding word hashes, many small filters and ranges."""
    texts = [(("en", "de", None)[i % 3], prose(i, 150)) for i in range(12)]
    frame = spark.createDataFrame(texts, "lang string, text string").repartition(5)
    own = {k: v for k, v in options.items() if k in ("top", "min_count")}
    assert found(collocations.collocations(frame, **options)) == brute(texts, **own)


def test_odd_rows(spark):
    expected = brute([(r[2], r[1]) for r in odd_rows()])
    assert found(collocations.collocations(odd_documents(spark))) == expected
    assert expected


def test_empty_tables(spark):
    assert collocations.collocations(empty_documents(spark)).count() == 0
    assert collocations.collocations(documents(spark, {1: "one two three"})).count() == 0


def test_hot_phrase_of_one_text(spark):
    text = "and so on " * 30_000
    (row,) = found(collocations.collocations(documents(spark, {1: text}), limit=1 << 14, top=1))
    assert row == brute([("en", text)], top=1)[0]


def test_query_against_sql(spark, sf_dir):
    result = QUERIES["op13_quotient_filter_collocations"](spark, sf_dir)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    expected = db.sql(ORACLE["op13_quotient_filter_collocations"])
    assert result.columns == expected.columns
    assert found(result) == sorted(expected.fetchall())
