"""License automata, personal data and repeated spans."""

import random
import re

import numpy as np
import pytest
from corpus import CLASHING, documents, empty_documents, odd_documents, rows, words

from pyspark.sql import functions as F

from ticketlake.llm import chunk_dedup, licenses, pii
from ticketlake.llm.queries import QUERIES

# Licenses -------------------------------------------------------------------------------------


def plain_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def test_base_places_against_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))}
    for r in rows(QUERIES["op4_template_automata"](spark, sf_dir)):
        w = plain_words(texts[r["doc_id"]])
        places = [
            (k, label)
            for phrase, label in licenses.PHRASES.items()
            for k in range(len(w))
            if w[k : k + len(phrase.split())] == phrase.split()
        ]
        assert r["n_words"] == len(w) and r["n_base"] == len(places)
        assert r["first_word"] == (min(places)[0] if places else None)
        assert r["last_word"] == (max(places)[0] if places else None)
        base = {label for _, label in places}
        assert r["base_labels"] == ",".join(sorted(base))
        assert base <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1


def as_regex(template):
    """The template as a pattern over words that are each followed by a space."""
    pieces, last = [], 0
    for mark in re.finditer(r"<<(optional|end|var:(\d+))>>", template):
        pieces.append("".join(f"{re.escape(w)} " for w in plain_words(template[last : mark.start()])))
        last = mark.end()
        pieces.append({"optional": "(?:", "end": ")?"}.get(mark[1], rf"(?:\S+ ){{1,{mark[2]}}}"))
    pieces.append("".join(f"{re.escape(w)} " for w in plain_words(template[last:])))
    return re.compile("".join(pieces))


@pytest.mark.parametrize("seed", range(4))
def test_automata_accept_what_the_pattern_accepts(seed):
    templates = [
        "alpha beta <<optional>>gamma <<optional>>delta<<end>><<end>> omega",
        "alpha <<var:2>> omega",
        "<<optional>>gamma<<end>> alpha <<optional>>version <<var:3>><<end>> beta",
        "alpha alpha beta",
    ]
    draw = random.Random(seed)
    for template in templates:
        automaton, pattern = licenses.compile_template(template), as_regex(template)
        for _ in range(300):
            w = draw.choices(["alpha", "beta", "gamma", "delta", "omega", "version", "x"], k=draw.randint(0, 8))
            data = [x.encode() for x in w]
            for start in range(len(w)):
                accepted = automaton.match(data, start) >= 0
                assert accepted == bool(pattern.match("".join(f"{x} " for x in w[start:]))), (template, w, start)


def test_templates_on_real_notices():
    scanner = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES)

    def labels(text):
        return {label for *_, label in scanner.scan(text)[2]}

    assert labels("x Licensed under the Apache License, Version 2.0. y") == {"apache-2.0-notice"}
    assert labels("Licensed under the Apache License, Version 1.1.") == set()
    assert labels("This work is licensed under the GNU General Public License, version 3.") == {"gpl-notice"}
    assert labels("Released under the MIT License.") == {"mit-notice"}
    assert labels("Released under the terms of the MIT License.") == {"mit-notice"}
    assert labels("Licensed under CC BY-NC 4.0.") == {"cc-by-nc-4.0-notice"}
    assert labels("Released under an MIT License.") == set()
    mit = re.sub(r"<<[^>]*>>", " ", licenses.TEMPLATES["mit"])
    assert labels(f"Copyright (c) 2020 Someone\n\n{mit.upper()}\n\nTHE SOFTWARE IS PROVIDED") == {"mit"}
    assert labels(mit.replace("free of charge", "at a charge")) == set()


def test_bad_templates():
    for bad in ("<<optional>>a", "<<var:2>> b", "<<optional>>a<<end>>"):
        with pytest.raises(ValueError):
            licenses.compile_template(bad)


# Personal data --------------------------------------------------------------------------------


def luhn(digits):
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(v * 2 - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def plain_spans(text):
    """The kinds by their plain patterns."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    found = []
    for order, (kind, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            fine = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                found.append((m.start(), order, m.end(), kind))
    return [(start, kind, end) for start, _, end, kind in sorted(found)]


@pytest.mark.parametrize("seed", range(6))
def test_base_spans_against_plain_patterns(seed):
    draw = random.Random(seed)
    pieces = ["a", "b.c", "@", "x@y.zz", ".", "1", "25", "256", "1.2.3.4", " ", "-", "+", "(", ")", "é", "4111 1111 1111 1111", "+1 650 555 1234", "\n", "00", "%"]
    for _ in range(400):
        text = "".join(draw.choices(pieces, k=draw.randint(1, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_base_counts_on_the_table(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))}
    import hashlib

    for r in rows(QUERIES["op10_offset_deobfuscation"](spark, sf_dir)):
        spans = plain_spans(texts[r["doc_id"]] or "")
        listed = ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) <= set(r["spans"].split(","))
        for kind in pii.KINDS:
            assert r[f"n_{kind}"] == sum(s[1] == kind for s in spans)


@pytest.mark.parametrize(
    "text,kind,source",
    [
        ("write john.doe [at] mail (dot) example [dot] com now", "email", "john.doe [at] mail (dot) example [dot] com"),
        ("mail me: jane at example dot org please", "email", "jane at example dot org"),
        ("so jоhn@exаmple.com it is", "email", "jоhn@exаmple.com"),
        ("user＠mail．example．com", "email", "user＠mail．example．com"),
        ("ask jane&#64;example.com", "email", "jane&#64;example.com"),
        ("call plus one six five zero five five five one two three four", "phone", "plus one six five zero five five five one two three four"),
        ("ip one nine two dot one six eight dot zero dot one ok", "ip", "one nine two dot one six eight dot zero dot one"),
        ("card four double one one triple one four one two one one one one one one one x", None, None),
        ("pay ４１１１ 1111 1111 1111 now", "card", "４１１１ 1111 1111 1111"),
        ("card four one one one one one one one one one one one one one one one thanks", "card", "four one one one one one one one one one one one one one one one"),
        ("we met at noon dot matrix", None, None),
        ("one two three four five", None, None),
    ],
)
def test_disguises(text, kind, source):
    base, spans = pii.all_spans(text)
    assert base == []
    assert [(k, text[a:b]) for a, k, b in spans] == ([(kind, source)] if kind else [])


@pytest.mark.parametrize(
    "text,remnant,source",
    [
        ("so jоhn.smith@example.com it is", "hn.smith@example.com", "jоhn.smith@example.com"),
        ("to john@example.cоm, please", "john@example.c", "john@example.cоm"),
        ("to john@mail.example [dot] com now", "john@mail.example", "john@mail.example [dot] com"),
    ],
)
def test_disguises_that_hold_a_base_match(spark, text, remnant, source):
    base, spans = pii.all_spans(text)
    assert [text[a:b] for a, _, b in base] == [remnant]
    assert set(base) < set(spans) and source in [text[a:b] for a, _, b in spans]
    redacted = rows(pii.redact_documents(documents(spark, {1: text})))[0]["text"]
    assert redacted == text.replace(source, "[EMAIL]")


@pytest.mark.parametrize(
    "source",
    [
        "jane@example dot com",
        "jane [at] example dot com",
        "jane at example [dot] com",
        "jane at example dot dev",
        "jane at example dot co dot uk",
        "john dot smith@example.com",
        "john dot smith at example.com",
        "jane [  at  ] example.com",
        "jane(   at   )example [  punkt  ] museum",
        "jane\t@example.com",
        "jane @ example dot com",
        "jane at example d\u200bot app",
    ],
)
def test_mixed_disguises(source):
    text = f"So, {source}, please"
    assert ("email", source) in [(k, text[a:b]) for a, k, b in pii.all_spans(text)[1]]


@pytest.mark.parametrize("text", ["look at example.com", "we met at noon dot matrix", "a @ b", "to bob@a.com dot Then"])
def test_signs_in_prose_stay(text):
    base, spans = pii.all_spans(text)
    assert base == spans


def test_hints_rule_nothing_out():
    draw = random.Random(4)
    pieces = ["[", " ", "  ", "(", "at", "@", "dot", "punkt", ".", "]", ")", "&#64;", "&period;", "%40", "\t", "\n", "x", "plus", "one", "7"]
    for _ in range(20_000):
        text = "".join(draw.choices(pieces, k=draw.randint(2, 9)))
        if any(p.search(text) for p in (pii._AT, pii._DOT)) or any(len(m[0]) > 1 for m in pii._LOOSE_AT.finditer(text)):
            assert pii._SIGN_HINT.search(text), text
        if pii._PLUS.search(text) or pii._SPELLED.search(text) and pii._SPELLED_PART.search(text):
            assert pii._DIGIT_HINT.search(text), text


def test_clean_text_gets_no_spans():
    assert all(pii.all_spans(words(k, 3000)) == ([], []) for k in range(5))


def test_redaction(spark):
    texts = {1: "a bob@example.com b +1 650 555 1234", 2: "nothing here", 3: None, 4: "", 5: "x at y dot com"}
    found = {r["doc_id"]: r for r in rows(pii.redact_documents(documents(spark, texts)))}
    assert [found[k]["text"] for k in texts] == ["a [EMAIL] b [PHONE]", "nothing here", None, "", "[EMAIL]"]
    assert found[1]["n_chars"] == len("a [EMAIL] b [PHONE]")


# Repeated spans -------------------------------------------------------------------------------


def plain_cuts(data: bytes):
    """The cuts by their definition, one place at a time."""
    gear = [int(g) for g in chunk_dedup._GEAR]
    candidates = []
    for end in range(1, len(data)):
        window = data[max(0, end - 16) : end]
        value = sum(gear[b] << (len(window) - 1 - k) for k, b in enumerate(window)) % (1 << 32)
        if value >> (32 - chunk_dedup.CUT_BITS) == 0 and data[end] & 0xC0 != 0x80:
            candidates.append(end)
    kept = [e for k, e in enumerate(candidates) if e - (candidates[k - 1] if k else -chunk_dedup.MIN_CHUNK) >= chunk_dedup.MIN_CHUNK]
    ends = []
    for end in [*kept, len(data)]:
        start = ends[-1] if ends else 0
        for forced in range(start + chunk_dedup.MAX_CHUNK, end, chunk_dedup.MAX_CHUNK):
            while forced < len(data) and data[forced] & 0xC0 == 0x80:
                forced += 1
            if forced < end:
                ends.append(forced)
        ends.append(end)
    return ends


@pytest.mark.parametrize("text", [words(1, 900), "été à l'école \U0001f600 " * 300, "x" * 5000, "é" * 3000, "a", "Ab" * 10])
def test_cuts_against_brute_force(text):
    data = text.encode()
    assert chunk_dedup.cuts(np.frombuffer(data, np.uint8)).tolist() == plain_cuts(data)


def test_cuts_resist_shifts():
    text = words(2, 800)
    ends = chunk_dedup.cuts(np.frombuffer(text.encode(), np.uint8))
    moved = chunk_dedup.cuts(np.frombuffer(("inserted " + text).encode(), np.uint8)) - len("inserted ")
    assert set(ends[ends > 64].tolist()) == set(moved[moved > 64].tolist())


def brute_spans(texts, min_span=chunk_dedup.MIN_SPAN):
    first, repeats = {}, []
    for i in sorted(texts):
        data, start = (texts[i] or "").encode(), 0
        for end in plain_cuts(data) if data else []:
            piece = data[start:end]
            if piece in first:
                repeats.append((i, len(data[:start].decode()), len(data[:end].decode()), first[piece]))
            else:
                first[piece] = i
            start = end
    spans = []
    for i, start, end, origin in repeats:
        if spans and spans[-1][0] == i and spans[-1][2] == start:
            last = spans.pop()
            spans.append((i, last[1], end, min(last[3], origin)))
        else:
            spans.append((i, start, end, origin))
    return {s for s in spans if s[2] - s[1] >= min_span}


def test_repeats_against_brute_force(spark):
    passage = words(50, 60)
    texts = {k: f"{words(k, 90)} {passage} {words(100 + k, 70)}" for k in range(8)}
    texts |= {20: words(3, 90), 21: words(300, 200), 22: "to " * 400, 23: None, 24: "", 25: texts[2]}
    found = rows(chunk_dedup.repeated_spans(documents(spark, texts)))
    assert {(r["doc_id"], r["start"], r["end"], r["first_doc_id"]) for r in found} == brute_spans(texts)
    for k in range(1, 8):
        hit = [r for r in found if r["doc_id"] == k and r["first_doc_id"] == 0]
        assert hit and texts[k][hit[0]["start"] : hit[0]["end"]] in passage + " " + passage
    assert not [r for r in found if r["doc_id"] in (0, 21)]


def test_short_passages_are_found(spark):
    """Passages of just over fifty words, planted in pairs of documents."""
    texts = {}
    for k in range(60):
        passage = words(1000 + k, 55)
        for side in (0, 1):
            texts[2 * k + side] = f"{words(2000 + 2 * k + side, 80)} {passage} {words(4000 + 2 * k + side, 40)}"
    found = {r["doc_id"] for r in rows(chunk_dedup.repeated_spans(documents(spark, texts)))}
    assert len(found) >= 55 and all(i % 2 for i in found)


def test_query_reports_short_repeats(spark, tmp_path):
    """Spans below MIN_SPAN: passages that share one or two chunks, and copies of short texts."""
    texts = {k: f"{words(k, 40)} {words(50, 20)} {words(100 + k, 30)}" for k in range(6)}
    texts |= {20: "a short text", 21: "a short text", 22: words(7, 12), 23: words(7, 12)}
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    found = rows(QUERIES["op3_gear_chunks"](spark, str(tmp_path)))
    spans = {(r["doc_id"], r["start"], r["end"], r["first_doc_id"]) for r in found}
    assert spans == brute_spans(texts, 1)
    assert {(21, 0, 12, 20), (23, 0, len(texts[23]), 22)} <= spans
    assert all(any(s[0] == k and s[3] == 0 for s in spans) for k in range(1, 6))


def test_repeats_are_cut_out(spark):
    text = words(9, 200)
    kept = {r["doc_id"]: r for r in rows(chunk_dedup.drop_repeats(documents(spark, {1: text, 2: text, 3: None, 4: "own"})))}
    assert kept[1]["text"] == text and kept[3]["text"] is None and kept[4]["text"] == "own"
    assert len(kept[2]["text"]) < 0.1 * len(text)


@pytest.mark.parametrize("operator", [licenses.scan_documents, pii.find_personal_data, pii.redact_documents])
def test_odd_rows(spark, operator):
    assert operator(odd_documents(spark)).count() == 14
    assert operator(empty_documents(spark)).count() == 0


def test_odd_rows_of_repeats(spark):
    docs = odd_documents(spark)
    found = {r["doc_id"] for r in rows(chunk_dedup.repeated_spans(docs))}
    assert found == {9}  # the repeated rows of 8 are one document
    copies = docs.filter("doc_id = 8").withColumn("doc_id", F.lit(20).cast("long"))
    found = [r for r in rows(chunk_dedup.repeated_spans(docs.unionByName(copies))) if r["doc_id"] == 20]
    assert len(found) == 1 and (found[0]["start"], found[0]["first_doc_id"]) == (0, 8)
    assert chunk_dedup.repeated_spans(empty_documents(spark)).count() == 0
    kept = chunk_dedup.drop_repeats(odd_documents(spark))
    assert kept.count() == 14 and set(CLASHING) <= set(kept.columns)
