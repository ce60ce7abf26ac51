"""Collocations: phrases of two or three words that stay together, counted in quotient filters.

Texts are cut at punctuation and line breaks into pieces, those into words. A first pass counts the
words of each language and gives every word an id. The second pass packs the ids of two or three
neighbours and the phrase's length into a key of up to 128 bits, permutes its bits invertibly, and
counts keys in counting quotient filters: the first bits of a permuted key are its quotient, which is
only stored as a place, all others its remainder, which is stored in full. So the counters are compact, nothing
is lost, and filters are sorted: those of all tasks are merged by ranges of the quotient. The counts
are turned back into word ids and, by the word table, into phrases.

Every word counts as ``MIN_COUNT`` or more occurrences do: phrases that hold a rarer word can't be
frequent and aren't counted. The tasks know frequent words by a bitmap of a fixed size, in which a
rare word may pass for a frequent one; its phrases are then counted and dropped for their count.

Word ids are hashes, of so many bits (41 at most) that about ``EXCEPTIONS`` words are expected to
share the hash of a frequent word. All words of the table are compared: those that do are listed,
with ids of their own above all hashes if they are frequent, so ids are exact. The list is
broadcast; it outgrows ``EXCEPTIONS`` beyond 10**17 pairs of a word and a frequent word.

Nothing is held per language or per key in one task: a task's filters hold ``FLUSH`` phrases at
most, ranges are so narrow that one holds about ``RANGE`` phrase occurrences, and a frequent phrase
arrives once per filter. Very long texts are cut at piece borders, or, in very long pieces, between
words, the last two words repeated without counting them again.

Defined results: a null text is empty, a null language is ``und``; empty tables give no rows;
repeated rows count each time; other columns are ignored. Ids of documents play no part.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ticketlake.llm.common import settle
from ticketlake.operators.skew import top_per_key

MIN_COUNT = 10
#: A candidate goes if a longer one around it has this share of its count, in percent.
INSIDE_PERCENT = 50
TOP = 2000
SCORE_UNIT = 1_000_000

#: Words that may share a hash with a frequent word; bits of the hash at least and at most.
EXCEPTIONS, MIN_BITS, MAX_BITS = 1 << 16, 18, 41
#: Stands for a rare word that shares the hash of a frequent one.
SKIPPED = (1 << 64) - 1
#: Bits of the bitmap that tells frequent words: 16 MB, whatever the number of words.
BITMAP = 1 << 27
#: Distinct phrases that a task holds, words that it holds, and occurrences per range when merging.
FLUSH, WORD_FLUSH, RANGE = 1_500_000, 400_000, 1 << 20
#: Bytes of text that are cut into words at a time.
CHUNK = 2 << 20

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_TOKEN = re.compile(rb"[^ \t.,;:!?\n\x0b\x0c\r]+|[.,;:!?\n\x0b\x0c\r]+")
#: Constants of the rounds of the permutation: any four odd numbers do.
_ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)

FILTER_DDL = (
    "lang string, range long, slots long, quotient_bits int, occupied binary, continued binary, "
    "remainders binary, counters binary, large binary"
)
COUNT_DDL = "lang string, size int, w1 long, w2 long, w3 long, a long"


# Words ----------------------------------------------------------------------------------------


def chunks(data: bytes, limit: int = CHUNK) -> Iterator[tuple[bytes, int]]:
    """Parts of a text of about ``limit`` bytes, each with the number of its first words that only
    repeat the end of the part before, as context."""
    start = skip = 0
    size = limit
    while start + size < len(data):
        end = start + size
        at = max(data.rfind(bytes([c]), start, end) for c in SEPARATORS)
        if at >= 0:
            yield data[start : at + 1], skip
            start, skip, size = at + 1, 0, limit
            continue
        blank = max(data.rfind(b" ", start, end), data.rfind(b"\t", start, end))
        words = data[start:blank].rstrip(b" \t") if blank >= 0 else b""
        parts = words.rsplit(None, 2)
        if len(parts) == 3:
            yield data[start:blank], skip
            before = words[: len(words) - len(parts[2])].rstrip(b" \t")
            start, skip, size = start + len(before) - len(parts[1]), 2, limit
        else:
            size *= 2
    yield data[start:], skip


def word_hash(word: bytes) -> int:
    """63 bits, of which ids take the lowest."""
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little") >> 1


def _texts(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[str, bytes, int]]:
    """``(language, text, words to skip)`` of batches of ``lang, text``, about ``limit`` bytes at a
    time: short texts of a language are put together, long ones cut."""
    held: dict[str, list[bytes]] = defaultdict(list)
    size = 0

    def parts() -> Iterator[tuple[str, bytes, int]]:
        for lang in list(held):
            for part, skip in chunks(b"\n".join(held.pop(lang)).lower(), limit):
                yield lang, part, skip

    for batch in batches:
        langs, texts = batch.column(0), batch.column(1).cast(pa.binary())
        for i in range(batch.num_rows):
            if texts[i].is_valid:
                held[langs[i].as_py()].append(texts[i].as_py())
                size += len(held[langs[i].as_py()][-1])
            if size >= limit:
                yield from parts()
                size = 0
    yield from parts()


def _tokens(part: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Codes of words and separators in their order, and what each code stands for."""
    tokens = np.empty(len(found := _TOKEN.findall(part)), dtype=object)
    tokens[:] = found
    return pd.factorize(tokens)


def _separators(kinds: Sequence[bytes]) -> np.ndarray:
    return np.fromiter((k[0] in SEPARATORS for k in kinds), dtype=bool, count=len(kinds))


def _count_words(limit: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes], int] = defaultdict(int)

        def flushed() -> pa.RecordBatch:
            langs, words = zip(*held, strict=True)
            columns = [
                pa.array(langs), pa.array(words, pa.binary()),
                pa.array(map(word_hash, words), pa.int64()), pa.array(held.values(), pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "word", "hash", "f"])

        for lang, part, skip in _texts(batches, limit):
            codes, kinds = _tokens(part)
            counts = np.bincount(codes[skip:], minlength=len(kinds))
            for word, n, apart in zip(kinds, counts.tolist(), _separators(kinds).tolist(), strict=True):
                if n and not apart:
                    held[lang, word] += n
            if len(held) >= WORD_FLUSH:
                yield flushed()
                held.clear()
        if held:
            yield flushed()

    return count


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.col("text").alias("text"))


def word_table(docs: DataFrame, limit: int = CHUNK) -> DataFrame:
    """``(lang, word, hash, f)`` of all words."""
    counted = _read(docs).mapInArrow(_count_words(limit), "lang string, word binary, hash long, f long")
    return settle(
        counted.groupBy("lang", F.col("word").cast("string").alias("word"))
        .agg(F.first("hash").alias("hash"), F.sum("f").alias("f"))
    )


@dataclass(frozen=True)
class Ids:
    """How words become ids: the low ``bits`` of their hash, but for the words in ``own``."""

    bits: int
    own: dict[bytes, int]

    @property
    def width(self) -> int:
        """Bits of an id."""
        return max(2, ((1 << self.bits) + len(self.own) - 1).bit_length())


def word_ids(words: DataFrame, min_count: int, exceptions: int = EXCEPTIONS, min_bits: int = MIN_BITS) -> Ids:
    """Ids that tell every frequent word from all others."""
    pairs = words.agg(F.count("*") * F.count_if(F.col("f") >= min_count).cast("double")).head()[0]
    bits = min(MAX_BITS, max(min_bits, math.ceil(math.log2(max(1.0, pairs / exceptions)))))
    numbered = words.withColumn("id", F.col("hash").bitwiseAND((1 << bits) - 1))
    shared = (
        numbered.groupBy("id")
        .agg(F.min("word").alias("a"), F.max("word").alias("b"), F.max("f").alias("f"))
        .filter((F.col("a") != F.col("b")) & (F.col("f") >= min_count))
    )
    found = (
        numbered.join(shared.select("id"), "id", "left_semi").groupBy("word").agg(F.max("f").alias("f")).collect()
    )
    frequent = sorted(r["word"] for r in found if r["f"] >= min_count)
    rare = {r["word"].encode(): SKIPPED for r in found if r["f"] < min_count}
    return Ids(bits, rare | {word.encode(): (1 << bits) + i for i, word in enumerate(frequent)})


def numbered_words(words: DataFrame, ids: Ids, min_count: int) -> DataFrame:
    """``(lang, word, id, f)`` of the frequent words."""
    own = [(word.decode(), i) for word, i in ids.own.items() if i != SKIPPED]
    listed = words.sparkSession.createDataFrame(own, "word string, own long")
    frequent = words.filter(F.col("f") >= min_count).join(F.broadcast(listed), "word", "left")
    by_hash = F.col("hash").bitwiseAND((1 << ids.bits) - 1)
    return settle(frequent.select("lang", "word", F.coalesce("own", by_hash).alias("id"), "f"))


def _bitmap(ids: DataFrame, bits: int = BITMAP) -> np.ndarray:
    """A bitmap of ``bits`` places, a power of two from 32768 on, with the places of all ids set.

    A place is the low bits of an id. What reaches the driver is the bitmap, in 4 KB parts.
    """
    slot = F.col("id").bitwiseAND(bits - 1)
    parts = (
        ids.groupBy(F.shiftright(slot, 15).alias("part"))
        .agg(F.bitmap_construct_agg(slot.bitwiseAND(32767)).alias("set"))
        .collect()
    )
    out = np.zeros(bits // 8, dtype=np.uint8)
    for part, own in parts:
        out[part * 4096 : (part + 1) * 4096] = np.frombuffer(own, dtype=np.uint8)
    return out


# Keys -----------------------------------------------------------------------------------------

_U = np.uint64


def half_bits(width: int) -> int:
    """Bits of each half of a key: two for the size, three ids, one more if that is odd."""
    return (3 * width + 3) // 2


def _mask(bits: int) -> np.uint64:
    return _U((1 << bits) - 1)


def packed(size: int, words: Sequence[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the keys: the size and the ids one after the other."""
    one, two, three = (*words, np.zeros_like(words[0]))[:3]
    in_low = half_bits(width) - width
    in_high = width - in_low
    high = (_U(size) << _U(width + in_high)) | (one << _U(in_high)) | (two >> _U(in_low))
    return high, ((two & _mask(in_low)) << _U(width)) | three


def unpacked(high: np.ndarray, low: np.ndarray, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sizes and ids."""
    in_low = half_bits(width) - width
    in_high = width - in_low
    two = ((high & _mask(in_high)) << _U(in_low)) | (low >> _U(width))
    return high >> _U(width + in_high), [(high >> _U(in_high)) & _mask(width), two, low & _mask(width)]


def _mixed(x: np.ndarray, constant: int) -> np.ndarray:
    x = (x + _U(constant)) * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(29)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def permuted(high: np.ndarray, low: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """A one-to-one mapping of keys: each round changes one half by the other."""
    for constant in _ROUNDS:
        high, low = low, high ^ (_mixed(low, constant) & _mask(half))
    return high, low


def restored(high: np.ndarray, low: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of :func:`permuted`."""
    for constant in reversed(_ROUNDS):
        high, low = low ^ (_mixed(high, constant) & _mask(half)), high
    return high, low


Counts = tuple[np.ndarray, np.ndarray, np.ndarray]


def summed(high: np.ndarray, low: np.ndarray, n: np.ndarray) -> Counts:
    """Distinct keys in their order with their summed counts. Sorted parts are merged as such."""
    if not len(high):
        return high, low, n
    order = np.argsort(high, kind="stable")
    high, low, n = high[order], low[order], n[order]
    starts = np.concatenate([[True], high[1:] != high[:-1]])
    if (mixed := ~starts[1:] & (low[1:] != low[:-1])).any():
        # Few keys share a half only; those are put in order among themselves.
        runs = np.cumsum(starts)
        places = np.flatnonzero(np.isin(runs, np.unique(runs[1:][mixed])))
        order = places[np.lexsort((low[places], high[places]))]
        low[places], n[places] = low[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]))
    return high[starts], low[starts], np.add.reduceat(n, starts)


# Filters --------------------------------------------------------------------------------------


def _bytes_of(values: np.ndarray, bits: int) -> np.ndarray:
    """The low ``bits`` of each value, in as many bytes as they need."""
    held = (values & _mask(bits)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return held[:, : (bits + 7) // 8]


def _values_of(held: np.ndarray) -> np.ndarray:
    full = np.zeros((len(held), 8), dtype=np.uint8)
    full[:, : held.shape[1]] = held
    return full.view("<u8").ravel().astype(np.uint64)


def filled(high: np.ndarray, low: np.ndarray, n: np.ndarray, half: int, range_bits: int) -> dict:
    """A counting quotient filter of sorted distinct keys that agree in their first ``range_bits``.

    As many quotients as keys are laid out. ``occupied`` has a bit per quotient that has keys,
    ``continued`` one per slot that has the quotient of the slot before; a slot holds the bits of
    the key after its quotient and a counter of one byte, 255 for those listed in ``large``.
    """
    bits = min(half, range_bits + max(0, len(high).bit_length() - 1))
    local = ((high >> _U(half - bits)) & _mask(bits - range_bits)).astype(np.int64)
    occupied = np.zeros(1 << (bits - range_bits), dtype=bool)
    occupied[local] = True
    continued = np.concatenate([[False], local[1:] == local[:-1]])
    places = np.flatnonzero(n >= 255)
    return {
        "slots": len(high),
        "quotient_bits": bits,
        "occupied": np.packbits(occupied).tobytes(),
        "continued": np.packbits(continued).tobytes(),
        "remainders": np.hstack([_bytes_of(high, half - bits), _bytes_of(low, half)]).tobytes(),
        "counters": np.minimum(n, 255).astype(np.uint8).tobytes(),
        "large": np.stack([places, n[places]]).astype(np.int64).tobytes(),
    }


def entries(row: dict, half: int, range_bits: int) -> Counts:
    """Keys and counts of a filter, in their order."""
    slots, bits = row["slots"], row["quotient_bits"]
    occupied = np.unpackbits(np.frombuffer(row["occupied"], np.uint8))[: 1 << (bits - range_bits)]
    continued = np.unpackbits(np.frombuffer(row["continued"], np.uint8))[:slots]
    # The j-th run of slots belongs to the j-th occupied quotient.
    local = np.flatnonzero(occupied)[np.cumsum(continued == 0) - 1].astype(np.uint64)
    quotients = _U(row["range"] << (bits - range_bits)) | local
    held = np.frombuffer(row["remainders"], np.uint8).reshape(slots, -1)
    upper = (half - bits + 7) // 8
    high = _values_of(held[:, :upper])
    if bits:
        high |= quotients << _U(half - bits)
    n = np.frombuffer(row["counters"], np.uint8).astype(np.int64)
    places, large = np.frombuffer(row["large"], np.int64).reshape(2, -1)
    n[places] = large
    return high, _values_of(held[:, upper:]), n


FILTER = pa.schema(
    [
        ("lang", pa.string()), ("range", pa.int64()), ("slots", pa.int64()), ("quotient_bits", pa.int32()),
        *[(c, pa.binary()) for c in ("occupied", "continued", "remainders", "counters", "large")],
    ]
)
#: Filters that a task hands over at a time.
FILTERS = 32


def _filters(lang: str, counts: Counts, half: int, range_bits: int) -> Iterator[pa.RecordBatch]:
    """The filters of sorted counts, one per range of the quotient."""
    high, low, n = counts
    ranges = high >> _U(half - range_bits)
    starts = [0, *(np.flatnonzero(ranges[1:] != ranges[:-1]) + 1).tolist()] if len(high) else []
    ends = [*starts[1:], len(high)]
    rows = []
    for start, end in zip(starts, ends, strict=False):
        own = filled(high[start:end], low[start:end], n[start:end], half, range_bits)
        rows.append({"lang": lang, "range": int(ranges[start]), **own})
        if len(rows) == FILTERS or end == len(high):
            yield pa.RecordBatch.from_pylist(rows, schema=FILTER)
            rows = []


def phrase_filters(
    docs: DataFrame, frequent: np.ndarray, ids: Ids, range_bits: int, limit: int = CHUNK, flush: int = FLUSH
) -> DataFrame:
    """Counting quotient filters of the phrases of two and three frequent words, by language and
    range of the quotient."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, ids))
    width, half = ids.width, half_bits(ids.width)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, ids = shared.value
        places, mask = len(bitmap) * 8 - 1, (1 << ids.bits) - 1
        known_ids: dict[bytes, int] = {}
        held: dict[str, list[Counts]] = defaultdict(list)
        total = 0

        def id_of(word: bytes) -> int:
            found = known_ids.get(word)
            if found is None:
                found = known_ids[word] = ids.own[word] if word in ids.own else word_hash(word) & mask
            return found

        def merged(parts: list[Counts]) -> Counts:
            return summed(*(np.concatenate(c) for c in zip(*parts, strict=True)))

        for lang, part, skip in _texts(batches, limit):
            codes, kinds = _tokens(part)
            if len(codes) < 2:
                continue
            if len(known_ids) > WORD_FLUSH:
                known_ids.clear()
            of_kind = np.fromiter(map(id_of, kinds), dtype=np.uint64, count=len(kinds))
            place = (of_kind & _U(places)).astype(np.int64)
            known = ((bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1) == 1
            use = (known & (of_kind != _U(SKIPPED)) & ~_separators(kinds))[codes]
            words = of_kind[codes]
            two = use[:-1] & use[1:]
            three = two[:-1] & two[1:]
            # A phrase belongs to the part that its last word is new in.
            two[: max(0, skip - 1)] = False
            three[: max(0, skip - 2)] = False
            pairs = packed(2, [words[:-1][two], words[1:][two]], width)
            triples = packed(3, [words[:-2][three], words[1:-1][three], words[2:][three]], width)
            high, low = permuted(*(np.concatenate(c) for c in zip(pairs, triples, strict=True)), half)
            if len(high):
                held[lang].append(summed(high, low, np.ones(len(high), dtype=np.int64)))
                total += len(held[lang][-1][0])
            if total >= flush:
                for name in list(held):
                    held[name] = [merged(held[name])]
                total = sum(len(p[0][0]) for p in held.values())
                if total >= flush // 2:
                    for name in list(held):
                        yield from _filters(name, held.pop(name)[0], half, range_bits)
                    total = 0
        for name in list(held):
            yield from _filters(name, merged(held.pop(name)), half, range_bits)

    return _read(docs).mapInArrow(count, FILTER_DDL)


def frequent_phrases(filters: DataFrame, width: int, range_bits: int, min_count: int = MIN_COUNT) -> DataFrame:
    """``(lang, size, w1, w2, w3, a)``: filters merged by ranges, and the frequent phrases in them."""
    half = half_bits(width)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        parts = [entries(row, half, range_bits) for row in table.to_pylist()]
        high, low, n = summed(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        kept = n >= min_count
        sizes, words = unpacked(*restored(high[kept], low[kept], half), width)
        columns = [sizes.astype(np.int32), *(w.astype(np.int64) for w in words), n[kept]]
        lang = pa.array([key[0].as_py()] * int(kept.sum()), pa.string())
        return pa.Table.from_arrays([lang, *map(pa.array, columns)], names=["lang", "size", "w1", "w2", "w3", "a"])

    return filters.groupBy("lang", "range").applyInArrow(merge, COUNT_DDL)


# Scores ---------------------------------------------------------------------------------------


def _score(a: str, left: str, right: str) -> Column:
    """Exact for counts below 10**16; beyond, the product stops the job."""
    a, left, right = (F.col(c).cast("decimal(38,0)") for c in (a, left, right))
    return F.call_function("div", F.lit(SCORE_UNIT).cast("decimal(38,0)") * a * a, left * right)


def candidates(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """``(lang, phrase, a, l, r, score)`` of all frequent phrases that stand for themselves.

    ``words`` has ``lang, word, id, f`` of the frequent words; a phrase's parts are frequent too,
    so everything needed is in the two tables. What is joined is one row per different phrase; a
    word that many phrases hold is a large key of an inner join, which adaptive execution splits.
    """
    named = ["lang", "size", "w1", "w2", "w3"]
    key = F.struct("lang", F.col("id").alias("id"))
    parts = phrases.select(
        *named, "a", F.posexplode(F.slice(F.array("w1", "w2", "w3"), 1, F.col("size"))).alias("at", "id")
    ).withColumn("key", key)
    spelled = (
        parts.join(words.select(key.alias("key"), "word", "f"), "key")
        .groupBy(*named)
        .agg(
            F.first("a").alias("a"),
            F.array_sort(F.collect_list(F.struct("at", "word", "f"))).alias("parts"),  # three at most
        )
        .select(
            *named, "a", F.array_join("parts.word", " ").alias("phrase"),
            F.col("parts")[0]["f"].alias("first"), F.element_at("parts", -1)["f"].alias("last"),
        )
    )
    spelled = settle(spelled)
    # The two pairs inside a triple: (cut after the other word, first word, second word).
    inner = F.inline(
        F.array(
            F.struct(F.lit(1).alias("cut"), F.col("w2").alias("x"), F.col("w3").alias("y")),
            F.struct(F.lit(2).alias("cut"), F.col("w1").alias("x"), F.col("w2").alias("y")),
        )
    )
    triples = spelled.filter("size = 3")
    pairs = spelled.filter("size = 2")
    inside = triples.select(*named, "a", inner).withColumn("key", F.struct("lang", "x", "y"))
    pair_key = F.struct("lang", F.col("w1").alias("x"), F.col("w2").alias("y"))
    of_pairs = (
        inside.join(pairs.select(pair_key.alias("key"), F.col("a").alias("f")), "key")
        .groupBy(*named)
        .agg(*[F.max(F.when(F.col("cut") == k, F.col("f"))).alias(f"pair{k}") for k in (1, 2)])
    )
    around = inside.groupBy("key").agg(F.max("a").alias("longer"))

    def cut(k: int, left: str, right: str) -> Column:
        score = _score("a", left, right).alias("score")
        return F.struct(score, F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))

    output = ["lang", "phrase", "a", "best.l", "best.r", "best.score"]
    two = (
        pairs.withColumn("key", pair_key)
        .join(around, "key", "left")
        .filter(F.coalesce(100 * F.col("longer") < INSIDE_PERCENT * F.col("a"), F.lit(True)))
        .withColumn("best", cut(1, "first", "last"))
    )
    three = triples.join(of_pairs, named).withColumn(
        "best", F.least(cut(1, "first", "pair1"), cut(2, "pair2", "last"))
    )
    return two.select(*output).unionByName(three.select(*output))


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, limit: int = CHUNK, flush: int = FLUSH,
    occurrences: int = RANGE, min_bits: int = MIN_BITS,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the first ``top`` phrases of each language."""
    words = word_table(docs, limit)
    ids = word_ids(words, min_count, min_bits=min_bits)
    frequent = numbered_words(words, ids, min_count)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    all_words = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    range_bits = min(half_bits(ids.width), (2 * all_words // occurrences).bit_length())
    bitmap = _bitmap(frequent, min(BITMAP, max(32768, 1 << ids.width)))
    filters = phrase_filters(docs, bitmap, ids, range_bits, limit, flush)
    phrases = settle(frequent_phrases(filters, ids.width, range_bits, min_count))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = top_per_key(candidates(frequent, phrases), "lang", order, top)
    return (
        first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
        .join(totals, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
