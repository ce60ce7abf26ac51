"""Substring dedup by content-defined chunks.

A gear hash rolls over the text's bytes; it depends on the last 16 bytes alone. A place is a
candidate if some of the hash's bits are zero, and a cut if no other candidate lies in the 16 bytes
before it, so a cut depends on the bytes around it and on nothing else: an insertion moves the cuts
behind it and changes none. Chunks have equal digests where their bytes are equal; each digest's
first chunk (least doc_id, then place) stays and the others are repeats. Neighbouring repeats are
joined to spans, and spans of ``min_span`` characters or more are reported: every repeat with 1, which
the query takes, or no lone 64-bit collision and no common phrase with ``MIN_SPAN``, the default.

Defined results: null and empty texts have no chunks and no spans; rows with a null doc_id take no
part; rows that repeat a doc_id count as one document with both texts' chunks, equal ones once; runs without a cut
are cut every ``MAX_CHUNK`` bytes; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from ticketlake.llm.common import settle, whole_text

MIN_CHUNK = 16
MAX_CHUNK = 1024
#: One place in 2**CUT_BITS is a candidate.
CUT_BITS = 4
MIN_SPAN = 100
_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of some UTF-8 bytes; never inside a character."""
    rolled = _GEAR[data]
    for step in (1, 2, 4, 8):
        shifted = rolled.copy()
        shifted[step:] += rolled[:-step] << np.uint32(step)
        rolled = shifted
    ends = np.flatnonzero((rolled >> np.uint32(32 - CUT_BITS)) == 0) + 1
    ends = ends[ends < len(data)]
    ends = ends[(data[ends] & 0xC0) != 0x80]
    ends = ends[np.diff(ends, prepend=-MIN_CHUNK) >= MIN_CHUNK]
    ends = np.append(ends, len(data))
    wide = np.flatnonzero(np.diff(ends, prepend=0) > MAX_CHUNK)
    if not len(wide):
        return ends
    starts = np.r_[0, ends[:-1]]
    more = np.concatenate([np.arange(starts[k] + MAX_CHUNK, ends[k], MAX_CHUNK) for k in wide])
    whole = [_character_end(data, int(end)) for end in more]
    return np.unique(np.r_[ends, whole])


def _character_end(data: np.ndarray, end: int) -> int:
    while end < len(data) and data[end] & 0xC0 == 0x80:
        end += 1
    return end


def chunks(docs: DataFrame) -> DataFrame:
    """``(doc_id, ends, digests)``: ends in code points; the first chunk starts at 0."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            places, digests = [], []
            for text in batch["text"]:
                raw = text.encode("utf-8", "surrogatepass")
                data = np.frombuffer(raw, np.uint8)
                ends = cuts(data)
                points = np.cumsum((data & 0xC0) != 0x80)[ends - 1] if len(data) != len(text) else ends
                starts = [0, *ends[:-1].tolist()]
                hashed = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts, ends.tolist())]
                places.append(points.astype(np.int32))
                digests.append(np.array(hashed, np.uint64).view(np.int64))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ends": places, "digests": digests})

    return (
        docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
        .filter("doc_id is not null and text <> ''")
        .mapInPandas(work, "doc_id long, ends array<int>, digests array<long>")
    )


def repeated_spans(docs: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """``(doc_id, start, end, n_chunks, first_doc_id)``: spans that repeat earlier text.

    Offsets are code points, the end is exclusive; ``first_doc_id`` is the least document that
    holds a chunk of the span first. Digests are counted before they meet, and the join that
    brings a digest's first place to its repeats may be split at digests that many documents share.
    """
    cut_up = settle(chunks(docs))
    each = cut_up.select("doc_id", F.posexplode(F.arrays_zip("ends", "digests")).alias("n", "c"), "ends").select(
        "doc_id",
        F.col("c.digests").alias("digest"),
        F.when(F.col("n") == 0, 0).otherwise(F.get("ends", F.col("n") - 1)).alias("start"),
        F.col("c.ends").alias("end"),
    )
    firsts = (
        each.groupBy("digest")
        .agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start")).alias("first"))
        .filter("n > 1")
        .select("digest", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("_first"))
    )
    repeats = each.join(firsts, "digest").filter("doc_id <> first_doc_id or start <> _first")
    along = Window.partitionBy("doc_id").orderBy("start", "end", "first_doc_id")
    again = (F.lag("start").over(along) == F.col("start")) & (F.lag("end").over(along) == F.col("end"))
    repeats = repeats.withColumn("_again", F.coalesce(again, F.lit(False))).filter("not _again")
    begins = F.coalesce(F.lag("end").over(along) != F.col("start"), F.lit(True)).cast("int")
    numbered = repeats.withColumn("_new", begins).withColumn("_span", F.sum("_new").over(along))
    return (
        numbered.groupBy("doc_id", "_span")
        .agg(
            F.min("start").cast("long").alias("start"),
            F.max("end").cast("long").alias("end"),
            F.count("*").alias("n_chunks"),
            F.min("first_doc_id").alias("first_doc_id"),
        )
        .filter(F.col("end") - F.col("start") >= min_span)
        .drop("_span")
    )


def _without(text: Column, spans: Column) -> Column:
    @F.pandas_udf("string")
    def cut_out(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def keep(text: str | None, found) -> str | None:
            if text is None or found is None:
                return text
            kept, done = [], 0
            for span in sorted((s["start"], s["end"]) for s in found):
                kept.append(text[done : span[0]])
                done = max(done, span[1])
            return "".join([*kept, text[done:]])

        return pd.Series([keep(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    return cut_out(text, spans)


def drop_repeats(docs: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """The documents without their repeated spans; other columns stay as they are."""
    spans = (
        repeated_spans(docs, min_span)
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    )
    joined = docs.alias("d").join(spans.alias("s"), F.col("d.doc_id") == F.col("s.doc_id"), "left")
    columns = [
        _without(F.col("d.text"), F.col("s.spans")).alias("text") if c == "text" else F.col(f"d.`{c}`")
        for c in docs.columns
    ]
    return joined.select(*columns)
