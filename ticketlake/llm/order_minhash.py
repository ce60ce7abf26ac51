"""Document fingerprints by Order MinHash, in SQL functions only.

A text's k-mers are its runs of ``K`` words. Equal k-mers are numbered by their occurrence, so the
text becomes a set of (k-mer, number) pairs. A hash deals the pairs to ``SLOTS`` slots; each slot
selects the two pairs with the smallest hashes and keeps them in their order in the text. The hash
of that ordered tuple is the slot's value. Two texts agree on a slot only if the same pairs were
selected and stand in the same order, so the share of equal slots falls with the edit distance,
reordering included, and not with the set of words alone.

One hash pass with slots replaces as many passes as there are slots: each slot is the minimum over
its own random part of the pairs. Occurrence numbers come from one sort: positions ride in the low
bits of the hashes, equal k-mers stand together in text order, and the run lengths count them.

Defined results: null and empty texts, and texts without words, have the empty fingerprint, which
is like itself (1.0) and unlike any other (0.0); fewer words than a k-mer make one k-mer; a null
doc_id has no next document, its last half is dropped and its likeness to the next is 0.0; a doc_id
that repeats stands once in the order of documents, with its least text, and each of its rows is
fingerprinted; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ticketlake.llm.common import settle, whole_text

K = 3
#: A power of two; a slot's number is the top bits of its pairs' hashes.
SLOT_BITS = 6
SLOTS = 1 << SLOT_BITS
#: A hash and a position share a long: 34 bits of hash, and 30 of position, which hold the words of
#: the longest string there can be.
PLACE = 30
PLACES = (1 << PLACE) - 1
#: A slot's value is its number and 26 bits of its tuple's hash, in one int.
_VALUE_BITS = 32 - SLOT_BITS

_BLANK = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"


def _left(value: Column, bits: Column | int) -> Column:
    return F.call_function("shiftleft", value, bits if isinstance(bits, Column) else F.lit(bits))


def _right(value: Column, bits: Column | int) -> Column:
    return F.call_function("shiftrightunsigned", value, bits if isinstance(bits, Column) else F.lit(bits))


def words_of(text: Column) -> Column:
    """Words between ASCII white space."""
    trimmed = F.btrim(text, F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _BLANK))


def with_signatures(df: DataFrame, signatures: dict[str, Column], k: int = K) -> DataFrame:
    """Adds an array of slot values for each text, named by the keys.

    Every intermediate array is a column of its own, so that none is computed twice.
    """
    keep = list(df.columns)
    names = list(signatures)
    lit = F.lit

    def step(frame: DataFrame, make) -> DataFrame:
        return frame.withColumns({f"_{n}_{part}": c for n in names for part, c in make(f"_{n}_").items()})

    out = step(df, lambda p: {"w": words_of(signatures[p[1:-1]])})
    out = step(
        out,
        lambda p: {
            "m": F.when(F.size(p + "w") == 0, 0).otherwise(F.greatest(F.size(p + "w") - (k - 1), lit(1))),
        },
    )
    # k-mer hashes with their positions in the low bits, sorted: equal k-mers in text order.
    out = step(
        out,
        lambda p: {
            "a": F.sort_array(
                F.transform(
                    _places(p + "m"),
                    lambda i: _left(
                        F.xxhash64(*[F.coalesce(F.get(p + "w", i + j), lit("")) for j in range(k)]), PLACE
                    ) + i,
                )
            )
        },
    )

    def new_run(p: str):
        def differs(i):
            return (i == 0) | (_right(F.get(p + "a", i), PLACE) != _right(F.get(p + "a", i - 1), PLACE))

        return differs

    out = step(out, lambda p: {"s": F.filter(_places(p + "m"), new_run(p))})
    # Occurrence numbers: 0, 1, .. along each run of equal hashes.
    out = step(
        out,
        lambda p: {
            "o": F.flatten(
                F.transform(
                    p + "s",
                    lambda s, j: F.sequence(lit(0), F.coalesce(F.get(p + "s", j + 1), F.col(p + "m")) - s - 1),
                )
            )
        },
    )
    out = step(
        out,
        lambda p: {
            "v": F.sort_array(
                F.zip_with(
                    p + "a", p + "o",
                    lambda x, o: F.coalesce(
                        _left(F.xxhash64(_right(x, PLACE), o), PLACE) + x.bitwiseAND(lit(PLACES)),
                        lit(0).cast("long"),
                    ),
                )
            )
        },
    )

    def slot(x):
        return F.shiftrightunsigned(x, 64 - SLOT_BITS)

    # The two smallest of each slot.
    out = step(
        out,
        lambda p: {
            "t": F.filter(
                p + "v", lambda x, i: F.coalesce(slot(F.get(p + "v", i - 2)) != slot(x), lit(True))
            )
        },
    )

    def values(p: str) -> Column:
        t = p + "t"

        def value(x, i):
            y = F.get(t, i + 1)
            pair = F.coalesce(slot(y) == slot(x), lit(False))
            straight = x.bitwiseAND(lit(PLACES)) <= y.bitwiseAND(lit(PLACES))
            h, g = _right(x, PLACE), _right(y, PLACE)
            tuple_hash = F.when(~pair, F.xxhash64(h)).when(straight, F.xxhash64(h, g)).otherwise(F.xxhash64(g, h))
            low = tuple_hash.bitwiseAND(lit((1 << _VALUE_BITS) - 1))
            first = F.coalesce(slot(F.get(t, i - 1)) != slot(x), lit(True))
            return F.when(first, (F.shiftleft(slot(x), _VALUE_BITS) + low).cast("long") - (1 << 31))

        filled = F.filter(F.transform(t, value), lambda x: x.isNotNull())
        return F.sort_array(F.transform(filled, lambda x: F.coalesce(x, lit(0)).cast("int")))

    out = step(out, lambda p: {"values": values(p)})
    return out.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"_{n}_values").alias(n) for n in names])


def _places(count: str) -> Column:
    """0 .. count - 1; none for a count of 0."""
    return F.when(F.col(count) == 0, F.array().cast("array<int>")).otherwise(
        F.sequence(F.lit(0), F.col(count) - 1)
    )


def fingerprint(signature: Column) -> Column:
    """The slot values as text: eight hexadecimal digits each."""
    shown = F.transform(signature, lambda v: F.lpad(F.lower(F.hex(v.cast("long") + F.lit(1 << 31))), 8, "0"))
    return F.array_join(shown, "")


def likeness(a: Column, b: Column) -> Column:
    """Equal slots among the slots that either signature fills."""
    def slots(s: Column) -> Column:
        return F.transform(s, lambda v: F.shiftright(v, _VALUE_BITS))

    either = F.size(F.array_union(slots(a), slots(b)))
    share = F.size(F.array_intersect(a, b)) / either
    return F.coalesce(F.when(either == 0, 1.0).otherwise(share), F.lit(0.0))


def neighbours(docs: DataFrame) -> DataFrame:
    """``(doc_id, next_id, prev_id, prev_half)`` in a ring over the distinct ids.

    Only ids and lengths move. Each range partition finds its own neighbours; the ends of the
    partitions, one row each, find theirs among themselves.
    """
    ids = (
        docs.filter("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.floor(F.max(F.length("text")) / 2).alias("half"))
        .repartitionByRange("doc_id")
        .select("doc_id", "half", F.spark_partition_id().alias("part"))
    )
    ids = settle(ids)
    along, ring = Window.orderBy("part"), Window.partitionBy(F.lit(0))
    ends = (
        ids.groupBy("part")
        .agg(
            F.min("doc_id").alias("low"),
            F.max("doc_id").alias("high"),
            F.max_by("half", "doc_id").alias("high_half"),
        )
        .select(
            "part",
            F.coalesce(F.lead("low").over(along), F.min("low").over(ring)).alias("next_low"),
            F.coalesce(F.lag("high").over(along), F.max("high").over(ring)).alias("prev_high"),
            F.coalesce(F.lag("high_half").over(along), F.max_by("high_half", "high").over(ring)).alias("prev_half"),
        )
    )
    inside = Window.partitionBy("part").orderBy("doc_id")
    # One row for each partition of the range shuffle: bounded by the session's partitions.
    return (
        ids.withColumns(
            {
                "_next": F.lead("doc_id").over(inside),
                "_prev": F.lag("doc_id").over(inside),
                "_half": F.lag("half").over(inside),
            }
        )
        .join(F.broadcast(ends), "part")
        .select(
            "doc_id",
            F.coalesce("_next", "next_low").alias("next_id"),
            F.coalesce("_prev", "prev_high").alias("prev_id"),
            F.coalesce("_half", "prev_half").alias("prev_half"),
        )
    )


def fingerprint_documents(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses.

    The edited text's last half is replaced by the beginning of the next document. Texts are
    shuffled by id once; the next document sends its signature and the part that is needed.
    """
    if dict(docs.dtypes)["doc_id"] != "bigint":
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    texts = docs.select("doc_id", whole_text().alias("text"))
    # Both joins by id read the same rows in the same way, so their shuffle of the texts is one.
    named = texts.filter("doc_id is not null")
    ring = neighbours(named)
    nexts = named.join(ring.select("doc_id", "prev_id", "prev_half"), "doc_id").select(
        "doc_id", "prev_id", F.expr("left(text, cast(prev_half as int))").alias("beginning"), "text"
    )
    least = nexts.groupBy("doc_id").agg(F.min(F.struct("text", "prev_id", "beginning")).alias("least")).select(
        F.col("least.prev_id").alias("doc_id"), F.col("least.beginning").alias("beginning"), F.col("least.text").alias("text")
    )
    sent = with_signatures(least, {"next_signature": F.col("text")}, k).drop("text")
    apart = texts.filter("doc_id is null").select(
        "*", F.lit("").alias("beginning"), F.lit(None).cast("array<int>").alias("next_signature")
    )
    both = named.join(sent, "doc_id").unionByName(apart).select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        "text",
        F.expr(
            "concat(left(text, length(text) - length(text) div 2),"
            " left(beginning, cast(length(text) div 2 as int)))"
        ).alias("edited"),
        "next_signature",
    )
    signed = with_signatures(both, {"signature": F.col("text"), "edited_signature": F.col("edited")}, k)
    return signed.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("signature")).alias("fingerprint"),
        fingerprint(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )
