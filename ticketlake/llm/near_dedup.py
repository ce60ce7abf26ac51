"""MinHash near-dedup: universal hash minima, banding, verification on full sets, components.

Every text becomes the set of its distinct five-word shingles. Texts of equal words form one node.
A node's signature holds the minima of many universal hashes over its shingles; ``ROWS`` minima
make a band, and nodes that agree on a band meet in a bucket. A pair at the threshold misses every
bucket with probability (1 - 0.85**ROWS)**BANDS, below 3e-7. Buckets join nodes into coarse
clusters, and inside a cluster all nodes are compared on their full sets, in blocks of bounded
size, so neither a bucket nor a cluster is ever held by one task and no pair is emitted but links
that join what is not yet joined in the block. Components follow from those links.

Defined results: null or empty texts, and texts without words, have no shingles and are linked
with nothing; fewer words than a shingle count as one shingle; a null doc_id takes part in nothing
and is its own class (component null, kept); rows that repeat a doc_id are one document that is linked
with whatever one of its texts is linked with; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from ticketlake.llm.common import settle, whole_text
from ticketlake.llm.components import connected_components

WORDS = 5
PERCENT = 85
ROWS = 8
BANDS = 48
#: Nodes and bytes of text that a block of a large cluster holds about; two blocks meet in a task.
BLOCK_NODES = 512
BLOCK_BYTES = 8 << 20

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word sequence's shingles."""
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(size, len(words))
    mixed = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        mixed = mixed * _MIX + hashes[k : len(words) - width + 1 + k]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def split_words(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


class Minima:
    """Minima of ``count`` universal hashes x -> a*x + b (mod 2**32, a odd) over a set."""

    def __init__(self, count: int, seed: int):
        draw = np.random.default_rng(seed)
        self.a = draw.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = draw.integers(0, 1 << 32, count, dtype=np.uint32)
        self.buffer = np.empty((64, count), np.uint32)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for start in range(0, len(x), 64):
            part = x[start : start + 64]
            buffer = self.buffer[: len(part)]
            np.multiply(part[:, None], self.a, out=buffer)
            np.add(buffer, self.b, out=buffer)
            np.minimum(least, buffer.min(axis=0), out=least)
        return least


def signatures(
    docs: DataFrame, words: int = WORDS, rows: int = ROWS, bands: int = BANDS, seed: int = 1
) -> DataFrame:
    """``(doc_id, digest, n_shingles, n_bytes, bands)``: one long per band; digest null without words."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        minima = Minima(rows * bands, seed)
        for batch in batches:
            out, seen = [], {}
            for text in batch["text"]:
                found = split_words(text)
                if not found:
                    out.append((None, 0, 0, None))
                    continue
                digest = xxhash.xxh3_128_digest(b" ".join(found))
                if digest not in seen:
                    hashes = shingles(found, words)
                    least = minima.of(hashes)
                    keys = [
                        xxhash.xxh3_64_intdigest(least[k * rows : (k + 1) * rows].tobytes(), k)
                        for k in range(bands)
                    ]
                    seen[digest] = len(hashes), np.array(keys, np.uint64).view(np.int64)
                count, keys = seen[digest]
                out.append((digest, count, len(text), keys))
            done = pd.DataFrame(out, columns=["digest", "n_shingles", "n_bytes", "bands"])
            done.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield done

    schema = "doc_id long, digest binary, n_shingles long, n_bytes long, bands array<long>"
    return (
        docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
        .filter("doc_id is not null")
        .mapInPandas(work, schema)
    )


def _spanning(sets: list[np.ndarray], first: np.ndarray, same: bool, percent: int) -> list[tuple[int, int]]:
    """Links that join the places of ``sets`` as all links would; ``first`` marks the first block's
    places, and unless ``same`` only pairs across the two blocks count."""
    sizes = np.array([len(s) for s in sets])
    place = np.repeat(np.arange(len(sets)), sizes)
    values, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[codes] > 1
    place, codes = place[shared], codes[shared]
    by_code = np.argsort(codes, kind="stable")
    postings = place[by_code]
    starts = np.searchsorted(codes[by_code], np.arange(len(values) + 1))
    bounds = np.searchsorted(place, np.arange(len(sets) + 1))
    label, links = np.arange(len(sets)), []
    for x in range(len(sets)):
        own = codes[bounds[x] : bounds[x + 1]]
        if not len(own) or not (same or first[x]):
            continue
        lengths = starts[own + 1] - starts[own]
        ends = np.cumsum(lengths)
        gather = np.arange(ends[-1]) + np.repeat(starts[own] - ends + lengths, lengths)
        common = np.bincount(postings[gather], minlength=len(sets))
        linked = 100 * common >= percent * (sizes + sizes[x] - common)
        if same:
            linked[: x + 1] = False
        else:
            linked &= ~first
        partners = np.flatnonzero(linked & (common > 0))
        kinds, at = np.unique(label[partners], return_index=True)
        for kind, k in zip(kinds, at, strict=True):
            if kind != label[x]:
                links.append((x, int(partners[k])))
                label[label == kind] = label[x]
    return links


def near_links(
    docs: DataFrame, nodes: DataFrame, words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """``(a, b)``: links between ``nodes`` (node, digest, n_bytes, bands), confirmed on full sets."""
    keyed = nodes.select("node", F.explode("bands").alias("band"))
    buckets = keyed.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n"))
    coarse = (
        keyed.join(buckets.filter("n > 1"), "band")
        .filter("node <> hub")
        .select("node", "hub")
        .distinct()
    )
    clusters = connected_components(coarse)
    members = settle(
        clusters.join(nodes.select("node", "digest", "n_bytes"), "node").select(
            "node", "digest", "n_bytes", F.col("component").alias("cluster")
        )
    )
    blocks = members.groupBy("cluster").agg(
        F.greatest(
            F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("n_bytes") / BLOCK_BYTES)
        ).alias("blocks")
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), whole_text().alias("text"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")
    met = (
        texts.join(members.select("node", "digest", "cluster"), "node")
        .join(blocks, "cluster")
        .select("*", block)
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        .select(
            "node", "digest", "text", "cluster", "block",
            F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        )
    )

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        places, sets = {}, []
        for node, digest, text, part in zip(
            group["node"], group["digest"], group["text"], group["block"], strict=True
        ):
            found = split_words(text)
            digest = bytes(digest)
            if (node, digest) not in places and xxhash.xxh3_128_digest(b" ".join(found)) == digest:
                places[node, digest] = part
                sets.append(shingles(found, words))
        ids = [node for node, _ in places]
        first = np.array(list(places.values())) == group["low"].iat[0]
        same = group["low"].iat[0] == group["high"].iat[0]
        found = _spanning(sets, first, same, percent) if len(sets) > 1 else []
        return pd.DataFrame([(ids[x], ids[y]) for x, y in found], columns=["a", "b"], dtype="int64")

    return met.groupBy("cluster", "low", "high").applyInPandas(verify, "a long, b long")


def _own_links(signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(a, b)``: links between the texts of documents whose rows have different ones."""
    several = (
        signed.filter("n_shingles > 0")
        .groupBy("doc_id")
        .agg(F.min("digest").alias("a"), F.max("digest").alias("b"))
        .filter("a <> b")
    )
    own = (
        signed.join(several.select("doc_id"), "doc_id", "left_semi")
        .join(nodes.select("digest", "node"), "digest")
        .select("doc_id", "node")
        .distinct()
    )
    hubs = own.groupBy("doc_id").agg(F.min("node").alias("hub")).select("doc_id", "hub")
    return own.join(hubs, "doc_id").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))


def near_duplicates(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row of ``docs``."""
    signed = settle(signatures(docs, words, rows, bands))
    nodes = settle(
        signed.filter("n_shingles > 0")
        .groupBy("digest")
        .agg(
            F.min("doc_id").alias("node"),
            F.first("n_bytes").alias("n_bytes"),
            F.first("bands").alias("bands"),
        )
    )
    links = near_links(docs, nodes, words, percent).unionByName(_own_links(signed, nodes))
    joined = connected_components(links)
    classes = nodes.select("digest", "node").join(joined, "node", "left")
    component = F.coalesce("component", "node", "doc_id")
    found = (
        signed.select("doc_id", "digest", "n_shingles")
        .join(classes, "digest", "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )
    without_id = docs.filter("doc_id is null").select(
        F.col("doc_id").cast("long"),
        F.lit(0).cast("long").alias("n_shingles"),
        F.lit(None).cast("long").alias("component_id"),
        F.lit(True).alias("kept"),
    )
    return found.unionByName(without_id)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay: one of each class, all columns as they are.

    Rows that repeat a doc_id are one document; the one with the smallest text stays.
    """
    kept = near_duplicates(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    stays = docs.alias("d").join(kept.alias("k"), F.col("d.doc_id") == F.col("k.doc_id"), "left_semi")
    one = stays.groupBy("doc_id").agg(F.min_by(every, whole_text()).alias("_row")).select("_row.*")
    return one.unionByName(docs.filter("doc_id is null"))
