"""Best-fit packing of tokenised documents into sequences, after dominance reduction.

Documents are tokenised once, ended by an id of 0, and cut only where they are longer than a
sequence. From then on a piece is its length: the instance is the number of pieces of each length,
at most ``capacity`` numbers however many documents there are, and these alone come to the driver.

The reduction (Martello and Toth) takes the largest length left and looks for a set that dominates
every other set with it: alone, if nothing else fits; with the largest length that fits, if that
fills the sequence, if no second piece would fit beside any other, or if no pair that fits weighs
more and no triple fits. Such sets are fixed for good, as often as their pieces last. The rest goes
best-fit, by falling length. Sequences of equal content are handled as one group, so the plan stays
a few thousand rows; each piece then finds its place from its rank among the pieces of its length.

Defined results: a null or empty text is the end id alone; repeated rows are packed each for itself;
ids may be null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, functions as F

from ticketlake.llm.common import running_position, settle, spread, whole_text

CAPACITY = 2048
END_ID = 0
#: The tokenizer, and the same vocabulary as ranks for the faster encoder.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

_SPECIAL = "<|endoftext|>"
_BLANK_RUN = re.compile(r"\s{2000}")


class Encoder:
    """Ids as the ``tokenizers`` file gives them without added special tokens.

    The rank file holds the same vocabulary and gives the same ids several times faster. Texts that
    spell the special token, or hold white space by the thousands, go through ``tokenizers``.
    """

    def __init__(self, vocabulary: str, ranks: str):
        self.vocabulary, self.slow = vocabulary, None
        name = f"ranks:{ranks}"
        known = tiktoken.registry.ENCODINGS
        if name not in known:
            with open(ranks, "rb") as lines:
                pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            known[name] = tiktoken.Encoding(
                name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={}
            )
        self.fast = known[name]

    def ids(self, text: str) -> list[int]:
        if _SPECIAL not in text and not _BLANK_RUN.search(text):
            return self.fast.encode_ordinary(text)
        if self.slow is None:
            self.slow = tokenizers.Tokenizer.from_file(self.vocabulary)
        return self.slow.encode(text, add_special_tokens=False).ids


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be shorter than a sequence."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *((at, capacity) for at in range(first, n, capacity))]


def pieces(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, ranks: str = RANKS, keep_ids: bool = False
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every row's text, on request with ``ids``."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(vocabulary, ranks)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.array([*encoder.ids(text), END_ID], "<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    rows.append((doc_id, piece, start, length, zlib.crc32(part.tobytes()), part if keep_ids else None))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out if keep_ids else out.drop(columns="ids")

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInPandas(
        work, schema + (", ids array<long>" if keep_ids else "")
    )


class Plan:
    """Groups of equal sequences, and where each piece of a length goes by its rank."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.left = {length: n for length, n in counts.items() if n > 0}
        self.rank = dict.fromkeys(self.left, 0)
        #: (length, first rank, pieces, first sequence, pieces per sequence, offset)
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.fixed = self._reduce()
        self._best_fit()

    def _emit(self, copies: int, content: list[tuple[int, int]]) -> None:
        """``copies`` sequences that hold ``per`` pieces of each length in ``content``."""
        offset = 0
        for length, per in content:
            self.runs.append((length, self.rank[length], copies * per, self.sequences, per, offset))
            self.rank[length] += copies * per
            offset += length * per
        self.sequences += copies

    def _take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]

    def _reduce(self) -> int:
        """Fixes dominating sets from the largest length down; returns the sequences it closed."""
        todo = sorted(self.left)
        while todo:
            large = todo.pop()
            while self.left.get(large):
                done = self._dominating(large)
                if not done:
                    break
        return self.sequences

    def _dominating(self, large: int) -> bool:
        room = self.capacity - large
        self.left[large] -= 1  # the others beside one piece of this length
        sizes = sorted(s for s, n in self.left.items() if n > 0 and s <= room)
        smallest = [s for size in sizes[:3] for s in [size] * min(self.left[size], 3)][:3]
        fits = sum(1 for k in range(len(smallest)) if sum(smallest[: k + 1]) <= room)
        best = sizes[-1] if sizes else 0
        dominates = best == room or fits <= 1 or (fits == 2 and best >= self._best_pair(sizes, room))
        self.left[large] += 1
        if fits == 0:
            copies = self.left[large]
            self._take(large, copies)
            self._emit(copies, [(large, 1)])
            return True
        if not dominates:
            return False
        # What dominates now dominates while pieces only go, until one of the two runs out.
        if best == large:
            copies = self.left[large] // 2
            self._take(large, 2 * copies)
            self._emit(copies, [(large, 2)])
        else:
            copies = min(self.left[large], self.left[best])
            self._take(large, copies)
            self._take(best, copies)
            self._emit(copies, [(large, 1), (best, 1)])
        return True

    def _best_pair(self, sizes: list[int], room: int) -> int:
        """The largest sum of two pieces that fits."""
        best, low, high = 0, 0, len(sizes) - 1
        while low <= high:
            both = sizes[low] + sizes[high]
            if both > room or (low == high and self.left[sizes[low]] < 2):
                high -= 1
            else:
                best = max(best, both)
                low += 1
        return best

    def _best_fit(self) -> None:
        """Each length in turn, from the largest: into the fullest sequences that have room."""
        rooms: list[int] = []  # sorted; groups of open sequences by what is free in each
        groups: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}

        def put(room: int, copies: int, content: list[tuple[int, int]]) -> None:
            if room not in groups:
                groups[room] = []
                bisect.insort(rooms, room)
            groups[room].append((copies, content))

        for length in sorted(self.left, reverse=True):
            n = self.left[length]
            while n:
                at = bisect.bisect_left(rooms, length)
                if at < len(rooms):
                    room = rooms[at]
                    copies, content = groups[room].pop()
                    if not groups[room]:
                        del groups[room], rooms[at]
                else:
                    room, content = self.capacity, []
                    copies = -(-n // (self.capacity // length))
                per = min(room // length, n)
                full = min(copies, n // per)
                put(room - per * length, full, [*content, (length, per)])
                n -= full * per
                if n and full < copies:
                    put(room - n * length, 1, [*content, (length, n)])
                    full, n = full + 1, 0
                if full < copies:
                    put(room, copies - full, content)
        for room in rooms:
            for copies, content in groups[room]:
                self._emit(copies, content)


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a checkpointed table of :func:`pieces`."""
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    plan = Plan(counts, capacity)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 6)
    keys = runs[:, 0] * (1 << 50) + runs[:, 1]
    ranked = running_position(
        found.withColumn("_order", spread(F.col("doc_id"), F.col("piece"), F.col("ids_crc32"))),
        ["length"],
        ["_order", "doc_id", "piece", "start", "ids_crc32"],
        F.lit(1),
        "_rank",
    ).drop("_order")
    columns = [c for c in ranked.columns if c != "_rank"]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, rank = (batch[c].to_numpy(np.int64) for c in ("length", "_rank"))
            run = runs[np.searchsorted(keys, length * (1 << 50) + rank, side="right") - 1]
            inside = rank - run[:, 1]
            batch = batch[columns]
            batch["sequence_id"] = run[:, 3] + inside // run[:, 4]
            batch["offset"] = run[:, 5] + inside % run[:, 4] * length
            yield batch

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInPandas(place, f"{fields}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, ranks: str = RANKS, keep_ids: bool = False
) -> DataFrame:
    """Pieces of every row with their sequence and their place in it."""
    return pack(settle(pieces(docs, capacity, vocabulary, ranks, keep_ids)), capacity)
