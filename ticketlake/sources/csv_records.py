"""Records of CSV files whose values may hold line breaks, read in splits.

Whether a line break ends a record depends on every quote before it in the file. But a line does
only one of four things to the state "inside a quoted value": keep it, swap it, switch it on or
switch it off, and so does a run of lines. So a first scan tells for each split what it does to
either state, how many records start in it, and the text up to its first record in case it starts
inside a value. From these few rows per file follow the state and the row number that each split
starts with, and what the splits after it hold of its last record. A second scan cuts the records.

Python workers read the lines, since the state runs through them in order; nothing is shuffled but
a row per split. Lines end in a line feed, with or without a carriage return; blank ones outside of
values don't count. A quote opens a value only at its start; text between a closing quote and the
next comma stays in the value.
"""

from __future__ import annotations

import csv
import itertools
import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ticketlake.functions.text import BOM
from ticketlake.operators.skew import small_dimension
from ticketlake.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Text up to a split's first record that the first scan brings along; longer ones need a scan more.
HEAD_BYTES = 1 << 20
#: Bytes of records that a worker returns at a time.
BATCH_BYTES = 4 << 20
#: Splits whose states are broadcast, and bytes of rests; beyond either, they are joined by split.
MAX_SPLITS, MAX_TAIL_BYTES = 500_000, 64 << 20

_CLOSED = rb'(?:[^"]++|"")*+"(?!")[^,]*+'
_FIELD = rb'(?:"' + _CLOSED + rb'|[^",][^,]*+)?+'
_FROM_OUTSIDE = re.compile(_FIELD + rb"(?:," + _FIELD + rb")*+")
_FROM_INSIDE = re.compile(_CLOSED + rb"(?:," + _FIELD + rb")*+")

SPLIT_DDL = (
    "_file string, _start long, n_out long, n_in long, end_out boolean, end_in boolean, "
    "head binary, names array<string>"
)
RECORD_DDL = "_file string, _start long, _place long, record binary, open boolean"
Line = tuple[tuple[str, int], bytes]


def inside_after(line: bytes, inside: bool) -> bool:
    """Whether the end of a line is inside a quoted value."""
    if b'"' not in line:
        return inside
    return not (_FROM_INSIDE if inside else _FROM_OUTSIDE).fullmatch(line)


_BLANK = (b"", b"\r")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[bytes], pa.RecordBatch]]:
    """Runs of lines of one split: its file and start, the lines, and these rows."""
    for batch in batches:
        starts = batch.column(1).to_numpy()
        files = batch.column(0).dictionary_encode()
        codes = files.indices.to_numpy()
        changes = np.flatnonzero((starts[1:] != starts[:-1]) | (codes[1:] != codes[:-1])) + 1
        for at, end in itertools.pairwise([0, *changes.tolist(), batch.num_rows]):
            if end > at:
                run = batch.slice(at, end - at)
                yield (files[at].as_py(), int(starts[at])), run.column(2).to_pylist(), run


def header_names(text: bytes) -> list[str]:
    decoded = text.decode("utf-8", "replace").replace(BOM, "")
    return [name.strip() for name in next(csv.reader([decoded], strict=False), [])]


class _Summary:
    """What a split does to either state, line by line."""

    def __init__(self, key: tuple[str, int], head_bytes: int):
        self.key, self.limit = key, head_bytes
        self.outside, self.inside = False, True  # the state now, had the split started with this one
        self.n_out = self.n_in = self.held = 0
        self.head: list[bytes] | None = []
        self.in_head = True
        self.first: list[bytes] = []

    def add(self, lines: list[bytes]) -> None:
        out, inn, n_out, n_in = self.outside, self.inside, self.n_out, self.n_in
        for line in lines:
            if line in _BLANK:
                if n_out == 1 and out:
                    self.first.append(line)
            else:
                if n_out == 0 or n_out == 1 and out:
                    self.first.append(line)
                n_out += not out
                n_in += not inn
            if self.in_head:
                self._keep(line)
            if b'"' in line:
                after = inside_after(line, out)
                inn = after if inn == out else inside_after(line, inn)
                out = after
                self.in_head = self.in_head and inn
        self.outside, self.inside, self.n_out, self.n_in = out, inn, n_out, n_in

    def _keep(self, line: bytes) -> None:
        self.held += len(line) + 1
        if self.held > self.limit:
            self.head = None
        elif self.head is not None:
            self.head.append(line)

    def row(self) -> dict:
        whole = self.n_out > 1 or not self.outside
        return {
            "_file": self.key[0], "_start": self.key[1], "n_out": self.n_out, "n_in": self.n_in,
            "end_out": self.outside, "end_in": self.inside,
            "head": None if self.head is None else b"\n".join(self.head),
            "names": header_names(b"\n".join(self.first)) if self.first and whole else None,
        }


_SPLIT = pa.schema(
    [
        ("_file", pa.string()), ("_start", pa.int64()), ("n_out", pa.int64()), ("n_in", pa.int64()),
        ("end_out", pa.bool_()), ("end_in", pa.bool_()), ("head", pa.binary()), ("names", pa.list_(pa.string())),
    ]
)
_RECORD = pa.schema(
    [
        ("_file", pa.string()), ("_start", pa.int64()), ("_place", pa.int64()), ("record", pa.binary()),
        ("open", pa.bool_()),
    ]
)


def _summaries(head_bytes: int) -> Callable:
    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for key, lines, _ in _runs(batches):
            if own is None or own.key != key:
                if own is not None:
                    yield pa.RecordBatch.from_pylist([own.row()], schema=_SPLIT)
                own = _Summary(key, head_bytes)
            own.add(lines)
        if own is not None:
            yield pa.RecordBatch.from_pylist([own.row()], schema=_SPLIT)

    return summarize


def _batch(key: tuple[str, int], places: list[int], records: list[bytes], is_open: bool) -> pa.RecordBatch:
    n = len(records)
    columns = [pa.repeat(v, n) for v in key] + [pa.array(places, pa.int64()), pa.array(records, pa.binary())]
    return pa.RecordBatch.from_arrays([*columns, pa.repeat(is_open, n)], schema=_RECORD)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records that start in each split, the last one open if it goes on in later splits.

    Lines bring the state that their split starts with and the number of its records.
    """
    key, inside, place, expected = None, False, 0, 0
    parts: list[bytes] = []

    def ended() -> Iterator[pa.RecordBatch]:
        if parts:
            yield _batch(key, [place], [b"\n".join(parts)], True)
            parts.clear()
        if key is not None and place != expected:
            raise ValueError("the input changed while it was read")

    for own, lines, run in _runs(batches):
        if own != key:
            yield from ended()
            key, place = own, 0
            inside, expected = (run.column(c)[0].as_py() for c in (3, 4))
        places, records, size = [], [], 0
        for line in lines:
            if not inside:
                if line in _BLANK:
                    continue
                place += 1
                if b'"' not in line or not inside_after(line, False):
                    places.append(place)
                    records.append(line.removesuffix(b"\r"))
                else:
                    parts.append(line)
                    inside = True
                size += len(line)
            else:
                inside = inside_after(line, True)
                if parts:
                    parts.append(line)
                    size += len(line)
                    if not inside:
                        places.append(place)
                        records.append(b"\n".join(parts).removesuffix(b"\r"))
                        parts.clear()
            if size >= BATCH_BYTES and records:
                yield _batch(key, places, records, False)
                places, records, size = [], [], 0
        if records:
            yield _batch(key, places, records, False)
    yield from ended()


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of splits that start inside a value, up to their first record."""
    key, parts, inside = None, [], False
    for own, lines, _ in _runs(batches):
        if own != key:
            if key is not None:
                yield _batch(key, [0], [b"\n".join(parts)], False)
            key, parts, inside = own, [], True
        for line in lines:
            if not inside:
                break
            parts.append(line)
            inside = inside_after(line, inside)
    if key is not None:
        yield _batch(key, [0], [b"\n".join(parts)], False)


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """``(_file, _start, line)`` in splits; the lines of a split stand in their order."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.col("value").cast("binary").alias("line"),
    )


def splits_of(lines: DataFrame, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """One row per split: ``inside`` and ``n`` (records that start in it), ``before`` (rows of the
    file before it, its header not counted), ``rows_before`` (rows of the files before), ``tail``
    (what later splits hold of its last record, line feed first) and ``names`` (the file's header).
    """
    scanned = materialize(lines.mapInArrow(_summaries(head_bytes), SPLIT_DDL))
    by_file = Window.partitionBy("_file").orderBy("_start")
    earlier = by_file.rowsBetween(Window.unboundedPreceding, -1)
    swaps = (F.col("end_out") & ~F.col("end_in")).cast("int")
    fixed = F.when(F.col("end_out") == F.col("end_in"), F.struct(F.col("end_out").alias("at"), F.col("_swaps")))
    counted = scanned.withColumn("_swaps", F.sum(swaps).over(by_file.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(fixed, ignorenulls=True).over(earlier)
    stated = counted.withColumns(
        {"_last": last, "_since": F.coalesce(F.lag("_swaps").over(by_file), F.lit(0))}
    )
    odd = (F.col("_since") - F.coalesce(F.col("_last")["_swaps"], F.lit(0))) % 2 == 1
    stated = stated.withColumn("inside", F.coalesce(F.col("_last")["at"], F.lit(False)) != odd)
    stated = stated.withColumn("n", F.when(F.col("inside"), F.col("n_in")).otherwise(F.col("n_out")))
    starts = F.when(F.col("n") > 0, F.col("_start"))
    placed = materialize(
        stated.withColumns(
            {
                "_owner": F.last(starts, ignorenulls=True).over(earlier),
                "_seen": F.coalesce(F.sum("n").over(earlier), F.lit(0)),
            }
        ).select("_file", "_start", "inside", "n", "_owner", "_seen", "head", "names")
    )
    first = placed.filter("n > 0 and _seen = 0").select(
        "_file", F.coalesce("names", F.raise_error(F.lit("a header line is longer than a split"))).alias("names")
    )
    files = placed.groupBy("_file").agg((F.sum("n") - 1).alias("_rows")).filter("_rows >= 0")
    among = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("rows_before", F.coalesce(F.sum("_rows").over(among), F.lit(0))).drop("_rows")
    tails = (
        _full_heads(lines, placed)
        .groupBy("_file", F.col("_owner").alias("_start"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col("_start").alias("at"), "head"))).alias("_heads"))
        # A record that goes on in later splits; its pieces make one value of one row.
        .select("_file", "_start", _joined(F.col("_heads")).alias("tail"))
    )
    return materialize(
        placed.drop("names").join(files, "_file").join(first, "_file").join(tails, ["_file", "_start"], "left").select(
            "_file", "_start", "inside", "n", (F.col("_seen") - 1).alias("before"), "rows_before", "tail", "names"
        )
    )


def _joined(heads: Column) -> Column:
    pieces = F.transform(heads, lambda h: F.concat(F.lit(b"\n"), h["head"]))
    everything = F.aggregate(pieces, F.lit(b""), lambda before, piece: F.concat(before, piece))
    ends_so = F.substring(everything, -1, 1) == F.lit(b"\r")
    return F.substring(everything, F.lit(1), F.octet_length(everything) - ends_so.cast("int"))


def _full_heads(lines: DataFrame, placed: DataFrame) -> DataFrame:
    """Heads of the splits that start inside a value, those that were too long read now."""
    inside = placed.filter(F.col("inside") & F.col("_owner").isNotNull())
    known = inside.filter(F.col("head").isNotNull()).select("_file", "_start", "_owner", "head")
    long = inside.filter(F.col("head").isNull()).select("_file", "_start", "_owner")
    if long.isEmpty():
        return known
    wanted = _with_splits(lines, long.select("_file", "_start"), ["_file", "_start", "line"])
    read = wanted.mapInArrow(_heads, RECORD_DDL).select("_file", "_start", F.col("record").alias("head"))
    return known.unionByName(long.join(read, ["_file", "_start"]).select(*known.columns))


def _with_splits(lines: DataFrame, splits: DataFrame, columns: list[str]) -> DataFrame:
    """Lines with the columns of their split, in the order of the file inside each split."""
    small = small_dimension(splits, MAX_SPLITS)
    if small is not splits:
        return lines.join(small, ["_file", "_start"]).select(*columns)
    placed = lines.withColumn("_at", F.monotonically_increasing_id())
    joined = placed.hint("shuffle_merge").join(splits, ["_file", "_start"])
    return joined.repartition("_file", "_start").sortWithinPartitions("_file", "_start", "_at").select(*columns)


def read_records(
    spark: SparkSession, path: str, head_bytes: int = HEAD_BYTES
) -> tuple[DataFrame, DataFrame]:
    """``(_file, _line, _row, _start, record)`` of all records but headers, and the splits.

    ``_line`` counts inside the file from 1, ``_row`` over the files in the order of their paths;
    both are dense. The input must not change meanwhile: a split whose records aren't as many as
    the first scan counted stops the read.
    """
    lines = lines_of(spark, path)
    splits = splits_of(lines, head_bytes)
    columns = ["_file", "_start", "line", "inside", "n"]
    read = _with_splits(lines, splits.select("_file", "_start", "inside", "n"), columns).mapInArrow(
        _records, RECORD_DDL
    )
    rest = splits.select("_file", "_start", "before", "rows_before", "tail")
    few_bytes = (splits.agg(F.sum(F.octet_length("tail"))).head()[0] or 0) <= MAX_TAIL_BYTES
    line = F.col("_place") + F.col("before")
    record = F.when(F.col("open") & F.col("tail").isNotNull(), F.concat("record", "tail")).otherwise(F.col("record"))
    numbered = read.join(small_dimension(rest, MAX_SPLITS) if few_bytes else rest, ["_file", "_start"]).select(
        "_file", line.alias("_line"), (line + F.col("rows_before")).alias("_row"), "_start",
        record.cast("string").alias("record"),
    )
    return numbered.filter("_line > 0"), splits
