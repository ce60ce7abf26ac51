"""Helpers that keep work spread out when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: No key outside the hot list holds more than one part in so many of all rows, and the hot list
#: itself has fewer rows than this, whatever the data size.
HOT_PARTS = 100_000
#: Rows that a task takes of one key; a key with fewer is never worth splitting.
HOT_ROWS = 100_000
#: Groups of input tasks that the first round of :func:`top_per_key` merges.
SALTS = 64
#: A dimension of at most so many rows is broadcast; a larger one is joined by key.
DIMENSION_ROWS = 100_000


def hot_keys(counts: DataFrame, key: str, n: str, min_rows: int = HOT_ROWS) -> DataFrame:
    """``(key, _salts)`` of the keys in a ``(key, n)`` table that are too large for one task.

    A task's share is ``min_rows`` or one part in ``HOT_PARTS`` of all rows, whichever is more, so
    fewer than ``HOT_PARTS`` keys exceed it. Each is split into as many parts as it needs.
    """
    total = F.coalesce(counts.agg(F.sum(n)).scalar(), F.lit(0))
    share = F.greatest(F.lit(min_rows).cast("bigint"), F.ceil(total / F.lit(HOT_PARTS)))
    return counts.select(key, F.ceil(F.col(n) / share).cast("int").alias("_salts")).filter(
        "_salts > 1"
    )


def frequent_from(counts: DataFrame, n: str, max_rows: int) -> Column:
    """Whether a row of ``counts`` is among the most frequent ones by ``n``, ``max_rows`` at most, that
    can be broadcast. Equal ``n`` are in or out together."""
    sizes = counts.groupBy(n).agg(F.count("*").alias("_rows"))
    upto = sizes.withColumn("_rows", F.sum("_rows").over(Window.orderBy(F.desc(n))))
    least = upto.filter(F.col("_rows") <= max_rows).agg(F.min(n)).head()[0]
    return F.lit(False) if least is None else F.col(n) >= F.lit(least)


def salted_join(
    rows: DataFrame, lookup: DataFrame, key: str, hot: DataFrame, spread: Sequence[str],
    how: str = "inner",
) -> DataFrame:
    """Join ``rows`` with a ``lookup`` that has one row per key, splitting the hot keys.

    Rows of a hot key get a salt from a hash of the ``spread`` columns (deterministic, so a
    re-run task sends every row to the same place); the lookup row of a hot key is repeated once
    per salt. ``hot`` comes from :func:`hot_keys`, so broadcasting it is bounded by HOT_PARTS.
    """
    salts = F.coalesce("_salts", F.lit(1))
    salted = rows.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*spread), salts).cast("int")
    )
    copies = lookup.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), salts - 1))
    )
    return (
        salted.drop("_salts").join(copies.drop("_salts"), [key, "_salt"], how).drop("_salt")
    )


def small_dimension(df: DataFrame, max_rows: int = DIMENSION_ROWS) -> DataFrame:
    """A dimension marked for broadcast after its rows were counted; a larger one as it is."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def top_per_key(df: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per key, in two rounds.

    A first round keeps ``n`` rows per key and group of input tasks, a second round merges the
    groups, so it sees ``SALTS * n`` rows of a key at most, whatever the key's size. Up to Spark's
    window group limit (1,000 rows by default) input tasks drop further rows before the shuffle;
    above it the first round still spreads a key over ``SALTS`` tasks.
    """
    part = df.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    first = Window.partitionBy(key, "_part").orderBy(*order)
    kept = part.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= n)
    last = Window.partitionBy(key).orderBy(*order)
    return (
        kept.drop("_n", "_part")
        .withColumn("_n", F.row_number().over(last))
        .filter(F.col("_n") <= n)
        .drop("_n")
    )


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds computed columns that later filters read instead of computing them again.

    The optimizer moves a filter below a projection by repeating its expressions. A generator of
    exactly one row keeps the values where they were computed; it moves no data.
    """
    kept = [name for name in df.columns if name not in columns]
    fields = [expression.alias(name) for name, expression in columns.items()]
    return df.select(*kept, F.inline(F.array(F.struct(*fields))))
