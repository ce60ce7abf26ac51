"""What the corpus operators share: columns of the document table, label folds, checkpoints, ranks."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Rows whose crc32(doc_id as text) leaves this remainder by FOLDS are never learned from.
FOLDS = 5


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def held_out(column: str = "doc_id") -> Column:
    """Whether a document belongs to the fold that is kept for testing; false for a null id."""
    fold = F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(FOLDS))
    return F.coalesce(fold == 0, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only a session without that setting (a test on a single machine) gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Files that a small table is checkpointed in at most.
SMALL_PARTS = 8


def settle(df: DataFrame, small: bool = False) -> DataFrame:
    """Checkpoint in the shared folder: ends the lineage and survives lost executors.

    A ``small`` table (a row per group, leaf or length) goes to few files, however many partitions
    the shuffle before it had.
    """
    if small:
        df = df.coalesce(SMALL_PARTS)
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that this run wrote and that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int
) -> DataFrame:
    """``(text, y)`` of at most ``per_class`` training documents of each label.

    Only labels outside the held-out fold are read. The documents with the smallest hashes are
    taken, so the sample doesn't depend on partitioning. The ids that select them are at most
    ``2 * per_class`` rows, which bounds the broadcast whatever the tables' sizes; of a document
    with several rows the smallest text is taken, so the sample has no more rows than ids.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(
        F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out()
    )
    order = (F.xxhash64("doc_id", F.lit(label)), F.col("doc_id"))
    one, zero = (
        known.filter(F.col("y") == y).orderBy(*order).limit(per_class) for y in (1, 0)
    )
    chosen = one.unionByName(zero).groupBy("doc_id").agg(F.max("y").alias("y"))
    found = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def bucket_count(rows: Column) -> Column:
    """So many buckets that neither a bucket nor the list of buckets outgrows the square root."""
    return F.ceil(F.sqrt(rows.cast("double"))).cast("bigint")


#: A table of at most so many rows of a few numbers each, some ten megabytes, is broadcast.
BROADCAST_ROWS = 100_000
#: Parts that the rows of one key are dealt into where they meet a larger table by that key.
PARTS = 64


def small_join(
    rows: DataFrame, small: DataFrame, keys: Sequence[str], by: Column, how: str = "inner"
) -> DataFrame:
    """Join of ``rows`` with one row per key of ``small``, null keys equal.

    A key may hold any share of the rows. ``small`` is checkpointed and counted: up to
    ``BROADCAST_ROWS`` it is broadcast and the rows stay where they are; beyond that they are dealt
    into ``PARTS`` parts by a hash of ``by``, and the row of ``small`` is repeated for each part.
    """
    small = settle(small, small=True)
    added = [F.col(f"s.{c}") for c in small.columns if c not in keys]
    kept = [F.col(f"r.`{c}`") for c in rows.columns]
    if small.count() <= BROADCAST_ROWS:
        dealt, copies, on = rows, F.broadcast(small), list(keys)
    else:
        dealt = rows.withColumn("_dealt", F.pmod(F.xxhash64(by), F.lit(PARTS)).cast("int"))
        copies = small.withColumn("_dealt", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        on = [*keys, "_dealt"]
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in on]
    return dealt.alias("r").join(copies.alias("s"), same, how).select(*kept, *added)


def running_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: Column, name: str
) -> DataFrame:
    """Adds ``name``: the sum of ``weight`` over the rows before this one among those of its key.

    A key may hold any share of the rows, so no window sees them all: each key's rows are dealt
    into buckets by ``order[0]``, which must be a long that is spread evenly over 0 .. 2**60 - 1;
    sums per bucket are added up, then rows inside each bucket. The number of buckets is the
    square root of the key's rows, so both windows stay small. ``df`` is read twice and should
    stand on a table or checkpoint. Rows that tie in the whole ``order`` must be interchangeable.
    """
    keys = list(keys)
    counted = df.groupBy(*keys).agg(bucket_count(F.count("*")).alias("_buckets"))
    dealt = (
        small_join(df, counted, keys, F.col(order[0]))
        .withColumn("_weight", weight.cast("bigint"))
        .withColumn(
            "_bucket",
            F.floor(F.col(order[0]) / F.lit(float(1 << 60)) * F.col("_buckets")).cast("bigint"),
        )
        .drop("_buckets")
    )
    sums = dealt.groupBy(*keys, "_bucket").agg(F.sum("_weight").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = dealt.withColumn("_inside", F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "_bucket"]]
    return (
        placed.alias("p")
        .join(starts.alias("s"), same)
        .select("p.*", (F.col("s._start") + F.col("p._inside")).alias(name))
        .drop("_bucket", "_weight", "_inside")
    )


def spread(*columns: Column) -> Column:
    """A long spread evenly over 0 .. 2**60 - 1, for :func:`running_position`."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 4)


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))
