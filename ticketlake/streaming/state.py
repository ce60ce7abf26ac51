"""State of micro-batch streams on shared storage.

:func:`previous` and :func:`advance` hold small state as two alternating tables: batch ``n`` reads
what batch ``n - 1`` wrote and overwrites what batch ``n - 2`` wrote.

:class:`KeyedState` holds a row per key of any number of keys. A batch writes a run with the keys
that it changed and nothing else; when ``FAN`` runs of one size are there, they are merged to one of
the next size. Which runs make the state before batch ``n`` follows from ``n`` alone (its digits to
the base ``FAN``), so there is no list of runs to keep, and a batch that runs again reads the same
state and writes the same runs. Over ``b`` batches a key's change is written ``log(b)`` times at
most; a lookup meets ``FAN * log(b)`` runs and reads only the buckets of the keys asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ticketlake.operators.skew import small_dimension
from ticketlake.session import materialize

#: Runs of one size that are merged to one of the next.
FAN = 8
#: Buckets of keys in a run: what a lookup can leave unread.
BUCKETS = 32


def previous(spark: SparkSession, path: str, batch_id: int, schema: str) -> DataFrame:
    """What the batch before this one left; nothing before the first."""
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{(batch_id - 1) % 2}")


def advance(state: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Writes this batch's state and reads it back."""
    target = f"{path}/{batch_id % 2}"
    state.write.mode("overwrite").parquet(target)
    return state.sparkSession.read.schema(state.schema).parquet(target)


def runs_before(batch_id: int, fan: int = FAN) -> list[tuple[int, int]]:
    """``(level, number)`` of the runs that hold the state before a batch, oldest first.

    Run ``number`` of ``level`` holds the changes of ``fan ** level`` batches in a row.
    """
    level = 0
    while fan ** (level + 1) <= batch_id:
        level += 1
    runs, start = [], 0
    for k in range(level, -1, -1):
        size = fan**k
        while start + size <= batch_id:
            runs.append((k, start // size))
            start += size
    return runs


def runs_written(batch_id: int, fan: int = FAN) -> list[tuple[int, int]]:
    """The runs that a batch writes: its own and those that are merged after it."""
    runs = [(0, batch_id)]
    while (runs[-1][1] + 1) % fan == 0:
        runs.append((runs[-1][0] + 1, runs[-1][1] // fan))
    return runs


@dataclass(frozen=True)
class KeyedState:
    """Rows of ``schema`` by ``key``; a row whose ``gone`` condition holds stands for no state."""

    spark: SparkSession
    path: str
    key: str
    schema: str
    gone: str = "false"
    fan: int = FAN
    buckets: int = BUCKETS

    def _folder(self, run: tuple[int, int]) -> str:
        return f"{self.path}/nivel={run[0]}/tramo={run[1]}"

    def _read(self, runs: list[tuple[int, int]]) -> DataFrame:
        """The rows of some runs with ``_age``: later runs have the larger number."""
        rows = self.spark.createDataFrame([], f"{self.schema}, _cubeta int, _age int")
        for age, run in enumerate(runs):
            read = self.spark.read.schema(f"{self.schema}, _cubeta int").parquet(self._folder(run))
            rows = rows.unionByName(read.withColumn("_age", F.lit(age)))
        return rows

    def _latest(self, rows: DataFrame) -> DataFrame:
        """One row per key, of the latest run; a key has one row per run at most."""
        names = [c for c in rows.columns if c not in ("_age", "_cubeta", self.key)]
        newest = rows.groupBy(self.key).agg(F.max_by(F.struct(*names), "_age").alias("_row"))
        return newest.select(self.key, "_row.*")

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_cubeta", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _ordered(self, rows: DataFrame) -> DataFrame:
        return self.spark.createDataFrame([], self.schema).unionByName(rows)

    def before(self, batch_id: int, keys: DataFrame) -> DataFrame:
        """State of the given keys (distinct, one column) before a batch; only their buckets are read."""
        wanted = materialize(self._bucketed(keys.select(self.key)))
        touched = [r[0] for r in wanted.select("_cubeta").distinct().collect()]
        rows = self._read(runs_before(batch_id, self.fan)).filter(F.col("_cubeta").isin(touched))
        found = rows.join(small_dimension(wanted.select(self.key)), self.key, "left_semi")
        return self._ordered(self._latest(found).filter(f"not ({self.gone})"))

    def whole(self, batch_id: int) -> DataFrame:
        """State of all keys before a batch."""
        return self._ordered(self._latest(self._read(runs_before(batch_id, self.fan))).filter(f"not ({self.gone})"))

    def write(self, batch_id: int, changes: DataFrame) -> None:
        """The rows that a batch changed, one per key; merges the runs that are due."""
        self._store(self._ordered(changes), (0, batch_id))
        for level, number in runs_written(batch_id, self.fan)[1:]:
            parts = [(level - 1, n) for n in range(number * self.fan, (number + 1) * self.fan)]
            merged = self._latest(self._read(parts))
            # The first run of a level has nothing before it that a lost key could come back from.
            self._store(merged if number else merged.filter(f"not ({self.gone})"), (level, number))
        used = {*runs_before(batch_id, self.fan), *runs_before(batch_id + 1, self.fan)}
        old = {*runs_written(batch_id, self.fan)}
        if batch_id:
            old |= {*runs_before(batch_id - 1, self.fan), *runs_written(batch_id - 1, self.fan)}
        self._drop(old - used)

    def _store(self, rows: DataFrame, run: tuple[int, int]) -> None:
        self._bucketed(rows).repartition("_cubeta").sortWithinPartitions("_cubeta", self.key).write.mode(
            "overwrite"
        ).partitionBy("_cubeta").parquet(self._folder(run))

    def _drop(self, runs: set[tuple[int, int]]) -> None:
        """Deletes runs that no batch reads any more, not even one that runs again."""
        for run in runs:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._folder(run))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
