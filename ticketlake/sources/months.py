"""Clean tickets stored by the month of their creation: a period reads the months it touches only.

A stored table has a folder per month, named by the month's first day. Writing replaces the months
that the new rows belong to and leaves the others alone, so a run over part of a history, or a change
log, rewrites what it touches. Two jobs at once must not write the same month.
"""

from __future__ import annotations

from calendar import monthrange
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ticketlake.operators.clean import CLEAN_ROWS
from ticketlake.schemas import TICKET_COLUMNS
from ticketlake.session import materialize

MONTH = "mes_creacion"
_ROWS = ("_row", *TICKET_COLUMNS)


def _month() -> Column:
    return F.trunc("fecha_creacion", "month")


def write_months(clean: DataFrame, path: str) -> None:
    """Clean tickets (``_row`` and the twelve columns) by month; the months they belong to are replaced.

    Rows meet by month before they are written, so a month has few files; a month that is too large
    for one task is split, and small ones share a task. An empty frame writes nothing.
    """
    rows = clean.select(*_ROWS).withColumn(MONTH, _month())
    rows.hint("rebalance", F.col(MONTH)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(MONTH).parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{CLEAN_ROWS}, {MONTH} date").parquet(path)


def read_months(
    spark: SparkSession, path: str, start: date | None = None, end: date | None = None
) -> DataFrame:
    """Stored tickets created in the closed interval; an open side is unbounded.

    The months outside the interval are left unread: the bounds reach the folder names as partition
    filters and the files as pushed filters.
    """
    rows = _stored(spark, path).filter(F.col("id").isNotNull())
    if start is not None:
        rows = rows.filter((F.col(MONTH) >= F.lit(start.replace(day=1))) & (F.col("fecha_creacion") >= F.lit(start)))
    if end is not None:
        rows = rows.filter((F.col(MONTH) <= F.lit(end.replace(day=1))) & (F.col("fecha_creacion") <= F.lit(end)))
    return rows.select(*_ROWS)


def read_month(spark: SparkSession, path: str, year: int, month: int) -> DataFrame:
    """Stored tickets created in one month."""
    return read_months(spark, path, date(year, month, 1), date(year, month, monthrange(year, month)[1]))


def apply_changes(spark: SparkSession, path: str, changes: DataFrame) -> list[date]:
    """Bring a stored table up to date with one batch of a change log; return the months rewritten.

    ``changes`` holds clean tickets with ``cambio``: ``+`` for a row kept from now on, ``-`` for one
    that it displaces; a row counts by its ``_row``. Only the months of changed rows are read and
    written. Applying a batch again changes nothing. A month that loses its last row keeps a marker
    without an id, which readers leave out: a month without new rows would not be replaced. The list
    of months is the only thing that reaches the driver; it grows with the years, not with the rows.
    """
    changes = materialize(changes.select("cambio", *_ROWS))
    touched = [row[0] for row in changes.select(_month().alias("m")).distinct().collect() if row[0]]
    if not touched:
        return []
    added = changes.filter("cambio = '+'").select(*_ROWS)
    try:
        before = _stored(spark, path).filter(F.col(MONTH).isin(touched) & F.col("id").isNotNull())
        unchanged = before.select(*_ROWS).join(changes.select("_row"), "_row", "left_anti")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        unchanged = added.limit(0)
    rows = materialize(unchanged.unionByName(added))
    held = {row[0] for row in rows.select(_month().alias("m")).distinct().collect()}
    emptied = [(m,) for m in touched if m not in held]
    markers = spark.createDataFrame(emptied, "fecha_creacion date")
    write_months(rows.unionByName(markers, allowMissingColumns=True), path)
    return sorted(touched)
