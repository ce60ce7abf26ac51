"""A ledger on shared storage that several runs may add to at once, each entry once.

A run stages its entries in a folder of its own and then tries to put a numbered manifest in place
that names this folder. Only one run can place a number; one that loses reads the ledger again,
drops what the winner has entered, and tries the next number. Readers see the folders that manifests
name, so entries appear all at once, and a run that dies leaves nothing that anybody reads.

The folder needs links or a rename that fails if the target exists and can't be seen half done: local
and shared POSIX folders, HDFS, ABFS. Object stores that rename by copying don't give that.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ticketlake.session import materialize


def manifests(spark: SparkSession, folder: str) -> list[str]:
    """Runs whose entries count, in the order of their manifests; one per run that added any."""
    try:
        lines = spark.read.text(f"{folder}/actas")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return [row.value for row in lines.orderBy(F.input_file_name()).collect()]


def entries(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All entries that count, with the run that entered them as ``intento``."""
    runs = manifests(spark, folder)
    schema = f"{schema}, intento string"
    if not runs:
        return spark.createDataFrame([], schema)
    base = f"{folder}/entradas"
    return spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/intento={run}" for run in runs])


def place(spark: SparkSession, source: str, target: str) -> bool:
    """Gives the file ``source`` the name ``target`` unless that exists; whether it did."""
    parts = urlparse(source)
    if parts.scheme in ("", "file") and not spark.sparkContext._jsc.hadoopConfiguration().get(
        "fs.defaultFS", "file:///"
    ).startswith("hdfs"):
        try:
            os.link(unquote(parts.path), unquote(urlparse(target).path))
        except FileExistsError:
            return False
        return True
    return _renamed(spark, source, target)


def _renamed(spark: SparkSession, source: str, target: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    old, new = hadoop.Path(source), hadoop.Path(target)
    context = hadoop.FileContext.getFileContext(old.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    keep_target = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context.rename(old, new, keep_target)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def _write_name(spark: SparkSession, path: str, name: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, False)
    out.write(bytearray(f"{name}\n", "ascii"))
    out.close()


def add_once(
    spark: SparkSession, folder: str, schema: str, missing: Callable[[DataFrame], DataFrame],
    run: str | None = None,
) -> DataFrame:
    """Adds what ``missing`` finds to be absent from the entries so far; returns all entries.

    ``missing`` is called again after each manifest that another run placed first. ``run`` names the
    run (a fresh name by default); its entries are the ones with that ``intento``. A run that finds
    nothing absent adds no manifest.
    """
    run = run or uuid.uuid4().hex
    staged = f"{folder}/entradas/intento={run}"
    while True:
        before = manifests(spark, folder)
        fresh = materialize(missing(entries(spark, folder, schema)))
        if run in before or fresh.isEmpty():
            return entries(spark, folder, schema)
        fresh.write.mode("overwrite").parquet(staged)
        draft = f"{folder}/actas/.{run}-{uuid.uuid4().hex}"
        _write_name(spark, draft, run)
        if place(spark, draft, f"{folder}/actas/{len(before) + 1:08d}"):
            return entries(spark, folder, schema)
