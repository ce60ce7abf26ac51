"""Policy texts, labelled reference cases and event logs."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable, Iterator
from itertools import groupby
from urllib.parse import quote

from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from ticketlake.functions.text import strip, text_or_empty
from ticketlake.operators.chunks import plain_lines
from ticketlake.operators.evaluation import NO_SUPPORT
from ticketlake.operators.metrics import redact_events
from ticketlake.schemas import LOG_FIELDS, REFERENCE_CASE

# Functions that run in tasks travel with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: Splits of small files that a task reads, as long as there are so many tasks for each core.
SPLITS, TASKS_PER_CORE = 16, 8


def write_policy_texts(docs: DataFrame, path: str, key: str) -> None:
    """One file per document ``(key, text)`` below the new folder ``path``, named ``key=value``, for
    :func:`read_policy_texts`: the text and a line feed. Rows of a task that share a key share a file.

    Where the folder is a local or mounted one, tasks write the files themselves, because Spark's text
    writer takes many times as long for a small file there as the file itself; elsewhere that one writes.
    """
    session = docs.sparkSession.sparkContext
    folder = session._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(session._jsc.hadoopConfiguration())
    if store.getScheme() != "file":
        docs.write.partitionBy(key).text(path)
        return
    store.mkdirs(folder)
    write = _files_of_task(store.makeQualified(folder).toUri().getPath(), key)
    docs.sortWithinPartitions(key).foreachPartition(write)


def _files_of_task(folder: str, key: str) -> Callable[[Iterator[Row]], None]:
    """A task's files stand in a folder of its own. A file gets its name when it is whole; a task that
    runs again writes the same files."""

    def write(rows: Iterator[Row]) -> None:
        task = TaskContext.get()
        own = f"{folder}/tarea-{task.partitionId():06d}"
        draft = f"{own}/.{task.taskAttemptId()}"
        for value, same in groupby(rows, key=lambda row: row[0]):
            os.makedirs(own, exist_ok=True)
            with open(draft, "wb") as out:
                for row in same:
                    out.write(f"{'' if row[1] is None else row[1]}\n".encode())
            name = "__HIVE_DEFAULT_PARTITION__" if value is None else quote(str(value), safe="")
            os.replace(draft, f"{own}/{key}={name}")

    return write


def read_policy_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, file_name, text)``, one row per document of a folder; an empty folder gives none.

    Bytes that are not UTF-8 make the text null: the document is reported, the others go on.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    # The reader rates each file at some megabytes, so a split holds a few small ones.
    splits = files.rdd.getNumPartitions()
    files = files.coalesce(max(1, min(splits, max(spark.sparkContext.defaultParallelism * TASKS_PER_CORE, -(-splits // SPLITS)))))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(
        F.col("path").alias("doc_id"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("file_name"),
        F.try_validate_utf8(F.col("content").cast("string")).alias("text"),
    ).withColumn("text", F.when(F.col("text").isNotNull(), plain_lines(F.col("text"))))


def reference_cases(rows: DataFrame) -> DataFrame:
    """``(id_caso, pregunta, esperado, cita_esperada)`` of the rows about policy questions.

    Rows without a source document that are not "no evidence" cases belong to classification.
    The expected citation is the file name up to ``_`` and the first of the listed sections.
    """
    expected = strip(text_or_empty(F.col("respuesta_o_categoria_esperada")))
    document = strip(text_or_empty(F.col("documento_fuente")))
    section = strip(F.get(F.split(text_or_empty(F.col("seccion_fuente")), " y "), F.lit(0)))
    citation = F.concat(F.get(F.split(document, "_"), F.lit(0)), F.lit(" §"), section)
    return rows.filter((expected == NO_SUPPORT) | (document != "")).select(
        "id_caso",
        F.col("pregunta_o_texto").alias("pregunta"),
        expected.alias("esperado"),
        F.when(document != "", citation).alias("cita_esperada"),
    )


def read_reference_cases(spark: SparkSession, path: str) -> DataFrame:
    rows = (
        spark.read.schema(REFERENCE_CASE)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )
    return reference_cases(rows)


def event_fields(lines: DataFrame) -> DataFrame:
    """Log events from lines of JSON text (``value``).

    The known fields are columns, every other field stays in the map ``extras`` (a nested value as
    its JSON text). A line that is no JSON object keeps its text in ``_roto``.
    """
    fields = F.from_json(F.col("value"), "map<string,string>")
    read = lines.filter(F.trim("value") != "").select("value", fields.alias("f"))
    broken = F.col("f").isNull()
    return read.select(
        *[F.element_at("f", name).alias(name) for name in LOG_FIELDS],
        F.map_filter("f", lambda name, value: ~name.isin(*LOG_FIELDS)).alias("extras"),
        F.when(broken, F.col("value")).alias("_roto"),
    )


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line."""
    return event_fields(spark.read.text(path))


def stream_event_log(spark: SparkSession, path: str) -> DataFrame:
    return event_fields(spark.readStream.text(path))


def write_event_log(events: DataFrame, path: str) -> None:
    """One JSON object per line: known fields and extras side by side, private ones replaced."""
    redacted = redact_events(events)
    known = F.map_from_arrays(
        F.array(*map(F.lit, LOG_FIELDS)), F.array(*[F.col(name) for name in LOG_FIELDS])
    )
    given = F.map_filter(known, lambda name, value: value.isNotNull())
    fields = F.map_concat(given, F.coalesce("extras", F.create_map().cast("map<string,string>")))
    redacted.select(F.to_json(fields).alias("value")).write.text(path)
