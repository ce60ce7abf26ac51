"""Ticket history files in, cleaned tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ticketlake.functions.catalogs import canonical_column
from ticketlake.functions.text import strip, text_or_empty
from ticketlake.operators.skew import settled, small_dimension
from ticketlake.schemas import TICKET_COLUMNS
from ticketlake.sources.csv_records import lines_of, read_records


def _csv(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """The lines of a history as they are read; the same splits with and without line breaks."""
    return lines_of(spark, path)


def read_tickets(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Raw tickets as text with ``_row``, ``_file`` and ``_line``; a missing path is an error.

    Columns go by the names in each file's own header line, in any order and number: a missing
    column is null and an unknown one is left out. ``_row`` is unique over all files. Blank lines
    do not count. Values may hold line breaks inside quotes; files are read in splits all the same
    (``multi_line`` is accepted and changes nothing). Of two columns of one name the first counts.
    """
    records, splits = read_records(spark, path)
    width = splits.agg(F.max(F.size("names"))).head()[0] or 1
    positions = [f"_c{i}" for i in range(width)]
    options = {"quote": '"', "escape": '"', "multiLine": "true", "maxColumns": str(width + 1024)}
    parsed = F.from_csv("record", ", ".join(f"{name} string" for name in positions), options)
    places = splits.groupBy("_file").agg(F.first("names").alias("_names")).select(
        "_file",
        *[F.array_position("_names", F.lit(n)).cast("int").alias(f"_at_{n}") for n in TICKET_COLUMNS],
    )
    # Parsed once: each field of an expression would parse the record again.
    held = settled(records, {"_parsed": parsed})
    values = held.withColumn("_values", F.array(*[F.col(f"_parsed.{name}") for name in positions]))
    named = values.join(small_dimension(places), "_file")
    return named.select(
        "_row", "_file", "_line", *[F.get("_values", F.col(f"_at_{n}") - 1).alias(n) for n in TICKET_COLUMNS]
    )


def write_clean(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The twelve columns in order; as CSV with ISO dates and a null close date left empty."""
    ordered = df.select(*TICKET_COLUMNS)
    if fmt == "csv":
        ordered.write.option("header", True).option("escape", '"').option(
            "emptyValue", ""
        ).option("dateFormat", "yyyy-MM-dd").csv(path)
    else:
        ordered.write.format(fmt).save(path)


def write_quarantine(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Quarantine records with the original row as JSON, one folder per motive."""
    records = df.withColumn("fila_original", F.to_json("fila_original"))
    writer = records.write.partitionBy("motivo")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """Both summary blocks in one CSV table, in report order."""
    (
        summary.select(
            "agrupacion", "nombre", "total", "abiertos", "cerrados", "tasa_reapertura_pct"
        )
        .write.option("header", True)
        .option("escape", '"')
        .csv(path)
    )


def read_labelled_texts(raw: DataFrame, *keep: str) -> DataFrame:
    """``(asunto, texto, etiqueta)`` of raw tickets with a usable category and some text."""
    title = strip(text_or_empty(F.col("asunto")))
    text = strip(F.concat(title, F.lit(" "), text_or_empty(F.col("descripcion"))))
    label = canonical_column("categoria", F.col("categoria"))
    read = settled(
        raw.select(*keep, "asunto", "descripcion", "categoria"), {"texto": text, "etiqueta": label}
    )
    return read.filter(F.col("etiqueta").isNotNull() & (F.col("texto") != "")).select(
        *keep, title.alias("asunto"), "texto", "etiqueta"
    )
