"""Registered queries over readers, sinks and streams: write from the given tables, read back.

Every call writes below a folder of its own in the session's shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, functions as F

from ticketlake.operators import chunks, clean, dictionaries, evaluation, metrics, reports, rules, tfidf
from ticketlake.plans.queries import (
    HOLIDAYS,
    SESSION_GAP,
    TODAY,
    _cleaned,
    _matrix,
    _operations,
    _questions,
    _raw,
    _session_times,
    query,
)
from ticketlake.plans.views import view
from ticketlake.schemas import INTAKE_EVENT, LOG_FIELDS, TICKET_COLUMNS
from ticketlake.session import materialize, shared_folder, stored
from ticketlake.sources import documents, months, tickets
from ticketlake.streaming.flows import (
    classify_batches,
    classify_with_answers,
    clean_changes,
    clean_so_far,
    late_events,
    rolling_latency,
    send_reminders,
    session_counts,
    stream_clean,
    window_counts,
)
from ticketlake.streaming.intake import idempotent_intake

#: Micro-batches that the stream queries cut their input into.
PARTS = 3


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/consulta-{uuid.uuid4().hex}"


# Sources and sinks ----------------------------------------------------------------------------


def _write_history(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    writer = rows.write.mode(mode).option("header", True).option("escape", '"')
    for option in ("ignoreLeadingWhiteSpace", "ignoreTrailingWhiteSpace"):
        writer = writer.option(option, False)
    writer.csv(path)


@query
def s1_read(spark, sf_dir):
    """A history in files whose headers name the columns in different orders."""
    path = _folder(spark)
    raw = _raw(spark, sf_dir)
    odd = F.col("_row") % 2 == 1
    _write_history(raw.filter(odd).select(*TICKET_COLUMNS), path)
    extra = F.lit("sobra").alias("otra")
    _write_history(raw.filter(~odd).select(*reversed(TICKET_COLUMNS), extra), path, "append")
    return tickets.read_tickets(spark, path).select(*TICKET_COLUMNS)


@query
def w2_rows(spark, sf_dir):
    """Row numbers over all files of an ordered history."""
    path = _folder(spark)
    raw = _raw(spark, sf_dir).select("_row", "id", *[c for c in TICKET_COLUMNS if c != "id"])
    _write_history(raw.orderBy("_row").drop("_row"), path)
    return tickets.read_tickets(spark, path).select("_row", "id", "fecha_creacion")


@query
def s2_clean(spark, sf_dir):
    path = _folder(spark)
    tickets.write_clean(_cleaned(spark, sf_dir).clean, path, "csv")
    return tickets.read_tickets(spark, path).select(*TICKET_COLUMNS)


def _by_month(spark, sf_dir) -> str:
    path = _folder(spark)
    months.write_months(_cleaned(spark, sf_dir).clean, path)
    return path


@query
def p6_stored(spark, sf_dir):
    """A period that begins and ends inside months, over the history stored by month."""
    stored = months.read_months(spark, _by_month(spark, sf_dir), date(1997, 1, 15), date(1997, 3, 10))
    return stored.select("_row", "id", "fecha_creacion")


@query
def a9_stored(spark, sf_dir):
    """The monthly report over the history stored by month."""
    stored = months.read_month(spark, _by_month(spark, sf_dir), 1997, 12)
    return reports.period_report(stored, "1997-12")


@query
def s2_months_stream(spark, sf_dir):
    """The change log of the cleaning stream, applied to a table by month batch by batch."""
    folder = _streamed(spark, sf_dir)
    log = clean_changes(spark, f"{folder}/limpios")
    for batch in range(PARTS):
        months.apply_changes(spark, f"{folder}/meses", log.filter(F.col("lote") == batch))
    return months.read_months(spark, f"{folder}/meses")


@query
def s3_quarantine(spark, sf_dir):
    path = _folder(spark)
    tickets.write_quarantine(_cleaned(spark, sf_dir).quarantine, path)
    return spark.read.parquet(path).select(
        "numero_de_fila",
        "motivo",
        "detalle",
        "numero_fila_descartada",
        F.size(F.json_object_keys("fila_original")).cast("bigint").alias("campos"),
    )


@query
def s4_written(spark, sf_dir):
    """The summary of the cleaned history, written as a report and read back."""
    path = _folder(spark)
    tickets.write_summary(reports.summarize(_cleaned(spark, sf_dir).clean), path)
    schema = "agrupacion string, nombre string, total long, abiertos long, cerrados long, tasa_reapertura_pct double"
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


@query
def s7_read(spark, sf_dir):
    """One file per page, read back as a folder of documents."""
    path = _folder(spark)
    documents.write_policy_texts(view(spark, sf_dir, "pages").select("page_id", "html"), path, "page_id")
    read = documents.read_policy_texts(spark, path)
    page = F.regexp_extract("doc_id", "page_id=([0-9]+)", 1).cast("bigint")
    return read.select(page.alias("page_id"), F.md5("text").alias("texto_md5"))


@query
def s8_log(spark, sf_dir):
    """Log lines out with private fields replaced, and in again with every field."""
    path = _folder(spark)
    operations = _operations(spark, sf_dir).select("seq", "operacion", "latencia_ms", "id_traza")
    requests = view(spark, sf_dir, "solicitudes_crudas").select("seq", "descripcion", "solicitante")
    joined = operations.join(requests, "seq")
    given = {"evento": F.col("operacion")}
    events = joined.select(
        *[
            given.get(name, F.col(name) if name in joined.columns else F.lit(None).cast("string")).alias(name)
            for name in LOG_FIELDS
        ],
        F.create_map(
            F.lit("seq"), F.col("seq").cast("string"),
            F.lit("latencia_ms"), F.col("latencia_ms").cast("string"),
            F.lit("correo_interno"), F.lit("x"),
        ).alias("extras"),
    )
    documents.write_event_log(events, path)
    read = documents.read_event_log(spark, path)
    return read.select(
        F.element_at("extras", "seq").cast("bigint").alias("seq"),
        "evento",
        "id_traza",
        "descripcion",
        "solicitante",
        F.element_at("extras", "latencia_ms").cast("double").alias("latencia_ms"),
        F.size("extras").cast("bigint").alias("extras"),
    )


@query
def p13_whole(spark, sf_dir):
    """Usable ids stay, every other row gets one of its own."""
    events = _operations(spark, sf_dir).select("seq", "id_traza")
    given = events.select("seq", metrics.usable_trace(F.col("id_traza")).alias("util"))
    after = materialize(metrics.standardize_trace_ids(events)).join(given, "seq")
    fresh = F.col("util").isNull()
    return after.agg(
        F.count("*").alias("filas"),
        F.count_if(F.col("id_traza") == F.col("util")).alias("conservadas"),
        F.count_if(fresh).alias("nuevas"),
        F.count_distinct(F.when(fresh, F.col("id_traza"))).alias("distintas"),
        F.count_if(fresh & F.col("id_traza").rlike("^[0-9a-f]{32}$")).alias("con_forma"),
    )


def _some_unreadable(spark, sf_dir):
    text = F.when(F.col("doc_id") % 50 != 7, F.col("text"))
    return view(spark, sf_dir, "politicas").withColumn("text", text)


@query
def a24_unreadable(spark, sf_dir):
    return chunks.ingestion_report(_some_unreadable(spark, sf_dir))


@query
def a24_outcomes(spark, sf_dir):
    return chunks.document_outcomes(_some_unreadable(spark, sf_dir))


# Inputs as tables -----------------------------------------------------------------------------


@query
def p2_table_catalog(spark, sf_dir):
    """Market segments against a catalog that comes from the table itself."""
    segments = view(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    table = segments.select(
        F.lit("area").alias("catalogo"),
        F.explode(F.array("c_mktsegment", F.concat(F.lit("grupo "), "c_mktsegment"))).alias("forma"),
        F.initcap("c_mktsegment").alias("valor"),
    )
    written = (
        F.when(F.col("c_custkey") % 7 == 0, F.lit("otro"))
        .when(F.col("c_custkey") % 7 == 1, F.lit("  "))
        .when(F.col("c_custkey") % 7 == 2, F.concat(F.lit("2 - Grupo  "), F.col("c_mktsegment")))
        .otherwise(F.concat(F.lit(" "), F.lower("c_mktsegment")))
    )
    rows = view(spark, sf_dir, "customer").select("c_custkey", written.alias("area"))
    read = dictionaries.standardize_by_table(rows, {"v": "area"}, table)
    return read.select("c_custkey", F.col("v.valor").alias("valor"), F.col("v.motivo").alias("motivo"))


@query
def t2_table_rules(spark, sf_dir):
    """Documents by keyword rules that come from a table: parts of nation names, by region."""
    nations = view(spark, sf_dir, "nation").join(
        view(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    table = nations.select(
        F.col("n_nationkey").alias("orden"),
        F.col("r_name").alias("categoria"),
        F.substring("n_name", 1, 3).alias("palabra"),
    )
    classified = dictionaries.classify_by_rule_table(
        view(spark, sf_dir, "documents"), F.col("text"), table
    )
    return classified.select("doc_id", "categoria")


@query
def t6_bm25(spark, sf_dir):
    corpus = stored(
        tfidf.term_counts(
            view(spark, sf_dir, "documents").withColumnRenamed("doc_id", "doc_key"),
            F.col("text"),
            "doc_key",
        )
    )
    found = tfidf.bm25_top_k(_questions(spark, sf_dir), corpus)
    return found.withColumns(
        {"puntaje": F.round("puntaje", 4), "posicion": F.col("posicion").cast("bigint")}
    )


@query
def t8_prompt(spark, sf_dir):
    prompts = rules.classification_prompt(view(spark, sf_dir, "tickets_conversados"))
    return prompts.select("ticket_id", F.md5("entrada").alias("entrada_md5"))


@query
def a19_gate(spark, sf_dir):
    return evaluation.macro_f1_gate(evaluation.class_metrics(_matrix(spark, sf_dir)))


# Streams over files ---------------------------------------------------------------------------


def _in_batches(rows: DataFrame, order: str, path: str, run: Callable[[DataFrame], object]) -> None:
    """Writes ``rows`` in ``PARTS`` steps by ``order`` and runs the stream after each."""
    spark = rows.sparkSession
    rows = materialize(rows)
    first, last = rows.agg(F.min(order), F.max(order)).head()
    width = (last - first) // PARTS + 1
    for part in range(PARTS):
        low = first + part * width
        step = rows.filter(F.col(order).between(low, low + width - 1))
        step.write.mode("append").parquet(path)
        run(spark.readStream.schema(rows.schema).parquet(path)).awaitTermination()


@query
def r1_stream(spark, sf_dir):
    folder = _folder(spark)
    names = [field.name for field in INTAKE_EVENT]
    _in_batches(
        view(spark, sf_dir, "ingreso").select(*names), "seq", f"{folder}/log",
        lambda events: idempotent_intake(
            events, f"{folder}/salida", f"{folder}/estado", f"{folder}/control"
        ),
    )
    return spark.read.parquet(f"{folder}/salida").drop("lote")


@query
def r2_stream(spark, sf_dir):
    folder = _folder(spark)
    target = f"{folder}/ventanas"

    def counted(events: DataFrame):
        return (
            window_counts(events).writeStream.outputMode("complete")
            .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(target))
            .option("checkpointLocation", f"{folder}/control")
            .trigger(availableNow=True).start()
        )

    _in_batches(_operations(spark, sf_dir), "seq", f"{folder}/log", counted)
    return spark.read.parquet(target).withColumn(
        "desde", F.date_format("desde", "yyyy-MM-dd HH:mm:ss")
    )


def _out_of_order(spark, sf_dir) -> DataFrame:
    """Operations with the second at which they arrive: four of five come hours after their time."""
    events = _operations(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withColumn("llegada", F.unix_seconds("ts") + F.col("seq") % 5 * 14400)


@query
def r2_sessions(spark, sf_dir):
    """Sessions over events out of order by up to 16 hours, none of them too late."""
    folder = _folder(spark)

    def counted(events: DataFrame):
        return (
            session_counts(events, f"{SESSION_GAP} seconds", "1 day").writeStream.outputMode("append")
            .option("checkpointLocation", f"{folder}/control")
            .format("parquet").option("path", f"{folder}/sesiones")
            .trigger(availableNow=True).start()
        )

    events = _out_of_order(spark, sf_dir)
    _in_batches(events, "llegada", f"{folder}/log", counted)
    # Nothing comes any more: an event of no operation moves the time on.
    end = {"ts": F.lit("2100-01-01").cast("timestamp")}
    last = [end.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in events.dtypes]
    spark.range(1).select(*last).write.mode("append").parquet(f"{folder}/log")
    counted(spark.readStream.schema(events.schema).parquet(f"{folder}/log")).awaitTermination()
    return _session_times(spark.read.parquet(f"{folder}/sesiones"))


@query
def r2_late_events(spark, sf_dir):
    """Events whose hour had closed, by the events of earlier batches, when they arrived."""
    folder = _folder(spark)
    _in_batches(
        _out_of_order(spark, sf_dir), "llegada", f"{folder}/log",
        lambda events: late_events(events, f"{folder}/tardios", f"{folder}/estado", f"{folder}/control"),
    )
    late = spark.read.parquet(f"{folder}/tardios")
    return late.select("seq", "operacion", F.col("lote").cast("bigint").alias("lote"))


@query
def r2_latency_stream(spark, sf_dir):
    folder = _folder(spark)
    target = f"{folder}/resumen"
    _in_batches(
        _operations(spark, sf_dir), "seq", f"{folder}/log",
        lambda events: rolling_latency(
            events, f"{folder}/muestras",
            lambda df: df.write.mode("overwrite").parquet(target), f"{folder}/control",
        ),
    )
    return spark.read.parquet(target)


@query
def r3_stream(spark, sf_dir):
    folder = _folder(spark)
    answers = materialize(view(spark, sf_dir, "respuestas_modelo"))
    _in_batches(
        view(spark, sf_dir, "tickets_conversados"), "ticket_id", f"{folder}/log",
        lambda arrived: classify_batches(arrived, answers, f"{folder}/salida", f"{folder}/control"),
    )
    return spark.read.parquet(f"{folder}/salida").drop("lote")


@query
def r3_late_answers(spark, sf_dir):
    """Answers come one step after their tickets and twice; every fifth comes after the wait."""
    folder = _folder(spark)
    start = F.unix_timestamp(F.lit("2025-01-01 00:00:00"))
    asked = F.timestamp_seconds(start + F.col("ticket_id"))
    tickets_in = materialize(view(spark, sf_dir, "tickets_conversados").withColumn("momento", asked))
    minutes = F.when(F.col("ticket_id") % 5 == 0, 200).otherwise(F.col("ticket_id") % 100)
    first = view(spark, sf_dir, "respuestas_modelo").withColumn(
        "momento_respuesta", F.timestamp_seconds(start + F.col("ticket_id") + 60 * minutes)
    )
    again = first.withColumns(
        {"texto": F.lit("otra"), "momento_respuesta": F.col("momento_respuesta") + F.expr("INTERVAL 5 MINUTES")}
    )
    answers_in = materialize(first.unionByName(again))
    low, high = tickets_in.agg(F.min("ticket_id"), F.max("ticket_id")).head()
    width = (high - low) // PARTS + 1
    end = F.lit("2100-01-01").cast("timestamp")
    for part in range(PARTS + 2):
        def step(rows, at, time):
            if at == PARTS:  # nothing comes any more: a row of no ticket moves the time on
                other = {"ticket_id": F.lit(-1), time: end}
                row = [other.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in rows.dtypes]
                return spark.range(1).select(*row)
            return rows.filter(F.floor((F.col("ticket_id") - low) / width) == at)

        step(tickets_in, min(part, PARTS), "momento").write.mode("append").parquet(f"{folder}/tickets")
        step(answers_in, part - 1, "momento_respuesta").write.mode("append").parquet(f"{folder}/respuestas")
        classify_with_answers(
            spark.readStream.schema(tickets_in.schema).parquet(f"{folder}/tickets"),
            spark.readStream.schema(answers_in.schema).parquet(f"{folder}/respuestas"),
            f"{folder}/salida", f"{folder}/control", late="4 hours",
        ).awaitTermination()
    return spark.read.parquet(f"{folder}/salida").drop("lote")


@query
def r4_reminders(spark, sf_dir):
    """The second run of a day adds nothing."""
    folder = _folder(spark)
    inputs = [materialize(view(spark, sf_dir, name)) for name in ("tickets", "historial_estado")]
    for _ in range(2):
        sent = send_reminders(*inputs, folder, TODAY, HOLIDAYS)
    return sent.select("id_ticket", "codigo", "dias_habiles", "tipo", "fecha")


def _streamed(spark, sf_dir) -> str:
    folder = _folder(spark)
    _in_batches(
        _raw(spark, sf_dir), "_row", f"{folder}/log",
        lambda raw: stream_clean(
            raw, f"{folder}/limpios", f"{folder}/rechazos", f"{folder}/control"
        ),
    )
    return folder


@query
def r5_stream(spark, sf_dir):
    return clean_so_far(spark, f"{_streamed(spark, sf_dir)}/limpios", PARTS - 1)


@query
def r5_rejects(spark, sf_dir):
    return spark.read.parquet(f"{_streamed(spark, sf_dir)}/rechazos").select(
        "numero_de_fila", "motivo", "detalle", "numero_fila_descartada"
    )
