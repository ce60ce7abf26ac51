"""Streams that reuse the batch operators: metrics, classification, cleaning, reminders."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ticketlake.operators.clean import (
    CLEAN_ROWS,
    check_tickets,
    duplicate_rejects,
    mark_duplicates,
    typed_tickets,
    validation_rejects,
)
from ticketlake.operators.metrics import CALL_SUMS, call_sums, last_samples, latency_summary
from ticketlake.operators.reminders import due_reminders, last_change, not_yet_sent
from ticketlake.operators.rules import ANSWER_COLUMNS, answer_order, validate_model_output
from ticketlake.session import materialize
from ticketlake.streaming.ledger import add_once
from ticketlake.streaming.state import KeyedState, advance, previous


def window_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calls, degraded calls and tokens per operation and event-time window.

    The watermark is an addition for unbounded input: it bounds the state. Events of windows that
    had closed when they arrived are left out here and written by :func:`late_events`.
    """
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", width), "operacion")
        .agg(*call_sums())
        .select(F.col("window.start").alias("desde"), "operacion", *CALL_SUMS)
    )


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Calls, degraded calls and tokens of each session of an operation, as a stream.

    A session is a run of calls at most ``gap`` apart; :func:`ticketlake.operators.metrics.sessions`
    finds the same in batch. A session is given out once the watermark has passed its last call by
    ``gap``; events may come out of order by up to ``late``, also such that join two sessions to one.
    State is a row per open session. Each task merges its own calls to sessions before they meet by
    operation, so a busy operation costs its sessions. Rows without a time are left out.
    """
    events.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap), "operacion")
        .agg(*call_sums(), F.max("ts").alias("hasta"))
        .select(F.col("session_window.start").alias("desde"), "hasta", "operacion", *CALL_SUMS)
    )


def late_events(
    events: DataFrame, late_path: str, state_path: str, checkpoint: str, width: str = "1 hour",
    late: str = "10 minutes", trigger: dict | None = None,
) -> StreamingQuery:
    """Writes the events whose window had closed when they arrived: what :func:`window_counts`
    leaves out of the same micro-batches. Its state is the latest event time so far."""
    def keep(batch: DataFrame, batch_id: int) -> None:
        before = previous(batch.sparkSession, state_path, batch_id, "ts timestamp")
        timed = batch.withColumn("ts", F.col("ts").cast("timestamp"))
        closed = before.agg(F.max("ts") - F.expr(f"INTERVAL {late}")).scalar()
        ended = F.col("_window.end") <= closed
        timed.withColumn("_window", F.window("ts", width)).filter(ended).drop("_window").write.mode(
            "overwrite"
        ).parquet(f"{late_path}/lote={batch_id}")
        latest = timed.select("ts").unionByName(before).agg(F.max("ts").alias("ts"))
        advance(latest, state_path, batch_id)

    return _each_batch(events, keep, checkpoint, trigger)


def _each_batch(
    events: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str,
    trigger: dict | None,
) -> StreamingQuery:
    return (
        events.writeStream.foreachBatch(work)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def rolling_latency(
    events: DataFrame, samples_path: str, publish: Callable[[DataFrame], None],
    checkpoint: str, trigger: dict | None = None,
) -> StreamingQuery:
    """Latency summary over the last samples of each operation, refreshed per micro-batch.

    The state holds the samples that count, ``MAX_SAMPLES`` per operation at most; each batch
    merges its own into them and publishes the summary.
    """
    def refresh(batch: DataFrame, batch_id: int) -> None:
        schema = "operacion string, seq long, latencia_ms double"
        before = previous(batch.sparkSession, samples_path, batch_id, schema)
        arrived = batch.select(
            "operacion", F.col("seq").cast("bigint"), F.col("latencia_ms").cast("double")
        )
        kept = last_samples(arrived.unionByName(before), "operacion", "seq")
        publish(latency_summary(advance(kept, samples_path, batch_id)))

    return _each_batch(events, refresh, checkpoint, trigger)


def classify_batches(
    tickets: DataFrame, responses: DataFrame, out: str, checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Classify the requests that arrived since the last run; schedule it every hour.

    ``responses`` is the table of external answers. Each batch writes its own folder, so a re-run
    of a batch replaces its output instead of adding to it.
    """
    def classify(batch: DataFrame, batch_id: int) -> None:
        validate_model_output(batch, responses).write.mode("overwrite").parquet(
            f"{out}/lote={batch_id}"
        )

    return _each_batch(tickets, classify, checkpoint, trigger)


def classify_with_answers(
    tickets: DataFrame, answers: DataFrame, out: str, checkpoint: str, wait: str = "2 hours",
    late: str = "10 minutes", trigger: dict | None = None,
) -> StreamingQuery:
    """Classify tickets by answers that are a stream of their own and may come later, or never.

    ``tickets`` have ``momento``, ``answers`` ``momento_respuesta``. A ticket waits for the answers
    of up to ``wait`` after its own time. Once both streams have passed that by ``late``, it is
    classified by the earliest of them (:func:`answer_order` among equally early ones), or by rules
    if there is none: an answer that comes twice counts once, and one that comes too late changes
    nothing. What waits is held by the engine and dropped with the watermark. Equal rows of a ticket
    are one; a ticket without an id is left out. Each batch writes its own folder.
    """
    asked = tickets.select(
        "ticket_id", "asunto", "descripcion", F.col("momento").cast("timestamp").alias("momento")
    ).withWatermark("momento", late)
    given = answers.select(
        F.col("ticket_id").alias("_ticket"),
        F.col("momento_respuesta").cast("timestamp").alias("momento_respuesta"),
        *ANSWER_COLUMNS,
    ).withWatermark("momento_respuesta", late)
    in_time = F.col("momento_respuesta").between(
        F.col("momento"), F.col("momento") + F.expr(f"INTERVAL {wait}")
    )
    met = asked.join(given, (F.col("ticket_id") == F.col("_ticket")) & in_time, "left_outer")
    decided = met.groupBy("ticket_id", "asunto", "descripcion", "momento").agg(
        F.min_by(F.struct("momento_respuesta", *ANSWER_COLUMNS), answer_order("momento_respuesta")).alias("_answer")
    )

    def classify(batch: DataFrame, batch_id: int) -> None:
        batch = materialize(batch.filter(F.col("ticket_id").isNotNull()))
        answered = batch.filter(F.col("_answer.momento_respuesta").isNotNull()).select("ticket_id", "_answer.*")
        validate_model_output(batch, answered).write.mode("overwrite").parquet(f"{out}/lote={batch_id}")

    return _each_batch(decided, classify, checkpoint, trigger)


def stream_clean(
    raw: DataFrame, clean_path: str, rejects_path: str, checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Clean raw tickets as they arrive: checks per row, duplicates against all that came before.

    The state is the clean table itself, the row kept so far of every id. A batch is judged once;
    its valid rows meet the kept ones of their ids by the same fold as in a batch run, which only
    ever compares with the row kept so far. A batch reads and writes only the ids that it holds, and
    leaves a change log: the rows kept from now on and, as retractions, those that they displace
    (:func:`clean_changes`). Rows must arrive in the order of ``_row``; then the last state and all
    rejects equal those of one run over everything.
    """
    def settle_batch(batch: DataFrame, batch_id: int) -> None:
        state = clean_state(batch.sparkSession, clean_path)
        checked = materialize(check_tickets(batch))
        valid = typed_tickets(checked)
        before = materialize(state.before(batch_id, valid.select("id").distinct()))
        own = materialize(mark_duplicates(valid.unionByName(before.select(*valid.columns))))
        rejects = validation_rejects(checked).unionByName(duplicate_rejects(own))
        rejects.write.mode("overwrite").parquet(f"{rejects_path}/lote={batch_id}")
        # Kept rows of this batch are the changes; a row kept before was displaced by one of them.
        arrived = own.join(before.select("_row"), "_row", "left_anti")
        kept = materialize(arrived.filter(F.col("motivo").isNull()).select(*valid.columns))
        displaced = before.join(kept.select("id"), "id", "left_semi").select(*valid.columns)
        kept.withColumn("cambio", F.lit("+")).unionByName(displaced.withColumn("cambio", F.lit("-"))).write.mode(
            "overwrite"
        ).parquet(f"{clean_path}/cambios/lote={batch_id}")
        state.write(batch_id, kept)

    return _each_batch(raw, settle_batch, checkpoint, trigger)


def clean_state(spark: SparkSession, clean_path: str) -> KeyedState:
    return KeyedState(spark, f"{clean_path}/estado", "id", CLEAN_ROWS)


def clean_so_far(spark: SparkSession, clean_path: str, last_batch: int) -> DataFrame:
    """The clean tickets after batch number ``last_batch`` of :func:`stream_clean`."""
    return clean_state(spark, clean_path).whole(last_batch + 1)


def clean_changes(spark: SparkSession, clean_path: str) -> DataFrame:
    """The change log of :func:`stream_clean`: ``lote``, ``cambio`` (+ kept, - displaced), tickets."""
    return spark.read.schema(f"{CLEAN_ROWS}, cambio string, lote int").parquet(f"{clean_path}/cambios")


def send_reminders(
    tickets: DataFrame, history: DataFrame, ledger_path: str, today: date,
    holidays: Sequence[date] = (), run: str | None = None,
) -> DataFrame:
    """Enter the due reminders of a day that the ledger does not hold yet; return that day's.

    Only that day's folder of the ledger is read, as no other can hold its entries. Every (ticket,
    type, date) is entered by one run: a second run of the day adds nothing, and of runs at the same
    time one wins each entry (:mod:`ticketlake.streaming.ledger`). Whoever sends the messages of a
    named ``run`` sends the entries whose ``intento`` it is.
    """
    due = materialize(due_reminders(last_change(tickets, history), today, holidays))
    schema = "id_ticket long, codigo string, dias_habiles long, tipo string, fecha date"
    names = ["id_ticket", "codigo", "dias_habiles", "tipo", "fecha"]
    return add_once(
        tickets.sparkSession, f"{ledger_path}/dia={today.isoformat()}", schema,
        lambda sent: not_yet_sent(due, sent).select(*names), run,
    )
