"""Relational reports over tickets, areas, users and state history, and the monthly report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ticketlake.functions.catalogs import OPEN_STATES, priority_rank
from ticketlake.functions.dates import month_bounds, report_dates
from ticketlake.functions.ratios import percent
from ticketlake.functions.text import strip, text_or_empty
from ticketlake.operators.skew import settled, small_dimension

CLOSED = "Cerrado"
REOPENED = "Reabierto"
NO_AREA = "Sin area"


def tickets_by_area(tickets: DataFrame, areas: DataFrame) -> DataFrame:
    """Volume, open/closed split and reopen percentage per area and site.

    Tickets are reduced to one row per area before they meet the dimension.
    """
    per_area = tickets.groupBy("id_area").agg(
        F.count("*").alias("total_tickets"),
        F.count_if(F.col("estado") == CLOSED).alias("cerrados"),
        F.count_if(F.col("estado") != CLOSED).alias("abiertos"),
        F.count_if(F.col("reaperturas") > 0).alias("con_reapertura"),
    )
    return (
        per_area.join(areas, "id_area")
        .select(
            F.col("nombre").alias("area"),
            "sede",
            "total_tickets",
            "cerrados",
            "abiertos",
            "con_reapertura",
            percent(F.col("con_reapertura"), F.col("total_tickets")).alias("tasa_reapertura_pct"),
        )
        .orderBy(F.desc("total_tickets"), "area")
    )


def ticket_detail(
    tickets: DataFrame, users: DataFrame, areas: DataFrame, id_area: int | None = None
) -> DataFrame:
    """Open tickets with requester and both areas: the one that serves and the requester's own.

    ``id_area`` is a bound value, not text spliced into a query; the filter reaches the scan. The
    areas are broadcast once their rows are counted; a requester with a large share of all tickets
    is left to the engine's skew handling, as their tickets join one row.
    """
    areas = small_dimension(areas)
    open_tickets = tickets.filter(F.col("estado") != CLOSED)
    if id_area is not None:
        open_tickets = open_tickets.filter(F.col("id_area") == F.lit(id_area))
    serving = areas.select("id_area", F.col("nombre").alias("area_que_atiende"))
    asking = areas.select(
        F.col("id_area").alias("area_usuario"), F.col("nombre").alias("area_del_solicitante")
    )
    requesters = users.select(
        "id_usuario",
        F.col("nombre").alias("solicitante"),
        F.col("correo").alias("correo_solicitante"),
        F.col("id_area").alias("area_usuario"),
    ).join(asking, "area_usuario")
    with_requester = open_tickets.join(serving, "id_area").join(requesters, "id_usuario")
    return (
        with_requester.select(
            F.col("codigo").alias("ticket"),
            "estado",
            "prioridad",
            "categoria",
            F.col("fecha_creacion").alias("creado"),
            "solicitante",
            "correo_solicitante",
            "area_que_atiende",
            "area_del_solicitante",
            F.when(F.col("area_usuario") != F.col("id_area"), "SI")
            .otherwise("NO")
            .alias("solicitante_de_otra_area"),
        )
        .orderBy(F.desc("creado"), "ticket")
    )


def reopen_discrepancy(tickets: DataFrame, areas: DataFrame, history: DataFrame) -> DataFrame:
    """Reopen counter against reopen events, per ticket with either.

    History is reduced to one row per ticket first, so a ticket with a huge history costs its
    partial sums only; the left join keeps tickets that have a counter and no event.
    """
    events = (
        history.filter(F.col("estado_nuevo") == REOPENED)
        .groupBy("id_ticket")
        .agg(
            F.count("id_historial").alias("eventos"),
            F.max("fecha_cambio").alias("ultima_reapertura"),
        )
    )
    n_events = F.coalesce("eventos", F.lit(0).cast("bigint"))
    return (
        tickets.join(events, "id_ticket", "left")
        .filter((F.col("reaperturas") > 0) | (n_events > 0))
        .join(small_dimension(areas), "id_area")
        .select(
            F.col("codigo").alias("ticket"),
            F.col("nombre").alias("area"),
            F.col("estado").alias("estado_actual"),
            F.col("reaperturas").alias("contador_reaperturas"),
            n_events.alias("eventos_de_reapertura"),
            F.when(F.col("reaperturas") != n_events, "DISCREPA")
            .otherwise("OK")
            .alias("concordancia"),
            "ultima_reapertura",
        )
        .orderBy(F.desc("contador_reaperturas"), F.desc("eventos_de_reapertura"), "ticket")
    )


def summarize(tickets: DataFrame) -> DataFrame:
    """Per area (by volume) and per priority (in business order), in one table.

    The finest grouping is computed once and both blocks are rolled up from it, so the tickets
    are read a single time.
    """
    is_open = F.col("estado").isin(*OPEN_STATES)
    cells = tickets.groupBy("area", "prioridad").agg(
        F.count("*").alias("total"),
        F.count_if(is_open).alias("abiertos"),
        F.count_if(F.col("reaperturas") > 0).alias("reaperturas"),
    )
    blocks = cells.select(
        F.explode(
            F.create_map(F.lit("area"), F.col("area"), F.lit("prioridad"), F.col("prioridad"))
        ).alias("agrupacion", "nombre"),
        "total",
        "abiertos",
        "reaperturas",
    )
    sums = blocks.groupBy("agrupacion", "nombre").agg(
        *[F.sum(name).alias(name) for name in ("total", "abiertos", "reaperturas")]
    )
    position = F.when(F.col("agrupacion") == "area", -F.col("total")).otherwise(
        priority_rank(F.col("nombre")).cast("bigint")
    )
    return sums.select(
        "agrupacion",
        "nombre",
        "total",
        "abiertos",
        (F.col("total") - F.col("abiertos")).alias("cerrados"),
        "reaperturas",
        percent(F.col("reaperturas"), F.col("total")).alias("tasa_reapertura_pct"),
    ).orderBy("agrupacion", position, "nombre")


def area_priority_counts(tickets: DataFrame) -> DataFrame:
    """Tickets per area and priority."""
    return tickets.groupBy("area", "prioridad").agg(F.count("*").alias("total"))


def priority_volume(tickets: DataFrame) -> DataFrame:
    """Tickets per priority in business order, with the position used for sorting."""
    return (
        tickets.groupBy(F.col("prioridad").alias("nombre"))
        .agg(F.count("*").alias("total"))
        .withColumn("posicion", priority_rank(F.col("nombre")))
        .orderBy("posicion", "nombre")
    )


def filter_period(tickets: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows whose written creation date falls in the closed interval; unreadable dates do not."""
    dated = report_dates(tickets, {"_creado": "fecha_creacion"})
    inside = settled(dated, {"_dentro": F.col("_creado").between(start, end)})
    return inside.filter("_dentro").drop("_dentro", "_creado")


def _report_area() -> Column:
    named = F.col("area").isNotNull() & (F.col("area") != "")
    return F.when(named, strip(F.col("area"))).otherwise(F.lit(NO_AREA))


def count_by_area(tickets: DataFrame) -> DataFrame:
    """Rows per area as written, trimmed; null and empty areas count as one group."""
    return tickets.groupBy(_report_area().alias("area")).agg(F.count("*").alias("total"))


def is_reopened(col: Column) -> Column:
    """Whether a state as written means reopened, whatever its case and outer blanks."""
    return F.lower(strip(text_or_empty(col))) == "reabierto"


def reopened_now(tickets: DataFrame) -> DataFrame:
    """Rows currently in the reopened state and their percentage (0.0 without rows)."""
    return tickets.agg(
        F.count("*").alias("total"), F.count_if(is_reopened(F.col("estado"))).alias("reabiertos")
    ).withColumn("tasa_reapertura", percent(F.col("reabiertos"), F.col("total")))


def monthly_report(tickets: DataFrame, year: int, month: int) -> DataFrame:
    """Tidy report of a month: a ``total`` row with the reopen percentage, a row per area."""
    return period_report(filter_period(tickets, *month_bounds(year, month)), f"{year}-{month:02d}")


def period_report(tickets: DataFrame, name: str) -> DataFrame:
    """The report of :func:`monthly_report` over tickets that are all of one period.

    One pass over the tickets; the total row is summed from the per-area rows.
    """
    per_area = (
        tickets.groupBy(_report_area().alias("nombre"))
        .agg(F.count("*").alias("total"), F.count_if(is_reopened(F.col("estado"))).alias("n"))
    )
    zero = F.lit(0).cast("bigint")
    whole = per_area.agg(
        F.coalesce(F.sum("total"), zero).alias("total"), F.coalesce(F.sum("n"), zero).alias("n")
    )
    period = F.lit(name).alias("periodo")
    return whole.select(
        period,
        F.lit("total").alias("seccion"),
        F.lit(None).cast("string").alias("nombre"),
        "total",
        percent(F.col("n"), F.col("total")).alias("tasa_reapertura"),
    ).unionByName(
        per_area.select(
            period,
            F.lit("area").alias("seccion"),
            "nombre",
            "total",
            F.lit(None).cast("double").alias("tasa_reapertura"),
        )
    )


def attention_days(tickets: DataFrame) -> DataFrame:
    """Rows with ``dias_atencion``: days from creation to close, null when either is unreadable."""
    dated = report_dates(tickets, {"_creado": "fecha_creacion", "_cerrado": "fecha_cierre"})
    return dated.withColumn("dias_atencion", F.date_diff("_cerrado", "_creado")).drop(
        "_creado", "_cerrado"
    )


def average_attention(tickets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sample size, total days and average per group; the average is null without a sample."""
    return (
        attention_days(tickets)
        .groupBy(*by)
        .agg(
            F.count("dias_atencion").alias("muestras"),
            F.sum("dias_atencion").alias("dias"),
            F.round(F.avg("dias_atencion"), 4).alias("promedio_dias"),
        )
    )
