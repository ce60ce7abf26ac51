"""Ageing in business days and reminders that are never sent twice."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from ticketlake.operators.skew import settled, small_dimension
from ticketlake.session import materialize

# Business days before a reminder and before an escalation.
REMINDER_DAYS = 3
ESCALATION_DAYS = 5
REMINDER, ESCALATION = "recordatorio", "escalamiento"
LEDGER_KEY = ["id_ticket", "tipo", "fecha"]


def _weekdays_until(day: Column) -> Column:
    """Weekdays from a fixed Monday up to and including ``day``."""
    days = F.date_diff(day, F.lit(date(1900, 1, 1)))
    week = F.floor(days / F.lit(7))
    return week * 5 + F.least(days - week * 7 + 1, F.lit(5))


def business_days(start: Column, end: Column, holidays: Sequence[date] = ()) -> Column:
    """Business days after ``start`` up to and including ``end``.

    Closed-form weekday arithmetic minus the weekday holidays in between: row-local, no calendar
    join.
    """
    days = _weekdays_until(end) - _weekdays_until(start)
    weekday_holidays = [h for h in holidays if h.weekday() < 5]
    if weekday_holidays:
        dates = F.array(*[F.lit(h) for h in weekday_holidays])
        days = days - F.size(F.filter(dates, lambda h: (h > start) & (h <= end)))
    return days.cast("bigint")


def site_calendars(holidays: DataFrame) -> DataFrame:
    """A row per site with its calendar, from ``(sede, dia)`` in any order, repeated or not.

    ``calendario`` lists the holidays that fall on weekdays with the cumulative business-day index on
    each of them; between two of them the index grows by weekdays. It grows with the calendar only.
    Rows without a site or a day are left out.
    """
    known = holidays.filter(F.col("sede").isNotNull() & (F.weekday("dia") < 5))
    by_site = known.groupBy("sede").agg(F.array_sort(F.collect_set("dia")).alias("_dias"))
    indexed = F.transform(
        "_dias",
        lambda day, i: F.struct(day.alias("dia"), (_weekdays_until(day) - i - 1).cast("bigint").alias("indice")),
    )
    return by_site.select("sede", indexed.alias("calendario"))


def business_index(day: Column, calendar: Column) -> Column:
    """Cumulative business-day index of ``day``, read as of the last holiday up to it.

    Without a calendar, or before its first holiday, every weekday counts.
    """
    passed = F.filter(calendar, lambda holiday: holiday["dia"] <= day)
    last = F.try_element_at(passed, F.lit(-1))
    since = _weekdays_until(day) - _weekdays_until(last["dia"])
    return F.coalesce(last["indice"] + since, _weekdays_until(day)).cast("bigint")


def due_by_site(tickets: DataFrame, holidays: DataFrame, today: date) -> DataFrame:
    """:func:`due_reminders` where each ticket ages by the calendar of its ``sede``.

    A site without holidays, and a ticket without a site, age by weekdays. A calendar is read once for
    each day on which a ticket of its site changed, and once for today, not once per ticket; what
    tickets meet are these days with their indexes, broadcast once they are counted.
    """
    calendars = materialize(site_calendars(holidays))
    asked = tickets.select("sede", "ultimo_cambio").filter("sede is not null and ultimo_cambio is not null")
    days = asked.distinct().join(small_dimension(calendars), "sede")
    indexed = materialize(
        days.select(
            "sede",
            "ultimo_cambio",
            business_index(F.col("ultimo_cambio"), F.col("calendario")).alias("_indice"),
            business_index(F.lit(today), F.col("calendario")).alias("_hoy"),
        )
    )
    placed = tickets.join(small_dimension(indexed), ["sede", "ultimo_cambio"], "left")
    age = F.coalesce("_hoy", _weekdays_until(F.lit(today))) - F.coalesce(
        "_indice", _weekdays_until(F.col("ultimo_cambio"))
    )
    return _due(settled(placed, {"dias_habiles": age.cast("bigint")}), today, "sede")


def due_reminders(tickets: DataFrame, today: date, holidays: Sequence[date] = ()) -> DataFrame:
    """Open tickets without a change for three business days, escalated from the fifth on.

    ``tickets``: id_ticket, codigo, ultimo_cambio of open tickets.
    """
    days = business_days(F.col("ultimo_cambio"), F.lit(today), holidays)
    return _due(tickets.withColumn("dias_habiles", days), today)


def _due(aged: DataFrame, today: date, *keep: str) -> DataFrame:
    return aged.filter(F.col("dias_habiles") >= REMINDER_DAYS).select(
        *keep,
        "id_ticket",
        "codigo",
        "dias_habiles",
        F.when(F.col("dias_habiles") >= ESCALATION_DAYS, ESCALATION)
        .otherwise(REMINDER)
        .alias("tipo"),
        F.lit(today).alias("fecha"),
    )


def not_yet_sent(due: DataFrame, ledger: DataFrame) -> DataFrame:
    """Due reminders whose (ticket, type, date) is not in the ledger, each once."""
    return due.dropDuplicates(LEDGER_KEY).join(ledger.select(*LEDGER_KEY), LEDGER_KEY, "left_anti")


def last_change(tickets: DataFrame, history: DataFrame, *keep: str) -> DataFrame:
    """Open tickets with the date of their last state change, or of creation without one."""
    changes = history.groupBy("id_ticket").agg(F.max("fecha_cambio").alias("_cambio"))
    return (
        tickets.filter(F.col("estado") != "Cerrado")
        .join(changes, "id_ticket", "left")
        .select(
            "id_ticket",
            "codigo",
            *keep,
            F.coalesce(F.to_date("_cambio"), F.col("fecha_creacion")).alias("ultimo_cambio"),
        )
    )
