"""Dates written in three ways, read as a three-state value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ticketlake.functions.text import BOM, literal_map, strip, text_or_empty

# Month abbreviations, accepted shapes and reject motives.
MONTHS = {
    "ene": 1, "feb": 2, "mar": 3, "abr": 4, "may": 5, "jun": 6,
    "jul": 7, "ago": 8, "sep": 9, "oct": 10, "nov": 11, "dic": 12,
}
ISO_SHAPE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"
SLASH_SHAPE = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"
NAMED_SHAPE = r"^([0-9]{1,2})-([A-Za-zÁÉÍÓÚáéíóú]{3,})-([0-9]{4})$"
NO_SUCH_DATE = "fecha_inexistente"
UNKNOWN_MONTH = "mes_no_reconocido"
UNKNOWN_FORMAT = "formato_no_reconocido"


ENGLISH_MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}
SHORT_NAMED_SHAPE = r"^[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4}$"


def _as_iso(text: Column, named: str, month: Column) -> Column:
    """The written date as ``year-month-day`` text; null for an unknown shape.

    An unknown month leaves only year and day, which no calendar date matches.
    """
    slash = [F.split_part(text, F.lit("/"), F.lit(i)) for i in (3, 2, 1)]
    day, year = (F.split_part(text, F.lit("-"), F.lit(i)) for i in (1, 3))
    return (
        F.when(text.rlike(ISO_SHAPE), text)
        .when(text.rlike(SLASH_SHAPE), F.concat_ws("-", *slash))
        .when(text.rlike(named), F.concat_ws("-", year, month.cast("string"), day))
    )


def _month(text: Column, months: dict[str, int], letters: int | None) -> Column:
    table = literal_map(months)
    name = F.lower(F.split_part(text, F.lit("-"), F.lit(2)))
    return F.element_at(table, F.substring(name, 1, letters) if letters else name)


def _real(iso: Column) -> Column:
    """The calendar date, or null when the day does not exist or the year is zero.

    A cast reads these shapes several times faster than a pattern does, but it also reads a year and a
    month without a day, which is what an unknown month leaves.
    """
    whole = ~iso.startswith("0000") & (F.split_part(iso, F.lit("-"), F.lit(3)) != "")
    return F.when(whole, iso.try_cast("date"))


def standardize_dates(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds ``struct<valor date, motivo string>`` columns: a date, nothing (both null) or a motive.

    ``columns`` maps each new column to the text column it reads. Accepts ``2025-3-8``,
    ``8/3/2025`` and ``8-Mar-2025`` with Spanish months, of which the first three letters count, in
    any case. A blank is not a reject.
    """
    texts = {
        f"_t_{new}": strip(F.replace(text_or_empty(F.col(old)), F.lit(BOM), F.lit("")))
        for new, old in columns.items()
    }
    isos = {
        f"_i_{new}": _as_iso(
            F.col(f"_t_{new}"), NAMED_SHAPE, _month(F.col(f"_t_{new}"), MONTHS, 3)
        )
        for new in columns
    }
    values = {f"_d_{new}": _real(F.col(f"_i_{new}")) for new in columns}

    def state(new: str) -> Column:
        text, iso, value = (F.col(f"_{kind}_{new}") for kind in "tid")
        motive = (
            F.when((text == "") | value.isNotNull(), None)
            .when(iso.isNull(), F.lit(UNKNOWN_FORMAT))
            .when(iso.rlike(ISO_SHAPE), F.lit(NO_SUCH_DATE))
            .otherwise(F.lit(UNKNOWN_MONTH))
        )
        return F.struct(value.alias("valor"), motive.alias("motivo"))

    return (
        df.withColumns(texts)
        .withColumns(isos)
        .withColumns(values)
        .withColumns({new: state(new) for new in columns})
        .drop(*texts, *isos, *values)
    )


def report_dates(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds dates as the monthly report reads them: null when unreadable.

    Unlike :func:`standardize_dates` the month must be exactly three letters, Spanish or English.
    """
    months = {**ENGLISH_MONTHS, **MONTHS}
    texts = {f"_t_{new}": strip(text_or_empty(F.col(old))) for new, old in columns.items()}
    isos = {
        f"_i_{new}": _as_iso(
            F.col(f"_t_{new}"), SHORT_NAMED_SHAPE, _month(F.col(f"_t_{new}"), months, None)
        )
        for new in columns
    }
    return (
        df.withColumns(texts)
        .withColumns(isos)
        .withColumns({new: _real(F.col(f"_i_{new}")) for new in columns})
        .drop(*texts, *isos)
    )


def month_bounds(year: Column | int, month: Column | int) -> tuple[Column, Column]:
    """First and last day of a month, given as numbers or columns."""
    year, month = (x if isinstance(x, Column) else F.lit(x) for x in (year, month))
    first = F.make_date(year, month, F.lit(1))
    return first, F.last_day(first)
