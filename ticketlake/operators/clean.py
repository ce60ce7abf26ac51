"""Cleaning of a hand-written ticket history: typed values, quarantine, duplicates, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ticketlake.functions.catalogs import (
    DEFAULT_AREA,
    DEFAULT_CATEGORY,
    DEFAULT_CHANNEL,
    DEFAULT_PRIORITY,
    standardize_catalogs,
)
from ticketlake.functions.dates import standardize_dates
from ticketlake.functions.text import collapse, strip, text_or_empty
from ticketlake.operators.skew import HOT_ROWS, hot_keys, salted_join, settled
from ticketlake.schemas import TICKET_COLUMNS
from ticketlake.session import materialize

# Quarantine motives and the gate threshold in percent.
MISSING_ID = "id_ausente"
MISSING_CREATION = "fecha_creacion_ausente"
BAD_CREATION = "fecha_creacion_invalida"
BAD_CLOSE = "fecha_cierre_invalida"
CLOSE_BEFORE_CREATION = "cierre_anterior_a_creacion"
MISSING_STATE = "estado_ausente"
BAD_STATE = "estado_fuera_de_catalogo"
BAD_PRIORITY = "prioridad_fuera_de_catalogo"
BAD_CHANNEL = "canal_fuera_de_catalogo"
BAD_CATEGORY = "categoria_fuera_de_catalogo"
BAD_REOPENS = "reaperturas_no_numericas"
EXACT_DUPLICATE = "duplicado_exacto"
CONFLICTING_DUPLICATE = "duplicado_con_contenido_en_conflicto"
MAX_QUARANTINE_PCT = 10.0
# Details of rejects and names of the report's lines.
NO_ID_DETAIL = "la fila no trae identificador de ticket"
NO_CREATION_DETAIL = "sin fecha de creación"
NO_STATE_DETAIL = "sin estado"
CLOSE_DETAIL = ("cierre ", " anterior a creación ")
EXACT_DETAIL = ("repite exactamente al ticket ", " ya procesado")
CONFLICT_DETAIL = (
    "mismo id ",
    " con contenido distinto; se conservó la captura más completa y esta se aparta para revisión",
)
APPLIED_DEFAULTS = {
    "area": "area → Sin área",
    "categoria": "categoria → Sin clasificar",
    "prioridad": "prioridad ausente",
    "canal": "canal ausente",
}
VALIDATION_MOTIVES = (
    MISSING_ID, MISSING_CREATION, BAD_CREATION, BAD_CLOSE, CLOSE_BEFORE_CREATION, MISSING_STATE,
    BAD_STATE, BAD_PRIORITY, BAD_CHANNEL, BAD_CATEGORY, BAD_REOPENS,
)
CATALOG_MOTIVES = (BAD_STATE, BAD_PRIORITY, BAD_CHANNEL, BAD_CATEGORY, "valor_fuera_de_catalogo")

#: Clean tickets with their row numbers, as a table schema.
CLEAN_ROWS = "_row long, " + ", ".join(
    f"{name} {({'fecha_creacion': 'date', 'fecha_cierre': 'date', 'reaperturas': 'long'}).get(name, 'string')}"
    for name in TICKET_COLUMNS
)
CONTENT = tuple(name for name in TICKET_COLUMNS if name != "id")
QUARANTINE_COLUMNS = (
    "numero_de_fila", "motivo", "detalle", "fila_original", "numero_fila_descartada",
)


@dataclass(frozen=True)
class Cleaning:
    """Outcome of a cleaning run: frames over judged rows that are already written."""

    clean: DataFrame
    duplicates: DataFrame
    quarantine: DataFrame
    report: DataFrame


def standardize_reopens(col: Column) -> Column:
    """Reopen count: blank is zero, anything but a non-negative integer is null (a reject)."""
    text = strip(text_or_empty(col))
    number = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))
    return F.when(text == "", F.lit(0).cast("bigint")).when(number >= 0, number)


def apply_defaults(df: DataFrame) -> DataFrame:
    """Fill absent labels and tidy free text.

    Expects ``area``, ``solicitante``, ``asunto`` and ``descripcion`` as written and the catalog
    columns already looked up (null = absent).
    """
    area = strip(text_or_empty(F.col("area")))
    return df.withColumns(
        {
            "area": F.when(area == "", F.lit(DEFAULT_AREA)).otherwise(area),
            "categoria": F.coalesce("categoria", F.lit(DEFAULT_CATEGORY)),
            "prioridad": F.coalesce("prioridad", F.lit(DEFAULT_PRIORITY)),
            "canal": F.coalesce("canal", F.lit(DEFAULT_CHANNEL)),
            "solicitante": strip(text_or_empty(F.col("solicitante"))),
            "asunto": collapse(F.col("asunto")),
            "descripcion": collapse(F.col("descripcion")),
        }
    )


def _quoted(name: str) -> Column:
    return F.coalesce(F.concat(F.lit("'"), F.col(name), F.lit("'")), F.lit("None"))


def _as_map(names: tuple[str, ...]) -> Column:
    pairs = [x for name in names for x in (F.lit(name), text_or_empty(F.col(name)))]
    return F.create_map(*pairs)


def _first_failure() -> tuple[Column, Column]:
    """Motive and detail of the first failed check, in the fixed order of the checks."""
    creation, closing = F.col("_creacion"), F.col("_cierre")
    created, closed = creation["valor"], closing["valor"]
    state = F.col("_estado")
    checks = [
        (F.col("_id") == "", MISSING_ID, F.lit(NO_ID_DETAIL)),
        (
            created.isNull() & creation["motivo"].isNull(),
            MISSING_CREATION,
            F.lit(NO_CREATION_DETAIL),
        ),
        (creation["motivo"].isNotNull(), BAD_CREATION, creation["motivo"]),
        (closing["motivo"].isNotNull(), BAD_CLOSE, closing["motivo"]),
        (
            closed < created,
            CLOSE_BEFORE_CREATION,
            F.concat(
                F.lit(CLOSE_DETAIL[0]), closed.cast("string"),
                F.lit(CLOSE_DETAIL[1]), created.cast("string"),
            ),
        ),
        (state["valor"].isNull() & state["motivo"].isNull(), MISSING_STATE, F.lit(NO_STATE_DETAIL)),
        (state["motivo"].isNotNull(), BAD_STATE, _quoted("estado")),
        (F.col("_prioridad")["motivo"].isNotNull(), BAD_PRIORITY, _quoted("prioridad")),
        (F.col("_canal")["motivo"].isNotNull(), BAD_CHANNEL, _quoted("canal")),
        (F.col("_categoria")["motivo"].isNotNull(), BAD_CATEGORY, _quoted("categoria")),
        (F.col("_reaperturas").isNull(), BAD_REOPENS, _quoted("reaperturas")),
    ]
    motive, detail = F.lit(None).cast("string"), F.lit(None).cast("string")
    for failed, name, text in reversed(checks):
        motive = F.when(failed, F.lit(name)).otherwise(motive)
        detail = F.when(failed, text).otherwise(detail)
    return motive, detail


def check_tickets(raw: DataFrame) -> DataFrame:
    """Every raw row judged once, without a shuffle.

    Columns: ``_row``; ``motivo`` and ``detalle`` of the first failed check (null when valid);
    ``fila_original`` of a failed row; the typed ticket columns of a valid one; and
    ``por_defecto``, the default labels applied to a valid one.
    """
    read = standardize_dates(raw, {"_creacion": "fecha_creacion", "_cierre": "fecha_cierre"})
    read = standardize_catalogs(
        read, {f"_{name}": name for name in ("estado", "prioridad", "canal", "categoria")}
    ).withColumns(
        {
            "_id": strip(text_or_empty(F.col("id"))),
            "_reaperturas": standardize_reopens(F.col("reaperturas")),
        }
    )
    motive, detail = _first_failure()
    judged = settled(read, {"motivo": motive, "detalle": detail})
    valid = F.col("motivo").isNull()
    kept = judged.select(
        "_row",
        "motivo",
        "detalle",
        F.when(~valid, _as_map(TICKET_COLUMNS)).alias("fila_original"),
        F.col("_id").alias("id"),
        F.col("_creacion")["valor"].alias("fecha_creacion"),
        F.col("_cierre")["valor"].alias("fecha_cierre"),
        "area",
        *[F.col(f"_{name}")["valor"].alias(name) for name in ("categoria", "prioridad", "canal")],
        "solicitante",
        "asunto",
        "descripcion",
        F.col("_estado")["valor"].alias("estado"),
        F.col("_reaperturas").alias("reaperturas"),
    )
    blank = {
        "area": strip(text_or_empty(F.col("area"))) == "",
        **{name: F.col(name).isNull() for name in ("categoria", "prioridad", "canal")},
    }
    applied = F.array(
        *[F.when(valid & blank[name], F.lit(label)) for name, label in APPLIED_DEFAULTS.items()]
    )
    return apply_defaults(kept.withColumn("por_defecto", F.array_compact(applied)))


def typed_tickets(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("motivo").isNull()).select("_row", *TICKET_COLUMNS)


def validation_rejects(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("motivo").isNotNull()).select(
        F.col("_row").alias("numero_de_fila"),
        "motivo",
        "detalle",
        "fila_original",
        F.col("_row").alias("numero_fila_descartada"),
    )


def validate_tickets(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split raw rows into valid typed tickets (with ``_row``) and quarantine records."""
    checked = check_tickets(raw)
    return typed_tickets(checked), validation_rejects(checked)


def _completeness() -> Column:
    """How many of six descriptive fields carry data."""
    present = [
        F.col("fecha_cierre").isNotNull(),
        *[F.col(name) != "" for name in ("solicitante", "asunto", "descripcion")],
        F.col("area") != DEFAULT_AREA,
        F.col("categoria") != DEFAULT_CATEGORY,
    ]
    score = F.lit(0)
    for flag in present:
        score = score + flag.cast("int")
    return score


def mark_duplicates(valid: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Valid tickets plus ``motivo`` (null = survives) and ``numero_de_fila`` of the record.

    ``_row`` must be unique; it orders the rows. Per id, in row order, a row is compared with the
    one kept so far: same content makes it an exact duplicate; otherwise the more complete of the
    two stays (a tie keeps the earlier) and the loser is a conflict, filed under the number of the
    later row. Content is compared by two independent 64-bit hashes, so two different captures of
    one id pass for the same with a probability of about 2**-128 per pair.

    The row kept so far is always the first row of the highest completeness level seen, and there
    are seven levels. So one partial-aggregated pass finds the first row of every (id, level), a
    ladder of at most seven entries per id, and each row settles its fate against its own ladder.
    No task ever holds all rows of an id, and only ids with duplicates get a ladder. What meets by
    id are row numbers, levels and hashes; the tickets themselves only meet their verdicts, by
    row number, which no skew can touch. Ladders are read three times, so they are written once,
    right away.
    """
    scored = valid.select(
        "_row",
        "id",
        _completeness().alias("_score"),
        F.xxhash64(*[text_or_empty(F.col(name)) for name in CONTENT]).alias("_h1"),
        F.xxhash64(
            F.lit("content"), *[text_or_empty(F.col(name)) for name in reversed(CONTENT)]
        ).alias("_h2"),
    )
    levels = scored.groupBy("id", "_score").agg(
        F.min("_row").alias("_first"),
        F.min_by("_h1", "_row").alias("_h1"),
        F.min_by("_h2", "_row").alias("_h2"),
        F.count("*").alias("_n"),
    )
    ladders = materialize(
        levels.groupBy("id")
        .agg(
            F.collect_list(F.struct("_score", "_first", "_h1", "_h2")).alias("_ladder"),
            F.sum("_n").alias("_n"),
        )
        .filter(F.col("_n") > 1)
    )
    hot = hot_keys(ladders, "id", "_n", hot_rows)
    joined = salted_join(scored, ladders.drop("_n"), "id", hot, ["_row"])

    earlier = F.filter("_ladder", lambda rung: rung["_first"] < F.col("_row"))
    best = F.array_max(
        F.transform(
            earlier,
            lambda rung: F.struct(
                rung["_score"].alias("score"), rung["_h1"].alias("h1"), rung["_h2"].alias("h2")
            ),
        )
    )
    later = F.filter("_ladder", lambda rung: rung["_score"] > F.col("_score"))
    displaced_by = F.array_min(F.transform(later, lambda rung: rung["_first"]))
    kept = settled(joined, {"_kept": best, "_next": displaced_by})
    never_kept = F.coalesce(F.col("_kept")["score"] >= F.col("_score"), F.lit(False))
    same = (F.col("_kept")["h1"] == F.col("_h1")) & (F.col("_kept")["h2"] == F.col("_h2"))
    motive = F.when(never_kept & same, F.lit(EXACT_DUPLICATE)).when(
        never_kept | F.col("_next").isNotNull(), F.lit(CONFLICTING_DUPLICATE)
    )
    verdicts = kept.select(
        "_row",
        motive.alias("motivo"),
        F.when(never_kept, F.col("_row")).otherwise(F.col("_next")).alias("numero_de_fila"),
    ).filter(F.col("motivo").isNotNull())
    return valid.join(verdicts, "_row", "left")


def require_unique_rows(df: DataFrame) -> None:
    """Raises if two rows share a ``_row``: the order of captures would not be defined."""
    repeated = df.groupBy("_row").count().filter("count > 1").select("_row").head()
    if repeated is not None:
        raise ValueError(f"row number {repeated['_row']} occurs more than once")


def duplicate_rejects(marked: DataFrame) -> DataFrame:
    exact, conflict = (
        F.concat(F.lit(before), F.col("id"), F.lit(after))
        for before, after in (EXACT_DETAIL, CONFLICT_DETAIL)
    )
    return marked.filter(F.col("motivo").isNotNull()).select(
        "numero_de_fila",
        "motivo",
        F.when(F.col("motivo") == EXACT_DUPLICATE, exact).otherwise(conflict).alias("detalle"),
        _as_map(TICKET_COLUMNS).alias("fila_original"),
        F.col("_row").alias("numero_fila_descartada"),
    )


def deduplicate(valid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One ticket per id, and the quarantine records of the others."""
    marked = mark_duplicates(valid)
    clean = marked.filter(F.col("motivo").isNull()).select("_row", *TICKET_COLUMNS)
    return clean, duplicate_rejects(marked)


def clean_history(raw: DataFrame) -> Cleaning:
    """Typed, validated and deduplicated tickets with quarantine and quality report.

    The judged rows are written once: the duplicate ladder, the surviving tickets and the quarantine
    read that table instead of parsing the raw text again. The pass that writes it also counts what
    the report says about single rows. It runs right away, and so does the check that ``_row`` is
    unique.
    """
    seen = Observation()
    checked = materialize(check_tickets(raw).observe(seen, *row_counters()))
    require_unique_rows(checked)
    clean, duplicates = deduplicate(typed_tickets(checked))
    quarantine = validation_rejects(checked).unionByName(duplicates)
    return Cleaning(clean, duplicates, quarantine, counted_report(seen.get, duplicates))


def row_counters() -> list[Column]:
    """What :func:`check_tickets` finds out row by row, as aggregates to observe in the pass that
    writes its rows: rows read, rejects by motive, defaults by name (over valid rows)."""
    return [
        F.count(F.lit(1)).alias("leidos"),
        *[F.count_if(F.col("motivo") == name).alias(name) for name in VALIDATION_MOTIVES],
        *[F.count_if(F.array_contains("por_defecto", name)).alias(name) for name in APPLIED_DEFAULTS.values()],
    ]


def counted_report(counted: dict[str, int], duplicates: DataFrame) -> DataFrame:
    """:func:`quality_report` from the values of :func:`row_counters`: only the duplicates, which no
    single row shows, are read again."""
    spark = duplicates.sparkSession
    repeats = duplicates.groupBy(F.col("motivo").alias("nombre")).agg(F.count("*").alias("n"))
    read, rejected = counted["leidos"], sum(counted[name] for name in VALIDATION_MOTIVES)
    dropped = repeats.agg(F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("_dropped"))
    totals = dropped.select(
        F.explode(
            F.create_map(
                F.lit("leidos"), F.lit(read).cast("bigint"),
                F.lit("limpios"), F.lit(read - rejected).cast("bigint") - F.col("_dropped"),
                F.lit("en_cuarentena"), F.lit(rejected).cast("bigint") + F.col("_dropped"),
            )
        ).alias("nombre", "n")
    )
    sections = {"motivos": VALIDATION_MOTIVES, "valores_por_defecto": APPLIED_DEFAULTS.values()}
    found = [(section, name, counted[name]) for section, names in sections.items() for name in names if counted[name]]
    return (
        totals.select(F.lit("totales").alias("seccion"), "nombre", "n")
        .unionByName(repeats.select(F.lit("motivos").alias("seccion"), "nombre", "n"))
        .unionByName(spark.createDataFrame(found, "seccion string, nombre string, n long"))
    )


def default_counters(checked: DataFrame) -> DataFrame:
    """How often a default label was applied, counted over valid rows before deduplication."""
    return (
        checked.select(F.explode("por_defecto").alias("nombre"))
        .groupBy("nombre")
        .agg(F.count("*").alias("n"))
    )


def quality_report(checked: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Tidy report ``(seccion, nombre, n)``: rows read, clean and quarantined, motives, defaults.

    For judged rows that were written without :func:`row_counters`; it reads them for each block.
    Read equals clean plus quarantined by construction: every row ends in exactly one of them.
    """
    motives = quarantine.groupBy(F.col("motivo").alias("nombre")).agg(F.count("*").alias("n"))
    read = checked.agg(F.count("*").alias("leidos"))
    dropped = motives.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
    totals = read.select(
        F.explode(
            F.create_map(
                F.lit("leidos"), F.col("leidos"),
                F.lit("limpios"), F.col("leidos") - dropped,
                F.lit("en_cuarentena"), dropped,
            )
        ).alias("nombre", "n")
    )
    return (
        totals.select(F.lit("totales").alias("seccion"), "nombre", "n")
        .unionByName(motives.select(F.lit("motivos").alias("seccion"), "nombre", "n"))
        .unionByName(
            default_counters(checked).select(
                F.lit("valores_por_defecto").alias("seccion"), "nombre", "n"
            )
        )
    )


def quality_gate(report: DataFrame, threshold: float = MAX_QUARANTINE_PCT) -> DataFrame:
    """One row: share of quarantined rows, and whether it stays within the threshold.

    ``codigo`` is 0 when it passes and 2 when it does not; an empty input passes.
    """
    def total(name: str) -> Column:
        chosen = (F.col("seccion") == "totales") & (F.col("nombre") == name)
        return F.coalesce(F.sum(F.when(chosen, F.col("n"))), F.lit(0))

    sums = report.agg(total("leidos").alias("leidos"), total("en_cuarentena").alias("apartados"))
    share = F.coalesce(
        F.col("apartados") * 100.0 / F.nullif("leidos", F.lit(0).cast("bigint")), F.lit(0.0)
    )
    return sums.select(
        "leidos",
        F.col("apartados").alias("en_cuarentena"),
        F.round(share, 4).alias("porcentaje"),
        (share <= threshold).alias("aprueba"),
        F.when(share <= threshold, F.lit(0)).otherwise(F.lit(2)).alias("codigo"),
    )


def second_pass_eligible(quarantine: DataFrame) -> DataFrame:
    """Quarantine records a second, probabilistic pass may look at: out-of-catalog values only."""
    return quarantine.filter(F.col("motivo").isin(*CATALOG_MOTIVES))
