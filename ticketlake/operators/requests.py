"""Requests: intake validation, listing, lookup, state change, numbering, review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ticketlake.functions.catalogs import canonical, canonical_column
from ticketlake.functions.text import strip, text_or_empty
from ticketlake.operators.skew import settled

# Lengths, defaults, paging limits and the request code format.
MAX_TITLE = 200
MAX_BODY = 5000
INITIAL_STATE = "Abierto"
DEFAULT_CHANNEL = "Formulario"
PAGE_SIZE = 50
MAX_PAGE_SIZE = 200
FILTER_FIELDS = ("area", "estado", "categoria", "prioridad")
CODE_PREFIX = "SOL"
CODE_WIDTH = 6
NUMBERING_BLOCK = 1_000_000
GROUPED_BLOCKS = 10_000


class UnknownFilterValue(ValueError):
    """A filter names a value that is in no catalog: an error, not an empty page."""


def validate_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a batch into accepted requests and rejects with the first failing ``campo``.

    Checked in order: title (required, 200), body (5000), area (in catalog), requester
    (required, 200), channel (defaults to the form, otherwise in catalog). Row-local.
    """
    read = requests.withColumns(
        {
            **{f"_{c}": strip(text_or_empty(F.col(c))) for c in ("asunto", "descripcion",
                                                                 "solicitante", "canal")},
            "_area": canonical_column("area", F.col("area")),
            "_canal_valido": canonical_column("canal", F.col("canal")),
        }
    )

    def unusable(name: str) -> Column:
        return (F.col(name) == "") | (F.length(name) > MAX_TITLE)

    failing = F.coalesce(
        F.when(unusable("_asunto"), F.lit("asunto")),
        F.when(F.length("_descripcion") > MAX_BODY, F.lit("descripcion")),
        F.when(F.col("_area").isNull(), F.lit("area")),
        F.when(unusable("_solicitante"), F.lit("solicitante")),
        F.when((F.col("_canal") != "") & F.col("_canal_valido").isNull(), F.lit("canal")),
    )
    checked = settled(read, {"campo": failing})
    accepted = checked.filter(F.col("campo").isNull()).withColumns(
        {
            **{name: F.col(f"_{name}") for name in ("asunto", "descripcion", "area",
                                                    "solicitante")},
            "canal": F.coalesce("_canal_valido", F.lit(DEFAULT_CHANNEL)),
            "estado": F.lit(INITIAL_STATE),
        }
    )
    helpers = [name for name in checked.columns if name.startswith("_")]
    rejected = checked.filter(F.col("campo").isNotNull())
    return accepted.drop("campo", *helpers), rejected.drop(*helpers)


def _matches(spark: SparkSession, filters: dict[str, str | None]) -> Column:
    """Equality with canonical values, which are constants by the time the filter is planned."""
    condition = F.lit(True)
    for name in FILTER_FIELDS:
        wanted = filters.get(name)
        if wanted is None or not wanted.strip():
            continue
        value = spark.sql("SELECT 1").select(canonical(name, F.lit(wanted))).first()[0]
        if value is None:
            raise UnknownFilterValue(name)
        condition = condition & (F.col(name) == value)
    return condition


def list_requests(
    requests: DataFrame, filters: dict[str, str | None] | None = None,
    limit: int = PAGE_SIZE, offset: int = 0, order: str = "seq",
) -> tuple[DataFrame, DataFrame]:
    """One page, newest first, and ``(total, hay_mas)`` for the same filters without paging.

    Filters compare exactly against canonical values, so they reach the scan. The page is a
    top-k, not a sort of the table.
    """
    limit, offset = max(1, min(int(limit), MAX_PAGE_SIZE)), max(0, int(offset))
    chosen = requests.filter(_matches(requests.sparkSession, filters or {}))
    page = chosen.orderBy(F.desc(order)).offset(offset).limit(limit)
    total = chosen.agg(F.count("*").alias("total")).withColumn(
        "hay_mas", F.lit(offset + limit) < F.col("total")
    )
    return page, total


def get_request(requests: DataFrame, code: str | None) -> DataFrame:
    """The request with that code; no row when the code is blank or unknown."""
    return requests.filter(F.col("codigo") == F.lit((code or "").strip() or None))


def change_state(requests: DataFrame, code: str, state: str) -> DataFrame:
    """A copy of the table where one request has another state."""
    return requests.withColumn(
        "estado", F.when(F.col("codigo") == code, F.lit(state)).otherwise(F.col("estado"))
    )


def request_code(number: Column) -> Column:
    """``SOL-000001``; numbers past six digits widen instead of being cut."""
    digits = number.cast("string")
    padded = F.when(F.length(digits) >= CODE_WIDTH, digits).otherwise(
        F.lpad(digits, CODE_WIDTH, "0")
    )
    return F.concat(F.lit(f"{CODE_PREFIX}-"), padded)


def number_requests(
    requests: DataFrame, order: str, last_number: int = 0, block: int = NUMBERING_BLOCK
) -> DataFrame:
    """Consecutive ``numero`` and ``codigo`` after ``last_number``, in the order of a whole-number
    arrival sequence.

    Rows are ranked inside blocks of the sequence. A block starts where the blocks before it end,
    which is again found in two levels: blocks inside groups of ``GROUPED_BLOCKS``, and the groups
    among themselves, so even the one global window sees a row per group only.
    """
    blocked = requests.withColumn(
        "_block", F.floor(F.col(order) / F.lit(block)).cast("bigint")
    )
    sizes = (
        blocked.groupBy("_block")
        .agg(F.count("*").alias("_size"))
        .withColumn("_group", F.floor(F.col("_block") / F.lit(GROUPED_BLOCKS)).cast("bigint"))
    )
    earlier = Window.unboundedPreceding, -1
    inside_group = Window.partitionBy("_group").orderBy("_block").rowsBetween(*earlier)
    groups = sizes.groupBy("_group").agg(F.sum("_size").alias("_group_size")).select(
        "_group",
        F.coalesce(
            F.sum("_group_size").over(Window.orderBy("_group").rowsBetween(*earlier)), F.lit(0)
        ).alias("_base"),
    )
    offsets = (
        sizes.withColumn("_inside", F.coalesce(F.sum("_size").over(inside_group), F.lit(0)))
        .join(groups, "_group")
        .select("_block", (F.col("_base") + F.col("_inside")).alias("_offset"))
    )
    inside = Window.partitionBy("_block").orderBy(order)
    return (
        blocked.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, "_block")
        .withColumn("numero", F.col("_rank") + F.col("_offset") + F.lit(last_number))
        .withColumn("codigo", request_code(F.col("numero")))
        .drop("_block", "_rank", "_offset")
    )


def needs_review(classified: DataFrame) -> DataFrame:
    """Requests whose category does not come from the model."""
    return classified.filter(F.col("origen") != "modelo")
