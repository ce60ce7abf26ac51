"""Operational metrics over event tables: latency, degradation rates, token usage, cost, redaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ticketlake.functions.ratios import rate
from ticketlake.functions.text import strip
from ticketlake.operators.skew import top_per_key

# Sample size, percentiles, fields that must not reach a log and their marker.
MAX_SAMPLES = 1000
PERCENTILES = (50, 95, 99)
PRIVATE_FIELDS = ("asunto", "descripcion", "solicitante", "correo", "texto")
REDACTED = "«omitido: dato personal o contenido»"
TRACE_SHAPE = r"^[\p{L}\p{Nd}\p{Nl}\p{No}_-]{1,64}$"


def last_samples(events: DataFrame, key: str, order: str, n: int = MAX_SAMPLES) -> DataFrame:
    """The most recent ``n`` rows per key."""
    return top_per_key(events, key, [F.desc(order)], n)


def nearest_rank(samples: Column, p: int) -> Column:
    """Percentile of a sorted array as one of its values; 0.0 when it is empty.

    The rank is ``p/100·n + 0.5`` rounded half to even, clamped to the array.
    """
    n = F.size(samples)
    rank = F.bround(F.lit(p / 100) * n + 0.5).cast("int")
    index = F.greatest(F.lit(0), F.least(n - 1, rank - 1))
    return F.round(F.coalesce(F.get(samples, index), F.lit(0.0)), 2)


def latency_summary(events: DataFrame) -> DataFrame:
    """Count and p50/p95/p99 over the last samples of each operation.

    ``events``: operacion, seq, latencia_ms. Only the kept samples are ever gathered per operation.
    """
    kept = last_samples(events, "operacion", "seq")
    lists = kept.groupBy("operacion").agg(
        F.sort_array(F.collect_list("latencia_ms")).alias("_ms"), F.count("*").alias("cuenta")
    )
    return lists.select(
        "operacion", "cuenta", *[nearest_rank(F.col("_ms"), p).alias(f"p{p}") for p in PERCENTILES]
    )


def rates_by_origin(events: DataFrame, bad: str, by: Sequence[str] = ()) -> DataFrame:
    """Total, bad count and bad share of events ``(origen, motivo)``."""
    return (
        events.groupBy(*by)
        .agg(F.count("*").alias("total"), F.count_if(F.col("origen") == bad).alias("malos"))
        .withColumn("tasa", rate(F.col("malos"), F.col("total")))
    )


def motives(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Events per motive; events without one are not listed."""
    named = events.filter(F.coalesce(F.col("motivo"), F.lit("")) != "")
    return named.groupBy(*by, "motivo").agg(F.count("*").alias("n"))


def token_usage(calls: DataFrame, by: Sequence[str] = ("proveedor",)) -> DataFrame:
    """Calls, calls without any token report, tokens in/out and reasoning tokens per group.

    A call with one null counts that side as zero; only both null means unreported. Reasoning is
    part of the output tokens and is never added to them. Cost is left null: it needs prices.
    """
    silent = F.col("tokens_entrada").isNull() & F.col("tokens_salida").isNull()

    def total(name: str) -> Column:
        return F.coalesce(
            F.sum(F.when(~silent, F.col(name).cast("bigint"))), F.lit(0).cast("bigint")
        ).alias(name)

    return (
        calls.groupBy(*by)
        .agg(
            F.count("*").alias("llamadas"),
            F.count_if(silent).alias("llamadas_sin_tokens"),
            total("tokens_entrada"),
            total("tokens_salida"),
            total("tokens_razonamiento"),
        )
        .withColumn("costo_estimado", F.lit(None).cast("double"))
    )


def cost_projection(usage: DataFrame, prices: DataFrame, calls_per_month: int) -> DataFrame:
    """Monthly cost per provider from measured tokens per reporting call and a price table.

    ``prices``: proveedor, precio_entrada, precio_salida per million tokens. Providers without a
    price keep a null cost; nothing is assumed for them.
    """
    reporting = F.nullif(
        F.col("llamadas") - F.col("llamadas_sin_tokens"), F.lit(0).cast("bigint")
    )
    per_call = [
        (F.col(name) / reporting) * calls_per_month / 1_000_000.0
        for name in ("tokens_entrada", "tokens_salida")
    ]
    return usage.join(prices, "proveedor", "left").select(
        "proveedor",
        "llamadas",
        F.round(per_call[0], 4).alias("millones_entrada"),
        F.round(per_call[1], 4).alias("millones_salida"),
        F.round(
            per_call[0] * F.col("precio_entrada") + per_call[1] * F.col("precio_salida"), 4
        ).alias("costo_mensual"),
    )


def redact_events(events: DataFrame, fields: Sequence[str] = PRIVATE_FIELDS) -> DataFrame:
    """Replace private fields that carry a value by a fixed marker, also among the ``extras``."""
    present = [name for name in fields if name in events.columns]
    changed = {name: F.when(F.col(name).isNotNull(), F.lit(REDACTED)) for name in present}
    if "extras" in events.columns:
        changed["extras"] = redact_map(F.col("extras"), fields)
    return events.withColumns(changed)


def redact_map(extras: Column, fields: Sequence[str] = PRIVATE_FIELDS) -> Column:
    """The same for the extra fields of an event kept in a map."""
    return F.transform_values(
        extras, lambda key, value: F.when(key.isin(*fields), F.lit(REDACTED)).otherwise(value)
    )


def usable_trace(col: Column) -> Column:
    """A caller's trace id when it is usable, else null."""
    trimmed = strip(col)
    return F.when(trimmed.rlike(TRACE_SHAPE), trimmed)


def standardize_trace_ids(events: DataFrame, column: str = "id_traza") -> DataFrame:
    """Keep usable trace ids and give every other row a new 32-digit one."""
    return events.withColumn(
        column, F.coalesce(usable_trace(F.col(column)), F.replace(F.uuid(), F.lit("-"), F.lit("")))
    )


#: What :func:`call_sums` gives, in order.
CALL_SUMS = ("llamadas", "degradadas", "tokens_entrada", "tokens_salida")


def call_sums() -> list[Column]:
    """Calls, degraded calls and tokens of a group; absent token counts add nothing."""
    return [
        F.count("*").alias("llamadas"),
        F.count_if(F.col("origen") == "degradado").alias("degradadas"),
        F.sum(F.coalesce("tokens_entrada", F.lit(0))).alias("tokens_entrada"),
        F.sum(F.coalesce("tokens_salida", F.lit(0))).alias("tokens_salida"),
    ]


def sessions(events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Sessions of each operation: runs of calls at most ``gap_seconds`` apart.

    Calls within one stretch of the clock of that length always share a session, so they are added up
    first, partially before the shuffle. What is then ordered per operation is a row per stretch with
    its first and last call: its number depends on the time covered, not on how busy an operation is.
    Rows without a time are left out; a missing operation is one of its own.
    """
    micros = gap_seconds * 1_000_000
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).filter(F.col("ts").isNotNull())
    stretch = F.floor(F.unix_micros("ts") / F.lit(micros)).cast("bigint")
    stretches = timed.groupBy("operacion", stretch.alias("_stretch")).agg(
        F.min("ts").alias("desde"), F.max("ts").alias("hasta"), *call_sums()
    )
    along = Window.partitionBy("operacion").orderBy("_stretch")
    apart = F.unix_micros("desde") - F.unix_micros(F.lag("hasta").over(along)) > micros
    numbered = stretches.withColumn("_first", F.coalesce(apart, F.lit(True)).cast("int")).withColumn(
        "_session", F.sum("_first").over(along)
    )
    return numbered.groupBy("operacion", "_session").agg(
        F.min("desde").alias("desde"), F.max("hasta").alias("hasta"),
        *[F.sum(name).alias(name) for name in CALL_SUMS],
    ).drop("_session")
