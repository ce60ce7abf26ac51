"""Evaluation against labelled cases: confusion, class metrics, retrieval, gates, thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ticketlake.functions.ratios import rate

# Sentinel of unsupported cases, targets and the sweep of thresholds.
NO_SUPPORT = "SIN EVIDENCIA EN LOS DOCUMENTOS"
MIN_RECALL = 0.90
MAX_ESCALATION = 0.25
MIN_MACRO_F1 = 0.70
SWEEP = tuple(round(0.02 * step, 2) for step in range(1, 21))
NO_EVIDENCE = "sin_evidencia_suficiente"
ABSTAINED = "abstencion"
UNCITED = "emitió una respuesta sin ninguna cita"
UNSUPPORTED_ANSWER = "respondió a una pregunta sin respaldo"
UNANSWERED = "quedó sin respuesta"


def confusion_matrix(
    pairs: DataFrame, labels: Sequence[str] | None = None, real: str = "real",
    predicted: str = "prediccion",
) -> DataFrame:
    """``(real, prediccion, n)`` for every pair of labels, zeros included.

    Without ``labels`` the list is what occurs on either side. With them it is closed: a pair with
    a label outside the list is an error when the matrix is read, never a lost case. The grid comes
    from two explodes of the label list, one short row, not from a join of the data with itself.
    """
    counts = pairs.groupBy(
        F.col(real).alias("real"), F.col(predicted).alias("prediccion")
    ).agg(F.count("*").alias("n"))
    if labels is None:
        either = counts.select(F.explode(F.array("real", "prediccion")).alias("label"))
        names = either.agg(F.array_sort(F.collect_set("label")).alias("names"))
    else:
        known = F.array(*[F.lit(name) for name in labels])
        names = counts.sparkSession.range(1).select(known.alias("names"))
        stray = ~F.col("real").isin(*labels) | ~F.col("prediccion").isin(*labels)
        message = F.concat_ws(
            " ", F.lit("label outside the list:"), "real", F.lit("/"), "prediccion"
        )
        counts = counts.withColumn(
            "n", F.when(stray, F.raise_error(message).cast("bigint")).otherwise(F.col("n"))
        )
    grid = names.select("names", F.explode("names").alias("real")).select(
        "real", F.explode("names").alias("prediccion")
    )
    how = "left" if labels is None else "full"  # a stray label must reach its error
    return grid.join(counts, ["real", "prediccion"], how).select(
        "real", "prediccion", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")
    )


def class_metrics(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 (four decimals, 0 when undefined) and support per class."""
    hit = F.col("real") == F.col("prediccion")
    sides = matrix.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("real").alias("categoria"), F.col("n").alias("reales"),
                    F.lit(0).cast("bigint").alias("predichos"),
                    F.when(hit, F.col("n")).otherwise(0).cast("bigint").alias("aciertos"),
                ),
                F.struct(
                    F.col("prediccion").alias("categoria"), F.lit(0).cast("bigint").alias("reales"),
                    F.col("n").alias("predichos"), F.lit(0).cast("bigint").alias("aciertos"),
                ),
            )
        ).alias("s")
    ).select("s.*")
    sums = sides.groupBy("categoria").agg(
        *[F.sum(name).alias(name) for name in ("reales", "predichos", "aciertos")]
    )
    # F1 = 2·hits / (real + predicted), the same number without intermediate rounding.
    return sums.select(
        "categoria",
        rate(F.col("aciertos"), F.col("predichos")).alias("precision"),
        rate(F.col("aciertos"), F.col("reales")).alias("exhaustividad"),
        F.when(
            F.col("aciertos") > 0,
            rate(F.col("aciertos") * 2, F.col("reales") + F.col("predichos")),
        )
        .otherwise(0.0)
        .alias("f1"),
        F.col("reales").alias("casos"),
    )


def accuracy(matrix: DataFrame) -> DataFrame:
    """Cases, hits and share of hits."""
    hits = F.sum(F.when(F.col("real") == F.col("prediccion"), F.col("n")).otherwise(0))
    return matrix.agg(F.sum("n").alias("casos"), hits.alias("aciertos")).withColumn(
        "exactitud", rate(F.col("aciertos"), F.col("casos"))
    )


def macro_f1(metrics: DataFrame) -> DataFrame:
    """Unweighted mean of the class F1 values."""
    return metrics.agg(
        F.count("*").alias("categorias"), F.round(F.avg("f1"), 4).alias("macro_f1")
    )


def macro_f1_gate(metrics: DataFrame, threshold: float = MIN_MACRO_F1) -> DataFrame:
    """The macro-F1 and whether it reaches the threshold; no classes fail."""
    return macro_f1(metrics).withColumn(
        "aprueba", F.coalesce(F.col("macro_f1") >= threshold, F.lit(False))
    )


def retrieval_hits(cases: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Per case: best score, whether the expected citation was delivered and at which position.

    ``cases``: id_caso, esperado, cita_esperada. ``retrieved``: question_id, cita, puntaje, posicion.
    """
    joined = cases.join(retrieved, F.col("id_caso") == F.col("question_id"), "left")
    position = F.min(F.when(F.col("cita") == F.col("cita_esperada"), F.col("posicion")))
    return joined.groupBy("id_caso", "esperado", "cita_esperada").agg(
        F.coalesce(F.max("puntaje"), F.lit(0.0)).alias("mejor"),
        position.isNotNull().alias("recuperada"),
        position.alias("posicion"),
    )


def unsupported() -> Column:
    return F.trim("esperado") == NO_SUPPORT


def case_detail(hits: DataFrame, answers: DataFrame) -> DataFrame:
    """Outcome of every case with the reason it counts as a failure (null when it does not).

    A case without an answer stays, with a null ``origen``, and counts as a failure.
    """
    joined = hits.join(answers, F.col("id_caso") == F.col("question_id"), "left").withColumn(
        "citas", F.coalesce("citas", F.array().cast("array<string>"))
    )
    missing = F.col("question_id").isNull()
    abstained = F.coalesce(F.col("origen") == ABSTAINED, F.lit(False))
    uncited = ~missing & ~abstained & (F.size("citas") == 0)
    return joined.select(
        "id_caso",
        unsupported().alias("sin_respaldo"),
        "origen",
        "motivo",
        F.round("mejor_puntaje", 4).alias("puntaje"),
        "citas",
        "recuperada",
        uncited.alias("sin_cita"),
        F.when(missing, F.lit(UNANSWERED))
        .when(uncited, F.lit(UNCITED))
        .when(unsupported() & ~abstained, F.lit(UNSUPPORTED_ANSWER))
        .alias("fallo"),
    )


def evaluate(detail: DataFrame) -> DataFrame:
    """One row of totals and rates over :func:`case_detail`.

    Any abstention counts as right for an unsupported case; only missing evidence counts as an
    escalation for a supported one.
    """
    backed, abstained = ~F.col("sin_respaldo"), F.col("origen") == ABSTAINED
    sums = detail.agg(
        F.count_if(backed).alias("con_respaldo"),
        F.count_if(~backed).alias("sin_respaldo"),
        F.count_if(backed & F.col("recuperada")).alias("recuperados"),
        F.count_if(~backed & abstained).alias("abstenciones_correctas"),
        F.count_if(F.col("sin_cita")).alias("respuestas_sin_cita"),
        F.count_if(backed & (F.col("motivo") == NO_EVIDENCE)).alias("escalamientos"),
        F.count_if(F.col("origen").isNull()).alias("sin_respuesta"),
        F.count_if(F.col("fallo").isNotNull()).alias("fallos"),
    )
    return sums.withColumns(
        {
            "recall": rate(F.col("recuperados"), F.col("con_respaldo")),
            "tasa_abstencion": rate(F.col("abstenciones_correctas"), F.col("sin_respaldo")),
            "tasa_escalamiento": rate(F.col("escalamientos"), F.col("con_respaldo")),
        }
    )


def check_thresholds(result: DataFrame, real_provider: bool) -> DataFrame:
    """The unmet conditions of an evaluation; no row means it passes.

    Compared as whole counts, so 9 of 10 is exactly a recall of 0.90. Abstention is only checked
    against a real provider.
    """
    misses_abstention = (F.col("abstenciones_correctas") < F.col("sin_respaldo")) | (
        F.col("sin_respaldo") == 0
    )
    misses_recall = (
        F.col("recuperados") * 100 < F.col("con_respaldo") * int(MIN_RECALL * 100)
    ) | (F.col("con_respaldo") == 0)
    escalates = F.col("escalamientos") * 100 > F.col("con_respaldo") * int(MAX_ESCALATION * 100)
    checks = [
        ("respuestas_sin_cita", True, F.col("respuestas_sin_cita") > 0),
        ("abstencion", True, misses_abstention if real_provider else F.lit(False)),
        ("recall", False, misses_recall),
        ("escalamiento", False, escalates),
    ]
    unmet = F.array(
        *[
            F.when(broken, F.struct(F.lit(name).alias("condicion"), F.lit(hard).alias("dura")))
            for name, hard, broken in checks
        ]
    )
    return result.select(F.inline(F.array_compact(unmet)))


def threshold_sweep(hits: DataFrame, thresholds: Sequence[float] = SWEEP) -> DataFrame:
    """For each threshold: good answers, wrong abstentions, right abstentions and both targets.
    Without cases every threshold still has its row, of zeros.

    Cases are first counted by how many thresholds their best score reaches, so only a handful of
    rows per threshold is ever expanded.
    """
    steps = F.array(*[F.lit(float(u)) for u in thresholds])
    reached = F.size(F.filter(steps, lambda u: u <= F.col("mejor")))
    cells = hits.groupBy(
        unsupported().alias("sin_respaldo"), "recuperada", reached.alias("alcanza")
    ).agg(F.count("*").alias("n"))
    backed = ~F.col("sin_respaldo")
    passes = F.col("paso") < F.col("alcanza")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    every = cells.sparkSession.range(1).select(
        F.lit(None).cast("boolean").alias("sin_respaldo"),
        F.lit(None).cast("boolean").alias("recuperada"),
        F.lit(0).alias("alcanza"),
        F.lit(0).cast("bigint").alias("n"),
    )
    return (
        cells.unionByName(every)
        .select("*", F.posexplode(steps).alias("paso", "umbral"))
        .groupBy("umbral")
        .agg(
            total(backed & passes & F.col("recuperada")).alias("buenas"),
            total(backed & ~passes).alias("abstiene_mal"),
            total(~backed & ~passes).alias("abstiene_bien"),
            total(backed).alias("con_respaldo"),
            total(~backed).alias("sin_respaldo"),
        )
        .withColumns(
            {
                "cumple_escalamiento": F.col("abstiene_mal") * 100
                <= F.col("con_respaldo") * int(MAX_ESCALATION * 100),
                "cumple_abstencion": F.col("abstiene_bien") == F.col("sin_respaldo"),
            }
        )
        .orderBy("umbral")
    )


def chosen_threshold(sweep: DataFrame) -> DataFrame:
    """The lowest threshold that abstains on every unsupported case; null when none does."""
    return sweep.agg(
        F.min(F.when(F.col("cumple_abstencion"), F.col("umbral"))).alias("umbral")
    )
