"""Multinomial naive Bayes as two tables, its prediction, and reproducible splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ticketlake.functions.ratios import rate
from ticketlake.operators.skew import HOT_ROWS, hot_keys, salted_join
from ticketlake.operators.tfidf import postings, term_counts
from ticketlake.session import materialize

TRAIN, TEST = "entrenamiento", "prueba"
TRAIN_SHARE = 0.8


@dataclass(frozen=True)
class BayesModel:
    """``classes``: etiqueta, n_docs, log_previa, total_terminos, log_desconocido.
    ``terms``: etiqueta, termino, n, log_verosimilitud."""

    classes: DataFrame
    terms: DataFrame


def train_naive_bayes(texts: DataFrame) -> BayesModel:
    """Fit on ``(texto, etiqueta)``.

    The texts are read once: the counts per class and term are written and the model is derived
    from them. Priors are unsmoothed; a term of a class weighs ``ln((n + 1) / (T + V))`` and a vocabulary
    term the class never showed ``ln(1 / (T + V))``. Fewer than two classes raise an error when
    the model is read.
    """
    counted = term_counts(texts, F.col("texto"), "etiqueta")
    counts = materialize(
        counted.select("etiqueta", F.inline("terms"))
        .groupBy("etiqueta", "termino")
        .agg(F.sum("tf").alias("n"))
    )
    labels = texts.groupBy("etiqueta").agg(F.count("*").alias("n_docs"))
    total = labels.agg(F.sum("n_docs")).scalar()
    n_labels = labels.agg(F.count("*")).scalar()
    vocabulary = (
        counts.groupBy("termino").agg(F.lit(1).alias("_one")).agg(F.count("*")).scalar()
    )
    sizes = counts.groupBy("etiqueta").agg(F.sum("n").alias("total_terminos"))
    prior = F.when(
        n_labels < 2, F.raise_error(F.lit("naive Bayes needs at least two classes"))
    ).otherwise(F.log(F.col("n_docs") / total))
    classes = (
        labels.join(sizes, "etiqueta", "left")
        .withColumn("total_terminos", F.coalesce("total_terminos", F.lit(0).cast("bigint")))
        .withColumn("log_previa", prior.cast("double"))
        .withColumn("_den", F.col("total_terminos") + vocabulary)
        .withColumn("log_desconocido", F.log(F.lit(1.0) / F.col("_den")))
    )
    terms = counts.join(classes.select("etiqueta", "_den"), "etiqueta").select(
        "etiqueta",
        "termino",
        "n",
        F.log((F.col("n") + 1.0) / F.col("_den")).alias("log_verosimilitud"),
    )
    return BayesModel(classes.drop("_den"), terms)


def predict_naive_bayes(
    texts: DataFrame, model: BayesModel, key: str = "doc_id", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``(key, prediccion, margen)`` for ``(key, texto)``.

    The class with the highest log-posterior over known terms; equal scores go to the
    alphabetically last class. ``margen`` is the gap to the second class. Each text term meets one
    model row (a short list, one entry per class) in a salted join, and the products add up per
    text; classes without the term add their unseen-term constant through the known-term count.
    """
    unseen = model.classes.select("etiqueta", "log_desconocido")
    by_term = (
        model.terms.join(unseen, "etiqueta")
        .groupBy("termino")
        .agg(
            F.sum("n").alias("_n"),
            F.collect_list(
                F.struct(
                    "etiqueta",
                    (F.col("log_verosimilitud") - F.col("log_desconocido")).alias("extra"),
                )
            ).alias("_gains"),
        )
    )
    flat = postings(term_counts(texts, F.col("texto"), key), key)
    known = salted_join(
        flat, by_term.drop("_n"), "termino", hot_keys(by_term, "termino", "_n", hot_rows), [key]
    ).repartition(key)
    gains = (
        known.select(
            key,
            "tf",
            F.inline(
                F.concat(
                    "_gains",
                    F.array(F.struct(F.lit("").alias("etiqueta"), F.lit(1.0).alias("extra"))),
                )
            ),
        )
        .groupBy(key, "etiqueta")
        .agg(F.sum(F.col("tf") * F.col("extra")).alias("gain"))
        .groupBy(key)
        .agg(F.map_from_entries(F.collect_list(F.struct("etiqueta", "gain"))).alias("_gain"))
    )
    classes = model.classes.agg(
        F.collect_list(F.struct("etiqueta", "log_previa", "log_desconocido"))
    ).scalar()
    scored = (
        texts.select(key)
        .join(gains, key, "left")
        .withColumn("_gain", F.coalesce("_gain", F.create_map().cast("map<string,double>")))
        .withColumn("_classes", classes)
        .withColumn(
            "_scores",
            F.sort_array(
                F.transform(
                    "_classes",
                    lambda c: F.struct(
                        F.round(
                            c["log_previa"]
                            + _gain_of(F.lit("")) * c["log_desconocido"]
                            + _gain_of(c["etiqueta"]),
                            9,
                        ).alias("score"),
                        c["etiqueta"].alias("etiqueta"),
                    ),
                ),
                asc=False,
            ),
        )
    )
    return scored.select(
        key,
        F.col("_scores")[0]["etiqueta"].alias("prediccion"),
        F.round(
            F.coalesce(
                F.get("_scores", F.lit(0))["score"] - F.get("_scores", F.lit(1))["score"],
                F.lit(0.0),
            ),
            4,
        ).alias("margen"),
    )


def _gain_of(label: Column) -> Column:
    return F.coalesce(F.element_at("_gain", label), F.lit(0.0))


def corpus_diversity(texts: DataFrame) -> DataFrame:
    """One row about labelled ``(asunto, etiqueta)``: size, distinct subjects, repeats per
    subject, classes, share of the largest class and subjects with more than one class."""
    cells = texts.groupBy("asunto", "etiqueta").agg(F.count("*").alias("n"))
    subjects = cells.groupBy("asunto").agg(F.count("*").alias("classes"))
    labels = cells.groupBy("etiqueta").agg(F.sum("n").alias("n"))
    by_subject = subjects.agg(
        F.count("*").alias("asuntos"), F.count_if(F.col("classes") > 1).alias("ambiguos")
    )
    return labels.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("filas"),
        F.count("*").alias("categorias"),
        F.max("n").alias("mayor"),
    ).select(
        "filas",
        by_subject.select("asuntos").scalar().alias("asuntos"),
        F.coalesce(
            F.call_function(
                "div", F.col("filas"), F.nullif(by_subject.select("asuntos").scalar(), F.lit(0))
            ),
            F.lit(0).cast("bigint"),
        ).alias("repeticiones"),
        "categorias",
        rate(F.coalesce("mayor", F.lit(0)), F.col("filas")).alias("linea_base"),
        by_subject.select("ambiguos").scalar().alias("asuntos_ambiguos"),
    )


def _shuffled_position(key: str, seed: int) -> Column:
    text = F.col(key).cast("string")
    return F.concat(F.md5(F.concat(F.lit(f"{seed}|"), text)), F.lit("|"), text)


def _cut_position(keys: DataFrame, key: str, seed: int, share: float) -> str | None:
    """The shuffled position up to which ``int(n * share)`` of the distinct keys lie.

    Keys are counted in about a million hash buckets; only the bucket the cut falls in is ranked.
    The result is one value, so the split itself is a comparison with a constant.
    """
    placed = keys.select(_shuffled_position(key, seed).alias("_at")).withColumn(
        "_bucket", F.substring("_at", 1, 5)
    )
    sizes = placed.groupBy("_bucket").agg(F.count("*").alias("_size"))
    running = Window.orderBy("_bucket")
    cut = F.floor(sizes.agg(F.sum("_size")).scalar() * F.lit(share)).cast("bigint")
    place = (
        sizes.withColumn("_upto", F.sum("_size").over(running))
        .filter((F.col("_upto") >= cut) & (F.col("_upto") - F.col("_size") < cut))
        .select("_bucket", (cut - (F.col("_upto") - F.col("_size"))).alias("_rank"))
    ).head()
    if place is None:
        return None
    inside = placed.filter(F.col("_bucket") == place["_bucket"]).withColumn(
        "_n", F.row_number().over(Window.orderBy("_at"))
    )
    return inside.filter(F.col("_n") == place["_rank"]).head()["_at"]


def _split(df: DataFrame, keys: DataFrame, key: str, seed: int, share: float) -> DataFrame:
    cut = _cut_position(keys, key, seed, share)
    in_train = F.lit(False) if cut is None else _shuffled_position(key, seed) <= cut
    return df.withColumn("particion", F.when(in_train, TRAIN).otherwise(TEST))


def split_by_row(df: DataFrame, key: str, seed: int, share: float = TRAIN_SHARE) -> DataFrame:
    """Marks a reproducible shuffle's first ``int(n * share)`` rows as training; key is unique.

    Every row compares its own hash with one threshold, so no row moves.
    """
    return _split(df, df.select(key), key, seed, share)


def split_by_group(df: DataFrame, group: str, seed: int, share: float = TRAIN_SHARE) -> DataFrame:
    """Same cut over distinct groups: a group never has rows on both sides."""
    return _split(df, df.select(group).distinct(), group, seed, share)
