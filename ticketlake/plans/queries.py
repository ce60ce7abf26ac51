"""Registered queries: every operator over whole tables, with flat, named result columns."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from ticketlake.functions.catalogs import canonical_column, standardize_catalogs
from ticketlake.functions.citations import (
    citations,
    document_header,
    fingerprint,
    first_json_object,
    idempotency_key,
)
from ticketlake.functions.dates import month_bounds, report_dates, standardize_dates
from ticketlake.functions.text import search_key, title_and_body, tokens
from ticketlake.operators import (
    bayes,
    chunks,
    clean,
    evaluation,
    gates,
    intake,
    metrics,
    reminders,
    reports,
    requests,
    rules,
    tfidf,
)
from ticketlake.operators.skew import small_dimension
from ticketlake.plans.views import VIEWS, view
from ticketlake.schemas import TICKET_COLUMNS
from ticketlake.session import materialize, stored
from ticketlake.sources.documents import reference_cases
from ticketlake.sources.tickets import read_labelled_texts
from ticketlake.streaming.flows import window_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters of the registered queries.
SEED = 42
TODAY = date(2001, 8, 6)
HOLIDAYS = (date(2000, 1, 3), date(2000, 12, 25), date(2001, 5, 1), date(2001, 7, 20))
PRICES = [("norte", 0.28, 0.42), ("sur", 0.05, 0.4)]
CALLS_PER_MONTH = 90_000
MIN_MARGIN = 25.0
SESSION_GAP = 600


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _flat(col, separator: str = "|"):
    return F.array_join(col, separator)


_BUILT: dict[tuple[str, str, str], object] = {}


def _shared[T](name: str, spark: SparkSession, sf_dir: str, build: Callable[[], T]) -> T:
    """What several queries share, built once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


def _once(name: str, spark: SparkSession, sf_dir: str, build: Callable[[], DataFrame]) -> DataFrame:
    """An input that several queries share, written once per session."""
    return _shared(name, spark, sf_dir, lambda: materialize(build()))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hand-written history: an input of the cleaning queries.

    Captures are dealt evenly first: a table of few splits would leave the parsing to as few tasks,
    and a step of the order to the tasks that hold its range.
    """
    def render() -> DataFrame:
        captures = materialize(view(spark, sf_dir, "capturas").hint("rebalance"))
        return spark.sql(VIEWS["tickets_crudos"], capturas=captures).drop("k")

    return _once("tickets_crudos", spark, sf_dir, render)


def _cleaned(spark: SparkSession, sf_dir: str) -> clean.Cleaning:
    """The cleaned history over judged rows that are written once: an input of the queries on it."""
    return _shared("limpieza", spark, sf_dir, lambda: clean.clean_history(_raw(spark, sf_dir)))


# Typed values ---------------------------------------------------------------------------------


@query
def p1_dates(spark, sf_dir):
    read = standardize_dates(_raw(spark, sf_dir), {"c": "fecha_creacion", "x": "fecha_cierre"})
    return read.select(
        "_row",
        F.col("c.valor").alias("creacion"),
        F.col("c.motivo").alias("motivo_creacion"),
        F.col("x.valor").alias("cierre"),
        F.col("x.motivo").alias("motivo_cierre"),
    )


@query
def p2_catalog(spark, sf_dir):
    names = ("categoria", "prioridad", "estado", "canal", "area")
    read = standardize_catalogs(_raw(spark, sf_dir), {f"v_{name}": name for name in names})
    return read.select(
        "_row",
        *[F.col(f"v_{name}.valor").alias(name) for name in names],
        *[F.col(f"v_{name}.motivo").alias(f"motivo_{name}") for name in names],
    )


@query
def p3_reopens(spark, sf_dir):
    return _raw(spark, sf_dir).select(
        "_row", clean.standardize_reopens(F.col("reaperturas")).alias("reaperturas")
    )


@query
def p4_defaults(spark, sf_dir):
    names = ("categoria", "prioridad", "canal")
    looked_up = _raw(spark, sf_dir).withColumns(
        {name: canonical_column(name, F.col(name)) for name in names}
    )
    return clean.apply_defaults(looked_up).select(
        "_row", "area", *names, "solicitante", "asunto", "descripcion"
    )


@query
def x1_keys(spark, sf_dir):
    return view(spark, sf_dir, "tickets_conversados").select(
        "ticket_id", F.md5(search_key(F.col("descripcion"))).alias("clave")
    )


@query
def x2_tokens(spark, sf_dir):
    return view(spark, sf_dir, "documents").select(
        "doc_id",
        F.size(tokens(F.col("text"))).cast("bigint").alias("n"),
        F.md5(F.array_join(tokens(F.col("text")), " ")).alias("tokens_md5"),
    )


# Cleaning -------------------------------------------------------------------------------------


@query
def p5_validate(spark, sf_dir):
    _, rejects = clean.validate_tickets(_raw(spark, sf_dir))
    return rejects.select("numero_de_fila", "motivo", "detalle")


@query
def p5_valid(spark, sf_dir):
    valid, _ = clean.validate_tickets(_raw(spark, sf_dir))
    return valid.select("_row", *TICKET_COLUMNS)


@query
def w1_dedup_clean(spark, sf_dir):
    return _cleaned(spark, sf_dir).clean


@query
def w1_dedup_quarantine(spark, sf_dir):
    rejects = _cleaned(spark, sf_dir).duplicates
    stored = [
        F.col("fila_original")[name].alias(f"fila_{name}")
        for name in ("id", "categoria", "solicitante", "fecha_cierre")
    ]
    return rejects.select("numero_de_fila", "motivo", "numero_fila_descartada", *stored)


@query
def w10_quarantine(spark, sf_dir):
    return _cleaned(spark, sf_dir).quarantine.select(
        "numero_de_fila", "motivo", "detalle", "numero_fila_descartada"
    )


@query
def a5_quality(spark, sf_dir):
    return _cleaned(spark, sf_dir).report


@query
def a6_gate(spark, sf_dir):
    return clean.quality_gate(_cleaned(spark, sf_dir).report)


@query
def p15_second_pass(spark, sf_dir):
    quarantine = _cleaned(spark, sf_dir).quarantine
    return clean.second_pass_eligible(quarantine).select("numero_de_fila", "motivo")


@query
def a3_summary(spark, sf_dir):
    return reports.summarize(_cleaned(spark, sf_dir).clean)


@query
def s4_summary(spark, sf_dir):
    return reports.summarize(
        view(spark, sf_dir, "tickets").withColumnRenamed("categoria", "area")
    ).select("agrupacion", "nombre", "total", "abiertos", "cerrados", "tasa_reapertura_pct")


@query
def a4_area_priority(spark, sf_dir):
    return reports.area_priority_counts(_cleaned(spark, sf_dir).clean)


@query
def w11_priority_order(spark, sf_dir):
    return reports.priority_volume(view(spark, sf_dir, "tickets"))


@query
def s6_labelled_texts(spark, sf_dir):
    return read_labelled_texts(_raw(spark, sf_dir), "_row")


# Relational reports ---------------------------------------------------------------------------


@query
def a1_area(spark, sf_dir):
    return reports.tickets_by_area(view(spark, sf_dir, "tickets"), view(spark, sf_dir, "areas"))


@query
def j2_detail(spark, sf_dir):
    return reports.ticket_detail(
        *[view(spark, sf_dir, name) for name in ("tickets", "usuarios", "areas")]
    )


@query
def j3_param(spark, sf_dir):
    return reports.ticket_detail(
        *[view(spark, sf_dir, name) for name in ("tickets", "usuarios", "areas")], id_area=7
    )


@query
def a2_discrepancy(spark, sf_dir):
    return reports.reopen_discrepancy(
        *[view(spark, sf_dir, name) for name in ("tickets", "areas", "historial_estado")]
    )


@query
def p6_period(spark, sf_dir):
    start, end = F.lit(date(1997, 1, 31)), F.lit(date(1997, 3, 31))
    return reports.filter_period(_raw(spark, sf_dir), start, end).select("_row", "fecha_creacion")


@query
def p7_month_bounds(spark, sf_dir):
    day = F.col("fecha_creacion")
    first, last = month_bounds(F.year(day), F.month(day))
    return (
        view(spark, sf_dir, "tickets")
        .groupBy(first.alias("desde"), last.alias("hasta"))
        .agg(F.count("*").alias("tickets"))
    )


@query
def a7_area_legacy(spark, sf_dir):
    return reports.count_by_area(_raw(spark, sf_dir))


@query
def a8_reopen_now(spark, sf_dir):
    return reports.reopened_now(_raw(spark, sf_dir))


@query
def a9_monthly(spark, sf_dir):
    return reports.monthly_report(_raw(spark, sf_dir), 1997, 12)


@query
def a10_attention(spark, sf_dir):
    return reports.average_attention(_raw(spark, sf_dir), ["estado"])


@query
def x9_days(spark, sf_dir):
    dated = report_dates(_raw(spark, sf_dir), {"creado": "fecha_creacion"})
    return reports.attention_days(dated).select("_row", "dias_atencion", "creado")


# Requests -------------------------------------------------------------------------------------


@query
def p8_list(spark, sf_dir):
    page, _ = requests.list_requests(
        view(spark, sf_dir, "solicitudes"), {"area": " COMPRAS ", "estado": "abierto"}, 30, 20
    )
    return page.select("seq", "codigo", "area", "estado")


@query
def p8_total(spark, sf_dir):
    _, total = requests.list_requests(
        view(spark, sf_dir, "solicitudes"), {"categoria": "conectividad"}, 10_000, -3
    )
    return total


@query
def p9_lookup(spark, sf_dir):
    return requests.get_request(view(spark, sf_dir, "solicitudes"), " SOL-1000042 ")


@query
def p10_requests(spark, sf_dir):
    _, rejected = requests.validate_requests(view(spark, sf_dir, "solicitudes_crudas"))
    return rejected.select("seq", "campo")


@query
def p10_accepted(spark, sf_dir):
    accepted, _ = requests.validate_requests(view(spark, sf_dir, "solicitudes_crudas"))
    return accepted.select(
        "seq", "asunto", "descripcion", "area", "solicitante", "canal", "estado"
    )


@query
def p11_state(spark, sf_dir):
    changed = requests.change_state(
        view(spark, sf_dir, "solicitudes"), "SOL-1000042", "Escalado"
    )
    return changed.select("seq", "codigo", "estado")


@query
def p12_redact(spark, sf_dir):
    events = view(spark, sf_dir, "solicitudes_crudas").select(
        "seq", "asunto", "descripcion", "solicitante", "canal"
    )
    return metrics.redact_events(events)


@query
def p13_traces(spark, sf_dir):
    events = view(spark, sf_dir, "operaciones")
    kept = metrics.usable_trace(F.col("id_traza"))
    return events.select("seq", kept.alias("id_traza")).filter(F.col("id_traza").isNotNull())


@query
def p14_review(spark, sf_dir):
    return (
        requests.needs_review(view(spark, sf_dir, "solicitudes"))
        .groupBy("prioridad")
        .agg(F.count("*").alias("degradadas"))
    )


@query
def w13_numbering(spark, sf_dir):
    accepted, _ = requests.validate_requests(view(spark, sf_dir, "solicitudes_crudas"))
    return requests.number_requests(accepted, "seq", last_number=999_000).select(
        "seq", "numero", "codigo"
    )


@query
def x6_fingerprint(spark, sf_dir):
    raw = view(spark, sf_dir, "solicitudes_crudas")
    names = ("asunto", "descripcion", "area", "solicitante", "canal")
    return (
        raw.groupBy(fingerprint(**{name: F.col(name) for name in names}).alias("huella"))
        .agg(F.min("seq").alias("primera"), F.count("*").alias("veces"))
        .drop("huella")
    )


@query
def x7_keys(spark, sf_dir):
    key = idempotency_key(F.col("descripcion"))
    return view(spark, sf_dir, "solicitudes_crudas").select(
        "seq", key["clave"].alias("clave"), key["valida"].alias("valida")
    )


@query
def r1_intake_batch(spark, sf_dir):
    return intake.replay_intake(view(spark, sf_dir, "ingreso"))


# Classification -------------------------------------------------------------------------------


@query
def t2_rules(spark, sf_dir):
    return rules.classify_by_rules(view(spark, sf_dir, "documents"), F.col("text")).select(
        "doc_id", "categoria", "prioridad"
    )


@query
def t3_model_output(spark, sf_dir):
    return rules.validate_model_output(
        view(spark, sf_dir, "tickets_conversados"), view(spark, sf_dir, "respuestas_modelo")
    )


@query
def x3_json(spark, sf_dir):
    found = first_json_object(F.col("texto"))
    return view(spark, sf_dir, "respuestas_modelo").select(
        "ticket_id",
        *[found[name].alias(name) for name in ("categoria", "prioridad", "legible")],
    )


@query
def x8_title_body(spark, sf_dir):
    return view(spark, sf_dir, "tickets_conversados").select(
        "ticket_id",
        F.md5(title_and_body(F.col("asunto"), F.col("descripcion"))).alias("texto_md5"),
    )


def _labelled(spark, sf_dir):
    return view(spark, sf_dir, "textos_etiquetados")


@query
def a15_diversity(spark, sf_dir):
    return bayes.corpus_diversity(_labelled(spark, sf_dir))


@query
def a16_nb_model(spark, sf_dir):
    model = bayes.train_naive_bayes(_labelled(spark, sf_dir))
    return model.terms.withColumn("log_verosimilitud", F.round("log_verosimilitud", 6))


@query
def a16_nb_classes(spark, sf_dir):
    classes = bayes.train_naive_bayes(_labelled(spark, sf_dir)).classes
    return classes.withColumns(
        {name: F.round(name, 6) for name in ("log_previa", "log_desconocido")}
    )


@query
def w8_split_row(spark, sf_dir):
    return bayes.split_by_row(_labelled(spark, sf_dir), "doc_id", SEED).select(
        "doc_id", "particion"
    )


@query
def w8_split_group(spark, sf_dir):
    return bayes.split_by_group(_labelled(spark, sf_dir), "asunto", SEED).select(
        "doc_id", "particion"
    )


def _predictions(spark, sf_dir):
    """The test rows and their predictions by a model trained on the others; predicted once."""
    split = bayes.split_by_row(_labelled(spark, sf_dir), "doc_id", SEED)
    test = split.filter(F.col("particion") == bayes.TEST)

    def predicted() -> DataFrame:
        model = bayes.train_naive_bayes(split.filter(F.col("particion") == bayes.TRAIN))
        return bayes.predict_naive_bayes(test, model)

    return test, _once("predicciones", spark, sf_dir, predicted)


def _matrix(spark, sf_dir):
    test, predicted = _predictions(spark, sf_dir)
    pairs = test.select("doc_id", F.col("etiqueta").alias("real")).join(predicted, "doc_id")
    return evaluation.confusion_matrix(pairs)


@query
def w7_nb_predict(spark, sf_dir):
    return _predictions(spark, sf_dir)[1]


@query
def t7_routing(spark, sf_dir):
    _, doubtful = rules.route_by_margin(_predictions(spark, sf_dir)[1], MIN_MARGIN)
    return doubtful.select("doc_id", "prediccion")


@query
def a17_confusion(spark, sf_dir):
    return _matrix(spark, sf_dir)


@query
def a18_class_metrics(spark, sf_dir):
    return evaluation.class_metrics(_matrix(spark, sf_dir))


@query
def a19_accuracy(spark, sf_dir):
    return evaluation.accuracy(_matrix(spark, sf_dir))


@query
def a19_macro_f1(spark, sf_dir):
    return evaluation.macro_f1(evaluation.class_metrics(_matrix(spark, sf_dir)))


# Policies: fragments, retrieval, gates, evaluation --------------------------------------------


@query
def t1_chunks(spark, sf_dir):
    cut = chunks.chunk_sections(view(spark, sf_dir, "politicas"))
    return cut.select(
        "doc_id",
        F.concat_ws(".", "posicion.part", "posicion.piece").alias("posicion"),
        "documento",
        "titulo_documento",
        "version",
        "seccion",
        "titulo_seccion",
        "titulo_padre",
        F.md5("texto").alias("texto_md5"),
        F.length("texto").cast("bigint").alias("largo"),
        "corto",
    )


@query
def x5_headers(spark, sf_dir):
    header = document_header(chunks.plain_lines(F.col("text")), F.col("file_name"))
    return view(spark, sf_dir, "politicas").select(
        "doc_id",
        *[
            header[name].alias(name)
            for name in ("documento", "titulo_documento", "version")
        ],
    )


@query
def x10_search_text(spark, sf_dir):
    return chunks.fragments(view(spark, sf_dir, "politicas")).select(
        "doc_id", "cita", F.md5("texto_para_buscar").alias("texto_md5")
    )


@query
def s7_policy_texts(spark, sf_dir):
    return view(spark, sf_dir, "pages").select(
        "page_id", F.md5(chunks.plain_lines(F.col("html"))).alias("texto_md5")
    )


@query
def a24_ingest(spark, sf_dir):
    return chunks.ingestion_report(view(spark, sf_dir, "politicas"))


@query
def a20_idf(spark, sf_dir):
    counted = tfidf.term_counts(view(spark, sf_dir, "documents"), F.col("text"), "doc_id")
    return tfidf.fit_idf(counted).withColumn("idf", F.round("idf", 6))


@query
def a20_tfidf(spark, sf_dir):
    documents = view(spark, sf_dir, "documents")
    counted = materialize(tfidf.term_counts(documents, F.col("text"), "doc_id"))
    return tfidf.tfidf_weights(counted, "doc_id").withColumn("peso", F.round("peso", 4))


@query
def w5_topk(spark, sf_dir):
    documents = view(spark, sf_dir, "documents").withColumnRenamed("doc_id", "doc_key")
    corpus = stored(tfidf.term_counts(documents, F.col("text"), "doc_key"))
    found = tfidf.retrieve_top_k(_questions(spark, sf_dir), corpus)
    return found.withColumns(
        {"puntaje": F.round("puntaje", 4), "posicion": F.col("posicion").cast("bigint")}
    )


def _searchable(spark, sf_dir, of: DataFrame | None = None):
    """Fragments with a unique key that sorts like the citation; with ``of``, of its doc_ids only."""
    policies = view(spark, sf_dir, "politicas")
    if of is not None:
        policies = policies.join(small_dimension(of), "doc_id", "left_semi")
    place = F.concat_ws(".", "posicion.part", "posicion.piece")
    key = F.concat_ws("\u0001", "cita", F.col("doc_id").cast("string"), place)
    return chunks.fragments(policies).withColumn("doc_key", key)


def _fragment_terms(spark, sf_dir):
    """The index: term counts of every fragment, shared by all queries that retrieve."""
    return _shared(
        "fragmentos", spark, sf_dir,
        lambda: stored(
            tfidf.term_counts(_searchable(spark, sf_dir), F.col("texto_para_buscar"), "doc_key")
        ),
    )


def _questions(spark, sf_dir):
    return tfidf.term_counts(
        view(spark, sf_dir, "preguntas").withColumnRenamed("question_id", "query_id"),
        F.col("pregunta"),
        "query_id",
    )


def _cited(found):
    return found.select(
        F.col("query_id").alias("question_id"),
        F.split_part("doc_key", F.lit("\u0001"), F.lit(1)).alias("cita"),
        "puntaje",
        F.col("posicion").cast("bigint").alias("posicion"),
        "doc_key",
    )


def _retrieved(spark, sf_dir):
    """The five best fragments of every question, shared by the queries that read them."""
    return _once(
        "recuperados", spark, sf_dir,
        lambda: _cited(
            tfidf.retrieve_top_k(_questions(spark, sf_dir), _fragment_terms(spark, sf_dir))
        ),
    )


def _responses(spark, sf_dir, retrieved):
    """External answers: some cite what they were given, some invent, some do not cite, some fail."""
    first, second = (
        F.max(F.when(F.col("posicion") == i, F.col("cita"))).alias(f"cita{i}") for i in (1, 2)
    )
    given = retrieved.groupBy("question_id").agg(first, second)
    item = F.col("question_id")
    text = (
        F.when(item % 5 == 0, F.lit("NO_TENGO_EVIDENCIA"))
        .when(item % 5 == 1, F.lit(" Según POL-NADA-99 § 9 el plazo vence."))
        .when(item % 5 == 2, F.concat(F.lit("Ver "), "cita1", F.lit(" y POL-NADA-99 §9.")))
        .otherwise(
            F.concat(F.lit(" Según "), "cita1", F.lit(", "), "cita2", F.lit(" y "), "cita1")
        )
    )
    return given.select("question_id", (item % 7 != 6).alias("ok"), text.alias("texto"))


def _cases(spark, sf_dir, retrieved):
    """Labelled cases over the questions: unsupported ones, and expected citations."""
    second = retrieved.filter(F.col("posicion") == 2).select("question_id", "cita")
    item = F.col("question_id")
    code = F.get(F.split("cita", " §"), F.lit(0))
    section = F.get(F.split("cita", " §"), F.lit(1))
    backed = (item % 4 != 0) & (item % 3 != 0)
    rows = (
        view(spark, sf_dir, "preguntas")
        .join(second, "question_id", "left")
        .select(
            F.col("question_id").alias("id_caso"),
            F.col("pregunta").alias("pregunta_o_texto"),
            F.when(item % 4 == 0, evaluation.NO_SUPPORT)
            .when(item % 9 == 1, "Hardware")
            .otherwise("un plazo")
            .alias("respuesta_o_categoria_esperada"),
            F.when((item % 4 == 0) | (item % 9 == 1), "")
            .when(backed, F.concat(code, F.lit("_Plazos.pdf")))
            .otherwise("POL-NADA-01_Nada.pdf")
            .alias("documento_fuente"),
            F.when(backed, F.concat(section, F.lit(" y 9.9"))).otherwise("1")
            .alias("seccion_fuente"),
        )
    )
    return reference_cases(rows)


def _answers(spark, sf_dir, retrieved):
    return gates.gate_answers(
        view(spark, sf_dir, "preguntas"), retrieved, _responses(spark, sf_dir, retrieved)
    )


def _detail(spark, sf_dir):
    retrieved = _retrieved(spark, sf_dir)
    hits = evaluation.retrieval_hits(_cases(spark, sf_dir, retrieved), retrieved)
    return evaluation.case_detail(hits, _answers(spark, sf_dir, retrieved))


@query
def s5_reference_cases(spark, sf_dir):
    cases = _cases(spark, sf_dir, _retrieved(spark, sf_dir))
    return cases.select("id_caso", "esperado", "cita_esperada")


@query
def t4_gates(spark, sf_dir):
    answers = _answers(spark, sf_dir, _retrieved(spark, sf_dir))
    return answers.withColumns(
        {
            "citas": _flat("citas"),
            "fragmentos_consultados": _flat("fragmentos_consultados"),
            "mejor_puntaje": F.round("mejor_puntaje", 4),
        }
    )


@query
def t5_prompt(spark, sf_dir):
    retrieved = _retrieved(spark, sf_dir)
    cited = F.split_part("doc_key", F.lit("\u0001"), F.lit(2)).cast("bigint").alias("doc_id")
    texts = _searchable(spark, sf_dir, retrieved.select(cited).distinct()).select(
        "doc_key", "titulo_padre", "titulo_seccion", "texto"
    )
    prompts = gates.retrieval_prompt(texts.join(small_dimension(retrieved), "doc_key"))
    listing = F.element_at(F.split("instruccion", "\n\n", 2), 2)
    return prompts.select("question_id", F.md5(listing).alias("listado_md5"))


@query
def w12_invented(spark, sf_dir):
    retrieved = _retrieved(spark, sf_dir)
    delivered = retrieved.groupBy("question_id").agg(F.collect_set("cita").alias("entregadas"))
    joined = _responses(spark, sf_dir, retrieved).join(delivered, "question_id")
    return joined.select(
        "question_id",
        _flat(
            gates.invented_citations(citations(F.col("texto")), F.col("entregadas"))
        ).alias("inventadas"),
    )


@query
def x4_citations(spark, sf_dir):
    quoted = F.concat(
        F.lit("según POL-ADM-04 § 5.1, "), F.col("text"),
        F.lit(" POL-GTH-01 §"), (F.col("doc_id") % 120).cast("string"),
        F.lit(". POL-ADM-04 §5.1 y "), "source", F.lit("-POL §3"),
    )
    return view(spark, sf_dir, "documents").select(
        "doc_id", _flat(citations(quoted)).alias("citas")
    )


@query
def j7_hits(spark, sf_dir):
    retrieved = _retrieved(spark, sf_dir)
    hits = evaluation.retrieval_hits(_cases(spark, sf_dir, retrieved), retrieved)
    return hits.select(
        "id_caso", F.round("mejor", 4).alias("mejor"), "recuperada", "posicion"
    )


@query
def a21_evaluate(spark, sf_dir):
    return evaluation.evaluate(_detail(spark, sf_dir))


@query
def a21_detail(spark, sf_dir):
    return _detail(spark, sf_dir).withColumn("citas", _flat("citas"))


@query
def a22_thresholds(spark, sf_dir):
    return evaluation.check_thresholds(evaluation.evaluate(_detail(spark, sf_dir)), True)


@query
def a23_sweep(spark, sf_dir):
    retrieved = _retrieved(spark, sf_dir)
    hits = evaluation.retrieval_hits(_cases(spark, sf_dir, retrieved), retrieved)
    return evaluation.threshold_sweep(hits)


@query
def a23_chosen(spark, sf_dir):
    retrieved = _retrieved(spark, sf_dir)
    hits = evaluation.retrieval_hits(_cases(spark, sf_dir, retrieved), retrieved)
    return evaluation.chosen_threshold(evaluation.threshold_sweep(hits))


# Operations -----------------------------------------------------------------------------------


def _operations(spark, sf_dir):
    return view(spark, sf_dir, "operaciones")


@query
def w3_last_n(spark, sf_dir):
    return metrics.last_samples(_operations(spark, sf_dir), "operacion", "seq").select(
        "operacion", "seq"
    )


@query
def a11_latency(spark, sf_dir):
    return metrics.latency_summary(_operations(spark, sf_dir))


@query
def a12_rates(spark, sf_dir):
    return metrics.rates_by_origin(_operations(spark, sf_dir), "degradado", ["operacion"])


@query
def a12_motives(spark, sf_dir):
    return metrics.motives(_operations(spark, sf_dir), ["operacion"])


@query
def a13_tokens(spark, sf_dir):
    return metrics.token_usage(_operations(spark, sf_dir))


@query
def a14_cost(spark, sf_dir):
    prices = spark.createDataFrame(
        PRICES, "proveedor string, precio_entrada double, precio_salida double"
    )
    return metrics.cost_projection(
        metrics.token_usage(_operations(spark, sf_dir)), prices, CALLS_PER_MONTH
    )


@query
def r2_metrics_batch(spark, sf_dir):
    return window_counts(_operations(spark, sf_dir)).withColumn(
        "desde", F.date_format("desde", "yyyy-MM-dd HH:mm:ss")
    )


def _due(spark, sf_dir):
    changed = reminders.last_change(
        view(spark, sf_dir, "tickets"), view(spark, sf_dir, "historial_estado")
    )
    return reminders.due_reminders(changed, TODAY, HOLIDAYS)


@query
def w9_business_days(spark, sf_dir):
    return _due(spark, sf_dir).select("id_ticket", "dias_habiles", "tipo")


@query
def w9_site_calendars(spark, sf_dir):
    """Ageing by the calendar of the site that a ticket's area belongs to."""
    changed = reminders.last_change(
        view(spark, sf_dir, "tickets"), view(spark, sf_dir, "historial_estado"), "id_area"
    )
    sites = small_dimension(view(spark, sf_dir, "areas").select("id_area", "sede"))
    due = reminders.due_by_site(changed.join(sites, "id_area"), view(spark, sf_dir, "festivos"), TODAY)
    return due.select("id_ticket", "sede", "dias_habiles", "tipo")


@query
def r2_sessions_batch(spark, sf_dir):
    return _session_times(metrics.sessions(_operations(spark, sf_dir), SESSION_GAP))


def _session_times(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss.SSSSSS") for n in ("desde", "hasta")})


@query
def j5_reminders(spark, sf_dir):
    due = _due(spark, sf_dir)
    sent = due.filter(F.col("id_ticket") % 3 == 0)
    return reminders.not_yet_sent(due, sent).select("id_ticket", "codigo", "tipo", "fecha")
