import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ticketlake.functions.citations import citations
from ticketlake.functions.text import tokens
from ticketlake.operators import bayes, chunks, evaluation, gates, rules, tfidf

POLICY = (
    "Política de Vacaciones\n"
    "Empresa · Código POL-GTH-01 · Versión 3 · Vigente desde el 1 de febrero\n"
    "1. Objeto y alcance\n"
    "Regular la solicitud y el disfrute de las vacaciones.\n"
    "2. Causación\n"
    "Cada colaborador causa quince (15) días   hábiles por año.\n"
    "3. Solicitud y aprobación\n"
    " 3.1. La solicitud debe radicarse con quince (15) días de anticipación.\n"
    "\x7f3.2. La aprobación corresponde al jefe inmediato.\n"
    "1 al 20 de enero y 1 al 15 de julio\n15. \n"
)


def test_chunks(spark):
    docs = spark.createDataFrame(
        [("a", "fa", POLICY), ("b", "fb", "Solo prosa.\n"), ("c", "fc", ""),
         ("d", "fd", " 2.1. Una subsección suelta sin padre\n")],
        "doc_id string, file_name string, text string",
    )
    rows = chunks.chunk_sections(docs).orderBy("doc_id", "posicion").collect()
    got = [(r.doc_id, r.seccion, r.titulo_seccion, r.titulo_padre, r.texto, r.corto) for r in rows]
    parent = "Solicitud y aprobación"
    assert got == [
        ("a", "1", "Objeto y alcance", "", "Regular la solicitud y el disfrute de las vacaciones.", False),
        ("a", "2", "Causación", "", "Cada colaborador causa quince (15) días hábiles por año.", False),
        ("a", "3", parent, "", "", True),
        ("a", "3.1", "", parent, "La solicitud debe radicarse con quince (15) días de anticipación.", False),
        ("a", "3.2", "", parent,
         "La aprobación corresponde al jefe inmediato. 1 al 20 de enero y 1 al 15 de julio 15.", False),
        ("d", "2.1", "", "", "Una subsección suelta sin padre", False),
    ]
    assert {(r.documento, r.titulo_documento, r.version) for r in rows if r.doc_id == "a"} == {
        ("POL-GTH-01", "Política de Vacaciones", "3")
    }
    assert [(r.documento, r.version) for r in rows if r.doc_id == "d"] == [("fd", "sin versión")]
    searchable = chunks.fragments(docs).filter("cita = 'POL-GTH-01 §3.1'").head()
    assert searchable.texto_para_buscar.startswith("Solicitud y aprobación La solicitud")
    report = chunks.ingestion_report(docs).head()
    assert tuple(report) == (4, 5, 1, 0)


def test_tokens_and_citations(spark):
    df = spark.createDataFrame(
        [("¿Cuál es la ANTICIPACIÓN de 15 días? ñu x",), (None,)], "t string"
    )
    assert [r[0] for r in df.select(tokens(F.col("t"))).collect()] == [
        ["anticipacion", "15", "dias", "nu"], [],
    ]
    texts = {
        "POL-GTH-01 §3.1": ["POL-GTH-01 §3.1"], "según POL-ADM-04 § 5.1 el plazo": ["POL-ADM-04 §5.1"],
        "POL-GTH-01 §3.1 y POL-GTH-01 §3.1": ["POL-GTH-01 §3.1"], "sin cita": [],
        "POL-GTH-01 sin seccion": [], "§3.1 sin documento": [],
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(citations(F.col("t"))).collect()] == list(texts.values())


CORPUS = {
    "d1": "vacaciones vacaciones anticipacion", "d2": "viaticos hotel hotel vacaciones",
    "d3": "", "d4": "hardware portatil red", "d5": "vacaciones vacaciones anticipacion",
}
QUERIES = {"q1": "vacaciones hotel", "q2": "nada conocido", "q3": "red"}


def cosine_table():
    terms = {d: Counter(t.split()) for d, t in CORPUS.items()}
    df = Counter(w for c in terms.values() for w in c)
    idf = {w: math.log((1 + len(CORPUS)) / (1 + n)) + 1 for w, n in df.items()}

    def vector(counts):
        weights = {w: (1 + math.log(n)) * idf[w] for w, n in counts.items() if w in idf}
        norm = math.sqrt(sum(x * x for x in weights.values()))
        return {w: x / norm for w, x in weights.items()}

    docs = {d: vector(c) for d, c in terms.items()}
    for name, text in QUERIES.items():
        q = vector(Counter(text.split()))
        scores = {d: round(sum(x * v.get(w, 0) for w, x in q.items()), 9) for d, v in docs.items()}
        yield name, sorted(scores.items(), key=lambda s: (-s[1], s[0]))


@pytest.mark.parametrize("k", [0, 1, 2, 5, 9])
def test_top_k(spark, k):
    corpus = tfidf.term_counts(
        spark.createDataFrame(list(CORPUS.items()), "doc_key string, t string"), F.col("t"), "doc_key"
    )
    queries = tfidf.term_counts(
        spark.createDataFrame(list(QUERIES.items()), "query_id string, t string"), F.col("t"), "query_id"
    )
    found = tfidf.retrieve_top_k(queries, corpus, k).orderBy("query_id", "posicion").collect()
    expected = [(q, d, s) for q, ranked in cosine_table() for d, s in ranked[:k]]
    assert [(r.query_id, r.doc_key, round(r.puntaje, 6)) for r in found] == [
        (q, d, round(s, 6)) for q, d, s in expected
    ]


TRAINING = [
    ("no enciende portatil", "Hardware"), ("portatil danado", "Hardware"),
    ("impresora atascada portatil", "Hardware"), ("clave vencida", "Accesos"),
    ("usuario bloqueado clave", "Accesos"),
]


def test_naive_bayes(spark):
    counts, docs = defaultdict(Counter), Counter()
    for text, label in TRAINING:
        words = [w for w in text.split() if w != "no"]
        counts[label].update(words)
        docs[label] += 1
    vocabulary = {w for c in counts.values() for w in c}

    def predict(text):
        scores = []
        for label in sorted(docs):
            total = sum(counts[label].values()) + len(vocabulary)
            score = math.log(docs[label] / len(TRAINING)) + sum(
                math.log((counts[label][w] + 1) / total) for w in text.split() if w in vocabulary
            )
            scores.append((score, label))
        scores.sort(reverse=True)
        return scores[0][1], round(scores[0][0] - scores[1][0], 4)

    model = bayes.train_naive_bayes(spark.createDataFrame(TRAINING, "texto string, etiqueta string"))
    texts = ["portatil portatil clave", "clave bloqueado", "desconocido", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, texto string")
    for hot_rows in (10**9, 0):
        got = bayes.predict_naive_bayes(df, model, hot_rows=hot_rows).orderBy("doc_id").collect()
        assert [(r.prediccion, r.margen) for r in got] == [predict(t) for t in texts]


def test_one_class_is_an_error(spark):
    model = bayes.train_naive_bayes(spark.createDataFrame([("a b", "X")], "texto string, etiqueta string"))
    with pytest.raises(Exception, match="two classes"):
        model.classes.collect()


@pytest.mark.parametrize("n", [1, 5, 37])
def test_split_sizes(spark, n):
    df = spark.createDataFrame([(i, f"g{i % 7}") for i in range(n)], "k int, g string")
    assert bayes.split_by_row(df, "k", 7).filter("particion = 'entrenamiento'").count() == int(n * 0.8)
    sides = bayes.split_by_group(df, "g", 7).groupBy("g").agg(F.count_distinct("particion").alias("n"))
    assert {r.n for r in sides.collect()} == {1}


def test_rules_order_and_substrings(spark):
    texts = {
        "me quedé sin contraseña": ("Accesos", "Media"), "permiso remunerado": ("Accesos", "Media"),
        "quedó acreditado": ("Red", "Media"), "URGENTE: no puedo entrar": ("Incidentes", "Alta"),
        "pago de NOMINA": ("Nómina", "Media"), "hola": ("Otros", "Media"), "": ("Otros", "Media"),
    }
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = rules.classify_by_rules(df, F.col("t")).orderBy("i").collect()
    assert [(r.categoria, r.prioridad) for r in got] == list(texts.values())


def test_gates(spark):
    questions = spark.createDataFrame(
        [(i, "¿plazo?") for i in range(7)] + [(7, "  "), (8, "sin lista")],
        "question_id int, pregunta string",
    )
    score = {0: 0.2, 1: 0.19999, 2: 0.5, 3: 0.5, 4: 0.5, 5: 0.5, 6: 0.5}
    retrieved = spark.createDataFrame(
        [(q, f"POL-AA-0{q} §{p}", s if p == 1 else 0.0, p) for q, s in score.items() for p in (1, 2)],
        "question_id int, cita string, puntaje double, posicion int",
    )
    responses = spark.createDataFrame(
        [(0, True, " Va POL-AA-00 § 1. "), (1, True, "POL-AA-01 §1"), (2, False, "POL-AA-02 §1"),
         (3, True, "NO_TENGO_EVIDENCIA"), (4, True, "POL-AA-04 §1 y POL-AA-99 §1"), (6, True, "POL-AA-06 §2")],
        "question_id int, ok boolean, texto string",
    )
    got = gates.gate_answers(questions, retrieved, responses).orderBy("question_id").collect()
    assert [r.motivo for r in got] == [
        None, "sin_evidencia_suficiente", "proveedor_no_disponible", "respuesta_sin_cita_verificable",
        "cita_fuera_de_los_fragmentos_recuperados", "proveedor_no_disponible", None, "consulta_vacia",
        "sin_evidencia_suficiente",
    ]
    assert (got[0].texto, got[0].citas, got[0].origen) == ("Va POL-AA-00 § 1.", ["POL-AA-00 §1"], "modelo")
    assert got[7].fragmentos_consultados == [] and got[7].mejor_puntaje == 0.0


@pytest.mark.parametrize(
    ("recovered", "escalated", "unmet"),
    [(9, 2, []), (8, 0, ["recall"]), (10, 3, ["escalamiento"])],
)
def test_threshold_edges(spark, recovered, escalated, unmet):
    result = spark.createDataFrame(
        [(10, 4, recovered, 4, 0, escalated)],
        "con_respaldo long, sin_respaldo long, recuperados long, abstenciones_correctas long, "
        "respuestas_sin_cita long, escalamientos long",
    )
    assert [r.condicion for r in evaluation.check_thresholds(result, True).collect()] == unmet
