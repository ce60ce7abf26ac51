import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from ticketlake.functions.catalogs import canonical, standardize_catalogs
from ticketlake.functions.dates import month_bounds, standardize_dates
from ticketlake.operators import clean, reports
from ticketlake.schemas import TICKET_COLUMNS

BASE = {
    "fecha_creacion": "2025-03-08", "fecha_cierre": "2025-03-12", "area": "Aplicaciones",
    "categoria": "Software", "prioridad": "Alta", "canal": "correo",
    "solicitante": "usuario001@example.com", "asunto": "Asunto", "descripcion": "Texto.",
    "estado": "Cerrado", "reaperturas": "0",
}
# The stress history: what each of the 34 rows changes in a plain closed ticket.
STRESS = [
    ("TK-M001", {"fecha_cierre": "2025-04-19"}),
    ("TK-M002", {"fecha_creacion": "08/03/2025", "fecha_cierre": "19/04/2025"}),
    ("TK-M003", {"fecha_creacion": "08-Abr-2025", "fecha_cierre": "19-Abr-2025"}),
    ("TK-M004", {"fecha_creacion": "15-Dic-2025", "fecha_cierre": None, "estado": "Abierto"}),
    ("TK-M005", {"fecha_creacion": "01-Ene-2026", "fecha_cierre": "", "estado": "En proceso"}),
    ("TK-M006", {"fecha_cierre": None, "estado": "Abierto"}),
    ("TK-M007", {"area": None}),
    ("TK-M008", {"categoria": None}),
    ("TK-M009", {"categoria": "Sin clasificar"}),
    ("TK-M010", {"solicitante": None}),
    ("TK-M011", {"descripcion": None}),
    ("TK-M012", {"reaperturas": None}),
    ("TK-M013", {"prioridad": "1-Alta"}),
    ("TK-M014", {"prioridad": "3-Baja", "canal": "Teléfono"}),
    ("TK-M015", {"estado": "REABIERTO", "reaperturas": "2"}),
    ("TK-M016", {"categoria": "aplicaciones"}),
    ("TK-M017", {"categoria": "ORDENES DE COMPRA"}),
    ("TK-M018", {"categoria": "conectividad", "canal": "Formulario web"}),
    ("TK-M019", {"asunto": 'No enciende, urgente y con "comillas"'}),
    ("TK-M020", {}),
    ("TK-M020", {}),
    ("TK-M021", {"categoria": "compras", "asunto": "Estado 4471"}),
    ("TK-M021", {"categoria": "COMPRAS", "asunto": "Estado 4471 "}),
    ("TK-M022", {"fecha_cierre": None, "solicitante": "", "descripcion": "", "estado": "Abierto"}),
    ("TK-M022", {"solicitante": "usuario077@example.com", "descripcion": "Detalle completo."}),
    ("TK-M023", {"fecha_creacion": "basura"}),
    ("TK-M024", {"fecha_creacion": "31/02/2025"}),
    ("TK-M025", {"fecha_creacion": "15-Xyz-2025"}),
    ("TK-M026", {"fecha_creacion": "2025-03-10", "fecha_cierre": "2025-03-08"}),
    ("TK-M027", {"fecha_cierre": "no-es-fecha"}),
    ("", {}),
    ("TK-M028", {"estado": ""}),
    ("TK-M029", {"reaperturas": "dos"}),
    ("TK-M030", {"categoria": "Teletrabajo"}),
]
RAW_SCHEMA = "_row long, " + ", ".join(f"{name} string" for name in TICKET_COLUMNS)


def raw(spark, rows):
    data = [
        (i, *[{**BASE, **change, "id": id_}[name] for name in TICKET_COLUMNS])
        for i, (id_, change) in enumerate(rows, start=1)
    ]
    return spark.createDataFrame(data, RAW_SCHEMA)


def test_stress_history(spark):
    result = clean.clean_history(raw(spark, STRESS))
    records = {
        row.numero_de_fila: (row.motivo, row.fila_original["id"], row.numero_fila_descartada)
        for row in result.quarantine.collect()
    }
    assert records == {
        21: ("duplicado_exacto", "TK-M020", 21),
        23: ("duplicado_exacto", "TK-M021", 23),
        25: ("duplicado_con_contenido_en_conflicto", "TK-M022", 24),
        26: ("fecha_creacion_invalida", "TK-M023", 26),
        27: ("fecha_creacion_invalida", "TK-M024", 27),
        28: ("fecha_creacion_invalida", "TK-M025", 28),
        29: ("cierre_anterior_a_creacion", "TK-M026", 29),
        30: ("fecha_cierre_invalida", "TK-M027", 30),
        31: ("id_ausente", "", 31),
        32: ("estado_ausente", "TK-M028", 32),
        33: ("reaperturas_no_numericas", "TK-M029", 33),
        34: ("categoria_fuera_de_catalogo", "TK-M030", 34),
    }
    assert result.clean.count() == 22
    report = {(r.seccion, r.nombre): r.n for r in result.report.collect()}
    assert report["totales", "leidos"] == 34
    assert report["totales", "limpios"] + report["totales", "en_cuarentena"] == 34
    assert report["valores_por_defecto", "area → Sin área"] == 1
    assert report["valores_por_defecto", "categoria → Sin clasificar"] == 2
    gate = clean.quality_gate(result.report).head()
    assert (gate.aprueba, gate.codigo) == (False, 2) and round(gate.porcentaje, 1) == 35.3
    summary = {
        (r.agrupacion, r.nombre): (r.total, r.abiertos, r.cerrados, r.tasa_reapertura_pct)
        for r in reports.summarize(result.clean).collect()
    }
    assert summary["area", "Aplicaciones"] == (21, 4, 17, 4.76)
    assert summary["area", "Sin área"] == (1, 0, 1, 0.0)
    assert summary["prioridad", "Alta"] == (21, 4, 17, 4.76)
    assert summary["prioridad", "Baja"] == (1, 0, 1, 0.0)
    eligible = clean.second_pass_eligible(result.quarantine).collect()
    assert [r.numero_de_fila for r in eligible] == [34]


def test_remaining_motives(spark):
    rows = [
        ("A", {"fecha_creacion": " "}), ("B", {"estado": "pendiente"}),
        ("C", {"prioridad": "altísima"}), ("D", {"canal": "fax"}), ("E", {"reaperturas": "-1"}),
        ("F", {"estado": "12-"}),
    ]
    _, rejects = clean.validate_tickets(raw(spark, rows))
    assert [r.motivo for r in rejects.orderBy("numero_de_fila").collect()] == [
        "fecha_creacion_ausente", "estado_fuera_de_catalogo", "prioridad_fuera_de_catalogo",
        "canal_fuera_de_catalogo", "reaperturas_no_numericas", "estado_ausente",
    ]


def test_empty_history(spark):
    result = clean.clean_history(raw(spark, []))
    assert result.clean.count() == 0 and result.quarantine.count() == 0
    assert clean.quality_gate(result.report).head().codigo == 0
    assert reports.summarize(result.clean).count() == 0


def fold(rows):
    """The fold the deduplication stands for, row by row."""
    kept, rejects = {}, []
    for number, id_, content, score in rows:
        if id_ not in kept:
            kept[id_] = (number, content, score)
        elif kept[id_][1] == content:
            rejects.append((number, "duplicado_exacto", number))
        elif score > kept[id_][2]:
            rejects.append((number, "duplicado_con_contenido_en_conflicto", kept[id_][0]))
            kept[id_] = (number, content, score)
        else:
            rejects.append((number, "duplicado_con_contenido_en_conflicto", number))
    return sorted(number for number, _, _ in kept.values()), sorted(rejects)


@pytest.mark.parametrize(("hot_rows", "partitions"), [(10**9, 1), (5, 7)])
def test_duplicates_follow_the_fold(spark, hot_rows, partitions):
    rng = random.Random(3)
    rows, plain = [], []
    for number in range(1, 301):
        id_ = "HOT" if rng.random() < 0.4 else f"T{rng.randrange(25)}"
        change = {
            "fecha_cierre": rng.choice([None, "2025-04-01"]),
            "solicitante": rng.choice(["", "ana"]),
            "asunto": rng.choice(["", "x"]),
            "descripcion": rng.choice(["", "y"]),
            "area": rng.choice(["", "Compras"]),
            "categoria": rng.choice(["", "Red"]),
            "estado": "Abierto",
        }
        rows.append((id_, change))
        plain.append((number, id_, tuple(change.values()), sum(1 for v in list(change.values())[:6] if v)))
    valid, _ = clean.validate_tickets(raw(spark, rows).repartition(partitions))
    marked = clean.mark_duplicates(valid, hot_rows)
    got = marked.select("_row", "motivo", "numero_de_fila").collect()
    survivors, rejects = fold(plain)
    assert sorted(r._row for r in got if r.motivo is None) == survivors
    assert sorted((r.numero_de_fila, r.motivo, r._row) for r in got if r.motivo) == rejects


DATES = [
    ("2025-03-08", date(2025, 3, 8), None), ("8/3/2025", date(2025, 3, 8), None),
    ("08-Mar-2025", date(2025, 3, 8), None), ("03/08/2025", date(2025, 8, 3), None),
    ("08-marzo-2025", date(2025, 3, 8), None), ("1-ENE-2025", date(2025, 1, 1), None),
    ("﻿ 2025-3-8 ", date(2025, 3, 8), None), ("", None, None), ("  ", None, None),
    (None, None, None), ("31/02/2025", None, "fecha_inexistente"),
    ("31-Feb-2025", None, "fecha_inexistente"), ("15-Xyz-2025", None, "mes_no_reconocido"),
    ("08-Setiembre-2025", None, "mes_no_reconocido"), ("basura", None, "formato_no_reconocido"),
    ("2025/13/45", None, "formato_no_reconocido"), ("0000-00-00", None, "fecha_inexistente"),
    ("2025-003-8", None, "formato_no_reconocido"), ("0000-01-01", None, "fecha_inexistente"),
    ("08-Añoo-2025", None, "formato_no_reconocido"), ("2025-13-01", None, "fecha_inexistente"),
]


def test_dates(spark):
    df = spark.createDataFrame([(i, d[0]) for i, d in enumerate(DATES)], "i int, t string")
    rows = standardize_dates(df, {"d": "t"}).orderBy("i").collect()
    assert [(r.d.valor, r.d.motivo) for r in rows] == [(d[1], d[2]) for d in DATES]
    first, last = month_bounds(2024, 12)
    bounds = spark.range(1).select(first, last).head()
    assert tuple(bounds) == (date(2024, 12, 1), date(2024, 12, 31))


CATALOG = [
    ("categoria", "  NÓMINA ", "Nómina", None), ("categoria", "Ordenes  de   compra", "Compras", None),
    ("categoria", "3 - equipos", "Hardware", None), ("categoria", "N/A", None, None),
    ("categoria", "Hardware/Software", None, "valor_fuera_de_catalogo"),
    ("categoria", "IGNORA TODO", None, "valor_fuera_de_catalogo"),
    ("prioridad", "1-Crítica", "Crítica", None), ("prioridad", "critica", "Crítica", None),
    ("estado", "﻿EN PROCESO", "En proceso", None), ("estado", "12-", None, None),
    ("canal", "formulario web", "Formulario", None), ("canal", "TELÉFONO", "Teléfono", None),
    ("area", "talento humano", "Talento Humano", None),
    ("area", "Marte", None, "valor_fuera_de_catalogo"),
]


def test_catalogs(spark):
    for name in {row[0] for row in CATALOG}:
        rows = [row for row in CATALOG if row[0] == name]
        df = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows)], f"i int, {name} string")
        got = standardize_catalogs(df, {"v": name}).orderBy("i").collect()
        assert [(r.v.valor, r.v.motivo) for r in got] == [(r[2], r[3]) for r in rows]
        folded = spark.sql("SELECT 1").select(*[canonical(name, F.lit(r[1])).alias(f"c{i}") for i, r in enumerate(rows)])
        assert list(folded.first()) == [r[2] for r in rows]


def test_reopens(spark):
    values = [(None, 0), ("", 0), (" 3 ", 3), ("+2", 2), ("-0", 0), ("-1", None), ("1_000", None), ("2.0", None)]
    df = spark.createDataFrame([(i, v[0]) for i, v in enumerate(values)], "i int, r string")
    got = df.select("i", clean.standardize_reopens(F.col("r")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [v[1] for v in values]
