"""Help-desk inputs derived from the star-schema tables.

Each view is one statement in the SQL both Spark and a checking engine read. ``{name}`` refers to
a source table or to another view. The derived histories are dirty on purpose: spellings, blanks,
impossible dates, unknown values and duplicates depend on the order key.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_DAY = "CAST(o_orderdate AS DATE)"


def _iso(day: str) -> str:
    return (
        f"CAST(year({day}) AS STRING) || '-' || lpad(CAST(month({day}) AS STRING), 2, '0')"
        f" || '-' || lpad(CAST(day({day}) AS STRING), 2, '0')"
    )


def _slash(day: str) -> str:
    return (
        f"lpad(CAST(day({day}) AS STRING), 2, '0') || '/' || CAST(month({day}) AS STRING)"
        f" || '/' || CAST(year({day}) AS STRING)"
    )


def _named(day: str) -> str:
    months = "EneFebMarAbrMayJunJulAgoSepOctNovDic"
    return (
        f"lpad(CAST(day({day}) AS STRING), 2, '0') || '-' || "
        f"substr('{months}', CAST(month({day}) * 3 - 2 AS INT), 3) || '-' || "
        f"CAST(year({day}) AS STRING)"
    )


def _written(day: str) -> str:
    return (
        f"CASE o_orderkey % 3 WHEN 0 THEN {_iso(day)} WHEN 1 THEN {_slash(day)} "
        f"ELSE {_named(day)} END"
    )


_CLOSED_DAY = f"({_DAY} + CAST(o_orderkey % 40 AS INT))"
_TOO_EARLY = f"({_DAY} - 3)"

VIEWS = {
    "areas": """
        SELECT n_nationkey AS id_area, n_name AS nombre, r_name AS sede
        FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "usuarios": """
        SELECT c_custkey AS id_usuario, c_name AS nombre,
               lower(c_name) || '@example.com' AS correo, c_nationkey AS id_area
        FROM {customer}""",
    "tickets": f"""
        SELECT o_orderkey AS id_ticket, 'TK-' || CAST(o_orderkey AS STRING) AS codigo,
               CAST(o_orderkey % 25 AS INT) AS id_area, o_custkey AS id_usuario,
               CASE o_orderstatus WHEN 'F' THEN 'Cerrado' WHEN 'P' THEN 'En proceso'
                    ELSE 'Abierto' END AS estado,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Crítica' WHEN '2' THEN 'Alta'
                    WHEN '3' THEN 'Media' WHEN '5' THEN 'Baja' ELSE 'Sin prioridad' END
                    AS prioridad,
               CASE o_orderkey % 4 WHEN 0 THEN 'Red' WHEN 1 THEN 'Software'
                    WHEN 2 THEN 'Accesos' ELSE 'Otros' END AS categoria,
               {_DAY} AS fecha_creacion,
               CAST(o_orderkey % 3 AS BIGINT) AS reaperturas
        FROM {{orders}}""",
    "historial_estado": """
        SELECT l_orderkey * 10 + l_linenumber AS id_historial, l_orderkey AS id_ticket,
               CASE l_returnflag WHEN 'R' THEN 'Reabierto' WHEN 'A' THEN 'Cerrado'
                    ELSE 'En proceso' END AS estado_nuevo,
               CAST(l_shipdate AS DATE) AS fecha_cambio
        FROM {lineitem}""",
    # Holidays of each site; weekends and repeats among them.
    "festivos": f"""
        SELECT sede, {_DAY} AS dia FROM {{orders}} JOIN {{areas}} ON o_orderkey % 25 = id_area
        WHERE o_orderkey % 41 = 3""",
    "capturas": f"""
        SELECT o_orderkey AS k, o_orderkey * 4 + 1 AS _row,
               CASE WHEN o_orderkey % 97 = 0 THEN '  '
                    ELSE 'TK-' || CAST(o_orderkey AS STRING) END AS id,
               CASE WHEN o_orderkey % 101 = 0 THEN '' WHEN o_orderkey % 89 = 0 THEN 'basura'
                    WHEN o_orderkey % 83 = 0 THEN '31/02/2025'
                    WHEN o_orderkey % 79 = 0 THEN '15-Xyz-2025'
                    WHEN o_orderkey % 73 = 0 THEN ' 8-marzo-2025 '
                    ELSE {_written(_DAY)} END AS fecha_creacion,
               CASE WHEN o_orderstatus = 'O' THEN NULL
                    WHEN o_orderkey % 107 = 0 THEN 'no-es-fecha'
                    WHEN o_orderkey % 61 = 0 THEN {_written(_TOO_EARLY)}
                    ELSE {_written(_CLOSED_DAY)} END AS fecha_cierre,
               CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN ' Aplicaciones '
                    WHEN 2 THEN 'Infraestructura' WHEN 3 THEN 'Talento Humano'
                    WHEN 4 THEN 'Contabilidad' WHEN 5 THEN 'Compras' WHEN 6 THEN 'Comercial'
                    WHEN 7 THEN 'Operaciones' ELSE 'Calidad' END AS area,
               CASE WHEN o_orderkey % 103 = 0 THEN 'Teletrabajo'
                    ELSE CASE o_orderkey % 11 WHEN 0 THEN 'SOFTWARE' WHEN 1 THEN 'nómina'
                    WHEN 2 THEN 'NOMINA ' WHEN 3 THEN 'Ordenes  de compra' WHEN 4 THEN 'viáticos'
                    WHEN 5 THEN 'Sin clasificar' WHEN 6 THEN NULL WHEN 7 THEN 'conectividad'
                    WHEN 8 THEN 'n/a' WHEN 9 THEN '3 - Equipos' ELSE 'Capacitación' END
                    END AS categoria,
               CASE WHEN o_orderkey % 117 = 0 THEN 'altísima'
                    ELSE CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '1-Crítica'
                    WHEN '2' THEN 'ALTA' WHEN '3' THEN '2 - media' WHEN '5' THEN 'baja'
                    ELSE '' END END AS prioridad,
               CASE WHEN o_orderkey % 109 = 0 THEN 'fax'
                    ELSE CASE o_orderkey % 5 WHEN 0 THEN 'correo' WHEN 1 THEN 'Teléfono'
                    WHEN 2 THEN 'FORMULARIO WEB' WHEN 3 THEN NULL ELSE 'Mesa  de ayuda' END
                    END AS canal,
               CASE WHEN o_orderkey % 13 = 0 THEN ''
                    ELSE ' usuario' || CAST(o_custkey AS STRING) || '@example.com' END
                    AS solicitante,
               'Asunto   número ' || CAST(o_orderkey % 50 AS STRING) || ' ' AS asunto,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL
                    ELSE '  Pedido de ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)
                    END AS descripcion,
               CASE WHEN o_orderkey % 113 = 0 THEN '' WHEN o_orderkey % 127 = 0 THEN 'pendiente'
                    WHEN o_orderkey % 8 = 0 THEN 'REABIERTO'
                    ELSE CASE o_orderstatus WHEN 'F' THEN 'CERRADO ' WHEN 'O' THEN 'abierto'
                    ELSE 'En  Proceso' END END AS estado,
               CASE WHEN o_orderkey % 131 = 0 THEN 'dos' WHEN o_orderkey % 137 = 0 THEN '-1'
                    WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_orderkey % 3 AS STRING) END
                    AS reaperturas
        FROM {{orders}}""",
    # Repeats: an identical capture that differs in case and blanks, a poorer or richer capture,
    # and a third one, so that ids go through every kind of duplicate. One id out of the whole
    # history repeats a share of all rows.
    "tickets_crudos": """
        SELECT * FROM {capturas}
        UNION ALL
        SELECT k, _row + 1, id || ' ', fecha_creacion, fecha_cierre, area, upper(categoria),
               lower(prioridad), canal, solicitante || '  ', asunto, descripcion, estado,
               reaperturas
        FROM {capturas} WHERE k % 10 = 0
        UNION ALL
        SELECT k, _row + 2, id, fecha_creacion, fecha_cierre, area, 'Red', prioridad, canal,
               'relevo@example.com', asunto, 'Detalle  completo', estado, reaperturas
        FROM {capturas} WHERE k % 14 = 0
        UNION ALL
        SELECT k, _row + 3, id, fecha_creacion, fecha_cierre, '', '', prioridad, canal,
               '', asunto, '', estado, reaperturas
        FROM {capturas} WHERE k % 35 = 0
        UNION ALL
        SELECT k, _row + 3, 'TK-REPETIDO', fecha_creacion, fecha_cierre, area, categoria,
               prioridad, canal, solicitante, asunto, descripcion, estado, reaperturas
        FROM {capturas} WHERE k % 6 = 1 AND k % 35 <> 0""",
    "textos_etiquetados": """
        SELECT doc_id, text AS texto, lang AS etiqueta, text AS asunto
        FROM {documents}""",
    "solicitudes_crudas": """
        SELECT event_id AS seq, ts AS fecha_creacion,
               CASE WHEN event_id % 37 = 0 THEN '  ' WHEN event_id % 41 = 0 THEN repeat('x', 201)
                    ELSE '  Solicitud ' || event_type END AS asunto,
               CASE WHEN event_id % 43 = 0 THEN repeat('y', 5001)
                    WHEN event_id % 3 = 0 THEN NULL ELSE 'Detalle ' || props END AS descripcion,
               CASE event_id % 10 WHEN 0 THEN 'aplicaciones' WHEN 1 THEN 'INFRAESTRUCTURA'
                    WHEN 2 THEN 'Talento  Humano' WHEN 3 THEN 'contabilidad'
                    WHEN 4 THEN ' Compras' WHEN 5 THEN 'comercial' WHEN 6 THEN 'operaciones'
                    WHEN 7 THEN 'Calidad' WHEN 8 THEN 'Marte' ELSE '' END AS area,
               CASE WHEN event_id % 47 = 0 THEN ' '
                    ELSE 'usuario' || CAST(user_id AS STRING) END AS solicitante,
               CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'correo'
                    WHEN 3 THEN 'TELEFONO' WHEN 4 THEN 'fax' ELSE 'Formulario Web' END AS canal
        FROM {events}""",
    "solicitudes": """
        SELECT event_id AS seq, 'SOL-' || CAST(event_id + 1000000 AS STRING) AS codigo,
               'Solicitud ' || event_type AS asunto, props AS descripcion,
               CASE event_id % 8 WHEN 0 THEN 'Aplicaciones' WHEN 1 THEN 'Infraestructura'
                    WHEN 2 THEN 'Talento Humano' WHEN 3 THEN 'Contabilidad' WHEN 4 THEN 'Compras'
                    WHEN 5 THEN 'Comercial' WHEN 6 THEN 'Operaciones' ELSE 'Calidad' END AS area,
               'usuario' || CAST(user_id AS STRING) AS solicitante, 'Formulario' AS canal,
               CASE event_id % 4 WHEN 0 THEN 'Red' WHEN 1 THEN 'Software' WHEN 2 THEN 'Accesos'
                    ELSE 'Otros' END AS categoria,
               CASE event_id % 3 WHEN 0 THEN 'Alta' ELSE 'Media' END AS prioridad,
               CASE event_id % 5 WHEN 0 THEN 'Abierto' WHEN 1 THEN 'En proceso'
                    WHEN 2 THEN 'Cerrado' WHEN 3 THEN 'Reabierto' ELSE 'Escalado' END AS estado,
               CASE WHEN event_id % 6 = 0 THEN 'degradado' ELSE 'modelo' END AS origen
        FROM {events}""",
    "operaciones": """
        SELECT event_id AS seq, ts, event_type AS operacion, value AS latencia_ms,
               CASE WHEN event_id % 6 = 0 THEN 'degradado' ELSE 'modelo' END AS origen,
               CASE WHEN event_id % 6 = 0 THEN
                    CASE WHEN event_id % 4 = 0 THEN 'proveedor_no_disponible'
                         ELSE 'salida_no_interpretable' END END AS motivo,
               CASE event_id % 3 WHEN 0 THEN 'norte' WHEN 1 THEN 'sur' ELSE 'este' END
                    AS proveedor,
               CASE WHEN event_id % 5 = 0 THEN NULL
                    ELSE CAST(replace(replace(props, '{{"k": ', ''), '}}', '') AS INT) END
                    AS tokens_entrada,
               CASE WHEN event_id % 10 = 0 OR event_id % 7 = 0 THEN NULL
                    ELSE CAST(event_id % 90 AS INT) END AS tokens_salida,
               CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 30 AS INT) END
                    AS tokens_razonamiento,
               CASE event_id % 4 WHEN 0 THEN ' traza-' || CAST(event_id AS STRING)
                    WHEN 1 THEN 'no vale' WHEN 2 THEN repeat('a', 65) ELSE 'ñandú_7' END
                    AS id_traza
        FROM {events}""",
    # A fifth of the log belongs to one key; a few events carry no key.
    "ingreso": """
        SELECT event_id AS seq, ts,
               CASE WHEN event_id % 7 = 3 THEN 'completar' WHEN event_id % 7 = 5 THEN 'liberar'
                    ELSE 'reservar' END AS accion,
               CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'K-unica'
                    ELSE 'K-' || CAST((user_id * 31 + event_id) % 2003 AS STRING) END AS clave,
               'h' || CAST(user_id % 2 AS STRING) AS huella,
               CASE WHEN event_id % 7 = 3 THEN 'SOL-' || CAST(event_id AS STRING) END AS codigo
        FROM {events}""",
    "tickets_conversados": """
        SELECT conv_id * 1000 + turn AS ticket_id,
               CASE WHEN conv_id % 9 = 0 THEN '' ELSE text END AS asunto,
               CASE WHEN conv_id % 9 = 0 THEN '  ' ELSE text END AS descripcion
        FROM {conversations} WHERE role = 'user'""",
    "respuestas_modelo": """
        SELECT conv_id * 1000 + turn - 1 AS ticket_id,
               (conv_id + turn) % 8 <> 0 AS ok,
               text || CASE (conv_id + turn) % 9
                    WHEN 0 THEN ' {{"categoria": "Red", "prioridad": "Alta"}} listo'
                    WHEN 1 THEN ' {{"categoria": "NOMINA", "prioridad": "1-alta"}}'
                    WHEN 2 THEN ' {{"categoria": "Teletrabajo", "prioridad": "Alta"}}'
                    WHEN 3 THEN ' sin objeto'
                    WHEN 4 THEN ' {{"categoria": "Red"}}'
                    WHEN 5 THEN ' {{"categoria": {{"a": "Red"}}, "prioridad": "Alta"}}'
                    WHEN 6 THEN ' {{"categoria": "Sin clasificar", "prioridad": "Baja"}}'
                    WHEN 7 THEN ' {{"categoria": "reportes", "prioridad": "critica"}}'
                    ELSE ' {{roto' END AS texto,
               'norte' AS proveedor, 'm1' AS modelo, CAST(turn * 10.5 AS DOUBLE) AS latencia_ms,
               CAST(conv_id AS INT) AS tokens_entrada, CAST(turn AS INT) AS tokens_salida
        FROM {conversations} WHERE role = 'assistant'""",
    "preguntas": """
        SELECT item_id AS question_id,
               CASE WHEN item_id % 13 = 12 THEN '  ' WHEN item_id % 11 = 5 THEN 'zzqx zzqy'
                    ELSE text END AS pregunta
        FROM {benchmark}""",
}

# The numbered policies: the line position decides what opens a section or a subsection. The two
# engines number list positions from 0 and from 1, so this view has one text per engine.
_CODE = (
    "'POL-' || chr(CAST(65 + CAST(floor(doc_id / 17576000) AS BIGINT) % 26 AS INT))"
    " || chr(CAST(65 + CAST(floor(doc_id / 676000) AS BIGINT) % 26 AS INT))"
    " || chr(CAST(65 + CAST(floor(doc_id / 26000) AS BIGINT) % 26 AS INT))"
    " || chr(CAST(65 + CAST(floor(doc_id / 1000) AS BIGINT) % 26 AS INT))"
    " || '-' || lpad(CAST(doc_id % 1000 AS STRING), 3, '0')"
)
_HEAD = (
    "'Política ' || CAST(doc_id AS STRING) || chr(10) || CASE WHEN doc_id % 10 = 9 THEN 'Sin marca'"
    f" ELSE 'Mesa · Código ' || {_CODE} || ' · Versión ' || CAST(doc_id % 7 + 1 AS STRING)"
    " || ' · Vigente' END || chr(10)"
)


def _numbered(line: str, position: str) -> str:
    number = f"CAST(CAST(floor(({position}) / 5) AS BIGINT) % 99 + 1 AS STRING)"
    return (
        f"CASE ({position}) % 5 WHEN 0 THEN {number} || '. ' || {line} "
        f"WHEN 3 THEN ' ' || {number} || '.1. ' || {line} ELSE {line} END"
    )


POLICIES_SPARK = f"""
    SELECT doc_id, 'archivo-' || CAST(doc_id AS STRING) AS file_name,
           {_HEAD} || array_join(
               transform(split(text, chr(10)), (x, i) -> {_numbered("x", "i")}), chr(10)) AS text
    FROM {{documents}}"""
POLICIES_CHECK = f"""
    SELECT doc_id, 'archivo-' || CAST(doc_id AS STRING) AS file_name,
           {_HEAD} || array_to_string(
               list_transform(string_split(text, chr(10)),
                              lambda x, i: {_numbered("x", "i - 1")}), chr(10)) AS text
    FROM {{documents}}"""


def names_in(sql: str) -> list[str]:
    """Names of tables and views a statement refers to."""
    return sorted(set(re.findall(r"(?<!\{)\{([a-z_]+)\}(?!\})", sql)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A source table or a derived view as a lazy frame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    sql = POLICIES_SPARK if name == "politicas" else VIEWS[name]
    return spark.sql(sql, **{dep: view(spark, sf_dir, dep) for dep in names_in(sql)})
