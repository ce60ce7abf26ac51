"""SQL a second engine runs on the same tables to check the registered queries.

Written independently of the DataFrame code: sequential folds are recursive queries or windows over
whole keys, sections are found line by line, term counts come from plain grouping.
"""

from __future__ import annotations

import re

from ticketlake.functions import catalogs, dates, text
from ticketlake.operators import gates, metrics, reminders, rules
from ticketlake.operators.evaluation import SWEEP
from ticketlake.plans import queries as q
from ticketlake.plans.views import POLICIES_CHECK, TABLES, VIEWS, names_in
from ticketlake.schemas import TICKET_COLUMNS

_BLANKS = "'" + text.WHITESPACE + "'"
_WS = text.WS


def _quote(value: object) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def _strip(x: str) -> str:
    return f"trim({x}, {_BLANKS})"


def _none(x: str) -> str:
    return f"coalesce({x}, '')"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({_none(x)}, '{_WS}+', ' ', 'g'), ' ')"


def _fold(x: str) -> str:
    return f"strip_accents(lower({x}))"


def _key(x: str) -> str:
    bare = f"lower({_strip(f'replace({_none(x)}, {_quote(text.BOM)}, {_quote(str())})')})"
    plain = f"regexp_replace({bare}, '^[0-9]+{_WS}*-{_WS}*', '')"
    return _strip(f"strip_accents(regexp_replace({plain}, '{_WS}+', ' ', 'g'))")


def _date_text(x: str) -> str:
    return _strip(f"replace({_none(x)}, {_quote(text.BOM)}, '')")


_MONTH_LIST = "['" + "','".join(dates.MONTHS) + "']"


def _date(x: str) -> str:
    """A valid date or null, from already trimmed text."""
    named = dates.NAMED_SHAPE
    month = f"list_position({_MONTH_LIST}, lower(substr(regexp_extract({x}, '{named}', 2), 1, 3)))"
    day, year = (f"regexp_extract({x}, '{named}', {i})" for i in (1, 3))
    return f"""CASE
        WHEN regexp_matches({x}, '{dates.ISO_SHAPE}') AND {x} NOT LIKE '0000%'
            THEN CAST(try_strptime({x}, '%Y-%m-%d') AS DATE)
        WHEN regexp_matches({x}, '{dates.SLASH_SHAPE}') AND {x} NOT LIKE '%/0000'
            THEN CAST(try_strptime({x}, '%d/%m/%Y') AS DATE)
        WHEN regexp_matches({x}, '{named}') AND {month} > 0 AND {year} <> '0000'
            THEN CAST(try_strptime({year} || '-' || {month} || '-' || {day}, '%Y-%m-%d') AS DATE)
        END"""


def _date_motive(x: str, value: str) -> str:
    named = dates.NAMED_SHAPE
    month = f"list_position({_MONTH_LIST}, lower(substr(regexp_extract({x}, '{named}', 2), 1, 3)))"
    return f"""CASE WHEN {x} = '' OR {value} IS NOT NULL THEN NULL
        WHEN regexp_matches({x}, '{dates.ISO_SHAPE}')
          OR regexp_matches({x}, '{dates.SLASH_SHAPE}') THEN '{dates.NO_SUCH_DATE}'
        WHEN regexp_matches({x}, '{named}') THEN CASE WHEN coalesce({month}, 0) = 0
            THEN '{dates.UNKNOWN_MONTH}' ELSE '{dates.NO_SUCH_DATE}' END
        ELSE '{dates.UNKNOWN_FORMAT}' END"""


def _lookup(name: str, key: str) -> str:
    cases = " ".join(
        f"WHEN {_quote(k)} THEN {_quote(v)}" for k, v in catalogs.CATALOGS[name].items()
    )
    return f"CASE {key} {cases} END"


def _blank_key(name: str, key: str) -> str:
    absent = ("", *(catalogs.NO_CATEGORY if name == "categoria" else ()))
    return f"{key} IN ({', '.join(_quote(x) for x in absent)})"


def _pct(n: str, d: str) -> str:
    return f"coalesce((20000 * {n} + {d}) // (2 * nullif({d}, 0)) / 100.0, 0.0)"


def _rate(n: str, d: str) -> str:
    return f"coalesce((20000 * {n} + {d}) // (2 * nullif({d}, 0)) / 10000.0, 0.0)"


def _tokens(x: str) -> str:
    stop = ", ".join(_quote(w) for w in text.STOP_WORDS)
    return (
        f"list_filter(regexp_extract_all({_fold(_none(x))}, '{text.TOKEN}'), "
        f"lambda w: w NOT IN ({stop}))"
    )


def _mentions(key: str, words) -> str:
    return "(" + " OR ".join(f"contains({key}, {_key(_quote(w))})" for w in words) + ")"


def _rules(key: str) -> str:
    cases = " ".join(f"WHEN {_mentions(key, words)} THEN {_quote(c)}" for c, words in rules.RULES)
    return f"CASE {cases} ELSE '{rules.DEFAULT_RULE_CATEGORY}' END"


def _urgency(key: str) -> str:
    return f"CASE WHEN {_mentions(key, rules.URGENT_WORDS)} THEN 'Alta' ELSE 'Media' END"


def _title_body(title: str, body: str) -> str:
    a, b = _strip(_none(title)), _strip(_none(body))
    return f"concat_ws(chr(10), nullif({a}, ''), nullif({b}, ''))"


def _listed(values) -> str:
    return ", ".join(_quote(v) for v in values)


# Common table expressions, by name. A statement pulls in the ones it mentions.
CTES: dict[str, str] = {
    name: sql.format(**{dep: dep for dep in names_in(sql)}) for name, sql in VIEWS.items()
}
CTES["politicas"] = POLICIES_CHECK.format(documents="documents")

_CATALOG_FIELDS = ("categoria", "prioridad", "estado", "canal", "area")
CTES["fechas"] = f"""
    SELECT *, {_date('fc')} AS creacion, {_date('fx')} AS cierre
    FROM (SELECT *, {_date_text('fecha_creacion')} AS fc, {_date_text('fecha_cierre')} AS fx,
                 {', '.join(f"{_key(n)} AS k_{n}" for n in _CATALOG_FIELDS)},
                 {_strip(_none('reaperturas'))} AS t_reap, {_strip(_none('id'))} AS t_id
          FROM tickets_crudos)"""
CTES["buscados"] = f"""
    SELECT *, {_date_motive('fc', 'creacion')} AS m_creacion, {_date_motive('fx', 'cierre')} AS m_cierre,
           {', '.join(f"CASE WHEN NOT {_blank_key(n, 'k_' + n)} THEN {_lookup(n, 'k_' + n)} END AS v_{n}"
                      for n in _CATALOG_FIELDS)},
           {', '.join(f"CASE WHEN NOT {_blank_key(n, 'k_' + n)} AND {_lookup(n, 'k_' + n)} IS NULL "
                      f"THEN '{catalogs.OUT_OF_CATALOG}' END AS m_{n}" for n in _CATALOG_FIELDS)},
           CASE WHEN t_reap = '' THEN 0
                WHEN regexp_matches(t_reap, '^[+-]?[0-9]+$') AND TRY_CAST(t_reap AS BIGINT) >= 0
                THEN TRY_CAST(t_reap AS BIGINT) END AS v_reap
    FROM fechas"""
CTES["revisados"] = """
    SELECT *, CASE WHEN t_id = '' THEN 'id_ausente'
        WHEN fc = '' THEN 'fecha_creacion_ausente'
        WHEN m_creacion IS NOT NULL THEN 'fecha_creacion_invalida'
        WHEN m_cierre IS NOT NULL THEN 'fecha_cierre_invalida'
        WHEN cierre < creacion THEN 'cierre_anterior_a_creacion'
        WHEN k_estado = '' THEN 'estado_ausente'
        WHEN m_estado IS NOT NULL THEN 'estado_fuera_de_catalogo'
        WHEN m_prioridad IS NOT NULL THEN 'prioridad_fuera_de_catalogo'
        WHEN m_canal IS NOT NULL THEN 'canal_fuera_de_catalogo'
        WHEN m_categoria IS NOT NULL THEN 'categoria_fuera_de_catalogo'
        WHEN v_reap IS NULL THEN 'reaperturas_no_numericas' END AS motivo
    FROM buscados"""
CTES["rechazos"] = """
    SELECT _row AS numero_de_fila, motivo, CASE motivo
        WHEN 'id_ausente' THEN 'la fila no trae identificador de ticket'
        WHEN 'fecha_creacion_ausente' THEN 'sin fecha de creación'
        WHEN 'fecha_creacion_invalida' THEN m_creacion
        WHEN 'fecha_cierre_invalida' THEN m_cierre
        WHEN 'cierre_anterior_a_creacion' THEN
            'cierre ' || CAST(cierre AS VARCHAR) || ' anterior a creación ' || CAST(creacion AS VARCHAR)
        WHEN 'estado_ausente' THEN 'sin estado'
        WHEN 'estado_fuera_de_catalogo' THEN '''' || estado || ''''
        WHEN 'prioridad_fuera_de_catalogo' THEN '''' || prioridad || ''''
        WHEN 'canal_fuera_de_catalogo' THEN '''' || canal || ''''
        WHEN 'categoria_fuera_de_catalogo' THEN '''' || categoria || ''''
        ELSE '''' || reaperturas || '''' END AS detalle, _row AS numero_fila_descartada
    FROM revisados WHERE motivo IS NOT NULL"""
_AREA = f"CASE WHEN {_strip(_none('area'))} = '' THEN 'Sin área' ELSE {_strip(_none('area'))} END"
CTES["validos"] = f"""
    SELECT _row, t_id AS id, creacion AS fecha_creacion, cierre AS fecha_cierre, {_AREA} AS area,
           coalesce(v_categoria, 'Sin clasificar') AS categoria,
           coalesce(v_prioridad, 'Sin prioridad') AS prioridad,
           coalesce(v_canal, 'Sin canal') AS canal, {_strip(_none('solicitante'))} AS solicitante,
           {_collapse('asunto')} AS asunto, {_collapse('descripcion')} AS descripcion,
           v_estado AS estado, v_reap AS reaperturas
    FROM revisados WHERE motivo IS NULL"""
_CONTENT = [name for name in TICKET_COLUMNS if name != "id"]
# The fold over the captures of an id, as windows: the row kept before each one is the earliest of
# the most complete ones seen so far.
CTES["puntuados"] = f"""
    SELECT *, (fecha_cierre IS NOT NULL)::INT + (solicitante <> '')::INT + (asunto <> '')::INT
        + (descripcion <> '')::INT + (area <> 'Sin área')::INT
        + (categoria <> 'Sin clasificar')::INT AS puntos,
        concat_ws(chr(1), {', '.join(f"coalesce(CAST({n} AS VARCHAR), '')" for n in _CONTENT)}) AS contenido
    FROM validos"""
CTES["plegados"] = """
    SELECT *, arg_max(_row, clave) OVER previos AS fila_previa,
           arg_max(contenido, clave) OVER previos AS contenido_previo,
           arg_max(puntos, clave) OVER previos AS puntos_previos
    FROM (SELECT *, puntos * 10000000000 - _row AS clave FROM puntuados)
    WINDOW previos AS (PARTITION BY id ORDER BY _row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
CTES["decididos"] = """
    SELECT *, CASE WHEN fila_previa IS NULL THEN 'primera' WHEN contenido_previo = contenido THEN 'exacto'
                WHEN puntos > puntos_previos THEN 'desplaza' ELSE 'pierde' END AS caso
    FROM plegados"""
CTES["duplicados"] = """
    SELECT d._row AS numero_de_fila, CASE d.caso WHEN 'exacto' THEN 'duplicado_exacto'
        ELSE 'duplicado_con_contenido_en_conflicto' END AS motivo,
        CASE d.caso WHEN 'desplaza' THEN d.fila_previa ELSE d._row END AS numero_fila_descartada,
        CASE d.caso WHEN 'exacto' THEN 'repite exactamente al ticket ' || d.id || ' ya procesado'
        ELSE 'mismo id ' || d.id || ' con contenido distinto; se conservó la captura más completa '
             || 'y esta se aparta para revisión' END AS detalle
    FROM decididos d WHERE d.caso <> 'primera'"""
CTES["limpios"] = f"""
    SELECT _row, {', '.join(TICKET_COLUMNS)} FROM validos
    WHERE _row NOT IN (SELECT numero_fila_descartada FROM duplicados)"""
CTES["cuarentena"] = """
    SELECT numero_de_fila, motivo, detalle, numero_fila_descartada FROM rechazos
    UNION ALL SELECT numero_de_fila, motivo, detalle, numero_fila_descartada FROM duplicados"""
CTES["reporte"] = f"""
    SELECT 'totales' AS seccion, 'leidos' AS nombre, count(*) AS n FROM tickets_crudos
    UNION ALL SELECT 'totales', 'limpios', count(*) FROM limpios
    UNION ALL SELECT 'totales', 'en_cuarentena', count(*) FROM cuarentena
    UNION ALL SELECT 'motivos', motivo, count(*) FROM cuarentena GROUP BY motivo
    UNION ALL SELECT 'valores_por_defecto', nombre, count(*) FROM (
        SELECT unnest([CASE WHEN {_strip(_none('area'))} = '' THEN 'area → Sin área' END,
                       CASE WHEN v_categoria IS NULL THEN 'categoria → Sin clasificar' END,
                       CASE WHEN v_prioridad IS NULL THEN 'prioridad ausente' END,
                       CASE WHEN v_canal IS NULL THEN 'canal ausente' END]) AS nombre
        FROM revisados WHERE motivo IS NULL) WHERE nombre IS NOT NULL GROUP BY nombre"""

_OPEN = f"estado IN ({_listed(catalogs.OPEN_STATES)})"
_ORDER = " ".join(
    f"WHEN {_quote(name)} THEN {i}" for i, name in enumerate(catalogs.PRIORITY_ORDER)
)


def _summary(source: str, area: str = "area") -> str:
    block = (
        "SELECT '{0}' AS agrupacion, {1} AS nombre, count(*) AS total, "
        f"count(*) FILTER ({_OPEN}) AS abiertos, count(*) FILTER (NOT {_OPEN}) AS cerrados, "
        "count(*) FILTER (reaperturas > 0) AS reaperturas, "
        f"{_pct('count(*) FILTER (reaperturas > 0)', 'count(*)')} AS tasa_reapertura_pct "
        f"FROM {source} GROUP BY {{1}}"
    )
    return block.format("area", area) + " UNION ALL " + block.format("prioridad", "prioridad")


# Report dates: exact three-letter months, Spanish or English.
_SHORT = r"^([0-9]{1,2})-([A-Za-z]{3})-([0-9]{4})$"
_REPORT_MONTHS = (
    "['ene','feb','mar','abr','may','jun','jul','ago','sep','oct','nov','dic']"
)
_ENGLISH_MONTHS = (
    "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"
)


def _report_date(x: str) -> str:
    name = f"lower(regexp_extract({x}, '{_SHORT}', 2))"
    month = (
        f"coalesce(nullif(list_position({_REPORT_MONTHS}, {name}), 0), "
        f"nullif(list_position({_ENGLISH_MONTHS}, {name}), 0))"
    )
    day, year = (f"regexp_extract({x}, '{_SHORT}', {i})" for i in (1, 3))
    return f"""CASE
        WHEN regexp_matches({x}, '{dates.ISO_SHAPE}') AND {x} NOT LIKE '0000%'
            THEN CAST(try_strptime({x}, '%Y-%m-%d') AS DATE)
        WHEN regexp_matches({x}, '{dates.SLASH_SHAPE}') AND {x} NOT LIKE '%/0000'
            THEN CAST(try_strptime({x}, '%d/%m/%Y') AS DATE)
        WHEN regexp_matches({x}, '{_SHORT}') AND {month} IS NOT NULL AND {year} <> '0000'
            THEN CAST(try_strptime({year} || '-' || {month} || '-' || {day}, '%Y-%m-%d') AS DATE)
        END"""


CTES["informados"] = f"""
    SELECT *, {_report_date('rc')} AS creado, {_report_date('rx')} AS cerrado,
           lower({_strip(_none('estado'))}) = 'reabierto' AS es_reabierto,
           CASE WHEN coalesce(area, '') = '' THEN 'Sin area' ELSE {_strip('area')} END AS area_informe
    FROM (SELECT *, {_strip(_none('fecha_creacion'))} AS rc, {_strip(_none('fecha_cierre'))} AS rx
          FROM tickets_crudos)"""

# Requests.
_T, _B, _R = (_strip(_none(c)) for c in ("asunto", "descripcion", "solicitante"))
CTES["admitidas"] = f"""
    SELECT *, CASE WHEN t = '' OR length(t) > 200 THEN 'asunto' WHEN length(b) > 5000 THEN 'descripcion'
        WHEN v_area IS NULL THEN 'area' WHEN r = '' OR length(r) > 200 THEN 'solicitante'
        WHEN c <> '' AND v_canal IS NULL THEN 'canal' END AS campo
    FROM (SELECT *, {_T} AS t, {_B} AS b, {_R} AS r, {_strip(_none('canal'))} AS c,
                 {_lookup('area', _key('area'))} AS v_area, {_lookup('canal', _key('canal'))} AS v_canal
          FROM solicitudes_crudas)"""

# The intake fold, one event of every key per step.
CTES["pasos"] = """
    SELECT *, row_number() OVER (PARTITION BY clave ORDER BY seq) AS paso
    FROM ingreso WHERE clave IS NOT NULL"""
_AFTER = """
    CASE WHEN e.accion = 'reservar' AND {0}estado = 'libre' THEN 'reservada'
         WHEN e.accion = 'completar' AND {0}estado <> 'libre' THEN 'terminada'
         WHEN e.accion = 'liberar' AND {0}estado = 'reservada' THEN 'libre' ELSE {0}estado END AS estado,
    CASE WHEN e.accion = 'reservar' AND {0}estado = 'libre' THEN e.huella ELSE {0}huella END AS huella,
    CASE WHEN e.accion = 'completar' AND {0}estado <> 'libre' THEN e.codigo ELSE {0}codigo END AS codigo,
    e.seq, e.accion, e.huella AS pedida, {0}estado AS estado_previo, {0}huella AS huella_previa,
    {0}codigo AS codigo_previo"""

# Text.
CTES["terminos"] = f"""
    SELECT doc_id, termino, count(*) AS tf FROM (
        SELECT doc_id, unnest({_tokens('text')}) AS termino FROM documents) GROUP BY ALL"""


def _idf(source: str, total: str) -> str:
    return f"""
    SELECT termino, count(*) AS df, ln((1.0 + (SELECT count(*) FROM {total})) / (1.0 + count(*))) + 1 AS idf
    FROM {source} GROUP BY termino"""


CTES["idf"] = _idf("terminos", "documents")
CTES["pesos"] = """
    SELECT doc_id, termino, p / sqrt(sum(p * p) OVER (PARTITION BY doc_id)) AS peso FROM (
        SELECT doc_id, termino, (1 + ln(tf)) * idf AS p FROM terminos JOIN idf USING (termino))"""
CTES["terminos_pregunta"] = f"""
    SELECT question_id, termino, count(*) AS tf FROM (
        SELECT question_id, unnest({_tokens('pregunta')}) AS termino FROM preguntas) GROUP BY ALL"""


def _query_weights(idf: str) -> str:
    return f"""
    SELECT question_id, termino, p / sqrt(sum(p * p) OVER (PARTITION BY question_id)) AS peso FROM (
        SELECT question_id, termino, (1 + ln(tf)) * idf AS p
        FROM terminos_pregunta JOIN {idf} USING (termino))"""


def _top_k(weights: str, query_weights: str, key: str, corpus: str) -> str:
    """Every question against every document, the missing products counted as zero."""
    return f"""
    SELECT question_id, doc_key, puntaje, posicion FROM (
        SELECT question_id, doc_key, puntaje, row_number() OVER (
            PARTITION BY question_id ORDER BY puntaje DESC, doc_key) AS posicion
        FROM (SELECT p.question_id, c.{key} AS doc_key, round(coalesce(s.score, 0.0), 9) AS puntaje
              FROM preguntas p CROSS JOIN {corpus} c LEFT JOIN (
                SELECT question_id, {key} AS doc_key, sum(w.peso * v.peso) AS score
                FROM {weights} w JOIN {query_weights} v USING (termino) GROUP BY ALL) s
              ON s.question_id = p.question_id AND s.doc_key = c.{key}))
    WHERE posicion <= 5"""


CTES["largos"] = f"""
    SELECT doc_id, len({_tokens('text')}) AS largo FROM documents"""
CTES["frecuencias"] = "SELECT termino, count(*) AS df FROM terminos GROUP BY termino"
CTES["pesos_okapi"] = """
    SELECT doc_id, termino, tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * largo
           / (SELECT avg(largo) FROM largos))) AS peso FROM terminos JOIN largos USING (doc_id)"""
CTES["pesos_pregunta_okapi"] = """
    SELECT question_id, termino, tf * ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)) AS peso
    FROM terminos_pregunta JOIN frecuencias USING (termino)"""
CTES["top_okapi"] = _top_k("pesos_okapi", "pesos_pregunta_okapi", "doc_id", "documents")
CTES["pesos_pregunta"] = _query_weights("idf")
CTES["top_documentos"] = _top_k("pesos", "pesos_pregunta", "doc_id", "documents")

# Policies, line by line.
_B1 = r"[\x09\x0b-\x0d\x1c-\x20\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
_SEC = rf"^{_B1}*(\p{{Nd}}{{1,2}})\.{_B1}+([\p{{L}}\p{{Nl}}\p{{No}}].*)$"
_SUB = rf"^{_B1}*(\p{{Nd}}{{1,2}}\.\p{{Nd}}{{1,2}})\.{_B1}+([\p{{L}}\p{{Nl}}\p{{No}}].*)$"


def _plain(x: str) -> str:
    return (
        r"regexp_replace(regexp_replace("
        + x
        + r", '[\x00-\x09\x0b-\x1f\x7f-\x{9f}]', ' ', 'g'), '[\x{2028}\x{2029}]', chr(10), 'g')"
    )


CTES["limpias"] = f"SELECT doc_id, file_name, {_plain('text')} AS text FROM politicas"
CTES["renglones"] = f"""
    SELECT doc_id, i, linea, regexp_matches(linea, '{_SUB}') AS es_sub,
           regexp_matches(linea, '{_SEC}') AND NOT regexp_matches(linea, '{_SUB}') AS es_sec
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS linea,
                 generate_subscripts(string_split(text, chr(10)), 1) AS i FROM limpias)"""
CTES["tramos"] = f"""
    SELECT *, sum((es_sec OR es_sub)::INT) OVER w AS tramo, sum(es_sec::INT) OVER w AS parte,
           last_value(CASE WHEN es_sec THEN {_strip(f"regexp_extract(linea, '{_SEC}', 2)")} END
                      IGNORE NULLS) OVER w AS titulo
    FROM renglones WINDOW w AS (PARTITION BY doc_id ORDER BY i)"""
CTES["cabeceras"] = rf"""
    SELECT doc_id, coalesce(nullif(regexp_extract(cabeza,
                'C[óo]digo{_WS}+([A-Z]{{2,4}}-[A-Z]{{2,4}}-[0-9]{{2,3}})', 1), ''), file_name) AS documento,
           coalesce(renglon[1], file_name) AS titulo_documento,
           coalesce(nullif(regexp_extract(cabeza,
                'Versi[óo]n{_WS}+([^\x09-\x0d\x1c-\x20\x{{85}}\x{{a0}}\x{{2028}}\x{{2029}}]+)', 1), ''),
                'sin versión') AS version
    FROM (SELECT doc_id, file_name, renglon, array_to_string(renglon[1:5], chr(10)) AS cabeza FROM (
        SELECT doc_id, file_name, list_filter(list_transform(string_split(text, chr(10)),
               lambda x: {_strip('x')}), lambda x: x <> '') AS renglon FROM limpias))"""
CTES["cortes"] = f"""
    SELECT t.doc_id, t.parte || '.' || (t.tramo - min(t.tramo) OVER (PARTITION BY t.doc_id, t.parte)
                + CASE WHEN t.parte = 0 THEN 1 ELSE 0 END) AS posicion,
           h.documento, h.titulo_documento, h.version, t.seccion, t.titulo_seccion, t.titulo_padre,
           t.texto, length(t.texto) < 20 AS corto
    FROM (SELECT doc_id, tramo, min(parte) AS parte,
                 max(CASE WHEN es_sub THEN regexp_extract(linea, '{_SUB}', 1)
                          WHEN es_sec THEN regexp_extract(linea, '{_SEC}', 1) END) AS seccion,
                 max(CASE WHEN es_sub THEN '' WHEN es_sec THEN titulo END) AS titulo_seccion,
                 max(CASE WHEN es_sub THEN coalesce(titulo, '') WHEN es_sec THEN '' END) AS titulo_padre,
                 {_collapse("string_agg(CASE WHEN es_sec THEN '' WHEN es_sub THEN regexp_extract(linea, '" + _SUB + "', 2) ELSE linea END, ' ' ORDER BY i)")} AS texto
          FROM tramos WHERE tramo > 0 GROUP BY doc_id, tramo) t
    JOIN cabeceras h USING (doc_id)"""
CTES["fragmentos"] = """
    SELECT *, documento || ' §' || seccion AS cita,
           concat_ws(' ', nullif(titulo_padre, ''), nullif(titulo_seccion, ''), nullif(texto, '')) AS buscable,
           documento || ' §' || seccion || chr(1) || doc_id || chr(1) || posicion AS doc_key
    FROM cortes WHERE NOT corto"""
CTES["terminos_fragmento"] = f"""
    SELECT doc_key, termino, count(*) AS tf FROM (
        SELECT doc_key, unnest({_tokens('buscable')}) AS termino FROM fragmentos) GROUP BY ALL"""
CTES["idf_fragmento"] = _idf("terminos_fragmento", "fragmentos")
CTES["pesos_fragmento"] = """
    SELECT doc_key, termino, p / sqrt(sum(p * p) OVER (PARTITION BY doc_key)) AS peso FROM (
        SELECT doc_key, termino, (1 + ln(tf)) * idf AS p
        FROM terminos_fragmento JOIN idf_fragmento USING (termino))"""
CTES["pesos_pregunta_fragmento"] = _query_weights("idf_fragmento")
CTES["top_fragmentos"] = _top_k(
    "pesos_fragmento", "pesos_pregunta_fragmento", "doc_key", "fragmentos"
)
CTES["recuperados"] = """
    SELECT question_id, doc_key, string_split(doc_key, chr(1))[1] AS cita, puntaje, posicion
    FROM top_fragmentos"""
CTES["respuestas"] = """
    SELECT question_id, question_id % 7 <> 6 AS ok, CASE question_id % 5
        WHEN 0 THEN 'NO_TENGO_EVIDENCIA' WHEN 1 THEN ' Según POL-NADA-99 § 9 el plazo vence.'
        WHEN 2 THEN 'Ver ' || cita1 || ' y POL-NADA-99 §9.'
        ELSE ' Según ' || cita1 || ', ' || cita2 || ' y ' || cita1 END AS texto
    FROM (SELECT question_id, max(cita) FILTER (posicion = 1) AS cita1,
                 max(cita) FILTER (posicion = 2) AS cita2 FROM recuperados GROUP BY question_id)"""
CTES["casos"] = """
    SELECT question_id AS id_caso,
           CASE WHEN question_id % 4 = 0 THEN 'SIN EVIDENCIA EN LOS DOCUMENTOS'
                ELSE 'un plazo' END AS esperado,
           CASE WHEN question_id % 4 = 0 THEN NULL
                WHEN question_id % 3 <> 0 THEN cita ELSE 'POL-NADA-01 §1' END AS cita_esperada
    FROM preguntas LEFT JOIN (SELECT question_id, cita FROM recuperados WHERE posicion = 2)
         USING (question_id)
    WHERE question_id % 4 = 0 OR question_id % 9 <> 1"""
_CITE = rf"\b([A-Z]{{2,4}}-[A-Z]{{2,4}}-[0-9]{{2,3}}){_WS}*§{_WS}*([0-9]{{1,2}}(?:\.[0-9]{{1,2}})?)"


def _cites(x: str) -> str:
    """Distinct citations in order of appearance."""
    pairs = (
        f"list_transform(list_zip(regexp_extract_all({x}, '{_CITE}', 1), "
        f"regexp_extract_all({x}, '{_CITE}', 2)), lambda z: z[1] || ' §' || z[2])"
    )
    return f"list_filter({pairs}, lambda v, i: list_position({pairs}, v) = i)"


CTES["puertas"] = f"""
    SELECT question_id, pregunta, ok, texto, citas, entregadas, mejor, CASE
        WHEN pregunta = '' THEN 'consulta_vacia' WHEN mejor < 0.20 THEN 'sin_evidencia_suficiente'
        WHEN NOT coalesce(ok, false) THEN 'proveedor_no_disponible'
        WHEN len(citas) = 0 THEN 'respuesta_sin_cita_verificable'
        WHEN len(list_filter(citas, lambda c: NOT list_contains(entregadas, c))) > 0
             THEN 'cita_fuera_de_los_fragmentos_recuperados' END AS motivo
    FROM (SELECT p.question_id, {_strip('p.pregunta')} AS pregunta, r.ok, r.texto, {_cites('r.texto')} AS citas,
                 e.entregadas, e.mejor
          FROM preguntas p LEFT JOIN respuestas r USING (question_id)
          LEFT JOIN (SELECT question_id, list(cita ORDER BY posicion) AS entregadas, max(puntaje) AS mejor
                     FROM recuperados GROUP BY question_id) e USING (question_id))"""
CTES["aciertos"] = """
    SELECT id_caso, esperado, cita_esperada, coalesce(max(puntaje), 0.0) AS mejor,
           min(posicion) FILTER (cita = cita_esperada) AS posicion
    FROM casos LEFT JOIN recuperados ON question_id = id_caso
    GROUP BY id_caso, esperado, cita_esperada"""
CTES["detalle"] = """
    SELECT id_caso, esperado LIKE 'SIN EVIDENCIA%' AS sin_respaldo,
           CASE WHEN p.question_id IS NULL THEN NULL WHEN motivo IS NULL THEN 'modelo' ELSE 'abstencion' END
           AS origen, motivo,
           round(CASE WHEN pregunta = '' THEN 0.0 ELSE p.mejor END, 4) AS puntaje,
           CASE WHEN motivo IS NULL THEN array_to_string(citas, '|') ELSE '' END AS citas,
           posicion IS NOT NULL AS recuperada,
           p.question_id IS NOT NULL AND motivo IS NULL AND len(citas) = 0 AS sin_cita,
           CASE WHEN p.question_id IS NULL THEN 'quedó sin respuesta'
                WHEN esperado LIKE 'SIN EVIDENCIA%' AND motivo IS NULL
                THEN 'respondió a una pregunta sin respaldo' END AS fallo
    FROM aciertos LEFT JOIN puertas p ON question_id = id_caso"""
CTES["evaluado"] = f"""
    SELECT *, {_rate('recuperados', 'con_respaldo')} AS recall,
           {_rate('abstenciones_correctas', 'sin_respaldo')} AS tasa_abstencion,
           {_rate('escalamientos', 'con_respaldo')} AS tasa_escalamiento
    FROM (SELECT count(*) FILTER (NOT sin_respaldo) AS con_respaldo,
                 count(*) FILTER (sin_respaldo) AS sin_respaldo,
                 count(*) FILTER (NOT sin_respaldo AND recuperada) AS recuperados,
                 count(*) FILTER (sin_respaldo AND origen = 'abstencion') AS abstenciones_correctas,
                 count(*) FILTER (sin_cita) AS respuestas_sin_cita,
                 count(*) FILTER (NOT sin_respaldo AND motivo = 'sin_evidencia_suficiente') AS escalamientos,
                 count(*) FILTER (origen IS NULL) AS sin_respuesta,
                 count(*) FILTER (fallo IS NOT NULL) AS fallos FROM detalle)"""
CTES["barrido"] = f"""
    SELECT umbral, count(*) FILTER (respaldo AND mejor >= umbral AND posicion IS NOT NULL) AS buenas,
           count(*) FILTER (respaldo AND mejor < umbral) AS abstiene_mal,
           count(*) FILTER (NOT respaldo AND mejor < umbral) AS abstiene_bien,
           count(*) FILTER (respaldo) AS con_respaldo, count(*) FILTER (NOT respaldo) AS sin_respaldo
    FROM (SELECT *, esperado NOT LIKE 'SIN EVIDENCIA%' AS respaldo FROM aciertos)
    CROSS JOIN (SELECT unnest([{', '.join(f'{u}::DOUBLE' for u in SWEEP)}]) AS umbral)
    GROUP BY umbral"""

# Naive Bayes.
CTES["barajados"] = f"""
    SELECT *, md5('{q.SEED}|' || doc_id) || '|' || doc_id AS lugar FROM textos_etiquetados"""
CTES["repartidos"] = """
    SELECT *, CASE WHEN row_number() OVER (ORDER BY lugar)
                        <= floor((SELECT count(*) FROM textos_etiquetados) * 0.8)
              THEN 'entrenamiento' ELSE 'prueba' END AS particion FROM barajados"""


def _bayes(prefix: str, source: str) -> None:
    CTES[f"{prefix}_conteos"] = f"""
        SELECT etiqueta, termino, count(*) AS n FROM (
            SELECT etiqueta, unnest({_tokens('texto')}) AS termino FROM {source}) GROUP BY ALL"""
    CTES[f"{prefix}_clases"] = f"""
        SELECT etiqueta, n_docs, ln(n_docs / (SELECT count(*) FROM {source})) AS log_previa,
               coalesce(total, 0) AS total_terminos,
               ln(1.0 / (coalesce(total, 0) + (SELECT count(DISTINCT termino) FROM {prefix}_conteos)))
                   AS log_desconocido
        FROM (SELECT etiqueta, count(*) AS n_docs FROM {source} GROUP BY etiqueta)
        LEFT JOIN (SELECT etiqueta, CAST(sum(n) AS BIGINT) AS total FROM {prefix}_conteos GROUP BY etiqueta)
             USING (etiqueta)"""
    CTES[f"{prefix}_modelo"] = f"""
        SELECT etiqueta, termino, n, ln((n + 1.0) / (total_terminos
               + (SELECT count(DISTINCT termino) FROM {prefix}_conteos))) AS log_verosimilitud
        FROM {prefix}_conteos JOIN {prefix}_clases USING (etiqueta)"""


_bayes("todo", "textos_etiquetados")
CTES["parte_entrenada"] = "SELECT * FROM repartidos WHERE particion = 'entrenamiento'"
CTES["parte_probada"] = "SELECT * FROM repartidos WHERE particion = 'prueba'"
_bayes("nb", "parte_entrenada")
CTES["puntajes"] = f"""
    SELECT d.doc_id, c.etiqueta, round(c.log_previa + coalesce(sum(
               t.tf * coalesce(m.log_verosimilitud, c.log_desconocido)), 0), 9) AS puntaje
    FROM parte_probada d CROSS JOIN nb_clases c
    LEFT JOIN (SELECT doc_id, termino, count(*) AS tf FROM (
            SELECT doc_id, unnest({_tokens('texto')}) AS termino FROM parte_probada)
        WHERE termino IN (SELECT termino FROM nb_conteos) GROUP BY ALL) t ON t.doc_id = d.doc_id
    LEFT JOIN nb_modelo m ON m.termino = t.termino AND m.etiqueta = c.etiqueta
    GROUP BY d.doc_id, c.etiqueta, c.log_previa"""
CTES["predichos"] = """
    SELECT doc_id, max(etiqueta) FILTER (lugar = 1) AS prediccion,
           round(max(puntaje) FILTER (lugar = 1) - max(puntaje) FILTER (lugar = 2), 4) AS margen
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY puntaje DESC, etiqueta DESC) AS lugar
          FROM puntajes) GROUP BY doc_id"""
CTES["enfrentados"] = """
    SELECT d.doc_id, d.etiqueta AS real, p.prediccion FROM parte_probada d JOIN predichos p USING (doc_id)"""
_CLASSES = "(SELECT real AS {0} FROM enfrentados UNION SELECT prediccion FROM enfrentados)"
CTES["matriz"] = f"""
    SELECT real, prediccion, count(doc_id) AS n
    FROM {_CLASSES.format('real')} CROSS JOIN {_CLASSES.format('prediccion')}
    LEFT JOIN enfrentados USING (real, prediccion)
    GROUP BY real, prediccion"""
CTES["por_clase"] = f"""
    SELECT categoria, {_rate('a', 'p')} AS precision, {_rate('a', 'r')} AS exhaustividad,
           CASE WHEN a > 0 THEN {_rate('(2 * a)', '(r + p)')} ELSE 0.0 END AS f1, r AS casos
    FROM (SELECT c.categoria,
                 (SELECT CAST(sum(n) AS BIGINT) FROM matriz WHERE real = c.categoria) AS r,
                 (SELECT CAST(sum(n) AS BIGINT) FROM matriz WHERE prediccion = c.categoria) AS p,
                 (SELECT n FROM matriz WHERE real = c.categoria AND prediccion = c.categoria) AS a
          FROM {_CLASSES.format('categoria')} c)"""

# Reminders.
_FEST = ", ".join(f"DATE '{h}'" for h in q.HOLIDAYS)
CTES["habiles"] = f"""
    SELECT dia, count(*) FILTER (isodow(dia) < 6 AND dia NOT IN ({_FEST})) OVER (ORDER BY dia) AS indice
    FROM (SELECT CAST(unnest(generate_series(DATE '1990-01-01', DATE '2005-01-01', INTERVAL 1 DAY)) AS DATE) AS dia)"""
CTES["cambiados"] = """
    SELECT id_ticket, codigo, coalesce(cambio, fecha_creacion) AS ultimo_cambio
    FROM tickets LEFT JOIN (SELECT id_ticket, max(fecha_cambio) AS cambio
                            FROM historial_estado GROUP BY id_ticket) USING (id_ticket)
    WHERE estado <> 'Cerrado'"""
CTES["vencidos"] = f"""
    SELECT id_ticket, codigo, hoy.indice - antes.indice AS dias_habiles,
           CASE WHEN hoy.indice - antes.indice >= 5 THEN 'escalamiento' ELSE 'recordatorio' END AS tipo,
           DATE '{q.TODAY}' AS fecha
    FROM cambiados JOIN habiles antes ON antes.dia = ultimo_cambio
    JOIN habiles hoy ON hoy.dia = DATE '{q.TODAY}'
    WHERE hoy.indice - antes.indice >= {reminders.REMINDER_DAYS}"""

CTES["habiles_sede"] = """
    SELECT sede, dia, count(*) FILTER (isodow(dia) < 6 AND libre IS NULL) OVER (
        PARTITION BY sede ORDER BY dia) AS indice
    FROM (SELECT sede, CAST(unnest(generate_series(DATE '1990-01-01', DATE '2005-01-01', INTERVAL 1 DAY)) AS DATE) AS dia
          FROM (SELECT DISTINCT sede FROM areas))
    LEFT JOIN (SELECT DISTINCT sede, dia, 1 AS libre FROM festivos) USING (sede, dia)"""
CTES["vencidos_sede"] = f"""
    SELECT id_ticket, a.sede, hoy.indice - antes.indice AS dias_habiles,
           CASE WHEN hoy.indice - antes.indice >= {reminders.ESCALATION_DAYS} THEN 'escalamiento'
                ELSE 'recordatorio' END AS tipo
    FROM cambiados JOIN tickets t USING (id_ticket) JOIN areas a ON a.id_area = t.id_area
    JOIN habiles_sede antes ON antes.dia = ultimo_cambio AND antes.sede = a.sede
    JOIN habiles_sede hoy ON hoy.dia = DATE '{q.TODAY}' AND hoy.sede = a.sede
    WHERE hoy.indice - antes.indice >= {reminders.REMINDER_DAYS}"""

# Sessions and late events.
CTES["sesiones"] = f"""
    SELECT *, sum(nueva) OVER (PARTITION BY operacion ORDER BY ts, seq) AS sesion FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY operacion ORDER BY ts, seq)
                            <= INTERVAL {q.SESSION_GAP} SECOND THEN 0 ELSE 1 END AS nueva
        FROM operaciones)"""
CTES["llegadas"] = """
    SELECT seq, operacion, ts, (llegada - min(llegada) OVER ()) // (
               (max(llegada) OVER () - min(llegada) OVER ()) // 3 + 1) AS lote
    FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) + seq % 5 * 14400 AS llegada FROM operaciones)"""
CTES["ultimos"] = "SELECT lote, max(ts) AS ultimo FROM llegadas GROUP BY lote"

_DETAIL = """
    SELECT t.codigo AS ticket, t.estado, t.prioridad, t.categoria, t.fecha_creacion AS creado,
           u.nombre AS solicitante, u.correo AS correo_solicitante,
           a1.nombre AS area_que_atiende, a2.nombre AS area_del_solicitante,
           CASE WHEN u.id_area <> t.id_area THEN 'SI' ELSE 'NO' END AS solicitante_de_otra_area
    FROM tickets t JOIN usuarios u ON u.id_usuario = t.id_usuario
    JOIN areas a1 ON a1.id_area = t.id_area JOIN areas a2 ON a2.id_area = u.id_area
    WHERE t.estado <> 'Cerrado'"""


def _percentile(p: int) -> str:
    rank = f"CAST(round_even({p / 100}::DOUBLE * n + 0.5, 0) AS BIGINT)"
    return f"round(muestras[greatest(1, least(n, {rank}))], 2) AS p{p}"


CTES["ultimas"] = f"""
    SELECT operacion, seq, latencia_ms FROM operaciones
    QUALIFY row_number() OVER (PARTITION BY operacion ORDER BY seq DESC) <= {metrics.MAX_SAMPLES}"""
CTES["consumo"] = """
    SELECT proveedor, count(*) AS llamadas,
           count(*) FILTER (tokens_entrada IS NULL AND tokens_salida IS NULL) AS llamadas_sin_tokens,
           CAST(coalesce(sum(tokens_entrada), 0) AS BIGINT) AS tokens_entrada,
           CAST(coalesce(sum(tokens_salida), 0) AS BIGINT) AS tokens_salida,
           CAST(coalesce(sum(tokens_razonamiento) FILTER (tokens_entrada IS NOT NULL
                OR tokens_salida IS NOT NULL), 0) AS BIGINT) AS tokens_razonamiento,
           CAST(NULL AS DOUBLE) AS costo_estimado
    FROM operaciones GROUP BY proveedor"""

_JSON = r"regexp_extract(texto, '(?s)(\{.*?\})', 1)"
CTES["leidas"] = f"""
    SELECT *, j <> '' AND json_valid(j) AS legible,
           CASE WHEN json_valid(j) THEN json_extract_string(j, '$.categoria') END AS j_cat,
           CASE WHEN json_valid(j) THEN json_extract_string(j, '$.prioridad') END AS j_pri
    FROM (SELECT *, {_JSON} AS j FROM respuestas_modelo)"""
CTES["juzgados"] = f"""
    SELECT *, CASE WHEN txt = '' THEN 'salida_no_interpretable'
        WHEN NOT coalesce(ok, false) THEN 'proveedor_no_disponible'
        WHEN NOT legible THEN 'salida_no_interpretable'
        WHEN c IS NULL OR p IS NULL THEN 'salida_fuera_de_catalogo' END AS motivo_degradacion,
        {_key('txt')} AS clave
    FROM (SELECT t.ticket_id, {_title_body('t.asunto', 't.descripcion')} AS txt, r.* EXCLUDE (ticket_id),
                 {_lookup('categoria', _key('r.j_cat'))} AS c, {_lookup('prioridad', _key('r.j_pri'))} AS p
          FROM tickets_conversados t LEFT JOIN leidas r ON r.ticket_id = t.ticket_id)"""

SELECTS: dict[str, str] = {
    "p1_dates": """SELECT _row, creacion, m_creacion AS motivo_creacion, cierre,
        m_cierre AS motivo_cierre FROM buscados""",
    "p2_catalog": "SELECT _row, "
    + ", ".join(f"v_{n} AS {n}, m_{n} AS motivo_{n}" for n in _CATALOG_FIELDS)
    + " FROM buscados",
    "p3_reopens": "SELECT _row, v_reap AS reaperturas FROM buscados",
    "p4_defaults": f"""SELECT _row, {_AREA} AS area, coalesce(v_categoria, 'Sin clasificar') AS categoria,
        coalesce(v_prioridad, 'Sin prioridad') AS prioridad, coalesce(v_canal, 'Sin canal') AS canal,
        {_strip(_none('solicitante'))} AS solicitante, {_collapse('asunto')} AS asunto,
        {_collapse('descripcion')} AS descripcion FROM buscados""",
    "x1_keys": f"SELECT ticket_id, md5({_key('descripcion')}) AS clave FROM tickets_conversados",
    "x2_tokens": f"""SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS tokens_md5
        FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)""",
    "p5_validate": "SELECT numero_de_fila, motivo, detalle FROM rechazos",
    "p5_valid": f"SELECT _row, {', '.join(TICKET_COLUMNS)} FROM validos",
    "w1_dedup_clean": "SELECT * FROM limpios",
    "w1_dedup_quarantine": """SELECT d.numero_de_fila, d.motivo, d.numero_fila_descartada, v.id AS fila_id,
        v.categoria AS fila_categoria, v.solicitante AS fila_solicitante,
        coalesce(CAST(v.fecha_cierre AS VARCHAR), '') AS fila_fecha_cierre
        FROM duplicados d JOIN validos v ON v._row = d.numero_fila_descartada""",
    "w10_quarantine": "SELECT * FROM cuarentena",
    "a5_quality": "SELECT * FROM reporte",
    "a6_gate": """SELECT leidos, en_cuarentena, round(pct, 4) AS porcentaje, pct <= 10.0 AS aprueba,
        CASE WHEN pct <= 10.0 THEN 0 ELSE 2 END AS codigo FROM (
        SELECT *, coalesce(en_cuarentena * 100.0 / nullif(leidos, 0), 0.0)::DOUBLE AS pct FROM (
        SELECT (SELECT count(*) FROM tickets_crudos) AS leidos, (SELECT count(*) FROM cuarentena)
        AS en_cuarentena))""",
    "p15_second_pass": """SELECT numero_de_fila, motivo FROM cuarentena
        WHERE motivo LIKE '%_fuera_de_catalogo'""",
    "a3_summary": _summary("limpios"),
    "s4_summary": "SELECT agrupacion, nombre, total, abiertos, cerrados, tasa_reapertura_pct FROM ("
    + _summary("tickets", "categoria").replace("'categoria' AS agrupacion", "'area' AS agrupacion")
    + ")",
    "s4_written": "SELECT agrupacion, nombre, total, abiertos, cerrados, tasa_reapertura_pct FROM ("
    + _summary("limpios")
    + ")",
    "a4_area_priority": "SELECT area, prioridad, count(*) AS total FROM limpios GROUP BY ALL",
    "w11_priority_order": f"""SELECT prioridad AS nombre, count(*) AS total,
        CASE prioridad {_ORDER} ELSE 5 END AS posicion FROM tickets GROUP BY prioridad""",
    "s6_labelled_texts": f"""SELECT _row, asunto, texto, etiqueta FROM (
        SELECT _row, {_strip(_none('asunto'))} AS asunto,
               {_strip(_strip(_none('asunto')) + " || ' ' || " + _none('descripcion'))} AS texto,
               v_categoria AS etiqueta FROM buscados) WHERE etiqueta IS NOT NULL AND texto <> ''""",
    "a1_area": f"""SELECT a.nombre AS area, a.sede, count(*) AS total_tickets,
        count(*) FILTER (estado = 'Cerrado') AS cerrados, count(*) FILTER (estado <> 'Cerrado') AS abiertos,
        count(*) FILTER (reaperturas > 0) AS con_reapertura,
        {_pct('count(*) FILTER (reaperturas > 0)', 'count(*)')} AS tasa_reapertura_pct
        FROM tickets t JOIN areas a ON a.id_area = t.id_area GROUP BY a.id_area, a.nombre, a.sede""",
    "j2_detail": _DETAIL,
    "j3_param": _DETAIL + " AND t.id_area = 7",
    "a2_discrepancy": """SELECT t.codigo AS ticket, a.nombre AS area, t.estado AS estado_actual,
        t.reaperturas AS contador_reaperturas, count(h.id_historial) AS eventos_de_reapertura,
        CASE WHEN t.reaperturas <> count(h.id_historial) THEN 'DISCREPA' ELSE 'OK' END AS concordancia,
        max(h.fecha_cambio) AS ultima_reapertura
        FROM tickets t JOIN areas a ON a.id_area = t.id_area LEFT JOIN historial_estado h
          ON h.id_ticket = t.id_ticket AND h.estado_nuevo = 'Reabierto'
        GROUP BY t.id_ticket, t.codigo, a.nombre, t.estado, t.reaperturas
        HAVING t.reaperturas > 0 OR count(h.id_historial) > 0""",
    "p6_period": """SELECT _row, fecha_creacion FROM informados
        WHERE creado BETWEEN DATE '1997-01-31' AND DATE '1997-03-31'""",
    "p6_stored": """SELECT _row, id, fecha_creacion FROM limpios
        WHERE fecha_creacion BETWEEN DATE '1997-01-15' AND DATE '1997-03-10'""",
    "a9_stored": f"""WITH mes AS (SELECT area, estado = 'Reabierto' AS es_reabierto FROM limpios
            WHERE fecha_creacion BETWEEN DATE '1997-12-01' AND DATE '1997-12-31')
        SELECT '1997-12' AS periodo, 'total' AS seccion, NULL::VARCHAR AS nombre, count(*) AS total,
               {_pct('count(*) FILTER (es_reabierto)', 'count(*)')} AS tasa_reapertura FROM mes
        UNION ALL SELECT '1997-12', 'area', area, count(*), NULL FROM mes GROUP BY area""",
    "p7_month_bounds": """SELECT CAST(date_trunc('month', fecha_creacion) AS DATE) AS desde,
        last_day(fecha_creacion) AS hasta, count(*) AS tickets FROM tickets GROUP BY ALL""",
    "a7_area_legacy": "SELECT area_informe AS area, count(*) AS total FROM informados GROUP BY ALL",
    "a8_reopen_now": f"""SELECT total, reabiertos, {_pct('reabiertos', 'total')} AS tasa_reapertura FROM (
        SELECT count(*) AS total, count(*) FILTER (es_reabierto) AS reabiertos FROM informados)""",
    "a9_monthly": f"""WITH mes AS (SELECT * FROM informados
            WHERE creado BETWEEN DATE '1997-12-01' AND DATE '1997-12-31')
        SELECT '1997-12' AS periodo, 'total' AS seccion, NULL::VARCHAR AS nombre, count(*) AS total,
               {_pct('count(*) FILTER (es_reabierto)', 'count(*)')} AS tasa_reapertura FROM mes
        UNION ALL SELECT '1997-12', 'area', area_informe, count(*), NULL FROM mes GROUP BY area_informe""",
    "a10_attention": """SELECT estado, count(d) AS muestras, CAST(sum(d) AS BIGINT) AS dias,
        round(avg(d), 4) AS promedio_dias
        FROM (SELECT estado, cerrado - creado AS d FROM informados) GROUP BY estado""",
    "x9_days": """SELECT _row, CAST(cerrado - creado AS INT) AS dias_atencion, creado FROM informados""",
    "p8_list": """SELECT seq, codigo, area, estado FROM solicitudes
        WHERE area = 'Compras' AND estado = 'Abierto' ORDER BY seq DESC LIMIT 30 OFFSET 20""",
    "p8_total": """SELECT count(*) AS total, 200 < count(*) AS hay_mas FROM solicitudes
        WHERE categoria = 'Red'""",
    "p9_lookup": "SELECT * FROM solicitudes WHERE codigo = 'SOL-1000042'",
    "p10_requests": "SELECT seq, campo FROM admitidas WHERE campo IS NOT NULL",
    "p10_accepted": """SELECT seq, t AS asunto, b AS descripcion, v_area AS area, r AS solicitante,
        CASE WHEN c = '' THEN 'Formulario' ELSE v_canal END AS canal, 'Abierto' AS estado
        FROM admitidas WHERE campo IS NULL""",
    "p11_state": """SELECT seq, codigo, CASE WHEN codigo = 'SOL-1000042' THEN 'Escalado'
        ELSE estado END AS estado FROM solicitudes""",
    "p12_redact": "SELECT seq, "
    + ", ".join(
        f"CASE WHEN {n} IS NOT NULL THEN {_quote(metrics.REDACTED)} END AS {n}"
        for n in ("asunto", "descripcion", "solicitante")
    )
    + ", canal FROM solicitudes_crudas",
    "p13_traces": rf"""SELECT seq, t AS id_traza FROM (SELECT seq, {_strip('id_traza')} AS t FROM operaciones)
        WHERE regexp_matches(t, '^[\p{{L}}\p{{Nd}}\p{{Nl}}\p{{No}}_-]{{1,64}}$')""",
    "p14_review": """SELECT prioridad, count(*) AS degradadas FROM solicitudes WHERE origen <> 'modelo'
        GROUP BY prioridad""",
    "w13_numbering": """SELECT seq, numero, printf('SOL-%06d', numero) AS codigo FROM (
        SELECT seq, 999000 + row_number() OVER (ORDER BY seq) AS numero FROM admitidas
        WHERE campo IS NULL)""",
    "x6_fingerprint": """SELECT min(seq) AS primera, count(*) AS veces FROM solicitudes_crudas
        GROUP BY asunto, descripcion, area, solicitante, canal""",
    "x7_keys": f"""SELECT seq, CASE WHEN length(k) <= 128 THEN nullif(k, '') END AS clave,
        length(k) <= 128 AS valida FROM (SELECT seq, {_strip(_none('descripcion'))} AS k
        FROM solicitudes_crudas)""",
    "r1_intake_batch": f"""WITH RECURSIVE plegado AS (
            SELECT e.paso, e.clave, {_AFTER.replace('{0}', 'i.')}
            FROM pasos e, (SELECT 'libre' AS estado, NULL::VARCHAR AS huella, NULL::VARCHAR AS codigo) i
            WHERE e.paso = 1
            UNION ALL
            SELECT e.paso, e.clave, {_AFTER.replace('{0}', 'p.')}
            FROM plegado p JOIN pasos e ON e.clave = p.clave AND e.paso = p.paso + 1)
        SELECT seq, clave, pedida AS huella, CASE WHEN estado_previo = 'libre' THEN 'nueva'
            WHEN huella_previa <> pedida THEN 'conflicto' WHEN estado_previo = 'terminada' THEN 'repetida'
            ELSE 'en_curso' END AS estado,
            CASE WHEN estado_previo = 'terminada' AND huella_previa = pedida THEN codigo_previo END AS codigo
        FROM plegado WHERE accion = 'reservar'
        UNION ALL SELECT seq, clave, huella, 'nueva', NULL FROM ingreso
        WHERE clave IS NULL AND accion = 'reservar'""",
    "t2_rules": f"""SELECT doc_id, {_rules('k')} AS categoria, {_urgency('k')} AS prioridad
        FROM (SELECT doc_id, {_key('text')} AS k FROM documents)""",
    "t3_model_output": f"""SELECT ticket_id,
        CASE WHEN motivo_degradacion IS NULL THEN c ELSE {_rules('clave')} END AS categoria,
        CASE WHEN motivo_degradacion IS NULL THEN p ELSE {_urgency('clave')} END AS prioridad,
        CASE WHEN motivo_degradacion IS NULL THEN 'modelo' ELSE 'degradado' END AS origen,
        CASE WHEN motivo_degradacion IS NULL THEN 'alta' ELSE 'baja' END AS confianza, motivo_degradacion,
        {', '.join(f"CASE WHEN txt <> '' AND ok THEN {n} END AS {n}" for n in ('proveedor', 'modelo', 'latencia_ms', 'tokens_entrada', 'tokens_salida'))}
        FROM juzgados""",
    "x3_json": "SELECT ticket_id, j_cat AS categoria, j_pri AS prioridad, legible FROM leidas",
    "x8_title_body": f"""SELECT ticket_id, md5({_title_body('asunto', 'descripcion')}) AS texto_md5
        FROM tickets_conversados""",
    "a15_diversity": f"""SELECT filas, asuntos, filas // asuntos AS repeticiones, categorias,
        {_rate('mayor', 'filas')} AS linea_base, asuntos_ambiguos FROM (
        SELECT count(*) AS filas, count(DISTINCT asunto) AS asuntos, count(DISTINCT etiqueta) AS categorias,
               (SELECT max(n) FROM (SELECT count(*) AS n FROM textos_etiquetados GROUP BY etiqueta)) AS mayor,
               (SELECT count(*) FROM (SELECT asunto FROM textos_etiquetados GROUP BY asunto
                HAVING count(DISTINCT etiqueta) > 1)) AS asuntos_ambiguos FROM textos_etiquetados)""",
    "a16_nb_model": """SELECT etiqueta, termino, n, round(log_verosimilitud, 6) AS log_verosimilitud
        FROM todo_modelo""",
    "a16_nb_classes": """SELECT etiqueta, n_docs, round(log_previa, 6) AS log_previa, total_terminos,
        round(log_desconocido, 6) AS log_desconocido FROM todo_clases""",
    "w8_split_row": "SELECT doc_id, particion FROM repartidos",
    "w8_split_group": f"""SELECT doc_id, CASE WHEN rango <= floor(total * 0.8) THEN 'entrenamiento'
        ELSE 'prueba' END AS particion FROM textos_etiquetados JOIN (
        SELECT asunto, row_number() OVER (ORDER BY md5('{q.SEED}|' || asunto) || '|' || asunto) AS rango,
               count(*) OVER () AS total FROM (SELECT DISTINCT asunto FROM textos_etiquetados))
        USING (asunto)""",
    "w7_nb_predict": "SELECT * FROM predichos",
    "t7_routing": f"SELECT doc_id, prediccion FROM predichos WHERE margen < {q.MIN_MARGIN}",
    "a17_confusion": "SELECT * FROM matriz",
    "a18_class_metrics": "SELECT * FROM por_clase",
    "a19_accuracy": f"""SELECT casos, aciertos, {_rate('aciertos', 'casos')} AS exactitud FROM (
        SELECT CAST(sum(n) AS BIGINT) AS casos, CAST(sum(n) FILTER (real = prediccion) AS BIGINT)
        AS aciertos FROM matriz)""",
    "a19_macro_f1": "SELECT count(*) AS categorias, round(avg(f1), 4) AS macro_f1 FROM por_clase",
    "t1_chunks": """SELECT doc_id, posicion, documento, titulo_documento, version, seccion, titulo_seccion,
        titulo_padre, md5(texto) AS texto_md5, length(texto) AS largo, corto FROM cortes""",
    "x5_headers": "SELECT * FROM cabeceras",
    "x10_search_text": "SELECT doc_id, cita, md5(buscable) AS texto_md5 FROM fragmentos",
    "s7_policy_texts": f"SELECT page_id, md5({_plain('html')}) AS texto_md5 FROM pages",
    "a24_ingest": """SELECT (SELECT count(*) FROM politicas WHERE text IS NOT NULL) AS documentos_leidos,
        count(*) FILTER (NOT corto) AS fragmentos, count(*) FILTER (corto) AS descartados_por_cortos,
        (SELECT count(*) FROM politicas WHERE text IS NULL) AS documentos_ilegibles FROM cortes""",
    "a20_idf": "SELECT termino, df, round(idf, 6) AS idf FROM idf",
    "a20_tfidf": "SELECT doc_id, termino, round(peso, 4) AS peso FROM pesos",
    "w5_topk": """SELECT question_id AS query_id, doc_key, round(puntaje, 4) AS puntaje, posicion
        FROM top_documentos""",
    "s5_reference_cases": "SELECT * FROM casos",
    "t4_gates": f"""SELECT question_id,
        CASE WHEN motivo IS NULL THEN trim(texto) ELSE {_quote(gates.ABSTENTION)} END AS texto,
        CASE WHEN motivo IS NULL THEN array_to_string(citas, '|') ELSE '' END AS citas,
        CASE WHEN motivo IS NULL THEN 'modelo' ELSE 'abstencion' END AS origen,
        CASE WHEN motivo IS NULL THEN 'alta' ELSE 'baja' END AS confianza, motivo,
        CASE WHEN pregunta <> '' THEN array_to_string(entregadas, '|') ELSE '' END AS fragmentos_consultados,
        round(CASE WHEN pregunta <> '' THEN mejor ELSE 0.0 END, 4) AS mejor_puntaje FROM puertas""",
    "t5_prompt": """SELECT question_id, md5(string_agg('[' || posicion || '] ' || r.cita || ' — '
        || CASE WHEN titulo_padre <> '' THEN titulo_padre ELSE titulo_seccion END || chr(10) || texto,
        chr(10) || chr(10) ORDER BY posicion)) AS listado_md5
        FROM recuperados r JOIN (SELECT doc_key, titulo_padre, titulo_seccion, texto FROM fragmentos)
        USING (doc_key) GROUP BY question_id""",
    "w12_invented": f"""SELECT question_id, array_to_string(list_filter({_cites('texto')},
        lambda c: NOT list_contains(entregadas, c)), '|') AS inventadas FROM respuestas JOIN (
        SELECT question_id, list(cita) AS entregadas FROM recuperados GROUP BY question_id)
        USING (question_id)""",
    "x4_citations": f"""SELECT doc_id, array_to_string({_cites('t')}, '|') AS citas FROM (
        SELECT doc_id, 'según POL-ADM-04 § 5.1, ' || text || ' POL-GTH-01 §'
        || (doc_id % 120) || '. POL-ADM-04 §5.1 y ' || source || '-POL §3' AS t FROM documents)""",
    "j7_hits": """SELECT id_caso, round(mejor, 4) AS mejor, posicion IS NOT NULL AS recuperada, posicion
        FROM aciertos""",
    "a21_evaluate": "SELECT * FROM evaluado",
    "a21_detail": "SELECT * FROM detalle",
    "a22_thresholds": """SELECT condicion, dura FROM (
        SELECT 'respuestas_sin_cita' AS condicion, true AS dura, respuestas_sin_cita > 0 AS rota FROM evaluado
        UNION ALL SELECT 'abstencion', true, abstenciones_correctas < sin_respaldo OR sin_respaldo = 0
        FROM evaluado
        UNION ALL SELECT 'recall', false, con_respaldo = 0 OR recuperados < 0.90 * con_respaldo FROM evaluado
        UNION ALL SELECT 'escalamiento', false, escalamientos > 0.25 * con_respaldo FROM evaluado)
        WHERE rota""",
    "a23_sweep": """SELECT *, abstiene_mal <= 0.25 * con_respaldo AS cumple_escalamiento,
        abstiene_bien = sin_respaldo AS cumple_abstencion FROM barrido""",
    "a23_chosen": "SELECT min(umbral) FILTER (abstiene_bien = sin_respaldo) AS umbral FROM barrido",
    "w3_last_n": "SELECT operacion, seq FROM ultimas",
    "a11_latency": f"""SELECT operacion, n AS cuenta, {', '.join(_percentile(p) for p in metrics.PERCENTILES)}
        FROM (SELECT operacion, count(*) AS n, list(latencia_ms ORDER BY latencia_ms) AS muestras
              FROM ultimas GROUP BY operacion)""",
    "a12_rates": f"""SELECT operacion, total, malos, {_rate('malos', 'total')} AS tasa FROM (
        SELECT operacion, count(*) AS total, count(*) FILTER (origen = 'degradado') AS malos
        FROM operaciones GROUP BY operacion)""",
    "a12_motives": """SELECT operacion, motivo, count(*) AS n FROM operaciones WHERE motivo IS NOT NULL
        GROUP BY ALL""",
    "a13_tokens": "SELECT * FROM consumo",
    "a14_cost": f"""SELECT proveedor, llamadas, round(e, 4) AS millones_entrada, round(s, 4) AS millones_salida,
        round(e * pe + s * ps, 4) AS costo_mensual FROM (
        SELECT proveedor, llamadas,
               tokens_entrada / (llamadas - llamadas_sin_tokens) * {q.CALLS_PER_MONTH} / 1000000.0::DOUBLE AS e,
               tokens_salida / (llamadas - llamadas_sin_tokens) * {q.CALLS_PER_MONTH} / 1000000.0::DOUBLE AS s
        FROM consumo) LEFT JOIN (VALUES {', '.join(f"('{p}', {a}::DOUBLE, {b}::DOUBLE)" for p, a, b in q.PRICES)})
        AS precios(proveedor, pe, ps) USING (proveedor)""",
    "r2_metrics_batch": """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS desde, operacion,
        count(*) AS llamadas, count(*) FILTER (origen = 'degradado') AS degradadas,
        CAST(sum(coalesce(tokens_entrada, 0)) AS BIGINT) AS tokens_entrada,
        CAST(sum(coalesce(tokens_salida, 0)) AS BIGINT) AS tokens_salida
        FROM operaciones GROUP BY ALL""",
    # An empty value in a file reads as nothing.
    "s1_read": "SELECT "
    + ", ".join(f"nullif({name}, '') AS {name}" for name in TICKET_COLUMNS)
    + " FROM tickets_crudos",
    "w2_rows": """SELECT row_number() OVER (ORDER BY _row) AS _row, nullif(id, '') AS id,
        nullif(fecha_creacion, '') AS fecha_creacion FROM tickets_crudos""",
    "s2_clean": "SELECT "
    + ", ".join(f"nullif(CAST({name} AS VARCHAR), '') AS {name}" for name in TICKET_COLUMNS)
    + " FROM limpios",
    "s3_quarantine": "SELECT *, 12 AS campos FROM cuarentena",
    "s7_read": f"SELECT page_id, md5({_plain('html || chr(10)')}) AS texto_md5 FROM pages",
    "s8_log": f"""SELECT seq, operacion AS evento, id_traza,
        CASE WHEN descripcion IS NOT NULL THEN {_quote(metrics.REDACTED)} END AS descripcion,
        CASE WHEN solicitante IS NOT NULL THEN {_quote(metrics.REDACTED)} END AS solicitante, latencia_ms,
        3 AS extras FROM operaciones JOIN (SELECT seq, descripcion, solicitante FROM solicitudes_crudas)
        USING (seq)""",
    "p13_whole": rf"""SELECT count(*) AS filas, count(*) FILTER (util) AS conservadas,
        count(*) FILTER (NOT util) AS nuevas, count(*) FILTER (NOT util) AS distintas,
        count(*) FILTER (NOT util) AS con_forma FROM (
        SELECT regexp_matches({_strip('id_traza')}, '^[\p{{L}}\p{{Nd}}\p{{Nl}}\p{{No}}_-]{{1,64}}$') AS util
        FROM operaciones)""",
    "a24_unreadable": """SELECT count(*) FILTER (doc_id % 50 <> 7) AS documentos_leidos,
        (SELECT count(*) FROM cortes WHERE NOT corto AND doc_id % 50 <> 7) AS fragmentos,
        (SELECT count(*) FROM cortes WHERE corto AND doc_id % 50 <> 7) AS descartados_por_cortos,
        count(*) FILTER (doc_id % 50 = 7) AS documentos_ilegibles FROM politicas""",
    "a24_outcomes": """SELECT doc_id, file_name, coalesce(f, 0) AS fragmentos, coalesce(d, 0) AS descartados,
        CASE WHEN doc_id % 50 = 7 THEN 'texto_ilegible' WHEN f IS NULL THEN 'sin_secciones'
             WHEN f = 0 THEN 'secciones_cortas' END AS motivo
        FROM politicas LEFT JOIN (SELECT doc_id, count(*) FILTER (NOT corto) AS f,
            count(*) FILTER (corto) AS d FROM cortes WHERE doc_id % 50 <> 7 GROUP BY doc_id) USING (doc_id)""",
    "p2_table_catalog": """SELECT c_custkey, CASE WHEN c_custkey % 7 > 1
        THEN upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) END AS valor,
        CASE WHEN c_custkey % 7 = 0 THEN 'valor_fuera_de_catalogo' END AS motivo FROM customer""",
    "t2_table_rules": f"""SELECT doc_id, coalesce(arg_min(r_name, n_nationkey), 'Otros') AS categoria
        FROM (SELECT doc_id, {_key('text')} AS k FROM documents)
        LEFT JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey)
          ON contains(k, lower(substr(n_name, 1, 3))) GROUP BY doc_id""",
    "t6_bm25": """SELECT question_id AS query_id, doc_key, round(puntaje, 4) AS puntaje, posicion
        FROM top_okapi""",
    "t8_prompt": f"""SELECT ticket_id, md5('<<<TICKET>>>' || chr(10) || replace(replace(t,
        '<<<TICKET>>>', '< < <TICKET>>>'), '<<<FIN_TICKET>>>', '< < <FIN_TICKET>>>') || chr(10)
        || '<<<FIN_TICKET>>>') AS entrada_md5
        FROM (SELECT ticket_id, {_title_body('asunto', 'descripcion')} AS t FROM tickets_conversados)
        WHERE t <> ''""",
    "a19_gate": """SELECT count(*) AS categorias, round(avg(f1), 4) AS macro_f1,
        coalesce(round(avg(f1), 4) >= 0.70, false) AS aprueba FROM por_clase""",
    "r4_reminders": "SELECT id_ticket, codigo, dias_habiles, tipo, fecha FROM vencidos",
    "w9_site_calendars": "SELECT * FROM vencidos_sede",
    "r2_sessions_batch": """SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS desde,
        strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS hasta, operacion,
        count(*) AS llamadas, count(*) FILTER (origen = 'degradado') AS degradadas,
        CAST(sum(coalesce(tokens_entrada, 0)) AS BIGINT) AS tokens_entrada,
        CAST(sum(coalesce(tokens_salida, 0)) AS BIGINT) AS tokens_salida
        FROM sesiones GROUP BY operacion, sesion""",
    "r2_late_events": """SELECT seq, operacion, lote FROM llegadas a
        WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (
            SELECT max(ultimo) FROM ultimos u WHERE u.lote < a.lote) - INTERVAL 10 MINUTE""",
    "w9_business_days": "SELECT id_ticket, dias_habiles, tipo FROM vencidos",
    "j5_reminders": """SELECT id_ticket, codigo, tipo, fecha FROM vencidos WHERE id_ticket % 3 <> 0""",
}


#: Steps that later ones read several times.
_SHARED = (
    "buscados", "revisados", "validos", "puntuados", "plegados", "decididos", "duplicados", "limpios",
)


def _with(sql: str) -> str:
    """The statement preceded by the common table expressions it depends on."""
    ordered: list[str] = []

    def need(statement: str) -> None:
        for name in re.findall(r"[a-z_]+", statement):
            if name in CTES and name not in TABLES and name not in ordered:
                need_of = CTES[name]
                if need_of is statement:
                    continue
                need(need_of)
                if name not in ordered:
                    ordered.append(name)

    need(sql)
    if not ordered:
        return sql
    shared = ",\n".join(
        f"{name} AS {'MATERIALIZED ' if name in _SHARED else ''}({CTES[name]})" for name in ordered
    )
    if sql.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {shared},\n{sql.removeprefix('WITH RECURSIVE ')}"
    if sql.startswith("WITH "):
        return f"WITH {shared},\n{sql.removeprefix('WITH ')}"
    return f"WITH {shared}\n{sql}"


#: Streams are checked by the statements of their batch twins.
for _stream, _twin in (
    ("r1_stream", "r1_intake_batch"), ("r2_stream", "r2_metrics_batch"),
    ("r2_latency_stream", "a11_latency"), ("r3_stream", "t3_model_output"),
    ("r5_stream", "w1_dedup_clean"), ("r5_rejects", "w10_quarantine"),
    ("s2_months_stream", "w1_dedup_clean"), ("r2_sessions", "r2_sessions_batch"),
):
    SELECTS[_stream] = SELECTS[_twin]

ORACLE: dict[str, str] = {name: _with(sql) for name, sql in SELECTS.items()}
# Of the answers, every fifth comes after the wait; the second one to a ticket never counts.
ORACLE["r3_late_answers"] = ORACLE["t3_model_output"].replace(
    "FROM respuestas_modelo)", "FROM respuestas_modelo WHERE ticket_id % 5 <> 0)"
)
