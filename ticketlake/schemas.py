"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

TICKET_COLUMNS = (
    "id", "fecha_creacion", "fecha_cierre", "area", "categoria", "prioridad",
    "canal", "solicitante", "asunto", "descripcion", "estado", "reaperturas",
)

REFERENCE_CASE = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "id_caso", "pregunta_o_texto", "respuesta_o_categoria_esperada",
            "documento_fuente", "seccion_fuente", "observacion",
        )
    ]
)

#: Fields of a log line with a column of their own; any other field is kept in ``extras``.
LOG_FIELDS = (
    "momento", "nivel", "evento", "modulo", "id_traza", "asunto", "descripcion", "solicitante",
    "correo", "texto",
)

INTAKE_EVENT = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("accion", T.StringType()),
        T.StructField("clave", T.StringType()),
        T.StructField("huella", T.StringType()),
        T.StructField("codigo", T.StringType()),
    ]
)
