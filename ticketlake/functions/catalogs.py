"""Closed catalogs and the three-state lookup against them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ticketlake.functions.text import literal_map, search_key

# Lookup key -> canonical value of each closed catalog, the words that mean
# "no category", default labels and the order of priorities.
CATEGORIES = {
    "software": "Software",
    "aplicaciones": "Software",
    "accesos": "Accesos",
    "acceso": "Accesos",
    "gestion de accesos": "Accesos",
    "hardware": "Hardware",
    "equipos": "Hardware",
    "red": "Red",
    "conectividad": "Red",
    "incidente": "Incidentes",
    "incidentes": "Incidentes",
    "nomina": "Nómina",
    "compras": "Compras",
    "ordenes de compra": "Compras",
    "informes": "Informes",
    "reportes": "Informes",
    "vacaciones": "Vacaciones",
    "otros": "Otros",
    "viaticos": "Viáticos",
    "capacitacion": "Capacitación",
}
NO_CATEGORY = ("sin clasificar", "sin categoria", "n/a", "-")
PRIORITIES = {"critica": "Crítica", "alta": "Alta", "media": "Media", "baja": "Baja"}
STATES = {
    "abierto": "Abierto",
    "en proceso": "En proceso",
    "cerrado": "Cerrado",
    "reabierto": "Reabierto",
    "escalado": "Escalado",
}
AREAS = {
    "aplicaciones": "Aplicaciones",
    "infraestructura": "Infraestructura",
    "talento humano": "Talento Humano",
    "contabilidad": "Contabilidad",
    "compras": "Compras",
    "comercial": "Comercial",
    "operaciones": "Operaciones",
    "calidad": "Calidad",
}
CHANNELS = {
    "correo": "Correo",
    "telefono": "Teléfono",
    "formulario": "Formulario",
    "formulario web": "Formulario",
    "mesa de ayuda": "Mesa de ayuda",
}
OUT_OF_CATALOG = "valor_fuera_de_catalogo"
DEFAULT_AREA = "Sin área"
DEFAULT_CATEGORY = "Sin clasificar"
DEFAULT_PRIORITY = "Sin prioridad"
DEFAULT_CHANNEL = "Sin canal"
OPEN_STATES = ("Abierto", "En proceso", "Reabierto", "Escalado")
PRIORITY_ORDER = ("Crítica", "Alta", "Media", "Baja", "Sin prioridad")

CATALOGS = {
    "area": AREAS,
    "categoria": CATEGORIES,
    "prioridad": PRIORITIES,
    "estado": STATES,
    "canal": CHANNELS,
}


Catalogs = Mapping[str, Mapping[str, str]]


def lookup(name: str, key: Column, catalogs: Catalogs = CATALOGS) -> Column:
    """Canonical value of a lookup key, null when it is in no entry.

    The catalog is a small closed list that travels inside the plan as a literal map, so the
    lookup needs no join; ``operators.dictionaries`` looks up catalogs of any size.
    """
    return F.element_at(literal_map(catalogs[name]), key)


def _is_blank(name: str, key: Column) -> Column:
    return key.isin("", *NO_CATEGORY) if name == "categoria" else key == ""


def catalog_state(name: str, key: Column, value: Column) -> Column:
    """``struct<valor string, motivo string>`` of a lookup key and what was found for it: a canonical
    value, nothing or a motive."""
    blank = _is_blank(name, key)
    return F.struct(
        F.when(~blank, value).alias("valor"),
        F.when(~blank & value.isNull(), F.lit(OUT_OF_CATALOG)).alias("motivo"),
    )


def standardize_catalogs(
    df: DataFrame, columns: dict[str, str], catalogs: Catalogs = CATALOGS
) -> DataFrame:
    """Adds ``struct<valor string, motivo string>`` columns: canonical value, nothing or a motive.

    ``columns`` maps each new column to the field it reads, which also names the catalog.
    """
    keys = {f"_k_{new}": search_key(F.col(old)) for new, old in columns.items()}
    values = {
        f"_v_{new}": lookup(old, F.col(f"_k_{new}"), catalogs) for new, old in columns.items()
    }

    states = {
        new: catalog_state(old, F.col(f"_k_{new}"), F.col(f"_v_{new}")) for new, old in columns.items()
    }
    return (
        df.withColumns(keys)
        .withColumns(values)
        .withColumns(states)
        .drop(*keys, *values)
    )


def canonical_column(name: str, col: Column) -> Column:
    """Canonical value of a column, null when it is absent or in no catalog entry."""
    return lookup(name, search_key(col))


def canonical(name: str, value: Column) -> Column:
    """Canonical form of one parameter value, null when it names no catalog entry; a constant."""
    key = search_key(value)
    return F.when(~_is_blank(name, key), lookup(name, key))


def priority_rank(col: Column) -> Column:
    """Business order of priorities; unknown ones come last."""
    rank = F.lit(len(PRIORITY_ORDER))
    for position in reversed(range(len(PRIORITY_ORDER))):
        rank = F.when(col == PRIORITY_ORDER[position], F.lit(position)).otherwise(rank)
    return rank
