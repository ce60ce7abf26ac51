"""Numbered policy documents cut into citable fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ticketlake.functions.citations import document_header
from ticketlake.functions.text import collapse, join_non_blank, strip, text_or_empty
from ticketlake.operators.skew import settled

# Shapes of section and subsection lines, and the shortest useful fragment.
_BLANK = (
    r"[\x09\x0b-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
)
_LETTER = r"[\p{L}\p{Nl}\p{No}]"
SECTION = rf"{_BLANK}*(\p{{Nd}}{{1,2}})\.{_BLANK}+({_LETTER}[^\n]*)"
SUBSECTION = rf"{_BLANK}*(\p{{Nd}}{{1,2}}\.\p{{Nd}}{{1,2}})\.{_BLANK}+({_LETTER}[^\n]*)"
SECTION_START = rf"(?dm)^(?={SECTION})"
SUBSECTION_START = rf"(?dm)^(?={SUBSECTION})"
MIN_FRAGMENT = 20
UNREADABLE, NO_SECTIONS, ALL_SHORT = "texto_ilegible", "sin_secciones", "secciones_cortas"


def plain_lines(col: Column) -> Column:
    """Text whose only control character is the line feed."""
    return F.regexp_replace(
        F.regexp_replace(text_or_empty(col), r"[\p{Cc}&&[^\n]]", " "), r"[\x{2028}\x{2029}]", "\n"
    )


def chunk_sections(docs: DataFrame) -> DataFrame:
    """Fragments ``(doc_id, posicion, documento, titulo_documento, version, seccion,
    titulo_seccion, titulo_padre, texto, corto)`` of documents ``(doc_id, file_name, text)``.

    ``N. Title`` opens a section and ``N.M. text`` a subsection, whose parent title is the title
    of the section it sits in; text before the first number is ignored. Each document is cut by
    two regular-expression splits inside its own row, so there is no shuffle and no window, and a
    document costs time linear in its length.
    """
    lines = docs.select("doc_id", "file_name", plain_lines(F.col("text")).alias("text"))
    headed = lines.withColumn("h", document_header(F.col("text"), F.col("file_name")))
    parts = headed.select(
        "doc_id",
        "h",
        F.posexplode_outer(F.split("text", SECTION_START)).alias("part", "body"),
    )
    pieces = parts.select(
        "doc_id",
        "h",
        "part",
        strip(F.regexp_extract("body", f"^{SECTION}", 2)).alias("section_title"),
        F.posexplode_outer(F.split("body", SUBSECTION_START)).alias("piece", "body"),
    )
    found = settled(
        pieces,
        {
            "section": F.regexp_extract("body", f"^{SECTION}", 1),
            "subsection": F.regexp_extract("body", f"^{SUBSECTION}", 1),
        },
    ).filter((F.col("section") != "") | (F.col("subsection") != ""))
    is_sub = F.col("subsection") != ""
    first_words = F.when(is_sub, F.regexp_extract("body", f"^{SUBSECTION}", 2)).otherwise("")
    rest = F.regexp_replace("body", r"^[^\n]*\n?", "")
    cut = found.select(
        "doc_id",
        F.struct("part", "piece").alias("posicion"),
        "h.*",
        F.when(is_sub, F.col("subsection")).otherwise(F.col("section")).alias("seccion"),
        F.when(is_sub, "").otherwise(F.col("section_title")).alias("titulo_seccion"),
        F.when(is_sub, F.col("section_title")).otherwise("").alias("titulo_padre"),
        collapse(F.concat_ws(" ", first_words, rest)).alias("texto"),
    )
    return settled(cut, {"texto": F.col("texto"), "corto": F.length("texto") < MIN_FRAGMENT})


def citation_of(document: Column, section: Column) -> Column:
    return F.concat(document, F.lit(" §"), section)


def fragments(docs: DataFrame) -> DataFrame:
    """Fragments long enough to search, with their citation and the text to index."""
    kept = chunk_sections(docs).filter(~F.col("corto")).drop("corto")
    return kept.withColumns(
        {
            "cita": citation_of(F.col("documento"), F.col("seccion")),
            "texto_para_buscar": join_non_blank(
                " ", F.col("titulo_padre"), F.col("titulo_seccion"), F.col("texto")
            ),
        }
    )


def ingestion_report(docs: DataFrame) -> DataFrame:
    """Documents read and unreadable (null text), fragments kept and discarded as too short."""
    readable = docs.agg(
        F.count("text").alias("documentos_leidos"),
        F.count_if(F.col("text").isNull()).alias("documentos_ilegibles"),
    )
    counts = chunk_sections(docs.filter(F.col("text").isNotNull())).agg(
        F.count_if(~F.col("corto")).alias("fragmentos"),
        F.count_if(F.col("corto")).alias("descartados_por_cortos"),
    )
    # One row meets one row, so the documents are cut once for both counts.
    return readable.crossJoin(counts).select(
        "documentos_leidos", "fragmentos", "descartados_por_cortos", "documentos_ilegibles"
    )


def document_outcomes(docs: DataFrame) -> DataFrame:
    """``(doc_id, file_name, fragmentos, descartados, motivo)`` of every document.

    The motive is null if the document gave fragments; otherwise its text was unreadable, it had no
    numbered section, or all its sections were too short.
    """
    counts = chunk_sections(docs.filter(F.col("text").isNotNull())).groupBy("doc_id").agg(
        F.count_if(~F.col("corto")).alias("fragmentos"),
        F.count_if(F.col("corto")).alias("descartados"),
    )
    none = F.lit(0).cast("bigint")
    return docs.join(counts, "doc_id", "left").select(
        "doc_id",
        "file_name",
        F.coalesce("fragmentos", none).alias("fragmentos"),
        F.coalesce("descartados", none).alias("descartados"),
        F.when(F.col("text").isNull(), F.lit(UNREADABLE))
        .when(F.col("fragmentos").isNull(), F.lit(NO_SECTIONS))
        .when(F.col("fragmentos") == 0, F.lit(ALL_SHORT))
        .alias("motivo"),
    )
