"""Citations, document headers, embedded JSON and content fingerprints as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ticketlake.functions.text import WS, strip, text_or_empty

# Shapes of a citation, a document code, a version mark and a JSON object.
CITATION = rf"\b([A-Z]{{2,4}}-[A-Z]{{2,4}}-[0-9]{{2,3}}){WS}*§{WS}*([0-9]{{1,2}}(?:\.[0-9]{{1,2}})?)"
DOCUMENT_CODE = rf"C[óo]digo{WS}+([A-Z]{{2,4}}-[A-Z]{{2,4}}-[0-9]{{2,3}})"
VERSION = rf"Versi[óo]n{WS}+([^\x09-\x0d\x1c-\x20\x{{85}}\x{{a0}}\x{{2028}}\x{{2029}}]+)"
JSON_OBJECT = r"(?s)(\{.*?\})"
NO_VERSION = "sin versión"
MAX_KEY = 128


def citations(col: Column) -> Column:
    """Distinct citations of a text in order of appearance, written ``CODE §SECTION``."""
    text = text_or_empty(col)
    codes = F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))
    sections = F.regexp_extract_all(text, F.lit(CITATION), F.lit(2))
    return F.array_distinct(F.zip_with(codes, sections, lambda c, s: F.concat_ws(" §", c, s)))


def document_header(text: Column, fallback: Column) -> Column:
    """``struct<documento, titulo_documento, version>`` read from the first five lines with text."""
    lines = F.filter(
        F.transform(F.split(text, r"[\n\x{2028}\x{2029}]"), strip), lambda line: line != ""
    )
    head = F.concat_ws("\n", F.slice(lines, 1, 5))
    found = [F.regexp_extract(head, pattern, 1) for pattern in (DOCUMENT_CODE, VERSION)]
    return F.struct(
        F.when(found[0] != "", found[0]).otherwise(fallback).alias("documento"),
        F.coalesce(F.get(lines, F.lit(0)), fallback).alias("titulo_documento"),
        F.when(found[1] != "", found[1]).otherwise(F.lit(NO_VERSION)).alias("version"),
    )


def first_json_object(col: Column) -> Column:
    """``struct<categoria, prioridad, legible>`` of the first ``{...}`` inside a text."""
    found = F.regexp_extract(text_or_empty(col), JSON_OBJECT, 1)
    parsed = F.from_json(
        found,
        "categoria string, prioridad string, _roto string",
        {"columnNameOfCorruptRecord": "_roto", "allowSingleQuotes": "false"},
    )
    return F.struct(
        parsed["categoria"].alias("categoria"),
        parsed["prioridad"].alias("prioridad"),
        ((found != "") & parsed["_roto"].isNull()).alias("legible"),
    )


def fingerprint(**fields: Column) -> Column:
    """SHA-256 over the fields as JSON with sorted names; equal content, equal fingerprint."""
    ordered = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def idempotency_key(col: Column) -> Column:
    """``struct<clave, valida>``: blank keys are absent, keys over 128 characters are invalid."""
    key = F.nullif(strip(col), F.lit(""))
    valid = F.coalesce(F.length(key) <= MAX_KEY, F.lit(True))
    return F.struct(F.when(valid, key).alias("clave"), valid.alias("valida"))
