"""Catalogs and rules from tables against plain lookups, at any size."""

import random

import pytest
from pyspark.sql import functions as F

from ticketlake.functions.catalogs import standardize_catalogs
from ticketlake.operators import dictionaries, rules
from ticketlake.operators.dictionaries import classify_by_rule_table, standardize_by_table

RULE = "orden long, categoria string, palabra string"
ENTRY = "catalogo string, forma string, valor string"


def first_category(key, listed):
    hits = [(order, category) for order, category, word in listed if word in key]
    return min(hits)[1] if hits else rules.DEFAULT_RULE_CATEGORY


def test_rules_against_brute_force(spark):
    draw = random.Random(4)

    def word(low, high):
        return "".join(draw.choices("abc", k=draw.randint(low, high)))

    listed = [(k, f"c{k % 7}", word(2, 9)) for k in range(60)]
    texts = [(k, " ".join(word(1, 6) for _ in range(draw.randint(0, 4)))) for k in range(400)]
    docs = spark.createDataFrame(texts, "id long, t string")
    table = spark.createDataFrame(listed, RULE)
    found = {r["id"]: r["categoria"] for r in classify_by_rule_table(docs, F.col("t"), table).collect()}
    assert found == {k: first_category(t, listed) for k, t in texts}
    assert len(set(found.values())) > 3


def test_rules_agree_with_the_fixed_list(spark, sf_dir):
    listed = [(k, c, w) for k, (c, words) in enumerate(rules.RULES) for w in words]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(
        spark.createDataFrame([(-1, "Mi CONTRASEÑA"), (-2, "pago de la Nomina urgente"), (-3, "hotel")], docs.schema)
    )
    columns = ["doc_id", "categoria", "prioridad"]
    given = classify_by_rule_table(docs, F.col("text"), spark.createDataFrame(listed, RULE)).select(columns)
    fixed = rules.classify_by_rules(docs, F.col("text")).select(columns)
    assert sorted(given.collect()) == sorted(fixed.collect())


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_odd_rules_and_repeated_texts(spark, monkeypatch, broadcast):
    """Nulls, short words, signs beyond the first plane, rows that share names and texts."""
    monkeypatch.setattr(dictionaries, "DIMENSION_ROWS", broadcast)
    table = spark.createDataFrame(
        [(2, "dos", "Ñandú"), (1, "uno", "x"), (3, "tres", "\U0001f600\U0001f601\U0001f602\U0001f603!"), (4, None, "cuatro"),
         (None, "nada", "zz"), (5, "nada", None), (2, "dos", "nandu"), (2, "dos", "zorro")],
        RULE,
    )
    texts = ["un nandu", "NANDÚ x", "ab\U0001f600\U0001f601\U0001f602\U0001f603!", "cuatro", "zz", None, ""]
    rows = [(t, "clash", "clash", "clash") for t in texts] + [("zorro", "c", "c", "c")] * 50
    docs = spark.createDataFrame(rows, "t string, gram string, _row string, categoria string")
    read = classify_by_rule_table(docs, F.col("t"), table, hot_rows=10)
    assert read.columns == ["t", "gram", "_row", "categoria", "prioridad"]
    got = sorted((r["t"] or "", r["categoria"]) for r in read.collect())
    expected = dict(zip(texts, ["dos", "uno", "tres", "Otros", "Otros", "Otros", "Otros"], strict=True))
    assert got == sorted([(t or "", c) for t, c in expected.items()] + [("zorro", "dos")] * 50)


def test_a_rule_for_every_text(spark):
    docs = spark.createDataFrame([("a b",), ("",), ("temprano",)], "t string")
    table = spark.createDataFrame([(5, "todo", "  "), (1, "uno", "temp"), (9, "nueve", "a b")], RULE)
    found = {r["t"]: r["categoria"] for r in classify_by_rule_table(docs, F.col("t"), table).collect()}
    assert found == {"a b": "todo", "": "todo", "temprano": "uno"}


def test_empty_tables(spark):
    docs, table = spark.createDataFrame([("a",)], "t string"), spark.createDataFrame([(1, "c", "a")], RULE)
    assert classify_by_rule_table(docs.limit(0), F.col("t"), table).count() == 0
    assert classify_by_rule_table(docs, F.col("t"), table.limit(0)).head()["categoria"] == "Otros"
    entries = spark.createDataFrame([("area", "a", "A")], ENTRY)
    read = standardize_by_table(docs.withColumn("area", F.lit("Compras")), {"v": "area"}, entries.limit(0))
    assert read.head()["v"]["valor"] == "Compras"


def test_contradictions_are_errors(spark):
    docs = spark.createDataFrame([("a", "b")], "t string, area string")
    with pytest.raises(ValueError, match="two categories for rule 1"):
        classify_by_rule_table(docs, F.col("t"), spark.createDataFrame([(1, "a", "x"), (1, "b", "y")], RULE))
    with pytest.raises(ValueError, match="two values for 'x'"):
        standardize_by_table(docs, {"v": "area"}, spark.createDataFrame([("area", "X", "a"), ("area", " x", "b")], ENTRY))


def test_two_hundred_thousand_rules(spark):
    """All keywords begin alike; the first rule of each text is known from how it was written."""
    table = spark.range(200_000).select(
        F.col("id").alias("orden"), F.concat(F.lit("c"), F.col("id") % 1000).alias("categoria"),
        F.concat(F.lit("codigo de error "), F.lpad(F.hex(F.col("id") * 7919), 8, "0"), F.lit("#")).alias("palabra"),
    )
    number = (F.col("id") * 97) % 200_000
    text = F.concat(
        F.lit("aparece el Código de Error "), F.lpad(F.hex((number + 1000) * 7919), 8, "0"), F.lit("# y el codigo de error "),
        F.lpad(F.hex(number * 7919), 8, "0"), F.lit("# también"),
    )
    docs = spark.range(2000).withColumns({"n": number, "t": text})
    read = classify_by_rule_table(docs, F.col("t"), table)
    assert read.filter(F.col("categoria") == F.concat(F.lit("c"), F.col("n") % 1000)).count() == 2000


def test_a_million_catalog_entries(spark):
    """A shuffled lookup; two thirds of the rows hold one value."""
    table = spark.range(1_000_000).select(
        F.lit("area").alias("catalogo"), F.concat(F.lit("Área "), "id").alias("forma"), F.concat(F.lit("A"), "id").alias("valor"),
    )
    written = F.when(F.col("id") % 3 > 0, F.lit("7 - AREA  5")).when(F.col("id") % 2 == 0, F.lit("otra")).otherwise(
        F.concat(F.lit("area "), F.col("id") * 11)
    )
    df = spark.range(60_000).withColumn("area", written)
    read = standardize_by_table(df, {"v": "area"}, table)
    want = F.when(F.col("id") % 3 > 0, F.lit("A5")).when(F.col("id") % 2 == 1, F.concat(F.lit("A"), F.col("id") * 11))
    assert read.count() == 60_000
    assert read.filter(F.col("v.valor").eqNullSafe(want)).count() == 60_000
    assert read.filter("v.motivo = 'valor_fuera_de_catalogo'").count() == 10_000


def test_table_and_fixed_catalogs_agree(spark):
    df = spark.createDataFrame([(" 1 - Gestión de  Accesos",), ("N/A",), ("",), (None,), ("otra",)], "categoria string")
    table = spark.createDataFrame([("categoria", "gestion de ACCESOS", "Accesos"), ("area", "x", "X")], ENTRY)
    assert standardize_by_table(df, {"v": "categoria"}, table).collect() == standardize_catalogs(df, {"v": "categoria"}).collect()
