"""Catalogs and keyword rules that come from tables of any size.

The closed lists of the library travel inside the plan; these operators join instead, so neither the
driver nor a plan ever holds a dictionary. Lookups broadcast a dictionary of at most
``skew.DIMENSION_ROWS`` rows and meet a larger one by key, with the values that many rows share split.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from ticketlake.functions.catalogs import CATALOGS, Catalogs, catalog_state, lookup
from ticketlake.functions.text import search_key
from ticketlake.operators.rules import DEFAULT_RULE_CATEGORY, rule_priority
from ticketlake.operators.skew import DIMENSION_ROWS, HOT_ROWS, hot_keys, salted_join
from ticketlake.session import materialize

# Functions that run in tasks travel with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters of the piece that a keyword is searched by; a shorter keyword is its own piece.
GRAM = 4
#: Pieces of keywords that a task looks for in a text one by one.
FEW_GRAMS = 200


def _meet(rows: DataFrame, dictionary: DataFrame, key: str, how: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join on ``key``, which may be one value in any share of ``rows``."""
    if dictionary.limit(DIMENSION_ROWS + 1).count() <= DIMENSION_ROWS:
        return rows.join(F.broadcast(dictionary), key, how)
    hot = hot_keys(rows.groupBy(key).agg(F.count("*").alias("_n")), key, "_n", hot_rows)
    # Rows of a key may be equal, so they are told apart by the task they come from.
    spread = rows.withColumn("_task", F.spark_partition_id())
    return salted_join(spread, dictionary, key, hot, ["_task"], how).drop("_task")


def _one_row(df: DataFrame, columns: Sequence[str]) -> Column:
    """A row's own columns in one struct, so that their names can't meet the operator's."""
    return F.struct(*[F.col(f"`{name}`") for name in df.columns if name not in columns])


def catalog_entries(table: DataFrame) -> DataFrame:
    """``(catalogo, clave, valor)`` from a table ``(catalogo, forma, valor)``, one row per lookup key.

    Rows without a catalog are left out. A spelling with two values is an error.
    """
    entries = materialize(
        table.filter(F.col("catalogo").isNotNull())
        .select("catalogo", search_key(F.col("forma")).alias("clave"), F.struct("valor").alias("_v"))
        .groupBy("catalogo", "clave")
        .agg(F.min("_v").alias("_v"), F.max("_v").alias("_w"))
    )
    if twice := entries.filter(F.col("_v") != F.col("_w")).head(1):
        raise ValueError(f"two values for {twice[0]['clave']!r} in catalog {twice[0]['catalogo']!r}")
    return entries.select("catalogo", "clave", "_v.valor")


def standardize_by_table(
    df: DataFrame, columns: dict[str, str], table: DataFrame, defaults: Catalogs = CATALOGS
) -> DataFrame:
    """:func:`catalogs.standardize_catalogs` with catalogs from a table ``(catalogo, forma, valor)``.

    A catalog that the table names replaces the default one; spellings are compared by their lookup
    keys. Rows keep their number and their other columns; a column of a new name is replaced.
    """
    entries = catalog_entries(table)
    asked = set(columns.values())
    named = entries.select("catalogo").distinct().filter(F.col("catalogo").isin(*asked)).collect()
    given = {row["catalogo"] for row in named}
    out = df
    for new, old in columns.items():
        keyed = out.select(_one_row(out, (new,)).alias("_row"), search_key(F.col(f"`{old}`")).alias("clave"))
        if old in given:
            values = entries.filter(F.col("catalogo") == old).select("clave", F.col("valor").alias("_value"))
            read = _meet(keyed, values, "clave", "left")
        else:
            read = keyed.withColumn("_value", lookup(old, F.col("clave"), defaults))
        out = read.select("_row.*", catalog_state(old, F.col("clave"), F.col("_value")).alias(new))
    return out


def rule_keywords(table: DataFrame) -> DataFrame:
    """``(palabra, orden, categoria)`` from a table ``(orden, categoria, palabra)``: each folded
    keyword with its first rule.

    Rows without an order or a keyword are left out. Two categories for one order are an error.
    """
    rows = materialize(
        table.filter("orden is not null and palabra is not null").select(
            search_key(F.col("palabra")).alias("palabra"), "orden", "categoria"
        )
    )
    names = F.struct("categoria")
    several = rows.groupBy("orden").agg(F.min(names).alias("a"), F.max(names).alias("b")).filter("a != b")
    if twice := several.head(1):
        raise ValueError(f"two categories for rule {twice[0]['orden']!r}")
    return rows.groupBy("palabra").agg(
        F.min("orden").alias("orden"), F.min_by("categoria", "orden").alias("categoria")
    )


def _grams(chars: Column, length: int) -> Column:
    """All pieces of ``length`` characters of a text that is split into characters."""
    pieces = F.transform(
        chars, lambda _, i: F.concat(*[F.get(chars, i + j) for j in range(length)])
    )
    return F.array_compact(pieces)


def _with_grams(df: DataFrame, text: str, lengths: Sequence[int], *keep: str) -> DataFrame:
    """``(keep..., gram)``: the distinct pieces of the given lengths, linear in the text."""
    none = F.array().cast("array<string>")
    parted = df.select(*keep, F.split(F.col(text), "").alias("_chars"))
    pieces = [_grams(F.col("_chars"), length) for length in lengths]
    return parted.select(*keep, F.explode(F.array_distinct(F.concat(none, *pieces))).alias("gram"))


def anchored_keywords(keywords: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(gram, palabra, orden, categoria)``: each keyword by that piece of it which the fewest
    keywords hold, so that a beginning shared by all of them brings no candidates."""
    short = keywords.filter(F.length("palabra") < GRAM).withColumn("gram", F.col("palabra"))
    long = keywords.filter(F.length("palabra") >= GRAM)
    pieces = _with_grams(long, "palabra", [GRAM], "palabra", "orden", "categoria")
    counts = pieces.groupBy("gram").agg(F.count("*").alias("_n"))
    counted = salted_join(pieces, counts, "gram", hot_keys(counts, "gram", "_n", hot_rows), ["palabra"])
    rarest = counted.groupBy("palabra").agg(
        F.min_by(F.struct("gram", "orden", "categoria"), F.struct("_n", "gram")).alias("_a")
    )
    return rarest.select("_a.gram", "palabra", "_a.orden", "_a.categoria").unionByName(short)


def _first_keyword(listed: list[tuple[str, str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Gives the first of ``listed``, (gram, palabra) in the order of the rules, that a text holds. Up to
    ``FEW_GRAMS`` pieces are searched for one by one; with more, a text is cut into all of its own once."""
    by_gram = defaultdict(list)
    for rank, (gram, word) in enumerate(listed):
        by_gram[gram].append((rank, word))
    lengths = {len(gram) for gram in by_gram}

    def first(text: str) -> str | None:
        if len(by_gram) <= FEW_GRAMS:
            held = [gram for gram in by_gram if gram in text]
        else:
            held = by_gram.keys() & {text[i:i + n] for n in lengths for i in range(len(text) - n + 1)}
        candidates = sorted(entry for gram in held for entry in by_gram[gram])
        return next((word for _, word in candidates if word in text), None)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [None if key is None else first(key) for key in batch.column("_key").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_digest"), pa.array(words, "string")], ["_digest", "palabra"])

    return find


def first_rules(texts: DataFrame, keywords: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(_digest, orden, categoria)``: the first rule of each text that holds one of its keywords.

    ``texts``: (_digest, _key), one row per folded text, on a table or checkpoint. Texts and keywords
    meet where a text holds a keyword's piece; such candidates are confirmed on the whole text. Up to
    ``DIMENSION_ROWS`` keywords go to the texts, which do not move; with more, both meet by piece.
    """
    anchored = materialize(anchored_keywords(keywords.filter("palabra <> ''"), hot_rows))
    if anchored.limit(DIMENSION_ROWS + 1).count() <= DIMENSION_ROWS:
        listed = [(row["gram"], row["palabra"]) for row in anchored.orderBy("orden", "palabra").collect()]
        found = texts.select("_digest", "_key").mapInArrow(_first_keyword(listed), "_digest string, palabra string")
        rules = F.broadcast(anchored.select("palabra", "orden", "categoria"))
        return found.join(rules, "palabra").select("_digest", "orden", "categoria")
    lengths = [
        row["n"] for row in anchored.select(F.length("gram").alias("n")).distinct().orderBy("n").collect()
    ]
    pieces = _with_grams(texts, "_key", lengths, "_digest")
    candidates = _meet(pieces, anchored, "gram", "inner", hot_rows).drop("gram")
    return (
        candidates.join(texts, "_digest")
        .filter(F.contains("_key", "palabra"))
        .groupBy("_digest")
        .agg(F.min("orden").alias("orden"), F.min_by("categoria", "orden").alias("categoria"))
    )


def classify_by_rule_table(
    df: DataFrame, text: Column, table: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """:func:`rules.classify_by_rules` with rules from a table ``(orden, categoria, palabra)``.

    Adds ``categoria`` of the first rule with a keyword inside the folded text, and ``prioridad``.
    Each different text is matched once, whatever its number of rows. A keyword that folds to
    nothing stands in every text. Rows keep their number and their other columns.
    """
    keywords = materialize(rule_keywords(table))
    every = keywords.filter("palabra = ''").select("orden", "categoria").head()
    keyed = df.select(
        _one_row(df, ("categoria", "prioridad")).alias("_row"), search_key(text).alias("_key")
    ).withColumn("_digest", F.md5("_key"))
    texts = materialize(keyed.groupBy("_digest").agg(F.any_value("_key").alias("_key")))
    found = materialize(first_rules(texts, keywords, hot_rows))
    read = _meet(keyed, found, "_digest", "left", hot_rows)
    category, hit = F.col("categoria"), F.col("orden").isNotNull()
    if every is not None:
        before = hit & (F.col("orden") < F.lit(every["orden"]))
        category = F.when(before, category).otherwise(F.lit(every["categoria"]))
        hit = F.lit(True)
    return read.select(
        "_row.*",
        F.coalesce(F.when(hit, category), F.lit(DEFAULT_RULE_CATEGORY)).alias("categoria"),
        rule_priority(F.col("_key")).alias("prioridad"),
    )
