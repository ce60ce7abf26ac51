"""Column expressions over text: trimming, accent folding, lookup keys and tokens."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# The characters treated as white space, the byte-order mark, and the words
# dropped from token lists.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WS = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
BOM = "\ufeff"
STOP_WORDS = tuple(
    """
    el la los las un una unos unas de del al a en con por para y o u e que se
    su sus lo le les es son ser fue ha han este esta estos estas ese esa eso
    mi mis me te tu nos si no mas muy ya como cuando donde desde hasta sobre
    entre sin tras cada otro otra todo toda
    cual cuales cuanto cuanta cuantos cuantas quien quienes porque
    debo puedo necesito quiero tengo hay pasa
    """.split()
)
TOKEN = "[a-z0-9]{2,}"


def _accent_table() -> tuple[str, str]:
    """Precomposed letters and their base letter, derived from Unicode decompositions.

    No plane beyond the third holds a character with a decomposition.
    """
    source, target = [], []
    for code in range(0x80, 0x40000):
        char = chr(code)
        if 0xD800 <= code <= 0xDFFF or unicodedata.category(char) == "Mn":
            continue
        base = [c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn"]
        if len(base) == 1 and base[0] != char:
            source.append(char)
            target.append(base[0])
    return "".join(source), "".join(target)


ACCENTED, BASE = _accent_table()


def literal_map(entries: Mapping[str, object]) -> Column:
    """A small fixed table as a map literal inside the plan."""
    pairs = ", ".join(f"{key!r}, {value!r}" for key, value in entries.items())
    return F.expr(f"map({pairs})")


def strip(col: Column) -> Column:
    """Drop white space of any script from both ends."""
    return F.btrim(col, F.lit(WHITESPACE))


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def collapse(col: Column) -> Column:
    """Single blanks between words, none at the ends."""
    return F.btrim(F.regexp_replace(text_or_empty(col), f"{WS}+", " "), F.lit(" "))


def fold(col: Column) -> Column:
    """Lower case without accents: letters keep their base form, combining marks go.

    Text with as many bytes as characters has no accents to look for.
    """
    lowered = F.lower(col)
    bare = F.regexp_replace(F.translate(lowered, ACCENTED, BASE), r"\p{Mn}+", "")
    return F.when(F.octet_length(col) == F.length(col), lowered).otherwise(bare)


def search_key(col: Column) -> Column:
    """Lookup key of a hand-written value: byte-order mark, outer blanks, a leading
    ``number -`` prefix, repeated blanks, case and accents do not count."""
    bare = strip(F.replace(text_or_empty(col), F.lit(BOM), F.lit("")))
    unnumbered = F.regexp_replace(bare, rf"^[0-9]+{WS}*-{WS}*", "")
    return strip(fold(F.regexp_replace(unnumbered, f"{WS}+", " ")))


def tokens(col: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Words of two or more letters or digits, accent-free, without stop words."""
    words = F.regexp_extract_all(fold(text_or_empty(col)), F.lit(f"({TOKEN})"), F.lit(1))
    return F.filter(words, lambda word: ~word.isin(*stop_words)) if stop_words else words


def load_stop_words(table: DataFrame, max_rows: int = 10_000) -> tuple[str, ...]:
    """Stop words from a table ``(palabra)``, folded like tokens; more rows are an error."""
    rows = table.select(fold(F.col("palabra")).alias("palabra")).distinct().limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"a stop word table has more than {max_rows} rows")
    return tuple(sorted(row["palabra"] for row in rows))


def join_non_blank(separator: str, *cols: Column) -> Column:
    """Join the parts that have text, in order."""
    return F.concat_ws(separator, *[F.when(c != "", c) for c in cols])


def title_and_body(title: Column, body: Column) -> Column:
    """Text given to classifiers: title and body on separate lines, blank parts skipped."""
    return join_non_blank("\n", strip(text_or_empty(title)), strip(text_or_empty(body)))
