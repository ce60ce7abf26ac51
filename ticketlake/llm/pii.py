"""Personal data, also when disguised: normalise with an offset map, detect, map spans back.

The base kinds are found in the text as it stands. Then a transducer rewrites disguises: look-alike
characters become the ASCII characters they imitate, spelled digits become digits, and "at" and
"dot" in brackets (or bare between the parts of an address) become @ and a full stop. Every
rewritten character remembers the source characters it came from, so that an identifier found in
the rewritten text maps back to a span of the source. Spans that differ from every base span are
added to the base spans, which always stay: a disguise often leaves a base match on a part of itself.

Defined results: null and empty texts have no spans; null ids and repeated rows are treated like
any other row; other columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ticketlake.llm.common import whole_text
from ticketlake.llm.top_domains import TOP_DOMAINS

#: The kinds in the order that breaks ties.
KINDS = ("email", "ip", "card", "phone")

# Runs are matched possessively from where they begin, which finds what the plain patterns find,
# in linear time.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: Cyrillic and Greek letters that look like Latin ones, and signs like @ . + -
HOMOGLYPHS = dict(
    zip(
        "авекмнорстухіјѕԁԛԝАВЕКМНОРСТУХІЈЅαενορτυχικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ․。｡﹒‐‑‒–−﹢﹫",
        "abekmhopctyxijsdqwABEKMHOPCTYXIJSaevoptuxikABEZHIKMNOPTYX....-----+@",
        strict=True,
    )
)
#: Digits in words.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4",
    "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}
_WORD = "|".join(DIGIT_WORDS)
_NUMBER = rf"(?:{_WORD}|[0-9]++)"
_GAP = r"[\s,.()+-]{1,3}(?:double[\s-]|triple[\s-])?"
_SPELLED = re.compile(rf"(?<![^\W_]){_NUMBER}(?:{_GAP}{_NUMBER}){{3,}}(?![^\W_])", re.I)
_SPELLED_PART = re.compile(rf"(?:(double|triple)[\s-])?\b({_WORD})\b", re.I)
_SPOKEN_IP = re.compile(
    rf"(?<![^\W_]){_NUMBER}(?:\s{_NUMBER}){{0,2}}(?:\s+dot\s+{_NUMBER}(?:\s{_NUMBER}){{0,2}}){{3}}(?![^\W_])",
    re.I,
)
_SPOKEN_DOT = re.compile(r"\s+dot\s+", re.I)
_BRACKET = r"\s{{0,3}}[\[({{<]\s{{0,3}}(?:{})\s{{0,3}}[\])}}>]\s{{0,3}}"
_AT_WORDS, _AT_CODES = "at|@", r"&#0*64;|&commat;|%40"
_DOT_WORDS, _DOT_CODES = r"dot|punkt|point|punto|\.", r"&#0*46;|&period;"
_AT = re.compile(f"{_BRACKET.format(_AT_WORDS)}|{_AT_CODES}", re.I)
_DOT = re.compile(f"{_BRACKET.format(_DOT_WORDS)}|{_DOT_CODES}", re.I)
_LOOSE_AT = re.compile(r"(?<=[A-Za-z0-9])\s{0,2}@\s{0,2}(?=[A-Za-z0-9-]+\.[A-Za-z0-9])")
_PART = r"[A-Za-z0-9_%+-]++"
_ANY_DOT = r"(?:\.|\s++dot\s++)"
# Matches every word with the dots that follow it, so that a text is read once; the group ``at`` is
# there if it is an address. Bracketed signs are literal ones by then.
_BARE = re.compile(
    rf"{_PART}(?:{_ANY_DOT}{_PART})*+"
    rf"(?:(?P<at>\s{{0,2}}@\s{{0,2}}|\s+at\s+)(?P<domain>[A-Za-z0-9-]++(?:{_ANY_DOT}[A-Za-z0-9-]++)++))?",
    re.I,
)
_BARE_SIGN = re.compile(r"\s+(at|dot)\s+|\s{0,2}(@)\s{0,2}", re.I)
_LABEL = re.compile(rf"({_ANY_DOT})([A-Za-z0-9-]++)", re.I)
_PLUS = re.compile(r"(?<![^\W_])plus\s+(?=[0-9])", re.I)
_HIDDEN = re.compile("[­​-‍⁠﻿]+")
# What a text must hold for a pattern above to match, made of the same parts.
_SIGN_HINT = re.compile(
    rf"[\[({{<]\s{{0,3}}(?:{_AT_WORDS}|{_DOT_WORDS})|{_AT_CODES}|{_DOT_CODES}|\s@|@\s", re.I
)
_DOT_HINT = re.compile("dot", re.I)
_DIGIT_HINT = re.compile(rf"\b(?:{_WORD})\b|plus\s", re.I)


def _digits(run: str) -> str:
    return _NOT_DIGIT.sub("", run)


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base kinds, in order."""
    found = [(start, "email", end) for start, end in _emails(text)]
    for match in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in match[0].split(".")):
            found.append((match.start(), "ip", match.end()))
    for match in _CARD.finditer(text):
        digits = _digits(match[0])
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append((match.start(), "card", match.end()))
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 9 <= len(_digits(match[0])) <= 15:
                found.append((match.start(), "phone", match.end()))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


class Rewritten:
    """A text under rewriting: ``source[i]`` is the source span of its character i."""

    def __init__(self, text: str):
        self.text = text
        self.first = range(len(text))
        self.last = range(1, len(text) + 1)

    def replace(self, pattern: re.Pattern, put) -> bool:
        """Rewrites each match by ``put(match)``; the new characters share the match's source span."""
        parts, first, last, done = [], [], [], 0
        for match in pattern.finditer(self.text):
            new, (a, b) = put(match), match.span()
            if new is None or a == b:
                continue
            parts += [self.text[done:a], new]
            first += self.first[done:a]
            last += self.last[done:a]
            first += [self.first[a]] * len(new)
            last += [self.last[b - 1]] * len(new)
            done = b
        if parts:
            self.text = "".join([*parts, self.text[done:]])
            self.first = [*first, *self.first[done:]]
            self.last = [*last, *self.last[done:]]
        return bool(parts)

    def span(self, start: int, end: int) -> tuple[int, int]:
        return self.first[start], self.last[end - 1]


def _plain_character(character: str) -> str:
    """The ASCII character that another one imitates, or itself; always one for one."""
    if character in HOMOGLYPHS:
        return HOMOGLYPHS[character]
    digit = unicodedata.digit(character, None)
    if digit is not None:
        return str(digit)
    plain = unicodedata.normalize("NFKC", character)
    return plain if len(plain) == 1 and plain.isascii() else character


def _spelled(match: re.Match) -> str | None:
    """A run of spelled digits as digits; prose with a few number words stays as it is."""
    if not _SPELLED_PART.search(match[0]):
        return None
    digits = _spoken(match[0])
    return re.sub(r"(?<=[0-9])[\s,.]+(?=[0-9])", "", digits) if len(_digits(digits)) >= 9 else None


def _spoken(run: str) -> str:
    times = {"double": 2, "triple": 3}
    return _SPELLED_PART.sub(
        lambda m: DIGIT_WORDS[m[2].lower()] * times.get((m[1] or "").lower(), 1), run
    )


def _spoken_ip(match: re.Match) -> str:
    return re.sub(r"\s", "", _spoken(_SPOKEN_DOT.sub(".", match[0])))


def _domain_end(match: re.Match, general: bool) -> int | None:
    """Where the domain of an address with bare signs ends.

    That is after the last label that is a top domain, and never before a label behind a literal
    dot. Without one, an address with a literal sign may end in any label; a wholly bare one is prose.
    """
    start, end = match.start("domain"), None
    for label in _LABEL.finditer(match["domain"]):
        name = label[2].lower()
        if label[1] == "." or name in TOP_DOMAINS or name.startswith("xn--"):
            end = start + label.end()
    return end if end or not general else match.end("domain")


def _bare_signs(out: Rewritten) -> dict[int, str]:
    """Starts of the bare signs inside addresses. A bare "at" takes a disguised dot beside it: "at
    example.com" is prose."""
    signs = {}
    for match in _BARE.finditer(out.text):
        if match["at"] is None:
            continue
        bracketed = any(
            out.text[k] == "." and out.last[k] - out.first[k] > 1 for k in range(match.start(), match.end())
        )
        strong = "@" in match["at"] or bracketed
        if not strong and not _SPOKEN_DOT.search(match[0]):
            continue
        end = _domain_end(match, strong)
        for sign in _BARE_SIGN.finditer(out.text, match.start(), end or match.start()):
            signs[sign.start()] = "." if sign[1] and sign[1].lower() == "dot" else "@"
    return signs


def rewritten(text: str) -> Rewritten:
    """The transducers in turn: characters, signs, bare addresses, spelled digits."""
    if not text.isascii():
        unusual = {ord(c): p for c in set(text) if not c.isascii() and (p := _plain_character(c)) != c}
        text = text.translate(unusual) if unusual else text
    out, dots = Rewritten(text), False
    out.replace(_HIDDEN, lambda m: "")
    if _SIGN_HINT.search(out.text):
        out.replace(_AT, lambda m: "@")
        dots = out.replace(_DOT, lambda m: ".")
        out.replace(_LOOSE_AT, lambda m: "@" if len(m[0]) > 1 else None)
    if dots or _DOT_HINT.search(out.text):
        signs = _bare_signs(out)
        if signs:
            out.replace(_BARE_SIGN, lambda m: signs.get(m.start()) if m[0] != "@" else None)
        out.replace(_SPOKEN_IP, _spoken_ip)
    if _DIGIT_HINT.search(out.text):
        out.replace(_SPELLED, _spelled)
        out.replace(_PLUS, lambda m: "+")
    return out


def all_spans(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """The base spans, and all spans with those behind disguises, both in order."""
    base = base_spans(text)
    changed = rewritten(text)
    if changed.text == text:
        return base, base
    known, added = set(base), []
    for start, kind, end in base_spans(changed.text):
        first, last = changed.span(start, end)
        if (first, kind, last) not in known:
            known.add((first, kind, last))
            added.append((first, kind, last))
    return base, sorted([*base, *added], key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def personal_data(text: Column) -> Column:
    """A struct with the arrays ``base`` and ``spans`` of (start, kind, end), in code points."""

    @F.pandas_udf(
        "base array<struct<start: int, kind: string, end: int>>, "
        "spans array<struct<start: int, kind: string, end: int>>"
    )
    def detected(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([all_spans(t) for t in part], columns=["base", "spans"])

    return detected(text)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``(doc_id, base, spans)`` of every row."""
    return docs.select("doc_id", personal_data(whole_text()).alias("p")).select("doc_id", "p.*")


def redacted(text: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""

    @F.pandas_udf("string")
    def replaced(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def clean(value: str | None) -> str | None:
            if not value:
                return value
            pieces, done = [], 0
            for start, kind, end in all_spans(value)[1]:
                if start >= done:
                    pieces += [value[done:start], f"[{kind.upper()}]"]
                done = max(done, end)
            return "".join([*pieces, value[done:]]) if done else value

        for part in parts:
            yield part.map(clean)

    return replaced(text)


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced; ``n_chars``, where there is one, follows."""
    columns = docs.columns
    changed = docs.withColumn("text", redacted(F.col("text")))
    if "n_chars" in columns:
        counted = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))
        changed = changed.withColumn("n_chars", counted.cast(docs.schema["n_chars"].dataType))
    return changed.select(*[F.col(f"`{c}`") for c in columns])
