"""License scans: template markup compiled to token automata.

A template is plain wording with two kinds of marked regions: ``<<optional>> ... <<end>>`` may be
left out, and ``<<var:N>>`` stands for one to N words of the user's own (a year, a holder, a
version). Everything else is mandatory and must match exactly, word by word, after A-Z are
lower-cased and everything that isn't a word is dropped. Each template becomes an automaton over
words; it accepts a text at every place where some run of words spells the template.

Besides the templates there are base phrases, found wherever their words stand consecutively.

Defined results: null and empty texts have no words, no places and no labels; repeated rows and
null ids are scanned like any other row; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ticketlake.llm.common import whole_text

#: Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Wording of public licenses and of their notices, as templates by label.
TEMPLATES = {
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 <<optional>>(the \"License\"); you may not "
        "use this file except in compliance with the License. You may obtain a copy of the License "
        "at <<optional>>http https<<end>> <<var:8>> Unless required by applicable law or agreed to "
        "in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.<<end>>"
    ),
    "cc-by-4.0-notice": (
        "Licensed under <<optional>>a<<end>> <<optional>>Creative Commons<<end>> CC BY 4.0"
    ),
    "cc-by-nc-4.0-notice": (
        "Licensed under <<optional>>a<<end>> <<optional>>Creative Commons<<end>> CC BY-NC 4.0"
    ),
    "cc-by-sa-4.0-notice": (
        "Licensed under <<optional>>a<<end>> <<optional>>Creative Commons<<end>> CC BY-SA 4.0"
    ),
    "gpl-notice": (
        "This <<optional>>work<<end>> <<optional>>program<<end>> is licensed under the "
        "<<optional>>terms of the<<end>> GNU General Public License <<optional>>, version "
        "<<var:2>><<end>>"
    ),
    "gpl-redistribution-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either "
        "version <<var:2>> of the License, or (at your option) any later version."
    ),
    "mit-notice": "Released under the <<optional>>terms of the<<end>> MIT License",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice <<optional>>(including the next "
        "paragraph)<<end>> shall be included in all copies or substantial portions of the Software."
    ),
    "bsd-notice": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: <<optional>>1<<end>> "
        "Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies."
    ),
}

_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())
_MARK = re.compile(r"<<(optional|end|var:(\d+))>>")


def words_of(text: str) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass(frozen=True)
class Automaton:
    """States are 0 .. accept. ``arcs[s]`` maps a word to the next states, ``wild[s]`` lists next
    states that take any word, ``free[s]`` next states that take none."""

    arcs: tuple[Mapping[bytes, tuple[int, ...]], ...]
    wild: tuple[tuple[int, ...], ...]
    free: tuple[tuple[int, ...], ...]
    accept: int

    def closed(self, states: set[int]) -> set[int]:
        """The states and all that follow without a word."""
        todo = list(states)
        while todo:
            for state in self.free[todo.pop()]:
                if state not in states:
                    states.add(state)
                    todo.append(state)
        return states

    def anchors(self) -> set[bytes]:
        """Words of which a match must start with one."""
        return {word for state in self.closed({0}) for word in self.arcs[state]}

    def match(self, words: list[bytes], start: int) -> int:
        """The end of the longest accepted run from ``start``, or -1."""
        states, best = self.closed({0}), -1
        for place in range(start, len(words)):
            following = set()
            for state in states:
                following.update(self.arcs[state].get(words[place], ()))
                following.update(self.wild[state])
            states = self.closed(following)
            if self.accept in states:
                best = place + 1
            if not states:
                break
        return best


def compile_template(template: str) -> Automaton:
    """Compiles marked wording; a template must start with mandatory or optional words."""
    arcs: list[dict[bytes, tuple[int, ...]]] = [{}]
    wild: list[tuple[int, ...]] = [()]
    free: list[tuple[int, ...]] = [()]

    def state() -> int:
        arcs.append({})
        wild.append(())
        free.append(())
        return len(arcs) - 1

    def spell(text: str) -> None:
        for word in words_of(text):
            here = len(arcs) - 1
            arcs[here][word] = (*arcs[here].get(word, ()), state())

    opened, last = [], 0
    for mark in _MARK.finditer(template):
        spell(template[last : mark.start()])
        last = mark.end()
        if mark[1] == "optional":
            opened.append(state())
            free[opened[-1] - 1] += (opened[-1],)
        elif mark[1] == "end":
            begun, ended = opened.pop(), state()
            free[ended - 1] += (ended,)
            free[begun] += (ended,)
        else:
            first = len(arcs) - 1
            chain = [first, *(state() for _ in range(int(mark[2])))]
            for a, b in zip(chain, chain[1:]):
                wild[a] += (b,)
            ended = state()
            for b in chain[1:]:
                free[b] += (ended,)
    spell(template[last:])
    if opened:
        raise ValueError("a region isn't closed")
    found = Automaton(tuple(arcs), tuple(wild), tuple(free), len(arcs) - 1)
    if not found.anchors() or any(found.wild[s] for s in found.closed({0})) or found.accept in found.closed({0}):
        raise ValueError("a template must start with its own wording")
    return found


def word_places(joined: bytes, needle: bytes) -> Iterator[int]:
    """Words before each place of a needle that starts with a blank, in one pass over the text."""
    at, words, counted = joined.find(needle), 0, 0
    while at >= 0:
        words += joined.count(b" ", counted, at)
        counted = at
        yield words
        at = joined.find(needle, at + 1)


class Scanner:
    def __init__(self, phrases: Mapping[str, str], templates: Mapping[str, str]):
        self.phrases = [
            (b" " + b" ".join(words_of(phrase)) + b" ", label) for phrase, label in phrases.items()
        ]
        self.automata = {label: compile_template(t) for label, t in templates.items()}
        # A text can match only if it has all words of some path; the rarest mandatory word of each
        # template sends most texts past its automaton.
        self.needles = {
            label: b" " + max(words_of(_mandatory(t)), key=len) + b" " for label, t in templates.items()
        }

    def scan(self, text: str) -> tuple:
        """(words, base places as (start, label), template places as (start, end, label))."""
        words = words_of(text)
        joined = b" " + b" ".join(words) + b" "
        base, found = [], []
        for phrase, label in self.phrases:
            base += [(start, label) for start in word_places(joined, phrase)]
        for label, automaton in self.automata.items():
            if self.needles[label] not in joined:
                continue
            for anchor in automaton.anchors():
                for start in word_places(joined, b" " + anchor + b" "):
                    end = automaton.match(words, start)
                    if end >= 0:
                        found.append((start, end, label))
        return len(words), sorted(base), sorted(found)


def _mandatory(template: str) -> str:
    """The wording outside all marked regions."""
    kept, depth, last = [], 0, 0
    for mark in _MARK.finditer(template):
        if not depth:
            kept.append(template[last : mark.start()])
        depth += {"optional": 1, "end": -1}.get(mark[1], 0)
        last = mark.end()
    return " ".join([*kept, template[last:]])


def license_places(
    text: Column, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES
) -> Column:
    """A struct: n_words, base places (word, label), template places (first word, end word, label)."""

    @F.pandas_udf(
        "n_words long, base array<struct<word: long, label: string>>, "
        "templates array<struct<word: long, end: long, label: string>>"
    )
    def scanned(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(phrases, templates)
        for part in parts:
            yield pd.DataFrame(
                [scanner.scan(t) for t in part], columns=["n_words", "base", "templates"]
            )

    return scanned(text)


def scan_documents(
    docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES
) -> DataFrame:
    """``(doc_id, n_words, base, templates)`` of every row."""
    places = license_places(whole_text(), phrases, templates).alias("p")
    return docs.select("doc_id", places).select("doc_id", "p.*")
