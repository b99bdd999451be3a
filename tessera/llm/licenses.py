"""License scans by template-markup matching.

A template is license wording with two kinds of regions: `[[ ... ]]` may be left out (regions may stand inside one another), and
`{{a-b}}` is replaced by a to b words of any kind. Each is compiled to an automaton over words: a state before every mandatory word, empty steps
around optional regions, and unrolled any-word steps for replaceable ones. It's made deterministic as it runs, a state set at a time, and
kept in the worker. A text matches where the automaton reads it to the end, so mandatory wording has to stand there exactly, word for word.

Words of a text are numbered by the templates' vocabulary with numpy over the bytes of a whole Arrow batch; an automaton starts only where a template's
first two words stand, and reads at most as many words as the template can have. What a hash has found is confirmed on the bytes. Base phrases are
places where their words stand consecutively. No row leaves its partition: there is no shuffle.

Defined results: null and empty texts have no words and no labels; texts of any length are read whole; rows that repeat a doc_id are scanned as rows; of the matches of
one template that start at the same word the longest counts; extra columns pass through `with_licenses`, whose own columns replace those of the same name; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import LOWER, slices, spans, word_hashes

#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall"
_BSD_END = "this software is provided by {{1-12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
#: Wording of public licenses and their notices (label: templates).
TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this [[ {{1-3}} ]] file except in compliance with the license [[ you may obtain a copy of the license at {{1-12}} ]] unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "gpl-2.0": ["gnu general public license [[ as published by the free software foundation ]] [[ either ]] version 2"],
    "gpl-3.0": ["gnu general public license [[ as published by the free software foundation ]] [[ either ]] version 3"],
    "gpl-or-later": ["gnu general public license as published by the free software foundation either version {{1-2}} of the license or at your option any later version"],
    "cc-by-nc": ["licensed under [[ a ]] cc by nc [[ sa ]] [[ nd ]] {{1-2}}", "creative commons attribution noncommercial [[ sharealike ]] {{1-2}} [[ international ]] license"],
    "cc-by-sa": ["licensed under [[ a ]] cc by sa {{1-2}}", "creative commons attribution sharealike {{1-2}} [[ international ]] license"],
    "mit-notice": ["released under the [[ terms of the ]] mit license"],
    "mit-text": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[ including the next paragraph ]] shall be included in all copies or substantial portions of the software "
        + _WARRANTY + " {{1-12}} be liable for any claim damages or other liability",
    ],
    "isc-text": ["permission to use copy modify and [[ or ]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "bsd-text": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[ 1 ]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[ 2 ]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution [[ [[ 3 ]] neither the name of {{1-12}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission ]] "
        + _BSD_END,
    ],
    "unlicense-text": ["this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"],
}

#: Of lowered bytes those that separate words.
GAP = np.array([b < 128 and not (48 <= b <= 57 or 97 <= b <= 122) for b in range(256)])
ANY = None


def parse(markup: str) -> list:
    """A template as a list of words, (least, most) of any words, and lists: optional regions."""
    stack: list[list] = [[]]
    for part in markup.split():
        if part == "[[":
            stack.append([])
        elif part == "]]":
            if len(stack) == 1:
                raise ValueError(f"a region ends that has not begun: {markup}")
            region = stack.pop()
            stack[-1].append(region)
        elif m := re.fullmatch(r"\{\{(\d+)-(\d+)\}\}", part):
            if int(m[1]) > int(m[2]):
                raise ValueError(f"{part} admits no words: {markup}")
            stack[-1].append((int(m[1]), int(m[2])))
        elif re.fullmatch(r"[a-z0-9\x80-\U0010ffff]+", part):
            stack[-1].append(part)
        else:
            raise ValueError(f"not a word or a region: {part}")
    if len(stack) > 1:
        raise ValueError(f"a region does not end: {markup}")
    if len(stack[0]) < 2 or not all(isinstance(x, str) for x in stack[0][:2]):
        raise ValueError(f"a template begins with two mandatory words: {markup}")
    return stack[0]


class Automaton:
    """Reads words of one template. `reads`: for each state the word that leads to the next state, or ANY; `skips`: for each state the
    states that it reaches without a word."""

    def __init__(self, markup: str) -> None:
        self.reads: list[str | None] = []
        self.skips: dict[int, set[int]] = {}
        parts = parse(markup)
        self._add(parts)
        self.end, self.start = len(self.reads), tuple(parts[:2])
        self._moves: dict[frozenset[int], dict[str | None, frozenset[int]]] = {}

    def _add(self, parts: list) -> None:
        for part in parts:
            begin = len(self.reads)
            if isinstance(part, str):
                self.reads.append(part)
            elif isinstance(part, tuple):
                self.reads += [ANY] * part[1]
                for k in range(part[0], part[1]):
                    self.skips.setdefault(begin + k, set()).add(begin + part[1])
            else:
                self._add(part)
                self.skips.setdefault(begin, set()).add(len(self.reads))

    def _whole(self, states: set[int]) -> frozenset[int]:
        todo = list(states)
        while todo:
            for x in self.skips.get(todo.pop(), set()) - states:
                states.add(x)
                todo.append(x)
        return frozenset(states)

    def longest(self, words: list[str | None]) -> int:
        """How many of the words, from the first, the longest match has; 0 without a match. Words outside the vocabulary are None."""
        at, found = self._whole({0}), 0
        for n, word in enumerate(words):
            moves = self._moves.setdefault(at, {})
            if word not in moves:
                moves[word] = self._whole({k + 1 for k in at if k < self.end and (self.reads[k] is ANY or self.reads[k] == word)})
            at = moves[word]
            if not at:
                break
            if self.end in at:
                found = n + 1
        return found


def pattern(markup: str) -> str:
    """The template as a regular expression over a text's words, each followed by a space (for SQL and tests)."""

    def of(parts: list) -> str:
        return "".join(f"{p} " if isinstance(p, str) else f"(?:[^ ]+ ){{{p[0]},{p[1]}}}" if isinstance(p, tuple) else f"(?:{of(p)})?" for p in parts)

    return of(parse(markup))


class Scanner:
    """Finds phrases and templates in batches of texts."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, list[str]]) -> None:
        self.phrases = [(p.split(), label) for p, label in phrases.items()]
        self.automata = [(Automaton(m), label) for label, of in templates.items() for m in of]
        words = sorted({w for p, _ in self.phrases for w in p} | {w for a, _ in self.automata for w in a.reads if w})
        raw = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
        starts, ends, _ = spans(raw, np.array([0, len(raw)]), GAP)
        h = word_hashes(raw, starts, ends)
        order = np.argsort(h)
        self.hashes, self.words = h[order], [None, *(words[k] for k in order)]
        self.number = {w: n for n, w in enumerate(self.words) if w}

    def _places(self, ids: np.ndarray, words: list[str] | tuple[str, ...], stop: np.ndarray) -> np.ndarray:
        """Where the words stand consecutively inside a document; `stop`: for each word the end of its document."""
        n = max(0, len(ids) - len(words) + 1)
        at = np.flatnonzero(ids[:n] == self.number[words[0]])
        for k, w in enumerate(words[1:], 1):
            at = at[ids[at + k] == self.number[w]]
        return at[at + len(words) <= stop[at]]

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple[bool, str, int, int, str]]]]:
        """For each text the number of its words and its matches (of a template, label, first word, words, wording), by place."""
        for lo, hi, raw, off in slices(texts):
            low = LOWER[raw]
            starts, ends, first = spans(low, off, GAP)
            ids, stop = np.empty(0, dtype=np.int64), np.repeat(first[1:], np.diff(first))
            if len(starts):
                h = word_hashes(low, starts, ends)
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                ids = np.where(self.hashes[at] == h, at + 1, 0)
            found: dict[int, list] = {}

            def keep(method: bool, label: str, at: int, n: int) -> None:
                known = [self.words[k] for k in ids[at : at + n]]
                if all(w is None or low[starts[at + k] : ends[at + k]].tobytes() == w.encode() for k, w in enumerate(known)):  # noqa: B023
                    wording = raw[starts[at] : ends[at + n - 1]].tobytes().decode()  # noqa: B023
                    doc = int(np.searchsorted(first, at, side="right")) - 1  # noqa: B023
                    found.setdefault(doc, []).append((method, label, at - int(first[doc]), n, wording))  # noqa: B023

            for words, label in self.phrases:
                for at in self._places(ids, words, stop).tolist():
                    keep(False, label, at, len(words))
            for automaton, label in self.automata:
                for at in self._places(ids, automaton.start, stop).tolist():
                    if n := automaton.longest([self.words[k] for k in ids[at : min(at + automaton.end, stop[at])].tolist()]):
                        keep(True, label, at, n)
            for i in range(hi - lo):
                yield int(first[i + 1] - first[i]), sorted(found.get(i, []), key=lambda x: (x[2], x[0], x[1], x[3]))


_MATCHES = "array<struct<template boolean, label string, first long, words long, wording string>>"


def _scanned(phrases: dict[str, str], templates: dict[str, list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        kind = pa.list_(pa.struct([("template", pa.bool_()), ("label", pa.string()), ("first", pa.int64()), ("words", pa.int64()), ("wording", pa.string())]))
        for batch in batches:
            n, found = [], []
            for size, matches in scanner.scan(batch.column(1)):
                n.append(size)
                found.append([dict(zip(("template", "label", "first", "words", "wording"), m, strict=True)) for m in matches])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(found, kind)], [batch.schema.names[0], "n_words", "matches"])

    return run


def _labels(matches: str) -> str:
    return f"array_join(array_sort(array_distinct(transform({matches}, m -> m.label))), ',')"


_BASE = "filter(matches, m -> not m.template)"
COLUMNS = {
    "n_words": "n_words",
    "n_base": f"cast(size({_BASE}) as bigint)",
    "first_word": f"array_min(transform({_BASE}, m -> m.first))",
    "last_word": f"array_max(transform({_BASE}, m -> m.first))",
    "base_labels": _labels(_BASE),
    "labels": _labels("matches"),
    "score": f"case when exists(matches, m -> m.template) then 1.0D when size({_BASE}) > 0 then 0.5D else 0.0D end",
}


def license_report(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (1 where a template matches, 0.5 where only a phrase does)."""
    found = docs.select("doc_id", "text").mapInArrow(_scanned(phrases, templates), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, matches {_MATCHES}")
    return found.select("doc_id", *(F.expr(x).alias(c) for c, x in COLUMNS.items()))


def license_matches(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """One row for each match: doc_id, template (or a base phrase), label, first (its first word, from 0), words (how many), wording as it stands in the text."""
    found = docs.select("doc_id", "text").mapInArrow(_scanned(phrases, templates), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, matches {_MATCHES}")
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def with_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """The documents, all columns, with base_labels, labels and score."""
    rows = docs.select(F.struct("*").alias("_row"), "text").mapInArrow(_scanned(phrases, templates), f"_row {docs.schema.simpleString()}, n_words long, matches {_MATCHES}")
    added = ("base_labels", "labels", "score")
    return rows.select(*(F.col(f"_row.`{c}`") for c in docs.columns if c.lower() not in added), *(F.expr(COLUMNS[c]).alias(c) for c in added))
