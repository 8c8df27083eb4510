"""License scan: templates with optional and replaceable regions, compiled to automata over words.

A template is licence wording with markup::

    <<beginOptional>> ... <<endOptional>>         words that may be missing, all or none (regions nest)
    <<var;match="[0-9]+";least="1";most="2">>     between ``least`` and ``most`` words that each match the pattern in full

Everything else is mandatory and must occur word for word. The template becomes a Thompson automaton whose letters are
words; places in a text where it accepts are found from each occurrence of its possible first words, longest match
first. A text is only walked when it holds the template's longest run of mandatory words, so almost all texts cost one
substring search per template.

Defined results: a null or empty text has no words and no spans; a repeated row gives a repeated result; a null id is
kept; an empty table gives an empty result; other columns of the input are left alone. Texts are taken whole, one batch
of rows at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.text import blobs, letter_words, table

#: Fixed values of the contract: phrase and label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_LINK = '<<var;match="https?|www|[a-z0-9]+";least="1";most="8">>'
_HOLDER = '<<beginOptional>>copyright <<var;match=".+";least="0";most="12">><<beginOptional>>all rights reserved<<endOptional>><<endOptional>>'
_DISCLAIMER = (
    'this software is provided by <<var;match=".+";least="1";most="8">> as is and any express or implied warranties including but not limited to '
    "the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
)
_BSD = (
    f"{_HOLDER} redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    '<<var;match="1";least="0";most="1">> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer '
    '<<var;match="2";least="0";most="1">> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following '
    "disclaimer in the documentation and or other materials provided with the distribution "
)
#: Wording of public licences and of the notices that grant them, by label.
TEMPLATES = {
    "mit-text": (
        f"<<beginOptional>>the mit license<<beginOptional>>mit<<endOptional>><<endOptional>>{_HOLDER} permission is hereby granted free of charge to any person "
        "obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
        "furnished to do so subject to the following conditions the above copyright notice and this permission notice "
        "<<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software "
        "<<beginOptional>>the software is provided as is without warranty of any kind express or implied<<endOptional>>"
    ),
    "isc-text": (
        f"{_HOLDER} permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies"
    ),
    "bsd-3-clause-text": _BSD + (
        '<<var;match="3";least="0";most="1">> neither the name of <<var;match=".+";least="1";most="10">> nor the names of its contributors may be used to endorse or '
        f"promote products derived from this software without specific prior written permission {_DISCLAIMER}"
    ),
    "bsd-2-clause-text": f"{_BSD}{_DISCLAIMER}",
    "apache-2.0-notice": (
        "licensed under the apache license version 2 0 "
        "<<beginOptional>>the license you may not use this file except in compliance with the license "
        f"<<beginOptional>>you may obtain a copy of the license at {_LINK}<<endOptional>><<endOptional>>"
    ),
    "gpl-notice": (
        '<<beginOptional>>this <<var;match="work|program|software|file|library|project";least="1";most="1">> is<<endOptional>> licensed under '
        '<<beginOptional>>the terms of<<endOptional>> the gnu general public license <<var;match="v|version";least="1";most="1">> '
        '<<var;match="[123]";least="1";most="1">> <<beginOptional>>or <<beginOptional>>at your option<<endOptional>> any later version<<endOptional>>'
    ),
    "gpl-header": (
        "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
        'foundation <<var;match="either|only";least="0";most="1">> version <<var;match="[123]";least="1";most="1">> of the license '
        "<<beginOptional>>or at your option any later version<<endOptional>>"
    ),
    "mit-notice": (
        '<<var;match="released|licensed|distributed|available|published";least="1";most="1">> under <<beginOptional>>the terms of<<endOptional>> '
        "<<beginOptional>>the<<endOptional>> mit license"
    ),
    "cc-by-notice": (
        '<<var;match="released|licensed|distributed|available|published|shared";least="1";most="1">> under <<beginOptional>>a<<endOptional>> '
        '<<beginOptional>>the<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc by '
        '<<var;match="sa|nc|nd";least="0";most="2">> <<var;match="[1234]";least="0";most="1">> <<var;match="0|5";least="0";most="1">> '
        "<<beginOptional>>license<<endOptional>>"
    ),
}

_MARK = re.compile(r"<<(beginOptional|endOptional|var)((?:;\w+=\"[^\"]*\")*)>>")
SPANS = "array<struct<label:string,kind:string,start:bigint,length:bigint>>"


@dataclass
class Automaton:
    """``words[s]`` and ``patterns[s]`` lead to s + 1; ``skips[s]`` lead on without a word. The last state accepts."""

    words: dict[int, bytes] = field(default_factory=dict)
    patterns: dict[int, re.Pattern] = field(default_factory=dict)
    skips: dict[int, set[int]] = field(default_factory=dict)
    last: int = 0
    anchor: bytes = b""

    def closure(self, states: set[int]) -> frozenset[int]:
        seen, rest = set(states), list(states)
        while rest:
            for to in self.skips.get(rest.pop(), ()):
                if to not in seen:
                    seen.add(to)
                    rest.append(to)
        return frozenset(seen)

    def step(self, states: frozenset[int], word: bytes) -> frozenset[int]:
        known = self._moves.get((states, word))
        if known is None:
            onward = {s + 1 for s in states if self.words.get(s) == word or s in self.patterns and self.patterns[s].fullmatch(word)}
            known = self.closure(onward)
            if len(self._moves) < 100_000:  # a memo: beyond it moves are worked out anew
                self._moves[states, word] = known
        return known

    def __post_init__(self):
        self._moves: dict[tuple[frozenset[int], bytes], frozenset[int]] = {}

    def longest(self, words: list[bytes], start: int) -> int:
        """Length of the longest accepted run from ``start``; 0 if none."""
        states, best, at = self.closure({0}), 0, start
        while states and at < len(words):
            states = self.step(states, words[at])
            at += 1
            if self.last in states:
                best = at - start
        return best

    def places(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(start, length) of accepted runs from left to right; a run ends before the next begins."""
        begin, found, free = self.closure({0}), [], 0
        for at, word in enumerate(words):
            if at >= free and self.step(begin, word) and (length := self.longest(words, at)):
                found.append((at, length))
                free = at + length
        return found


def compile_template(template: str) -> Automaton:
    """A template without any mandatory word is refused, for it would accept an empty text."""
    made, state, opened, run, runs, cut = Automaton(), 0, [], [], [], 0

    def text(part: str) -> None:
        nonlocal state
        for word in letter_words(part.encode()):
            made.words[state] = word
            state += 1
            if not opened:
                run.append(word)

    for mark in _MARK.finditer(template):
        text(template[cut:mark.start()])
        cut = mark.end()
        runs.append(list(run))
        run.clear()
        if mark[1] == "beginOptional":
            opened.append(state)
        elif mark[1] == "endOptional":
            if not opened:
                raise ValueError("endOptional without beginOptional")
            made.skips.setdefault(opened.pop(), set()).add(state)
        else:
            given = dict(re.findall(r";(\w+)=\"([^\"]*)\"", mark[2]))
            least, most = int(given.get("least", 1)), int(given.get("most", given.get("least", 1)))
            first = state
            for _ in range(most):
                made.patterns[state] = re.compile(given["match"].encode(), re.DOTALL)
                state += 1
            for s in range(first + least, state):
                made.skips.setdefault(s, set()).add(state)
    text(template[cut:])
    runs.append(run)
    if opened:
        raise ValueError("beginOptional without endOptional")
    made.last, made.anchor = state, b" ".join(max(runs, key=lambda r: sum(map(len, r))))
    if not made.anchor:
        raise ValueError("a template needs a mandatory word")
    return made


def phrase_places(joined: bytes, phrase: bytes) -> Iterator[int]:
    """Word positions of a phrase in words that are joined by, and stand between, single spaces."""
    at, word, counted = joined.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        word, counted = word + joined.count(b" ", counted, at), at
        yield word
        at = joined.find(b" " + phrase + b" ", at + 1)


def license_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES,
                  phrases: dict[str, str] = PHRASES) -> DataFrame:
    """(doc id, n_words, spans): each place of a phrase (kind ``phrase``) or template (kind ``template``), in words from 0."""
    sought = {phrase.encode(): label for phrase, label in phrases.items()}
    for template in templates.values():
        compile_template(template)

    def scan(batches):
        automata = {label: compile_template(template) for label, template in templates.items()}
        for batch in batches:
            counts, found = [], []
            for blob in blobs(batch, "_text"):
                words = letter_words(blob)
                joined = b" " + b" ".join(words) + b" "
                spans = [{"label": label, "kind": "phrase", "start": at, "length": phrase.count(b" ") + 1}
                         for phrase, label in sought.items() if phrase in joined for at in phrase_places(joined, phrase)]
                spans += [{"label": label, "kind": "template", "start": at, "length": length}
                          for label, automaton in automata.items() if automaton.anchor in joined for at, length in automaton.places(words)]
                counts.append(len(words))
                found.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(pa.struct(
                [("label", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())])))], [doc_id, "n_words", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, F.col(text).alias("_text")).mapInArrow(scan, f"`{doc_id}` {kind}, n_words bigint, spans {SPANS}")


def _labels(spans: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(spans["label"])), ",")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: base phrases and the templates' labels. The score is 1 with a full template, 0.5 with phrases alone."""
    base = F.filter("spans", lambda span: span["kind"] == "phrase")
    full = F.filter("spans", lambda span: span["kind"] == "template")
    return license_spans(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base["start"]).alias("first_word"),
        F.array_max(base["start"]).alias("last_word"), _labels(base).alias("base_labels"), _labels(F.col("spans")).alias("labels"),
        F.when(F.size(full) > 0, 1.0).when(F.size(base) > 0, 0.5).otherwise(0.0).alias("score"), F.size(full).cast("long").alias("n_templates"),
    )
