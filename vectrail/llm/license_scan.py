"""Licence scan with a generalised suffix automaton over the words of licence templates.

All templates and phrases go into one automaton, whose words are small numbers. A text streams through
it and has, at each word, the longest run of words ending there that some template holds (its matching
statistics). Phrases end where the automaton's state, or a suffix of it, is a whole phrase. Runs that
cannot grow are anchors; anchors that follow one another in both text and template are chained, and a
chain that covers enough of its template is a span of that licence.

Defined results: a null text counts as empty and has no words and no spans; labels without any place
are the empty string; texts are read whole and in one pass, so memory follows the text and not the
number of places; equal rows give equal results; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.llm import common

#: Phrases that are looked for at every place, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices as their licences word them, by SPDX-like labels of our own.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
]
#: Words of the shortest anchor, words that a chain may skip in the text, and the share of a template that a span covers at least.
ANCHOR, GAP, COVER = 4, 24, 0.6

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII; A-Z are lower-cased, nothing else."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """Suffix automaton of several word sequences. Parallel lists hold each state's arcs, suffix link and longest length."""

    def __init__(self, sequences: list[list[bytes]]):
        self.number: dict[bytes, int] = {}
        self.arcs: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for s, sequence in enumerate(sequences):
            last = 0
            for at, w in enumerate(sequence):
                last = self._append(last, self.number.setdefault(w, len(self.number)))
                while len(ends) < len(self.arcs):
                    ends.append([])
                ends[last].append((s, at))
        for v in sorted(range(1, len(self.arcs)), key=self.length.__getitem__, reverse=True):
            ends[self.link[v]] += ends[v]
        #: Of each state, the (sequence, place) pairs at which its strings end.
        self.ends = [sorted(set(e)) for e in ends]

    def _state(self, arcs: dict[int, int], link: int, length: int) -> int:
        self.arcs.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.arcs) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """The state for the strings of q that p's longest string, with w behind, ends with."""
        if self.length[p] + 1 == self.length[q]:
            return q
        part = self._state(dict(self.arcs[q]), self.link[q], self.length[p] + 1)
        self.link[q] = part
        while p >= 0 and self.arcs[p].get(w) == q:
            self.arcs[p][w] = part
            p = self.link[p]
        return part

    def _append(self, last: int, w: int) -> int:
        if w in self.arcs[last]:
            return self._split(last, self.arcs[last][w], w)
        new = self._state({}, 0, self.length[last] + 1)
        p = last
        while p >= 0 and w not in self.arcs[p]:
            self.arcs[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.arcs[p][w], w)
        return new


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]]):
        self.phrase_labels = list(phrases.values())
        phrase_words, template_words = [words(p) for p in phrases], [words(t) for _, t in templates]
        self.labels, self.sizes = [label for label, _ in templates], [len(t) for t in template_words]
        self.machine = m = Automaton(phrase_words + template_words)
        n = len(phrase_words)
        #: Phrases that end in a state or in a suffix of it, by number and length, and places in templates.
        self.whole = [[(s, at + 1) for s, at in e if s < n and at + 1 == len(phrase_words[s]) <= m.length[v]] for v, e in enumerate(m.ends)]
        for v in sorted(range(1, len(m.arcs)), key=m.length.__getitem__):
            self.whole[v] += [p for p in self.whole[m.link[v]] if p not in self.whole[v]]
        self.places = [[(s - n, at) for s, at in e if s >= n] for e in m.ends]

    def scan(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[str, int, int, float]]]:
        """Phrase places (phrase, first word) and spans (label, first word, last word, covered share)."""
        m = self.machine
        arcs, link, length, whole = m.arcs, m.link, m.length, self.whole
        places, anchors = [], []
        state = run = 0
        before = -1
        for i, w in [(i, w) for i, w in enumerate(map(m.number.get, tokens)) if w is not None]:
            grown = False
            if i == before + 1:
                old, old_run = state, run
                while state and w not in arcs[state]:
                    state = link[state]
                    run = length[state]
                grown = run == old_run
                if not grown and old_run >= ANCHOR:
                    anchors.append((before, old_run, old))
            else:
                if run >= ANCHOR:
                    anchors.append((before, run, state))
                state = run = 0
            state = arcs[state][w]
            run += 1
            before = i
            for p, size in whole[state]:
                if size <= run:
                    places.append((p, i - size + 1))
        if run >= ANCHOR:
            anchors.append((before, run, state))
        return places, self.chains(anchors)

    def chains(self, anchors: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        spans: list[tuple[str, int, int, float]] = []
        open_: dict[int, list[int]] = {}  # template: first and last word of the chain, last place in the template, words covered

        def close(t: int) -> None:
            first, last, _, covered = open_.pop(t)
            if covered >= COVER * self.sizes[t]:
                spans.append((self.labels[t], first, last, covered / self.sizes[t]))

        for end, run, state in anchors:
            ways: dict[int, list[int]] = {}
            for t, at in self.places[state]:
                ways.setdefault(t, []).append(at)
            for t, ats in ways.items():
                chain = open_.get(t)
                if chain and end - run - chain[1] <= GAP and (on := [at for at in ats if at > chain[2]]):
                    new = min(run, end - chain[1], on[0] - chain[2])
                    if new > 0:
                        open_[t] = [chain[0], end, on[0], chain[3] + new]
                    continue
                if chain:
                    close(t)
                open_[t] = [end - run + 1, end, ats[0], run]
        for t in list(open_):
            close(t)
        return sorted(spans, key=lambda s: (s[1], s[2], s[0]))


@functools.lru_cache(maxsize=1)
def standard() -> Scanner:
    return Scanner(PHRASES, TEMPLATES)


SCHEMA = "doc_id bigint, n_words bigint, places array<struct<label:string,first:bigint>>, spans array<struct<label:string,first:bigint,last:bigint,covered:double>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, places of phrases, and spans of templates."""
    place = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64())]))
    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = standard()
        for b in batches:
            counts, places, spans = [], [], []
            for part in common.texts(b.column("text")):
                for t in part:
                    tokens = words(t)
                    found, covered = scanner.scan(tokens)
                    counts.append(len(tokens))
                    places.append([{"label": scanner.phrase_labels[p], "first": at} for p, at in found])
                    spans.append([dict(zip(("label", "first", "last", "covered"), s)) for s in covered])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(places, place), pa.array(spans, span)], names=["doc_id", "n_words", "places", "spans"])

    return common.spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, SCHEMA)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score: the largest share of a template or phrase that the text holds in one span."""
    return scan(common.table(spark, sf_dir, "documents")).selectExpr(
        "doc_id",
        "n_words",
        "cast(size(places) as bigint) AS n_base",
        "array_min(places.first) AS first_word",
        "array_max(places.first) AS last_word",
        "array_join(array_sort(array_distinct(places.label)), ',') AS base_labels",
        "array_join(array_sort(array_union(places.label, spans.label)), ',') AS labels",
        "CASE WHEN size(places) > 0 THEN 1.0D ELSE least(coalesce(array_max(spans.covered), 0.0D), 1.0D) END AS score",
    )
