"""Licence scans: a generalised suffix automaton of licence templates' words gives matching statistics of a file.

Each word extends the longest match that ends there or falls back along suffix links; long maximal matches are chained, in
order and close together, into spans of a template, and a template's label is given where enough of it is covered.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import chunks

#: Phrases whose places are counted, with their labels.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

#: Licence templates, with their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "Licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Words of a match that counts for a chain; words of the text that may lie between two matches of a chain.
LEAST, GAP = 4, 12
#: The covered share of a template that gives its label.
COVERED = 0.75

SEPARATORS = bytes(c for c in range(128) if c < 0x30 or 0x3A <= c <= 0x60 or c >= 0x7B)
SPACED = bytes.maketrans(SEPARATORS, b" " * len(SEPARATORS))


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased; words are runs of digits, a-z and other characters than ASCII."""
    return text.lower().translate(SPACED).split() if text else []


class Automaton:
    """The generalised suffix automaton of several word sequences."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for t, sequence in enumerate(sequences):
            last = 0
            for i, w in enumerate(sequence):
                last = self._add(last, w, ends)
                ends[last].append((t, i + 1))
        for v in sorted(range(1, len(self.link)), key=lambda v: -self.length[v]):
            ends[self.link[v]].extend(ends[v])
        #: For each state, (template, end) of its occurrences in order; the root's are of no use.
        self.ends = [[], *(sorted(set(e)) for e in ends[1:])]

    def _state(self, length: int, following: dict[int, int], link: int, ends: list) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        ends.append([])
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int, ends: list) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], ends)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _add(self, last: int, w: int, ends: list) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q, ends)
        new, p = self._state(self.length[last] + 1, {}, 0, ends), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q, ends)
        return new

    def statistics(self, sequence: Iterable[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest match that ends at each word."""
        v, length = 0, 0
        following, link, longest = self.next, self.link, self.length
        for w in sequence:
            while v and w not in following[v]:
                v = link[v]
                length = longest[v]
            if w in following[v]:
                v, length = following[v][w], length + 1
            yield v, length


class Scanner:
    def __init__(self, phrases: tuple[tuple[str, str], ...] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        self.labels = [x for x, _ in (*phrases, *templates)]
        sequences = [words_of(t.encode()) for _, t in (*phrases, *templates)]
        self.ids = {w: k for k, w in enumerate(dict.fromkeys(w for s in sequences for w in s))}
        self.sizes = [len(s) for s in sequences]
        self.phrases = len(phrases)
        #: Runs of known words that are shorter hold neither a phrase nor a match that counts.
        self.shortest = min([LEAST, *(n for n in self.sizes[: len(phrases)] if n)])
        self.automaton = Automaton([[self.ids[w] for w in s] for s in sequences])
        # Phrases that end wherever a state's words end: those whose whole sequence is one of its suffixes.
        self.closing: list[tuple[tuple[int, int], ...]] = []
        for v in range(len(self.automaton.link)):
            whole = [(t, self.sizes[t]) for t, end in self.automaton.ends[v] if t < self.phrases and end == self.sizes[t] and self.automaton.length[v] >= self.sizes[t]]
            self.closing.append(tuple(whole))
        for v in sorted(range(len(self.closing)), key=lambda v: self.automaton.length[v]):
            if v:
                self.closing[v] = tuple(dict.fromkeys((*self.closing[v], *self.closing[max(0, self.automaton.link[v])])))

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int, float]]]:
        """(words, places [(phrase, first word)], spans [(template, first word, end, covered share)]) of a text."""
        words = words_of(text)
        known = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int32, len(words))
        edges = np.diff(np.concatenate(([0], (known >= 0).view(np.int8), [0])))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        places, matches = [], []
        long = ends - starts >= self.shortest
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            before = (0, 0)
            for j, now in enumerate(self.automaton.statistics(known[a:b].tolist()), a):
                for phrase, size in self.closing[now[0]]:
                    if size <= now[1]:
                        places.append((phrase, j - size + 1))
                if now[1] <= before[1]:
                    matches.append((j, *before))
                before = now
            matches.append((b, *before))
        return len(words), places, self.chained([m for m in matches if m[2] >= LEAST])

    def chained(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Chains maximal matches (end, state, length), by template, into spans; close and in the template's order."""
        spans, open_chains = [], {}

        def close(t: int) -> None:
            first, end, _, covered = open_chains.pop(t)
            spans.append((t, first, end, covered / self.sizes[t]))

        for end, state, length in matches:
            for t in dict.fromkeys(t for t, _ in self.automaton.ends[state] if t >= self.phrases):
                if t in open_chains:
                    first, last, reached, covered = open_chains[t]
                    later = [e for x, e in self.automaton.ends[state] if x == t and e > reached]
                    if later and end - length - last <= GAP:
                        at = next((e for e in later if e - length >= reached), later[-1])
                        open_chains[t] = (first, end, at, covered + min(length, at - reached))
                        continue
                    close(t)
                at = next(e for x, e in self.automaton.ends[state] if x == t)
                open_chains[t] = (end - length, end, at, length)
        for t in list(open_chains):
            close(t)
        return sorted(spans, key=lambda s: (s[1], s[0]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: tuple[tuple[str, str], ...] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row for every row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts the places where a phrase's words stand one after another; first_word and last_word are the smallest and
    largest start of such a place, null without one. labels holds the base labels and those of templates of which at
    least COVERED is chained; both lists are sorted, comma-joined, and empty if there is nothing. score is the largest
    covered share of a template, 1 with a phrase. spans: (label, first_word, end_word, covered) of every chain. A null
    text has no word. Repeated rows each stay, texts may be of any length, other columns of docs, whatever their names, are
    not looked at. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for part, texts in chunks(batches):
            rows = []
            for text in texts:
                n, places, spans = scanner.scan(text)
                base = {scanner.labels[t] for t, _ in places}
                more = {scanner.labels[t] for t, _, _, share in spans if share >= COVERED}
                at = [w for _, w in places]
                score = 1.0 if places else min(1.0, max((s[3] for s in spans), default=0.0))
                named = [{"label": scanner.labels[t], "first_word": a, "end_word": b, "covered": share} for t, a, b, share in spans]
                rows.append((n, len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), score, named))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("covered", pa.float64())])))
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    spans = "array<struct<label:string,first_word:bigint,end_word:bigint,covered:double>>"
    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans {spans}")
