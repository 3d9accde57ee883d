"""License scans: matching statistics against a generalised suffix automaton of licence words.

The automaton holds every template's words. A text is streamed through it once; at each word the
longest stretch of template words that ends there is known. Base phrases are read off the suffix links.
Wherever a place in a template cannot be followed any further, its stretch is kept, also where other
templates go on; stretches of a template are chained into spans. A chain may jump a few words, in text
and template, but none that tells licences of one family apart (what templates of different labels that
share most words differ in). Of spans that overlap the one with the best cover stands, with those of its label.

Defined results: a null or empty text has no words, no places, empty label strings and score 0.
Words never cross rows; repeated rows and ties are handled row by row; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from huntframe.llm.common import LOWER, NOT_ALNUM, class_table, hash_words, kept_by_worker, span_hashes, table, text_blocks, word_spans

NAME = "op2_license_scans"

# Phrases whose presence alone names a licence.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Public licence notices and texts, by label.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

_LOWER_ASCII = bytes(LOWER)
_IS_WORD = class_table(NOT_ALNUM)


def words_of(text: str) -> list[bytes]:
    """Lower-cased words of a short text, as the scan sees them."""
    data = np.frombuffer(text.encode().translate(_LOWER_ASCII), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), _IS_WORD)
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(starts, ends)]


class WordAutomaton:
    """Generalised suffix automaton over word ids, with where each state's word stretch ends in the templates."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for which, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].add((which, at))
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, arcs: dict[int, int], link: int) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, parent: int, word: int, target: int) -> int:
        """The state for parent's longest stretch plus word, split off target if target is longer."""
        if self.length[target] == self.length[parent] + 1:
            return target
        clone = self._state(self.length[parent] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = clone
        while parent >= 0 and self.next[parent].get(word) == target:
            self.next[parent][word] = clone
            parent = self.link[parent]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word, self.next[last][word])
        new, parent = self._state(self.length[last] + 1, {}, 0), last
        while parent >= 0 and word not in self.next[parent]:
            self.next[parent][word] = new
            parent = self.link[parent]
        if parent >= 0:
            self.link[new] = self._split(parent, word, self.next[parent][word])
        return new

    def find(self, sequence: list[int]) -> int:
        state = 0
        for word in sequence:
            state = self.next[state][word]
        return state

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """For each word, the state and length of the longest template stretch that ends there."""
        state = size = 0
        for word in words:
            while word not in self.next[state]:
                state = self.link[state]
                if state < 0:
                    state = 0
                    break
                size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            else:
                size = 0
            yield state, size


@dataclass
class Scan:
    """What one text holds: base places as (first word, label), template spans as (label, first, last, covered share)."""

    n_words: int = 0
    places: list[tuple[int, str]] = field(default_factory=list)
    spans: list[tuple[str, int, int, float]] = field(default_factory=list)


class Scanner:
    """Phrases and templates made ready for scanning; min_match and min_cover tell a span from chance."""

    def __init__(self, phrases: dict[str, str], templates: tuple, min_match: int = 4, min_cover: float = 0.6, max_gap: int = 12):
        self.min_match, self.min_cover, self.max_gap = min_match, min_cover, max_gap
        self.templates = [(label, words_of(text)) for label, text in templates]
        phrase_words = [(label, words_of(text)) for text, label in phrases.items()]
        vocabulary = sorted({w for _, ws in [*self.templates, *phrase_words] for w in ws})
        ids = {w: i for i, w in enumerate(vocabulary)}
        hashes = hash_words(vocabulary)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(hashes >> np.uint64(48)).astype(np.int64)] = True
        self.automaton = WordAutomaton([[ids[w] for w in ws] for _, ws in [*self.templates, *phrase_words]])
        self.shortest = min((len(ws) for _, ws in phrase_words), default=2)
        told: set[bytes] = set()
        for at, (label, ws) in enumerate(self.templates):
            for other, others in self.templates[:at]:
                if label != other and 2 * len(set(ws) & set(others)) > max(len(set(ws)), len(set(others))):
                    told |= set(ws) ^ set(others)
        self.telling = np.zeros(len(vocabulary) + 1, np.int64)  # the last is for words of no template
        self.telling[[ids[w] for w in told]] = 1
        #: telling words of each template before each place
        self.told_before = [np.concatenate(([0], np.cumsum(self.telling[[ids[w] for w in ws]]))) for _, ws in self.templates]
        self.occurrences: dict[int, dict[tuple[int, int], int]] = {}
        own: dict[int, list[tuple[int, str]]] = {}
        for label, ws in phrase_words:
            own.setdefault(self.automaton.find([ids[w] for w in ws]), []).append((len(ws), label))
        #: phrases that end where a state's stretch ends, by walking its suffix links once
        self.phrases_at: list[list[tuple[int, str]]] = []
        for state in range(len(self.automaton.length)):
            found, up = [], state
            while up > 0:
                found += own.get(up, [])
                up = self.automaton.link[up]
            self.phrases_at.append(found)

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary id of each word hash, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        likely = np.flatnonzero(self.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[likely]), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes[likely]
        out[likely[hit]] = self.ids[at[hit]]
        return out

    def scan(self, ids: np.ndarray) -> Scan:
        """Base places and covered spans of one text given as word ids."""
        out = Scan(len(ids))
        matches: dict[int, list[tuple[int, int, int]]] = {}
        known = ids >= 0
        # stretches of known words, of two at least unless a phrase has one
        runs = known if self.shortest < 2 else np.concatenate((known[:-1] & known[1:], [False])) if len(known) else known
        if not runs.any():
            return out
        edges = np.flatnonzero(np.diff(np.concatenate(([0], runs.view(np.int8), [0]))))
        told = np.concatenate(([0], np.cumsum(self.telling[ids])))
        for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()):
            run = ids[lo : hi + (self.shortest > 1)].tolist()
            held: dict[tuple[int, int], int] = {}
            for at, (state, size) in enumerate(self.automaton.statistics(run), lo):
                for length, label in self.phrases_at[state]:
                    if length <= size:
                        out.places.append((at - length + 1, label))
                now = self._where(state, size) if size >= self.min_match else {}
                for (which, end), length in held.items():
                    if (which, end + 1) not in now:
                        matches.setdefault(which, []).append((at - 1, end, length))
                held = now
            for (which, end), length in held.items():
                matches.setdefault(which, []).append((lo + len(run) - 1, end, length))
        for which, found in matches.items():
            self._chain(out, which, found, told)
        out.spans = _best_covered(out.spans)
        return out

    def _where(self, state: int, size: int) -> dict[tuple[int, int], int]:
        """Where the words that end here stand in templates, as (template, end), with the length of the stretch."""
        if state not in self.occurrences:
            found: dict[tuple[int, int], int] = {}
            up = state
            while up > 0 and self.automaton.length[up] >= self.min_match:
                for place in self.automaton.ends[up]:
                    if place[0] < len(self.templates):
                        found.setdefault(place, self.automaton.length[up])
                up = self.automaton.link[up]
            self.occurrences[state] = found
        return {place: min(length, size) for place, length in self.occurrences[state].items()}

    def _chain(self, out: Scan, which: int, found: list[tuple[int, int, int]], told: np.ndarray) -> None:
        """Chain stretches that follow each other in text and template, gaps of max_gap words at most and none over a telling word."""
        label, words = self.templates[which]
        before = self.told_before[which]
        found.sort()
        best: list[tuple[int, int]] = []  # covered words, first word of the chain
        top: dict[int, tuple[int, int, int]] = {}
        for i, (at, end, size) in enumerate(found):
            covered, first = size, at - size + 1
            for j in range(bisect_left(found, (at - size - self.max_gap,)), i):
                at_j, end_j, _ = found[j]
                if at_j < at and end_j < end and end - size - end_j <= self.max_gap:
                    begin, start = max(at_j + 1, at - size + 1), max(end_j + 1, end - size + 1)
                    gain = min(size, at - at_j, end - end_j)
                    if told[begin] == told[at_j + 1] and before[start] == before[end_j + 1] and best[j][0] + gain > covered:
                        covered, first = best[j][0] + gain, best[j][1]
            best.append((covered, first))
            if covered > top.get(first, (0, 0, 0))[0]:
                top[first] = (covered, first, at)
        for covered, first, last in top.values():
            share = min(1.0, covered / len(words))
            if share >= self.min_cover:
                out.spans.append((label, first, last, share))


def _best_covered(spans: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """The spans less those that overlap a better covered one of another label; ties go to the longer, then by label."""
    kept: list[tuple[str, int, int, float]] = []
    for span in sorted(set(spans), key=lambda s: (-s[3], s[1] - s[2], s[0], s[1])):
        if not any(k[0] != span[0] and k[1] <= span[2] and span[1] <= k[2] for k in kept):
            kept.append(span)
    return sorted(kept, key=lambda s: (s[1], s[2], s[0]))


SCHEMA = "doc_id long, n_words long, places array<struct<first_word:long,label:string>>, spans array<struct<label:string,first_word:long,last_word:long,cover:double>>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(pa.struct([("first_word", pa.int64()), ("label", pa.string())]))), ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("cover", pa.float64())])))])


def license_scan(docs: DataFrame, phrases: dict[str, str] = BASE_PHRASES, templates: tuple = TEMPLATES, min_match: int = 4, min_cover: float = 0.6, max_gap: int = 12) -> DataFrame:
    """Scan every text: doc_id, word count, base places and covered template spans.

    Map-only: one pass over the text column, no shuffle; memory is one block of text.
    """
    key = (tuple(phrases.items()), templates, min_match, min_cover, max_gap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = kept_by_worker(key, lambda: Scanner(dict(phrases), templates, min_match, min_cover, max_gap))
        for batch in batches:
            n_words, places, spans = [], [], []
            for _, _, data, offsets in text_blocks(batch.column("text")):
                data = LOWER[data]
                starts, ends, rows = word_spans(data, offsets, _IS_WORD)
                ids = scanner.word_ids(span_hashes(data, starts, ends))
                for lo, hi in zip(rows[:-1].tolist(), rows[1:].tolist()):
                    found = scanner.scan(ids[lo:hi])
                    n_words.append(found.n_words)
                    places.append([{"first_word": a, "label": b} for a, b in found.places])
                    spans.append([{"label": a, "first_word": b, "last_word": c, "cover": d} for a, b, c, d in found.spans])
            columns = [batch.column("doc_id"), n_words, places, spans]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: base places digest, labels and the best cover as score."""
    return license_scan(table(spark, sf_dir, "documents")).selectExpr(
        "doc_id",
        "n_words",
        "cast(size(places) as long) AS n_base",
        "array_min(places.first_word) AS first_word",
        "array_max(places.first_word) AS last_word",
        "array_join(array_sort(array_distinct(places.label)), ',') AS base_labels",
        "array_join(array_sort(array_union(places.label, spans.label)), ',') AS labels",
        "CASE WHEN size(places) > 0 THEN 1D ELSE coalesce(array_max(spans.cover), 0D) END AS score",
    )
