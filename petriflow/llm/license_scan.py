"""Licence scans: texts are streamed through a suffix automaton of licence tokens, and long matches are chained into template spans.

One automaton holds all substrings of all templates and phrases. Reading a text word by word gives its matching statistics: at each
word, the longest run of words ending there that some template holds. A match that can't be extended, of MIN_MATCH words or more,
is placed at each end position of its state, and the places of one template are chained in the order of both text and template,
with at most MAX_GAP words left out between two of them on either side. A span is a chain; its cover is the share of the template's words
that it matches, and a span with MIN_COVER or more carries the template's label. A phrase stands where the match ending at a word
has the phrase as a suffix, which the automaton's links tell.

Words that are in no template set the automaton back to its start, so only stretches of words known to it are read one by one;
words are known by 64-bit hashes. The automaton's size follows from TEMPLATES and PHRASES alone, some thousand states.

Defined results: null and empty texts have no words, no places and score 0; repeated rows have a result each; ids may be null or repeated;
other columns are left aside whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petriflow.llm.common import utf8, words
from petriflow.llm.ngrams import pieces

MIN_MATCH, MAX_GAP, MIN_COVER = 3, 4, 0.75

# Phrases of the base result and the labels they give.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Public licence notices, each with the label it gives.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "SPDX-License-Identifier: MIT"),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
        and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
        IN THE SOFTWARE.""",
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution.""",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it
        will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
        See the GNU General Public License for more details.""",
    ),
    (
        "lgpl",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by
        the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    ),
    (
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
        You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies.""",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]

_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text: str) -> list[str]:
    return _WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))


class Automaton:
    """All substrings of the sequences: transitions, suffix links, longest lengths, and end positions (sequence, words up to its end)."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[list[tuple[int, int]]] = [[]]
        for k, seq in enumerate(sequences):
            at = 0
            for i, t in enumerate(seq):
                at = self._extend(at, t)
                own += [[] for _ in range(len(self.link) - len(own))]
                own[at].append((k, i + 1))
        # the ends of a state are those of all states whose links lead to it
        self.ends: list[set[tuple[int, int]]] = [set(e) for e in own]
        for v in sorted(range(1, len(self.link)), key=lambda v: -self.length[v]):
            if self.link[v] > 0:
                self.ends[self.link[v]] |= self.ends[v]

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, q: int, t: int) -> int:
        """A state for the strings of q that p's step reaches; q keeps the longer ones."""
        clone = self._new(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.step[p].get(t) == q:
            self.step[p][t] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, t: int) -> int:
        q = self.step[last].get(t)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, t)
        new, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and t not in self.step[p]:
            self.step[p][t] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][t]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, t)
        return new

    def statistics(self, seq: list[int]) -> list[tuple[int, int]]:
        """(length, state) of the longest match ending at each token."""
        out, v, n = [], 0, 0
        for t in seq:
            while v and t not in self.step[v]:
                v = self.link[v]
                n = self.length[v]
            if t in self.step[v]:
                v = self.step[v][t]
                n += 1
            out.append((n, v))
        return out


class Scanner:
    """The automaton of templates and phrases, and what its states say about phrases."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], min_match: int = MIN_MATCH, max_gap: int = MAX_GAP) -> None:
        self.labels = [label for label, _ in templates]
        split = [tokens(t) for _, t in templates] + [tokens(p) for p in phrases]
        if not all(split):
            raise ValueError("a template or phrase has no words")
        vocabulary = sorted({w for s in split for w in s})
        body = " ".join(vocabulary).encode()
        _, _, _, h = words(np.frombuffer(body, np.uint8), np.array([0, len(body)]), lower=True, between=_BETWEEN)
        self.order = np.argsort(h)
        self.known = h[self.order]
        ids = {w: i for i, w in enumerate(vocabulary)}
        split = [[ids[w] for w in s] for s in split]
        self.sizes = [len(s) for s in split[: len(templates)]]
        self.min_match, self.max_gap = min_match, max_gap
        self.automaton = Automaton(split)
        a = self.automaton
        #: phrases (words, label) that end strings of a state
        self.phrases: list[tuple[tuple[int, str], ...]] = [()] * len(a.link)
        own: dict[int, tuple[int, str]] = {}
        for s, label in zip(split[len(templates) :], phrases.values(), strict=True):
            own[a.statistics(s)[-1][1]] = (len(s), label)
        for v in sorted(range(1, len(a.link)), key=lambda v: a.length[v]):
            self.phrases[v] = self.phrases[a.link[v]] + ((own[v],) if v in own else ())
        self.ends = [[e for e in sorted(x) if e[0] < len(templates)] for x in a.ends]

    def stretches(self, h: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(first word, tokens) of the stretches of two or more known words in one document."""
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        known = self.known[at] == h
        joined = known[1:] & known[:-1] & (row[1:] == row[:-1])
        edge = np.flatnonzero(np.diff(np.concatenate([[False], joined, [False]]).astype(np.int8)))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            yield s, self.order[at[s : e + 1]].tolist()

    def read(self, first: int, seq: list[int]) -> tuple[list[tuple[int, str]], list[tuple[int, int, int, int]]]:
        """Phrases (first word, label) of a stretch, and places (template, text end, template end, words) of its longest matches."""
        stats = self.automaton.statistics(seq)
        found, places = [], []
        for i, (n, v) in enumerate(stats):
            found += [(first + i + 1 - m, label) for m, label in self.phrases[v] if m <= n]
            if n >= self.min_match and (i + 1 == len(stats) or stats[i + 1][0] <= n):
                places += [(k, first + i + 1, end, n) for k, end in self.ends[v]]
        return found, places

    def chains(self, places: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(template, first word, end, words covered) of the best chains that don't overlap, from places sorted by text end, per template."""
        out = []
        by: dict[int, list[tuple[int, int, int]]] = {}
        for k, *place in places:
            by.setdefault(k, []).append(tuple(place))
        for k, some in by.items():
            covered, before, start = [n for _, _, n in some], [-1] * len(some), [e - n for e, _, n in some]
            low = 0
            widest = max(n for _, _, n in some)
            for j, (te, pe, n) in enumerate(some):
                while some[low][0] < te - widest - self.max_gap:
                    low += 1
                for i in range(low, j):
                    tx, px, _ = some[i]
                    # what a match shares with the one before it, in text or template, counts once
                    cut = max(0, tx - (te - n), px - (pe - n))
                    if cut < n and te - n + cut - tx <= self.max_gap and pe - n + cut - px <= self.max_gap and covered[i] + n - cut > covered[j]:
                        covered[j], before[j], start[j] = covered[i] + n - cut, i, start[i]
            inner = {i for i in before if i >= 0}
            taken: list[tuple[int, int]] = []
            for j in sorted((j for j in range(len(some)) if j not in inner), key=lambda j: (-covered[j], start[j])):
                at = bisect_left(taken, (some[j][0], 0))
                if (at == 0 or taken[at - 1][1] <= start[j]):
                    insort(taken, (start[j], some[j][0]))
                    out.append((k, start[j], some[j][0], covered[j]))
        return sorted(out, key=lambda c: (c[1], c[2], c[0]))


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: list[tuple[str, str]] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    min_match: int = MIN_MATCH,
    max_gap: int = MAX_GAP,
) -> DataFrame:
    """(id, n_words, places, spans): places (start, label) of the phrases, spans (template, label, start, end, words, cover) of the templates, by start."""
    scanner = Scanner(templates, phrases, min_match, max_gap)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    place = pa.struct([("start", pa.int64()), ("label", pa.string())])
    span = pa.struct([("template", pa.int32()), ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64()), ("cover", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text"):
                data, off = utf8(b.column(1))
                row, _, _, h = words(data, off, lower=True, between=_BETWEEN)
                edges = np.searchsorted(row, np.arange(len(off)))
                found: list[list] = [[] for _ in range(b.num_rows)]
                places: list[list] = [[] for _ in range(b.num_rows)]
                for at, seq in scanner.stretches(h, row):
                    i = int(row[at])
                    f, p = scanner.read(at - int(edges[i]), seq)
                    found[i] += f
                    places[i] += p
                spans = [
                    [{"template": k, "label": scanner.labels[k], "start": s, "end": e, "words": n, "cover": n / scanner.sizes[k]} for k, s, e, n in scanner.chains(p)] for p in places
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        pa.array(np.diff(edges), pa.int64()),
                        pa.array([[{"start": s, "label": x} for s, x in sorted(f)] for f in found], pa.list_(place)),
                        pa.array(spans, pa.list_(span)),
                    ],
                    ["id", "n_words", "places", "spans"],
                )

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(
        run, f"id {kind}, n_words long, places array<struct<start:long,label:string>>, spans array<struct<template:int,label:string,start:long,end:long,words:long,cover:double>>"
    )


def op13_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence phrases and template spans of all documents; null texts have no words, labels '' and score 0. The score is the largest cover of a
    span, 1 where a phrase stands."""
    out = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    own = F.transform(F.filter("spans", lambda s: s["cover"] >= MIN_COVER), lambda s: s["label"])
    starts = F.transform("places", lambda p: p["start"])
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0))
    return out.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
    )
