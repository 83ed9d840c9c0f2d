"""License scans: matching statistics over a generalised suffix automaton of licence tokens.

The automaton holds all templates; a text streams through it word by word and the length of the
longest template passage that ends at each word is known. Maximal matches are chained, in order
of both text and template, into spans with the share of the template that they cover. A text that
holds a template several times has a span for each place.

Defined cases: a null or empty text has no words, no labels and score 0; rows with equal ids are
scanned one by one; texts of any length stream in linear time; ties between equally good spans go
to the template named first in the alphabet.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from turnloom.llm.common import arrow_map, raw_texts, texts

# Phrases of the base labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Well-known passages of public licences, by label, and short notices of use.
NOTICES = {
    "agpl": "This work is licensed under the GNU Affero General Public License, version 3.",
    "apache-2": "Licensed under the Apache License, Version 2.0.",
    "bsd": "Released under the BSD License.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc": "This work is licensed under CC BY-NC 4.0.",
    "cc-by-sa": "This work is licensed under CC BY-SA 4.0.",
    "gpl": "This work is licensed under the GNU General Public License, version 3.",
    "lgpl": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mpl-2": "This work is licensed under the Mozilla Public License, version 2.0.",
}
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."),
    "apache-2": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version. This program is distributed in the hope that it will be useful, "
        "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means."),
}

_SPACES = bytes(i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))


def words_of(raw: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and any other characters beyond ASCII."""
    return raw.lower().translate(_SPACES).split()


class SuffixAutomaton:
    """All passages of several token sequences; each state knows where its passages end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for number, tokens in enumerate(sequences):
            last = 0
            for place, token in enumerate(tokens):
                last = self._add(last, token, ends)
                ends[last].append((number, place + 1))
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            ends[self.link[state]] += ends[state]
        self.ends = [sorted(set(x)) for x in ends]

    def _split(self, state: int, token: int, target: int, ends) -> int:
        copy = len(self.size)
        self.next.append(dict(self.next[target]))
        self.link.append(self.link[target])
        self.size.append(self.size[state] + 1)
        ends.append([])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(token) == target:
            self.next[state][token] = copy
            state = self.link[state]
        return copy

    def _add(self, last: int, token: int, ends) -> int:
        if token in self.next[last]:
            target = self.next[last][token]
            whole = self.size[target] == self.size[last] + 1
            return target if whole else self._split(last, token, target, ends)
        new = len(self.size)
        self.next.append({})
        self.link.append(0)
        self.size.append(self.size[last] + 1)
        ends.append([])
        state = last
        while state >= 0 and token not in self.next[state]:
            self.next[state][token] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][token]
            whole = self.size[target] == self.size[state] + 1
            self.link[new] = target if whole else self._split(state, token, target, ends)
        return new

    def matches(self, tokens: list[int], least: int) -> list[tuple[int, int, int]]:
        """(start, end, state) of matches of at least `least` tokens that cannot go on."""
        found, state, size = [], 0, 0
        for place, token in enumerate(tokens):
            before = (state, size)
            while state and token not in self.next[state]:
                state = self.link[state]
                size = self.size[state]
            if token in self.next[state]:
                state, size = self.next[state][token], size + 1
            if before[1] >= least and size <= before[1]:
                found.append((place - before[1], place, before[0]))
        if size >= least:
            found.append((len(tokens) - size, len(tokens), state))
        return found


def _apart(spans: list[tuple[int, int]], start: int, stop: int) -> bool:
    """Whether a span overlaps none of these, which are sorted and do not overlap."""
    at = bisect_left(spans, (start,))
    return (at == len(spans) or stop <= spans[at][0]) and (at == 0 or spans[at - 1][1] <= start)


class Scanner:
    """Phrases and templates as numbers; scans one text at a time."""

    def __init__(self, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES,
                 notices: Mapping[str, str] = NOTICES, least_match: int = 4, most_gap: int = 20,
                 least_share: float = 0.75, least_words: int = 20):
        self.least, self.gap, self.share, self.enough = least_match, most_gap, least_share, least_words
        named = sorted([*templates.items(), *notices.items()])
        self.labels = [label for label, _ in named]
        self.phrases = [(words_of(k.encode()), v) for k, v in phrases.items()]
        bodies = [words_of(text.encode()) for _, text in named]
        self.numbers: dict[bytes, int] = {}
        for body in [*bodies, *(x for x, _ in self.phrases)]:
            for word in body:
                self.numbers.setdefault(word, len(self.numbers))
        coded = [[self.numbers[w] for w in body] for body in bodies]
        self.sizes = [len(x) for x in coded]
        self.automaton = SuffixAutomaton(coded)

    def coded(self, words: list[bytes]) -> np.ndarray:
        numbers = self.numbers
        return np.fromiter((numbers.get(w, -1) for w in words), np.int64, len(words))

    def places(self, codes: np.ndarray) -> list[tuple[int, str]]:
        """Start and label of each place where a phrase stands."""
        found = []
        for phrase, label in self.phrases:
            n = len(codes) - len(phrase) + 1
            if n > 0:
                hit = codes[:n] == self.numbers[phrase[0]]
                for step, word in enumerate(phrase[1:], 1):
                    hit &= codes[step : step + n] == self.numbers[word]
                found += [(int(i), label) for i in np.flatnonzero(hit)]
        return found

    def spans(self, codes: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, covered share of the template) of all chains that do not overlap.

        A chain counts if it covers `least_share` of its template or `least_words` words of it. Of
        chains that overlap the one that covers most words stays; what is left beside it is chained
        anew, so that every place of a template is found.
        """
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (codes >= 0).view(np.int8), [0]])))
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for start, end in zip(edges[::2], edges[1::2]):
            if end - start >= self.least:
                for a, b, state in self.automaton.matches(codes[start:end].tolist(), self.least):
                    for template, stop in self.automaton.ends[state]:
                        pieces.setdefault(template, []).append((int(start) + a, int(start) + b, stop))
        taken: list[tuple[int, int]] = []
        out: list[tuple[str, int, int, float]] = []
        while chains := [x for template, found in pieces.items() for x in self._chains(template, sorted(found), taken)]:
            for _, share, label, start, stop in sorted(chains):
                if _apart(taken, start, stop):
                    insort(taken, (start, stop))
                    out.append((label, start, stop, -share))
            pieces = {k: [x for x in found if _apart(taken, x[0], x[1])] for k, found in pieces.items()}
        return sorted(out)

    def _chains(self, template: int, found: list[tuple[int, int, int]], taken: list[tuple[int, int]]):
        """The best chain that ends with each piece and counts; none goes across what is taken."""
        size, label = self.sizes[template], self.labels[template]
        best: list[tuple[int, int]] = []  # covered tokens and first word of the chain so far
        for i, (a, b, stop) in enumerate(found):
            covered, first = b - a, a
            at = bisect_left(taken, (a,))
            wall = taken[at - 1][1] if at else 0
            for j in range(i - 1, -1, -1):
                if found[j][0] < max(wall, a - self.gap - size):
                    break
                c, d, before = found[j]
                fits = d <= a <= d + self.gap and before <= stop - (b - a)
                if fits and best[j][0] + b - a > covered:
                    covered, first = best[j][0] + b - a, best[j][1]
            best.append((covered, first))
            share = min(1.0, covered / size)
            if share >= self.share or covered >= self.enough:
                yield -covered, -share, label, first, b

    def scan(self, raw: bytes) -> dict:
        words = words_of(raw)
        codes = self.coded(words)
        places, spans = self.places(codes), self.spans(codes)
        base = {label for _, label in places}
        return {
            "n_words": len(words), "n_base": len(places),
            "first_word": min((i for i, _ in places), default=None),
            "last_word": max((i for i, _ in places), default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {x[0] for x in spans})),
            "score": 1.0 if places else max((x[3] for x in spans), default=0.0),
            "spans": [{"label": a, "start": b, "stop": c, "share": d} for a, b, c, d in spans]}


SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
    "labels string, score double, spans array<struct<label:string,start:bigint,stop:bigint,share:double>>")


def scanned(documents: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """Places, labels, score and spans of every row's whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(scanner or Scanner())  # templates only

    def work(batch: pa.RecordBatch) -> dict:
        found = [shared.value.scan(raw) for raw in raw_texts(batch.column("text"))]
        return {"doc_id": batch.column("doc_id")} | {k: [x[k] for x in found] for k in found[0]}

    return arrow_map(texts(documents), work, SCHEMA)
