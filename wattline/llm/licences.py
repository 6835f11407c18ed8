"""Licence texts in documents.

The templates' words make one generalised suffix automaton. The words of a
text are streamed through it: at each word the state and the length of the
longest match that ends there (the matching statistics). Long matches are
chained, template by template, into the spans of a text that cover a template.
Phrases are told by the automaton as well: a phrase ends at a word if its state
is on the suffix-link path of the state there.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import chunks

#: Bytes of words: digits, letters, in lower case, and all bytes of further characters.
_TO_WORD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

# Phrases, and passages of public licences by their usual labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = {
    "apache": ["the apache license version 2 0"],
    "mit": ["the mit license"],
    "bsd": ["the bsd license", "the 3 clause bsd license", "the 2 clause bsd license"],
    "gpl": ["the gnu general public license version 2", "the gnu general public license version 3"],
    "lgpl": ["the gnu lesser general public license version 2 1", "the gnu lesser general public license version 3"],
    "agpl": ["the gnu affero general public license version 3"],
    "mpl": ["the mozilla public license version 2 0"],
    "cc-by": ["cc by 4 0", "a creative commons attribution 4 0 international license"],
    "cc-by-sa": ["cc by sa 4 0", "a creative commons attribution sharealike 4 0 international license"],
    "cc-by-nc": ["cc by nc 4 0", "a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-nd": ["cc by nd 4 0", "a creative commons attribution noderivatives 4 0 international license"],
}
PASSAGES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
        "option) any later version.",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "unlicense": [
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
        "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "reserved": ["All rights reserved.", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means"],
}


def templates() -> list[tuple[str, str]]:
    """(label, text) of every template: each notice as it is granted, and the passages."""
    named = [(label, f"{lead} {name}") for label, names in NOTICES.items() for name in names
             for lead in ("licensed under", "released under", "distributed under")]
    return named + [(label, text) for label, texts in PASSAGES.items() for text in texts]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORD).split()


@dataclass(frozen=True)
class Span:
    """A stretch of a text (words ``start`` to before ``end``) that covers
    ``covered`` of the words of template ``template``."""

    template: int
    start: int
    end: int
    covered: int


class Automaton:
    """A generalised suffix automaton over the words of ``templates``, with
    ``phrases`` (two words or more) told exactly.

    ``least``: words of a match worth chaining (a shorter template: all of it);
    ``gap``: words that may lie between two matches of a chain."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], least: int = 5, gap: int = 20):
        self.labels = [label for label, _ in templates]
        self.texts = [words_of(t.encode()) for _, t in templates]
        self.phrases = [(words_of(p.encode()), label) for p, label in phrases.items()]
        if any(len(p) < 2 for p, _ in self.phrases) or not all(self.texts):
            raise ValueError("phrases need two words, templates one")
        self.least, self.gap = least, gap
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, list[tuple[int, int]]] = defaultdict(list)
        sequences = [[self.number.setdefault(w, len(self.number) + 1) for w in t] for t in self.texts]
        own = [[self.number.setdefault(w, len(self.number) + 1) for w in p] for p, _ in self.phrases]
        for t, sequence in enumerate([*sequences, *own]):
            state = 0
            for e, c in enumerate(sequence):
                state = self._extend(state, c)
                if t < len(sequences):
                    ends[state].append((t, e + 1))
        # which template places and phrases end in the matches of a state
        self.ends: list[list[tuple[int, int]]] = [ends[s] for s in range(len(self.next))]
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.ends[self.link[s]] = self.ends[self.link[s]] + self.ends[s]
        self.phrase_at: dict[int, list[int]] = defaultdict(list)
        for k, sequence in enumerate(own):
            state = 0
            for c in sequence:
                state = self.next[state][c]
            self.phrase_at[state].append(k)
        pairs = np.zeros((len(self.number) + 1,) * 2, bool)
        for sequence in [*sequences, *own]:
            pairs[sequence[:-1], sequence[1:]] = True
        self.pairs = pairs
        # a template shorter than `least` counts when it is matched whole
        self.shortest = min([least, *map(len, self.texts)])

    def _extend(self, last: int, c: int) -> int:
        follow = self.next[last].get(c)
        if follow is not None:
            return follow if self.length[follow] == self.length[last] + 1 else self._clone(last, follow, c)
        state = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p >= 0:
            follow = self.next[p][c]
            self.link[state] = follow if self.length[follow] == self.length[p] + 1 else self._clone(p, follow, c)
        return state

    def _clone(self, p: int, follow: int, c: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[follow]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[follow])
        self.link[follow] = clone
        while p >= 0 and self.next[p].get(c) == follow:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def statistics(self, numbers: list[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest match that ends at each word."""
        state, length, step = 0, 0, self.next
        for c in numbers:
            while state and c not in step[state]:
                state = self.link[state]
                length = self.length[state]
            if c in step[state]:
                state = step[state][c]
                length += 1
            yield state, length

    def scan(self, numbers: np.ndarray) -> tuple[list[tuple[int, int]], list[Span]]:
        """Places ``(start, phrase)`` of all phrases and the spans of a text.

        A match of two words or more lies in a stretch of pairs of words that
        some template or phrase has, so only such stretches are streamed."""
        known = self.pairs[numbers[:-1], numbers[1:]]
        edge = np.flatnonzero(np.diff(known, prepend=False, append=False))
        places: list[tuple[int, int]] = []
        open_spans: dict[tuple[int, int, int], int] = {}
        for a, z in zip(edge[::2].tolist(), (edge[1::2] + 1).tolist()):
            for i, (state, length) in enumerate(self.statistics(numbers[a:z].tolist()), a + 1):
                s, upto = state, length
                while s > 0 and upto > 1:
                    for k in self.phrase_at.get(s, ()):
                        if upto >= len(self.phrases[k][0]):
                            places.append((i - len(self.phrases[k][0]), k))
                    s = self.link[s]
                    upto = self.length[s]
                if length >= self.shortest:
                    self._note(open_spans, i, state, length)
        return sorted(places), self._chains(open_spans)

    def _note(self, spans: dict[tuple[int, int, int], int], i: int, state: int, length: int) -> None:
        """The longest match of each template place that ends before word ``i``."""
        seen: set[tuple[int, int]] = set()
        while state > 0 and length >= self.shortest:
            for t, e in self.ends[state]:
                if (t, e) not in seen and length >= min(self.least, len(self.texts[t])):
                    seen.add((t, e))
                    spans[t, i - e, i - length] = i
            state = self.link[state]
            length = self.length[state]

    def _chains(self, spans: dict[tuple[int, int, int], int]) -> list[Span]:
        """Disjoint chains of matches, best first: of one template, in the order
        of text and template, with at most ``gap`` words between two matches."""
        by: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for (t, shift, start), end in spans.items():
            by[t].append((start, end, start - shift))
        found = []
        for t, matches in by.items():
            matches.sort()
            score, back = [], []
            for k, (start, end, at) in enumerate(matches):
                best, via = 0, -1
                for j in range(k - 1, -1, -1):
                    s, e, p = matches[j]
                    if s + len(self.texts[t]) + self.gap < start:
                        break  # a match is no longer than its template
                    if e <= start <= e + self.gap and p + e - s <= at and score[j] > best:
                        best, via = score[j], j
                score.append(best + end - start)
                back.append(via)
            used = [False] * len(matches)
            for k in sorted(range(len(matches)), key=lambda k: (-score[k], k)):
                chain, j = [], k
                while j >= 0 and not used[j]:
                    chain.append(j)
                    j = back[j]
                for x in chain:
                    used[x] = True
                if j < 0:
                    covered = sum(matches[x][1] - matches[x][0] for x in chain)
                    found.append(Span(t, matches[chain[-1]][0], matches[k][1], covered))
        return found


def best_spans(spans: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Of spans (label, start, end, coverage) of a label that overlap, the one
    of most coverage (then the longest, then the first); by start, end, label."""
    kept: list[tuple[str, int, int, float]] = []
    reach = 0
    for span in sorted(spans):
        if kept and kept[-1][0] == span[0] and span[1] < reach:
            kept[-1] = max(kept[-1], span, key=lambda s: (s[3], s[2] - s[1], -s[1]))
            reach = max(reach, span[2])
        else:
            kept.append(span)
            reach = span[2]
    return sorted(kept, key=lambda s: (s[1], s[2], s[0]))


RESULT = (
    "n_words long, places array<struct<start: long, label: string>>, "
    "spans array<struct<label: string, start: long, end: long, coverage: double>>"
)


def licence_spans(
    docs: DataFrame, templates: list[tuple[str, str]], phrases: dict[str, str] = PHRASES,
    least: int = 5, coverage: float = 0.8, gap: int = 20, text_col: str = "text",
) -> DataFrame:
    """``docs`` as struct ``row``, with ``n_words``; ``places``: start and label
    of every place where the words of a phrase stand one after the other; and
    ``spans``: label, first word, end and coverage (0 to 1, of the template's
    words) of every chain of matches that covers ``coverage`` of a template or
    more, by start, end and label; of a label's spans that overlap the best stays.

    Words are digits, letters A-Z in lower case and characters beyond ASCII. The
    templates (a handful of texts, a parameter) go to the tasks with the code.
    Null and blank texts have no words and empty lists; whole texts are scanned,
    however long; repeated rows each come out; names of other columns cannot
    clash; an empty table gives an empty result. Nothing is shuffled."""
    ship_package(docs.sparkSession)

    @F.arrow_udf(RESULT)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = Automaton(templates, phrases, least, gap)
        get = automaton.number.get
        for batch in batches:
            texts, rows = batch.to_pylist(), []
            for a, z in chunks(texts):
                for text in texts[a:z]:
                    words = words_of(text)
                    numbers = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
                    places, spans = automaton.scan(numbers) if len(words) > 1 else ([], [])
                    shares = [(s, s.covered / len(automaton.texts[s.template])) for s in spans]
                    best = best_spans([(automaton.labels[s.template], s.start, s.end, v) for s, v in shares if v >= coverage])
                    rows.append({
                        "n_words": len(words),
                        "places": [{"start": p, "label": automaton.phrases[k][1]} for p, k in places],
                        "spans": [{"label": x, "start": a, "end": z, "coverage": v} for x, a, z, v in best],
                    })
            yield pa.array(rows, _TYPE)

    text = F.coalesce(docs[text_col], F.lit("")).cast("binary")
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), scan(text).alias("f"))
    return out.select("row", "f.n_words", "f.places", "f.spans")


_TYPE = pa.struct([
    ("n_words", pa.int64()),
    ("places", pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))),
    ("spans", pa.list_(pa.struct([
        ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64()),
    ]))),
])
