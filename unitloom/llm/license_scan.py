"""Licence scan by a generalised suffix automaton of licence wording.

The automaton holds the words of all templates: notices and bodies of public licences, the phrases that name one, and SPDX
lines. A document's words are streamed through it, which gives at each word the longest stretch ending there that stands in
some template (matching statistics). Stretches of ``LEAST_MATCH`` words or more that cannot go on are placed in the
templates they come from and chained, by dynamic programming: in order in both, with gaps of at most ``MOST_GAP`` words,
overlaps counted once, so that the most words are covered. A chain that covers ``COVERED`` of its template, or all of one of
fewer than ``SHORT`` words (where one word makes another licence), is a span with the template's label. Base phrases are templates
too; one ends at a word if its state is on the suffix-link path of the state reached there.

Defined results: null and empty texts have no words, no labels (empty strings), null places and score 0; texts of any length
are scanned whole; repeated rows give repeated result rows, an empty table none; of chains of a template that tie in covered
words the one that ends first is taken first; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitloom.llm.words import raw, words

LEAST_MATCH, MOST_GAP, COVERED, SHORT = 4, 8, 0.6, 16
# Phrases all of whose places are reported, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# SPDX identifiers of public licences, with the names that texts call them by.
NAMES = (
    ("MIT", ("MIT License", "MIT licence", "Expat License")),
    ("Apache-2.0", ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License")),
    ("BSD-2-Clause", ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License")),
    ("BSD-3-Clause", ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License")),
    ("ISC", ("ISC License",)),
    ("GPL-2.0", ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GNU GPL version 2")),
    ("GPL-3.0", ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GNU GPL version 3")),
    ("LGPL-2.1", ("GNU Lesser General Public License, version 2.1", "GNU LGPL version 2.1")),
    ("LGPL-3.0", ("GNU Lesser General Public License, version 3", "GNU LGPL version 3")),
    ("AGPL-3.0", ("GNU Affero General Public License, version 3", "GNU AGPL version 3", "GNU Affero General Public License v3.0")),
    ("MPL-2.0", ("Mozilla Public License, v. 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License 2.0")),
    ("EPL-2.0", ("Eclipse Public License 2.0", "Eclipse Public License, Version 2.0", "Eclipse Public License - v 2.0")),
    ("BSL-1.0", ("Boost Software License, Version 1.0", "Boost Software License 1.0")),
    ("Zlib", ("zlib License",)),
    ("Unlicense", ("The Unlicense",)),
    ("CC0-1.0", ("CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal Public Domain Dedication", "Creative Commons Zero v1.0 Universal")),
    ("CC-BY-4.0", ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 License")),
    ("CC-BY-SA-4.0", ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License")),
    ("CC-BY-NC-4.0", ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License")),
    ("CC-BY-ND-4.0", ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License")),
    ("CC-BY-NC-SA-4.0", ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License")),
    ("CC-BY-3.0", ("CC BY 3.0", "Creative Commons Attribution 3.0 Unported License")),
    ("CC-BY-SA-3.0", ("CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License")),
    ("Artistic-2.0", ("Artistic License 2.0",)),
    ("OFL-1.1", ("SIL Open Font License, Version 1.1",)),
    ("WTFPL", ("Do What The Fuck You Want To Public License",)),
    ("ODbL-1.0", ("Open Database License", "Open Data Commons Open Database License")),
    ("GFDL-1.3", ("GNU Free Documentation License, Version 1.3",)),
)
# How a text says that it is under a licence.
SAID = ("licensed under the {}", "licensed under {}", "licensed under a {}", "released under the {}", "released under {}", "distributed under the {}", "available under the {}", "under the terms of the {}", "subject to the {}")
# Wording of public licences' notices and bodies, with the label of each.
BODIES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("Apache-2.0", "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form"),
    ("Apache-2.0", "Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"),
    ("GPL", "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program, to make sure it remains free software for all its users"),
    ("LGPL", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide"),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"),
)


def _templates() -> tuple[tuple[str, str], ...]:
    """(label, wording): labels are SPDX identifiers, or a family's name, in lower case."""
    found = {text: label.lower() for label, text in BODIES}
    for ident, names in NAMES:
        found |= {text: ident.lower() for text in (f"SPDX-License-Identifier: {ident}", *(said.format(n) for n in names for said in SAID))}
    return tuple((label, text) for text, label in found.items())


TEMPLATES = _templates()


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, base: dict[str, str] = BASE):
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.templates: list[tuple[str, int]] = []
        ends: list[list[tuple[int, int]]] = [[]]
        phrases = [(label, words(text.encode())) for text, label in base.items()]
        sequences = [(label, words(text.encode())) for label, text in templates] + phrases
        for label, ws in sequences:
            k, state = len(self.templates), 0
            self.templates.append((label, len(ws)))
            for i, w in enumerate(ws):
                state = self._extend(state, self.vocabulary.setdefault(w, len(self.vocabulary) + 1))
                ends += [[] for _ in range(len(self.next) - len(ends))]
                ends[state].append((k, i + 1))
        by_length = sorted(range(len(self.next)), key=lambda v: -self.length[v])
        for v in by_length:  # a state's ends are those of the states whose links lead to it as well
            if self.link[v] > 0:
                ends[self.link[v]] += ends[v]
        self.ends = [sorted(set(e)) for e in ends]
        n = len(self.vocabulary) + 1
        self.pairs, self.base_pairs = np.zeros((n, n), dtype=bool), np.zeros((n, n), dtype=bool)  # words that stand side by side, and those of base phrases
        for k, (_, ws) in enumerate(sequences):
            ids = [self.vocabulary[w] for w in ws]
            self.pairs[ids[:-1], ids[1:]] = True
            if k >= len(templates):
                self.base_pairs[ids[:-1], ids[1:]] = True
        own: list[list[tuple[int, str]]] = [[] for _ in self.next]
        for label, ws in phrases:
            state = 0
            for w in ws:
                state = self.next[state][self.vocabulary[w]]
            own[state].append((len(ws), label))
        self.phrases = [[] for _ in self.next]
        for v in reversed(by_length):
            self.phrases[v] = own[v] + (self.phrases[self.link[v]] if v else [])

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        v = self._state({}, self.length[last] + 1)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = v
            p = self.link[p]
        if p < 0:
            self.link[v] = 0
        else:
            q = self.next[p][w]
            self.link[v] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return v

    def _split(self, p: int, w: int, q: int) -> int:
        v = self._state(dict(self.next[q]), self.length[p] + 1)
        self.link[v], self.link[q] = self.link[q], v
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = v
            p = self.link[p]
        return v

    def _state(self, to: dict[int, int], length: int) -> int:
        self.next.append(to)
        self.link.append(-1)
        self.length.append(length)
        return len(self.next) - 1

    def statistics(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """(state, match length) after each word number of a run."""
        state = length = 0
        for w in ids:
            while w not in self.next[state]:
                if not state:
                    break
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                length += 1
            yield state, length

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int, float]]]:
        """Words; (start, label) of each base place; (label, first word, end word, covered share) of each template span."""
        ws = words(text)
        known = np.fromiter(map(self.vocabulary.get, ws, [0] * len(ws)), dtype=np.int32, count=len(ws))
        places, matches = [], []
        for a, b in self._runs(known):
            before = (0, 0)
            for i, (state, length) in enumerate(self.statistics(known[a:b].tolist()), a):
                if length <= before[1] and before[1] >= LEAST_MATCH:
                    matches.append((i - before[1], i, before[0]))
                before = (state, length)
                for n, label in self.phrases[state]:
                    if n <= length:
                        places.append((i - n + 1, label))
            if before[1] >= LEAST_MATCH:
                matches.append((b - before[1], b, before[0]))
        return len(ws), places, self._chains(matches)

    def _runs(self, known: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches outside of which nothing can match: of known words, and cut where two of them stand side by side in no
        template; of those, the ones that are long enough for a match or hold a pair of a base phrase."""
        if self.shortest < 2:
            edge = np.flatnonzero(np.diff(np.concatenate([[0], (known > 0).view(np.int8), [0]])))
            yield from zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)
            return
        edge = np.flatnonzero(np.diff(np.concatenate([[0], self.pairs[known[:-1], known[1:]].view(np.int8), [0]])))
        start, stop = edge[::2], edge[1::2] + 1
        base = np.concatenate([[0], np.cumsum(self.base_pairs[known[:-1], known[1:]])])
        worth = (stop - start >= LEAST_MATCH) | (base[np.maximum(stop - 1, 0)] > base[start]) if len(start) else np.zeros(0, dtype=bool)
        yield from zip(start[worth].tolist(), stop[worth].tolist(), strict=True)

    @property
    def shortest(self) -> int:
        return min(n for _, n in self.templates)

    def _chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        placed: dict[int, list[tuple[int, int, int]]] = {}
        for start, end, state in matches:
            for k, to in self.ends[state]:
                placed.setdefault(k, []).append((start, end, to - (end - start)))
        spans = []
        for k, parts in sorted(placed.items()):
            label, size = self.templates[k]
            least = size if size < SHORT else COVERED * size
            spans += [(label, a, b, covered / size) for a, b, covered in chains(parts) if covered >= least]
        return spans


def chains(parts: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(first word, end word, words covered) of chains of stretches (first, end, place in the template), the best first; none shares one.

    A stretch goes on after another if it adds words to it and neither the document nor the template has a gap of over ``MOST_GAP`` words.
    """
    parts = sorted(set(parts))
    best, before, open_ = [], [], []
    for i, (a, b, t) in enumerate(parts):
        best.append(b - a)
        before.append(-1)
        open_ = [j for j in open_ if a - parts[j][1] <= MOST_GAP]
        for j in open_:
            x, y, u = parts[j]
            shared = max(0, y - a, u + (y - x) - t)  # words of this one that the other has covered
            if shared < b - a and a + shared - y <= MOST_GAP and t + shared - (u + y - x) <= MOST_GAP and best[j] + b - a - shared > best[i]:
                best[i], before[i] = best[j] + b - a - shared, j
        open_.append(i)
    used, found = set(), []
    for i in sorted(range(len(parts)), key=lambda i: (-best[i], parts[i][1], i)):
        chain = [i]
        while before[chain[-1]] >= 0:
            chain.append(before[chain[-1]])
        if used.isdisjoint(chain):
            used.update(chain)
            found.append((parts[chain[-1]][0], parts[i][1], best[i]))
    return found


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,end:long,covered:double>>"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))),
])


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """One row for each document; spans: the covered template spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(templates, base)  # small: made once a task
        for b in batches:
            rows = [_row(doc_id, automaton.scan(raw(t))) for doc_id, t in zip(b.column(0).to_pylist(), b.column(1), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, _SCHEMA)


def _row(doc_id: int | None, found: tuple) -> tuple:
    n, places, spans = found
    own = {label for _, label in places}
    score = max([1.0 if own else 0.0, *(s[3] for s in spans)])
    at = [p for p, _ in places]
    return (
        doc_id, n, len(places), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | {s[0] for s in spans})), score,
        [{"label": a, "first": b, "end": c, "covered": d} for a, b, c, d in spans],
    )
