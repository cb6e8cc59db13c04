"""Licence notices in texts: winnowed fingerprints find candidates, banded alignment measures them.

Templates' word k-grams are hashed and winnowed into an inverted index from fingerprint to (template, place). A text's fingerprints, chosen by the same rule, are looked up; hits of a
template whose diagonals lie close together make a candidate. Where the words there, counted, can reach the coverage, it is aligned with the template within a band about those diagonals. Reported are the share of the template's words
that match and the span of the text from the first to the last of them.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memquarry.llm.common import disjoint, mapped, mix64
from memquarry.llm.licence_texts import FULL_TEXTS

K, WINDOW, BAND, COVERAGE = 3, 3, 8, 0.7  # a run of K + WINDOW - 1 words that text and template share gives a common fingerprint; no template is shorter
WORD = re.compile(r"\w+")

#: name: (licence, text). Notices of one line, the operative paragraphs of common licences, and licences in full.
TEMPLATES = {
    "mit-line": ("MIT", "Released under the MIT License."),
    "mit-line-2": ("MIT", "This project is licensed under the MIT License."),
    "mit-grant": ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "apache-2-line": ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    "apache-2-header": ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "gpl-3-line": ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    "gpl-3-header": ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    "gpl-2-header": ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "bsd-conditions": ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    "mpl-2-header": ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "cc-by-nc-4-line": ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    "cc-by-4-line": ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    "cc-by-sa-4-line": ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    "cc-by-4-long": ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa-4-long": ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc-4-long": ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "isc-grant": ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "unlicense": ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
} | FULL_TEXTS


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    if len(ids) < k:
        return np.empty(0, np.uint64)
    h = np.full(len(ids) - k + 1, k, np.uint64)
    for i in range(k):
        h = mix64(h + ids[i : len(ids) - k + 1 + i])
    return h


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of every window, the rightmost of equals; of all hashes where there are fewer than a window."""
    if len(h) <= window:
        return np.arange(len(h))
    best = np.arange(len(h) - window + 1)
    for i in range(1, window):
        other = np.arange(i, len(h) - window + 1 + i)
        best = np.where(h[other] <= h[best], other, best)
    return np.unique(best)


def reach(n: int, band: int = BAND) -> int:
    """How far an alignment with a template of n words may stray from its diagonal: a quarter of a short notice, so that such notices in a row stay apart, `band` words, or one in fifty of a long text."""
    return max(1, min(band, n // 4), n // 50)


class Index:
    """The templates' words, and fingerprint -> places in templates, both winnowed by the rule that texts are."""

    def __init__(self, templates=TEMPLATES, k: int = K, window: int = WINDOW):
        self.k, self.window, self.names = k, window, list(templates)
        self.licence = [templates[n][0] for n in self.names]
        self.words = [WORD.findall(templates[n][1].lower()) for n in self.names]
        if short := [n for n, ws in zip(self.names, self.words) if len(ws) < k + window - 1]:
            raise ValueError(f"templates of fewer than {k + window - 1} words: {short}")
        self.number = {w: i for i, w in enumerate(sorted({w for ws in self.words for w in ws}), 1)}  # 0 stands for all other words
        self.hash = np.array([0, *(xxhash.xxh64_intdigest(w) | 1 for w in self.number)], np.uint64)
        self.numbers = [np.array([self.number[w] for w in ws], np.int64) for ws in self.words]
        self.counts = [np.bincount(x, minlength=len(self.hash)) for x in self.numbers]
        self.at = defaultdict(list)
        for t, x in enumerate(self.numbers):
            h = gram_hashes(self.hash[x], k)
            for i in winnow(h, window).tolist():
                self.at[int(h[i])].append((t, i))
        self.keys = np.array(sorted(self.at), np.uint64)


def _within(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return keys[at] == h


def align(template: list, words: list, diagonal: int, band: int = BAND) -> list[tuple[int, int]]:
    """Places (i, j) of equal words of template[i] and words[j] on the best local alignment with |j - i - diagonal| <= band: match 2, mismatch and gap -1."""
    n, width = len(template), 2 * band + 1
    above, moves = [0] * (width + 2), []
    best, at = 0, None
    for i in range(1, n + 1):
        word, row, move = template[i - 1], [0] * (width + 2), bytearray(width + 2)
        first = i - 1 + diagonal - band  # the word that template[i - 1] meets in column 1
        for c in range(max(1, 1 - first), min(width, len(words) - first) + 1):
            score, k = 0, 0
            if (s := above[c] + (2 if word == words[first + c - 1] else -1)) > score:
                score, k = s, 1
            if (s := above[c + 1] - 1) > score:
                score, k = s, 2
            if (s := row[c - 1] - 1) > score:
                score, k = s, 3
            row[c], move[c] = score, k
            if score > best:
                best, at = score, (i, c)
        moves.append(move)
        above = row
    out = []
    while at and (k := moves[at[0] - 1][at[1]]):
        i, c = at
        if k == 1:
            j = i - 1 + diagonal - band + c - 1
            if template[i - 1] == words[j]:
                out.append((i - 1, j))
            at = (i - 1, c) if i > 1 else None
        elif k == 2:
            at = (i - 1, c + 1) if i > 1 else None
        else:
            at = (i, c - 1)
    return out[::-1]


def scan(text: str | None, index: Index, coverage: float = COVERAGE, band: int = BAND) -> list[tuple[str, str, float, int, int]]:
    """(licence, template, coverage, start, end) of each notice in a text, in order; of overlapping ones the most matched words win, then the larger coverage, then the template's name."""
    if not text:
        return []
    words = WORD.findall(text.lower())
    get = index.number.get
    numbers = np.fromiter([get(w, 0) for w in words], np.int64, len(words))
    known = numbers > 0
    if len(words) < index.k or not known.any():
        return []
    h = gram_hashes(index.hash[numbers], index.k)
    full = known[: len(h)].copy()
    for i in range(1, index.k):
        full &= known[i : len(h) + i]
    if not full.any():
        return []
    chosen = np.zeros(len(h), bool)
    chosen[winnow(h, index.window)] = True
    places = np.flatnonzero(full & chosen & _within(h, index.keys))
    if not len(places):
        return []
    diagonals = defaultdict(list)
    for j in places.tolist():
        for t, i in index.at[int(h[j])]:
            diagonals[t].append((j - i, j))
    spans = None
    found = []
    for t, hits in diagonals.items():
        n = len(index.words[t])
        if len(words) < coverage * n:
            continue
        hits.sort()
        groups = [[hits[0]]]
        width = reach(n, band)
        for d in hits[1:]:
            if d[0] - groups[-1][0][0] <= width:
                groups[-1].append(d)
            else:
                groups.append([d])
        for g in groups:
            middle = g[len(g) // 2][0]
            begin = max(0, middle - width)
            own = numbers[begin : max(0, middle + n + width)]
            # no alignment matches more words than both hold
            if np.minimum(np.bincount(own, minlength=len(index.hash)), index.counts[t])[1:].sum() < coverage * n:
                continue
            pairs = [(i, j + begin) for i, j in align(index.numbers[t].tolist(), own.tolist(), middle - begin, width)]
            if len(pairs) < coverage * n:
                continue
            if spans is None:
                spans = [m.span() for m in WORD.finditer(text.lower())]
                exact = len(text.lower()) == len(text)
                if not exact:  # a character whose lower case is longer: places come from the text itself
                    spans = [m.span() for m in WORD.finditer(text)]
                    if len(spans) != len(words):
                        spans = [(0, len(text))] * len(words)
            found.append((len(pairs), round(len(pairs) / n, 4), t, spans[pairs[0][1]][0], spans[pairs[-1][1]][1]))
    best = sorted(set(found), key=lambda f: (-f[0], -f[1], index.names[f[2]], f[3]))
    kept = disjoint(best, lambda f: f[3], lambda f: f[4])
    return [(index.licence[t], index.names[t], c, a, b) for _, c, t, a, b in sorted(kept, key=lambda f: f[3])]


def notices(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, licence, template, coverage, span_start, span_end: one row per notice, offsets in characters; one pass, no shuffle.

    Null and empty texts give no rows; repeated rows give theirs again; null ids stay null; an empty table gives an empty one; other columns, whatever their names, aren't read. Whole texts
    are scanned, however long; ties between overlapping notices as in scan().
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        index = Index(templates)
        for b in batches:
            rows = [(i, *r) for i, t in enumerate(b.column(1).to_pylist()) for r in scan(t, index, coverage)]
            of = lambda k, t: pa.array([r[k] for r in rows], t)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(of(0, pa.int64())), of(1, pa.string()), of(2, pa.string()), of(3, pa.float64()), of(4, pa.int32()), of(5, pa.int32())],
                names=["doc_id", "licence", "template", "coverage", "span_start", "span_end"],
            )

    return mapped(docs.select(F.col(doc_id), F.col(text)), run, f"doc_id {kind}, licence string, template string, coverage double, span_start int, span_end int")
