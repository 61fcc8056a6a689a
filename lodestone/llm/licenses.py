"""License scans by patience alignment.

The coverage of a license in a text is the greatest share of the template's words that a patience alignment matches in any
window. The alignment matches what both sides begin and end with, then anchors on words unique to both, keeps the longest increasing
subsequence of anchors, and aligns each gap between them in the same way; a gap without anchors matches nothing more.

Windows: of n + max(1, n // 4) words, n being the template's length, from every word; for templates of more than EVERY words, from every
eighth part of a window. A template of at least GAPPED words is also sought in windows of twice, four times … that length, an eighth of a
window apart, up to the whole text, so that text may be inserted anywhere in it. A shorter notice is a phrase: scattered over a text, its
few common words would mean nothing. In a template of fewer than NAMED words, the names and numbers (words with a capital letter after
the first word, and digits) must all be matched, as they alone tell such notices apart.

An alignment uses each word once, so the words that text and template have in common, with their counts, bound its
coverage. The bound is taken for whole texts by array passes, then for each window, and windows that
can't reach the threshold aren't aligned. No case is lost by it. Texts are never shuffled.

A find reaches from the first to the last matched word. Of finds that overlap, whatever their licenses, the one of greatest
coverage stays, then of the longest template, then the shortest find, then the first: so a notice isn't also reported as its near relatives.

Defined results: null or empty texts, and texts without a license, have no row. A license has one row for each text, with
the remaining find of greatest coverage, the first of equal ones. Several licenses in one text have a row each. Repeated rows are scanned
one by one; a null doc_id is kept. Further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm import text as X

THRESHOLD = 0.8
EVERY, GAPPED, NAMED = 200, 40, 20

#: Notices and texts by SPDX identifier; the same license may have several.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    *((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in sorted(resources.files("lodestone.llm").joinpath("license_texts").iterdir(), key=lambda f: f.name)),
)


def increasing(values: Sequence[int]) -> list[int]:
    """Places of a longest increasing subsequence, by patience piles."""
    tops: list[int] = []
    pile: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before[i] = pile[k - 1] if k else -1
        if k == len(tops):
            tops.append(v)
            pile.append(i)
        else:
            tops[k], pile[k] = v, i
    out, i = [], pile[-1] if pile else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def aligned(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Places (in a, in b) of the words that the patience alignment of a and b matches."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: k for k, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = [(k, place[w]) for k, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place]
        kept = [anchors[k] for k in increasing([p for _, p in anchors])]
        out += kept
        if kept:
            todo += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip([(a0 - 1, b0 - 1), *kept], [*kept, (a1, b1)]) if y > x + 1 and v > u + 1]
    return out


def matched(a: Sequence[int], b: Sequence[int], named: frozenset[int] = frozenset()) -> tuple[int, int, int]:
    """How many words of a the alignment matches, and from where to where they are in b; none unless those at the places named are."""
    pairs = aligned(a, b)
    if not pairs or not named <= {i for i, _ in pairs}:
        return 0, 0, 0
    return len(pairs), min(j for _, j in pairs), max(j for _, j in pairs) + 1


def window(n: int) -> int:
    """Words of the least window for a template of n words."""
    return n + max(1, n // 4)


def names(text: str) -> frozenset[int]:
    """Places of the words of a short template that must be matched."""
    words = re.findall(r"\w+", text)
    return frozenset(k for k, w in enumerate(words) if k and w != w.lower() or w.isdigit()) if len(words) < NAMED else frozenset()


def windows(n: int, length: int) -> Iterator[tuple[int, int]]:
    """(words, step) of the windows for a template of n words in a text of so many words."""
    w = window(n)
    yield w, 1 if n <= EVERY else max(1, w // 8)
    while n >= GAPPED and w < length:
        w *= 2
        yield w, max(1, w // 8)


class Scanner:
    """Templates as numbers of words, and where each word occurs in them."""

    def __init__(self, templates: Sequence[tuple[str, str]], threshold: float):
        self.names, self.threshold = [n for n, _ in templates], threshold
        hashed = [X.Words([t]).hashes for _, t in templates]
        self.vocab = np.unique(np.concatenate(hashed))
        self.words = [np.searchsorted(self.vocab, h).tolist() for h in hashed]
        self.named = [names(t) for _, t in templates]
        self.size = np.array([len(w) for w in self.words])
        rows = sorted((w, k, c) for k, ws in enumerate(self.words) for w, c in Counter(ws).items())
        word, self.template, self.count = (np.array(c) for c in zip(*rows))
        self.of = np.searchsorted(word, np.arange(len(self.vocab) + 1))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.vocab >> X.U(44)).astype(np.int64)] = True

    def scan(self, words: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, str, float, int, int]]:
        """(text, license, coverage, first word, words from there to the last)."""
        at = np.flatnonzero(self.seen[(words >> X.U(44)).astype(np.int64)])
        word = np.minimum(np.searchsorted(self.vocab, words[at]), len(self.vocab) - 1)
        same = self.vocab[word] == words[at]
        at, word = at[same], word[same]
        if not len(at):
            return
        text = np.searchsorted(of, at, "right") - 1
        key, count = np.unique(text * len(self.vocab) + word, return_counts=True)
        d, w = key // len(self.vocab), key % len(self.vocab)
        n = self.of[w + 1] - self.of[w]
        row = np.repeat(np.arange(len(w)), n)
        post = np.arange(len(row)) + np.repeat(self.of[w] - (np.cumsum(n) - n), n)
        most = len(self.names)
        bound = np.bincount(d[row] * most + self.template[post], np.minimum(count[row], self.count[post]), minlength=(len(of) - 1) * most).reshape(-1, most)
        begin = np.searchsorted(text, np.arange(len(of)))
        by_text: dict[int, list[tuple[float, int, int, int]]] = {}
        for d, k in zip(*(x.tolist() for x in np.nonzero(bound >= self.threshold * self.size - 1e-9))):
            places, found = at[begin[d] : begin[d + 1]] - of[d], word[begin[d] : begin[d + 1]]
            by_text.setdefault(d, []).extend(self.windows(places, found, k, int(of[d + 1] - of[d])))
        for d, found in sorted(by_text.items()):
            best: dict[str, tuple[float, int, int]] = {}
            for coverage, start, size, k in apart(found, self.size):
                hit = (coverage, start, size)
                if self.names[k] not in best or (-coverage, start) < (-best[self.names[k]][0], best[self.names[k]][1]):
                    best[self.names[k]] = hit
            for name, hit in sorted(best.items()):
                yield d, name, *hit

    def windows(self, places: np.ndarray, found: np.ndarray, k: int, n_words: int) -> Iterator[tuple[float, int, int, int]]:
        """(coverage, first word, words, template) of finds at or above the threshold; places: of the known words of a text."""
        mine = self.words[k]
        want = Counter(mine)
        need = self.threshold * len(mine) - 1e-9
        use = np.isin(found, list(want))
        places, found = places[use].tolist(), found[use].tolist()
        for width, step in windows(len(mine), n_words):
            have: Counter[int] = Counter()
            both = end = first = 0
            # windows that begin with a known word, or on a grid; a word enters and leaves the count once
            for p in places if step == 1 else range(0, n_words, step):
                while end < len(places) and places[end] < p + width:
                    w = found[end]
                    both += have[w] < want[w]
                    have[w] += 1
                    end += 1
                while first < end and places[first] < p:
                    w = found[first]
                    have[w] -= 1
                    both -= have[w] < want[w]
                    first += 1
                if both >= need:
                    row = [-1 - x for x in range(min(width, n_words - p))]  # other words differ from each other and match none
                    for x in range(first, end):
                        row[places[x] - p] = found[x]
                    got, low, high = matched(mine, row, self.named[k])
                    if got >= need:
                        yield round(got / len(mine), 6), p + low, high - low, k


def apart(found: list[tuple[float, int, int, int]], size: Sequence[int]) -> list[tuple[float, int, int, int]]:
    """Of finds (coverage, first word, words, template) that overlap, the best."""
    starts: list[int] = []
    ends: list[int] = []
    out = []
    for row in sorted(found, key=lambda r: (-r[0], -size[r[3]], r[2], r[1], r[3])):
        k = bisect_left(starts, row[1])
        if (k == 0 or ends[k - 1] <= row[1]) and (k == len(starts) or starts[k] >= row[1] + row[2]):
            starts.insert(k, row[1])
            ends.insert(k, row[1] + row[2])
            out.append(row)
    return out


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, coverage, first_word, words) of every license found."""
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(templates, threshold))  # as large as the templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(first + d, *rest) for first, _, words, of in X.hashes(batch.column(1).to_pylist()) for d, *rest in shared.value.scan(words, of)]
            if rows:
                at, name, coverage, start, size = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(name), pa.array(coverage), pa.array(start, pa.int64()), pa.array(size, pa.int64())], names=["doc_id", "license", "coverage", "first_word", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, license string, coverage double, first_word long, words long")
