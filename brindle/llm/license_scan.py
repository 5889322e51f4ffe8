"""License scans: winnowed fingerprints pick templates, banded alignment reports what matches.

Templates and texts are taken as lower-cased words of letters and digits.
The k-grams of a template's words are winnowed: of every WINDOW neighbours
the smallest hash is kept, so any run of WINDOW + K - 1 words in common has a
kept one. The kept hashes make an inverted index. Hits of a text with one
template whose diagonals and places lie together make one candidate; the
words there are aligned with the template inside a band around the diagonal.
A match is reported if the aligned words cover enough of the template.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import PUNCTUATION, filled, mix, powers, scan, slices

K, WINDOW, BAND = 3, 2, 8
LEAST_COVERAGE = 0.75
# Texts and notices of public licenses, as their authors ask to use them.
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, {version}, or (at your option) any later version."
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-2-clause": _BSD + _BSD_END,
    "bsd-3-clause": _BSD + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END,
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "gpl-2.0-header": _GNU.format(name="General Public License", version="either version 2 of the License"),
    "lgpl-2.1-header": _GNU.replace("This program is free software", "This library is free software").format(name="Lesser General Public License", version="either version 2.1 of the License"),
    "lgpl-3.0-header": _GNU.format(name="Lesser General Public License", version="either version 3 of the License"),
    "agpl-3.0-header": _GNU.format(name="Affero General Public License", version="either version 3 of the License"),
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
SCHEMA = "doc_id long, license string, coverage double, n_matched int, n_template int, first_word int, end_word int, first_byte int, end_byte int"


def kgrams(hashes: np.ndarray, k: int = K) -> np.ndarray:
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    p = powers(k)
    for j in range(k):
        out += hashes[j : j + n] * p[j]
    return mix(out)


def winnow(grams: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the smallest hash of every window, the rightmost of equals."""
    if len(grams) <= window:
        return np.array([len(grams) - 1 - int(np.argmin(grams[::-1]))]) if len(grams) else np.zeros(0, int)
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(np.arange(len(views)) + window - 1 - np.argmin(views[:, ::-1], axis=1))


class Index:
    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.words: list[np.ndarray] = []
        postings: list[tuple[int, int, int]] = []
        for i, text in enumerate(templates.values()):
            raw = np.frombuffer(text.encode(), np.uint8)
            h = scan(raw, np.array([0, len(raw)]), PUNCTUATION).hashes
            self.words.append(h)
            grams = kgrams(h)
            postings.extend((int(grams[q]), i, int(q)) for q in winnow(grams))
        postings.sort()
        self.keys = np.array([p[0] for p in postings], np.uint64)
        self.postings = [(i, q) for _, i, q in postings]

    def candidates(self, grams: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
        """(template, [(place in text, place in template)]) of hits that lie together."""
        lo, hi = np.searchsorted(self.keys, grams, "left"), np.searchsorted(self.keys, grams, "right")
        by: dict[int, list[tuple[int, int]]] = {}
        for p in np.flatnonzero(hi > lo).tolist():
            for i, q in self.postings[lo[p] : hi[p]]:
                by.setdefault(i, []).append((p, q))
        out = []
        for i, hits in by.items():
            group: list[tuple[int, int]] = []
            for p, q in sorted(hits, key=lambda x: (x[0] - x[1], x[0])):
                if group and (p - q) - (group[-1][0] - group[-1][1]) > BAND:
                    out.append((i, group))
                    group = []
                group.append((p, q))
            out.append((i, group))
        return out


def align(text: np.ndarray, template: np.ndarray, diagonal: int) -> list[tuple[int, int]]:
    """Pairs of equal words (text, template) on a longest common subsequence within BAND of the diagonal."""
    n, width = len(template), 2 * BAND + 1
    table = np.zeros((n + 1, width + 2), np.int32)
    same = np.zeros((n, width), bool)
    places = np.arange(n)[:, None] + np.arange(width) + (diagonal - BAND)
    there = (places >= 0) & (places < len(text))
    same[there] = (text[places.clip(0, max(len(text) - 1, 0))] == template[:, None])[there] if len(text) else False
    for q in range(n - 1, -1, -1):
        below = table[q + 1, :width]
        row = np.where(same[q], below + 1, 0)
        row[1:] = np.maximum(row[1:], below[:-1])
        table[q, :width] = np.maximum.accumulate(row[::-1])[::-1]
    q, b, pairs = 0, 0, []
    while q < n and b < width:
        if same[q, b] and table[q, b] == table[q + 1, b] + 1:
            pairs.append((q + diagonal + b - BAND, q))
            q += 1
        elif table[q, b] == table[q, b + 1]:
            b += 1
        else:
            q, b = q + 1, b - 1
            if b < 0:
                break
    return pairs


@functools.lru_cache(4)
def index_of(templates: tuple[tuple[str, str], ...]) -> Index:
    return Index(dict(templates))


def matches(index: Index, hashes: np.ndarray, least: float) -> list[tuple[int, int, int, int]]:
    """(template, matched words, first word, end word); of overlapping matches the fullest."""
    found = []
    for i, hits in index.candidates(kgrams(hashes)):
        template = index.words[i]
        todo = sorted({p - q for p, q in hits})
        while todo:
            d = todo[0]
            todo = [x for x in todo if x - d > BAND]
            pairs = align(hashes, template, d)
            if pairs and len(pairs) >= least * len(template):
                found.append((i, len(pairs), pairs[0][0], pairs[-1][0] + 1))
    kept: list[tuple[int, int, int, int]] = []
    for m in sorted(found, key=lambda m: (-m[1], -m[1] / len(index.words[m[0]]), m[3] - m[2], m[2], m[0])):
        if all(m[3] <= x[2] or m[2] >= x[3] for x in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: (m[2], m[0]))


def _scan(templates: tuple[tuple[str, str], ...], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(templates)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.float64(), *[pa.int32()] * 6]
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
            rows = []
            for lo, _, data, offsets in slices(filled(batch.column("text"))):
                words = scan(data, offsets, PUNCTUATION)
                near = np.zeros(len(words.hashes) + 1, np.int64)
                near[1 : len(kgrams(words.hashes)) + 1] = np.isin(kgrams(words.hashes), index.keys)
                near = np.cumsum(near)
                for k in np.flatnonzero(near[words.first[1:]] > near[words.first[:-1]]):
                    a, b = int(words.first[k]), int(words.first[k + 1])
                    for i, n, first, end in matches(index, words.hashes[a:b], least):
                        total = len(index.words[i])
                        rows.append((ids[lo + k], index.names[i], n / total, n, total, first, end, int(words.starts[a + first] - offsets[k]), int(words.ends[a + end - 1] - offsets[k])))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names)

    return run


def scan_licenses(documents: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """A row for each template found in a text: doc_id, license, coverage and the matched span in words and UTF-8 bytes.

    Null and empty texts match nothing. A template with fewer than K words
    has no k-gram and is never found. Repeated rows are reported each;
    all places in a text are reported, of overlapping ones that with the most
    matched words. Only doc_id and text are read.
    """
    fixed = tuple((templates or TEMPLATES).items())
    return documents.select("doc_id", "text").mapInArrow(_scan(fixed, least), SCHEMA)
