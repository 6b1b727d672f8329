"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Templates and documents are read as words: runs of letters and digits, lower-cased. The templates'
fingerprints (hashes of ``GRAM`` successive words, the smallest of every ``WINDOW`` neighbours) form
an inverted index. Every gram of a document is looked up, so a run of GRAM + WINDOW - 1 words that
document and template share always hits. Hits of one template on diagonals of at most one band's
width form a region; regions that hold too few of the template's words are left, the others are
aligned with the template in a band around them. A match reports the share of the template's words
found (coverage) and its span in the document as it stands.

Of overlapping matches of one template the one with most words is reported, of equals the one with
fewest words skipped, then the first; whatever does not overlap it is reported too, so repeated
notices all are. Null and empty texts have no matches; rows are scanned one by one, so repeated rows
repeat their matches; other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselle.llm.langid import slices
from tesselle.llm.memory import Memory
from tesselle.llm.storage import text_rows
from tesselle.llm.words import pieces

GRAM, WINDOW = 3, 2
MIN_COVERAGE = 0.7
WORD = re.compile(r"[^\W_]+")

# Public license notices and texts.
TEMPLATES: dict[str, str] = {
    "mit-notice": "Released under the MIT License.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "rights-reserved": "All rights reserved.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS.""",
    "bsd-2": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "apache-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "gpl-3-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "bsd-3": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither
the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR
A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN
IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The
origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice
may not be removed or altered from any source distribution.""",
    "boost-1": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit
the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license
grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and
all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object
code generated by a source language processor.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial
or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software
dedicate any and all copyright interest in the software to the public domain.""",
    "mpl-2-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "lgpl-3-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "agpl-3-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(Memory):
    """Word to 64-bit hash of its lower-case form; bounded memory."""

    def make(self, w: str) -> int:
        from xxhash import xxh64_intdigest

        return xxh64_intdigest(w.lower().encode("utf-8", "surrogatepass"))

    def of(self, text: str) -> np.ndarray:
        runs = (WORD.findall(t) for t in pieces(text))
        return np.concatenate([np.fromiter(map(self.__getitem__, words), np.uint64, len(words)) for words in runs])


def spans(text: str, wanted: set[int]) -> dict[int, tuple[int, int]]:
    """Places of the words of the given numbers, characters of the text as it stands."""
    out, k, at = {}, 0, 0
    for t in pieces(text):
        for m in WORD.finditer(t):
            if k in wanted:
                out[k] = (at + m.start(), at + m.end())
            k += 1
        at += len(t)
    return out


def grams(h: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Hashes of k successive words at every place."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    g = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        g = (g + h[j : len(h) - k + 1 + j]) * _FACTOR
    return g ^ (g >> np.uint64(31))


def winnow(g: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the fingerprints: in every window the smallest hash, the rightmost of equals."""
    if not len(g):
        return np.zeros(0, np.int64)
    w = min(window, len(g))
    picks = {i + w - 1 - int(g[i : i + w][::-1].argmin()) for i in range(len(g) - w + 1)}
    return np.array(sorted(picks), np.int64)


@dataclass(frozen=True)
class Match:
    template: str
    coverage: float
    matched: int
    skipped: int  #: words passed over on either side between the first and the last match
    first: int  #: first and last matched word of the document
    last: int


class Index:
    """Templates with the inverted index of their fingerprints."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, least: float = MIN_COVERAGE):
        hashes = WordHashes()
        self.names = sorted(templates)
        self.words = [hashes.of(templates[n]) for n in self.names]
        self.least = least
        posts = []
        for t, w in enumerate(self.words):
            g = grams(w)
            posts += [(int(g[p]), t, int(p)) for p in winnow(g)]
        posts.sort()
        self.key = np.array([p[0] for p in posts], np.uint64)
        self.post_template = np.array([p[1] for p in posts], np.int64)
        self.post_place = np.array([p[2] for p in posts], np.int64)

    def band(self, t: int) -> int:
        """Width of a region, and how far its band reaches beyond it; two bands are narrower than the template,
        so that no copy beside the one that was hit lies in the band."""
        n = len(self.words[t])
        return min(max(3, n // 10), max(0, (n - 1) // 2))

    def regions(self, h: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, lowest and highest diagonal) of the candidates in a document's word hashes."""
        g = grams(h)
        lo = np.searchsorted(self.key, g)
        hit = np.flatnonzero(self.key[np.minimum(lo, len(self.key) - 1)] == g) if len(self.key) else np.zeros(0, np.int64)
        if not len(hit):
            return []
        lo, n = lo[hit], np.searchsorted(self.key, g[hit], side="right") - lo[hit]
        post = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        template, diagonal = self.post_template[post], np.repeat(hit, n) - self.post_place[post]
        out = []
        for t in np.unique(template).tolist():
            ds, band = np.unique(diagonal[template == t]), self.band(t)
            k = 0
            while k < len(ds):
                end = int(np.searchsorted(ds, ds[k] + band, side="right"))
                out.append((t, int(ds[k]), int(ds[end - 1])))
                k = end
        return out

    def matches(self, h: np.ndarray) -> list[Match]:
        found: dict[int, list[Match]] = {}
        for t, low, high in self.regions(h):
            tpl, b = self.words[t], self.band(t)
            lo, hi = low - b, high + b
            near = h[max(0, lo) : max(0, hi + len(tpl))]
            if np.isin(tpl, near).sum() < self.least * len(tpl):
                continue
            n, skipped, i, j = align(tpl, h, lo, hi)
            if n and n / len(tpl) >= self.least:
                found.setdefault(t, []).append(Match(self.names[t], n / len(tpl), n, skipped, i, j))
        out = []
        for t in sorted(found):
            taken: list[tuple[int, int]] = []
            for m in sorted(found[t], key=lambda m: (-m.matched, m.skipped, m.first, m.last)):
                k = bisect.bisect(taken, (m.first, m.last))
                if (k == 0 or taken[k - 1][1] < m.first) and (k == len(taken) or m.last < taken[k][0]):
                    taken.insert(k, (m.first, m.last))
                    out.append(m)
        return sorted(out, key=lambda m: (m.template, m.first))


# A cell of an alignment packs (matched, words skipped, first matched word) into one number that
# compares like them: more matched, then fewer skipped, then a later first word.
_FIRST, _SKIP = 1 << 24, 1 << 20
_MATCH = _FIRST * _SKIP


def align(tpl: np.ndarray, doc: np.ndarray, lo: int, hi: int) -> tuple[int, int, int, int]:
    """Best alignment of a whole template with places on diagonals lo..hi of a document.

    Most matched words first, then the fewest words skipped on either side between the first and the
    last match, then the earliest end, then the latest beginning. Returns (matched, skipped, first and
    last matched word). Rows of the template are vectors over the diagonals.
    """
    n, width, start = len(doc), hi - lo + 1, max(0, lo)
    column = np.arange(width)
    # best[c] has read tpl[:i] and the document up to i + lo + c; 0 while nothing is matched
    best = np.zeros(width + 1, np.int64)
    top = (0, 0, 0)
    for i, w in enumerate(tpl):
        j = i + lo + column
        inside = (j >= 0) & (j < n)
        same = np.zeros(width, bool)
        same[inside] = doc[j[inside]] == w
        fresh = _MATCH + j - start
        hit = np.where(same, np.where(best[:-1] > 0, best[:-1] + _MATCH, fresh), 0)
        got = np.maximum(hit, np.maximum(best[1:] - _FIRST, 0))
        # words of the document passed over: a running maximum along the row
        got = np.maximum(np.maximum.accumulate(got + column * _FIRST) - column * _FIRST, 0)
        score = hit // _FIRST
        k = int(score.argmax())
        if score[k] >= max(1, top[0]):
            top = max(top, (int(score[k]), -int(j[k]), int(hit[k]) % _FIRST + start))
        best[:-1] = got
    matched = -(-top[0] // _SKIP)
    return matched, matched * _SKIP - top[0], top[2], -top[1]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = MIN_COVERAGE, keep: str = "doc_id") -> DataFrame:
    """(doc_id, license, coverage, n_matched, start_char, end_char), a row for each notice found in a whole text."""
    shared = text_rows(docs).sparkSession.sparkContext.broadcast((templates, least))
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("n_matched", pa.int64()), ("start_char", pa.int64()), ("end_char", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hashes = Index(*shared.value), WordHashes()
        for b in batches:
            out = []
            for part, texts in slices(b, 1):
                for doc_id, text in zip(part.column(0).to_pylist(), texts):
                    found = index.matches(hashes.of(text)) if text else []
                    if found:
                        at = spans(text, {k for m in found for k in (m.first, m.last)})
                        out += [{"doc_id": doc_id, "license": m.template, "coverage": m.coverage, "n_matched": m.matched, "start_char": at[m.first][0], "end_char": at[m.last][1]} for m in found]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return docs.select(F.col(keep).cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, license string, coverage double, n_matched long, start_char long, end_char long")
