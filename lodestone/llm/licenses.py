"""Licence texts in documents: MinHash bands of overlapping windows find templates, shingle containment confirms them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.words import Words, slices, tidied

#: Words of a shingle, share of a template's shingles that must be there, and bands of one hash each. A template of n words
#: is looked for in windows of 2 w words every w words, w the next power of two, so any occurrence lies whole in a window
#: and shares at least 0.8 (n - 4) of at most 2 w + n - 8 < 5 n shingles with it; 128 bands miss that with
#: (1 - 0.8 (n - 4) / 5 n)^128, under 4e-5 at 8 words and 2e-9 from 16 on.
SHINGLE, SHARE, BANDS = 5, 0.8, 128

#: Licence statements (fixed values: the public wording of these notices).
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit": "Released under the MIT License.",
    "mit-text-short": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "isc-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense-text": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.',
    "bsd-2-clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-3-clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _normal(word: bytes) -> bytes:
    return bytes(b for b in word.lower() if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122)


def _hash(word: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in word:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h | 1


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(33)) * _M1
        x = (x ^ x >> np.uint64(33)) * _M2
    return x ^ x >> np.uint64(33)


def _shingles(words: np.ndarray) -> np.ndarray:
    """A 64-bit name for each run of ``SHINGLE`` words."""
    n = len(words) - SHINGLE + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            out = _mixed(out * np.uint64(31) + words[k : k + n]) if n > 0 else out
    return out


def _hashes(shingles: np.ndarray) -> Iterator[np.ndarray]:
    with np.errstate(over="ignore"):
        low = shingles.astype(np.uint32)
        for k in range(BANDS):
            yield (low ^ np.uint32((k * 0x9E3779B1 + 77) & 0xFFFFFFFF)) * np.uint32((2 * k + 1) * 0x85EBCA6B & 0xFFFFFFFF | 1)


class Templates:
    """The templates' words, shingles and MinHash values, by window size. One of fewer than ``SHINGLE`` words after normalisation
    is refused: it would be no shingle."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.names = sorted(texts)
        self.sets, self.words, sizes = [], [], []
        for name in self.names:
            w = np.array([_hash(n) for n in map(_normal, texts[name].encode().split()) if n], dtype=np.uint64)
            self.words.append(len(w))
            self.sets.append(np.unique(_shingles(w)))
            sizes.append(max(8, 1 << (max(len(w), 1) - 1).bit_length()))
        self.by_size = {s: [i for i, x in enumerate(sizes) if x == s and len(self.sets[i])] for s in sorted(set(sizes))}
        self.short = [i for i in range(len(self.names)) if not len(self.sets[i])]
        if self.short:
            raise ValueError(f"templates of fewer than {SHINGLE} words: {[self.names[i] for i in self.short]}")
        self.least = {i: [int(h.min()) for h in _hashes(self.sets[i])] for i in range(len(self.names))}


def _candidates(shingles: np.ndarray, whole: np.ndarray, t: Templates) -> set[tuple[int, int, int]]:
    """(template, begin, end) of windows, as places of shingles, that share a MinHash value with a template. ``whole``: the shingles that do not
    run across two texts; the others take no part."""
    found: set[tuple[int, int, int]] = set()
    n = len(shingles)
    if not n:
        return found
    for band, h in enumerate(_hashes(shingles)):
        h = np.where(whole, h, np.uint32(0xFFFFFFFF))
        low, size = None, 0
        for s, members in t.by_size.items():
            if low is None:
                low, size = np.minimum.reduceat(h, np.arange(0, n, s)), s
            while size < s:  # blocks of twice the size
                low = np.minimum(low[0::2], np.append(low[1::2], np.uint32(0xFFFFFFFF))[: len(low[0::2])])
                size *= 2
            window = low.copy()
            window[:-1] = np.minimum(window[:-1], low[1:])
            for i in members:
                for b in np.flatnonzero(window == t.least[i][band]).tolist():
                    found.add((i, b * s, min(n, (b + 2) * s)))
    return found


def _told_apart(hits: list[tuple[int, float, int, int]], t: Templates, share: float) -> list[tuple[int, float, int, int]]:
    """The hits (template, containment, begin, end) of a document that no other one explains. A hit is explained by one over half of
    its words: if both lie over half of each other, by the fuller one, then the longer; else by one whose template has its wording."""
    out = []
    for i, c, a, b in hits:
        for j, d, x, y in hits:
            shared = min(b, y) - max(a, x)
            if j == i or 2 * shared < b - a:
                continue
            alike = 2 * shared >= y - x
            larger = not alike and len(np.intersect1d(t.sets[i], t.sets[j])) >= share * len(t.sets[i])
            if larger or alike and (d, len(t.sets[j]), -j) > (c, len(t.sets[i]), -i):
                break
        else:
            out.append((i, c, a, b))
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, share: float = SHARE, *, overlapping: bool = True) -> DataFrame:
    """(doc_id, template, containment, first_word, n_words) of each template of which a window of a document's text holds at
    least ``share`` of the shingles; of several windows the fullest, then the first. Without ``overlapping``, of templates that were found in
    the same place only the best is told: the text of one licence that holds most of another's names one.

    Takes columns ``doc_id`` and ``text``; others are not read. Words are runs without white space, lower-cased, of letters,
    digits and non-ASCII characters. A null or empty text, or one of fewer words than a shingle, has no licence; a null
    ``doc_id`` stays null; repeated rows are scanned each; an empty table gives no rows. A pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Templates(templates)
        known: dict[bytes, int] = {}
        for batch in batches:
            for some in slices(batch):
                w = Words(some.column(1))
                names = []
                for word in w.distinct:
                    h = known.get(word)
                    if h is None:
                        n = _normal(word)
                        h = _hash(n) if n else 0
                        if len(known) > 1 << 17:
                            known.clear()
                        if len(word) <= 64:
                            known[word] = h
                    names.append(h)
                every = np.array(names, dtype=np.uint64)[w.codes] if names else np.zeros(0, dtype=np.uint64)
                real = np.flatnonzero(every)
                doc = np.searchsorted(w.first, real, side="right") - 1
                shingles = _shingles(every[real])
                whole = doc[: len(shingles)] == doc[SHINGLE - 1 :] if len(shingles) else np.zeros(0, dtype=bool)
                ids = some.column(0).to_pylist()
                best: dict[tuple[int, int], tuple[float, int, int]] = {}
                hits_of: dict[int, list[tuple[int, float, int, int]]] = {}
                for i, a, b in sorted(_candidates(shingles, whole, t)):
                    inside = np.flatnonzero(np.isin(shingles[a:b], t.sets[i]) & whole[a:b]) + a
                    for d in np.unique(doc[inside]).tolist():
                        hits = inside[doc[inside] == d]
                        c = len(np.unique(shingles[hits])) / len(t.sets[i])
                        if c >= share:
                            begin, end = real[hits[0]], real[hits[-1] + SHINGLE - 1]
                            hits_of.setdefault(d, []).append((i, c, int(begin - w.first[d]), int(end - w.first[d]) + 1))
                for d, hits in hits_of.items():
                    for i, c, a, b in hits if overlapping else _told_apart(hits, t, share):
                        if (d, i) not in best or c > best[d, i][0]:
                            best[d, i] = (c, a, b - a)
                out = [(ids[d], t.names[i], *best[d, i]) for d, i in sorted(best)]
                if out:
                    kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "template", "containment", "first_word", "n_words"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(tidied(run), "doc_id long, template string, containment double, first_word long, n_words long")
