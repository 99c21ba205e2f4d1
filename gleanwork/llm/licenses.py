"""Licence scan: Dice coefficient over word bigrams against licence templates.

Text and templates are normalised alike (lower case, words only, one spelling
of "licence", with and without copyright lines).  A stretch of words, which may
lie within a line, matches a template if ``2 |A & B| / (|A| + |B|)`` over their
distinct word bigrams reaches ``least``.  That bounds sizes: ``|A|`` lies
between ``|B| t / (2 - t)`` and ``|B| (2 - t) / t``, and a stretch of at most
that many distinct bigrams must hold ``|B| t / (2 - t)`` of the template's.
Templates of which the whole text holds fewer are pruned by one pass over the
text's bigrams; of the rest, those without such a place.

The best stretch begins with the last of its first bigram and ends with the
first of its last one (words outside add nothing), so the stretches that start
with one bigram never overlap, and a text costs its length times the number of
a template's bigrams at most, however often it repeats itself.

Templates of one family hold much of each other, so one stretch may match
several: of matches that overlap, the one of highest Dice stands (ties: the
longest, then the first template), and one stretch has one licence.

Templates are those in ``TEMPLATES`` and the texts beside this file; others can
be given.  Defined results: null and empty texts match nothing, an empty table
gives an empty one; one row for each document and template that stands, with its best
stretch (of equals the one that starts first; places count the words of the
text without copyright lines, unless only the text with them matches as well);
repeated rows give repeated rows; other columns are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 0.8
#: Public licence texts and the notices that stand for them.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "MPL-2.0 header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "GPL-2.0 header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "LGPL-2.1 header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "AGPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "CC0-1.0 notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
}


@lru_cache(maxsize=1)
def all_templates() -> dict[str, str]:
    """``TEMPLATES`` and the whole licence texts beside this file."""
    folder, out = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts"), dict(TEMPLATES)
    for name in sorted(os.listdir(folder)):
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            out[name.removesuffix(".txt")] = f.read()
    return out


_COPYRIGHT = re.compile(r"^\W*(?:copyright\b|©|\(c\)).*\d{4}.*$|^.*\ball rights reserved\W*$", re.MULTILINE)
_MIX = np.array([0x9E3779B97F4A7C15 - (1 << 64), 0x94D049BB133111EB - (1 << 64)], dtype=np.int64)
_TOKEN = re.compile(r"[^\W_]+|\n")


def normalized(text: str, copyright_lines: bool = False) -> list[str]:
    """Words and line ends of a text."""
    text = text.lower().replace("licence", "license")
    if not copyright_lines and ("copyright" in text or "©" in text or "(c)" in text or "all rights" in text):
        text = _COPYRIGHT.sub("", text)
    return _TOKEN.findall(text)


class LicenseMatcher:
    """Templates as sets of bigram codes over their own words; 0 stands for every other word."""

    def __init__(self, templates: dict[str, str] | None = None, least: float = LEAST):
        self.least = least
        self.names, words = [], []
        for name, text in (templates or all_templates()).items():
            self.names.append(name)
            words.append([w for w in normalized(text) if w != "\n"])
        self.vocabulary: dict[str, int] = {"\n": -1}
        for row in words:
            for w in row:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        self.base = len(self.vocabulary) + 1
        self.grams = [np.unique(self._codes(np.array([self.vocabulary[w] for w in row]))) for row in words]
        self.every = np.unique(np.concatenate(self.grams))
        # Of each bigram, the templates that have it: entries start[k] to start[k + 1] of ``owners``.
        place = np.concatenate([np.searchsorted(self.every, g) for g in self.grams])
        owner = np.repeat(np.arange(len(self.grams)), [len(g) for g in self.grams])
        self.owners = owner[np.argsort(place, kind="stable")]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(self.every)))])
        self.need = [len(g) * least / (2 - least) for g in self.grams]
        self.most = [len(g) * (2 - least) / least for g in self.grams]
        self.few = np.array([int(np.ceil(n - 1e-9)) for n in self.need])

    def _codes(self, words: np.ndarray) -> np.ndarray:
        """Code of each word pair; pairs with a word that no template has lie below 0."""
        left, right = words[:-1], words[1:]
        other = (left * _MIX[0] + right) * _MIX[1] | np.int64(-(1 << 63))
        return np.where((left > 0) & (right > 0) & (left < self.base) & (right < self.base), left * self.base + right, other)

    def match_anywhere(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """As ``match``, over all stretches of words; a copyright line may also hold the licence itself."""
        if not text:
            return []
        tokens = normalized(text)
        found = {m[0]: m for m in self._match(tokens, whole_lines=False)}
        if len(every := normalized(text, copyright_lines=True)) > len(tokens):
            for m in self._match(every, whole_lines=False):
                if m[0] not in found or m[1] > found[m[0]][1]:
                    found[m[0]] = m
        return [found[name] for name in self.names if name in found]

    def identify(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """The matches of ``match_anywhere`` that stand: none overlaps a better one that does."""
        found = self.match_anywhere(text)
        place = {name: k for k, name in enumerate(self.names)}
        standing: list[tuple[str, float, int, int]] = []
        for m in sorted(found, key=lambda m: (-m[1], m[2] - m[3], place[m[0]])):
            if all(m[3] <= s[2] or s[3] <= m[2] for s in standing):
                standing.append(m)
        return sorted(standing, key=lambda m: place[m[0]])

    def match(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(template, Dice, first word, word after the last) of the best stretch of whole lines for each template that matches."""
        return self._match(normalized(text) if text else [], whole_lines=True)

    def _match(self, tokens: list[str], whole_lines: bool) -> list[tuple[str, float, int, int]]:
        # Words that no template has are told apart by their hash.
        ids = np.fromiter(map(self.vocabulary.get, tokens, map(hash, tokens)), dtype=np.int64, count=len(tokens))
        ends = np.flatnonzero(ids == -1)
        words = ids[ids != -1]
        if len(words) < 2:
            return []
        codes = self._codes(words)
        where = np.minimum(np.searchsorted(self.every, codes), len(self.every) - 1)
        hits = np.flatnonzero(self.every[where] == codes)
        if not len(hits):
            return []
        own = np.unique(where[hits])
        count = self.start[own + 1] - self.start[own]
        entry = np.repeat(self.start[own] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        held = np.bincount(self.owners[entry], minlength=len(self.grams))
        # Words before each line end; lines without words fall together.
        edges = np.unique(np.concatenate([[0], ends - np.arange(len(ends)), [len(words)]])) if whole_lines else ends
        found, repeats = [], None
        for k in np.flatnonzero(held >= self.few).tolist():
            grams, few, need, most = self.grams[k], int(self.few[k]), self.need[k], self.most[k]
            place = hits[np.isin(codes[hits], grams)]
            repeats = repeats or _Repeats(codes)
            # So many hits must lie within a stretch of ``most`` words; in a text that repeats itself it may be longer.
            if not repeats.any and (place[few - 1 :] - place[: len(place) - few + 1]).min() > most:
                continue
            best = self._best(codes, place, edges, grams, need, most) if whole_lines else _best_anywhere(repeats, place, len(grams), few, need, most, self.least)
            if best:
                found.append((self.names[k], *best))
        return found

    def _best(self, codes: np.ndarray, place: np.ndarray, edges: np.ndarray, grams: np.ndarray, need: float, most: float) -> tuple[float, int, int] | None:
        best: tuple[float, int, int] | None = None
        lines = np.unique(np.searchsorted(edges, place, "right") - 1)
        for line in lines.tolist():
            start, seen, shared, at = int(edges[line]), set(), 0, int(edges[line])
            for edge in edges[line + 1 :].tolist():
                for code in codes[at : edge - 1].tolist():
                    if code not in seen:
                        seen.add(code)
                        k = np.searchsorted(grams, code)
                        shared += bool(k < len(grams) and grams[k] == code)
                at = max(at, edge - 1)
                if len(seen) > most:
                    break
                if shared >= need and len(seen) >= need:
                    dice = 2 * shared / (len(seen) + len(grams))
                    if dice >= self.least and (best is None or dice > best[0]):
                        best = dice, start, edge
        return best


class _Repeats:
    """Where each bigram of a text occurred before and occurs next (-1 and the text's size if nowhere)."""

    def __init__(self, codes: np.ndarray):
        order = np.argsort(codes, kind="stable")
        same = codes[order[1:]] == codes[order[:-1]]
        self.before, self.after = np.full(len(codes), -1), np.full(len(codes), len(codes))
        self.before[order[1:][same]] = order[:-1][same]
        self.after[order[:-1][same]] = order[1:][same]
        self.any = bool(same.any())
        # A stretch has at least as many distinct bigrams as bigrams that are new to the text.
        self.new = np.concatenate([[0], np.cumsum(self.before < 0)])
        self._codes = codes

    def once(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The first of all equal stretches, by a polynomial hash of their codes: a text that repeats itself is looked at once."""
        if not self.any:
            return np.arange(len(start))
        power = np.cumprod(np.full(len(self._codes) + 1, _MIX[0]))
        total = np.concatenate([[0], np.cumsum(self._codes * power[:-1])])
        # Sums are moved to a common power before they are compared.
        key = (total[end] - total[start]) * power[len(self._codes) - start] + (end - start)
        return np.sort(np.unique(key, return_index=True)[1])


def _best_anywhere(text: _Repeats, place: np.ndarray, size: int, few: int, need: float, most: float, least: float) -> tuple[float, int, int] | None:
    """(Dice, first word, word after the last) of the best stretch; it begins and ends with a bigram of the template."""
    stop = np.minimum(np.searchsorted(text.new, text.new[place] + most, "right") - 1, text.after[place])
    starts = np.flatnonzero(np.searchsorted(place, stop) - np.arange(len(place)) >= few)
    hit = np.zeros(len(text.before), dtype=bool)
    hit[place] = True
    best: tuple[float, int, int] | None = None
    starts = starts[text.once(place[starts], stop[starts])]
    for start, end in zip(place[starts].tolist(), stop[starts].tolist(), strict=True):
        first = text.before[start:end] < start
        own = first & hit[start:end]
        shared = np.cumsum(own)
        if shared[-1] < need:
            continue
        distinct = np.cumsum(first)
        dice = np.where(own & (shared >= need) & (distinct <= most), 2 * shared / (distinct + size), 0.0)
        k = int(dice.argmax())
        if dice[k] >= least and (best is None or dice[k] > best[0]):
            best = float(dice[k]), start, start + k + 2
            if best[0] == 1:
                break
    return best


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, license, dice, word_start and word_end of every match that stands."""
    shared = df.sparkSession.sparkContext.broadcast(LicenseMatcher(templates, least))
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(d, *m) for d, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for m in shared.value.identify(t)]
            columns = list(zip(*found, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "license", "dice", "word_start", "word_end"])

    return rows.mapInArrow(run, "doc_id long, license string, dice double, word_start long, word_end long")
