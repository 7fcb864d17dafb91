"""Licence scan: Dice coefficient over word bigrams against licence templates.

The units compared are the whole text, its paragraphs, its lines and all runs
of consecutive lines, which hold all runs of paragraphs. A unit of m bigrams can reach a Dice coefficient d only with templates of m d / (2 - d) to
m (2 - d) / d bigrams, and only with templates it shares a bigram with; those
are looked up in an index, all others are never compared. Runs share at least
d / (2 - d) of a template's bigrams, so they start and end at such bigrams only.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.base import map_texts, text_slices

DICE = 0.8

# Public licence notices and short licence texts; the long licence texts are in the folder `templates`.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License - see the LICENSE file for details."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        'of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
        "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express '
        "or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT "
        'HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
        "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor "
        "the names of its contributors may be used to endorse or promote products derived from this software without specific prior written "
        'permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO "
        "EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
        "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
        "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    (
        "LGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
)
# Texts of whole licences, named by file.
TEMPLATES += tuple((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in sorted((files("crestline.llm") / "templates").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt"))

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+(?:\.[0-9]+)*")
_PARAGRAPH = re.compile(rb"\n[ \t\r]*\n")


def normalised(text: bytes) -> list[bytes]:
    """Lower-cased words without punctuation; dotted numbers stay together."""
    return _WORD.findall(text.lower())


def bigrams(words: list[bytes]) -> Counter:
    return Counter(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    """2 |A and B| / (|A| + |B|) on multisets."""
    total = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / total if total else 0.0


class Matcher:
    """Templates sorted by size, with an index from bigrams."""

    def __init__(self, templates, least: float):
        made = sorted(((sum((g := bigrams(normalised(t.encode()))).values()), name, g) for name, t in templates), key=lambda x: (x[0], x[1]))
        self.items = [x for x in made if x[0]]
        self.sizes = [x[0] for x in self.items]
        self.least = least
        self.ratio = least / (2 - least)
        self.index: dict = {}
        for k, (_, _, g) in enumerate(self.items):
            for pair in g:
                self.index.setdefault(pair, []).append(k)
        self.low = self.sizes[0] * self.ratio if self.sizes else 0
        self.high = self.sizes[-1] / self.ratio if self.sizes else -1

    def best(self, words: list[bytes]) -> tuple[str, float] | None:
        """(licence, Dice) of the nearest template that reaches the threshold; ties go to the name that sorts first."""
        m = len(words) - 1
        if not self.low <= m <= self.high or m < 1:
            return None
        shared = [p for p in zip(words, words[1:]) if p in self.index]
        # At most 2 |shared| / (m + size) can be reached.
        if 2 * len(shared) < self.least * (m + max(self.sizes[0], m * self.ratio)):
            return None
        a = bisect_left(self.sizes, m * self.ratio - 1e-9)
        b = bisect_right(self.sizes, m / self.ratio + 1e-9)
        unit, found = bigrams(words), None
        for k in sorted({k for p in set(shared) for k in self.index[p] if a <= k < b}):
            d = dice(unit, self.items[k][2])
            if d >= self.least and (found is None or (-d, self.items[k][1]) < (-found[1], found[0])):
                found = (self.items[k][1], d)
        return found

    def runs(self, lines: list[list[bytes]]) -> list[tuple[str, float, int, int]]:
        """(licence, Dice, first line, last line) of runs of two or more lines that reach the threshold.

        Of a start the best end counts, and of overlapping runs the best one.
        """
        words = [w for x in lines for w in x]
        if len(words) - 1 < self.low:
            return []
        hits: dict[int, list[int]] = {}
        pairs = list(zip(words, words[1:]))
        for p, pair in enumerate(pairs):
            for k in self.index.get(pair, ()):
                hits.setdefault(k, []).append(p)
        ends = np.cumsum([len(x) for x in lines])
        found = []
        for k, at in hits.items():
            size, name, grams = self.items[k]
            if len(at) < size * self.ratio - 1e-9:
                continue
            # A bigram that a template holds c times counts in a run unless c earlier ones are in it.
            seen: dict = {}
            earlier = np.empty(len(at), np.int64)
            for n, p in enumerate(at):
                past = seen.setdefault(pairs[p], [])
                c = grams[pairs[p]]
                earlier[n] = past[-c] if len(past) >= c else -1
                past.append(p)
            pos = np.array(at)
            first, last = np.unique(np.searchsorted(ends, pos, "right")), np.unique(np.searchsorted(ends, pos + 1, "right"))
            begin, stop = ends[first] - [len(lines[x]) for x in first], ends[last]
            low, high = np.searchsorted(pos, begin), np.searchsorted(pos, begin + int(size / self.ratio + 1e-9) + 1)
            for x in np.flatnonzero(high - low >= size * self.ratio - 1e-9):
                a, lo, hi = begin[x], low[x], high[x]
                sums = np.concatenate([[0], np.cumsum(earlier[lo:hi] < a)])
                e0 = np.searchsorted(last, first[x], "right")
                e1 = np.searchsorted(stop, a + int(size / self.ratio + 1e-9) + 1, "right")
                if e0 >= e1:
                    continue
                shared = sums[np.searchsorted(pos, stop[e0:e1] - 1) - lo]
                scores = 2 * shared / (stop[e0:e1] - a - 1 + size)
                e = int(np.argmax(scores))
                if scores[e] >= self.least:
                    found.append((name, float(scores[e]), int(first[x]), int(last[e0 + e])))
        out: list[tuple[str, float, int, int]] = []
        for r in sorted(found, key=lambda r: (-r[1], r[0], r[2], r[3])):
            if all(r[3] < o[2] or o[3] < r[2] for o in out):
                out.append(r)
        return sorted(out, key=lambda r: r[2])


def units(text: bytes) -> dict[bytes, list[tuple[int, int]]]:
    """Whole text, paragraphs and lines with the places they stand at; equal ones once."""
    out: dict[bytes, list[tuple[int, int]]] = {text: [(0, len(text))]}
    breaks = [(m.start(), m.end()) for m in _PARAGRAPH.finditer(text)]
    for a, b in zip([0, *(e for _, e in breaks)], [*(s for s, _ in breaks), len(text)]):
        out.setdefault(text[a:b], []).append((a, b))
    at = 0
    for line in text.split(b"\n"):
        out.setdefault(line, []).append((at, at + len(line)))
        at += len(line) + 1
    return out


def matches(matcher: Matcher, text: bytes) -> list[tuple[str, float, bytes]]:
    """(licence, Dice, unit) of matching units, then of runs of lines.

    A run is left out if a unit that overlaps it matches as well with the same
    licence, or holds all of it and matches as well.
    """
    found, placed = [], []
    for u, places in units(text).items():
        if hit := matcher.best(normalised(u)):
            found.append((*hit, u))
            placed += [(*hit, *p) for p in places]
    lines = text.split(b"\n")
    if len(lines) > 1:
        starts = np.cumsum([0, *(len(x) + 1 for x in lines)])
        for name, score, i, j in matcher.runs([normalised(x) for x in lines]):
            a, b = int(starts[i]), int(starts[j + 1]) - 1
            if not any(s >= score - 1e-12 and x < b and a < y and (n == name or x <= a and b <= y) for n, s, x, y in placed):
                found.append((name, score, text[a:b]))
    return found


def scan_licenses(docs: DataFrame, templates=TEMPLATES, least: float = DICE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, score, n_matches, matches) of every row.

    ``matches`` lists (license, score, unit) of every matching unit or run, ``license``
    and ``score`` the best of them, null without one. Null and empty texts match
    nothing. Repeated rows and null ids are kept; other columns are ignored.
    """
    state: dict = {}
    shared = docs.sparkSession.sparkContext.broadcast(tuple(templates))
    kind = pa.list_(pa.struct([("license", pa.string()), ("score", pa.float64()), ("unit", pa.string())]))

    def fn(batch):
        if "m" not in state:
            state["m"] = Matcher(shared.value, least)
        for a, e, texts in text_slices(batch):
            out = [[{"license": n, "score": s, "unit": u.decode("utf-8", "replace")} for n, s, u in matches(state["m"], t)] for t in texts]
            top = [min(f, key=lambda m: (-m["score"], m["license"])) if f else {"license": None, "score": None} for f in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, e - a), pa.array([t["license"] for t in top], pa.string()), pa.array([t["score"] for t in top], pa.float64()), pa.array([len(f) for f in out], pa.int64()), pa.array(out, kind)],
                ["doc_id", "license", "score", "n_matches", "matches"],
            )

    cols = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_texts(cols, fn, "doc_id long, license string, score double, n_matches long, matches array<struct<license:string,score:double,unit:string>>")
