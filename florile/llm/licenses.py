"""Licence scans: the Dice coefficient over word bigrams of normalised text and licence templates.

A text's units are its lines, its paragraphs of two or more lines, and the whole of it where it has several paragraphs. A unit is
normalised (lower case, letters and digits only, one space between words) and has a set of word bigrams. A template can reach
the threshold t only if its set is between t / (2 - t) and (2 - t) / t times as large, so a unit meets only templates within these
bounds. by_document also gives passages: stretches of words anywhere, over paragraphs or inside a line, that reach the threshold and
whose lines no matching unit of the licence has. The table of templates is small (about 40 rows), so it is part of the job; a larger
one, say the whole texts of a folder, is a parameter (templates_in). Long texts are read word by word: of a unit no more bigrams
are kept than the largest template may meet, and of a text no more than what stands between bigrams of templates.

Defined results: a null or empty text, and one without words, has no unit; a unit of one word has that word as its only "bigram"; rows of the
same doc_id are one document; a null doc_id is an id like others; other columns are ignored; an empty table gives an empty result.
"""

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean

THRESHOLD = 0.8
#: Bytes of templates, at most.
TEMPLATE_BYTES = 32 << 20

#: Short licence texts and notices, by SPDX id.
TEMPLATES = (
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        'of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A '
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
        "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL '
        "THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL '
        "THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
        "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
        "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
        "THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
        "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
        "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
        "THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission "
        "is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The "
        "origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
        "documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This "
        "notice may not be removed or altered from any source distribution.",
    ),
    (
        "BSL-1.0",
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to '
        "use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to "
        "do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, "
        "must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of "
        "machine-executable object code generated by a source language processor.",
    ),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
        "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software "
        "dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
        "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    (
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 "
        "of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either "
        "version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with "
        "this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version.",
    ),
)

WORD = re.compile(r"[^\W_]+")
#: Characters up to which a text is cut into words at once.
AT_ONCE = 1 << 20


def templates_in(spark: SparkSession, folder: str) -> tuple[tuple[str, str], ...]:
    """Templates from a folder of text files, each named by its licence. For scan and by_document, which send them to every task."""
    rows = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]*?)(?:\.[^./]*)?$", 1).alias("name"), "value")
    size = rows.agg(F.sum(F.octet_length("value"))).first()[0] or 0
    if size > TEMPLATE_BYTES:
        raise ValueError(f"{size} bytes of templates; {TEMPLATE_BYTES} are sent to tasks at most")
    return tuple((r["name"], r["value"]) for r in rows.collect())


def bigrams(text: str) -> frozenset[str]:
    w = WORD.findall(text.lower())
    return frozenset(f"{a} {b}" for a, b in zip(w, w[1:])) if len(w) > 1 else frozenset(w)


def dice(a: frozenset[str], b: frozenset[str]) -> float:
    return 2 * len(a & b) / (len(a) + len(b))


def units(text: str):
    """(first line, count of lines, text) of each unit."""
    lines = text.split("\n")
    yield from ((i, 1, x) for i, x in enumerate(lines) if x)
    start, paragraphs = None, 0
    for i, x in enumerate([*lines, ""]):
        if x.strip():
            start = i if start is None else start
        elif start is not None:
            paragraphs += 1
            if i - start > 1:
                yield start, i - start, "\n".join(lines[start:i])
            start = None
    if paragraphs > 1:
        yield 0, len(lines), text


class Templates:
    """Sets of bigrams by size."""

    def __init__(self, rows=TEMPLATES, threshold: float = THRESHOLD):
        self.t = threshold
        self.rows = sorted(((len(b := bigrams(text)), name, b) for name, text in rows), key=lambda r: r[:2])
        self.low, self.high = threshold / (2 - threshold), (2 - threshold) / threshold
        self.first: dict[str, list[int]] = {}  # the templates that have a bigram
        for k, (_, _, b) in enumerate(self.rows):
            for g in b:
                self.first.setdefault(g, []).append(k)
        self.most = self.high * self.rows[-1][0]

    def small_set(self, unit: str) -> frozenset[str]:
        """The unit's bigrams; none if they are more than any template can meet."""
        if len(unit) <= AT_ONCE:
            return bigrams(unit)
        own, last = set(), None
        for m in WORD.finditer(unit):
            w = m[0].lower()
            if last is not None:
                own.add(f"{last} {w}")
                if len(own) > self.most:
                    return frozenset()
            last = w
        return frozenset(own or ([last] if last else []))

    def matches(self, unit: str):
        """(name, Dice coefficient) of each template that the unit reaches the threshold with."""
        own = self.small_set(unit)
        n = len(own)
        if not n or n > self.most or self.first.keys().isdisjoint(own):
            return
        for size, name, b in self.rows:
            if size > self.high * n + 1e-9:
                break
            if size >= self.low * n - 1e-9 and (d := dice(own, b)) >= self.t - 1e-12:
                yield name, d


def clusters(text: str, known: Templates):
    """Words with their places, in lists such that no stretch of words that reaches the threshold goes beyond one: what parts them has more
    bigrams than any template can meet, and none of a template."""
    if len(text) <= AT_ONCE:
        yield [(m.start(), m[0].lower()) for m in WORD.finditer(text)]
        return
    own: list[tuple[int, str]] = []
    gap: set[str] = set()
    hit = False
    for m in WORD.finditer(text):
        w = m[0].lower()
        if own and (g := f"{own[-1][1]} {w}") in known.first:
            gap, hit = set(), True
        elif not hit:
            own.clear()
        else:
            gap.add(g)
        own.append((m.start(), w))
        if len(gap) > known.most:
            yield own
            own, gap, hit = own[-1:], set(), False
    if hit:
        yield own


def passages(text: str, known: Templates):
    """(first line, count of lines, name, Dice coefficient) of stretches of words, wherever they stand in the text, that reach the threshold.

    A stretch that reaches the threshold still does without the words before its first and after its last bigram of the template that
    count for it, so only stretches between two such bigrams are tried: all those within the bounds of size. Of a licence's stretches that
    overlap, the best is given (the longest, then the first, of equals).
    """
    starts: list[int] = []
    for found in clusters(text, known):
        best = _best_stretches([w for _, w in found], known)
        if best and not starts:
            starts = [0, *(m.end() for m in re.finditer("\n", text))]
        line = lambda i: bisect_right(starts, found[i][0]) - 1
        for name, all_ in best.items():
            taken: list[tuple[int, int]] = []  # word places, sorted, apart from each other
            for d, i, j in sorted(all_, key=lambda r: (-r[0], r[1] - r[2], r[1])):
                k = bisect_right(taken, (i, j))
                if (k == 0 or taken[k - 1][1] < i) and (k == len(taken) or j < taken[k][0]):
                    taken.insert(k, (i, j))
                    yield line(i), line(j) - line(i) + 1, name, d


def _best_stretches(w: list[str], known: Templates) -> dict[str, list[tuple[float, int, int]]]:
    """By name: the coefficient, first and last word of the best stretch from each place."""
    grams = [f"{a} {b}" for a, b in zip(w, w[1:])]
    places: dict[int, list[int]] = {}
    for i, g in enumerate(grams):
        for k in known.first.get(g, ()):
            places.setdefault(k, []).append(i)
    best: dict[str, list[tuple[float, int, int]]] = {}
    for k in sorted(places):
        size, name, b = known.rows[k]
        at = places[k]
        if len(at) < known.low * size - 1e-9 or len(next(iter(b)).split()) < 2:  # a stretch has so many of the template's bigrams at least
            continue
        for x, i in enumerate(at):
            own: set[str] = set()
            both, last, top = 0, i, (0.0, 0, 0)
            for y in range(x, len(at)):
                j = at[y]
                if y > x and grams[j] == grams[i]:
                    break  # from here on, the stretch without its first bigram is as good or better
                for g in grams[last : j + 1]:
                    if g not in own:
                        own.add(g)
                        both += g in b
                last = j + 1
                if len(own) > known.high * size + 1e-9:
                    break
                top = max(top, (2 * both / (len(own) + size), j, i))
            if top[0] >= known.t - 1e-12:
                best.setdefault(name, []).append((top[0], i, top[1] + 1))
    return best


def whole_scan(text: str, known: Templates):
    """(name, Dice coefficient, first line, count of lines) of the matching units, and of passages of lines that no matching unit of the licence has."""
    seen: dict[str, list[tuple[int, int]]] = {}
    for line, n, unit in units(text):
        best: dict[str, float] = {}
        for name, d in known.matches(unit):
            best[name] = max(d, best.get(name, 0.0))
        for name, d in best.items():
            seen.setdefault(name, []).append((line, line + n))
            yield name, d, line, n
    for line, n, name, d in passages(text, known):
        if not any(a < line + n and line < b for a, b in seen.get(name, ())):
            yield name, d, line, n


FOUND = "doc_id long, license_id string, dice double, first_line long, n_lines long"


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, inside: bool = False) -> DataFrame:
    """A row for each unit and licence that match, with the best of the licence's templates. inside: and for passages that are in no matching unit."""

    def run(batches):
        known = Templates(templates, threshold)
        for b in lean(batches):
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py() or ""
                if inside:
                    rows += [(i, *x) for x in whole_scan(text, known)]
                    continue
                for line, n, unit in units(text):
                    best: dict[str, float] = {}
                    for name, d in known.matches(unit):
                        best[name] = max(d, best.get(name, 0.0))
                    rows += [(i, name, d, line, n) for name, d in best.items()]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "license_id", "dice", "first_line", "n_lines"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FOUND)


def by_document(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document and licence: the count of matching units and other passages, the best coefficient and the first line that has it."""
    best = F.min_by("first_line", F.struct(-F.col("dice"), "first_line"))
    return scan(docs, templates, threshold, inside=True).groupBy("doc_id", "license_id").agg(F.count("*").alias("n_units"), F.round(F.max("dice"), 9).alias("best_dice"), best.alias("best_line"))
