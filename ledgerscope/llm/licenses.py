"""License scan by patience alignment of document words with license templates.

A template is found where at least ``COVERAGE`` of its words align, in order, with a stretch of the text of at
most one and a half times its length. The alignment anchors on words that occur once in both, takes
the longest increasing run of these anchors, and aligns the gaps between them in the same way; equal words
at the ends of a gap are matched first. Stretches are tried only where enough of the template's words
are there at all, which no aligned stretch can lack. Of stretches that begin within a quarter of the template's length the
fullest is aligned and, if that gives nothing, all of them as one, so the work grows with the text and not with its square. A license
that stands twice in a text is found twice. Of overlapping finds the one with most matched words stays, of equally full ones the first.

Notices (templates of up to ``NOTICE`` words) are found only with the right version: the words of the license's name and the numbers
that a notice holds must be among the matched ones, and no word of another variant (``VARIANTS``) may stand between them.

Null and empty texts hold no license, an empty table gives none. Long texts are scanned whole. Repeated rows are scanned each. Words are runs of a-z and 0-9
after lower-casing, so line breaks, punctuation and comment signs do not matter.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import fresh, mapped, text_chunks

COVERAGE = 0.8
NOTICE = 250  # words
# Words that make another license of one with the same text.
VARIANTS = frozenset(["nc", "nd", "sa", "noncommercial", "noderivatives", "noderivs", "sharealike", "lesser", "library", "affero"])
WORD = re.compile(r"[a-z0-9]+")
# Notices by which public licenses are granted or named.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express '
        "or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        'of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("All-rights-reserved", "All rights reserved."),
    ("Copyright-notice", "Copyright (c)"),
    (
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    (
        "LGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    (
        "AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/",
    ),
]
_BY_NAME = {name: text for name, text in TEMPLATES}  # of several the last, which is the longest of MIT and BSD
_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ENDORSEMENT = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
# The parts of public licenses by their short names, and the versions there are.
_COMMONS = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
_GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
_VERSIONS = {
    "CC": ["1.0", "2.0", "2.5", "3.0", "4.0"],
    "GPL": ["1.0", "2.0", "3.0"],
    "LGPL": ["2.1", "3.0"],
    "AGPL": ["3.0"],
    "Apache": ["1.0", "1.1", "2.0"],
    "MPL": ["1.0", "1.1", "2.0"],
    "EPL": ["1.0", "2.0"],
}


def _notices() -> list[tuple[str, str]]:
    """Short notices of all versions and variants."""
    made = [("MIT", "MIT License")]
    for kind, words in _COMMONS.items():
        for version in _VERSIONS["CC"]:
            made.append((f"CC-{kind}-{version}", f"Licensed under CC {kind} {version}."))
            for port in ("International", "Unported"):
                made.append((f"CC-{kind}-{version}", f"This work is licensed under a Creative Commons {words} {version} {port} License."))
    for kind, words in _GNU.items():
        for version in _VERSIONS[kind]:
            made.append((f"{kind}-{version}", f"This work is licensed under the {words}, version {version.removesuffix('.0')}."))
            made.append((f"{kind}-{version}", f"{words} version {version.removesuffix('.0')}"))
    made += [(f"Apache-{version}", f"Apache License, Version {version}") for version in _VERSIONS["Apache"]]
    made += [(f"MPL-{version}", f"Mozilla Public License, version {version}") for version in _VERSIONS["MPL"]]
    made += [(f"EPL-{version}", f"Eclipse Public License, version {version}") for version in _VERSIONS["EPL"]]
    return [notice for notice in made if notice not in TEMPLATES]


def tags() -> list[tuple[str, str]]:
    """Tags by which files of source code name their license."""
    names = ["MIT", "ISC", "Unlicense", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "BSL-1.0", "Zlib"]
    names += [f"CC-{kind}-{version}" for kind in _COMMONS for version in _VERSIONS["CC"]]
    names += [f"{kind}-{version}" for kind in ("Apache", "MPL", "EPL") for version in _VERSIONS[kind]]
    names += [f"{kind}-{version}{end}" for kind in _GNU for version in _VERSIONS[kind] for end in ("", "-only", "-or-later")]
    return [(name, f"SPDX-License-Identifier: {name}") for name in names]


TEMPLATES += _notices()
# Whole licenses that follow from their openings above.
TEMPLATES += [
    (
        "MIT",
        _BY_NAME["MIT"] + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
        "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("BSD-2-Clause", _BY_NAME["BSD"] + " " + _DISCLAIMER),
    ("BSD-3-Clause", _BY_NAME["BSD"] + _ENDORSEMENT + _DISCLAIMER),
    (
        "ISC",
        _BY_NAME["ISC"] + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
        "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
]
# Section 13 by which the Affero license differs from the GNU General Public License.
_REMOTE = """  13. Remote Network Interaction; Use with the GNU General Public License.
Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users
interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding
Source of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary
means of facilitating copying of software. This Corresponding Source shall include the Corresponding Source for any work covered by version 3
of the GNU General Public License that is incorporated pursuant to the following paragraph.
Notwithstanding any other provision of this License, you have permission to link or combine any covered work with a work licensed under version
3 of the GNU General Public License into a single combined work, and to convey the resulting work. The terms of this License will continue to
apply to the part which is the covered work, but the work with which it is combined will remain governed by version 3 of the GNU General Public
License.
"""


def whole_texts() -> list[tuple[str, str]]:
    """The long licenses; read on the driver, as the package that executors get has no text files."""
    folder = Path(__file__).parent / "license_texts"
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    found = [(name, (folder / f"{file}.txt").read_text("utf-8")) for file, name in names.items()]
    gpl = dict(found)["GPL-3.0"]
    affero = gpl.replace("GNU General", "GNU Affero General").replace("GNU GENERAL", "GNU AFFERO GENERAL")
    start, stop = affero.index("  13. "), affero.index("  14. ")
    return [*found, ("AGPL-3.0", affero[:start] + _REMOTE + affero[stop:])]


def _increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing run of ``values``, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for i, value in enumerate(values):
        low, high = 0, len(tops)
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if tops[middle] < value else (low, middle)
        before.append(piles[low - 1] if low else -1)
        tops[low:low + 1], piles[low:low + 1] = [value], [i]
    run = []
    at = piles[-1] if piles else -1
    while at >= 0:
        run.append(at)
        at = before[at]
    return run[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places of ``a`` and ``b``, increasing in both."""
    matched = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {word: i for i, word in enumerate(b[b0:b1], b0) if in_b[word] == 1}
        unique = [(i, where[word]) for i, word in enumerate(a[a0:a1], a0) if in_a[word] == 1 and word in where]
        anchors = [unique[i] for i in _increasing([j for _, j in unique])]
        matched += anchors
        if anchors:
            starts = [(a0, b0)] + [(i + 1, j + 1) for i, j in anchors]
            gaps += [(i, k, j, m) for (i, j), (k, m) in zip(starts, [*anchors, (a1, b1)])]
    return sorted(matched)


def _free(taken: list[tuple[int, int]], start: int, stop: int) -> list[tuple[int, int]]:
    """What ``taken``, disjoint and in order, leaves of a stretch."""
    pieces = []
    i = bisect_right(taken, start, key=lambda span: span[1])
    while i < len(taken) and taken[i][0] < stop:
        pieces.append((start, taken[i][0]))
        start = taken[i][1]
        i += 1
    return [piece for piece in [*pieces, (start, stop)] if piece[0] < piece[1]]


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...], coverage: float):
        self.names = [name for name, _ in templates]
        self.words = [WORD.findall(text.lower()) for _, text in templates]
        self.counts = [Counter(words) for words in self.words]
        self.need = [-(-len(words) * round(coverage * 1000) // 1000) for words in self.words]  # rounded up
        self.vocabulary = frozenset().union(*self.counts)
        self.marks = [
            {word for word in words if word.isdigit() or word in VARIANTS or word in WORD.findall(name.lower())} if len(words) <= NOTICE else None
            for name, words in zip(self.names, self.words)
        ]

    def _stretches(self, words: list[str], number: int) -> Iterator[tuple[int, int, int]]:
        """``(common words, start, stop)`` of the stretches that hold enough of a template's words."""
        wanted, length = self.counts[number], len(self.words[number])
        hits = [i for i, word in enumerate(words) if word in wanted]
        have: Counter = Counter()
        common, stop = 0, 0
        for left, at in enumerate(hits):
            while stop < len(hits) and hits[stop] < at + length + length // 2:
                word = words[hits[stop]]
                have[word] += 1
                common += have[word] <= wanted[word]
                stop += 1
            if common >= self.need[number]:
                yield common, at, hits[stop - 1] + 1
            word = words[hits[left]]
            common -= have[word] <= wanted[word]
            have[word] -= 1

    def _cells(self, words: list[str], number: int) -> list[tuple[int, int, int, int, int]]:
        """``(common words, start, stop)`` of the fullest stretch and ``start, stop`` of all that begin in the same quarter of the template's length."""
        step = max(len(self.words[number]) // 4, 1)
        cells: dict[int, tuple[int, int, int, int, int]] = {}
        for common, start, stop in self._stretches(words, number):
            most, a, b, first, _ = cells.get(start // step, (0, 0, 0, start, 0))
            cells[start // step] = (common, start, stop, first, stop) if common > most else (most, a, b, first, stop)
        return sorted(cells.values(), key=lambda cell: (-cell[0], cell[1]))

    def _matched(self, words: list[str], number: int, start: int, stop: int) -> tuple[int, int, int] | None:
        """``(matched, start, stop)`` of the fullest alignment in a stretch that is enough, if any."""
        template, need = self.words[number], self.need[number]
        if stop - start < need:
            return None
        pairs = align(words[start:stop], template)
        if len(pairs) < need:
            return None
        reach, places = len(template) + len(template) // 2, [i for i, _ in pairs]
        ends = [bisect_left(places, place + reach) for place in places]
        first = max(range(len(pairs)), key=lambda k: (ends[k] - k, -k))
        pairs = pairs[first : ends[first]]
        if len(pairs) < need:
            return None
        a, b = start + pairs[0][0], start + pairs[-1][0] + 1
        if self.marks[number] is not None:
            if not self.marks[number] <= {template[j] for _, j in pairs}:
                return None
            met = {start + i for i, _ in pairs}
            if any(words[i] in VARIANTS and i not in met for i in range(a, b)):
                return None
        return len(pairs), a, b

    def _widened(self, words: list[str], number: int, taken: list[tuple[int, int]], find: tuple[int, int, int]) -> tuple[int, int, int]:
        """The find itself, or a fuller one that begins or ends where it does; the stretch may have cut it."""
        reach = len(self.words[number]) + len(self.words[number]) // 2
        _, a, b = find
        onward = _free(taken, a, min(a + reach, len(words)))[0]
        back = _free(taken, max(b - reach, 0), b)[-1]
        others = [self._matched(words, number, *piece) for piece in (onward, back) if piece != (a, b)]
        return max([find, *filter(None, others)], key=lambda f: f[0])

    def _finds(self, words: list[str], number: int) -> Iterator[tuple[int, int, int, int]]:
        """``(matched, template, start, stop)``; finds of one template do not overlap, the fullest stretch is tried first."""
        taken: list[tuple[int, int]] = []
        for _, start, stop, first, last in self._cells(words, number):
            for whole in dict.fromkeys([(start, stop), (first, last)]):
                found = [self._matched(words, number, *piece) for piece in _free(taken, *whole)]
                for matched, a, b in filter(None, found):
                    matched, a, b = self._widened(words, number, taken, (matched, a, b))
                    taken.insert(bisect_left(taken, (a, b)), (a, b))
                    yield matched, number, a, b
                if any(found):
                    break

    def scan(self, text: str | None) -> list[tuple[str, int, int, int, float]]:
        """``(license, first character, end, matched words, coverage)`` in order of place."""
        lower = (text or "").lower()
        words = WORD.findall(lower)
        present = self.vocabulary.intersection(words)
        finds: list[tuple[int, int, int, int]] = []
        for number, counts in enumerate(self.counts):
            marks = self.marks[number]
            if (not marks or marks <= present) and sum(counts[w] for w in counts.keys() & present) >= self.need[number]:
                finds += self._finds(words, number)
        kept: list[tuple[int, int, int, int]] = []
        taken: list[tuple[int, int]] = []
        for find in sorted(finds, key=lambda f: (-f[0], f[2], f[3], self.names[f[1]])):
            span = find[2:]
            if _free(taken, *span) == [span]:
                taken.insert(bisect_left(taken, span), span)
                kept.append(find)
        if not kept:
            return []
        spans = [match.span() for match in WORD.finditer(lower)]
        share = lambda f: f[0] / len(self.words[f[1]])
        return [(self.names[f[1]], spans[f[2]][0], spans[f[3] - 1][1], f[0], share(f)) for f in sorted(kept, key=lambda f: f[2])]


def scan(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """A row for each license found: the columns of ``docs`` but the text, and ``license, start, stop, matched, coverage``.

    ``start`` and ``stop`` count characters of the lower-cased text. Columns of these names are replaced.
    """
    chosen = tuple(templates or TEMPLATES + tags() + whole_texts())
    names = ["license", "start", "stop", "matched", "coverage"]
    passed = [column for column in docs.columns if column != text and column.lower() not in names]
    scanned = fresh("scanned text", passed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, coverage)
        for chunk in text_chunks(batches, scanned):
            found = [(i, *find) for i, value in enumerate(chunk.column(len(passed)).to_pylist()) for find in scanner.scan(value)]
            row, *columns = zip(*found) if found else [()] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            rows = chunk.select(passed).take(pa.array(row, pa.int64())) if passed else None
            own = [pa.array(values, kind) for values, kind in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([*(rows.columns if rows is not None else []), *own], [*passed, *names])

    kinds = ["string", "long", "long", "long", "double"]
    schema = [f"`{column}` {docs.schema[column].dataType.simpleString()}" for column in passed] + [f"{n} {k}" for n, k in zip(names, kinds)]
    return mapped(docs.select(*passed, F.col(text).alias(scanned)), run, ", ".join(schema))
