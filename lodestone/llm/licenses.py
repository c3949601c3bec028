"""License scans by patience alignment.

A window of a text and a template are aligned on the words that occur once in
both: the longest increasing subsequence of their positions gives the anchors,
and the gaps between anchors are aligned in the same way. Coverage is the share
of the template's words that are aligned. Windows begin at all places from which
on enough of a template's words stand to reach the wanted coverage at all.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, unused

LEAST = 0.8
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
# Notices and texts of public licenses.
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution."
)
_BSD_3 = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU_END = (
    " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. "
    "You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
)


def _gnu(name: str, version: str, thing: str = "program", pause: str = ":") -> tuple[str, str]:
    """The short notice of a GNU license, and the whole one."""
    short = (
        f"This {thing} is free software{pause} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, "
        "or (at your option) any later version."
    )
    return short, short + _GNU_END.replace("program", thing).format(name=name)


TEMPLATES = {
    "MIT": ("Released under the MIT License.", _MIT, _MIT + " " + _AS_IS),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", *_gnu("General Public License", "3")),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", *_gnu("General Public License", "2", pause=";")),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", *_gnu("Lesser General Public License", "3", "library")),
    "LGPL-2.1": ("This work is licensed under the GNU Lesser General Public License, version 2.1.", *_gnu("Lesser General Public License", "2.1", "library", ";")),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", *_gnu("Affero General Public License", "3")),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "EPL-2.0": (
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",),
    "ISC": (
        _ISC,
        _ISC + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "BSD-3-Clause": (_BSD_2 + _BSD_3, _BSD_2 + _BSD_3 + _BSD_AS_IS),
    "BSD-2-Clause": (_BSD_2, _BSD_2 + _BSD_AS_IS),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly "
        "marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    ),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
        "public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all "
        "present and future rights to this software under copyright law. " + _AS_IS.replace("THE AUTHORS OR COPYRIGHT HOLDERS", "THE AUTHORS"),
    ),
}


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def increasing(values: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence, by piles as in the card game."""
    tops, at, before = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        before[i] = at[p - 1] if p else -1
        tops[p : p + 1] = [v]
        at[p : p + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions (in a, in b) of equal words, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        once = Counter(b[j:n])
        place = {w: k for k, w in enumerate(b[j:n], j) if once[w] == 1}
        seen = Counter(a[i:m])
        pairs = [(k, place[w]) for k, w in enumerate(a[i:m], i) if seen[w] == 1 and w in place]
        anchors = [pairs[x] for x in increasing([y for _, y in pairs])]
        if anchors:
            x, y = i, j
            for k, h in anchors:
                out.append((k, h))
                todo.append((x, k, y, h))
                x, y = k + 1, h + 1
            todo.append((x, m, y, n))
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = LEAST):
        self.least = least
        self.templates = [(name, words_of(t)) for name, ts in templates.items() for t in ts]
        self.sets = [frozenset(w) for _, w in self.templates]

    @staticmethod
    def rich(words: list[bytes], places: list[int], want: Counter, width: int, need: float) -> list[bool]:
        """For each place, whether the ``width`` words from it on hold ``need`` of the words wanted, none counted too often."""
        have: Counter = Counter()
        out, total, hi = [], 0, 0
        for p in places:
            while hi < len(places) and places[hi] < p + width:
                w = words[places[hi]]
                have[w] += 1
                total += have[w] <= want[w]
                hi += 1
            out.append(total >= need)
            w = words[p]
            total -= have[w] <= want[w]
            have[w] -= 1
        return out

    def find(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(license, start, end, coverage): word spans, best first where they overlap, then by start."""
        held = set(words)
        found = []
        for (name, template), own in zip(self.templates, self.sets, strict=True):
            m = len(template)
            need = self.least * m
            if sum(w in held for w in template) < need:
                continue
            width = m + m // 2 + 2
            places = [i for i, w in enumerate(words) if w in own]
            enough = self.rich(words, places, Counter(template), width, need)
            start = 0
            for k, ok in zip(places, enough, strict=True):
                # a place is aligned only if its window holds enough of the template's words, each as often as there
                if not ok or k < start:
                    continue
                pairs = patience(words[k : k + width], template)
                if len(pairs) >= need:
                    found.append((name, k + pairs[0][0], k + pairs[-1][0] + 1, len(pairs) / m, m))
                    start = k + pairs[-1][0] + 1
        kept: list[tuple] = []
        for f in sorted(found, key=lambda f: (-f[3], -f[4], f[1], f[0])):
            if all(f[2] <= k[1] or k[2] <= f[1] for k in kept):
                kept.append(f)
        return sorted((f[:4] for f in kept), key=lambda f: f[1])


FOUND = "array<struct<license:string,start:long,end:long,coverage:double>>"


def scan(docs: DataFrame, text_col: str = "text", templates: dict[str, tuple[str, ...]] | None = None, least: float = LEAST, carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` (default: all) plus ``licenses``: the licenses found, with word spans and coverage.

    Whole texts are scanned. A null or empty text has none; repeated rows each
    get theirs; an empty table gives no rows. Where found spans overlap, the one
    with the highest coverage stays, then that of the longer template. An input
    column named ``licenses`` is replaced.
    """
    names = [c for c in (docs.columns if carry is None else carry) if c.lower() != "licenses"]
    kept = [F.col(f"`{c}`") for c in names]
    (text,) = unused([*names, "licenses"], "text_")
    given = docs.select(*kept, text_of(text_col).alias(text), F.array().cast(FOUND).alias("licenses"))
    use = dict(TEMPLATES if templates is None else templates)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(use, least)
        for b in it:
            rows = [[dict(zip(("license", "start", "end", "coverage"), f, strict=True)) for f in scanner.find(words_of(t.as_py()))] for t in b.column(b.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rows, b.schema.field("licenses").type)], schema=b.schema)

    return given.mapInArrow(batches, given.schema).drop(text)
