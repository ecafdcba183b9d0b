"""License scans by patience alignment.

A template is aligned with a stretch of text by words unique to both: of these anchors the longest increasing
subsequence is kept, and the gaps between them are aligned in the same way, down to equal words at their edges.
Coverage is the number of aligned words over the template's words and the words inserted into the stretch: what is
missing and what is too much both count against a match. A stretch with coverage of at least 0.8 is one, unless a
telling word (a license's name, ShareAlike and the like) is missing or inserted, or the version: a number behind
"version", "v" or a license's name, of which a template's first one must be aligned and no other may be inserted.

SPDX identifiers are read as expressions: each license that OR, AND and parentheses join is one match of its own name;
what WITH adds is left out, and -only, -or-later and + belong to the license.

Stretches are found from all places where a template's own words stand: each votes for the start the template would
have there, and where enough votes lie close together an alignment is made. Texts that lack too many of the words, or a
telling one, are left at once, which loses no match.

Defined results: a null or empty text has no match; matches in a text don't overlap: the one with the most aligned
words stays, then the better covered, the earlier and the first by name; repeated rows get equal results; an empty
table gives no rows.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted

WORDS = regex.compile(r"[\p{L}\p{N}]+")
COVERAGE = 0.8
#: Notices, headers and texts of common licenses, as license/form.
TEMPLATES = {
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""",
    "MIT/text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
        NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
        EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
        ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
        OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause/text": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the
        above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
        "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
        CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
        (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
        BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
        TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
        THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause/text": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the
        above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior written
        permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
        SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
        THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN
        ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC/text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
        SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
        IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD/text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
        SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
        FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
        DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib/text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
        be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
        to the following restrictions: The origin of this software must not be misrepresented; you must not claim that
        you wrote the original software. If you use this software in a product, an acknowledgment in the product
        documentation would be appreciated but is not required. Altered source versions must be plainly marked as such,
        and must not be misrepresented as being the original software. This notice may not be removed or altered from any
        source distribution.""",
    "BSL-1.0/text": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the
        software and accompanying documentation covered by this license (the "Software") to use, reproduce, display,
        distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit
        third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in
        the Software and this entire statement, including the above license grant, this restriction and the following
        disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the
        Software, unless such copies or derivative works are solely in the form of machine-executable object code
        generated by a source language processor.""",
    "Unlicense/text": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
        modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
        binary, for any purpose, commercial or non-commercial, and by any means.""",
    "Unlicense/notice": "This is free and unencumbered software released into the public domain.",
    "WTFPL/text": """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and
        changing it is allowed as long as the name is changed.""",
    "MPL-2.0/header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at""",
    "EPL-2.0/header": """This program and the accompanying materials are made available under the terms of the Eclipse Public
        License 2.0 which is available at""",
    "CC0-1.0/notice": """To the extent possible under law, the author has waived all copyright and related or neighboring
        rights to this work.""",
    "reserved/notice": "All rights reserved.",
}
_GNU = {"GPL-2.0": ("", "2"), "GPL-3.0": ("", "3"), "LGPL-2.1": ("Lesser ", "2.1"), "LGPL-3.0": ("Lesser ", "3"), "AGPL-3.0": ("Affero ", "3")}
_COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _name, (_kind, _version) in _GNU.items():
    _short, _license = _name.split("-")[0], f"GNU {_kind}General Public License"
    TEMPLATES |= {
        f"{_name}/notice": f"This work is licensed under the {_license}, version {_version}.",
        f"{_name}/short": f"Licensed under the {_short} v{_version}.",
        f"{_name}/header": f"""{"This library" if _name == "LGPL-2.1" else "This program"} is free software: you can redistribute it and/or
            modify it under the terms of the {_license} as published by the Free Software Foundation, either version
            {_version} of the License, or (at your option) any later version. This program is distributed in the hope that it
            will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
            PARTICULAR PURPOSE. See the {_license} for more details.""",
    }
for _name, _long in _COMMONS.items():
    TEMPLATES |= {
        f"CC-{_name}-4.0/notice": f"This work is licensed under a Creative Commons {_long} 4.0 International License.",
        f"CC-{_name}-4.0/short": f"Licensed under CC {_name} 4.0.",
    }
TEMPLATES |= {f"{_name}/notice": f"Released under the {_name} License." for _name in ("MIT", "BSD", "ISC")}
#: SPDX names that are looked for.
SPDX = ("Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "Zlib", "BSL-1.0", "Unlicense", "MPL-2.0", "EPL-2.0", "CC0-1.0", "WTFPL", *_GNU, *(f"CC-{_n}-4.0" for _n in _COMMONS))
_NAME = r"[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?"
IDENTIFIER = regex.compile(rf"(?i:SPDX-License-Identifier):[ \t]*(\(*{_NAME}(?:\)*[ \t]+(?:OR|AND|WITH)[ \t]+\(*{_NAME})*)")
PART = regex.compile(_NAME)

#: Words that tell licenses apart: one that a template has must be aligned, one that it lacks must not be inserted.
TELLING = set("mit bsd 0bsd isc apache gnu gpl lgpl agpl lesser affero mozilla mpl eclipse epl zlib bsl boost commons cc cc0 attribution sharealike noncommercial noderivatives unlicense wtfpl".split())
#: Words that tell beside "cc" only, words that a version stands behind, and its form.
BESIDE, BEFORE, VERSION = set("by sa nc nd".split()), set("version v license licence".split()), regex.compile("v?[0-9]+").fullmatch


def versions(words: list[str]) -> list[int]:
    """The places of numbers that are versions of licenses."""
    out: list[int] = []
    for j in range(1, len(words)):
        if VERSION(words[j]) and (words[j - 1] in BEFORE or words[j - 1] in TELLING or words[j - 1] in BESIDE or (out and out[-1] == j - 1)):
            out.append(j)
    return out


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (in order of the first) that increases in the second, by patience piles."""
    tops: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect.bisect_left(tops, y)
        before[i] = ends[k - 1] if k else -1
        tops[k : k + 1], ends[k : k + 1] = [y], [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of aligned positions in a and b."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            out.append((k, m))
        if i >= k or j >= m:
            continue
        once_a, once_b = Counter(a[i:k]), Counter(b[j:m])
        where = {w: y for y, w in enumerate(b[j:m], j) if once_b[w] == 1}
        anchors = increasing([(x, where[w]) for x, w in enumerate(a[i:k], i) if once_a[w] == 1 and w in where])
        if anchors:
            x, y = i, j
            for p, q in anchors:
                todo.append((x, p, y, q))
                x, y = p + 1, q + 1
            todo.append((x, k, y, m))
            out += anchors
    return sorted(out)


class Template:
    def __init__(self, text: str):
        self.words = [w.lower() for w in WORDS.findall(text)]
        self.counts = Counter(self.words)
        self.own = {w: self.words.index(w) for w, n in self.counts.items() if n == 1}
        numbers = versions(self.words)
        #: Places of the first version.
        self.version = {p for k, p in enumerate(numbers) if p - k == numbers[0]}
        self.telling = {w for w in self.words if self.tells(w)} | {self.words[p] for p in self.version}
        self.rare_first = sorted(self.counts.items(), key=lambda x: (-len(x[0]), x[0]))

    def tells(self, word: str) -> bool:
        return word in TELLING or (word in BESIDE and "cc" in self.counts)

    def possible(self, words: set[str]) -> bool:
        """False if the words that are missing leave too few for the coverage, or one of them tells."""
        left = (1 - COVERAGE) * len(self.words) + 1e-9
        if not self.telling <= words:
            return False
        for w, n in self.rare_first:
            if w not in words:
                left -= n
                if left < 0:
                    return False
        return True

    def stretch(self, words: list[str], lo: int, hi: int) -> tuple[int, float, int, int] | None:
        """Aligned words, coverage, first and last word (exclusive) of the match within a part of the words."""
        pairs = align(self.words, words[lo:hi])
        n = len(self.words)
        gaps = [q[1] - p[1] - 1 for p, q in zip(pairs, pairs[1:])]
        a, b, inserted = 0, len(pairs), sum(gaps)
        # Words aligned far outside only widen the stretch: ends go as long as that covers better.
        while b - a > 1:
            size = n + inserted
            fewer = (b - a - 1) * size
            if fewer > (b - a) * (size - gaps[a]):
                inserted -= gaps[a]
                a += 1
            elif fewer > (b - a) * (size - gaps[b - 2]):
                inserted -= gaps[b - 2]
                b -= 1
            else:
                break
        if b - a < COVERAGE * (n + inserted) - 1e-9:
            return None
        first, last = pairs[a][1], pairs[b - 1][1] + 1
        aligned = {j for _, j in pairs[a:b]}
        if not self.telling <= {words[lo + j] for j in aligned} or not self.version <= {i for i, _ in pairs[a:b]}:
            return None
        if any(j not in aligned and first <= j < last for j in versions(words[lo : lo + last])):
            return None
        if any(self.tells(w) and w not in self.counts for j in range(first, last) if j not in aligned and (w := words[lo + j])):
            return None
        return b - a, (b - a) / (n + inserted), lo + first, lo + last

    def matches(self, words: list[str], places: dict[str, list[int]]) -> list[tuple[int, float, int, int]]:
        """Aligned words, coverage, first and last word (exclusive) of all stretches that match; they may overlap."""
        n = len(self.words)
        slack = max(2, n // 4)
        starts = np.sort(np.array([p - i for w, i in self.own.items() for p in places.get(w, ())], dtype=np.int64))
        need = max(1, int(np.ceil(len(self.own) - (1 - COVERAGE) * n)))
        until = np.searchsorted(starts, starts + slack, "right")
        good = np.flatnonzero(until - np.arange(len(starts)) >= need)
        found, last = set(), None
        for g in good.tolist():
            middle = int(starts[(g + int(until[g]) - 1) // 2])
            if last is not None and middle == last:
                continue
            last = middle
            # Without slack too: next to a copy of the template its words are not unique in a wider stretch.
            for wide in (0, slack):
                m = self.stretch(words, max(0, middle - wide), min(len(words), middle + n + wide))
                if m:
                    found.add(m)
        return sorted(found)


def best(found: list[tuple[str, int, float, int, int]]) -> list[tuple[str, float, int, int]]:
    """name, coverage, first and last word of the matches that stay."""
    taken: list[tuple[int, int, str, float]] = []
    for name, n, c, s, e in sorted(found, key=lambda x: (-x[1], -x[2], x[3], x[0])):
        k = bisect.bisect_left(taken, (s, e))
        if (k == 0 or taken[k - 1][1] <= s) and (k == len(taken) or taken[k][0] >= e):
            taken.insert(k, (s, e, name, c))
    return [(name, c, s, e) for s, e, name, c in taken]


def identified(text: str | None, names: dict[str, str]) -> list[tuple[str, float, int, int]]:
    """The same of SPDX identifiers; names: licenses by their names in lower case."""
    out = []
    for m in IDENTIFIER.finditer(text or ""):
        skip = False
        for part in PART.finditer(text, *m.span(1)):
            if part[0] in ("OR", "AND", "WITH"):
                skip = part[0] == "WITH"
            elif not skip and (name := names.get(regex.sub(r"(?:-only|-or-later|\+)$", "", part[0].lower()))):
                out.append((name, 1.0, *part.span()))
    return out


def scan_text(text: str | None, templates: dict[str, Template]) -> list[tuple[str, float, int, int]]:
    """license, coverage, start and end (code points, end exclusive) of each stretch that matches a template."""
    words = WORDS.findall((text or "").lower())
    known = set(words)
    likely = {k: t for k, t in templates.items() if t.possible(known)}
    if not likely:
        return []
    want = set().union(*(t.own for t in likely.values()))
    places: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        if w in want:
            places.setdefault(w, []).append(i)
    kept = best([(name, *m) for name, t in likely.items() for m in t.matches(words, places)])
    # Lower-casing can change a text's length, so the places come from the text itself.
    spans = _spans(text, words) if kept else []
    return [(name.split("/")[0], c, spans[s][0], spans[e - 1][1]) for name, c, s, e in kept]


def _spans(text: str, words: list[str]) -> list[tuple[int, int]]:
    found = [m.span() for m in WORDS.finditer(text)]
    if len(found) == len(words):
        return found
    # Rare: lower-casing made or broke a word; map through the lengths of lower-cased characters.
    origin = [i for i, c in enumerate(text) for _ in c.lower()]
    return [(origin[m.start()], origin[m.end() - 1] + 1) for m in WORDS.finditer(text.lower())]


def scan(df: DataFrame, keep: list[str], text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """keep, license, coverage, start, end: one row for each match in a whole text. templates: texts by license, or by
    license/form where a license has several."""
    kept = df.select(*[F.col(quoted(k)) for k in keep], F.col(quoted(text)).alias("__text"))
    fields = {"license": T.StringType(), "coverage": T.DoubleType(), "start": T.LongType(), "end": T.LongType()}
    schema = T.StructType([*kept.schema.fields[:-1], *(T.StructField(n, t) for n, t in fields.items())])
    texts, n, names = templates or TEMPLATES, len(keep), [*keep, *fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {k: Template(v) for k, v in texts.items()}
        own = {x.lower(): x for x in ([k.split("/")[0] for k in texts] if templates else SPDX)}
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                rows = [(i, *m) for i, x in enumerate(batch.column(n).to_pylist()) for m in scan_text(x, made) + identified(x, own)]
                at = pa.array([r[0] for r in rows], type=pa.int64())
                columns = [c.take(at) for c in batch.columns[:n]]
                columns += [pa.array([r[c] for r in rows], type=t) for c, t in ((1, pa.string()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return kept.mapInArrow(run, schema)
