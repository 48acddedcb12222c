"""License scans: patience alignment of texts with license templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import UPPER_TO_LOWER

#: Part of a template's words that must be aligned, in percent.
COVERED = 80

# Texts, notices and grants as their licenses have them. Words in braces tell a license from its kin; a text is
# looked at where it has the first of them, so that is a rare one.
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_NAMES = "{Neither} the name of the copyright holder nor the names of its contributors may be used to {endorse} or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the "
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
)
_MIT_REST = (
    ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
    "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
    "OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
)
_GNU_HEADER = (
    "{subject} is free software; you can redistribute it and/or modify it under the terms of the {{GNU}} {kind}General Public License as published by the Free Software "
    "Foundation; either version {{{version}}} of the License, or (at your option) any later version."
)
TEMPLATES = {
    "Apache-2.0": "Licensed under the {Apache} License, Version {2.0}",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.{apache}.org/licenses/LICENSE-{2.0} "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR "
    "CONDITIONS OF ANY KIND, either express or implied.",
    "MIT-notice": "{Released} under the {MIT} License",
    "MIT-grant": _MIT_GRANT,
    "MIT": _MIT_GRANT + _MIT_REST,
    "ISC": _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL "
    "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
    "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "ISC-grant": _ISC_GRANT + ", {provided} that the above copyright notice and this permission notice appear in all copies.",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-2-Clause": _BSD + _BSD_END,
    "BSD-3-Clause": _BSD + _BSD_NAMES + _BSD_END,
    "Zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this "
    "software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to "
    "the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be "
    "plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Distributed under the {Boost} Software License, Version {1.0}",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
    "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "CC0-1.0-notice": "Licensed under {CC0} 1.0 Universal",
    "MPL-2.0": "This Source Code Form is subject to the terms of the {Mozilla} Public License, v. {2.0}. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "GPL-2.0-header": _GNU_HEADER.format(subject="This program", kind="", version=2),
    "GPL-3.0-header": _GNU_HEADER.format(subject="This program", kind="", version=3),
    "LGPL-2.1-header": _GNU_HEADER.format(subject="This library", kind="{Lesser} ", version="2.1"),
    "LGPL-3.0-header": _GNU_HEADER.format(subject="This library", kind="{Lesser} ", version=3),
    "AGPL-3.0-header": _GNU_HEADER.format(subject="This program", kind="{Affero} ", version=3),
    "GPL-2.0": "This work is licensed under the {GNU} General Public License, version {2}",
    "GPL-3.0": "This work is licensed under the {GNU} General Public License, version {3}",
    "LGPL-2.1": "This work is licensed under the {GNU} {Lesser} General Public License, version {2.1}",
    "LGPL-3.0": "This work is licensed under the {GNU} {Lesser} General Public License, version {3}",
    "AGPL-3.0": "This work is licensed under the {GNU} {Affero} General Public License, version {3}",
    "All-rights-reserved": "All rights {reserved}",
}
_CC_NAMES = {"BY": "Attribution", "NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
for _parts in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"):
    for _version in ("3.0", "4.0"):
        _scope = "International" if _version == "4.0" else "Unported"
        TEMPLATES[f"CC-{_parts}-{_version}"] = f"Licensed under {{CC}} {{{_parts}}} {{{_version}}}"
        TEMPLATES[f"CC-{_parts}-{_version}-notice"] = f"This work is licensed under a Creative {{Commons}} {{{'-'.join(_CC_NAMES[p] for p in _parts.split('-'))}}} {{{_version}}} {_scope} License"
_TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+")


def tokens(text: str | None) -> list[bytes]:
    return _TOKEN.findall((text or "").encode().translate(UPPER_TO_LOWER))


def patience(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b) of equal words, increasing in both.

    Equal beginnings and ends are aligned; words that occur once in both what is left of a and of b are anchors; the longest
    run of anchors that increases in both stays, and each gap between them is aligned the same way.
    """
    found: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {w: j for j, w in enumerate(b[b0:b1], b0) if once_b[w] == 1}
        pairs = [(i, at[w]) for i, w in enumerate(a[a0:a1], a0) if once_a[w] == 1 and w in at]
        chain = rising(pairs)
        if not chain:
            continue
        edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        found += chain
        gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False) if k > i + 1 and m > j + 1]
    return sorted(found)


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence whose second numbers increase: piles of cards, each card pointing to the top of the pile before."""
    tops: list[int] = []
    cards: list[int] = []
    before = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        before[n] = cards[pile - 1] if pile else -1
        tops[pile : pile + 1] = [j]
        cards[pile : pile + 1] = [n]
    out, n = [], cards[-1] if cards else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


class Template:
    """A template's words, those that must be aligned, and words of which every text that covers enough of it has one."""

    def __init__(self, name: str, text: str, covered: int):
        marked = re.split(r"[{}]", text)
        self.name, self.words, self.must = name, [], set()
        for n, part in enumerate(marked):
            own = tokens(part)
            self.must |= set(range(len(self.words), len(self.words) + len(own))) if n % 2 else set()
            self.words += own
        self.need = -(-covered * len(self.words) // 100)
        self.place = {w: i for i, w in reversed(list(enumerate(self.words)))}
        self.counts = Counter(self.words)
        self.keys: list[bytes] = [self.words[min(self.must)]] if self.must else []
        # Else: without the longest words, fewer words than needed are left, so a text must have one of them.
        spare = -1 if self.keys else len(self.words) - self.need
        for w in sorted(self.counts, key=lambda w: (-len(w), w)):
            if spare < 0:
                break
            self.keys.append(w)
            spare -= self.counts[w]

    def best(self, words: list[bytes], at: dict[bytes, list[int]], taken: list[tuple[int, int]]) -> tuple[int, int, int] | None:
        """(words aligned, start, end) of the best place that meets no taken stretch, the first of several.

        Places start where a key word would put the template's first word; each is as long as twice the template.
        """
        n = len(self.words)
        slack = max(1, n // 2)
        starts = sorted({max(0, p - self.place[k] - slack) // slack * slack for k in self.keys for p in at.get(k, ())})
        top = None
        for s in starts:
            part = words[s : s + 2 * n + slack]
            if sum((Counter(part) & self.counts).values()) < self.need:
                continue
            pairs = patience(self.words, part)
            if len(pairs) < self.need or not self.must <= {i for i, _ in pairs}:
                continue
            start, end = s + pairs[0][1], s + pairs[-1][1] + 1
            if (top is None or len(pairs) > top[0]) and not any(a < end and start < b for a, b in taken):
                top = (len(pairs), start, end)
        return top


def scan(docs: DataFrame, templates: dict[str, str] | None = None, covered: int = COVERED) -> DataFrame:
    """doc_id, license, template_words, matched_words, coverage, start_word, end_word: a row for each license a text has.

    Words are runs of letters and digits in lower case. A text has a license if at least 80 % of its template's words are
    aligned with a stretch of the text, the words that tell it from its kin (as version, Lesser, NC) among them. The best
    stretch is given, in words, end exclusive. Templates are tried from the longest on, and no stretch is given twice: a notice
    within a license's text, or CC BY within CC BY-NC, is no license of its own.

    Null and empty texts have none. Rows that share a doc_id are scanned each. Other columns are not read. An empty table
    gives an empty result.
    """
    known = sorted((Template(k, v, covered) for k, v in (templates or TEMPLATES).items()), key=lambda t: (-len(t.words), t.name))
    keys = sorted({w for t in known for w in t.keys})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode().translate(UPPER_TO_LOWER)
                has = {w for w in keys if w in data}
                if not has:
                    continue
                words = _TOKEN.findall(data)
                at: dict[bytes, list[int]] = {}
                for i, w in enumerate(words):
                    if w in has:
                        at.setdefault(w, []).append(i)
                taken: list[tuple[int, int]] = []
                for t in known:
                    if (not at.keys().isdisjoint(t.keys)) and (hit := t.best(words, at, taken)):
                        rows.append((doc_id, t.name, len(t.words), hit[0], hit[0] / len(t.words), hit[1], hit[2]))
                        taken.append(hit[1:])
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            names = ["doc_id", "license", "template_words", "matched_words", "coverage", "start_word", "end_word"]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)

    schema = "doc_id long, license string, template_words long, matched_words long, coverage double, start_word long, end_word long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, schema)
