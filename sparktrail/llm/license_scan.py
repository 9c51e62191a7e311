"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Texts and templates are normalised alike: A-Z lower-cased, runs of ASCII bytes
that are neither letters nor digits become one space. All k-grams of bytes are
hashed and winnowed: of each window of w neighbours the least hash is kept, so
that a shared passage of k + w - 1 bytes always shares a fingerprint. An inverted
index maps the fingerprints of the templates to their places. Where enough
fingerprints of a template meet a text within the band's reach of a diagonal, the
template's words are aligned with the text's words there, within a band around
that diagonal; the alignment says how many of the template's words are matched
(coverage) and which code points of the text they span. Every such diagonal is
tried, those with the most fingerprints first. Words of a match are used up, so
that of overlapping spans of a template the first stays. Templates are rivals for
a text: where the spans of two overlap by more than half of the shorter, the one
with more matched words stays, then the one with the greater coverage, then the
first by name; so a notice of one version is not reported as that of another, nor
a whole licence as its opening too.

The templates are a parameter and their index is small, so each task holds it.

Defined cases: a null or empty text has no matches; texts are scanned whole,
however long; a template that occurs several times is reported each time; a
template of fewer bytes than a fingerprint has is refused; repeated rows are
scanned each; ids may be null or of any kind; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow

K, WINDOW, BAND = 12, 4, 8
MIN_COVERAGE, MIN_SHARE = 0.8, 0.25
CHUNK = 1 << 22

_NO_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GNU_END = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."

#: The whole texts of short licences, the notices of longer ones, and usual lines.
TEMPLATES = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _NO_WARRANTY,
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
    "MIT-warranty": _NO_WARRANTY,
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Apache-2.0-opening": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": _BSD + _BSD_END,
    "BSD-3-Clause": _BSD + _BSD_NAME + _BSD_END,
    "BSD-opening": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version." + _GNU_END + " See the GNU General Public License for more details.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version." + _GNU_END + " See the GNU General Public License for more details.",
    "GPL-2.0-opening": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-opening": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MPL-2.0-opening": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Unlicense-opening": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "All-rights-reserved": "All rights reserved.",
}

_PLAIN = np.full(256, 0x20, np.uint8)
_PLAIN[0x30:0x3A] = np.arange(0x30, 0x3A)
_PLAIN[0x61:0x7B] = np.arange(0x61, 0x7B)
_PLAIN[0x41:0x5B] = np.arange(0x61, 0x7B)
_PLAIN[0x80:] = np.arange(0x80, 0x100)


def normal(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes, and the place of each in raw."""
    b = _PLAIN[np.frombuffer(raw, np.uint8)]
    space = b == 0x20
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    at = np.flatnonzero(keep)
    return b[at], at


def k_grams(b: np.ndarray, k: int = K) -> np.ndarray:
    """A hash of each k-gram, by doubling: a k-gram is a longer and a shorter power of two side by side."""
    if len(b) < k:
        return np.zeros(0, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    power, n, out, have = b.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if k & n:
            m = len(b) - (have + n) + 1
            out = power[:m] if out is None else out[:m] * np.uint64(pow(int(base), n, 1 << 64)) + power[have : have + m]
            have += n
        if have == k:
            break
        power = power[: len(power) - n] * np.uint64(pow(int(base), n, 1 << 64)) + power[n:]
        n *= 2
    out = out * base
    return out ^ (out >> np.uint64(29))


def winnowed(h: np.ndarray, at: np.ndarray, w: int = WINDOW) -> np.ndarray:
    """Which of the places `at` hold the least hash of some window of w (of all, if there are fewer)."""
    n = len(h)
    if n <= w:
        return h[at] == h.min() if n else np.zeros(0, bool)
    chosen = np.zeros(len(at), bool)
    for back in range(w):
        first = at - back
        ok = (first >= 0) & (first + w <= n)
        least = np.full(len(at), True)
        for j in range(w):
            least[ok] &= h[at[ok]] <= h[first[ok] + j]
        chosen |= ok & least
    return chosen


@dataclass
class Template:
    name: str
    words: list[bytes]
    starts: np.ndarray  # of the words, in normalised bytes
    n_prints: int


class Index:
    def __init__(self, templates: dict[str, str], k: int = K, w: int = WINDOW):
        self.k, self.w, self.templates = k, w, []
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for name, text in sorted(templates.items()):
            b, _ = normal(text.strip().encode())
            b = b[:-1] if len(b) and b[-1] == 0x20 else b
            h = k_grams(b, k)
            if not len(h):
                raise ValueError(f"template {name!r} is shorter than {k} bytes")
            at = np.flatnonzero(winnowed(h, np.arange(len(h)), w))
            words, starts = words_of(b)
            self.templates.append(Template(name, words, starts, len(at)))
            for i in at:
                self.places[int(h[i])].append((len(self.templates) - 1, int(i)))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[[x >> 44 for x in self.places]] = True

    def hits(self, b: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, place in the text, place in the template) of the fingerprints that meet."""
        found = []
        for i in range(0, len(b), CHUNK):
            over = max(0, i - self.w)
            h = k_grams(b[over : i + CHUNK + self.k + self.w], self.k)
            at = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
            at = at[(at + over >= i) & (at + over < i + CHUNK)]
            at = at[winnowed(h, at, self.w)]
            for p in at.tolist():
                found += [(t, p + over, q) for t, q in self.places.get(int(h[p]), ())]
        return found


def words_of(b: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    words, space = b.tobytes().split(b" "), np.flatnonzero(b == 0x20)
    starts = np.r_[0, space + 1]
    full = [i for i, w in enumerate(words) if w]
    return [words[i] for i in full], starts[full]


def align(a: list[bytes], b: list[bytes | None], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """Local alignment of a with b where |j - i - diagonal| <= band: matched words, first and last word of b (exclusive)."""
    best = (0, 0, 0, 0)
    above: dict[int, tuple[int, int, int]] = {}  # j: score, matches, start
    for i, word in enumerate(a):
        row: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i + diagonal - band), min(len(b), i + diagonal + band + 1)):
            if b[j] is None:  # no alignment goes through a used word
                continue
            s, m, f = above.get(j - 1, (0, 0, j))
            if s <= 0:
                s, m, f = 0, 0, j
            cell = (s + 2, m + 1, f) if word == b[j] else (s - 1, m, f)
            for other in (above.get(j), row.get(j - 1)):
                if other and other[0] - 1 > cell[0]:
                    cell = (other[0] - 1, other[1], other[2])
            row[j] = cell if cell[0] > 0 else (0, 0, j)
            if cell[0] > best[0]:
                best = (cell[0], cell[1], cell[2], j + 1)
        above = row
    return best[1], best[2], best[3]


def scan(text: str | None, index: Index, band: int = BAND, min_coverage: float = MIN_COVERAGE, min_share: float = MIN_SHARE) -> list[tuple[str, float, int, int]]:
    """(template, coverage, start, end) in code points, by start."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    b, at = normal(raw)
    hits = index.hits(b)
    if not hits:
        return []
    words, starts = words_of(b)
    ends = starts + np.array([len(w) for w in words])
    by = defaultdict(list)
    for t, p, q in hits:
        by[t].append((p - q, p, q))
    out = set()
    for t, own in by.items():
        template = index.templates[t]
        reach = band * 8  # bytes of the words that the band lets a copy gain or lose
        diagonals = defaultdict(list)
        for d, p, q in own:
            diagonals[d].append((p, q))
        order = sorted(diagonals)
        left = list(words)  # None: used by a match
        for d in sorted(order, key=lambda d: (-len(diagonals[d]), d)):
            near = order[bisect_left(order, d - reach) : bisect_right(order, d + reach)]
            if len({q for x in near for _, q in diagonals[x]}) < min_share * template.n_prints:
                continue
            while True:
                free = [(p, q, j) for p, q in diagonals[d] if left[j := int(np.searchsorted(starts, p, "right")) - 1] is not None]
                if not free:
                    break
                _, q, j = free[len(free) // 2]
                i = int(np.searchsorted(template.starts, q, "right")) - 1
                first = max(0, j - i - band)
                part = left[first : j - i + len(template.words) + band + 1]
                matched, s, e = align(template.words, part, j - i - first, band)
                if matched < min_coverage * len(template.words):
                    break
                left[first + s : first + e] = [None] * (e - s)
                lo, hi = int(at[starts[first + s]]), int(at[ends[first + e - 1] - 1]) + 1
                out.add((matched, matched / len(template.words), template.name, lo, hi))
    kept = strongest(out)
    places = sorted({n for m in kept for n in m[3:]})
    chars, total, before = {}, 0, 0
    for n in places:
        total += len(raw[before:n].decode("utf-8", "surrogatepass"))
        chars[n], before = total, n
    return sorted(((name, c, chars[lo], chars[hi]) for _, c, name, lo, hi in kept), key=lambda x: (x[2], x[3], x[0]))


def strongest(found: set[tuple]) -> list[tuple]:
    """Of (matched words, coverage, name, start, end) whose spans overlap by more than half of the shorter, the strongest."""
    kept: list[tuple] = []  # by start
    starts: list[int] = []
    longest = max((m[4] - m[3] for m in found), default=0)
    for m in sorted(found, key=lambda m: (-m[0], -m[1], m[2], m[3], m[4])):
        lo, hi = m[3:]
        near = kept[bisect_left(starts, lo - longest) : bisect_left(starts, hi)]
        if all(2 * (min(hi, k[4]) - max(lo, k[3])) <= min(hi - lo, k[4] - k[3]) for k in near):
            at = bisect_right(starts, lo)
            starts.insert(at, lo)
            kept.insert(at, m)
    return kept


MATCHES = "array<struct<license:string,coverage:double,start:long,end:long>>"


def license_matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, doc_id: str = "doc_id", text: str = "text", min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """doc_id, n_matches and matches (license, coverage, start, end) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(Index(templates))
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        index = sent.value
        for batch in batches:
            found = [scan(t, index, min_coverage=min_coverage) for t in batch.column(1).to_pylist()]
            rows = [[dict(zip(("license", "coverage", "start", "end"), m)) for m in own] for own in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in rows], pa.int64()), pa.array(rows, kind)], names=["doc_id", "n_matches", "matches"])

    ids = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return map_arrow(ids, run, f"doc_id {ids.dtypes[0][1]}, n_matches long, matches {MATCHES}")
