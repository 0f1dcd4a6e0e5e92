"""Licence scans: passages of a text that are a known licence text or notice.

The text is compared piece by piece: the whole text, its paragraphs (runs of lines between blank lines), its lines, and
windows of about a template's size anywhere in the text, whatever lines and paragraphs they cross.  A piece and a template are sets of word bigrams of their normalised text; their likeness is the Dice coefficient
2 * common / (bigrams + bigrams).  Before any bigram is looked at, a template is ruled out for a piece whose size alone
keeps the coefficient under the threshold, and a piece that shares no bigram with any template is skipped.  A window at the
threshold holds so many of the template's bigrams that it has one of any few of them: windows are looked for only in
texts that have one of these.

Normalised: lower case, licence spellings unified, words are runs of letters and digits.

Defined results: NULL, empty or wordless texts have no match; a one-word piece matches a one-word template only; for
every template a text gets one row, its most alike piece (the first of several), but of several versions of a licence over
one passage only the most alike; repeated rows give repeated matches;
extra columns are carried only if listed in ``keep``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import row_blocks

THRESHOLD = 0.9

# Licence texts and notices in their public wording, by SPDX id (or the notice's own name)
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE
IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE
COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause (short)": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE
COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of
the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
Public License for more details. You should have received a copy of the GNU General Public License along with
this program. If not, see <https://www.gnu.org/licenses/>.""",
    "GPL-3.0-or-later (short)": """This program is free software: you can redistribute it and/or modify it under the terms of
the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
Public License for more details.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of
the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at
your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
Public License for more details. You should have received a copy of the GNU General Public License along with
this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA
02110-1301 USA.""",
    "GPL-2.0-or-later (short)": """This program is free software; you can redistribute it and/or modify it under the terms of
the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at
your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
Public License for more details.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "All rights reserved": "All rights reserved.",
}

_WORD = re.compile(r"[^\W_]+")
_VERSION = re.compile(r"(.+?)-(\d+\.\d+)(?=-or-later|$)")  # (licence, version) of a template's name
_SAME = [(re.compile(p), r) for p, r in ((r"\blicence", "license"), (r"\bsub-licen[cs]e", "sublicense"),
                                         (r"\bnon-infringement", "noninfringement"),
                                         (r"\bcopyright owner", "copyright holder"))]
# a word as written, in lower case: spellings with a hyphen that are one word when unified are one
_SPAN = re.compile(r"\b(?:sub-licen[cs]e|non-infringement)[^\W_]*|[^\W_]+")


def words(text: str) -> list[str]:
    text = text.lower()
    if "c" in text:
        for pattern, plain in _SAME:
            text = pattern.sub(plain, text)
    return _WORD.findall(text)


def bigrams(w: list[str]) -> frozenset:
    return frozenset(zip(w, w[1:])) if len(w) != 1 else frozenset([(w[0],)])


def size_bounds(n: int, threshold: float) -> tuple[float, float]:
    """Sizes that leave the coefficient with a set of ``n`` at the threshold or above."""
    return n * threshold / (2 - threshold) - 1e-9, n * (2 - threshold) / threshold + 1e-9


def pieces(text: str) -> Iterator[tuple[str, int, str]]:
    """(kind, start, piece): the whole text, its paragraphs of several lines, its lines."""
    yield "text", 0, text
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, line))
        at += len(line) + 1
    if len(lines) == 1:
        return
    run: list[tuple[int, str]] = []
    for start, line in [*lines, (at, "")]:
        if line.strip():
            run.append((start, line))
            continue
        if 1 < len(run) < len(lines):
            yield "paragraph", run[0][0], text[run[0][0]:run[-1][0] + len(run[-1][1])]
        run = []
    for start, line in lines:
        if line.strip():
            yield "line", start, line


def offsets(text: str) -> list[tuple[int, int]]:
    """(start, end) in ``text`` of every one of its ``words``."""
    low = text.lower()
    at = range(len(low) + 1)
    if len(low) != len(text):  # letters that are longer in lower case
        at = [i for i, c in enumerate(text) for _ in c.lower()] + [len(text)]
    return [(at[m.start()], at[m.end() - 1] + 1) for m in _SPAN.finditer(low)]


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold = threshold
        self.sets = {name: bigrams(words(t)) for name, t in templates.items()}
        self.sets = {name: s for name, s in self.sets.items() if s}
        self.bounds = {name: size_bounds(len(s), threshold) for name, s in self.sets.items()}
        self.largest = max((b[1] for b in self.bounds.values()), default=0)
        self.smallest = min((b[0] for b in self.bounds.values()), default=0)
        self.known = frozenset().union(*self.sets.values())
        held = Counter(g for other in self.sets.values() for g in other)
        self.anchors: dict[tuple, list[str]] = {}
        self.least, self.longest = {}, {}
        for name, other in self.sets.items():
            # common >= threshold * (window + template) / 2 and window >= lowest size: fewer are not enough
            self.least[name] = max(1, ceil(threshold * len(other) / (2 - threshold) - 1e-9))
            n_words = len(words(templates[name]))
            self.longest[name] = ceil(n_words * (2 - threshold) / threshold)
            for g in sorted(other, key=lambda g: (held[g], -len("".join(g)), g))[:len(other) - self.least[name] + 1]:
                self.anchors.setdefault(g, []).append(name)

    def windows(self, w: list[str]) -> Iterator[tuple[str, float, int, int]]:
        """(template, dice, first word, end) of the most alike window for every template that has one."""
        grams = list(zip(w, w[1:])) if len(w) > 1 else []
        there = self.anchors.keys() & set(grams)
        for name in dict.fromkeys(n for g in there for n in self.anchors[g]):
            other, least = self.sets[name], self.least[name]
            hits = [i for i, g in enumerate(grams) if g in other]
            if len(hits) < least:
                continue
            high, best = self.bounds[name][1], (0.0, 0, 0)
            # a window only gains by a neighbour that is a hit: the best one starts where a run of hits starts, or inside a
            # run and is as long as a window may be
            inside = []
            for n, i in enumerate(hits):
                if n + least > len(hits) or hits[n + least - 1] - i >= self.longest[name]:
                    continue
                if n and hits[n - 1] == i - 1:
                    inside.append(i)
                    continue
                seen, common = set(), 0
                for j in range(i, min(len(grams), i + self.longest[name])):
                    if grams[j] in seen:
                        continue
                    seen.add(grams[j])
                    if len(seen) > high:
                        break
                    if grams[j] in other:
                        common += 1
                        dice = 2 * common / (len(seen) + len(other))
                        if dice > best[0]:
                            best = (dice, i, j + 2)
                if best[0] == 1.0:
                    break
            if best[0] < 1.0:
                best = max(best, self._longest_window(grams, inside, name), key=lambda b: b[0])
            if best[0] >= self.threshold:
                dice, i, end = best  # repeated bigrams at the end of a template belong to it, too
                while end <= len(grams) and end - 1 - i < self.longest[name] and grams[end - 1] in other:
                    end += 1
                yield name, dice, i, end

    def _longest_window(self, grams: list, starts: list[int], name: str) -> tuple[float, int, int]:
        """(dice, first word, end) of the most alike window of full length at one of the ascending ``starts``."""
        other, size = self.sets[name], self.longest[name]
        inside: Counter = Counter()
        at = end = common = 0
        best = (0.0, 0, 0)
        for i in starts:
            if i + size > len(grams):
                break
            if i >= end:  # no overlap with the window before
                inside.clear()
                at = end = i
                common = 0
            for g in grams[end:i + size]:
                inside[g] += 1
                common += inside[g] == 1 and g in other
            for g in grams[at:i]:
                inside[g] -= 1
                if not inside[g]:
                    del inside[g]
                    common -= g in other
            at, end = i, i + size
            dice = 2 * common / (len(inside) + len(other))
            if dice > best[0]:
                best = (dice, i, end + 1)
        return best

    def scan(self, text: str | None) -> list[tuple[str, float, str, int, int]]:
        """(template, dice, kind, start, length) of the most alike piece for every template reached."""
        best: dict[str, tuple[float, str, int, int]] = {}
        for kind, start, piece in pieces(text or ""):
            w = words(piece)
            # distinct bigrams are no more than words, and words no fewer than bigrams: sizes first
            if not w or max(1, len(w) - 1) < self.smallest:
                continue
            mine = bigrams(w)
            if len(mine) > self.largest or not (mine & self.known):
                continue
            for name, other in self.sets.items():
                low, high = self.bounds[name]
                if low <= len(mine) <= high:
                    dice = 2 * len(mine & other) / (len(mine) + len(other))
                    if dice >= self.threshold and dice > best.get(name, (0.0,))[0]:
                        best[name] = (dice, kind, start, len(piece))
        text = text or ""
        w = words(text)
        if len(w) > 1 and len(w) - 1 >= self.smallest:
            at = None
            for name, dice, first, end in self.windows(w):
                if dice > best.get(name, (0.0,))[0]:
                    at = offsets(text) if at is None else at
                    start = at[first][0]
                    best[name] = (dice, "window", start, at[end - 1][1] - start)
        return [(name, *best[name]) for name in self.sets if name in best and not self._outdone(name, best)]

    def _outdone(self, name: str, best: dict[str, tuple]) -> bool:
        """Whether another version of the same licence is more alike over the same passage: versions differ in a word or two."""
        own = _VERSION.match(name)
        if not own:
            return False
        dice, _, start, length = best[name]
        for other, (more, _, at, size) in best.items():
            m = _VERSION.match(other)
            if m and m[1] == own[1] and m[2] != own[2] and more > dice:
                common = min(start + length, at + size) - max(start, at)
                if 2 * common > min(length, size):
                    return True
        return False


def scan(docs: DataFrame, templates: dict[str, str] | None = None, keep: list[str] | None = None,
         text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns of ``docs`` plus template, dice, piece, start and length (code points), a row per match."""
    keep = ["doc_id"] if keep is None else keep
    templates = TEMPLATES if templates is None else templates
    src = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("__text"))
    fixed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for batch in batches:
            for part in row_blocks(batch, "__text"):
                got = [(i, *m) for i, t in enumerate(part.column(len(keep))) for m in scanner.scan(t.as_py())]
                row = pa.array([g[0] for g in got], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(row) for c in part.columns[:len(keep)]], pa.array([g[1] for g in got], pa.string()),
                     pa.array([g[2] for g in got], pa.float64()), pa.array([g[3] for g in got], pa.string()),
                     pa.array([g[4] for g in got], pa.int64()), pa.array([g[5] for g in got], pa.int64())],
                    names=[*part.schema.names[:len(keep)], "template", "dice", "piece", "start", "length"])

    out = src.mapInArrow(run, f"{fixed}, template string, dice double, piece string, start bigint, length bigint")
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "template", "dice", "piece", "start",
                      "length")


def op7_license_scan(docs: DataFrame) -> DataFrame:
    return scan(docs)
