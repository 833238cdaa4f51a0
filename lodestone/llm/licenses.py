"""License scans by conditional compression.

In a text with a license hint, windows with enough words of a template, counted over line ends and inside lines, are the
candidate blocks; windows that meet are one block, and the count loses none. A block is compressed alone and with each
template as zstandard raw dictionary, and the reductions in size rank the templates. In that order a template is aligned
with the words of the block; a stretch confirms it if at most ``MAX_DIFFERENT`` of the longer text's words differ and both
have the same words that tell licenses apart (names, versions, clauses). The first that is confirmed wins, and what is
left of the block beside its stretches is looked at again in the same way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._common import text_bytes

# fixed values: short statements and notices of common licenses, by SPDX identifier
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication."),
]
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
TEMPLATES += [(n, f"{t}\n{_ISC_END if n == 'ISC' else _BSD_END}") for n, t in TEMPLATES if n in ("BSD-2-Clause", "BSD-3-Clause", "ISC")]
# fixed values: identifier, name, version and date of the licenses of one family, whose texts differ in these
GNU = [
    ("GPL-2.0", "General", "2", "June 1991"), ("GPL-3.0", "General", "3", "29 June 2007"), ("LGPL-2.1", "Lesser General", "2.1", "February 1999"),
    ("LGPL-3.0", "Lesser General", "3", "29 June 2007"), ("AGPL-3.0", "Affero General", "3", "19 November 2007"),
]
CREATIVE_COMMONS = [("BY", ""), ("BY-SA", "-ShareAlike"), ("BY-NC", "-NonCommercial"), ("BY-ND", "-NoDerivatives"), ("BY-NC-SA", "-NonCommercial-ShareAlike"), ("BY-NC-ND", "-NonCommercial-NoDerivatives")]
_GNU_NOTICE = next(t for n, t in TEMPLATES if n == "GPL-3.0" and "redistribute" in t)
# fixed values: how the texts of licenses begin
_GNU_TITLE = "GNU {kind} Public License Version {version}, {date} Copyright (C) {year} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_CC_TITLE = "Creative Commons Attribution{kind} 4.0 International Public License By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution{kind} 4.0 International Public License (\"Public License\")."
for _name, _kind, _version, _date in GNU:
    TEMPLATES += [
        (_name, f"This work is licensed under the GNU {_kind} Public License, version {_version}."),
        *((_name, t.replace("GNU General", f"GNU {_kind}").replace("version 3", f"version {_version}")) for t in (_GNU_NOTICE, _GNU_NOTICE[: _GNU_NOTICE.index(" This program is dist")])),
        (_name, _GNU_TITLE.format(kind=_kind, version=_version, date=_date, year=_date[-4:])),
    ]
for _name, _kind in CREATIVE_COMMONS:
    TEMPLATES += [
        (f"CC-{_name}-4.0", f"This work is licensed under a Creative Commons Attribution{_kind} 4.0 International License."),
        (f"CC-{_name}-4.0", f"Licensed under CC {_name} 4.0."), (f"CC-{_name}-4.0", _CC_TITLE.format(kind=_kind)),
    ]
TEMPLATES += [
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
]
TEMPLATES += [(n, f"SPDX-License-Identifier: {n}") for n in dict.fromkeys(n for n, _ in TEMPLATES)]
TEMPLATES = list(dict.fromkeys(TEMPLATES))
# fixed values: words that tell licenses apart, and the neighbours of a number that is a version or counts clauses
_TELLING = frozenset(
    "mit apache gnu gpl lgpl agpl bsd isc mozilla mpl eclipse epl unlicense zlib cc cc0 lesser library affero"
    " noncommercial nc noderivatives noderivs nd sharealike sa endorse".split()
)
_BY_NUMBER = frozenset(("version", "v", "bsd", "clause"))
_HINT = re.compile(rb"licen[sc]e|copyright|\xc2\xa9|spdx|warrant|redistribut|permission|merchantab|creative commons|public domain", re.I)
_WORD = re.compile(r"[^\W_]+(?:\.[^\W_]+)*")
LEVEL = 3
MAX_DIFFERENT = 0.25
MAX_TEMPLATE_BYTES = 8 << 20
SCHEMA = "doc_id long, first_line int, last_line int, license_id string, size_alone int, size_given int, words int, different_words int, exact boolean"


def _distances(ids: np.ndarray, template: np.ndarray, anywhere: bool) -> np.ndarray:
    """The fewest words to change between the template and ids[:j] for each j, or, anywhere, the best ids[i:j] that ends at j."""
    at = np.arange(len(ids) + 1)
    d = np.zeros_like(at) if anywhere else at
    for w in template:
        e = d + 1
        np.minimum(e[1:], d[:-1] + (ids != w), out=e[1:])
        d = np.minimum.accumulate(e - at) + at
    return d


def different_words(a: list[str], b: list[str]) -> int:
    """The words to insert, delete or replace to make one text of the other."""
    known = {w: k for k, w in enumerate(dict.fromkeys(a + b))}
    return int(_distances(np.array([known[w] for w in a], np.int64), np.array([known[w] for w in b], np.int64), False)[-1])


def telling(words: list[str]) -> frozenset[str]:
    """Those of the words that tell one license from another; a version with and without its ending .0 is the same."""
    out = set()
    for k, w in enumerate(words):
        if w in _TELLING:
            out.add(w)
        elif w[0].isdigit() and ("." in w or not _BY_NUMBER.isdisjoint(words[max(k - 1, 0) : k + 2])):
            out.add(w.removesuffix(".0"))
    return frozenset(out)


class Scanner:
    def __init__(self, templates: list[tuple[str, str]]):
        import zstandard as z

        params = z.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.alone = z.ZstdCompressor(compression_params=params)
        self.given = [z.ZstdCompressor(compression_params=params, dict_data=z.ZstdCompressionDict(t.encode(), dict_type=z.DICT_TYPE_RAWCONTENT)) for _, t in templates]
        self.names = [n for n, _ in templates]
        self.words = [_WORD.findall(t.lower()) for _, t in templates]
        self.telling = [telling(t) for t in self.words]
        self.known = {w: k for k, w in enumerate(dict.fromkeys(w for t in self.words for w in t), 1)}
        self.ids = [np.array([self.known[w] for w in t], np.int64) for t in self.words]
        self.has = np.zeros((len(templates), len(self.known) + 1), bool)
        for k, t in enumerate(self.ids):
            self.has[k, t] = True

    def ranked(self, block: bytes, among: list[int]) -> list[int]:
        """Templates by what they save as dictionary, the most (the smallest size) first; of equal ones the earlier."""
        return sorted(among, key=lambda k: (len(self.given[k].compress(block)), k))

    def confirmed(self, words: list[str], k: int) -> int | None:
        """The words that differ from template k, None if they are too many or other words tell the two apart."""
        longer = max(len(words), len(self.words[k]))
        if abs(len(words) - len(self.words[k])) > MAX_DIFFERENT * longer or telling(words) != self.telling[k]:
            return None
        d = different_words(words, self.words[k])
        return d if d <= MAX_DIFFERENT * longer else None

    def row(self, block: bytes, words: list[str], k: int, different: int) -> tuple:
        return self.names[k], len(self.alone.compress(block)), len(self.given[k].compress(block)), len(words), different, different == 0

    def best(self, block: bytes) -> tuple | None:
        """license_id, the two sizes, words, different words, exact of a text that is one license; None if the wording confirms no template."""
        words = _WORD.findall(block.decode("utf-8", "replace").lower())
        for k in self.ranked(block, list(range(len(self.names)))):
            d = self.confirmed(words, k)
            if d is not None:
                return self.row(block, words, k, d)
        return None

    def _near(self, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(start, end) of stretches of ``ids`` near template k that do not overlap; a closer one goes before others."""
        t, m = self.ids[k], len(self.ids[k])
        d = _distances(ids, t, True)
        ends = np.flatnonzero(d <= m * MAX_DIFFERENT / (1 - MAX_DIFFERENT))
        free, out = np.ones(len(d), bool), []
        for end in ends[np.argsort(d[ends], kind="stable")].tolist():
            if not free[end]:
                continue
            lengths = _distances(ids[max(0, end - 2 * m) : end][::-1], t[::-1], False)
            size = min(np.flatnonzero(lengths == lengths.min()).tolist(), key=lambda n: (abs(n - m), n))
            if lengths[size] <= MAX_DIFFERENT * max(m, size):
                out.append((end - size, end))
                free[end - size + 1 : end + int(m * (1 - MAX_DIFFERENT))] = False  # stretches that end there overlap
        return out

    def blocks(self, ids: np.ndarray) -> list[tuple[int, int, list[int]]]:
        """(start, end, templates) of the runs of windows that have enough words of a template; runs that meet are one block."""
        runs = []
        for k, t in enumerate(self.ids):
            sums = np.concatenate([[0], np.cumsum(self.has[k][ids], dtype=np.int64)])
            least, width = (1 - MAX_DIFFERENT) * len(t), min(len(ids), int(len(t) / (1 - MAX_DIFFERENT)) + 1)
            if sums[-1] < least:
                continue
            full = np.flatnonzero(sums[width:] - sums[: len(sums) - width] >= least)
            for run in np.split(full, np.flatnonzero(np.diff(full) > width) + 1) if len(full) else []:
                runs.append((int(run[0]), int(run[-1]) + width, k))
        out: list[tuple[int, int, list[int]]] = []
        for a, b, k in sorted(runs):
            if out and a < out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]), [*out[-1][2], k])
            else:
                out.append((a, b, [k]))
        return [(a, b, sorted(set(ks))) for a, b, ks in out]

    def winners(self, ids: np.ndarray, block: bytes, lower: list[str], among: list[int]) -> tuple[int, list[tuple[int, int, int]]]:
        """The best-ranked template of which the wording confirms a stretch, and its stretches with their different words; -1 if there is none."""
        for k in self.ranked(block, among):
            found = [(i, j, d) for i, j in self._near(ids, k) if (d := self.confirmed(lower[i:j], k)) is not None]
            if found:
                return k, sorted(found)
        return -1, []

    def licenses(self, text: str) -> list[tuple[int, int, tuple]]:
        """(start, end, row) of the stretches of characters that are licenses, in order."""
        flat = np.fromiter((x for m in _WORD.finditer(text) for x in (m.start(), m.end(), self.known.get(m.group().lower(), 0))), np.int64).reshape(-1, 3)
        starts, ends, ids = flat[:, 0], flat[:, 1], np.ascontiguousarray(flat[:, 2])
        out, gaps = [], [(0, len(ids))]
        while gaps:
            lo, hi = gaps.pop()
            for a, b, among in self.blocks(ids[lo:hi]):
                a, b = lo + a, lo + b
                lower = [text[i:j].lower() for i, j in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                block = text[starts[a] : ends[b - 1]].encode("utf-8", "replace")
                k, found = self.winners(ids[a:b], block, lower, among)
                for i, j, d in found:
                    first, last = int(starts[a + i]), int(ends[a + j - 1])
                    out.append((first, last, self.row(text[first:last].encode("utf-8", "replace"), lower[i:j], k, d)))
                cuts = [0, *(x for i, j, _ in found for x in (i, j)), b - a]
                gaps += [(a + i, a + j) for i, j in zip(cuts[::2], cuts[1::2], strict=True) if found and i < j]
        return sorted(out)

    def hits(self, text: bytes) -> list[tuple]:
        """first line, last line and the row of each license in the text."""
        if not _HINT.search(text):
            return []
        whole, out, at, line = text.decode("utf-8", "replace"), [], 0, 0
        for a, b, row in self.licenses(whole):
            line += whole.count("\n", at, a)
            at = a
            out.append((line, line + whole.count("\n", a, b), *row))
        return out


def _scan(templates: list[tuple[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
        names = ["doc_id", "first_line", "last_line", "license_id", "size_alone", "size_given", "words", "different_words", "exact"]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(doc, *h) for h in scanner.hits(text or b"")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return run


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row for each stretch of a document that is a license: its lines, the winner, compressed sizes and wording differences.

    One pass over whole texts without a shuffle. Null and empty texts have no rows, rows with the same or a null doc_id have
    each their own. Equal reductions go to the earlier template; the sizes given out are those of the stretch. Of stretches
    near one template that overlap the nearest stays. Texts without a hint word have no rows. ``templates_in`` reads more templates.
    """
    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(_scan(templates or TEMPLATES), SCHEMA)


def templates_in(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """Whole license texts, a file each, named by the file without its ending. More than ``MAX_TEMPLATE_BYTES`` are an error, as every task has all."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    total = files.agg(F.sum("length")).first()[0] or 0
    if total > MAX_TEMPLATE_BYTES:
        raise ValueError(f"{total} bytes of templates in {folder}, at most {MAX_TEMPLATE_BYTES} go to every task")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.(txt|md)$", "")
    texts = spark.read.format("binaryFile").load(folder).select(name.alias("name"), F.decode("content", "UTF-8").alias("text"))
    return [(r.name, r.text) for r in texts.orderBy("name").collect() if _WORD.search(r.text)]
