"""License scans by conditional compression: templates as raw zstandard dictionaries."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.llm.common import id_back, id_text

# Fixed values: (license, template name, wording). Holders, years and titles are left out.
TEXTS = (
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", "text", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.'),
    ("BSD-3-Clause", "text", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.'),
    ("BSD", "notice", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC0-1.0", "notice", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
    ("ISC", "text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "text", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "text", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
# The disclaimers that follow the texts of that name.
DISCLAIMERS = {
    "MIT": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
}
# A program's header under the GNU licenses, with the license's name and version.
GNU_HEADER = "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
GNU = (("GPL", "GNU General Public License"), ("LGPL", "GNU Lesser General Public License"), ("AGPL", "GNU Affero General Public License"))
GNU_VERSIONS = {"GPL": ("1", "2", "3"), "LGPL": ("2.1", "3"), "AGPL": ("3",)}
CREATIVE_COMMONS = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
CC_KINDS, CC_VERSIONS = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"), ("1.0", "2.0", "2.5", "3.0", "4.0")


def families() -> list[tuple[str, str, str]]:
    """Templates that follow a rule: texts with their disclaimers, names and notices of each version, SPDX lines."""
    out = [(name, "full text", f"{text} {DISCLAIMERS[name.split('-')[0]]}") for name, kind, text in TEXTS if kind == "text" and name.split("-")[0] in DISCLAIMERS]
    for short, name in GNU:
        for v in GNU_VERSIONS[short]:
            one = f"{short}-{v if '.' in v else v + '.0'}"
            out += [(one, "notice", f"This work is licensed under the {name}, version {v}."), (one, "name", f"{name}, version {v}"), (one, "name", f"{name} v{v}"), (f"{one}-or-later", "header", GNU_HEADER.format(name=name, version=v))]
    for kind in CC_KINDS:
        for v in CC_VERSIONS:
            one, long = f"CC-{kind}-{v}", "Creative Commons " + "-".join(CREATIVE_COMMONS[x] for x in kind.split("-")) + f" {v}"
            out += [(one, "notice", f"Licensed under CC {kind} {v}."), (one, "name", f"CC {kind} {v}"), (one, "name", long), (one, "notice", f"This work is licensed under a {long} International License."), (one, "notice", f"This work is licensed under a {long} Unported License.")]
    out += [("MIT", "name", "MIT License"), ("ISC", "name", "ISC License"), ("Apache-2.0", "name", "Apache License, Version 2.0"), ("Apache-2.0", "name", "Apache License 2.0"), ("MPL-2.0", "name", "Mozilla Public License 2.0"), ("BSD-2-Clause", "name", "BSD 2-Clause License"), ("BSD-3-Clause", "name", "BSD 3-Clause License"), ("BSD", "name", "BSD License"), ("CC0-1.0", "name", "CC0 1.0 Universal")]
    known = list(dict.fromkeys(name for name, *_ in [*TEXTS, *out] if name != "BSD"))
    return [*out, *((name, "identifier", f"SPDX-License-Identifier: {name}") for name in known)]


TEMPLATES = (*TEXTS, *families())

#: Words that make a sentence a candidate, and how many other sentences may lie between two of a block.
CUES = r"(?i)licen[cs]e|copyright|creative commons|\bCC[ -]BY|\bCC0|permission is hereby|permission to use|redistribut|warrant(?:y|ies)|public domain|free software|all rights reserved"
GAP = 3
#: Bytes that a template saves at least, to be looked for word by word, and part of its own compressed size, to be compared with differences.
LEAST_SAVED, LEAST_SAVED_VARIANT = 1, 0.5
#: Least part of a variant's template's words that stand in order in the text; as many other words may stand between them, in part.
LEAST_COVERAGE = 0.8
#: A template is another license if one of these words, or a number, is on one side only.
DECISIVE = frozenset(
    "mit bsd isc apache mozilla gnu gpl lgpl agpl cc cc0 by sa nc nd by-sa by-nc by-nd by-nc-sa by-nc-nd lesser affero library public commons creative attribution sharealike "
    "noncommercial noderivatives attribution-sharealike attribution-noncommercial attribution-noderivatives attribution-noncommercial-sharealike attribution-noncommercial-noderivatives not no only later clause neither".split()
)

_cue, _sentence, _word = re.compile(CUES), re.compile(r"[^\n]*?(?:(?<!\bv)[.!?](?=\s)|(?=\n)|$)\s*", re.S), re.compile(r"\w+(?:[.'-]\w+)*")


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the text's sentences: up to a full stop (but that of "v.") before white space, or to the end of a line."""
    return [m.span() for m in _sentence.finditer(text) if m.end() > m.start()]


def blocks(text: str) -> list[tuple[int, int, int]]:
    """Candidate blocks ``(start, end, end of search)``: from a sentence with a cue to the last one with not more than ``GAP`` others between.

    Licenses are looked for in ``GAP`` sentences more, as they may end without a cue.
    """
    out: list[list[int]] = []  # first and last sentence
    spans = sentences(text) if _cue.search(text) else []
    for i, (a, b) in enumerate(spans):
        if _cue.search(text, a, b):
            if out and i - out[-1][1] <= GAP + 1:
                out[-1][1] = i
            else:
                out.append([i, i])
    stop = lambda j: spans[j][0] + len(text[spans[j][0] : spans[j][1]].rstrip())
    return [(spans[i][0], stop(j), stop(min(j + GAP, len(spans) - 1))) for i, j in out]


def words(text: str) -> list[str]:
    return _word.findall(text.casefold())


def decisive(word: str) -> bool:
    return word in DECISIVE or any(c.isdigit() for c in word)


class Scanner:
    """Compresses text alone and with each template, and compares the wording of those that save.

    Dictionaries end in eight line ends, as zstandard doesn't look up what begins in the last eight bytes.
    """

    def __init__(self, templates=TEMPLATES, level: int = 9):
        options = {"level": level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.alone = zstandard.ZstdCompressor(**options)
        given = dict.fromkeys((name, kind, text) for name, kind, text in templates)
        self.given = [
            (name, kind, words(text), len(self.alone.compress(text.encode())), zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(text.encode() + b"\n" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT), **options))
            for name, kind, text in given
        ]

    def reductions(self, text: str) -> tuple[int, list[int]]:
        """The compressed size, and how many bytes of it each template saves."""
        raw = text.encode("utf-8", "surrogatepass")
        size = len(self.alone.compress(raw))
        return size, [size - len(c.compress(raw)) for *_, c in self.given]

    def best(self, text: str, mine: list[str]) -> tuple | None:
        """(first word, word after the last, license, template, reduction, coverage, added, removed, verdict) of the best template in a text.

        Templates are ranked by what they save of their own compressed size, which doesn't depend on how long the text is. The wording
        of all that stand out decides: the longest that is there word for word (``exact``), else the best one of which most words stand
        in order and no decisive word differs (``variant``).
        """
        size, saved = self.reductions(text)
        ranked = sorted((i for i, x in enumerate(saved) if x >= LEAST_SAVED), key=lambda i: (-saved[i] / self.given[i][3], i))
        line, found = " " + " ".join(mine) + " ", None
        for i in ranked:
            name, kind, theirs, *_ = self.given[i]
            at = line.find(" " + " ".join(theirs) + " ")
            if at >= 0 and (found is None or len(theirs) > found[1] - found[0]):
                first = line.count(" ", 0, at)
                found = first, first + len(theirs), name, kind, saved[i] / size, 1.0, [], [], "exact"
        rank = None
        for i in ranked if found is None else []:
            name, kind, theirs, own, _ = self.given[i]
            if saved[i] < LEAST_SAVED_VARIANT * own:
                continue
            same = [m for m in difflib.SequenceMatcher(None, theirs, mine, autojunk=False).get_matching_blocks() if m.size]
            coverage = sum(m.size for m in same) / len(theirs)
            if coverage < LEAST_COVERAGE:
                continue
            first, last = same[0].b, same[-1].b + same[-1].size
            steps = difflib.SequenceMatcher(None, theirs, mine[first:last], autojunk=False).get_opcodes()
            removed = [w for op, a, b, _, _ in steps if op in ("delete", "replace") for w in theirs[a:b]]
            added = [w for op, _, _, a, b in steps if op in ("insert", "replace") for w in mine[first + a : first + b]]
            if len(added) <= (1 - LEAST_COVERAGE) * len(theirs) and not any(map(decisive, [*removed, *added])) and (rank is None or (coverage, saved[i]) > rank):
                rank = coverage, saved[i]
                found = first, last, name, kind, saved[i] / size, coverage, added, removed, "variant"
        return found

    def scan(self, block: str, cued: int) -> list[tuple]:
        """(start, end, license, template, reduction, coverage, added, removed, verdict) of each license in a block, in order.

        What a license takes is set aside, and what stands before and after it is scanned on. A block without any license gives one row ``none``
        for its first ``cued`` characters.
        """
        out, left = [], [(0, len(block))]
        while left:
            a, b = left.pop()
            spans = [m.span() for m in _word.finditer(block, a, b)]
            if not spans or not _cue.search(block, a, b):
                continue
            if (best := self.best(block[a:b], [block[x:y].casefold() for x, y in spans])) is not None:
                first, last, *rest = best
                end = spans[last - 1][1]
                out.append((spans[first][0], end + (block[end : end + 1] == "."), *rest))
                left += [(a, spans[first][0]), (end, b)]
        if not out:
            size, saved = self.reductions(block[:cued])
            out.append((0, cued, None, None, max(saved) / size, 0.0, [], [], "none"))
        return sorted(out, key=lambda x: x[0])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per license in a candidate block: ``(id, block, start, end, license, template, reduction, coverage, added, removed, verdict)``.

    A block with cue words but no license gives one row with the verdict ``none``, license and template null.
    ``start`` and ``end`` are code points; ``block`` counts a document's blocks from 0. Texts without cue words never
    leave the JVM. Null and empty texts have no blocks; an empty table gives an empty result; repeated rows
    are scanned each; texts are read whole; other columns are not read, whatever their names.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner()
        known: dict[tuple[str, int], list[tuple]] = {}
        for batch in batches:
            out = []
            for doc, text in zip(batch["id"], batch["text"]):
                for i, (a, b, stop) in enumerate(blocks(text)):
                    block = text[a:stop], b - a
                    if block not in known:
                        if len(known) > 10_000:
                            known.clear()
                        known[block] = scanner.scan(*block)
                    out += [(doc, i, a + x, a + y, *rest) for x, y, *rest in known[block]]
            yield pd.DataFrame(out, columns=names)

    names = ["id", "block", "start", "end", "license", "template", "reduction", "coverage", "added", "removed", "verdict"]
    schema = "block int, start int, end int, license string, template string, reduction double, coverage double, added array<string>, removed array<string>, verdict string"
    source = docs.select(id_text(id_col), F.col(text_col).alias("text")).where(F.col("text").rlike(CUES))
    return id_back(source.mapInPandas(run, f"id string, {schema}"), docs, id_col)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
