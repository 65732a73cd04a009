"""License scan by conditional compression, confirmed by exact wording."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Public wordings of license notices, by SPDX identifier and form.
TEMPLATES = {
    "Apache-2.0/notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "Apache-2.0/short": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause/grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0/short": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0/short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0/short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0/long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0/short": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-2.0/short": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0/short": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC/grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0/short": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT/grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MIT/short": "Released under the MIT License.",
    "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense/grant": "This is free and unencumbered software released into the public domain.",
    "AGPL-3.0/short": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0/SPDX": "SPDX-License-Identifier: Apache-2.0",
    "BSD-2-Clause/SPDX": "SPDX-License-Identifier: BSD-2-Clause",
    "BSD-3-Clause/SPDX": "SPDX-License-Identifier: BSD-3-Clause",
    "CC-BY-4.0/long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0/SPDX": "SPDX-License-Identifier: CC0-1.0",
    "GPL-2.0/SPDX": "SPDX-License-Identifier: GPL-2.0",
    "GPL-3.0/SPDX": "SPDX-License-Identifier: GPL-3.0",
    "ISC/SPDX": "SPDX-License-Identifier: ISC",
    "MIT/SPDX": "SPDX-License-Identifier: MIT",
    "MPL-2.0/SPDX": "SPDX-License-Identifier: MPL-2.0",
    "Apache-2.0/header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause/full": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause/full": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC/full": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT/full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Zlib/full": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
#: Words one of which every notice has; they part at any white space. All templates are tried around each hit.
CUE = r"(?i)\b(?:sub)?licen[sc]|\bpermission\b|\bredistribution\b|\bfree software\b|\bcopyright|\bpublic\s+domain\b"
#: Least share of a block's compressed size that the template must save, and most words that may differ per 100.
MIN_SAVED, MAX_DIFFER = 0.35, 15
LEVEL = 9

_WORD = re.compile(r"\w+(?:[.\-']\w+)*")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Scanner:
    """Finds notices in one text. Plain compressor and one conditional compressor per template are made once a task."""

    def __init__(self, templates: dict[str, str]):
        self.cue = re.compile(CUE)
        self.words = {k: _words(t) for k, t in templates.items()}
        self.bags = {k: Counter(w) for k, w in self.words.items()}
        self.slack = {k: len(w) * MAX_DIFFER // 100 for k, w in self.words.items()}
        self.cues = {k: self._hits(t, list(_WORD.finditer(t))) for k, t in templates.items()}
        if bare := [k for k, c in self.cues.items() if not c]:
            raise ValueError(f"templates without a cue: {bare}")
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.given = {}
        for k, t in templates.items():
            d = zstandard.ZstdCompressionDict(t.encode().rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.given[k] = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)

    def _hits(self, text: str, at: list[re.Match]) -> list[int]:
        """Numbers of the words at which cues begin."""
        starts = [m.start() for m in at]
        return sorted({max(0, bisect_right(starts, m.start()) - 1) for m in self.cue.finditer(text)}) if at else []

    def differences(self, k: str, have: list[str]) -> tuple[int, int, list[str], list[str]]:
        """(first, end, missing, extra): the words of ``have`` that stand for template k, and where they differ from it."""
        want = self.words[k]
        ops = SequenceMatcher(None, want, have, autojunk=False).get_opcodes()
        first, end = 0, len(have)
        if ops and ops[-1][0] == "insert":  # what follows the notice
            end, ops = ops[-1][3], ops[:-1]
        if ops and ops[0][0] == "insert":  # what precedes it
            first, ops = ops[0][4], ops[1:]
        missing = [w for tag, a, b, _, _ in ops if tag in ("delete", "replace") for w in want[a:b]]
        extra = [w for tag, _, _, a, b in ops if tag in ("insert", "replace") for w in have[a:b]]
        return first, end, missing, extra

    def around(self, text: str, at: list[re.Match], words: list[str], c: int, first: int) -> tuple | None:
        """The notice whose cue is word c and that lies from word ``first`` on: (first word, end, template, share saved, missing, extra)."""
        ranked = []
        for k, want in self.words.items():
            blocks = []
            for p in self.cues[k]:
                x, y = max(first, c - p - self.slack[k]), min(len(at), c - p + len(want) + self.slack[k])
                if (self.bags[k] & Counter(words[x:y])).total() * 100 < (100 - MAX_DIFFER) * len(want):
                    continue  # more words are missing than may differ
                data = " ".join(text[at[x].start() : at[y - 1].end()].split()).encode()
                plain = len(self.plain.compress(data))
                saved = plain - len(self.given[k].compress(data))
                if saved >= MIN_SAVED * plain:
                    blocks.append((saved, saved / plain, x, y))
            if blocks:
                ranked.append((max(blocks)[0], k, blocks))
        best, agreed = None, 0
        for _, k, blocks in sorted(ranked, key=lambda r: (-r[0], r[1])):
            told = [(d, x, share) for _, share, x, y in blocks if x + (d := self.differences(k, words[x:y]))[0] <= c < x + d[1]]
            if not told:
                continue  # a notice beside this cue, which has cues of its own
            (i, j, missing, extra), x, share = min(told, key=lambda d: (max(len(d[0][2]), len(d[0][3])), d[1]))
            n, differ = len(self.words[k]), max(len(missing), len(extra))
            if differ * 100 <= MAX_DIFFER * n and n - 2 * differ > agreed:  # kindred licenses differ in a clause only
                best, agreed = (x + i, x + j, k, share, missing, extra), n - 2 * differ
        return best

    def scan(self, text: str) -> list[tuple]:
        """(start, end, template, share saved, differing words, missing, extra) per notice, in characters of the text; notices don't overlap."""
        at = list(_WORD.finditer(text))
        words, out, end = [m.group().lower() for m in at], [], 0
        for c in self._hits(text, at):
            if c >= end and (found := self.around(text, at, words, c, end)):
                x, end, k, share, missing, extra = found
                out.append((at[x].start(), at[end - 1].end(), k, share, max(len(missing), len(extra)), " ".join(missing), " ".join(extra)))
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, line, start, end, license, form, saved, differing_words, missing, extra): one row per confirmed notice.

    Around every cue word of a text each template gives candidate blocks: its length of words, and a slack, laid so that
    a cue of the template falls on the cue. So lines don't matter: a notice may be wrapped, or lie within a paragraph, or
    several in one. A block is compressed alone and with the template as raw dictionary; templates that save
    enough are ranked by the bytes saved, and of those whose words differ little enough the one wins whose words agree
    most, less those that differ (ties by rank, then name). ``line`` and the characters [start, end)
    tell where the notice lies. Texts without a cue never leave the scan. Whole texts are read; null and empty texts, and
    an empty table, have no notice; repeated rows each give theirs. Other columns are ignored.
    """
    templates = templates or TEMPLATES
    small_batches(docs.sparkSession, 500)
    fields = "doc_id long, line long, start long, end long, license string, form string, saved double, differing_words long, missing string, extra string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.int64(), pa.string(), pa.string())
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                whole = text.as_py()
                for start, end, k, saved, differ, missing, extra in scanner.scan(whole):
                    rows.append((doc_id, whole.count("\n", 0, start), start, end, *k.partition("/")[::2], round(saved, 6), differ, missing, extra))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[f.split()[0] for f in fields.split(", ")])

    rows = docs.where(F.col("text").rlike(CUE)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, fields)
