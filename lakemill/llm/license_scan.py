"""License scans by conditional compression.

A candidate block is a sentence over its lines, or a line, of FEWEST words or more of which the share WORDED
stands in one template: any other can't be confirmed. It is compressed alone and with every template as a
raw zstandard dictionary. Templates are ranked by the share of the size that they save; all that save
enough are confirmed by the exact differences of wording, which also tell versions apart. Adjoining blocks
of one license are one finding, those with few words of their own among them.

Candidates are found for a whole chunk of texts at once, by the places of words and of the ends of lines and
sentences; only texts that hold one are cut into blocks.

Defined results: null and empty texts and those without a candidate have no findings; ties between
templates go to the fewer differing words, then to the name. Repeated rows have equal findings, and
columns other than doc_id and text aren't read. The whole text is read, however long.
"""

from __future__ import annotations

import functools
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame

from lakemill.llm import kernel
from lakemill.llm.chars import ragged
from lakemill.llm.frames import by_chunk

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"

TEMPLATES = {
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License. SPDX-License-Identifier: Apache-2.0""",
    "mit": """Released under the MIT License. Licensed under the MIT License. This project is licensed under the terms of the MIT license. SPDX-License-Identifier: MIT
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Licensed under the ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. SPDX-License-Identifier: ISC
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause": """Licensed under the BSD 2-Clause License. """ + _BSD.format("") + """ SPDX-License-Identifier: BSD-2-Clause""",
    "bsd-3-clause": """Licensed under the BSD 3-Clause License. """ + _BSD.format(_BSD_NAMES) + """ SPDX-License-Identifier: BSD-3-Clause""",
    "gpl-2.0": """This work is licensed under the GNU General Public License, version 2. Licensed under the GPL version 2. This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. SPDX-License-Identifier: GPL-2.0""",
    "gpl-3.0": """This work is licensed under the GNU General Public License, version 3. Licensed under the GPL version 3. This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. SPDX-License-Identifier: GPL-3.0
You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
    "lgpl-3.0": """This work is licensed under the GNU Lesser General Public License, version 3. This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. SPDX-License-Identifier: LGPL-3.0""",
    "agpl-3.0": """This work is licensed under the GNU Affero General Public License, version 3. This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. SPDX-License-Identifier: AGPL-3.0""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. Licensed under the Mozilla Public License, version 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/. SPDX-License-Identifier: MPL-2.0""",
    "cc-by-4.0": """Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/""",
    "cc-by-sa-4.0": """Licensed under CC BY-SA 4.0. This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/""",
    "cc-by-nc-4.0": """Licensed under CC BY-NC 4.0. This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/""",
    "cc-by-nd-4.0": """Licensed under CC BY-ND 4.0. This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nd/4.0/""",
    "cc0-1.0": """Licensed under CC0 1.0. To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal public domain dedication.""",
    "unlicense": """Released under the Unlicense. This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.
We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to https://unlicense.org""",
    "proprietary": """All rights reserved. Copyright. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher. Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.""",
}
#: The share of its size and the bytes that a template has to save, the share of its words that have to stand in the template,
#: in order, the differing words that a word of the block may cost at most, and the words of a block that begins a finding.
SAVED, SAVED_BYTES, WORDED, DIFFERING, FEWEST = 0.35, 10, 0.8, 0.5, 3
_BLOCK = regex.compile(r"\S(?:[^\n]*?(?<=[.!?])(?=\s)|[^\n]*)")
# an end that leaves a sentence open, what may stand between its lines, and between the blocks of a finding
_OPEN = regex.compile(r"[^.!?:]\s*$")
_WRAP = regex.compile(r"[ \t\r]*\n[ \t]*")
_MARK = regex.compile(r"(?:\s|[*#/\-•]|\(?[0-9a-z][.)])*")
_RUN = regex.compile(kernel.WORD_SQL)
_WORD = regex.compile(r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*")


def _coder(dictionary: bytes | None) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(19, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0)
    extra = {"dict_data": zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if dictionary else {}
    return zstandard.ZstdCompressor(compression_params=params, **extra)


@functools.cache
def _coders() -> tuple[zstandard.ZstdCompressor, dict[str, zstandard.ZstdCompressor]]:
    return _coder(None), {k: _coder(v.lower().encode()) for k, v in TEMPLATES.items()}


@functools.cache
def _template_words(name: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(TEMPLATES[name])]


@functools.cache
def _vocabulary() -> tuple[dict[str, int], int]:
    """For every word of the templates a number with a 1 in the field of each template that has it, and the most words of a template."""
    out: dict[str, int] = {}
    for i, text in enumerate(TEMPLATES.values()):
        for w in {w.lower() for w in _RUN.findall(text)}:
            out[w] = out.get(w, 0) | 1 << 32 * i
    return out, max(len(_template_words(k)) for k in TEMPLATES)


def likely(block: str) -> bool:
    """Whether the block is a candidate."""
    vocabulary, _ = _vocabulary()
    words = _RUN.findall(block.lower())
    if len(words) < FEWEST:
        return False
    total = sum(vocabulary.get(w, 0) for w in words)
    return any((total >> 32 * i & 0xFFFFFFFF) >= WORDED * len(words) for i in range(len(TEMPLATES)))


@functools.cache
def _masks() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the templates' words in order, and the templates that have each as bits."""
    vocabulary, _ = _vocabulary()
    hashes = kernel.words(pa.array(list(vocabulary))).hashes
    bits = np.array([sum((x >> 32 * i & 1) << i for i in range(len(TEMPLATES))) for x in vocabulary.values()], np.int64)
    order = np.argsort(hashes)
    return hashes[order], bits[order]


def candidates(texts: pa.Array) -> np.ndarray:
    """Which texts hold a candidate block."""
    w = kernel.words(texts)
    n = len(w.hashes)
    out = np.zeros(len(texts), bool)
    if not n:
        return out
    hashes, bits = _masks()
    at = np.minimum(np.searchsorted(hashes, w.hashes), len(hashes) - 1)
    mask = np.where(hashes[at] == w.hashes, bits[at], 0)
    # ends of parts and of sentences after every byte
    data = w.data
    space, line, point = _KINDS[data] == 1, data == 10, _KINDS[data] == 2
    place = np.arange(len(data))
    stop = point.copy()
    stop[:-1] &= space[1:]
    full, last_line = (np.maximum.accumulate(np.where(x, place, -1)) for x in (~space, line))
    before = np.concatenate([[-1], full[:-1]])  # the last character before this one
    blank = np.concatenate([[-1], last_line[:-1]]) > before
    closed = line & (blank | (before < 0) | (_KINDS[data[before]] == 2) | (data[before] == 58))
    doc = np.zeros(len(data) + 1, np.int64)
    np.add.at(doc, w.docs[1:-1], 1)
    word_doc = np.repeat(np.arange(len(texts)), np.diff(w.first))
    for ends in (line | stop, stop | closed):
        part = np.concatenate([[0], np.cumsum(ends)])[w.start] + np.cumsum(doc)[w.start]
        begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        size = np.diff(np.append(begin, n))
        some = np.flatnonzero((size >= FEWEST) & (np.add.reduceat(mask != 0, begin, dtype=np.int64) >= WORDED * size))
        if len(some):
            own, first = mask[ragged(begin[some], size[some])], np.cumsum(size[some]) - size[some]
            most = np.max([np.add.reduceat(own >> i & 1, first) for i in range(len(TEMPLATES))], axis=0)
            out[word_doc[begin[some[most >= WORDED * size[some]]]]] = True
    return out


_KINDS = np.zeros(256, np.uint8)
_KINDS[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = 1
_KINDS[[ord(c) for c in ".!?"]] = 2


@functools.lru_cache(maxsize=50_000)
def _size(block: str) -> int:
    return len(_coders()[0].compress(block.lower().encode()))


@functools.lru_cache(maxsize=50_000)
def matches(block: str) -> tuple[tuple[int, float, str], ...]:
    """(differing words, minus the share of the size saved, license) of the confirmed templates of one block, the best first."""
    words = [w.lower() for w in _WORD.findall(block)]
    if not words or WORDED * len(words) > _vocabulary()[1]:
        return ()  # more words than any template could match
    raw, size = block.lower().encode(), _size(block)
    ranked = sorted(((size - len(c.compress(raw))) / size, k) for k, c in _coders()[1].items())[::-1]
    found = []
    for saved, name in ranked:
        if saved < SAVED:
            break
        matcher = SequenceMatcher(None, _template_words(name), words, autojunk=False)
        same = [m for m in matcher.get_matching_blocks() if m.size]
        matched = sum(m.size for m in same)
        if matched >= WORDED * len(words):
            inside = same[-1].a + same[-1].size - same[0].a - matched  # template words passed over between matches
            differ = len(words) - matched + inside
            if differ <= DIFFERING * len(words):
                found.append((differ, -saved, name))
    return tuple(sorted(found))


def best(block: str) -> tuple[str, float, int] | None:
    """(license, share of the size saved, differing words) of the confirmed winner for one block."""
    found = matches(block)
    return (found[0][2], -found[0][1], found[0][0]) if found else None


def _sentences(text: str) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """First character, character after the last, and lines or parts of lines, of every sentence; a blank line ends one, a line's end doesn't."""
    out: list[tuple[int, int, list[tuple[int, int]]]] = []
    for m in _BLOCK.finditer(text):
        if out and _OPEN.search(text, max(out[-1][0], out[-1][1] - 8), out[-1][1]) and _WRAP.fullmatch(text, out[-1][1], m.start()):
            out[-1][2].append(m.span())
            out[-1] = (out[-1][0], m.end(), out[-1][2])
        else:
            out.append((*m.span(), [m.span()]))
    return out


def _trimmed(text: str, lines: list[tuple[int, int]]) -> tuple[int, int]:
    """The first line and that after the last of a confirmed sentence without the lines at its ends that add no word of the template."""
    i, j = 0, len(lines)
    differ, _, name = matches(text[lines[0][0] : lines[-1][1]])[0]
    while j - i > 1:
        for k, m, edge in ((i + 1, j, i), (i, j - 1, j - 1)):
            less = next((d for d, _, x in matches(text[lines[k][0] : lines[m - 1][1]]) if x == name), None)
            if less is not None and less == differ - len(_WORD.findall(text[slice(*lines[edge])])):
                i, j, differ = k, m, less
                break
        else:
            break
    return i, j


def findings(text: str) -> list[tuple[int, int, str, float, int]]:
    """(first character, character after the last, license, saved, differing words) of every finding.

    A wrapped sentence counts whole where a template confirms it, else by its lines. From candidates that save enough bytes,
    findings grow over adjoining blocks that a template confirms. Adjoining blocks go together while a license is among the
    best of each of them; which of several it is, the whole decides.
    """
    blocks: list[tuple[int, int]] = []
    for a, b, lines in _sentences(text):
        if len(lines) == 1:
            blocks.append((a, b))
        elif likely(text[a:b]) and matches(text[a:b]):
            i, j = _trimmed(text, lines)
            blocks += [*lines[:i], (lines[i][0], lines[j - 1][1]), *lines[j:]]
        else:
            blocks += lines
    hits: dict[int, tuple] = {i: found for i, (a, b) in enumerate(blocks) if likely(text[a:b]) and (found := matches(text[a:b])) and max(-x[1] for x in found) * _size(text[a:b]) >= SAVED_BYTES}
    for step in (1, -1):
        for i in sorted(hits, reverse=step < 0):
            j = i + step
            while 0 <= j < len(blocks) and j not in hits:
                a, b = blocks[j]
                if _MARK.fullmatch(text[a:b]):
                    j += step
                    continue
                same = {name for _, _, name in hits[i]}
                found = tuple(x for x in matches(text[a:b]) if x[2] in same)
                if not found:
                    break
                hits[j] = found
                i, j = j, j + step
    groups: list[tuple[int, int, set[str], list[tuple]]] = []
    for i in sorted(hits):
        (a, b), found = blocks[i], hits[i]
        names = {name for differ, _, name in found if differ == found[0][0]}
        if groups and names & groups[-1][2] and _MARK.fullmatch(text[groups[-1][1] : a]):
            groups[-1] = (groups[-1][0], b, names & groups[-1][2], [*groups[-1][3], found])
        else:
            groups.append((a, b, names, [found]))
    out = []
    for a, b, names, each in groups:
        name = next((x for _, _, x in matches(text[a:b]) if x in names), None) if len(each) > 1 and len(names) > 1 else None
        name = name or next(x for _, _, x in each[0] if x in names)
        own = [next(x for x in found if x[2] == name) for found in each]
        out.append((a, b, name, max(-saved for _, saved, _ in own), sum(differ for differ, _, _ in own)))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, first_char, end_char, license, saved, differing_words) of every finding; no shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        hit = batch.filter(pa.array(candidates(batch.column("text"))))
        rows = [(d, *f) for d, t in zip(hit.column("doc_id").to_pylist(), hit.column("text").to_pylist(), strict=True) for f in findings(t)]
        if not rows:
            return None
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "first_char", "end_char", "license", "saved", "differing_words"])

    return by_chunk(docs.select("doc_id", "text"), run, "doc_id bigint, first_char bigint, end_char bigint, license string, saved double, differing_words int")
