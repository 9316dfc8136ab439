"""License notices and texts by conditional compression.

Candidate blocks are compressed with each template as a zstandard raw-content
dictionary, and templates are ranked by how much they shrink a block against its
size without a dictionary. The first of the ranking whose exact differences in
wording leave enough standing wins; no template is left out of the ranking or,
if none before it is confirmed, of the comparison. Identifiers that
begin alike are told apart so: of templates whose wording stands whole the longest
wins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import batch_columns, bounded_batches

_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, "
    "either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, "
    "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. "
    "You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
)
_GNU_SHORT = "This work is licensed under the {name}, version {version}. This program is free software: you can redistribute it under the terms of the {name} version {version}."
_CC = "Licensed under {short}. This work is licensed under a Creative Commons {long} International License ({short}). To view a copy of this license, visit https://creativecommons.org/licenses/"
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution. "
)
_BSD_CLAUSE = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Name, words that must stand, words that must stand unless half of the wording does, wording.
TEMPLATES = (
    ("MIT", "", "mit", "Released under the MIT License. This project is licensed under the MIT License; see the LICENSE file for details."),
    ("MIT", "", "mit", "The MIT License. Copyright (c). Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
     "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
     "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
     "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
     "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
     "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "2.0", "apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the "
     "License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
     "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "gnu general 2", "", _GNU_SHORT.format(name="GNU General Public License", version="2")),
    ("GPL-2.0", "gnu general 2", "", _GNU.format(name="GNU General Public License", version="2")),
    ("GPL-3.0", "gnu general 3", "", _GNU_SHORT.format(name="GNU General Public License", version="3")),
    ("GPL-3.0", "gnu general 3", "", _GNU.format(name="GNU General Public License", version="3")),
    ("LGPL-2.1", "gnu lesser 2.1", "", _GNU_SHORT.format(name="GNU Lesser General Public License", version="2.1")),
    ("LGPL-2.1", "gnu lesser 2.1", "", _GNU.format(name="GNU Lesser General Public License", version="2.1")),
    ("LGPL-3.0", "gnu lesser 3", "", _GNU_SHORT.format(name="GNU Lesser General Public License", version="3")),
    ("LGPL-3.0", "gnu lesser 3", "", _GNU.format(name="GNU Lesser General Public License", version="3")),
    ("AGPL-3.0", "gnu affero 3", "", _GNU_SHORT.format(name="GNU Affero General Public License", version="3")),
    ("AGPL-3.0", "gnu affero 3", "", _GNU.format(name="GNU Affero General Public License", version="3")),
    ("MPL-2.0", "mozilla 2.0", "", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
     "You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD", "", "bsd", "Licensed under the BSD License. Released under the BSD License. Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", "redistribution", "bsd", "BSD 2-Clause License. Copyright (c). All rights reserved. " + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", "redistribution endorse", "bsd", "BSD 3-Clause License. Copyright (c). All rights reserved. " + _BSD_HEAD + _BSD_CLAUSE + _BSD_TAIL),
    ("ISC", "", "isc", "ISC License. Released under the ISC License. Copyright (c). Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO "
     "THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
     "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
     "PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "", "zlib", "zlib License. This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of "
     "this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
     "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in "
     "the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
     "3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "boost 1.0", "", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("CC-BY-4.0", "by 4.0", "cc", _CC.format(short="CC BY 4.0", long="Attribution 4.0")),
    ("CC-BY-SA-4.0", "sa 4.0", "cc by", _CC.format(short="CC BY-SA 4.0", long="Attribution-ShareAlike 4.0")),
    ("CC-BY-NC-4.0", "nc 4.0", "cc by", _CC.format(short="CC BY-NC 4.0", long="Attribution-NonCommercial 4.0")),
    ("CC-BY-ND-4.0", "nd 4.0", "cc by", _CC.format(short="CC BY-ND 4.0", long="Attribution-NoDerivatives 4.0")),
    ("CC-BY-4.0", "attribution 4.0", "creative commons", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "attribution sharealike 4.0", "creative commons", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "attribution noncommercial 4.0", "creative commons", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "cc0 1.0", "", "Released under CC0 1.0. To the extent possible under law, the person who associated CC0 1.0 with this work has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "", "unencumbered", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
     "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software "
     "dedicate any and all copyright interest in the software to the public domain."),
    ("Proprietary", "rights reserved", "", "Copyright. All rights reserved. No part of this work may be reproduced without written permission."),
    *((f"EPL-{v}", f"eclipse {v}", "", wording.format(v=v)) for v in ("1.0", "2.0") for wording in (
        "Licensed under the Eclipse Public License, Version {v}.", "Eclipse Public License {v}.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License {v} which is available at https://www.eclipse.org/legal/")),
    *((f"EUPL-{v}", f"eupl {v}", "", wording.format(v=v)) for v in ("1.1", "1.2") for wording in (
        "Licensed under the EUPL, Version {v}.", "EUPL, Version {v}.",
        "Licensed under the EUPL, Version {v} or as soon they will be approved by the European Commission subsequent versions of the EUPL (the \"Licence\"); You may not use this work except in compliance "
        "with the Licence. You may obtain a copy of the Licence at: https://joinup.ec.europa.eu/software/page/eupl Unless required by applicable law or agreed to in writing, software distributed under the "
        "Licence is distributed on an \"AS IS\" basis, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the Licence for the specific language governing permissions and limitations under the Licence.")),
)
#: Identifiers that stand after "SPDX-License-Identifier:".
SPDX = (
    "MIT MIT-0 Apache-2.0 BSD-2-Clause BSD-3-Clause ISC Zlib MPL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 BSL-1.0 Unlicense CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 "
    "GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later"
).split()
#: A sentence with one of these is a candidate.
CUE_WORDS = frozenset("license licence licenses licences licensed licenced licensing copyright copyrighted redistribute redistribution redistributions spdx cc0".split())
CUE_PAIRS = frozenset({("rights", "reserved"), ("public", "domain"), ("creative", "commons"), ("cc", "by")})
#: A sentence is a candidate too if this share of its three-word runs stands in a template; up to BRIDGE words between candidates join them.
RUN_SHARE, BRIDGE = 0.5, 3
#: Least share of a block's words that a template holds in order, or of the template's that the block holds; level of compression.
LEAST_SHARE, LEAST_COVERAGE, LEVEL = 0.75, 0.9, 9
#: Blocks up to this many characters are remembered, since they repeat.
REMEMBERED = 4096

_SENTENCE = re.compile(r"[^\n]+?(?:[.!?](?=\s)|(?=\n)|\Z)")
_WORDS = re.compile(r"[^\W_]+(?:\.\d+)*")
_V = re.compile(r"\bv(?=\d)")


def words_of(text: str) -> list[str]:
    """Words in lower case; a "v" right before a number is none."""
    return _WORDS.findall(_V.sub("", text.lower()))


def _runs(words: list[str]) -> Iterator[tuple[str, str, str]]:
    return zip(words, words[1:], words[2:])


TEMPLATES += tuple((name, f"spdx identifier {' '.join(words_of(name))}", "", f"SPDX-License-Identifier: {name}") for name in SPDX)

_TEMPLATE_RUNS = frozenset(run for *_, wording in TEMPLATES for run in _runs(words_of(wording)))


def _cued(words: list[str]) -> bool:
    return not CUE_WORDS.isdisjoint(words) or not CUE_PAIRS.isdisjoint(zip(words, words[1:]))


def is_candidate(words: list[str]) -> bool:
    """Whether a sentence holds a licensing word or mostly runs of words that a template holds."""
    return _cued(words) or len(words) > 2 and sum(map(_TEMPLATE_RUNS.__contains__, _runs(words))) >= RUN_SHARE * (len(words) - 2)


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of maximal runs of candidates among sentences and lines, joined over a few words between them; end exclusive, in code points."""
    words = words_of(text)
    if not _cued(words) and _TEMPLATE_RUNS.isdisjoint(_runs(words)):
        return
    run: tuple[int, int] | None = None
    between = 0
    for m in _SENTENCE.finditer(text):
        start, end = m.span()
        start += len(m[0]) - len(m[0].lstrip())
        words = words_of(m[0])
        if not words:
            continue
        if is_candidate(words):
            run, between = (run[0] if run else start, end), 0
        elif run:
            between += len(words)
            if between > BRIDGE:
                yield run
                run = None
    if run:
        yield run


class Wording:
    """The words of a template as a bit mask for each, for longest common subsequences in time linear in the block."""

    def __init__(self, words: list[str]):
        self.words, self.counts, self.places = words, Counter(words), {}
        for i, w in enumerate(words):
            self.places[w] = self.places.get(w, 0) | 1 << i

    def bound(self, counts: Counter[str]) -> int:
        """At most so many words are common."""
        return (self.counts & counts).total()

    def steps(self, found: list[str]) -> Iterator[int]:
        """After each word of the block: a clear bit i if the common subsequence grows at the template's word i."""
        v = (1 << len(self.words)) - 1
        full = v
        for w in found:
            u = v & self.places.get(w, 0)
            v = ((v + u) | (v - u)) & full
            yield v

    def common(self, found: list[str]) -> int:
        v = (1 << len(self.words)) - 1
        for v in self.steps(found):  # noqa: B007
            pass
        return len(self.words) - v.bit_count()

    def differences(self, found: list[str]) -> tuple[list[str], list[str]]:
        """(words that the block adds, words of the template that it leaves out)."""
        rows = [(1 << len(self.words)) - 1, *self.steps(found)]
        length = lambda i, j: i - (rows[j] & ((1 << i) - 1)).bit_count()
        i, j, added, gone = len(self.words), len(found), [], []
        while i or j:
            if i and length(i - 1, j) == length(i, j):
                i -= 1
                gone.append(self.words[i])
            elif j and length(i, j - 1) == length(i, j):
                j -= 1
                added.append(found[j])
            else:
                i, j = i - 1, j - 1
        return added[::-1], gone[::-1]


class Matcher:
    """One for each Python worker; blocks repeat, so the last ones are remembered."""

    def __init__(self, templates: Sequence[tuple[str, str, str, str]] = TEMPLATES):
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.templates = []
        for name, always, named, wording in templates:
            dictionary = zstandard.ZstdCompressionDict(wording.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary)
            self.templates.append((name, set(always.split()), set(named.split()), Wording(words_of(wording)), compressor))
        self._remembered = lru_cache(1 << 12)(self._match)

    def match(self, block: str) -> tuple[str, float, float, float, str, str, bool]:
        """(license, size reduction, share of the block's words, of the template's, words added, words left out, confirmed) of the winner.

        Without a confirmed template, that of the greatest reduction. Equal reductions rank in the order of the templates.
        """
        return self._remembered(block) if len(block) <= REMEMBERED else self._match(block)

    def _match(self, block: str) -> tuple[str, float, float, float, str, str, bool]:
        raw = block.encode()
        alone = len(self.plain.compress(raw))
        ranked = sorted(((1 - len(c.compress(raw)) / alone, i) for i, (*_, c) in enumerate(self.templates)), key=lambda x: (-x[0], x[1]))
        found = words_of(block)
        counts = Counter(found)

        def holds(same: int, always: set[str], named: set[str], wording: Wording) -> bool:
            if not always <= counts.keys() or not (named <= counts.keys() or 2 * same >= len(wording.words)):
                return False
            return same >= LEAST_SHARE * len(found) or same >= LEAST_COVERAGE * len(wording.words)

        won = None
        for reduction, i in ranked:
            _, always, named, wording, _ = self.templates[i]
            # what fails with the most words that can be common fails with those that are
            if not holds(wording.bound(counts), always, named, wording):
                continue
            same = wording.common(found)
            if not holds(same, always, named, wording):
                continue
            whole = same if same == len(wording.words) else 0
            if won is None or whole > won[2]:
                won = reduction, i, whole
            if not whole:
                break
        reduction, i = won[:2] if won else ranked[0]
        name, _, _, wording, _ = self.templates[i]
        added, gone = wording.differences(found)
        same = len(found) - len(added)
        return name, reduction, same / max(1, len(found)), same / len(wording.words), " ".join(added), " ".join(gone), won is not None


_MATCHERS: list[Matcher] = []


def license_notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, license, reduction, share, coverage, added, left_out, confirmed): one row per candidate block.

    Spans are code points of the whole text. Texts that are null, empty or without
    a candidate give no rows; repeated rows give theirs again; blocks that no
    template explains come with confirmed false and the nearest template.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _MATCHERS:
            _MATCHERS.append(Matcher())
        match = _MATCHERS[0].match
        for batch in batches:
            rows = [
                dict(zip(_SCHEMA.names, (doc_id, a, b, *match(text[a:b])), strict=True))
                for doc_id, text in zip(*batch_columns(batch, "doc_id", "text"), strict=True)
                for a, b in blocks(text)
            ]
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    ready = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return ready.where(F.length("text") > 0).mapInArrow(
        run, "doc_id long, start long, end long, license string, reduction double, share double, coverage double, added string, left_out string, confirmed boolean"
    )


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("reduction", pa.float64()), ("share", pa.float64()), ("coverage", pa.float64()), ("added", pa.string()), ("left_out", pa.string()), ("confirmed", pa.bool_())])
