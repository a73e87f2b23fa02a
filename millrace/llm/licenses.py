"""License scans by conditional compression.

Blocks around words that license wordings use are compressed by zstandard alone and with each template
as a raw dictionary. The share of a template's own compressed size that it saves ranks the templates;
winners are confirmed by the exact differences between their words and the best aligned words of the
block.

Defined results: null, empty and other texts without such words have no blocks; wordings may be broken
over lines and differ in case and punctuation; repeated rows each get their row; other columns are
ignored; an empty table gives no rows. Of wordings that overlap, that with the most words that agree stays.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

#: License identifiers and wordings of their notices.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-3-clause", "Released under the BSD 3-Clause License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("all-rights-reserved", "All rights reserved"),
    ("apache-2.0", "Licensed under the Apache License 2.0"),
    ("apache-2.0", "Licensed under the Apache 2.0 license"),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mit", "Distributed under the MIT license"),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("gpl-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("gpl-2.0", "GNU General Public License v2.0"),
    ("gpl-3.0", "GNU General Public License v3.0"),
    ("gpl-2.0", "GNU General Public License, version 2"),
    ("gpl-3.0", "GNU General Public License, version 3"),
    ("lgpl-2.1", "GNU Lesser General Public License, version 2.1"),
    ("lgpl-3.0", "GNU Lesser General Public License v3.0"),
    ("agpl-3.0", "GNU Affero General Public License v3.0"),
    ("mpl-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("mpl-2.0", "Mozilla Public License, version 2.0"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("epl-2.0", "Eclipse Public License - v 2.0"),
    ("bsd-2-clause", "BSD 2-Clause License"),
    ("bsd-3-clause", "BSD 3-Clause License"),
    ("bsd-2-clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("bsd-3-clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "SPDX-License-Identifier: ISC"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("wtfpl", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
]
#: Every template holds one of these words (or one that starts so).
ANCHOR = re.compile(rb"(?i)licen[sc]|copyright|rights\W+reserved|redistribut|permission|public\W+domain")
WORD = re.compile(r"[^\W_]+")
#: Words of a block before and after an anchor, for short notices and for long ones; a block longer than
#: BLOCK is taken in overlapping parts.
AROUND, BLOCK = [(12, 16), (100, 120)], 600
#: Least share of its own size that a template must save, and the share of its words that may differ.
LEAST_GAIN, TOLERANCE = 0.1, 0.1


def normal(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


@cache
def compressors(templates: tuple) -> tuple:
    """Plain compressor, and for each template its words, own size and compressor."""
    plain = zstandard.ZstdCompressor(level=9, write_content_size=False)
    out = []
    for name, wording in templates:
        words = normal(wording)
        data = " ".join(words).encode()
        given = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.append((name, words, len(plain.compress(data)), zstandard.ZstdCompressor(level=9, dict_data=given, write_content_size=False, write_dict_id=False)))
    return plain, out


def blocks(n: int, anchors: list[int], before: int, after: int) -> list[tuple[int, int]]:
    """Ranges of the n words around the anchors, merged where they touch."""
    out: list[list[int]] = []
    for a in anchors:
        lo, hi = max(0, a - before), min(n, a + after)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(at, min(at + BLOCK, hi)) for lo, hi in out for at in range(lo, max(lo + 1, hi - BLOCK // 2), BLOCK // 2)]


def align(template: list[str], words: list[str], lo: int, hi: int):
    """(start, end, missing, extra) of the words that fit the template best: around the longest common run."""
    run = SequenceMatcher(None, template, words[lo:hi], autojunk=False).find_longest_match()
    if not run.size:
        return None
    room = max(2, len(template) // 8)
    lo, hi = max(lo, lo + run.b - run.a - room), min(hi, lo + run.b - run.a + len(template) + room)
    m = SequenceMatcher(None, template, words[lo:hi], autojunk=False)
    same = [b for b in m.get_matching_blocks() if b.size]
    start, end = lo + same[0].b, lo + same[-1].b + same[-1].size
    got_t, got_w = {i for b in same for i in range(b.a, b.a + b.size)}, {i for b in same for i in range(lo + b.b, lo + b.b + b.size)}
    return start, end, [w for i, w in enumerate(template) if i not in got_t], [words[i] for i in range(start, end) if i not in got_w]


def confirmed(fit, n: int) -> bool:
    """Few words differ, and none of those that differ has a digit, as versions do."""
    return bool(fit) and len(fit[2]) + len(fit[3]) <= int(TOLERANCE * n) and not any(c.isdigit() for w in fit[2] + fit[3] for c in w)


def scan_text(text: str, templates: tuple = tuple(TEMPLATES)) -> tuple[int, list[dict]]:
    """Number of blocks, and the confirmed wordings by their place, in code points."""
    found = list(WORD.finditer(text))
    words = [m[0].lower() for m in found]
    anchors = [i for i, w in enumerate(words) if ANCHOR.match(w.encode()) or w in ("rights", "public")]
    plain, given = compressors(templates)
    parts = sorted({b for around in AROUND for b in blocks(len(words), anchors, *around)})
    fits = []
    for lo, hi in parts:
        data = " ".join(words[lo:hi]).encode()
        alone = len(plain.compress(data))
        ranked = sorted(((alone - len(c.compress(data))) / own, -k) for k, (_, _, own, c) in enumerate(given))
        for gain, k in reversed(ranked):
            if gain < LEAST_GAIN:
                break
            name, template, _, _ = given[-k]
            todo = [(lo, hi)]
            while todo:  # a confirmed span parts what is left of the block
                a, b = todo.pop()
                fit = align(template, words, a, b) if b - a >= len(template) * (1 - TOLERANCE) else None
                if confirmed(fit, len(template)):
                    missing, extra = fit[2:]
                    fits.append((2 * len(missing) + 2 * len(extra) - len(template), -gain, fit[0], fit[1], name, missing, extra))
                    todo += [(a, fit[0]), (fit[1], b)]
    kept: list[dict] = []
    taken: list[tuple[int, int]] = []
    for _, gain, a, b, name, missing, extra in sorted(fits):  # the most words that agree, then the best rank
        if all(b <= c or d <= a for c, d in taken):
            taken.append((a, b))
            kept.append({"license": name, "start": found[a].start(), "stop": found[b - 1].end(), "gain": round(-gain, 6), "missing": missing, "extra": extra})
    return len(parts), sorted(kept, key=lambda f: f["start"])


def scan(docs: DataFrame, templates=None) -> DataFrame:
    """(doc_id, n_blocks, licenses, findings) of every row of docs: licenses are the distinct confirmed
    ones, sorted; findings hold license, start and stop, the ranking gain and the words that differ."""
    wanted = tuple(templates or TEMPLATES)
    kind = docs.schema["doc_id"].dataType.simpleString()
    finding = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("gain", pa.float64()), ("missing", pa.list_(pa.string())), ("extra", pa.list_(pa.string()))]))

    def run(batches):
        for b in batches:
            counts, found = [], []
            for t in b.column(1).cast(pa.binary()):
                t = t.as_py()
                n, got = scan_text(t.decode(), wanted) if t and ANCHOR.search(t) else (0, [])
                counts.append(n)
                found.append(got)
            names = [sorted({f["license"] for f in got}) for got in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int32()), pa.array(names, pa.list_(pa.string())), pa.array(found, finding)], ["doc_id", "n_blocks", "licenses", "findings"])

    schema = f"doc_id {kind}, n_blocks int, licenses array<string>, findings array<struct<license:string,start:int,stop:int,gain:double,missing:array<string>,extra:array<string>>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
