import random

import pytest

from millrace.llm import licenses


def brute(text):
    """Licenses whose wording stands in the text word for word, longest wordings first."""
    words, used, out = licenses.normal(text or ""), set(), set()
    for name, wording in sorted(licenses.TEMPLATES, key=lambda t: -len(licenses.normal(t[1]))):
        w = licenses.normal(wording)
        for i in range(len(words) - len(w) + 1):
            if words[i : i + len(w)] == w and not used & set(range(i, i + len(w))):
                used |= set(range(i, i + len(w)))
                out.add(name)
    return sorted(out)


def sample():
    rnd = random.Random(6)
    filler = lambda n: " ".join(rnd.choice("lorem ipsum dolor sit amet license public rights copyright the of".split()) for _ in range(n))
    rows = []
    for name, wording in licenses.TEMPLATES:
        for n in (0, 7, 400):
            rows.append(f"{filler(n)}. {wording.upper() if n == 7 else wording.replace(' ', chr(10)) if n else wording}! {filler(n)}")
    two = rnd.sample(range(len(licenses.TEMPLATES)), 2)
    rows += [". ".join(licenses.TEMPLATES[i][1] for i in two), " ".join(w for _, w in licenses.TEMPLATES), None, "", "clean text", filler(2000), "é " * 30_000 + "Released under the MIT License"]
    return list(enumerate(rows))


def test_against_brute_force(spark):
    rows = [*sample(), (3, "all rights reserved"), (3, "all rights reserved"), (None, "ALL  RIGHTS\nreserved.")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, findings string")
    got = licenses.scan(docs).collect()
    assert sorted([(r.doc_id, r.licenses) for r in got], key=str) == sorted([(i, brute(t)) for i, t in rows], key=str)
    texts = dict(rows)
    for r in got:
        for f in r.findings:
            if r.doc_id not in (3, None):
                assert not f.missing and not f.extra
                assert any(licenses.normal(texts[r.doc_id][f.start : f.stop]) == licenses.normal(w) for n, w in licenses.TEMPLATES if n == f.license)


@pytest.mark.parametrize(
    ("change", "want"),
    [(lambda w: w.replace("merge, ", ""), ["mit"]), (lambda w: w.replace("copyright notice", "notice of copyright"), ["mit"]), (lambda w: w[: len(w) // 2], []), (lambda w: " ".join(w.split()[::-1]), [])],
)
def test_differences(change, want):
    wording = next(w for n, w in licenses.TEMPLATES if n == "mit" and len(w) > 100)
    _, found = licenses.scan_text(f"intro {change(wording)} outro")
    assert [f["license"] for f in found] == want
    assert all(f["missing"] or f["extra"] for f in found)


def test_versions_are_not_confused():
    found = lambda t: [f["license"] for f in licenses.scan_text(t)[1]]
    assert found("This work is licensed under the GNU General Public License, version 1.") == []
    assert found("This work is licensed under the GNU General Public License, version 2.") == ["gpl-2.0"]
    assert found("Licensed under CC BY 3.0.") == []


HELD_OUT = [
    ("Licensed under the Apache License, version 2.0.", "apache-2.0"), ("code is licensed under the APACHE license 2.0, see LICENSE", "apache-2.0"), ("// SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
    ("# spdx-license-identifier: mit", "mit"), ("This project is released under the MIT license.", "mit"), ("It is distributed under the\nMIT License; enjoy", "mit"), ("Licensed under the MIT license - see the file", "mit"),
    ("under the terms of the GNU General Public License v3.0 only", "gpl-3.0"), ("GNU General Public License v2.0", "gpl-2.0"), ("see the GNU General Public License, version 2, for details", "gpl-2.0"), ("* SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3.0"),
    ("the GNU Lesser General Public License v3.0 applies", "lgpl-3.0"), ("GNU Affero General Public License v3.0", "agpl-3.0"), ("subject to the Mozilla Public License, Version 2.0", "mpl-2.0"), ("the Eclipse Public License - v 2.0", "epl-2.0"),
    ("released under a BSD 2-Clause License", "bsd-2-clause"), ("the BSD 3-Clause License", "bsd-3-clause"), ("/* SPDX-License-Identifier: BSD-3-Clause */", "bsd-3-clause"), ("Distributed under the Boost Software License, Version 1.0", "bsl-1.0"),
    ("This text is licensed under CC BY-SA 4.0", "cc-by-sa-4.0"), ("licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0"), ("© 2020 someone. All rights reserved.", "all-rights-reserved"), ("use of this source is governed by a BSD-style license", "bsd"),
]


def test_recall_on_wordings_held_out():
    found = [name in {f["license"] for f in licenses.scan_text(text)[1]} for text, name in HELD_OUT]
    assert sum(found) / len(found) >= 0.9


def test_empty(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
