"""License scans: names, versions, negation, identifiers and licence files; scores and inheritance by brute force."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandframe.llm import licenses as L

PLAIN = L.Scanner({}, 3.0)


@pytest.mark.parametrize("text, name", [
    ("Released under the WTFPL License.", "WTFPL"),
    ("Licensed under the EUPL License.", None),
    ("Released under the Frobnicate License.", None),
    ("This is not licensed under the MIT License.", None),
    ("This file isn't released under the MIT License.", None),
    ("It was never available under Apache 2.0.", None),
    ("Not a secret: licensed under the MIT License.", "MIT"),
    ("// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later"),
    ("SPDX-License-Identifier: Zlib", "Zlib"),
    ("# SPDX-License-Identifier: (mit OR apache-2.0)", "MIT OR Apache-2.0"),
    ("Released under CC BY 4.0.", "CC-BY-4.0"),
    ("Available under Apache 2.0", "Apache-2.0"),
    ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
    ("Licensed under the Apache License, Version 1.1.", None),
    ("A license is a topic, not a notice.", None),
])
def test_notices(text, name):
    assert PLAIN.scan(f"some code\n{text}\nmore code")[0] == name


@pytest.mark.parametrize("what, version, name", [("", "2", "GPL-2.0"), ("", "3", "GPL-3.0"), ("Lesser ", "2.1", "LGPL-2.1"), ("Lesser ", "3", "LGPL-3.0"), ("Affero ", "3", "AGPL-3.0")])
def test_headers_in_wrapped_lines(what, version, name):
    text = f"""/*  This program is free software; you can redistribute it and/or modify
 *  it under the terms of the GNU {what}General Public License as published by
 *  the Free Software Foundation; either version {version} of the License, or
 *  (at your option) any later version.
 *
 *  This program is distributed in the hope that it will be useful,
 *  but WITHOUT ANY WARRANTY; without even the implied warranty of
 *  MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 *  GNU {what}General Public License for more details.
 */
int main() {{ return 0; }}
""" + "code code\n" * 300
    got = PLAIN.scan(text)
    assert got[0] == name and got[1] > 0.9 and not got[2]


def test_every_template_is_found_and_covers_its_file():
    for t in L.TEMPLATES:
        assert PLAIN.scan(t.text)[::2] == (t.name, True), t
        got = PLAIN.scan("first line\n" + t.text + "\nlast line\n" + "other words\n" * 400)
        assert got[0] == t.name and got[2] == t.head, t


def test_full_texts_with_a_title_cover():
    mit = next(t.text for t in L.TEMPLATES if t.name == "MIT" and "conditions" in t.text)
    assert PLAIN.scan("MIT License\n\nCopyright (c) 2020 Some Body\n\n" + mit)[::2] == ("MIT", True)
    gpl = next(t.text for t in L.TEMPLATES if t.name == "GPL-3.0" and t.head)
    assert PLAIN.scan("  " + gpl + " the rest of it" * 1500)[::2] == ("GPL-3.0", True)
    assert PLAIN.scan("word " * 200 + "\n" + gpl + " the rest of it" * 1500)[::2] == ("GPL-3.0", False)


def brute_cosine(words, template, idf, unknown):
    a, b = Counter(words), Counter(L.terms(template))
    w = lambda c, x: (1 + math.log(c[x])) * idf.get(x, unknown) if c[x] else 0.0
    dot = sum(w(a, x) * w(b, x) for x in set(a) | set(b))
    return dot / math.sqrt(sum(w(a, x) ** 2 for x in a) * sum(w(b, x) ** 2 for x in b)) if a and b else 0.0


def test_query_against_brute_force(spark):
    """op8 over a whole table: every window of every template, and the nearest directory by walking up."""
    from strandframe.llm import queries

    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, f"{r.source or '-'}/{r.lang or '-'}/{r.doc_id}.txt", r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    size = len(docs) + len(L.TEMPLATES)
    n = Counter(w for _, _, t in docs for w in set(L.terms(t))) + Counter(w for t in L.TEMPLATES for w in set(L.terms(t.text)))
    idf = {w: math.log(1 + size / n[w]) for t in L.TEMPLATES for w in L.terms(t.text)}
    own = {}
    for d, path, text in docs:
        low, best = text.lower(), (0.0, 0, None)
        if m := re.search(r"spdx-license-identifier: *(\S+)", low):
            own[d] = (1.0, next((t.name for t in L.TEMPLATES if t.name.lower() == m[1].rstrip(".")), None), len(L.terms(text)))
            assert own[d][1]
            continue
        lines = low.split("\n")
        for i, line in enumerate(lines):
            if not any(c in line for c in L.CUES):
                continue
            words = L.terms(" \n".join(lines[i:]))
            for start in range(len(L.terms(line)) + 1):
                for t in L.TEMPLATES:
                    window = words[start : start + len(L.terms(t.text))]
                    if set(t.needs) <= set(window) and not t.bars & set(window):
                        best = max(best, (round(brute_cosine(window, t.text, idf, math.log(1 + size)), 6), len(L.terms(t.text)), t.name), key=lambda x: x[:2])
        own[d] = (best[0], best[2] if best[0] >= L.THRESHOLD else None, best[1] if best[0] >= L.THRESHOLD else 0)
    files = {d: (path, text) for d, path, text in docs}
    giving = {}
    for d, (score, name, width) in own.items():
        path, text = files[d]
        if name and width >= L.FILE_SHARE * len(L.terms(text)):
            at = path.rsplit("/", 1)[0]
            giving[at] = min(giving.get(at, (0, "", "")), (-score, name, path))
    got = {r.doc_id: r for r in queries.op8_licenses(spark, sf).collect()}
    assert len(got) == len(docs) and sum(1 for x in own.values() if x[1]) > 20
    for d, (path, _) in files.items():
        at, up = path, None
        while "/" in at and up is None:
            at = at.rsplit("/", 1)[0]
            up = giving.get(at)
        want = (own[d][1], "own", None) if own[d][1] else (up[1], "inherited", at) if up else (None, "none", None)
        assert (got[d].license, got[d].origin, got[d].from_dir) == want
        assert not own[d][1] or got[d].score == pytest.approx(own[d][0], abs=1e-4)


def test_awkward_files(spark):
    """Null and equal paths, repeated rows, very long texts, clashing names, deep and odd directories."""
    mit = "Licensed under the MIT License."
    rows = [("a/LICENSE", mit), ("a/LICENSE", mit), ("a//b/c.py", None), (None, mit), (None, None), ("a/x.py", "word " * 300_000), ("/".join("d" * 60) + "/f.py", ""), ("z/y.py", ""), ("a/x.py", "word " * 300_000)]
    files = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "id long, path string, text string")
    for c in ("own", "score", "covers", "dir", "near"):
        files = files.withColumn(c, F.lit("x"))
    got = {r.id: (r.license, r.origin, r.from_dir) for r in L.scan_licenses(files, keys=("id",)).collect()}
    # The file at the root, whose path is null, is all notice, so it licenses whatever lies below.
    assert got == {0: ("MIT", "own", None), 1: ("MIT", "own", None), 2: ("MIT", "inherited", "a"), 3: ("MIT", "own", None), 4: ("MIT", "inherited", ""), 5: ("MIT", "inherited", "a"), 6: ("MIT", "inherited", ""), 7: ("MIT", "inherited", ""), 8: ("MIT", "inherited", "a")}
