"""License scans: TF-IDF cosine to templates, then inheritance from the nearest directory.

Templates are notices, headers and licence texts. Every line of a text that holds a cue word
opens windows, as many words long as each template; the window's sparse TF-IDF vector is
compared with the template's by cosine, and the best one from THRESHOLD on is the file's own
licence. A template counts only where the words that tell its licence from others (name and
version) are in the window and none that speak against it (`lesser` for the GPL), so an
unknown name is no licence; nor is a notice whose name is negated ("not licensed under the MIT
License"). An SPDX line is taken by its identifier, listed or not.

Inverse document frequencies of the templates' terms are counted over all files. A file
named like a licence file, one that the matching window covers for the most part, or one that
opens with the beginning of a long licence text, licenses its directory. Files without a
licence of their own inherit from the nearest ancestor directory that has one, by a join of
directories with their ancestors.

A null or empty text has no licence of its own; a null path is the root's file "".
Ties between templates go to the longer template and then the smaller name, between
licence files of a directory to the higher score, then the smaller name and path.
Repeated rows each get a row; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

THRESHOLD = 0.75
#: Share of a file's words that a window must cover to make it a licence file.
FILE_SHARE = 0.6
#: Words before the window of a long licence's beginning, at most, in a file that is that licence.
TITLE_WORDS = 30
#: Windows open at a cue line's start and at up to this many words before each cue.
LEAD = 12
CUES = (
    "licen", "copyright", "spdx", "permission", "public domain", "redistribution", "warranty", "gpl", "apache", "mozilla", "mpl", "cc by", "cc-by", "cc0", "creative commons", "wtfpl", "free software", "unencumbered",
)
_CUE = re.compile("|".join(CUES))
_WORD = re.compile(r"[a-z0-9]+(?:[.-][0-9a-z]+)*")
_FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|unlicense|notice)([.-][^/]*)?$"
_SPDX = re.compile(r"spdx-license-identifier:[ \t]*(\([^)\n]*\)|[a-z0-9][a-z0-9.+-]*(?:[ \t]+(?:or|and|with)[ \t]+[a-z0-9][a-z0-9.+-]*)*)", re.I)
#: A licence that is named and denied.
_DENIED = re.compile(r"\b(?:not|never|no longer|isn t|aren t|wasn t|weren t|nor|neither)(?: (?:be|been|being|currently|yet|ever|otherwise|itself|to be))? (?:licensed|released|available|distributed|covered|offered|published|governed|subject|provided|made|under)\b(?: [^ ]+){0,6}$")


class Template(NamedTuple):
    """name; text; words of which one of each group must be in the window, and none of `bars`; whether it is the beginning of a longer text."""

    name: str
    text: str
    needs: tuple[str, ...]
    bars: frozenset[str] = frozenset()
    head: bool = False


def _t(name: str, needs: str, text: str, bars: str = "", head: bool = False) -> Template:
    return Template(name, text, tuple(needs.split()), frozenset(bars.split()), head)


_GPL = "lesser library affero lgpl agpl"
_CC = "sharealike noncommercial noderivatives noderivs by-sa by-nc by-nd by-nc-sa by-nc-nd"
_ASIS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU_NOTICE = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version. This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details."
_GNU_HEAD = "GNU {0}GENERAL PUBLIC LICENSE Version {1} Copyright (C) {2} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."

#: Fixed texts of public licences: their usual notices, headers, texts, and of the longest texts the beginning.
TEMPLATES: tuple[Template, ...] = (
    _t("MIT", "mit", "Released under the MIT License."),
    _t("MIT", "mit", "Licensed under the MIT License."),
    _t("MIT", "permission granted charge sublicense", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    _t("MIT", "permission granted charge sublicense warranty", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _ASIS),
    _t("Apache-2.0", "apache 2.0", "Licensed under the Apache License, Version 2.0."),
    _t("Apache-2.0", "apache 2.0", "Available under Apache 2.0."),
    _t("Apache-2.0", "apache 2.0 compliance", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    _t("Apache-2.0", "apache 2.0 compliance", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    _t("Apache-2.0", "apache 2.0 reproduction", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. License shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.", head=True),
    _t("GPL-3.0", "general public 3", "This work is licensed under the GNU General Public License, version 3.", _GPL),
    _t("GPL-3.0", "gplv3", "Licensed under the GPLv3.", _GPL),
    _t("GPL-3.0", "gpl 3", "Licensed under the GPL version 3.", _GPL),
    _t("GPL-3.0", "general public 3", _GNU_NOTICE.format("program", "", 3), _GPL),
    _t("GPL-3.0", "general public 3 2007 verbatim", _GNU_HEAD.format("", "3, 29 June 2007", "2007") + " Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works.", _GPL, head=True),
    _t("GPL-2.0", "general public 2", "This work is licensed under the GNU General Public License, version 2.", _GPL),
    _t("GPL-2.0", "gplv2", "Licensed under the GPLv2.", _GPL),
    _t("GPL-2.0", "gpl 2", "Licensed under the GPL version 2.", _GPL),
    _t("GPL-2.0", "general public 2", _GNU_NOTICE.format("program", "", 2), _GPL),
    _t("GPL-2.0", "general public 2 1991 verbatim", _GNU_HEAD.format("", "2, June 1991", "1989, 1991") + " Preamble The licenses for most software are designed to take away your freedom to share and change it.", _GPL, head=True),
    _t("LGPL-3.0", "lesser general public 3", "This library is licensed under the GNU Lesser General Public License, version 3."),
    _t("LGPL-3.0", "lesser general public 3", _GNU_NOTICE.format("library", "Lesser ", 3)),
    _t("LGPL-3.0", "lesser general public 3 2007 verbatim", _GNU_HEAD.format("LESSER ", "3, 29 June 2007", "2007") + " This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.", head=True),
    _t("LGPL-2.1", "lesser general public 2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    _t("LGPL-2.1", "lesser general public 2.1", _GNU_NOTICE.format("library", "Lesser ", 2.1)),
    _t("LGPL-2.1", "lesser general public 2.1 1999 verbatim", _GNU_HEAD.format("LESSER ", "2.1, February 1999", "1991, 1999") + " This is the first released version of the Lesser GPL.", head=True),
    _t("AGPL-3.0", "affero general public 3", "This work is licensed under the GNU Affero General Public License, version 3."),
    _t("AGPL-3.0", "affero general public 3", _GNU_NOTICE.format("program", "Affero ", 3)),
    _t("AGPL-3.0", "affero general public 3 2007 verbatim", _GNU_HEAD.format("AFFERO ", "3, 19 November 2007", "2007") + " Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.", head=True),
    _t("BSD-3-Clause", "bsd 3-clause", "Licensed under the BSD 3-Clause License."),
    _t("BSD-2-Clause", "bsd 2-clause", "Licensed under the BSD 2-Clause License."),
    _t("BSD-3-Clause", "redistribution permitted neither endorse", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    _t("BSD-3-Clause", "redistribution permitted neither endorse disclaimed", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    _t("BSD-2-Clause", "redistribution permitted disclaimed", _BSD_HEAD + _BSD_TAIL, "neither endorse"),
    _t("MPL-2.0", "mozilla public 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    _t("MPL-2.0", "mozilla public 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    _t("MPL-2.0", "mozilla public 2.0 contributor", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.", head=True),
    _t("CC-BY-4.0", "cc by 4.0", "Licensed under CC BY 4.0.", _CC),
    _t("CC-BY-4.0", "commons attribution 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", _CC),
    _t("CC-BY-SA-4.0", "cc by-sa 4.0", "Licensed under CC BY-SA 4.0."),
    _t("CC-BY-SA-4.0", "commons attribution-sharealike 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    _t("CC-BY-NC-4.0", "cc by-nc 4.0", "Licensed under CC BY-NC 4.0."),
    _t("CC-BY-NC-4.0", "commons attribution-noncommercial 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    _t("CC-BY-NC-SA-4.0", "cc by-nc-sa 4.0", "Licensed under CC BY-NC-SA 4.0."),
    _t("CC-BY-ND-4.0", "cc by-nd 4.0", "Licensed under CC BY-ND 4.0."),
    _t("CC0-1.0", "cc0 1.0", "Released into the public domain under CC0 1.0 Universal License."),
    _t("CC0-1.0", "cc0", "Released under CC0."),
    _t("Unlicense", "unencumbered domain", "This is free and unencumbered software released into the public domain. License"),
    _t("Unlicense", "unencumbered domain", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _ASIS),
    _t("ISC", "isc", "Licensed under the ISC License."),
    _t("ISC", "permission fee granted disclaims", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    _t("Zlib", "zlib", "Licensed under the zlib License."),
    _t("Zlib", "misrepresented altered", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    _t("BSL-1.0", "boost 1.0", "Distributed under the Boost Software License, Version 1.0."),
    _t("WTFPL", "wtfpl", "Released under the WTFPL License."),
    _t("Proprietary", "rights reserved reproduced", "Copyright. All rights reserved. No part of this work may be reproduced without permission."),
)


def terms(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Scanner:
    def __init__(self, idf: dict[str, float], unknown: float, templates: tuple[Template, ...] = TEMPLATES):
        self.idf, self.unknown = idf, unknown
        self.templates = []
        for t in templates:
            words = terms(t.text)
            self.templates.append((t, len(words), *self._vector(words)))
        self.longest = max(n for _, n, _, _ in self.templates)
        #: SPDX identifiers by their lower-case form.
        self.known = {t.name.lower(): t.name for t in templates}

    def _vector(self, words: list[str]) -> tuple[dict[str, float], float]:
        v = {w: (1 + math.log(n)) * self.idf.get(w, self.unknown) for w, n in Counter(words).items()}
        return v, math.sqrt(sum(x * x for x in v.values())) or 1.0

    def best(self, words: list[str], starts: list[int]) -> tuple[float, int, str | None, bool, int]:
        """(score, words of the window, licence, whether it is the beginning of a longer text, start) over all templates and windows."""
        got: tuple[float, int, str | None, bool, int] = (0.0, 0, None, False, 0)
        there = set(words)
        for t, n, vec, norm in self.templates:
            if not there.issuperset(t.needs):
                continue
            for s in starts:
                window = words[s : s + n]
                held = set(window)
                if not held.issuperset(t.needs) or not held.isdisjoint(t.bars):
                    continue
                v, own = self._vector(window)
                score = round(sum(x * v[w] for w, x in vec.items() if w in v) / (norm * own), 6)
                if (score < got[0] or score == got[0] and (-n, t.name) >= (-got[1], got[2] or "")) or not score:
                    continue
                # Denied within the words up to the name, or before the window.
                if n <= 2 * LEAD and _DENIED.search(" ".join(words[max(0, s - LEAD) : s + window.index(t.needs[0])])):
                    continue
                got = (score, n, t.name, t.head, s)
        return got

    def identifier(self, text: str) -> str | None:
        """The expression of an SPDX line, with listed identifiers in their usual case."""
        m = _SPDX.search(text)
        return None if m is None else " ".join([self.known.get(x.lower(), x.upper() if x.lower() in ("or", "and", "with") else x) for x in m[1].strip("() ").split()])

    def scan(self, text: str) -> tuple[str | None, float, bool]:
        """(licence or None, score, whether the text is a licence file)."""
        low = text.lower()
        if not _CUE.search(low):
            return None, 0.0, False
        if "spdx-license-identifier" in low and (name := self.identifier(text)):
            return name, 1.0, 4 >= FILE_SHARE * len(terms(text))
        best: tuple[float, int, str | None, bool] = (0.0, 0, None, False)
        lines, words, first = low.split("\n"), [], []
        for line in lines:
            first.append(len(words))
            words += _WORD.findall(line)
        for line, before in zip(lines, first):
            if not _CUE.search(line):
                continue
            places = [m.start() for m in _WORD.finditer(line)]
            cues = {bisect_left(places, m.start()) for m in _CUE.finditer(line)}
            starts = sorted({0} | {max(0, k - d) for k in cues for d in range(LEAD + 1)})
            score, n, name, head, s = self.best(words[before : before + starts[-1] + self.longest], starts)
            if (score, n) > best[:2]:
                best = (score, n, name, head and before + s <= TITLE_WORDS)
        if best[0] < THRESHOLD:
            return None, best[0], False
        return best[2], best[0], best[3] or best[1] >= FILE_SHARE * len(words)


def inverse_frequencies(files: DataFrame, text: str = "text", templates=TEMPLATES) -> tuple[dict[str, float], float]:
    """(idf of each template term, idf of any other term), counted over all files; as many numbers as templates have terms."""
    vocabulary = {w for t in templates for w in terms(t.text)}

    def run(batches):
        counts: Counter = Counter()
        n = 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                counts.update(vocabulary.intersection(_WORD.findall(t.lower())))
                n += 1
        counts[""] = n
        yield pa.RecordBatch.from_pydict({"term": list(counts), "n": pa.array(list(counts.values()), pa.int64())})

    texts = files.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    got = {r.term: r.n for r in C.map_batches(texts, run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    total = got.pop("", 0)
    # Templates count as files too, so that no term is without a count.
    count = Counter(w for t in templates for w in set(terms(t.text)))
    size = total + len(templates)
    return {w: math.log(1 + size / (got.get(w, 0) + count[w])) for w in vocabulary}, math.log(1 + size)


def scan_licenses(files: DataFrame, path: str = "path", text: str = "text", keys: tuple[str, ...] = (), work: str | None = None) -> DataFrame:
    """keys, path, license, score, origin (own, inherited or none) and from_dir for every file."""
    spark = files.sparkSession
    work = work or C.shared_dir(spark)
    idf, unknown = inverse_frequencies(files, text)

    def run(batches):
        scanner = Scanner(idf, unknown)
        for batch in batches:
            got = [scanner.scan(t) for t in batch.column("text").to_pylist()]
            cols = [batch.column(k) for k in range(batch.num_columns - 1)] + [pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:-1], "own", "score", "covers"])

    given = files.select(*keys, F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    scanned = C.map_batches(given, run, f"{fields}, own string, score double, covers boolean")
    scanned = C.stored(scanned.withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", "")), f"{work}/scanned")

    licensing = scanned.where(F.col("own").isNotNull() & (F.col("covers") | F.col("path").rlike(_FILE_NAME)))
    of_dir = licensing.groupBy("dir").agg(F.min_by("own", F.struct(-F.col("score"), F.col("own"), F.col("path"))).alias("given"))
    # Directories and their ancestors, the root "" included.
    dirs = scanned.select("dir").distinct()
    up = dirs.select("dir", F.explode(F.expr("transform(sequence(0, size(split(dir, '/'))), i -> struct(i as depth, array_join(slice(split(dir, '/'), 1, i), '/') as above))")).alias("a")).select("dir", "a.*")
    nearest = up.join(of_dir.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max_by(F.struct("given", "above"), "depth").alias("near"))
    out = C.join_lookup(scanned, C.stored(nearest, f"{work}/nearest"), "dir", [*keys, "path"])
    return out.select(
        *keys, "path", F.coalesce("own", "near.given").alias("license"), F.round("score", 4).alias("score"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("own").isNull(), F.col("near.above")).alias("from_dir"),
    )
