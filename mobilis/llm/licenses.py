"""Licences of documents: sparse TF-IDF cosine to templates, and inheritance by path.

Templates are short statements, file headers, the headings with which long licences
open, and short licences as a whole.  Term weights come from how many of all documents
hold each term of the templates.  A text is scored as a whole and in every window of a
template's length, across line ends, so a header counts wherever it stands.  Of each
template the heaviest terms are its anchors, as many as it takes until the others alone
cannot reach the threshold: windows without any are passed over, which loses none.

Bags of words do not tell versions and variants apart, so a few terms decide: a window
counts only if it has the version and the variant words of the template, none that the
template lacks, and no negation in it or right before the statement.

A document that holds a licence and hardly a word more, or opens with the heading of a
long one, is a licence file: it licenses its directory, and documents without a licence
of their own take that of their nearest directory upwards.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilis.llm.shared import joined_to_unique, stored, tidy
from mobilis.llm.text import blocks

#: Texts of public licences and the forms in which files state them.
STATEMENTS = {
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD-2-Clause": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        "BSD 2-Clause License",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD license",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        "BSD 3-Clause License",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "BSL-1.0": [
        "Licensed under the Boost Software License, Version 1.0",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        "SPDX-License-Identifier: ISC",
    ],
    "LGPL-2.1": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "LGPL-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-3.0-only",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "MIT": [
        "Released under the MIT License",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": [
        """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
        "SPDX-License-Identifier: Unlicense",
    ],
    "Zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    ],
}
#: How the files of long licences open.
OPENINGS = {
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "Apache-2.0": ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "CC0-1.0": ["Creative Commons Legal Code CC0 1.0 Universal"],
    "EPL-2.0": ["Eclipse Public License - v 2.0"],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "MPL-2.0": ["Mozilla Public License Version 2.0"],
}
THRESHOLD = 0.75
#: Terms among which the heading of a licence file stands.
OPENING_TERMS = 12
#: Terms that a licence file may have besides its licence: a title, a year, a holder.
OTHER_TERMS = 12
#: Words that tell variants of a licence apart, the numbers that tell versions, and the families that have any.
VARIANTS = frozenset({"affero", "lesser", "lgpl", "agpl", "noncommercial", "nc", "sharealike", "sa", "noderivatives", "nd", "boost", "bsl"})
VERSIONS = frozenset({"1", "2", "3", "4"})
VERSIONED = ("AGPL", "Apache", "BSL", "CC", "EPL", "GPL", "LGPL", "MPL")
NEGATIONS = frozenset({"not", "never", "no", "neither", "isn", "aren", "without"})
_TERM = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")
_BETWEEN = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)])


def terms(text: str) -> list[str]:
    return _TERM.findall(text.encode().lower().decode())  # bytes lower A-Z only


def _forms() -> Iterator[tuple[str, bool, list[str]]]:
    for opening, table in ((False, STATEMENTS), (True, OPENINGS)):
        for name, texts in table.items():
            for text in texts:
                yield name, opening, terms(text)


def _vocabulary() -> list[str]:
    return sorted({t for _, _, own in _forms() for t in own})


def document_counts(docs: DataFrame, text_col: str = "text") -> tuple[int, dict[str, int]]:
    """The number of documents, and of those with each term of the templates (bounded by these)."""
    words = _vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known,) = blocks(pa.array([" ".join(words)]), _BETWEEN)
        hashes = known.word_hashes(lower=True)
        order = np.argsort(hashes)
        total, n = np.zeros(len(words), dtype=np.int64), 0
        for batch in batches:
            for block in blocks(batch.column("text"), _BETWEEN):
                mine = block.word_hashes(lower=True)
                at = np.minimum(np.searchsorted(hashes[order], mine), len(words) - 1)
                hit = np.flatnonzero(hashes[order][at] == mine)
                text = np.searchsorted(block.word_offsets, hit, side="right") - 1
                pairs = np.unique(text * len(words) + order[at[hit]])
                total += np.bincount(pairs % len(words), minlength=len(words))
                n += len(block.offsets) - 1
        yield pa.RecordBatch.from_arrays([pa.array([*words, None]), pa.array([*total.tolist(), n])], ["term", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "term string, n long")
    found = {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return found.pop(None, 0), found


@dataclass
class Form:
    """A template: unit vector over its terms, its length, and the terms that no match can lack."""

    name: str
    opening: bool
    length: int
    vector: dict[str, float]
    anchors: frozenset[str]
    required: frozenset[str]
    excluded: frozenset[str]
    negations: int


@dataclass
class Weights:
    rarity: dict[str, float]
    unseen: float
    forms: list[Form]


def _negations(words: list[str]) -> int:
    return sum(t in NEGATIONS for t in words)


def deciding(name: str, own: list[str]) -> tuple[frozenset[str], frozenset[str]]:
    """The terms that a window must have to state a licence as a template does, and those that it must not have."""
    telling = VARIANTS | (VERSIONS if name.startswith(VERSIONED) else frozenset())
    return telling & set(own), telling - set(own)


def weigh(n: int, counts: dict[str, int], threshold: float) -> Weights:
    rarity = {t: 1 + math.log((n + 1) / (counts.get(t, 0) + 1)) for t in _vocabulary()}
    forms = []
    for name, opening, own in _forms():
        raw = {t: k * rarity[t] for t, k in Counter(own).items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        vector = {t: v / norm for t, v in raw.items()}
        left, anchors = 1.0, set()
        for t, v in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
            if left < threshold**2 * 0.999:
                break
            anchors.add(t)
            left -= v * v
        forms.append(Form(name, opening, len(own), vector, frozenset(anchors), *deciding(name, own), _negations(own)))
    return Weights(rarity, 1 + math.log(n + 1), sorted(forms, key=lambda f: f.name))


def cosine(words: list[str], form: Form, w: Weights) -> float:
    """The cosine of some terms in a row to a template."""
    raw = {t: k * w.rarity.get(t, w.unseen) for t, k in Counter(words).items()}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    return sum(v * raw.get(t, 0.0) for t, v in form.vector.items()) / norm if norm else 0.0


def _stretches(at: list[int], length: int, n: int) -> Iterator[tuple[int, int]]:
    """First and last start of the windows that hold one of the sorted positions, as few runs as there are."""
    first = last = -1
    for p in at:
        a, b = max(0, p - length + 1), min(p, n - length)
        if first >= 0 and a <= last + 1:
            last = max(last, b)
            continue
        if first >= 0:
            yield first, last
        first, last = a, b
    if first >= 0:
        yield first, last


def _denied(words: list[str], start: int, form: Form) -> bool:
    """Whether one of the two terms before the statement is a negation.

    A window may begin inside the statement, so terms of the form that lead up to it belong to it.
    """
    stop = max(0, start - form.length)
    while start > stop and words[start - 1] in form.vector and words[start - 1] not in NEGATIONS:
        start -= 1
    return any(t in NEGATIONS for t in words[max(0, start - 2) : start])


def admitted(words: list[str], start: int, size: int, form: Form) -> bool:
    """Whether a window may state what the form states: versions and variants as in it, no negation."""
    window = words[start : start + size]
    own = set(window)
    return form.required <= own and not form.excluded & own and _negations(window) <= form.negations and not _denied(words, start, form)


def best_window(words: list[str], at: list[int], form: Form, w: Weights) -> tuple[float, int]:
    """The highest cosine of an admitted window of the form's length that holds one of the positions, and its start."""
    n, size = len(words), form.length
    if n <= size:
        return (cosine(words, form, w), 0) if at and admitted(words, 0, n, form) else (0.0, 0)
    best, where = 0.0, -1
    rarity, vector, unseen = w.rarity, form.vector, w.unseen
    for first, last in _stretches(at, size, n):
        count = Counter(words[first : first + size])
        dot = sum(vector.get(t, 0.0) * k * rarity.get(t, unseen) for t, k in count.items())
        square = sum((k * rarity.get(t, unseen)) ** 2 for t, k in count.items())
        for start in range(first, last + 1):
            if start > first:
                gone, come = words[start - 1], words[start + size - 1]
                if gone != come:
                    for t, step in ((gone, -1), (come, 1)):
                        k, r = count[t], rarity.get(t, unseen)
                        square += (2 * k * step + 1) * r * r
                        dot += step * vector.get(t, 0.0) * r
                        count[t] = k + step
            if dot > 0 and dot * dot > best * best * square * (1 + 1e-12) and admitted(words, start, size, form):
                best, where = dot / math.sqrt(square), start
    return (cosine(words[where : where + size], form, w), where) if where >= 0 else (0.0, 0)


def reachable(own: set[str], form: Form, threshold: float) -> bool:
    """Whether a window of a text with these terms can reach the threshold.

    No cosine is above the length of the form's vector over the terms that are there.
    """
    return form.required <= own and sum(v * v for t, v in form.vector.items() if t in own) >= threshold * threshold * 0.999


def best_match(text: str, w: Weights, threshold: float) -> tuple[float, str | None, bool]:
    """Score and name of the best template that reaches the threshold (of equal ones the longest, then the first by name), and whether the text is a licence file."""
    words = terms(text)
    own = set(words)
    forms = [f for f in w.forms if reachable(own, f, threshold)]
    known = {t for f in forms for t in f.anchors}
    positions: dict[str, list[int]] = {}
    for k, t in enumerate(words) if forms else ():
        if t in known:
            positions.setdefault(t, []).append(k)
    best, length, found = 0.0, 0, None
    file = False
    for form in forms:
        at = sorted(p for t in form.anchors for p in positions.get(t, ()))
        score, start = best_window(words, at, form, w)
        if len(words) <= form.length + OTHER_TERMS:  # the licence and hardly a word more
            whole = cosine(words, form, w) if score and admitted(words, 0, len(words), form) else 0.0
            file |= max(score, whole) >= threshold
            score = max(score, whole)
        file |= form.opening and score >= threshold and start < OPENING_TERMS
        if score > best + 1e-12 or (score > best - 1e-12 and score and form.length > length):
            best, length, found = score, form.length, form.name
    return best, found, file


def scan(docs: DataFrame, path_col: str, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, own_license, score, is_license_file, license, inherited_from per row.

    ``license`` is the own licence, else that of the licence file nearest upwards in
    ``path`` (``/`` between directories; of several files in one directory the first
    by path), else null.  ``score`` is null without an own licence.  Null and empty
    texts state none; a null path inherits nothing and licenses nothing.  Repeated
    rows and null ids give a row each; other columns are not read.
    """
    weights = weigh(*document_counts(docs, text_col), threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, files = [], [], []
            for text in batch.column("text").to_pylist():
                score, name, file = best_match(text or "", weights, threshold)
                own = score >= threshold
                names.append(name if own else None)
                scores.append(round(score, 6) if own else None)
                files.append(own and file)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("path"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(files, pa.bool_())], ["doc_id", "path", "own_license", "score", "is_license_file"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(tidy(run), "doc_id long, path string, own_license string, score double, is_license_file boolean")
    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit(""))
    found = stored(found.withColumn("dir", folder))
    grants = found.where("is_license_file AND dir IS NOT NULL").groupBy("dir").agg(F.min(F.struct("path", "own_license")).alias("g")).select(F.col("dir").alias("up"), F.col("g.path").alias("file"), F.col("g.own_license").alias("granted"))
    steps = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.expr("concat(array(''), transform(sequence(1, size(split(dir, '/'))), i -> array_join(slice(split(dir, '/'), 1, i), '/')))"))
    dirs = stored(found.where("dir IS NOT NULL").groupBy("dir").agg(F.count(F.lit(1)).alias("n_rows")))
    # all directories lead up to a few: those meet their grant by a broadcast, as the rows of large directories do
    ways = stored(dirs.select("dir", F.posexplode(steps).alias("depth", "up")))
    reached = stored(ways.groupBy("up").agg(F.count(F.lit(1)).alias("n_ways")).join(grants, "up"))
    granted = joined_to_unique(ways, reached, "up", "n_ways", ways.count()).groupBy("dir").agg(F.max(F.struct("depth", "file", "granted")).alias("g"))
    near = stored(dirs.join(granted, "dir", "left").select("dir", "n_rows", "g.file", "g.granted"))
    placed = joined_to_unique(found.where("dir IS NOT NULL"), near, "dir", "n_rows", found.count())
    lost = found.where("dir IS NULL").withColumns({"file": F.lit(None).cast("string"), "granted": F.lit(None).cast("string")})
    none = F.col("own_license").isNull()
    return placed.unionByName(lost).select("doc_id", "path", "own_license", "score", "is_license_file", F.coalesce("own_license", "granted").alias("license"), F.when(none, F.col("file")).alias("inherited_from"))
