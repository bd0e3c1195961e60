"""License scans: normalised text compared to licence templates by the Dice coefficient over word bigrams.

Text is lower-cased (A-Z) and cut into words of letters and digits; years and punctuation do not count. A candidate is any window of words
of the whole text, across lines and inside them, that begins and ends with a bigram of the template; words around a notice
are outside its window, and a holder's name inside one costs its own bigrams only. ``2 * common / (size + size of template)`` cannot exceed
``2 * min / (sum)``, so a template's size bounds that of its windows, and a window must hold a share of ``dice / (2 - dice)`` of the
template's bigrams; a sliding count of the places where a template's bigrams occur leaves only beginnings that can have that many. From each the
best end is taken.

Windows are given out best first; what lies between them is searched again until no window there is near enough, so notices side by
side are all found. Long notices win over the shorter ones they contain only if they are nearer.

Defined results: null and empty texts, and texts without two words, have no matches; ties go to the longer template, then
the earlier one, then the earlier and the shorter window. Repeated rows each get their rows; ids may be null; other columns are not read. Words
are compared as 64-bit hashes. Lines are counted from 0 by ``\\n``; ``start`` and ``end`` are code points, the end exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foreshock.llm.words import Texts, grams, slices

#: Least coefficient of a match.
DICE = 0.75

# Notices as their licences ask for them to be written, and the bodies of short licences, by SPDX name.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ],
    "GPL-3.0-only": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License version 3.",
    ],
    "GPL-3.0-or-later": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0-only": ["Licensed under the GNU General Public License version 2."],
    "GPL-2.0-or-later": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1-only": ["Licensed under the GNU Lesser General Public License, version 2.1."],
    "LGPL-3.0-only": ["Licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0-only": ["Licensed under the GNU Affero General Public License, version 3."],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
        "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
        "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
        "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
        "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved.", "This software is proprietary and confidential."],
}

_WORD = re.compile(r"[a-z0-9]+")
_YEAR = re.compile(r"(?:19|20)[0-9][0-9]")
_IN_WORD = np.zeros(256, bool)
_IN_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True


def words(text: str) -> list[str]:
    low = text.translate({c: c + 32 for c in range(65, 91)})
    return [w for w in _WORD.findall(low) if not _YEAR.fullmatch(w)]


def bigrams(text: str) -> Counter:
    found = words(text)
    return Counter(zip(found, found[1:]))


class Words:
    """The words of some texts: where they begin and end in bytes, their hashes, and the first word of each text."""

    def __init__(self, texts: Texts):
        low = texts.lowered()
        cut = Texts(np.where(_IN_WORD[low], low, 32).astype(np.uint8), texts.offsets)
        keep = np.ones(len(cut.starts), bool)
        four = np.flatnonzero(cut.ends - cut.starts == 4)
        if len(four):
            d = cut.data[cut.starts[four][:, None] + np.arange(4)]
            century = (d[:, 0] == ord("1")) & (d[:, 1] == ord("9")) | (d[:, 0] == ord("2")) & (d[:, 1] == ord("0"))
            keep[four] = ~(century & (d[:, 2:] <= ord("9")).all(axis=1))
        self.starts, self.ends, self.hashes = cut.starts[keep], cut.ends[keep], cut.hashes(lower=False)[keep]
        self.bounds = np.searchsorted(cut.doc[keep], np.arange(len(texts) + 1))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the bigram that begins at each word, and where the bigrams of its text end (the last word of a text begins none)."""
        stops = np.repeat(self.bounds[1:] - 1, np.diff(self.bounds))[:-1]
        return grams(self.hashes, 2), stops


class Index:
    """Templates with the number of times each has each of all their bigrams."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, dice: float = DICE):
        named = [(name, t) for name, texts in templates.items() for t in texts]
        hashes = []
        for _, t in named:
            found = Words(next(slices(pa.array([t])))[1])
            hashes.append(grams(found.hashes, 2))
        self.rows = [(name, t, len(h)) for (name, t), h in zip(named, hashes)]
        self.codes = np.unique(np.concatenate([*hashes, np.zeros(1, np.uint64)]))
        self.counts = np.zeros((len(named), len(self.codes)), np.int64)
        for i, h in enumerate(hashes):
            np.add.at(self.counts[i], np.searchsorted(self.codes, h), 1)
        self.dice = dice

    def windows(self, at: np.ndarray, code: np.ndarray, stop: np.ndarray) -> list[tuple[float, int, int, int, int]]:
        """The best window of each template from each place it can begin: coefficient, size and number of the template, first and last
        bigram. ``at`` are the bigrams of any template in order, ``code`` which, ``stop`` where a window from there must end."""
        out = []
        for i, (_, _, size) in enumerate(self.rows):
            if not size:
                continue
            mine = self.counts[i][code] > 0
            place, which, bound = at[mine], code[mine], stop[mine]
            least, most = math.ceil(self.dice * size / (2 - self.dice) - 1e-9), math.floor(size * (2 - self.dice) / self.dice + 1e-9)
            if len(place) < least:
                continue
            to = np.searchsorted(place, np.minimum(place + most, bound))
            for a in np.flatnonzero(to - np.arange(len(place)) >= least).tolist():
                inside = which[a : to[a]]
                kinds, again = np.unique(inside, return_inverse=True)
                order = np.argsort(again, kind="stable")
                rank = np.empty(len(inside), np.int64)
                rank[order] = np.arange(len(inside)) - np.searchsorted(again[order], np.arange(len(kinds)))[again[order]]
                common = np.cumsum(rank < self.counts[i][inside])
                value = 2 * common / (place[a : to[a]] - place[a] + 1 + size)
                b = int(value.argmax())
                if value[b] >= self.dice:
                    out.append((float(value[b]), size, i, int(place[a]), int(place[a + b])))
        return out


def matches(found: Words, index: Index) -> list[tuple[int, int, int, float]]:
    """First and last word, number of the template and coefficient of each match, in order."""
    if len(found.hashes) < 2:
        return []
    pairs, stops = found.pairs()
    near = np.minimum(np.searchsorted(index.codes, pairs), len(index.codes) - 1)
    at = np.flatnonzero((index.codes[near] == pairs) & (np.arange(len(pairs)) < stops))
    code, stop = near[at], stops[at]
    taken = np.empty((0, 2), np.int64)  # first and last word, in order and apart
    out: list[tuple[int, int, int, float]] = []
    while len(at):
        new: list[tuple[int, int, int, float]] = []
        free = np.ones(len(pairs) + 1, bool)
        for value, _, i, first, last in sorted(index.windows(at, code, stop), key=lambda x: (-x[0], -x[1], *x[2:])):
            if free[first : last + 2].all():
                free[first : last + 2] = False
                new.append((first, last + 1, i, value))
        if not new:
            break
        out += new
        taken = np.array(sorted([*taken.tolist(), *([f, g] for f, g, _, _ in new)]), np.int64)
        # what is left: places in the texts of new matches, outside all matches, up to the next one
        text = np.searchsorted(found.bounds, at, "right")
        again = np.isin(text, np.searchsorted(found.bounds, [f for f, *_ in new], "right"))
        after = np.searchsorted(taken[:, 0], at, "right")
        again &= (after == 0) | (at > taken[after - 1, 1])
        upto = np.append(taken[:, 0] - 1, len(pairs))[after]
        at, code, stop = at[again], code[again], np.minimum(stop, upto)[again]
        inside = at < stop
        at, code, stop = at[inside], code[inside], stop[inside]
    return sorted(out)


SCHEMA = "doc_id BIGINT, license STRING, first_line BIGINT, last_line BIGINT, start BIGINT, end BIGINT, dice DOUBLE, template STRING"
_OUT = pa.schema([
    ("doc_id", pa.int64()), ("license", pa.string()), ("first_line", pa.int64()), ("last_line", pa.int64()),
    ("start", pa.int64()), ("end", pa.int64()), ("dice", pa.float64()), ("template", pa.string()),
])


def _scanner(templates: dict[str, list[str]], dice: float):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, dice)
        for batch in batches:
            ids = batch.column("doc_id")
            for at, texts in slices(batch.column("text")):
                found = Words(texts)
                rows, got = [], matches(found, index)
                if not got:
                    continue
                points, breaks = texts.code_points(), np.flatnonzero(texts.data == 10)
                for first, last, i, value in got:
                    k = int(np.searchsorted(found.bounds, first, "right")) - 1
                    low, a, b = texts.offsets[k], found.starts[first], found.ends[last]
                    lines = np.searchsorted(breaks, [low, a, b])
                    name, template, _ = index.rows[i]
                    rows.append(
                        (ids[at + k].as_py(), name, lines[1] - lines[0], lines[2] - lines[0], points[a] - points[low], points[b] - points[low], value, template)
                    )
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)

    return over


def license_matches(
    docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, dice: float = DICE, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per notice found: its lines and code points, licence, coefficient and template."""
    plain = docs.selectExpr(f"CAST(`{doc_id}` AS BIGINT) AS doc_id", f"CAST(`{text}` AS STRING) AS text")
    return plain.mapInArrow(_scanner(templates, dice), SCHEMA)


def op3_dice_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"))
