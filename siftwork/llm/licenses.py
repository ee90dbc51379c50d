"""License scans by conditional compression.

A block that is confirmed has most of its template's words, and all that name the license; so each template has
a few seeds of which every such block has one (its longest name, or enough of its longest words). Around each
seed in a text, the words that align best with a template are its candidate block; it may begin and end inside lines
and cross them. Each candidate is compressed alone and with its template as raw dictionary. The template that saves
most bytes, and a share of the block's size, wins if the exact difference of the wordings confirms it: the words
of the block and of the template that their alignment leaves out; else the next one may. A difference in
words that name a license, its version or its variant makes it another license. Of overlapping
blocks the one that saves most stays, and the seeds outside it are tried again on what is left.

Defined cases: null and empty texts have no rows, as have texts without a confirmed block; a block repeated
in a text has a row each time; blocks of one text never overlap. Columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

import bisect
import difflib
import heapq
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, table

# Fixed wordings: short notices and the operative paragraphs of common licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}
# The same for versions and families that differ from each other in few words.
for _v in ("1.0", "2.0"):
    TEMPLATES[f"GPL-{_v}"] = f"This work is licensed under the GNU General Public License, version {_v[0]}."
    TEMPLATES[f"GPL-{_v}-header"] = TEMPLATES["GPL-3.0-header"].replace("version 3", f"version {_v[0]}")
for _k, _name, _versions in (("LGPL", "Lesser", ("2.1", "3.0")), ("LGPL", "Library", ("2.0",)), ("AGPL", "Affero", ("3.0",))):
    for _v in _versions:
        TEMPLATES[f"{_k}-{_v}"] = f"This work is licensed under the GNU {_name} General Public License, version {_v.removesuffix('.0')}."
        TEMPLATES[f"{_k}-{_v}-header"] = TEMPLATES["GPL-3.0-header"].replace("GNU General", f"GNU {_name} General").replace("version 3", f"version {_v.removesuffix('.0')}")
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _k, _name in _CC.items():
    for _v in ("2.0", "2.5", "3.0", "4.0"):
        _port = {"4.0": "International", "3.0": "Unported"}.get(_v, "Generic")
        TEMPLATES[f"CC-{_k}-{_v}" + ("-short" if (_k, _v) != ("BY-NC", "4.0") else "")] = f"Licensed under CC {_k} {_v}."
        TEMPLATES[f"CC-{_k}-{_v}" + ("-long" if (_k, _v) != ("BY", "4.0") else "")] = f"This work is licensed under a Creative Commons {_name} {_v} {_port} License."
_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES'
TEMPLATES |= {
    "BSD": "Released under the BSD License.",
    "BSD-head": _HEAD,  # common to all variants
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-2-Clause-text": f"{_HEAD} {_BINARY} {_AS_IS}",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSD-3-Clause-text": f"{_HEAD} {_BINARY} {_NAMES} {_AS_IS}",
    "ISC": "Released under the ISC License.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-1.1": "Licensed under the Mozilla Public License, Version 1.1.",
    "MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
# Words that tell licenses apart: a block that lacks or adds one is not that license.
NAMING = set(
    "apache mit gnu gpl lgpl agpl general lesser library affero bsd isc mozilla mpl eclipse epl cc creative commons by nc sa nd attribution noncommercial sharealike noderivatives noderivs "
    "neither endorse advertising clause simplified modified artistic boost zlib cddl eupl x11".split()
)
VERSION = re.compile(r"v?(\d+(?:\.\d+)*?)(?:\.0)*")
SHORT = 20  # longer wordings may have numbered lists
WORD = re.compile(r"[^\W_]+(?:\.[^\W_]+)*")
MIN_SAVING, MIN_ALIKE = 0.25, 0.75
RESULT = "doc_id long, first int, last int, start int, stop int, license string, saving double, alike double, missing string, added string"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("license", pa.string()), ("saving", pa.float64()), ("alike", pa.float64()), ("missing", pa.string()), ("added", pa.string())])


def plain(word: str) -> str:
    """Versions without v and trailing .0."""
    m = VERSION.fullmatch(word)
    return m[1] if m else word


def seeds(own: list[str]) -> set[str]:
    """Words of which every block that can be confirmed has one.

    A block lacks no word that names its license. Without such a word of four letters or more, it is the
    likeness that asks for a share of the template's words, so that more than the rest of them must meet one."""
    naming = [w for w in own if names(w, own) and not VERSION.fullmatch(w) and len(w) > 3]
    if naming:
        return {max(naming, key=lambda w: (len(w), w))}
    count, out, n = Counter(own), set(), 0
    for w in sorted(count, key=lambda w: (VERSION.fullmatch(w) is not None, -len(w), w)):
        out.add(w)
        n += count[w]
        if n > (1 - MIN_ALIKE / (2 - MIN_ALIKE)) * len(own):
            break
    return out


class Scanner:
    def __init__(self, templates: dict[str, str]):
        import ahocorasick
        import zstandard as z

        self.words = {k: [plain(w) for w in WORD.findall(v.lower())] for k, v in templates.items()}
        self.naming = {k: {w for w in v if names(w, v)} for k, v in self.words.items()}
        self.sets = {k: set(v) for k, v in self.words.items()}
        self.seeded: dict[str, list[str]] = {}
        for k, v in self.words.items():
            for w in seeds(v):
                self.seeded.setdefault(w, []).append(k)
        self.gate = ahocorasick.Automaton()
        for w in self.seeded:
            self.gate.add_word(w, w)
        self.gate.make_automaton()
        self.reach = int((2 / MIN_ALIKE - 1) * max(map(len, self.words.values())))
        self.alone = z.ZstdCompressor(level=9, write_content_size=False)
        self.packers = {k: z.ZstdCompressor(level=9, write_content_size=False, dict_data=z.ZstdCompressionDict(v.lower().encode(), dict_type=z.DICT_TYPE_RAWCONTENT)) for k, v in templates.items()}

    def sizes(self, block: str, name: str) -> tuple[int, int]:
        """The block's compressed size alone and given the template."""
        raw = " ".join(block.lower().split()).encode()
        return len(self.alone.compress(raw)), len(self.packers[name].compress(raw))

    def difference(self, block: str, name: str) -> tuple[float, str, str]:
        """Likeness of the wordings, and the words that the block misses and adds."""
        a, b = self.words[name], [plain(w) for w in WORD.findall(block.lower())]
        m = difflib.SequenceMatcher(None, a, b, autojunk=False)
        missing, added = [], []
        for op, i, j, p, q in m.get_opcodes():
            if op != "equal":
                missing += a[i:j]
                added += b[p:q]
        return m.ratio(), " ".join(missing), " ".join(added)

    def other(self, name: str, missing: str, added: str) -> bool:
        """Whether the difference touches words that tell licenses apart, except by their order."""
        gone, come = Counter(missing.split()), Counter(added.split())
        own = self.words[name]
        # a longer wording may have gained the numbers of a list
        return any(names(w, own) for w in gone - come) or any(names(w, own) and not (len(own) > SHORT and w[0].isdigit()) for w in come - gone)

    def block(self, words: list[str], at: int, name: str) -> tuple[float, int, int] | None:
        """(score, first, end) of the words around the word `at` that are most like a template.

        A common word, in order, counts 2, and each word of either costs MIN_ALIKE; below 0 the likeness is too small."""
        own = self.words[name]
        # a likeness of MIN_ALIKE needs that share of common words and allows that length
        reach, least = int((2 / MIN_ALIKE - 1) * len(own)), MIN_ALIKE / (2 - MIN_ALIKE) * len(own)
        low, high = max(0, at - reach), min(len(words), at + reach + 1)
        near = words[low:high]
        if sum(w in self.sets[name] for w in near) < least:
            return None
        at -= low
        end, best = best_end(own, near, at)
        first = end - best_end(own[::-1], near[:end][::-1], end - 1 - at)[0]
        score = best - MIN_ALIKE * len(own)
        return (score, first + low, end + low) if score >= 0 else None

    def scan(self, text: str):
        """(first line, last line, start, stop, license, saving, likeness, missing, added) of each confirmed block."""
        if next(self.gate.iter(text.lower()), None) is None:
            return
        spans = [m.span() for m in WORD.finditer(text)]
        words = [plain(text[a:b].lower()) for a, b in spans]

        def best(at: int, low: int, high: int):
            """The confirmed block at a seed of which a template saves most bytes; then likeness and the templates' order decide."""
            seen, near, found = set(words[low:high]), words[low:high], []
            for order, name in enumerate(self.seeded[words[at]]):
                b = self.block(near, at - low, name) if self.naming[name] <= seen else None
                if b:
                    first, end = b[1] + low, b[2] + low
                    part = text[spans[first][0] : spans[end - 1][1]]
                    own, given = self.sizes(part, name)
                    found.append((given - own, -b[0], order, first, end, name, 1 - given / own, part))
            for less, _, _, first, end, name, saving, part in sorted(found):
                if saving >= MIN_SAVING:
                    alike, missing, added = self.difference(part, name)
                    if alike >= MIN_ALIKE and not self.other(name, missing, added):
                        return -less, first, end, name, saving, alike, missing, added

        def put(at: int, low: int, high: int):
            b = best(at, max(low, at - self.reach), min(high, at + self.reach + 1))
            if b:
                heapq.heappush(heap, (-b[0], at, b))

        heap: list = []
        for at, w in enumerate(words):
            if w in self.seeded:
                put(at, 0, len(words))
        taken: list[tuple[int, int, tuple]] = []
        while heap:
            _, at, b = heapq.heappop(heap)
            k = bisect.bisect_right(taken, at, key=lambda x: x[0])
            low, high = taken[k - 1][1] if k else 0, taken[k][0] if k < len(taken) else len(words)
            if at < low:
                continue
            if b[1] < low or b[2] > high:
                put(at, low, high)
            else:
                taken.insert(k, (b[1], b[2], b))
        line, done = 0, 0
        for first, end, b in taken:
            start, stop = spans[first][0], spans[end - 1][1]
            line, done = line + text.count("\n", done, start), start
            yield line, line + text.count("\n", start, stop), start, stop, *b[3:]


def names(word: str, wording: list[str]) -> bool:
    """Whether a word that a block lacks or adds makes it another license than that of the wording."""
    return VERSION.fullmatch(word) is not None or (word in NAMING and (word != "by" or "cc" in wording))


def best_end(own: list[str], words: list[str], at: int) -> tuple[int, float]:
    """(end, score) of the best alignment of words[first:end] for any first <= at < end: 2 a common word, less MIN_ALIKE a word."""
    ids = {w: i for i, w in enumerate(dict.fromkeys(own))}
    mine = np.array([ids[w] for w in own])
    row, best = np.full(len(own) + 1, -np.inf), (0, -np.inf)
    for j, w in enumerate(words):
        if j <= at:
            row = np.maximum(row, 0.0)
        new = row.copy()
        if (i := ids.get(w)) is not None:
            new[1:] = np.where(mine == i, np.maximum(new[1:], row[:-1] + 2), new[1:])
        row = np.maximum.accumulate(new) - MIN_ALIKE
        if j >= at and row[-1] > best[1]:
            best = (j + 1, float(row[-1]))
    return best


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """A row for each confirmed license block of the whole texts; first and last are line numbers from 0, start and stop places in the text."""
    templates = templates or TEMPLATES
    def run(it):
        scanner = Scanner(templates)
        for ids, texts in batches(it, "doc_id", "text"):
            rows = [(d, *r) for d, t in zip(ids, texts) for r in scanner.scan(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") > 0).mapInArrow(run, RESULT)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op5_license_scan": op5_license_scan}
