"""Licence scans: Dice coefficient of word bigrams against licence templates.

Texts and templates are normalised alike: case-folded runs of letters and digits,
`licence` as `license`, copyright lines of templates left out. A template of B
bigrams is compared with every passage of B bigrams of a document (the whole
document if it is shorter), both as multisets. Size bounds prune: a document
that holds fewer than LEAST / (2 - LEAST) * B bigrams of a template can't reach
the threshold, and a passage shares at most as many as it holds, which a running
sum tells for all. The passages that remain are scored by a running count.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partmill.llm.common import MIX, mapped, scrambled, ship, table, text_bytes

LEAST = 0.8

# Licence texts, the headers that they ask for, and the notices by which works name their licence.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to
deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS",
WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD
TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1.
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in
binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1.
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in
binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from
the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you
wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may
not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute
this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions
that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We
make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt
act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software
and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the
Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
machine-executable object code generated by a source language processor.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy
of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the
License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "LGPL-2.1": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the
Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "LGPL-3.0": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the
Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the
Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
obtain one at http://mozilla.org/MPL/2.0/.""",
    "MIT (notice)": "Released under the MIT License.",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause (notice)": "Licensed under the BSD 3-Clause License.",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 (notice)": "This work is licensed under the GNU General Public License, version 2.",
    "MPL-2.0 (notice)": "Licensed under the Mozilla Public License, version 2.0.",
    "CC-BY-4.0 (notice)": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 (notice)": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0 (notice)": "Released into the public domain under CC0 1.0.",
    "LGPL-2.1 (notice)": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0 (notice)": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0 (notice)": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-4.0 (statement)": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 (statement)": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 (statement)": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0 (statement)": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0 (statement)": """This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.""",
}


def full_texts() -> dict[str, str]:
    """The licences whose texts are files of this package, by name."""
    folder = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts")
    out = {}
    for name in sorted(os.listdir(folder)):
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            out[f"{name.removesuffix('.txt')} (text)"] = f.read()
    return out


_OTHER = re.compile(r"[\W_]+")


def normal(text: str) -> list[str]:
    out = _OTHER.sub(" ", text.casefold()).split()
    return ["license" if w == "licence" else w for w in out]


def bigrams(words: list[str]) -> np.ndarray:
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return scrambled(h[:-1] * MIX + h[1:])


class Passage(NamedTuple):
    license: str
    dice: float
    shared: int
    first: int
    end: int


class Templates:
    def __init__(self, texts: dict[str, str], least: float = LEAST):
        self.least = least
        own = {k: bigrams(w) for k, t in texts.items() if len(w := normal(t)) > 1}
        self.sizes = {k: len(h) for k, h in own.items()}
        self.names = list(own)
        self.counts = {k: Counter(h.tolist()) for k, h in own.items()}
        self.all = np.unique(np.concatenate([*own.values(), np.empty(0, np.uint64)]))
        self.held = np.array([np.isin(self.all, h) for h in own.values()]).reshape(len(own), len(self.all))
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.all & np.uint64(0xFFFF)).astype(np.int64)] = True

    def scores(self, name: str, h: np.ndarray, hit: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Bigrams that the windows starting at lo..hi share with the template, as multisets, by a running count."""
        size, most = self.sizes[name], self.counts[name]
        held: Counter[int] = Counter()
        now, out = 0, np.zeros(hi - lo + 1, np.int64)
        for x in h[hit[np.searchsorted(hit, lo) : np.searchsorted(hit, lo + size)]].tolist():
            held[x] += 1
            now += held[x] <= most[x]
        out[0] = now
        own = hit[(hit >= lo) & (hit < hi + size)]
        steps = sorted([(p + 1, 0, x) for p, x in zip(own.tolist(), h[own].tolist()) if p < hi] + [(p - size + 1, 1, x) for p, x in zip(own.tolist(), h[own].tolist()) if p - size + 1 > lo])
        for start, comes, x in steps:  # the window that starts at `start` has lost x, or gained it
            if comes:
                held[x] += 1
                out[start - lo] += held[x] <= most[x]
            else:
                out[start - lo] -= held[x] <= most[x]
                held[x] -= 1
        return np.cumsum(out)

    def passages(self, name: str, h: np.ndarray, hit: np.ndarray) -> list[Passage]:
        """Passages of the template's length of LEAST or more that don't overlap: the highest coefficient first, then the first one."""
        size = self.sizes[name]
        wide = min(size, len(h))
        need = self.least * (size + wide) / 2 - 1e-9
        if len(hit) < need:
            return []
        starts = np.arange(max(0, int(hit[0]) - size), min(int(hit[-1]), len(h) - wide) + 1)
        bound = np.searchsorted(hit, starts + wide) - np.searchsorted(hit, starts)
        starts = starts[bound >= need]  # a window shares at most as many as it has bigrams of the template
        if not len(starts):
            return []
        out, cuts = [], np.nonzero(np.diff(starts) > 1)[0] + 1
        for run in np.split(starts, cuts):
            shared = self.scores(name, h, hit, int(run[0]), int(run[-1]))
            out.append((run[shared >= need], shared[shared >= need]))
        at, shared = np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])
        kept: list[Passage] = []
        while len(at):
            k = int(np.argmax(shared))  # the first of the highest
            s, n = int(at[k]), int(shared[k])
            kept.append(Passage(name, 2 * n / (size + wide), n, s, s + wide + 1))
            free = (at + wide + 1 <= s) | (at >= s + wide + 1)
            at, shared = at[free], shared[free]
        return kept

    def found(self, texts: list[bytes]) -> list[list[Passage]]:
        """Passages of each text, by place. Of those that overlap the one of most shared bigrams times its coefficient stays."""
        words = [normal(t.decode("utf-8", "replace")) for t in texts]
        n = np.fromiter(map(len, words), np.int64, len(words))
        out: list[list[Passage]] = [[] for _ in texts]
        if n.sum() < 2 or not len(self.all):
            return out
        h = bigrams([*chain.from_iterable(words)])
        ends = np.cumsum(n)
        near = np.nonzero(self.seen[(h & np.uint64(0xFFFF)).astype(np.int64)])[0]
        at = np.minimum(np.searchsorted(self.all, h[near]), len(self.all) - 1)
        same = self.all[at] == h[near]
        near, at = near[same], at[same]
        of = np.searchsorted(ends, near, "right")
        inside = near + 1 < ends[of]  # not from one text into the next
        near, at, of = near[inside], at[inside], of[inside]
        for k in np.unique(of).tolist():
            a, b = np.searchsorted(of, k), np.searchsorted(of, k, "right")
            start = int(ends[k] - n[k])
            hits, which = near[a:b] - start, at[a:b]
            own = h[start : start + int(n[k]) - 1]
            every: list[Passage] = []
            for t in np.nonzero(np.array([self.least / (2 - self.least) * self.sizes[x] for x in self.names]) <= min(b - a, len(own)))[0].tolist():  # size bounds
                every += self.passages(self.names[t], own, hits[self.held[t][which]])
            every.sort(key=lambda p: (-p.shared * p.dice, -p.dice, p.first, p.license))
            for p in every:
                if all(p.end <= q.first or q.end <= p.first for q in out[k]):
                    out[k].append(p)
            out[k].sort(key=lambda p: p.first)
        return out


def license_passages(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, passages: those of each row that holds any, by place.

    Words are counted in the normalised text. Passages of one document don't
    overlap. A null text is empty and holds none; other columns are not read;
    repeated rows repeat.
    """
    given = ship(docs.sparkSession).sparkContext.broadcast(Templates(TEMPLATES | full_texts() if templates is None else templates, least))  # the templates are a parameter of fixed size

    def run(b: pa.RecordBatch) -> dict:
        ids = b.column(0).to_pylist()
        rows = [(i, [p._asdict() for p in got]) for i, got in zip(ids, given.value.found(b.column(1).to_pylist())) if got]
        return dict(zip(("doc_id", "passages"), zip(*rows) if rows else [[]] * 2))

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()), run, "doc_id long, passages array<struct<license:string,dice:double,shared:long,first:long,end:long>>")


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, license, dice, n_passages, first_word, end_word: a row for each document and licence it holds; the best passage is the one of the highest coefficient, then the first."""
    own = license_passages(docs, templates, least)
    names = F.array_distinct(F.col("passages.license"))
    own = own.select("doc_id", "passages", F.explode(names).alias("license"))
    mine = F.filter("passages", lambda p: p["license"] == F.col("license"))
    best = F.array_max(F.transform(mine, lambda p: F.struct(p["dice"].alias("dice"), (-p["first"]).alias("first"), p["end"].alias("end"))))
    own = own.select("doc_id", "license", F.size(mine).cast("long").alias("n_passages"), best.alias("best"))
    return own.select("doc_id", "license", "best.dice", "n_passages", (-F.col("best.first")).alias("first_word"), F.col("best.end").alias("end_word"))


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
