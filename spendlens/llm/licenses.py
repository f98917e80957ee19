"""Licence scans: Dice coefficient of word bigrams between passages and licence templates.

A text is normalised (A-Z in lower case, words of letters, digits and anything
beyond ASCII). Each window of consecutive words, of one line or of several, that
may hold a template is compared with it: 2 x common bigrams / (bigrams of both), as
multisets. A window that begins or ends with a bigram the template does not have
is worse than one without it, so windows go from one of the template's bigrams to
another. Sizes bound the coefficient: with p and q bigrams it is at most
2 min(p, q) / (p + q), so for a threshold d a window has at most q x (2 - d) / d
bigrams and at least q x d / (2 - d) of them are the template's; places without so
many in reach are not looked at. ``Templates.scan`` compares windows of whole
lines only; ``Templates.passages`` is what documents are scanned with.

Templates are a bounded table (``MAX_TEMPLATES``, checked) and broadcast; texts
are read in blocks and scored in place, without a shuffle.

Defined results: null and empty texts have no licence; several licences in one
text are all listed, each with its best window; ties go to the earlier window;
repeated rows are scanned each; without templates nothing is found; columns of
the documents pass through, and one named like a result is replaced by it.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.llm import words as W
from spendlens.llm.common import small_batches

THRESHOLD = 0.8
MAX_TEMPLATES = 10_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# fixed values: notices by which works are put under a licence, and short licence texts; whole texts lie in TEXTS
TEXTS = Path(__file__).with_name("license_texts")
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS "
        "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
        "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA "
        "OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You "
        "may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0-notice": "This work is dedicated to the public domain under CC0 1.0.",
    "BSD-3-Clause-notice": "Licensed under the BSD 3-Clause License.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Proprietary": "All rights reserved.",
    "BSD-2-Clause-notice": "Licensed under the BSD 2-Clause License.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0-notice": "Licensed under the Mozilla Public License, Version 2.0.",
    "EPL-2.0-notice": "Licensed under the Eclipse Public License, Version 2.0.",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This library is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "LGPL-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."
    ),
    "GFDL-1.3": (
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 "
        "or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover "
        "Texts. A copy of the license is included in the section entitled \"GNU Free Documentation License\"."
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/"
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
        "https://www.boost.org/LICENSE_1_0.txt)"
    ),
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0-notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0-notice": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-3.0-notice": "Licensed under CC BY 3.0.",
    "CC-BY-3.0": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "CC-BY-SA-3.0-notice": "Licensed under CC BY-SA 3.0.",
    "CC-BY-SA-3.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "CC-BY-NC-3.0-notice": "Licensed under CC BY-NC 3.0.",
    "CC-BY-NC-3.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 3.0 Unported License.",
    "CC-BY-ND-3.0-notice": "Licensed under CC BY-ND 3.0.",
    "CC-BY-ND-3.0": "This work is licensed under a Creative Commons Attribution-NoDerivs 3.0 Unported License.",
    "CC-BY-NC-SA-3.0-notice": "Licensed under CC BY-NC-SA 3.0.",
    "CC-BY-NC-SA-3.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License.",
    "CC-BY-NC-ND-3.0-notice": "Licensed under CC BY-NC-ND 3.0.",
    "CC-BY-NC-ND-3.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License.",
}

FOUND = T.ArrayType(
    T.StructType(
        [
            T.StructField("licence", T.StringType()),
            T.StructField("dice", T.DoubleType()),
            T.StructField("from_line", T.LongType()),
            T.StructField("to_line", T.LongType()),
        ]
    )
)


def built_in() -> list[tuple[str, str]]:
    """The templates used when none are given: notices, and the whole texts under their names with ``-text``."""
    return sorted([*TEMPLATES.items(), *((f"{f.stem}-text", f.read_text(encoding="utf-8")) for f in TEXTS.glob("*.txt"))])


def normal(text: str | None) -> list[str]:
    return WORD.findall(_lower(text or ""))


def _lower(text: str) -> str:
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def bigrams(words: list[str]) -> Counter:
    """Word bigrams; a single word is its own bigram with nothing after it."""
    return Counter(zip(words, words[1:])) if len(words) > 1 else Counter((w, "") for w in words)


def dice(a: Counter, b: Counter) -> float:
    total = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / total if total else 0.0


class Templates:
    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        made = sorted((sum(b.values()), name, b) for name, b in ((n, bigrams(normal(t))) for n, t in templates) if b)
        self.sizes = [s for s, _, _ in made]
        self.made, self.threshold = made, threshold
        self.seen = {g for _, _, b in made for g in b}
        self.low = threshold / (2 - threshold)
        self.largest = max(self.sizes, default=0) / self.low if made else 0
        # which templates hold a bigram, and how often: a slice of ``owners`` and ``times`` for each
        held: dict[tuple, list] = {}
        for t, (_, _, b) in enumerate(made):
            for g, n in b.items():
                held.setdefault(g, []).append((t, n))
        self.ids = {g: i for i, g in enumerate(held)}
        self.edges = np.cumsum([0, *map(len, held.values())])
        self.owners = np.array([t for x in held.values() for t, _ in x], dtype=np.int64)
        self.times = np.array([n for x in held.values() for _, n in x], dtype=np.int64)

    def fitting(self, size: int) -> list:
        """Templates that a window of ``size`` bigrams can reach the threshold with."""
        a = bisect.bisect_left(self.sizes, size * self.low - 1e-9)
        b = bisect.bisect_right(self.sizes, size / self.low + 1e-9)
        return self.made[a:b]

    def scan(self, text: str | None) -> list[dict]:
        if not self.made:
            return []
        seen = self.seen
        lines = [(k, words) for k, words in enumerate(map(normal, (text or "").split("\n"))) if words]
        # bigrams of any template, within each line and from the line before
        own = [sum(g in seen for g in zip(w, w[1:])) for _, w in lines]
        joint = [int(i > 0 and (lines[i - 1][1][-1], w[0]) in seen) for i, (_, w) in enumerate(lines)] + [0]
        best: dict[str, dict] = {}
        for i, (first, words) in enumerate(lines):
            if not own[i] and not joint[i + 1] and (len(words) > 1 or (words[0], "") not in seen):
                continue  # without this line the window is at least as good
            size, hits = -1, 0
            for j in range(i, len(lines)):
                size += len(lines[j][1])
                hits += own[j] + (joint[j] if j > i else 0)
                if max(1, size) > self.largest:
                    break
                if size < 1:
                    hits_here = (words[0], "") in seen
                elif own[j] or (joint[j] and j > i):
                    hits_here = hits >= self.low * size - 1e-9  # fewer cannot reach the threshold with any template
                else:
                    continue
                if not hits_here:
                    continue
                grams = bigrams([w for _, line in lines[i : j + 1] for w in line])
                for _, name, template in self.fitting(max(1, size)):
                    d = dice(grams, template)
                    if d >= self.threshold and d > best.get(name, {"dice": 0})["dice"]:
                        best[name] = {"licence": name, "dice": d, "from_line": first, "to_line": lines[j][0] + 1}
        return sorted(best.values(), key=lambda x: (-x["dice"], x["licence"]))

    def passages(self, text: str | None) -> list[dict]:
        """As ``scan`` over all windows of words, also those that begin or end inside a line."""
        words, line = [], []
        for k, part in enumerate((text or "").split("\n")):
            more = normal(part)
            words += more
            line += [k] * len(more)
        best = {}
        for t, d, a, b in self._windows(words):
            best[self.made[t][1]] = {"licence": self.made[t][1], "dice": d, "from_line": line[a], "to_line": line[b] + 1}
        return sorted(best.values(), key=lambda x: (-x["dice"], x["licence"]))

    def _windows(self, words: list[str]):
        """(template, coefficient, first word, last word) of the best window of each template."""
        get = self.ids.get
        ids = [get(g, -1) for g in zip(words, words[1:])]
        for k in sorted({w: k for k, w in reversed(list(enumerate(words))) if (w, "") in self.ids}.values()):
            g = get((words[k], ""))  # templates of a single word
            for t in self.owners[self.edges[g] : self.edges[g + 1]].tolist():
                yield t, 1.0, k, k
        ids = np.array(ids, dtype=np.int64)
        at = np.flatnonzero(ids >= 0)
        ids = ids[at]
        many = self.edges[ids + 1] - self.edges[ids]
        inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        slot = np.repeat(self.edges[ids], many) + inside
        place, owner = np.repeat(at, many), self.owners[slot]
        by = np.argsort(owner, kind="stable")
        place, owner, slot = place[by], owner[by], slot[by]
        begins = np.flatnonzero(np.diff(owner, prepend=-1))
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(owner)]):
            t = int(owner[a])
            q = self.sizes[t]
            need, longest = max(1, int(np.ceil(q * self.low - 1e-9))), int(q / self.low + 1e-9)
            if b - a < need:
                continue
            where = place[a:b]
            starts = np.flatnonzero(where[need - 1 :] - where[: b - a - need + 1] < longest)
            if len(starts):
                found = self._best(where, slot[a:b], starts, q, longest)
                if found:
                    yield t, *found

    def _best(self, where: np.ndarray, slot: np.ndarray, starts: np.ndarray, q: int, longest: int):
        # of a bigram that the template has n times, an occurrence counts unless n before it are in the window
        by = np.argsort(slot, kind="stable")
        same, n = slot[by], self.times[slot[by]]
        back = np.arange(len(by)) - n
        before = np.full(len(by), -1, dtype=np.int64)
        fits = np.flatnonzero(back >= 0)
        fits = fits[same[back[fits]] == same[fits]]
        before[by[fits]] = by[back[fits]]
        best, found = self.threshold - 1e-12, None
        ends = np.searchsorted(where, where[starts] + longest)
        for i, e in zip(starts.tolist(), ends.tolist()):
            hits = np.cumsum(before[i:e] < i)
            if 2 * hits[-1] < best * (hits[-1] + q):
                continue  # not even a window of these alone
            d = 2 * hits / (where[i:e] - where[i] + 1 + q)
            j = int(d.argmax())
            if d[j] > best:
                best, found = float(d[j]), (float(d[j]), int(where[i]), int(where[i + j]) + 1)
        return found


def scan(documents: DataFrame, templates: DataFrame | None = None, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """Adds ``licences``: name, coefficient and lines [from, to) of each licence found, the likeliest first.

    ``templates`` has ``licence, text``; without it the built-in texts are used.
    """
    small_batches(documents.sparkSession)
    if templates is None:
        rows = built_in()
    else:
        rows = [(r["licence"], r["text"]) for r in templates.select("licence", "text").distinct().limit(MAX_TEMPLATES + 1).collect()]
        if len(rows) > MAX_TEMPLATES:
            raise ValueError(f"more than {MAX_TEMPLATES} templates")
    names = [c for c in (documents.columns if keep is None else keep) if c != "licences"]
    sent = documents.sparkSession.sparkContext.broadcast(Templates(rows, threshold))
    schema = T.StructType([*[documents.schema[c] for c in names], T.StructField("licences", FOUND)])
    kind = pa.list_(pa.struct([("licence", pa.string()), ("dice", pa.float64()), ("from_line", pa.int64()), ("to_line", pa.int64())]))

    def run(batches):
        for block in W.blocks(batches):
            text = block.column(block.schema.get_field_index("text"))
            found = [sent.value.passages(t.as_py()) for t in text]
            arrays = [block.column(block.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(found, kind)], names=[*names, "licences"])

    return documents.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, schema)


def best(found: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The likeliest licence of each document and how many were found; ``keep`` names columns to leave beside them."""
    top = F.get("licences", F.lit(0))
    return found.select(
        "doc_id", top["licence"].alias("licence"), F.round(top["dice"], 6).alias("dice"),
        top["from_line"].alias("from_line"), top["to_line"].alias("to_line"), F.size("licences").cast("long").alias("n_licences"), *keep,
    )
